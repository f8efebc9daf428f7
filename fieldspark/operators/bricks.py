"""Bricks: assignment, ghost cells, packing, metadata, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES, VolumeInfo
from fieldspark.functions.session import cut
from fieldspark.operators.select import BROADCAST_ROWS, small


def assign_bricks(df: DataFrame, info: VolumeInfo) -> DataFrame:
    """Adds the brick whose core holds a cell."""
    info.check()
    return df.withColumns({f"b{a}": F.floor(F.col(a) / info.core).cast("int") for a in AXES})


def brick_sizes(df: DataFrame, info: VolumeInfo) -> DataFrame:
    """Adds cells per axis of each brick, ghost cells included; bricks at the upper border are cut."""
    return df.withColumns({f"n{a}": F.least(F.lit(info.brick), F.lit(n) - F.col(f"b{a}") * info.core + 2 * info.overlap).cast("int") for a, n in zip(AXES, info.size, strict=True)})


def _between(low: int, high: int):
    return lambda p: (p >= low) & (p < high)


def _wrapped(n: int):
    return lambda p: F.pmod(p, F.lit(n))


def with_halo(df: DataFrame, info: VolumeInfo, boundary: str | None = None, halo: int | None = None) -> DataFrame:
    """Cells copied to every brick that needs them: adds bx, by, bz, the place gx, gy, gz (beyond the volume at its borders)
    and is_halo. Each axis gives the at most three bricks around a cell, and at a border the ghost places it stands for."""
    info.check()
    boundary = boundary or ("periodic" if info.periodic else "clamp")
    w = info.overlap if halo is None else halo
    for a, n, count in zip(AXES, info.size, info.brick_count, strict=True):
        cell = F.col(a)
        here = F.array(cell)
        if boundary == "clamp":
            low = F.when(cell == 0, F.sequence(F.lit(-w), F.lit(-1))).otherwise(F.array().cast("array<int>")) if w else F.array().cast("array<int>")
            high = F.when(cell == n - 1, F.sequence(F.lit(n), F.lit(n + w - 1))).otherwise(F.array().cast("array<int>")) if w else F.array().cast("array<int>")
            places = F.concat(here, low, high)
        else:
            places = F.filter(F.array(cell, cell - n, cell + n), _between(-w, n + w))
        df = df.withColumn(f"g{a}", F.explode(places))
        first = F.greatest(F.lit(0), F.floor((F.col(f"g{a}") - w) / info.core)).cast("int")
        last = F.least(F.lit(count - 1), F.floor((F.col(f"g{a}") + w) / info.core)).cast("int")
        df = df.withColumn(f"b{a}", F.explode(F.sequence(first, last)))
        own = [F.col(f"b{a}") * info.core, F.least(F.lit(n), (F.col(f"b{a}") + 1) * info.core)]
        df = df.where((F.col(f"g{a}") >= own[0] - w) & (F.col(f"g{a}") < own[1] + w))
    core = F.lit(False)
    for a, n in zip(AXES, info.size, strict=True):
        low = F.col(f"b{a}") * info.core
        core = core | (F.col(f"g{a}") < low) | (F.col(f"g{a}") >= F.least(F.lit(n), low + info.core))
    return df.withColumn("is_halo", core)


#: The 27 places of a brick beside another: itself and its neighbours by face, edge and corner.
BESIDE = tuple((x, y, z) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1))


def around(bricks: DataFrame, info: VolumeInfo) -> DataFrame:
    """t, bx, by, bz, beside: bricks of a list and their neighbours; bit k of beside says that the list has the brick at BESIDE[k] from here."""
    places = F.explode(F.array(*[F.struct(*[F.lit(-o).alias(f"d{a}") for a, o in zip(AXES, off, strict=True)], F.lit(1 << k).alias("bit")) for k, off in enumerate(BESIDE)]))
    rows = bricks.select("t", "bx", "by", "bz", places.alias("p"))
    to = [F.col(f"b{a}") + F.col(f"p.d{a}") for a in AXES]
    if info.periodic:
        to = [F.pmod(c, F.lit(n)) for c, n in zip(to, info.brick_count, strict=True)]
    rows = rows.select("t", *[c.cast("int").alias(f"b{a}") for a, c in zip(AXES, to, strict=True)], "p.bit")
    for a, n in zip(AXES, info.brick_count, strict=True):
        rows = rows.where(F.col(f"b{a}").between(0, n - 1))
    return rows.groupBy("t", "bx", "by", "bz").agg(F.bit_or("bit").alias("beside"))


def with_ghosts(df: DataFrame, bricks: DataFrame, info: VolumeInfo, halo: int = 1) -> DataFrame:
    """Cells of the listed bricks (t, bx, by, bz), and those of other bricks that lie within `halo` cells of one; adds bx, by, bz, is_halo.

    A cell comes once. Stencils up to `halo` cells wide give the same on cells that aren't is_halo as on the whole volume. The
    list is joined to cells by their brick, so no cell is copied; the halo must fit every brick.
    """
    thin = [n - (c - 1) * info.core for n, c in zip(info.size, info.brick_count, strict=True)]
    if halo > info.core or (info.periodic and halo > min(thin)):
        raise ValueError(f"a halo of {halo} cells spans more than a brick")
    cells = df if "bx" in df.columns else assign_bricks(df, info)
    near = {}
    for a, n in zip(AXES, info.size, strict=True):
        low = F.col(f"b{a}") * info.core
        near[a] = {-1: F.col(a) - low < halo, 0: F.lit(True), 1: F.col(a) >= F.least(low + info.core, F.lit(n)) - halo}
    own = F.col("beside").bitwiseAND(1 << BESIDE.index((0, 0, 0))) != 0
    keep = own
    for k, off in enumerate(BESIDE):
        if any(off):
            test = F.col("beside").bitwiseAND(1 << k) != 0
            for a, o in zip(AXES, off, strict=True):
                test = test & near[a][o]
            keep = keep | test
    return cells.join(small(around(bricks, info)), ["t", "bx", "by", "bz"]).where(keep).withColumn("is_halo", ~own).drop("beside")


def ghost_ranges(df: DataFrame, info: VolumeInfo, cols: list[str]) -> DataFrame:
    """t, bx, by, bz, measure, vmin, vmax of each brick's cells and the layer around it; cells at borders are told to all bricks they border on."""
    cells = assign_bricks(df, info) if "bx" not in df.columns else df
    for a, n, count in zip(AXES, info.size, info.brick_count, strict=True):
        b, low = F.col(f"b{a}"), F.col(f"b{a}") * info.core
        beside = F.array_compact(F.array(b, F.when(F.col(a) == low, b - 1), F.when(F.col(a) == F.least(low + info.core, F.lit(n)) - 1, b + 1)))
        beside = F.transform(beside, _wrapped(count)) if info.periodic else F.filter(beside, _between(0, count))
        cells = cells.withColumn(f"b{a}", F.explode(beside))
    wide = cells.groupBy("t", "bx", "by", "bz").agg(*[f(m).alias(f"{n}_{m}") for m in cols for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"lo_{m}").cast("double").alias("vmin"), F.col(f"hi_{m}").cast("double").alias("vmax")) for m in cols]))
    return wide.select("t", "bx", "by", "bz", rows.alias("r")).select("t", "bx", "by", "bz", "r.*")


def pack_bricks(df: DataFrame, cols: list[str], place: tuple[str, str, str] = ("gx", "gy", "gz")) -> DataFrame:
    """A row for each brick with its extent and an array for each channel, x fastest."""
    key = F.struct(*[F.col(p).alias(f"k{k}") for k, p in enumerate(reversed(place))], *cols)
    rows = df.groupBy("t", "bx", "by", "bz").agg(F.array_sort(F.collect_list(key)).alias("cells"), *[(F.max(p) - F.min(p) + 1).cast("int").alias(f"n{a}") for a, p in zip(AXES, place, strict=True)], *[F.min(p).alias(f"o{a}") for a, p in zip(AXES, place, strict=True)])
    return rows.select("t", "bx", "by", "bz", "nx", "ny", "nz", "ox", "oy", "oz", *[F.col(f"cells.{c}").alias(c) for c in cols])


def unpack_bricks(bricks: DataFrame, cols: list[str]) -> DataFrame:
    """The cells of packed bricks."""
    rows = bricks.select("t", "bx", "by", "bz", "nx", "ny", "ox", "oy", "oz", F.posexplode(F.arrays_zip(*cols)).alias("i", "c"))
    return rows.select("t", "bx", "by", "bz", (F.col("ox") + F.col("i") % F.col("nx")).alias("gx"), (F.col("oy") + F.expr("(i div nx) % ny")).cast("int").alias("gy"), (F.col("oz") + F.expr("i div (nx * ny)")).cast("int").alias("gz"), *[F.col(f"c.{c}").alias(c) for c in cols])


def deal(rows: DataFrame, bricks: DataFrame, keys: list[str], bound: int, ident: str = "line_id") -> tuple[DataFrame, DataFrame] | None:
    """Rows and the packed bricks they need, both with a `copy`; None if there are no rows.

    A brick with rows comes once for each `bound` of them or part of it; rows are dealt to its copies by a hash of ident. keys: the brick, and its
    step t, or tk, the step that a pair begins with.
    """
    load = cut(rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(bound)).cast("int").alias("copies")))
    number, total = load.agg(F.count("*"), F.sum("copies")).first()
    if not number:
        return None
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    dealt = rows.join(few(load, number), keys).withColumn("copy", F.pmod(F.xxhash64(ident), F.col("copies")).cast("int")).drop("copies")
    need = load.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    if "tk" in keys:
        need, total = need.withColumn("t", F.explode(F.array("tk", F.col("tk") + 1))), 2 * total
    return dealt, bricks.join(few(need, total), ["bx", "by", "bz"] + (["t"] if "t" in need.columns else []))


def brick_meta(df: DataFrame, info: VolumeInfo, measures: list[str]) -> DataFrame:
    """t, bx, by, bz, measure, vmin, vmax over core cells: one aggregate for all measures, then rows."""
    wide = assign_bricks(df, info).groupBy("t", "bx", "by", "bz").agg(*[f(m).alias(f"{n}_{m}") for m in measures for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"lo_{m}").alias("vmin"), F.col(f"hi_{m}").alias("vmax")) for m in measures]))
    return wide.select("t", "bx", "by", "bz", rows.alias("r")).select("t", "bx", "by", "bz", "r.*")


#: Order of the six directions: -x -y -z +x +y +z.
DIRECTIONS = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (1, 0, 0), (0, 1, 0), (0, 0, 1))


def brick_neighbors(bricks: DataFrame, info: VolumeInfo) -> DataFrame:
    """bx, by, bz, dir, nbx, nby, nbz for neighbours within the lattice."""
    d = F.explode(F.array(*[F.struct(F.lit(k).alias("dir"), *[F.lit(o).alias(f"d{a}") for a, o in zip(AXES, off, strict=True)]) for k, off in enumerate(DIRECTIONS)]))
    out = bricks.select("bx", "by", "bz", d.alias("d")).select("bx", "by", "bz", "d.dir", *[(F.col(f"b{a}") + F.col(f"d.d{a}")).alias(f"nb{a}") for a in AXES])
    for a, n in zip(AXES, info.brick_count, strict=True):
        out = out.where(F.col(f"nb{a}").between(0, n - 1))
    return out


#: What two volumes must share for the steps of one to go on those of the other.
GEOMETRY = ("nx", "ny", "nz", "hx", "hy", "hz", "dt", "periodic", "brick", "overlap")


def assert_appendable(a: VolumeInfo, b: VolumeInfo) -> None:
    """Raises if steps of b can't be appended to a."""
    for field in GEOMETRY:
        if getattr(a, field) != getattr(b, field):
            raise ValueError(f"{field} differs: {getattr(a, field)} and {getattr(b, field)}")


def appendable(infos: DataFrame, info: VolumeInfo) -> DataFrame:
    """Descriptions (a row each, with the columns of VolumeInfo) with `differs`: the first field in which they differ from info, or null."""
    differs = F.coalesce(*[F.when(~F.col(f).eqNullSafe(F.lit(getattr(info, f))), F.lit(f)) for f in GEOMETRY])
    return infos.withColumn("differs", differs)


def order_by_distance(bricks: DataFrame, info: VolumeInfo, p: tuple[float, float, float]) -> DataFrame:
    """Bricks with the distance of their centre from a viewpoint, nearest first."""
    d = F.lit(0.0)
    for a, half, size, v in zip(AXES, info.half_size_world, info.brick_size_world, p, strict=True):
        low = F.lit(-half) + F.col(f"b{a}") * size
        d = d + ((low + F.least(low + size, F.lit(half))) / 2.0 - v) ** 2
    return bricks.withColumn("distance", F.sqrt(d)).orderBy("distance", "bz", "by", "bx")


def append_timesteps(a: DataFrame, b: DataFrame, info_a: VolumeInfo, info_b: VolumeInfo) -> DataFrame:
    """Steps of b after those of a."""
    assert_appendable(info_a, info_b)
    return a.unionByName(b.withColumn("t", F.col("t") + info_a.nt))


def densify(df: DataFrame, info: VolumeInfo, cols: list[str]) -> DataFrame:
    """Every cell of the lattice; cells without a row get zeros."""
    n = info.nx * info.ny * info.nz
    cells = df.sparkSession.range(n * info.nt).select(F.expr(f"int(id div {n})").alias("t"), F.expr(f"int(id % {info.nx})").alias("x"), F.expr(f"int((id div {info.nx}) % {info.ny})").alias("y"), F.expr(f"int((id div {info.nx * info.ny}) % {info.nz})").alias("z"))
    return cells.join(df, ["t", "x", "y", "z"], "left").select("t", "x", "y", "z", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def ordered(cols: list[str], by: list[str]):
    return Window.partitionBy(*by).orderBy(*cols)
