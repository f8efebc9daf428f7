"""Iso-value queries along an axis, and ordered compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.select import pair_levels
from fieldspark.operators.stencil import PENCIL, neighbour, pencil


def classify_iso(df: DataFrame, measure: str, iso: float, scale: float = 1.0) -> DataFrame:
    return df.withColumn("inside", F.col(measure) * scale >= iso)


def transitions(df: DataFrame, flag: str, axis: str) -> DataFrame:
    """Cells whose flag differs from that of the cell before; a cell after a gap has none before it."""
    return df.withColumn("before", neighbour(flag, axis, -1, "null")).where(F.col("before") != F.col(flag))


def iso_crossings(df: DataFrame, measure: str, iso: float | list[float], axis: str, scale: float = 1.0) -> DataFrame:
    """pencil, iso, at (crossing between neighbours, linear), enters, hit (1 for the first along the axis).

    Cells that aren't next to one another have no crossing between them. On bricks that survive pruning, taken with a layer of ghost
    cells, the crossings are those of the whole volume.
    """
    keys = PENCIL[axis]
    values = F.explode(F.array(*[F.lit(float(v)) for v in (iso if isinstance(iso, list) else [iso])]))
    rows = df.select(*keys, axis, (F.col(measure) * scale).alias("m")).withColumn("a", neighbour("m", axis, -1, "null")).where("a is not null").withColumn("iso", values)
    rows = rows.where((F.col("a") >= F.col("iso")) != (F.col("m") >= F.col("iso")))
    rows = rows.select(*keys, "iso", (F.col(axis) - 1 + (F.col("iso") - F.col("a")) / (F.col("m") - F.col("a"))).alias("at"), (F.col("m") >= F.col("iso")).alias("enters"))
    return rows.withColumn("hit", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "iso")).cast("int"))


def first_hit(df: DataFrame, measure: str, iso: float, axis: str, scale: float = 1.0) -> DataFrame:
    """Depth of the first crossing of each pencil."""
    return iso_crossings(df, measure, iso, axis, scale).groupBy(*PENCIL[axis]).agg(F.min("at").alias("depth"))


def iso_pair(fine: DataFrame, m1: str, iso1: float, coarse: DataFrame, m2: str, iso2: float, axis: str) -> DataFrame:
    """Crossings of a measure on the fine volume and of one on the filtered volume, in one order."""
    both = pair_levels(fine, coarse, [m2])
    a = iso_crossings(both, m1, iso1, axis).withColumn("surface", F.lit("fine"))
    b = iso_crossings(both, f"coarse_{m2}", iso2, axis).withColumn("surface", F.lit("coarse"))
    keys = PENCIL[axis]
    return a.unionByName(b).withColumn("hit", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "surface")).cast("int"))


def iso_cascade(levels: list[DataFrame], measure: str, isos: list[float]) -> DataFrame:
    """Cells of the finest level inside its iso value where every coarser level is inside its own; finest first."""
    rows = levels[0].where(F.col(measure) >= isos[0])
    for k, (level, iso) in enumerate(zip(levels[1:], isos[1:], strict=True)):
        inside = level.where(F.col(measure) >= iso).select("t", "x", "y", "z")
        rows = rows.join(inside, ["t", "x", "y", "z"], "left_semi").withColumn("levels", F.lit(k + 2))
    return rows


def transfer(df: DataFrame, col: str, lo: float, hi: float, c0: tuple[float, float, float, float], c1: tuple[float, float, float, float]) -> DataFrame:
    """Adds r, g, b, a: the blend of two colours by a value's place in [lo, hi]."""
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(col) - lo) / (hi - lo)))
    return df.withColumns({n: F.lit(a) + f * (b - a) for n, a, b in zip("rgba", c0, c1, strict=True)})


def emission_absorption(df: DataFrame, step: float) -> DataFrame:
    """Emission and absorption (a) to colour and opacity of a segment of the given length."""
    tau = F.col("a") * step
    f = tau * F.exp(-tau * 0.5)
    return df.withColumns({"r": F.col("r") * f, "g": F.col("g") * f, "b": F.col("b") * f, "a": 1.0 - F.exp(-tau)})


def transmittance(alpha: Column, axis: str) -> Column:
    """What passes the cells before this one: the product of 1 - alpha; 0 behind an opaque cell."""
    before = pencil(axis).rowsBetween(Window.unboundedPreceding, -1)
    clear = F.coalesce(F.max(F.when(alpha >= 1.0, 1).otherwise(0)).over(before), F.lit(0)) == 0
    logs = F.sum(F.when(alpha < 1.0, F.log1p(-alpha)).otherwise(0.0)).over(before)
    return F.when(clear, F.exp(F.coalesce(logs, F.lit(0.0)))).otherwise(0.0)


def with_transmittance(df: DataFrame, alpha: Column, axis: str, cells: int, name: str = "pass") -> DataFrame:
    """df with transmittance(), by bricks of so many cells along the axis.

    A brick and pencil has one product, and these meet in a window of the pencil's bricks; within a brick the window is the
    brick's. So no task holds a pencil's cells.
    """
    keys = PENCIL[axis]
    rows = df.withColumns({"_brick": F.floor(F.col(axis) / cells).cast("int"), "_alpha": alpha})
    shut, clear = F.max((F.col("_alpha") >= 1.0).cast("int")), F.sum(F.when(F.col("_alpha") < 1.0, F.log1p(-F.col("_alpha"))).otherwise(0.0))
    whole = rows.groupBy(*keys, "_brick").agg(shut.alias("_shut"), clear.alias("_log"))
    earlier = Window.partitionBy(*keys).orderBy("_brick").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_brick", F.coalesce(F.max("_shut").over(earlier), F.lit(0)).alias("_shut"), F.coalesce(F.sum("_log").over(earlier), F.lit(0.0)).alias("_log"))
    inner = Window.partitionBy(*keys, "_brick").orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_own_shut": F.coalesce(shut.over(inner), F.lit(0)), "_own_log": F.coalesce(clear.over(inner), F.lit(0.0))}).join(whole, [*keys, "_brick"])
    value = F.when(F.greatest("_shut", "_own_shut") == 1, 0.0).otherwise(F.exp(F.col("_log") + F.col("_own_log")))
    return rows.select(*[F.col(c) for c in df.columns if c != name], value.alias(name))


def composite(df: DataFrame, axis: str, clip: tuple[float, float] | None = None) -> DataFrame:
    """Front-to-back sum of (r, g, b, a) along an axis: a colour for each pencil; clip: the closed depth range that counts."""
    if clip:
        df = df.where(F.col(axis).between(*clip))
    rows = df.withColumn("pass", transmittance(F.col("a"), axis))
    return rows.groupBy(*PENCIL[axis]).agg(*[F.sum(F.col("pass") * F.col(c)).alias(c) for c in "rgb"], F.sum(F.col("pass") * F.col("a")).alias("a"))


def _over(a: Column, b: Column) -> Column:
    """What two pieces of a ray look like, the first in front: colours and opacity so far (r, g, b, a), and what passes (pass)."""
    return F.struct(*[(a[c] + a["pass"] * b[c]).alias(c) for c in "rgba"], (a["pass"] * b["pass"]).alias("pass"))


def _folded(pieces: Column) -> Column:
    """Pieces in their order put over one another."""
    none = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"], F.lit(1.0).alias("pass"))
    return F.aggregate(pieces, none, _over)


def composite_bricks(df: DataFrame, axis: str, cells: int, clip: tuple[float, float] | None = None) -> DataFrame:
    """composite() by bricks of so many cells along the axis.

    The cells of a brick and pencil are put over one another where the brick lies, and the pieces of a pencil then in depth order: between
    tasks goes a row for each brick and pencil. A cell behind an opaque one adds nothing.
    """
    if clip:
        df = df.where(F.col(axis).between(*clip))
    keys = PENCIL[axis]
    cell = F.struct(F.col(axis).alias("at"), *[F.col(c).cast("double").alias(c) for c in "rgba"], (1.0 - F.least(F.col("a").cast("double"), F.lit(1.0))).alias("pass"))
    pieces = df.groupBy(*keys, F.floor(F.col(axis) / cells).cast("int").alias("_brick")).agg(_folded(F.array_sort(F.collect_list(cell))).alias("p"))
    piece = F.struct(F.col("_brick"), *[F.col(f"p.{c}").alias(c) for c in (*"rgba", "pass")])
    return pieces.groupBy(*keys).agg(_folded(F.array_sort(F.collect_list(piece))).alias("p")).select(*keys, *[F.col(f"p.{c}").alias(c) for c in "rgba"])


def color_lines(vertices: DataFrame, mode: str, max_age: float = 1.0, column: str | None = None) -> DataFrame:
    """Adds `color`: the line's number modulo 1024, its age in [0, 1], its region, or a measure."""
    c = {"line": F.col("line_id") % 1024 / 1024.0, "age": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("time") / max_age)) if "time" in vertices.columns else F.lit(0.0)}
    if mode in ("region", "measure"):
        return vertices.withColumn("color", F.col(column or "region").cast("double"))
    return vertices.withColumn("color", c[mode])
