"""Selection: boxes, planes, iso pruning, slices, thresholds, regions; and the joins that apply them."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES, VolumeInfo
from fieldspark.functions.session import cut

Box = tuple[tuple[float, float, float], tuple[float, float, float]]

#: Rows of a lookup table that are broadcast at most; larger ones are left to the optimiser.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast, if there are no more rows than that; they are kept as they are counted, so what made them runs once."""
    head = cut(df.limit(rows + 1))
    return F.broadcast(head) if head.count() <= rows else df


def clip_box(df: DataFrame, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> DataFrame:
    """Points in a closed box, or bricks (lo_x..hi_z) that overlap it."""
    test = F.lit(True)
    for a, low, high in zip(AXES, lo, hi, strict=True):
        if f"lo_{a}" in df.columns:
            test = test & (F.greatest(F.col(f"lo_{a}"), F.lit(float(low))) < F.least(F.col(f"hi_{a}"), F.lit(float(high))))
        else:
            test = test & F.col(a).between(low, high)
    return df.where(test)


def clip_planes(bricks: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Drops bricks of which all corners lie on or behind one of the planes."""
    for p in planes:
        corners = [p[0] * F.col(f"{i}_x") + p[1] * F.col(f"{j}_y") + p[2] * F.col(f"{k}_z") + p[3] for i, j, k in product(("lo", "hi"), repeat=3)]
        bricks = bricks.where(F.greatest(*corners) > 0)
    return bricks


def prune_iso(meta: DataFrame, measure: str, iso: float, scale: float = 1.0) -> DataFrame:
    """Bricks whose scaled range of a measure holds the iso value."""
    a, b = F.col("vmin") * scale, F.col("vmax") * scale
    return meta.where((F.col("measure") == measure) & (F.least(a, b) <= iso) & (F.greatest(a, b) >= iso))


def in_bricks(voxels: DataFrame, bricks: DataFrame, keep: bool = True) -> DataFrame:
    """Voxels (with bx, by, bz) whose brick is, or is not, in a list."""
    keys = [k for k in ("t", "bx", "by", "bz") if k in bricks.columns]
    return voxels.join(small(bricks.select(*keys).distinct()), keys, "left_semi" if keep else "left_anti")


def slice_at(df: DataFrame, axis: str, value: float) -> DataFrame:
    return df.where(F.col(axis) == value)


def split_by_plane(df: DataFrame, axis: str, value: float) -> DataFrame:
    """Adds side: below, or above (on the plane: above)."""
    return df.withColumn("side", F.when(F.col(axis) < value, "below").otherwise("above"))


def drop_slow(df: DataFrame, vmin: float) -> DataFrame:
    return df.where(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w") >= vmin * vmin)


def region_place(info: VolumeInfo, width: int, height: int, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """Column and row of a position's region; y runs down the raster, indices are clamped."""
    half = info.half_size_world
    fx, fy = (F.col(x) + half[0]) / (2 * half[0]), 1.0 - (F.col(y) + half[1]) / (2 * half[1])
    place = lambda f, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(f * n))).cast("int")
    return place(fx, width), place(fy, height)


def with_region(df: DataFrame, regions: DataFrame, info: VolumeInfo, width: int, height: int, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the region id of a position (0: none)."""
    tx, ty = region_place(info, width, height, x, y)
    return df.withColumns({"tx": tx, "ty": ty}).join(small(regions), ["tx", "ty"], "left").withColumn("region", F.coalesce("region", F.lit(0).cast("long"))).drop("tx", "ty")


def filter_region(df: DataFrame, regions: DataFrame, picked: list[int], info: VolumeInfo, width: int, height: int, x: str = "x", y: str = "y") -> DataFrame:
    return with_region(df, regions, info, width, height, x, y).where(F.col("region").isin(picked))


def mask_by_measure(df: DataFrame, measure: str, threshold: float, cols: list[str]) -> DataFrame:
    """Zeros where the measure is under the threshold."""
    return df.withColumns({c: F.when(F.col(measure) >= threshold, F.col(c)).otherwise(0.0) for c in cols})


# ---------------------------------------------------------------- joins


def join_bricks(points: DataFrame, bricks: DataFrame, info: VolumeInfo, time: str | None = None) -> DataFrame:
    """Points (bx, by, bz, and t or time) with their brick; time="floor_ceil": with its step and the next."""
    if time is None:
        return points.join(bricks, [k for k in ("t", "bx", "by", "bz") if k in points.columns and k in bricks.columns])
    step = F.floor(F.col("time") / info.dt).cast("int")
    return points.withColumn("t", F.explode(F.array(step, step + 1))).join(bricks, ["t", "bx", "by", "bz"])


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(small(table), keys, "left")


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Range join on boxes (lo_x..hi_z, half open), by cells of a hierarchy of grids.

    A box lies at the level whose cells are as large as its longest side, so it meets eight of them at most; a point looks up one
    cell for each level that has boxes. What remains is a join on equal cells, and the boxes' bounds. Boxes without a finite side
    are in one cell of a level of their own.
    """
    side = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES]).cast("double")
    far = F.greatest(*[F.abs(F.col(f"{e}_{a}").cast("double")) for e in ("lo", "hi") for a in AXES])
    finite = far < 1e300
    # cells of less than 2^-50 of the place would not be told apart
    level = F.when(finite, F.ceil(F.log2(F.greatest(side, far * 2.0**-50, F.lit(1e-300)))).cast("int")).otherwise(BEYOND)
    ok = F.lit(True)
    for a in AXES:
        ok = ok & (F.col(f"hi_{a}") > F.col(f"lo_{a}"))
    rows = boxes.where(ok).withColumn("_level", level)
    levels = [r[0] for r in rows.select("_level").distinct().collect()]  # powers of two that doubles have: some thousand at most
    cell = lambda x, lv: F.when(lv == BEYOND, 0.0).otherwise(F.floor(x.cast("double") / F.pow(F.lit(2.0), lv)).cast("double"))
    for a in AXES:
        low, high = cell(F.col(f"lo_{a}"), F.col("_level")), cell(F.col(f"hi_{a}"), F.col("_level"))
        rows = rows.withColumn(f"_c{a}", F.explode(F.array_distinct(F.array(low, high))))
    rows = rows.withColumnsRenamed({f"_c{a}": f"_b{a}" for a in AXES} | {"_level": "_of"})
    at = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    at = at.withColumns({f"_c{a}": cell(F.col(a), F.col("_level")) for a in AXES})
    test = F.col("_level") == F.col("_of")
    for a in AXES:
        test = test & (F.col(f"_c{a}") == F.col(f"_b{a}")) & (F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) < F.col(f"hi_{a}"))
    return at.join(rows, test).drop("_level", "_of", *[f"_{k}{a}" for k in "bc" for a in AXES])


#: The level of boxes without a finite side.
BEYOND = 5000


def cross_bricks(seeds: DataFrame, bricks: DataFrame) -> DataFrame:
    """Every seed in every brick; seeds are the small side."""
    return bricks.crossJoin(small(seeds))


def pair_levels(fine: DataFrame, coarse: DataFrame, cols: list[str]) -> DataFrame:
    """Channels of a coarse volume beside the fine one's at each voxel, as coarse_<name>."""
    return fine.join(coarse.select("t", *AXES, *[F.col(c).alias(f"coarse_{c}") for c in cols]), ["t", *AXES])


def sync_channels(heat: DataFrame, picked: DataFrame) -> DataFrame:
    """Heat map channels of picked regions: others are dropped, new ones start with no counts."""
    kept = heat.join(picked, "channel", "left_semi")
    new = picked.join(heat.select("channel").distinct(), "channel", "left_anti")
    return kept.unionByName(new.select("channel", *[F.lit(None).cast(dict(heat.dtypes)[c]).alias(c) for c in heat.columns if c not in ("channel", "cnt")], F.lit(0).cast("long").alias("cnt")))


# ---------------------------------------------------------------- order


def depth_sort(df: DataFrame, plane: tuple[float, float, float, float]) -> DataFrame:
    """Particles by depth behind a plane, with the depth."""
    d = -(plane[0] * F.col("x") + plane[1] * F.col("y") + plane[2] * F.col("z") + plane[3])
    return df.withColumn("depth", d).orderBy("depth", "pid")
