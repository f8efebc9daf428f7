"""Seeds of traces, as tables made by arithmetic on ranges; random ones from a small generator that SQL can replay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from fieldspark.functions.info import VolumeInfo
from fieldspark.operators.select import with_region

Box = tuple[tuple[float, float, float], tuple[float, float, float]]  # least corner, size
MODULUS = 2147483647


def uniform(key: Column, seed: int, draw: int) -> Column:
    """A number in [0, 1) from a key: three rounds of a multiplicative generator."""
    x = F.pmod(key * 48271 + seed * 69621 + draw * 16807 + 12345, F.lit(MODULUS))
    for a in (48271, 69621, 40014):
        x = F.pmod(x * a + 1013, F.lit(MODULUS))
    return x.cast("double") / MODULUS


def _placed(df: DataFrame, key: Column, box: Box, seed: int) -> DataFrame:
    (lo, size) = box
    return df.withColumns({a: lo[k] + size[k] * uniform(key, seed, k) for k, a in enumerate("xyz")})


def seed_random(spark: SparkSession, n: int, box: Box, seed: int = 1) -> DataFrame:
    return _placed(spark.range(n).withColumnRenamed("id", "pid"), F.col("pid"), box, seed)


def seed_grid(spark: SparkSession, n: int, box: Box) -> DataFrame:
    """n seeds by rows of floor(sqrt(n)) on the box's least z plane."""
    lo, size = box
    m = max(1, math.isqrt(n))
    return spark.range(n).select(F.col("id").alias("pid"), (lo[0] + size[0] * (F.col("id") % m) / float(m)).alias("x"), (lo[1] + size[1] * F.floor(F.col("id") / m) / float(m)).alias("y"), F.lit(float(lo[2])).alias("z"))


def seed_ftle(spark: SparkSession, res: int, box: Box, slice_at: float, sep: tuple[float, float, float]) -> DataFrame:
    """gx, gy, k (0..5: -x +x -y +y -z +z) and the place of each stencil point; pid numbers them."""
    lo, size = box
    grid = spark.range(res * res).select(F.expr(f"int(id div {res})").alias("gx"), F.expr(f"int(id % {res})").alias("gy"))
    off = [F.struct(F.lit(2 * a + s).alias("k"), *[F.lit((2 * s - 1) * sep[a] * (a == c)).alias(f"d{x}") for c, x in enumerate("xyz")]) for a in range(3) for s in range(2)]
    rows = grid.withColumn("o", F.explode(F.array(*off)))
    return rows.select(((F.col("gx") * res + F.col("gy")) * 6 + F.col("o.k")).cast("long").alias("pid"), "gx", "gy", "o.k", (lo[0] + size[0] * F.col("gx") / float(res) + F.col("o.dx")).alias("x"), (lo[1] + size[1] * F.col("gy") / float(res) + F.col("o.dy")).alias("y"), (F.lit(float(slice_at)) + F.col("o.dz")).alias("z"))


def seed_regions(spark: SparkSession, n: int, box: Box, regions: DataFrame, picked: list[int], info: VolumeInfo, width: int, height: int, seed: int = 1, tries: int = 20) -> DataFrame:
    """The first of at most `tries` draws whose region is picked; seeds without one lie outside the domain."""
    rows = spark.range(n).withColumnRenamed("id", "pid").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    rows = _placed(rows, F.col("pid") * tries + F.col("attempt"), box, seed)
    hit = with_region(rows, regions, info, width, height).where(F.col("region").isin(picked))
    first = hit.groupBy("pid").agg(F.min_by(F.struct("x", "y", "z"), "attempt").alias("p"))
    out = [2.0 * h + 1.0 for h in info.half_size_world]
    return spark.range(n).withColumnRenamed("id", "pid").join(first, "pid", "left").select("pid", *[F.coalesce(F.col(f"p.{a}"), F.lit(o)).alias(a) for a, o in zip("xyz", out, strict=True)])


def emit_seeds(spark: SparkSession, n: int, box: Box, emissions: int, fresh: bool, seed: int = 1) -> DataFrame:
    """Seeds of each emission: the same ones, or new ones each time."""
    rows = spark.range(n * emissions).select(F.col("id").alias("pid"), F.expr(f"int(id div {n})").alias("emission"), (F.col("id") % n).alias("slot"))
    return _placed(rows, F.col("pid") if fresh else F.col("slot"), box, seed)


def emissions(spark: SparkSession, n: int, box: Box, first: int, count: int, fresh: bool, seed: int = 1) -> DataFrame:
    """line, emission, x, y, z of n seed lines for some emissions: the same places, or new ones each time."""
    rows = spark.range(n * count).select((F.col("id") % n).alias("line"), (F.expr(f"id div {n}") + first).alias("emission"))
    return _placed(rows, F.col("emission") * n + F.col("line") if fresh else F.col("line"), box, seed)


def checkpoints(seeds: DataFrame, t0: float = 0.0, dt: float = 0.005) -> DataFrame:
    """The first state of lines: line_id, place, seed place, time, step, normal, counters."""
    rows = seeds.withColumnRenamed("pid", "line_id") if "line_id" not in seeds.columns else seeds
    start = F.col("time") if "time" in rows.columns else F.lit(float(t0))
    return rows.select("line_id", "x", "y", "z", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), start.alias("time"), F.lit(float(dt)).alias("dt"), F.lit(0.0).alias("nrm_x"), F.lit(0.0).alias("nrm_y"), F.lit(0.0).alias("nrm_z"), F.lit(0).cast("long").alias("steps_total"), F.lit(0).cast("long").alias("steps_accepted"), F.lit(0).cast("int").alias("length"), F.lit("active").alias("status"))


@udtf(returnType="pid: bigint, x: double, y: double, z: double")
class GridSeeds:
    """seed_grid for SQL: grid_seeds(n, x, y, z, sx, sy)."""

    def eval(self, n: int, x: float, y: float, z: float, sx: float, sy: float):
        m = max(1, math.isqrt(n))
        for i in range(n):
            yield i, x + sx * (i % m) / m, y + sy * (i // m) / m, z


def register_seed_functions(spark: SparkSession) -> None:
    spark.udtf.register("grid_seeds", GridSeeds)
