"""Volumes, points and trajectories derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo
from fieldspark.operators.bricks import densify

INFO = VolumeInfo(nx=8, ny=8, nz=8, nt=2, brick=4, overlap=1)
CHANNELS = ["u", "v", "w", "temp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded alike in all engines, without a negative zero. Halves, which sums in another order may miss by a hair, go up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5001) / 1e6 + 0.0


def grid_info(n: int = 8) -> VolumeInfo:
    return VolumeInfo(nx=n, ny=n, nz=n, nt=2, brick=4 if n <= 8 else 16, overlap=1 if n <= 8 else 4)


def grid(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """t, x, y, z, u, v, w, temp from lineitem: ratios of small-integer sums, so that all engines agree to the bit."""
    li = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_linenumber") % 2).cast("int").alias("t"), *[(F.col(c) % n).cast("int").alias(a) for c, a in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]]
    whole = lambda c: F.floor(F.col(c) * 100 + 0.5)
    raw = li.groupBy(*keys).agg(F.sum("l_quantity").alias("su"), F.sum(whole("l_discount")).alias("sv"), F.sum(whole("l_tax")).alias("sw"), F.sum(F.col("l_linenumber").cast("double")).alias("st"), F.count("*").alias("n"))
    cells = raw.select("t", "x", "y", "z", *[(F.col(s) / F.col("n")).alias(c) for s, c in (("su", "u"), ("sv", "v"), ("sw", "w"), ("st", "temp"))])
    return densify(cells, grid_info(n), CHANNELS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, px, py, pz in [0, 7], t, time in [0, 1), from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pid"), ((F.col("event_id") % 701) / 100.0).alias("px"), ((F.col("user_id") * 7 % 701) / 100.0).alias("py"), ((F.col("event_id") * 3 % 701) / 100.0).alias("pz"), (F.col("event_id") % 2).cast("int").alias("t"), ((F.col("event_id") % 8) / 8.0).alias("time"))


def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with world places x, y, z in [-8, 6]."""
    return points(spark, sf_dir).select("pid", *[(F.col(f"p{a}") * 2.0 - 8.0).alias(a) for a in "xyz"], "t", "time")


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with grid coordinates: cell i has its centre at i + 0.5."""
    return points(spark, sf_dir).select("pid", "t", "time", *[(F.col(f"p{a}") + 0.5).alias(f"g{a}") for a in "xyz"])


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, seq, place and time: the events of each user in order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select("event_id", F.col("user_id").alias("line_id"), seq.cast("int").alias("seq"))
    return rows.join(world_points(spark, sf_dir).withColumnRenamed("pid", "event_id"), "event_id").select("line_id", "seq", "x", "y", "z", (F.col("seq") / 4.0).alias("time"), "t")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, seq, region 1..5, dt in quarters of a second: events of each user as visits of cells."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.col("event_id") * 7 % 5 + 1
    return e.select(F.col("user_id").alias("pid"), seq.cast("long").alias("seq"), kind.cast("long").alias("region"), ((F.col("event_id") % 4 + 1) / 4.0).alias("dt"), "ts")


def regions(spark: SparkSession) -> DataFrame:
    """A 16 x 16 raster of region ids 1..5."""
    return spark.range(256).select((F.col("id") % 16).cast("int").alias("tx"), F.expr("int(id div 16)").alias("ty")).withColumn("region", (1 + (F.expr("tx div 4") + 4 * F.expr("ty div 4")) % 5).cast("long"))


def lattice(spark: SparkSession) -> DataFrame:
    return spark.range(64).select((F.col("id") % 4).cast("int").alias("bx"), F.expr("int((id div 4) % 4)").alias("by"), F.expr("int(id div 16)").alias("bz"))
