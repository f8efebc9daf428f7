"""Hierarchical statistics and reconstruction errors: partial aggregates, rolled up and mergeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo
from fieldspark.functions.session import cut

VALUE_BYTES = 4


def stats(df: DataFrame, cols: list[str], by: list[str], bits: str | None = None) -> DataFrame:
    """n, bytes, min, max, range, avg, var of each channel in rows (`channel`); bits: a column of coded bits per value."""
    rows = _long(df, cols, by, [bits] if bits else [])
    out = rows.groupBy(*by, "channel").agg(*_plain(), *([(F.sum(bits) / 8.0).alias("comp_bytes")] if bits else []))
    if bits:
        out = out.withColumns({"bits_per_elem": F.try_divide(8.0 * F.col("comp_bytes"), F.col("n")), "compression_rate": F.try_divide(F.col("orig_bytes").cast("double"), F.col("comp_bytes"))})
    return out


def _long(df: DataFrame, cols: list[str], by: list[str], more: list[str] = ()) -> DataFrame:
    return df.select(*by, *more, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in cols])).alias("r")).select(*by, *more, "r.channel", "r.v")


def _plain(v: str = "v", p: str = "") -> list[Column]:
    size = [F.count(v).alias("n"), (F.count(v) * VALUE_BYTES).alias("orig_bytes")] if not p else []
    return [*size, F.min(v).alias(f"{p}vmin"), F.max(v).alias(f"{p}vmax"), (F.max(v) - F.min(v)).alias(f"{p}vrange"), F.avg(v).alias(f"{p}avg"), F.var_pop(v).alias(f"{p}var")]


def brick_stats(df: DataFrame, info: VolumeInfo, cols: list[str], include_halo: bool = False) -> DataFrame:
    """stats() of each brick's cells; include_halo: of its ghost cells too, which so count in several bricks, and at borders more than once."""
    from fieldspark.operators.bricks import assign_bricks, with_halo

    return stats(with_halo(df, info) if include_halo else assign_bricks(df, info), cols, ["t", "bx", "by", "bz"])


def recon_stats(df: DataFrame, pairs: dict[str, str], by: list[str], eps: float = 0.01, strict: bool = False) -> DataFrame:
    """Statistics of channels and of their reconstructions, and error figures. pairs: channel -> reconstructed column.

    psnr takes the square root of the range over the error (strict=True: the range itself). snr and psnr are null for no error.
    """
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("channel"), F.col(a).cast("double").alias("v"), F.col(b).cast("double").alias("r")) for a, b in pairs.items()])).alias("s")).select(*by, "s.*")
    e = F.abs(F.col("r") - F.col("v"))
    rel = F.when(F.abs("v") > eps, F.try_divide(e, F.abs("v")))
    out = rows.groupBy(*by, "channel").agg(*_plain(), *_plain("r", "r_"), F.avg(e).alias("avg_abs"), F.max(e).alias("max_abs"), F.sqrt(F.avg(e * e)).alias("rms"), F.avg(rel).alias("avg_rel"), F.max(rel).alias("max_rel"), F.count(rel).alias("n_rel"))
    top = F.col("vrange") if strict else F.sqrt("vrange")
    db = lambda x: 20.0 * F.log10(F.nullif(F.try_divide(x, F.col("rms")), F.lit(0.0)))
    return out.withColumns({"snr": db(F.sqrt("var")), "psnr": db(top)})


#: Level names of grouping_id over (t, bx, by, bz).
LEVELS = {0: "brick", 7: "timestep", 15: "global"}


def stats_rollup(df: DataFrame, cols: list[str], all_channels: bool = True) -> DataFrame:
    """Statistics by brick, time step and in all, for each channel and for all channels together, in one aggregate."""
    rows = _long(df, cols, ["t", "bx", "by", "bz"])
    sets = [["t", "bx", "by", "bz"], ["t"], []]
    sets = [s + ["channel"] for s in sets] + (sets if all_channels else [])
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in ("t", "bx", "by", "bz", "channel")]).agg(F.grouping_id().alias("g"), *_plain())
    level = F.when(F.expr("g div 2") == 0, "brick").when(F.expr("g div 2") == 7, "timestep").otherwise("global")
    return out.select(level.alias("level"), "t", "bx", "by", "bz", F.coalesce("channel", F.lit("all")).alias("channel"), *[c for c in out.columns if c not in ("g", "t", "bx", "by", "bz", "channel")])


# ---------------------------------------------------------------- mergeable state

STATE = ("n", "vmin", "vmax", "s1", "s2")


def stats_state(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Sums from which statistics follow, and which add up over parts."""
    return _long(df, cols, by).groupBy(*by, "channel").agg(F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))


def merge_stats(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*by, "channel").agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def finish_stats(state: DataFrame) -> DataFrame:
    avg = F.col("s1") / F.col("n")
    return state.withColumns({"orig_bytes": F.col("n") * VALUE_BYTES, "vrange": F.col("vmax") - F.col("vmin"), "avg": avg, "var": F.greatest(F.col("s2") / F.col("n") - avg * avg, F.lit(0.0))})


# ---------------------------------------------------------------- reductions

REDUCTIONS = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "max_abs": lambda c: F.max(F.abs(c)), "count_if": lambda c: F.count_if(F.col(c) != 0)}


def reduce(df: DataFrame, col: str, op: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(REDUCTIONS[op](col).alias(f"{op}_{col}"))


def max_abs(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    return reduce(df, col, "max_abs", by)


def measure_min_max(df: DataFrame, measures: list[str], by: list[str]) -> DataFrame:
    return _long(df, measures, by).groupBy(*by, "channel").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))


def histogram(df: DataFrame, symbol: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, symbol).agg(F.count("*").alias("cnt"))


def common_quant_step(steps: DataFrame, col: str = "q") -> DataFrame:
    """The one quantisation step of all channels, or -1."""
    return steps.agg(F.when(F.count_distinct(col) == 1, F.max(col)).otherwise(F.lit(-1.0)).alias("q"))


def points_per_brick(points: DataFrame, time: str = "time") -> DataFrame:
    """Points in each brick and the earliest time among them; points have bx, by, bz."""
    return points.groupBy("bx", "by", "bz").agg(F.count("*").alias("n_points"), F.min(time).alias("first_time"))


def bricks_touched(vertices: DataFrame, brick_bytes: int) -> DataFrame:
    """Visits, distinct bricks and their bytes for each line."""
    return vertices.groupBy("line_id").agg(F.count("*").alias("visits"), F.count_distinct("bx", "by", "bz").alias("bricks")).withColumn("bytes", F.col("bricks") * brick_bytes)


def prefix_sum(rows: DataFrame, keys: list[str], order: list[str], col: str, name: str = "prefix", exclusive: bool = False, blocks: int | None = None) -> DataFrame:
    """rows with the running sum of col within each key, in the given total order; exclusive: without the row's own value (0 at first).

    Without blocks a key is one task's window: for short keys. With blocks, keys of any length are scanned in two passes: rows are dealt to so many
    ranges of (keys, order), each range sums its part of each key, the sums before a range are carried in, and ranges are scanned side by side.
    A range begins within one key at most, so there are fewer carried sums than ranges. keys may be empty.
    """
    if blocks is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        total = F.sum(col).over(upto)
        return rows.withColumn(name, F.coalesce(total, F.lit(0)) if exclusive else total)
    ranged = cut(in_ranges(rows, keys, order, blocks))
    own = [F.struct(*keys).alias("scan_key")] if keys else [F.lit(0).alias("scan_key")]
    sums = ranged.groupBy(*own, "scan_block").agg(F.sum(col).alias("scan_sum"))
    earlier = Window.partitionBy("scan_key").orderBy("scan_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("scan_carry", F.sum("scan_sum").over(earlier)).where("scan_carry is not null").drop("scan_sum")
    inner = Window.partitionBy("scan_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = ranged.withColumn("scan_local", F.sum(col).over(inner)).withColumn("scan_key", own[0])
    carry = F.broadcast(carry.withColumnRenamed("scan_key", "scan_of"))  # fewer rows than blocks
    out = local.join(carry.withColumnRenamed("scan_block", "scan_at"), (F.col("scan_block") == F.col("scan_at")) & F.col("scan_key").eqNullSafe(F.col("scan_of")), "left")
    both = F.coalesce(F.col("scan_local") + F.col("scan_carry"), "scan_local", "scan_carry")
    return out.select(*[F.col(c) for c in rows.columns if c != name], (F.coalesce(both, F.lit(0)) if exclusive else both).alias(name))


def in_ranges(rows: DataFrame, keys: list[str], order: list[str], blocks: int) -> DataFrame:
    """rows dealt to ranges of (keys, order), with the number of the range in scan_block."""
    return rows.repartitionByRange(blocks, *keys, *order).withColumn("scan_block", F.spark_partition_id())
