"""Quantisation, symbols, runs, coded sizes and wavelets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.stats import prefix_sum, recon_stats
from fieldspark.operators.stencil import PENCIL

#: Analysis and synthesis filters (low pass, high pass; even, odd), centred, mirrored at the borders.
FILTERS: dict[str, dict[str, tuple[list[float], list[float]]]] = {
    "cdf97": {
        "analysis": ([0.0267488, -0.0168641, -0.0782233, 0.2668641, 0.6029490, 0.2668641, -0.0782233, -0.0168641, 0.0267488], [0.0, 0.0456359, -0.0287718, -0.2956359, 0.5575435, -0.2956359, -0.0287718, 0.0456359, 0.0]),
        "synthesis": ([0.0, 0.0337282, -0.0575435, -0.5337281, 1.1150871, -0.5337281, -0.0575435, 0.0337282, 0.0], [0.0534975, -0.0912718, -0.1564465, 0.5912718, 1.2058980, 0.5912718, -0.1564465, -0.0912718, 0.0534975]),
    },
    "cdf53": {
        "analysis": ([-0.125, 0.25, 0.75, 0.25, -0.125], [0.0, -0.25, 0.5, -0.25, 0.0]),
        "synthesis": ([0.0, -0.5, 1.0, -0.5, 0.0], [-0.25, 0.5, 1.5, 0.5, -0.25]),
    },
    "haar": {"analysis": ([0.0, 0.5, 0.5], [-0.5, 0.5, 0.0]), "synthesis": ([0.0, 1.0, -1.0], [1.0, 1.0, 0.0])},
}


def _sign(v: Column) -> Column:
    return F.when(v < 0, -1.0).when(v > 0, 1.0).otherwise(0.0)


def _trunc(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")


def quantized(v: Column, step: float, mode: str = "uniform") -> Column:
    q = v / step
    return _trunc(q + _sign(q) * 0.5) if mode == "uniform" else _trunc(q)


def unquantized(n: Column, step: float, mode: str = "uniform") -> Column:
    n = n.cast("double")
    return n * step if mode == "uniform" else (n + 0.5 * _sign(n)) * step


def quantize(df: DataFrame, col: str, step: float, mode: str = "uniform") -> DataFrame:
    """Adds <col>_q and <col>_r: the symbol and its value. mode: uniform (mid-tread) or deadzone."""
    return df.withColumn(f"{col}_q", quantized(F.col(col), step, mode)).withColumn(f"{col}_r", unquantized(F.col(f"{col}_q"), step, mode))


def symbols(n: Column) -> Column:
    """Signed to unsigned: twice the size, less one for negatives."""
    return (2 * F.abs(n) - F.when(n < 0, 1).otherwise(0)).cast("long")


def from_symbols(s: Column) -> Column:
    return F.when(s % 2 == 1, -((s + 1) / 2).cast("long")).otherwise((s / 2).cast("long"))


def to_symbols(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_s", symbols(F.col(col)))


def quantize8(df: DataFrame, col: str) -> DataFrame:
    """Adds the clamped 8-bit value of a column that is centred at 0, and what it stands for."""
    q = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(col) + 128.5))).cast("int")
    return df.withColumn(f"{col}_q8", q).withColumn(f"{col}_r8", F.col(f"{col}_q8") - 128.0)


def quantize_report(df: DataFrame, steps: dict[str, float], mode: str, by: list[str]) -> DataFrame:
    """Error statistics of a quantisation round trip, with a step for each channel."""
    for c, q in steps.items():
        df = quantize(df, c, q, mode)
    return recon_stats(df, {c: f"{c}_r" for c in steps}, by)


def residual_symbols(df: DataFrame, col: str, axis: str, step: float) -> DataFrame:
    """Adds <col>_d, the symbol of the quantised value less that of the cell before it along an axis."""
    q = quantized(F.col(col), step)
    w = Window.partitionBy(*PENCIL[axis]).orderBy(axis)
    return df.withColumn("_q", q).withColumn(f"{col}_d", symbols(F.col("_q") - F.coalesce(F.lag("_q").over(w), F.lit(0).cast("long")))).drop("_q")


def zero_runs(df: DataFrame, symbol: str, by: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    """by, run, zeros, symbol: the zeros before each non-zero symbol; a last run of zeros has a null symbol. blocks: see stats.prefix_sum."""
    rows = df.withColumn("_n", (F.col(symbol) != 0).cast("int"))
    rows = prefix_sum(rows, by, order, "_n", "run", True, blocks)
    return rows.groupBy(*by, "run").agg(F.sum(1 - F.col("_n")).alias("zeros"), F.max(F.when(F.col(symbol) != 0, F.col(symbol))).alias(symbol))


def zero_run_stats(df: DataFrame, symbol: str, by: list[str], order: list[str], blocks: int | None = None) -> DataFrame:
    return zero_runs(df, symbol, by, order, blocks).groupBy("zeros").agg(F.count("*").alias("runs"))


def coded_size(df: DataFrame, symbol: str, by: list[str]) -> DataFrame:
    """by, n, bytes: the entropy of the symbols' histogram, in bytes."""
    h = df.groupBy(*by, symbol).agg(F.count("*").alias("cnt"))
    # -sum c log2(c / n) = n log2 n - sum c log2 c, so that counts needn't meet their total first
    sums = h.groupBy(*by).agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.log2("cnt")).alias("_own")).where("n is not null")
    return sums.select(*by, "n", ((F.col("n") * F.log2("n") - F.col("_own")) / 8.0).alias("bytes"))


# ---------------------------------------------------------------- wavelets


def _mirror(i: Column, n: Column) -> Column:
    j = F.abs(i)
    return F.when(j >= n, 2 * (n - 1) - j).otherwise(j)


def _filtered(cells: DataFrame, keys: tuple[str, ...], even: list[float], odd: list[float]) -> DataFrame:
    """keys, i and c of cells (keys, i from 0 without gaps, c) after a filter for even, and one for odd places, mirrored at both ends.

    Taps are the cells beside a cell in its pencil: one exchange, whatever the filter's length.
    """
    half = len(even) // 2
    w = Window.partitionBy(*keys).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = cells.withColumn("n", F.count("*").over(whole))
    # the mirror of a place beyond the border lies within half + 1 cells of it
    taps = {k: (F.lead("c", k) if k >= 0 else F.lag("c", -k)).over(w) for k in range(-half, half + 1)}
    ends = ends.withColumns({f"_t{k + half}": c for k, c in taps.items()})
    first = [F.nth_value("c", j + 1).over(whole) for j in range(half + 1)]
    back = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = [F.nth_value("c", j + 1).over(back) for j in range(half + 1)]
    ends = ends.withColumns({"_low": F.array(*first), "_high": F.array(*last)})
    value = {}
    for k in range(-half, half + 1):
        at = F.col("i") + k
        mirrored = _mirror(at, F.col("n"))
        beyond = (F.when(at < 0, F.get("_low", mirrored.cast("int"))) if k < 0 else F.when(at >= F.col("n"), F.get("_high", (F.col("n") - 1 - mirrored).cast("int")))) if k else F.lit(None).cast("double")
        value[k] = F.coalesce(F.col(f"_t{k + half}"), beyond, F.lit(0.0))
    total = lambda weights: sum((F.lit(a) * value[k - half] for k, a in enumerate(weights) if a), F.lit(0.0))
    return ends.select(*keys, "i", F.when(F.col("i") % 2 == 0, total(even)).otherwise(total(odd)).alias("c"))


def wavelet(df: DataFrame, col: str, axis: str, kind: str = "cdf97", keys: tuple[str, ...] | None = None) -> DataFrame:
    """One level along an axis: keys, band (low, high), i and the coefficient c. Pencils have an even number of cells."""
    keys = keys or PENCIL[axis]
    low, high = FILTERS[kind]["analysis"]
    got = _filtered(df.select(*keys, F.col(axis).alias("i"), F.col(col).cast("double").alias("c")), keys, low, high)
    return got.select(*keys, F.when(F.col("i") % 2 == 0, "low").otherwise("high").alias("band"), F.floor(F.col("i") / 2).cast("int").alias("i"), "c")


def inverse_wavelet(bands: DataFrame, axis: str, kind: str = "cdf97", keys: tuple[str, ...] | None = None) -> DataFrame:
    """The cells of one level: keys, axis, c."""
    keys = keys or PENCIL[axis]
    even, odd = FILTERS[kind]["synthesis"]
    cells = bands.select(*keys, (2 * F.col("i") + (F.col("band") == "high").cast("int")).alias("i"), "c")
    return _filtered(cells, keys, even, odd).withColumnRenamed("i", axis)


def wavelet_levels(df: DataFrame, col: str, axis: str, levels: int, step: float, kind: str = "cdf97") -> DataFrame:
    """Several levels along an axis with dead-zone symbols: keys, level, band, i, c, q; step halves with each level."""
    keys, low, out = PENCIL[axis], df, None
    for k in range(1, levels + 1):
        bands = wavelet(low, col, axis, kind).withColumn("level", F.lit(k)).withColumn("q", quantized(F.col("c"), step / 2**k, "deadzone"))
        low = bands.where("band = 'low'").select(*keys, F.col("i").alias(axis), F.col("c").alias(col))
        part = bands if k == levels else bands.where("band = 'high'")
        out = part if out is None else out.unionByName(part)
    return out


def band_energy(bands: DataFrame) -> DataFrame:
    by = ["level", "band"] if "level" in bands.columns else ["band"]
    return bands.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("energy"))
