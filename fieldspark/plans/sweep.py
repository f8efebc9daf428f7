"""Parameter sweeps of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo
from fieldspark.functions.schemes import SCHEMES
from fieldspark.operators.trace import TraceParams, trace_runs


def spaced(lo: float, hi: float, n: int) -> list[float]:
    """n values from lo to hi, evenly by ratio."""
    return [lo * (hi / lo) ** (k / max(1, n - 1)) for k in range(n)]


def sweep_table(qualities: DataFrame, schemes: list[str], kernels: list[str], steps: int, dt: tuple[float, float], tol: tuple[float, float]) -> DataFrame:
    """scheme, kernel, quality, dt, tol for each row of qualities (quality, 0 to steps - 1): adaptive schemes vary the tolerance, others the step."""
    spark = qualities.sparkSession
    s = spark.createDataFrame([(n, SCHEMES[n].adaptive) for n in schemes], "scheme string, adaptive boolean")
    k = spark.createDataFrame([(n,) for n in kernels], "kernel string")
    q = qualities.select(F.col("quality").cast("int").alias("quality"))
    f = F.col("quality") / max(1, steps - 1)
    rows = q.crossJoin(F.broadcast(s.crossJoin(k)))  # schemes and kernels are few, by name
    rows = rows.withColumn("dt", F.when(F.col("adaptive"), dt[0]).otherwise(dt[0] * F.pow(F.lit(dt[1] / dt[0]), f))).withColumn("tol", F.when(F.col("adaptive"), tol[0] * F.pow(F.lit(tol[1] / tol[0]), f)).otherwise(tol[0]))
    return rows.drop("adaptive")


def trace_sweep(voxels: DataFrame, info: VolumeInfo, seeds: DataFrame, runs: list[TraceParams]) -> DataFrame:
    """run, and the final states of each run's lines; all runs go in one trace."""
    return trace_runs(voxels, info, seeds, runs)[1]
