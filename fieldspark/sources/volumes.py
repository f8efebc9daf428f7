"""Sources and sinks: raw volumes, volume tables, statistics and line sets, points, region rasters, analytic fields."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo
from fieldspark.functions.tensor import normalize
from fieldspark.operators.seeds import uniform
from fieldspark.sources import raw_source, store

def read_raw(spark: SparkSession, mask: str, dims: tuple[int, int, int], channels: list[str], tmin: int, tmax: int, tstep: int = 1, slab_bytes: int = raw_source.SLAB_BYTES) -> DataFrame:
    """t, x, y, z and a column for each component, from files of interleaved float32, x fastest: the raw_volume data source.

    channels: "name:count"; a count above 1 makes <name>0.. A task reads the byte range of a slab of z of at most slab_bytes;
    filters on t and z keep whole slabs from being read.
    """
    options = {"dims": ",".join(map(str, dims)), "channels": ",".join(channels), "tmin": tmin, "tmax": tmax, "tstep": tstep, "slab_bytes": slab_bytes}
    return raw_source.register(spark).read.format("raw_volume").options(**options).load(mask)


def export_raw(df: DataFrame, info: VolumeInfo, path: str, cols: list[str]) -> DataFrame:
    """Writes core cells as one binary row for each (channel, t, z) slab, x fastest, to a Parquet table, and returns it."""
    rows = df.where("not is_halo") if "is_halo" in df.columns else df
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("float").alias("v")) for c in cols]))
    long = rows.select("t", "z", "y", "x", values.alias("r")).select("r.channel", "t", "z", "y", "x", "r.v")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        return pd.DataFrame({"channel": [pdf["channel"].iloc[0]], "t": [pdf["t"].iloc[0]], "z": [pdf["z"].iloc[0]], "data": [pdf["v"].to_numpy(np.float32).tobytes()]})

    long.groupBy("channel", "t", "z").applyInPandas(pack, "channel string, t int, z int, data binary").write.mode("overwrite").partitionBy("channel", "t").parquet(path)
    return df.sparkSession.read.parquet(path)


def unpack_raw(slabs: DataFrame, info: VolumeInfo, cols: list[str]) -> DataFrame:
    """t, x, y, z and the channels of a table of raw slabs, as export_raw writes it."""
    nx = info.nx

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                v = np.frombuffer(r.data, np.float32)
                i = np.arange(len(v), dtype=np.int32)
                yield pd.DataFrame({"channel": r.channel, "t": r.t, "x": i % nx, "y": i // nx, "z": r.z, "v": v.astype(float)})

    cells = slabs.where(F.col("channel").isin(cols)).select("channel", F.col("t").cast("int").alias("t"), "z", "data").mapInPandas(run, "channel string, t int, x int, y int, z int, v double")
    return cells.groupBy("t", "x", "y", "z").pivot("channel", cols).agg(F.first("v"))


def write_volume(df: DataFrame, info: VolumeInfo, path: str, mode: str = "overwrite") -> None:
    """The steps of df (t, x, y, z, channels) as a brick store (see sources.store); append adds steps, and checks them."""
    if mode == "overwrite":
        store.create(df.sparkSession, path, info)
    store.append(df, info, path, [c for c in df.columns if c not in ("t", "x", "y", "z")])


def read_volume(spark: SparkSession, path: str) -> tuple[DataFrame, VolumeInfo]:
    """Cells and description of a brick store."""
    return store.read(spark, path).drop("bx", "by", "bz"), store.described(spark, path)


def write_stats(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_trace_stats(df: DataFrame, path: str, **keys: str | int | float) -> None:
    """Statistics or timings of a trace, under the given key columns, which come first; runs add up in one folder."""
    rows = df.select(*[F.lit(v).alias(k) for k, v in keys.items()], *[c for c in df.columns if c not in keys])
    rows.write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def write_lines(vertices: DataFrame, path: str) -> None:
    vertices.repartition("line_id").sortWithinPartitions("line_id", "seq").write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, line_id: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if line_id is None else df.withColumn("line_id", F.lit(line_id).cast("long"))


def write_flow_graph(flow: DataFrame, path: str) -> None:
    flow.write.mode("overwrite").parquet(path)


def read_flow_graph(spark: SparkSession, path: str, info: VolumeInfo) -> DataFrame:
    """A saved flow graph; raises if it is not of this lattice."""
    flow = spark.read.parquet(path)
    want = math.prod(info.brick_count)
    got = flow.select("bx", "by", "bz").distinct().count()
    if got != want:
        raise ValueError(f"flow graph has {got} bricks, the volume {want}")
    return flow


def read_points(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """pid, x, y, z from a file of float32 blocks x[], y[], z[]; each task reads its own range of the three through Arrow's file systems."""
    fs, at = raw_source.file_system(path)
    n = fs.get_file_info(at).size // 12
    step = max(1, -(-n // parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = raw_source.file_system(path)
        for b in batches:
            for first in b["id"].tolist():
                m = min(step, n - first)
                cols = {"pid": np.arange(first, first + m)}
                with fs.open_input_file(at) as f:
                    for k, c in enumerate("xyz"):
                        f.seek(4 * (k * n + first))
                        cols[c] = np.frombuffer(f.read(4 * m), np.float32).astype(float)
                yield pd.DataFrame(cols)

    return spark.range(0, n, step).mapInPandas(run, "pid long, x double, y double, z double")


def write_points(points: DataFrame, path: str) -> None:
    """x, y, z of points (pid from 0 without gaps) as a file of float32 blocks x[], y[], z[]: three streams, one after the other, by one task."""
    fs, at = raw_source.file_system(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = raw_source.file_system(path)
        n = 0
        with fs.open_output_stream(at) as f:
            for b in batches:
                f.write(b.column(0).to_numpy().astype(np.float32).tobytes())
                n += len(b)
        yield pa.RecordBatch.from_pylist([{"n": n}], schema=pa.schema([("n", pa.int64())]))

    axes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(a).cast("double").alias("v")) for k, a in enumerate("xyz")]))
    points.select("pid", axes.alias("r")).select("pid", "r.k", "r.v").repartitionByRange(1, "k", "pid").sortWithinPartitions("k", "pid").select("v").mapInArrow(run, "n long").collect()


def read_regions(df: DataFrame) -> DataFrame:
    """tx, ty, region of a raster table."""
    return df.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.col("region").cast("long").alias("region"))


def synth_vortex(spark: SparkSession, nx: int, ny: int, nz: int, jitter: float = 0.0, seed: int = 1, nt: int = 1) -> DataFrame:
    """t, x, y, z, u, v, w, temp of (-y, x, 0) on [-1, 1]^3; with jitter its unit vectors and random unit vectors of that size."""
    n = nx * ny * nz
    rows = spark.range(n * nt).select("id", F.expr(f"int(id div {n})").alias("t"), F.expr(f"int(id % {nx})").alias("x"), F.expr(f"int((id div {nx}) % {ny})").alias("y"), F.expr(f"int((id div {nx * ny}) % {nz})").alias("z"))
    at = lambda a, m: 2.0 * (F.col(a) + 0.5) / m - 1.0
    v = (-at("y", ny), at("x", nx), F.lit(0.0))
    if jitter:
        unit = tuple(F.coalesce(c, F.lit(0.0)) for c in normalize(v))
        r = normalize(tuple(2.0 * uniform(F.col("id"), seed, k) - 1.0 for k in range(3)))
        v = tuple(a + jitter * b for a, b in zip(unit, r, strict=True))
    return rows.select("t", "x", "y", "z", v[0].alias("u"), v[1].alias("v"), v[2].alias("w"), F.lit(0.0).alias("temp"))
