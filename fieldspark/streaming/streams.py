"""Incremental forms: ingest with merged statistics, particle ticks, time in cells, running heat maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldspark.functions.info import AXES, VolumeInfo
from fieldspark.operators.bricks import assert_appendable
from fieldspark.operators.lines import cell_step
from fieldspark.operators.stats import stats_state
from fieldspark.operators.trace import BrickField, TraceParams
from fieldspark.sources import store

TICK_MOST = 0.1


def stream_ingest(source: DataFrame, info: VolumeInfo, path: str, cols: list[str], checkpoint: str, trigger: dict | None = None, again: str = "replace") -> StreamingQuery:
    """Appends streamed voxels (t, x, y, z, cols) to a brick store, each time step once, with its statistics.

    The store is made if there is none; otherwise it must be of this geometry. Cells wait in <path>/staged, by batch, until
    their step is whole; then it is written, with its directory and statistics, and published at once (see sources.store). So a
    reader never sees a part of a step, and a batch that runs again changes nothing. A cell that comes twice while its step waits counts as it
    came last. A step that comes again, whole, is replaced, or left as it is (again="refuse").
    """
    if again not in ("replace", "refuse"):
        raise ValueError(again)
    whole = info.nx * info.ny * info.nz

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        files = store.Files(spark, path)
        if not files.names("info"):
            store.create(spark, path, info)
        assert_appendable(store.described(spark, path), info)
        there = store.manifest(spark, path)
        mine = f"{checkpoint}#{number}"
        done = [t for t, m in there.items() if again == "refuse" or m.get("batch") == mine]
        cells = df.select(F.col("t").cast("int").alias("t"), *AXES, *cols).where(~F.col("t").isin(done))
        cells.write.mode("overwrite").partitionBy("t").parquet(f"{path}/staged/batch={number}")
        steps = [r.t for r in spark.read.schema(cells.schema).parquet(f"{path}/staged/batch={number}").select("t").distinct().collect()]
        if not steps:
            return
        staged = spark.read.schema(cells.schema.add("batch", "long")).parquet(f"{path}/staged").where(F.col("t").isin(steps))
        last = staged.groupBy("t", *AXES).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("t", *AXES, "r.*")
        ready = [r.t for r in last.groupBy("t").count().where(F.col("count") >= whole).collect()]
        if not ready:
            return

        def keep_stats(written: DataFrame) -> None:
            state = stats_state(written, cols, ["t", "store_step"])
            state.write.mode("append").partitionBy("store_step").parquet(f"{path}/stats")

        store.append(last.where(F.col("t").isin(ready)), info, path, cols, "replace", also=keep_stats, note={"batch": mine})
        for name in files.names("staged"):
            for t in ready:
                files.remove(f"staged/{name}/t={t}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics of the steps that are published."""
    live = [f"{path}/stats/store_step={m['step']}" for m in store.manifest(spark, path).values()]
    return spark.read.option("basePath", f"{path}/stats").parquet(*live).drop("store_step")


CELLS = "pid long, current_cell long, time_in_cell double, longest_cell long, longest_time double"


def stream_time_in_cell(visits: DataFrame, threshold: float, watermark: str | None = None, time: str = "ts", keep: float | None = None) -> DataFrame:
    """The state of each particle after every batch of visits (pid, seq, region, dt).

    With a watermark, rows older than it as their batch begins are left out. keep: seconds after which, by the watermark, a particle not seen again
    is forgotten; it starts anew if it comes back. Without keep, states stay.
    """
    if keep is not None and not watermark:
        raise ValueError("keep needs a watermark")
    if watermark:
        visits = visits.withWatermark(time, watermark).withColumn("_ms", F.unix_millis(time))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *own, last = state.get if state.exists else (0, 0.0, 0.0, 0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        if watermark:
            rows = rows[rows["_ms"] >= state.getCurrentWatermarkMs()]  # Spark itself leaves them out a batch later
        if not len(rows):
            if keep is not None and state.exists:
                state.setTimeoutTimestamp(max(last + int(1000 * keep), state.getCurrentWatermarkMs() + 1))
            return
        if keep is not None and state.exists and last + 1000 * keep <= state.getCurrentWatermarkMs():
            own, last = (0, 0.0, 0.0, 0, 0.0), 0
        for cell, dt in zip(rows["region"].tolist(), rows["dt"].tolist(), strict=True):
            own = cell_step(tuple(own), int(cell), float(dt), threshold)
        if watermark:
            last = max(last, int(rows["_ms"].max()))
        state.update((*own, last))
        if keep is not None:
            state.setTimeoutTimestamp(max(last + int(1000 * keep), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"pid": [key[0]], "current_cell": [own[0]], "time_in_cell": [own[1]], "longest_cell": [own[3]], "longest_time": [own[4]]})

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return visits.groupBy("pid").applyInPandasWithState(run, CELLS, "cell long, inside double, outside double, longest long, most double, last long", "update", timeout)


def stream_heat_map(points: DataFrame, info: VolumeInfo, dims: tuple[int, int, int], window: str | None = None, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Running counts of grid cells; window: counts start anew in each window of event time."""
    if watermark:
        points = points.withWatermark(time, watermark)
    for a, n, half in zip(AXES, dims, info.half_size_world, strict=True):
        q = (F.col(a) + half) / (2.0 * half) * n
        points = points.withColumn(f"g{a}", F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("int")).where(F.col(f"g{a}").between(0, n - 1))
    keys = ([F.window(time, window).alias("window")] if window else []) + ["gx", "gy", "gz"]
    return points.groupBy(*keys).agg(F.count("*").alias("cnt"))


PARTICLES = "pid long, x double, y double, z double, time double, alive boolean"


def stream_particles(ticks: DataFrame, field: pd.DataFrame, info: VolumeInfo, p: TraceParams | None = None, seed_box: tuple = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), life: float = 1e9) -> DataFrame:
    """Advances particles (one for each pid of ticks: pid, tick, dt and, where they go by time, ts) by Euler steps, with state; ticks are held to TICK_MOST.

    field: packed rows of a small volume (one brick), which travels with the tasks. A particle that leaves, or is older than
    `life`, starts anew from its seed at the next tick. A batch tells a particle as it is after its last tick: not alive where
    that tick ended it. How ticks fall into batches, kept in order, doesn't change where particles are.
    """
    p = p or TraceParams(scheme="euler")
    half = np.array(info.half_size_world)

    def seed(pid: int) -> np.ndarray:
        r = np.random.default_rng(pid).random(3)
        return np.array(seed_box[0]) + r * np.array(seed_box[1])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = BrickField(field, info, p.kernel, p.backward)
        pid = int(key[0])
        at, time = (np.array(state.get[:3]), state.get[3]) if state.exists else (seed(pid), 0.0)
        alive = True
        rows = pd.concat(list(parts))
        for dt in rows.sort_values(["ts", "tick"] if "ts" in rows else ["tick"])["dt"].tolist():
            if not alive:
                at, time = seed(pid), 0.0
            h = min(float(dt), TICK_MOST)
            at, time = at + h * f(at[None], np.array([time]))[0], time + h
            alive = not ((np.abs(at) > half).any() or time >= life)
        if alive:
            state.update((*at.tolist(), time))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"pid": [pid], "x": [at[0]], "y": [at[1]], "z": [at[2]], "time": [time], "alive": [alive]})

    return ticks.groupBy("pid").applyInPandasWithState(run, PARTICLES, "x double, y double, z double, time double", "update", GroupStateTimeout.NoTimeout)
