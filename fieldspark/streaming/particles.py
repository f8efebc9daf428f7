"""A particle system over a bricked volume, driven by a stream of clock ticks.

At a tick all particles move on by one step of a scheme, and where the last emission is longer ago than the rate allows,
each seed line emits a particle into the next of `capacity` slots, from which the particle that was there is taken. Particles that
leave the volume or are too slow are taken out.

The particles are a table in the shared folder, one version for each batch of ticks, published with the clock by one atomic rename; a batch
that runs again after a crash finds its version and changes nothing. Within a batch particles meet the bricks they are in by cogroup
(`trace._deal`, so crowded bricks are split), take all ticks they can there, and are handed over to the next brick. Emissions follow from the
clock alone, so particles whose slot is filled again within the batch are never moved.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldspark.functions.info import AXES, VolumeInfo, with_brick_of
from fieldspark.functions.schemes import advance
from fieldspark.functions.session import cut
from fieldspark.operators.trace import BrickField, TraceParams, _bricks, _deal
from fieldspark.sources.store import Files
from fieldspark.streaming.streams import TICK_MOST

#: Fixed value: a tick of so many seconds moves particles by dt times that and SPEED.
SPEED = 100.0
STATE = "line_id long, emission long, slot int, x double, y double, z double, age double, k int"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_OUT = f"{STATE}, alive boolean"


@dataclass(frozen=True)
class Clock:
    now: float = 0.0
    last: float | None = None  # when particles were last emitted
    emissions: int = 0
    batch: int = -1


def schedule(clock: Clock, ticks: list[float], rate: float) -> tuple[Clock, list[tuple[int, int]]]:
    """The clock after some ticks (seconds), and its emissions: number, and the tick after which they are."""
    now, last, n, out = clock.now, clock.last, clock.emissions, []
    for k, dt in enumerate(ticks):
        now += dt
        if last is None or now - last > 1.0 / rate:
            out.append((n, k))
            last, n = now, n + 1
    return Clock(now, last, n, clock.batch), out


def move(particles: DataFrame, bricks: DataFrame, info: VolumeInfo, p: TraceParams, steps: list[float]) -> DataFrame:
    """Particles after all steps; column k is the next step of each. Those that left or were too slow are gone."""
    half, size, top = np.array(info.half_size_world), np.array(info.brick_size_world), len(steps)

    def solve(key: tuple, rows: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(packed):
            return pd.DataFrame({c: [] for c in (*_NAMES, "alive")})
        rows = rows.sort_values("line_id")
        f = BrickField(packed, info, p.kernel, p.backward)
        lo = -half + np.array([int(v) for v in key[:3]]) * size
        hi = np.minimum(lo + size, half)
        pos, age, k = rows[list(AXES)].to_numpy(float), rows["age"].to_numpy(float).copy(), rows["k"].to_numpy().astype(np.int64)
        alive, here = np.ones(len(rows), bool), np.ones(len(rows), bool)
        for step in range(int(k.min()), top):
            go = np.flatnonzero(here & (k == step))
            if not len(go):
                continue
            vel = f(pos[go], age[go])
            if p.min_velocity > 0:
                slow = (vel**2).sum(1) < p.min_velocity**2
                alive[go[slow]] = here[go[slow]] = False
                go, vel = go[~slow], vel[~slow]
                if not len(go):
                    continue
            h = np.full(len(go), steps[step])
            pos[go] = advance(p.scheme, f, pos[go], age[go], vel, h, 1e300, 0.0, 1e300, False).pos  # a step is taken as it is
            age[go] += steps[step]
            k[go] += 1
            out = (np.abs(pos[go]) > half).any(1)
            alive[go[out]] = False
            inside = ((pos[go] >= lo) & ((pos[go] < hi) | (hi >= half))).all(1)
            here[go[out | ~inside]] = False
        return rows.assign(x=pos[:, 0], y=pos[:, 1], z=pos[:, 2], age=age, k=k, alive=alive)[[*_NAMES, "alive"]]

    state = cut(particles.select(*_NAMES))
    done = [state.where(F.col("k") >= top)]
    for _ in range(p.rounds):
        live = with_brick_of(state.where(F.col("k") < top), info)
        live = live.withColumns({f"b{a}": F.greatest(F.lit(0), F.least(F.col(f"b{a}"), F.lit(n - 1))) for a, n in zip(AXES, info.brick_count, strict=True)})
        dealt = _deal(live, bricks, ["bx", "by", "bz"], p.lines_a_task)
        if dealt is None:
            break
        lines, near = (df.groupBy("bx", "by", "bz", "copy") for df in dealt)
        got = cut(lines.cogroup(near).applyInPandas(solve, _OUT)).where("alive").drop("alive")
        done.append(got.where(F.col("k") >= top))
        state = got.where(F.col("k") < top)
    else:
        raise RuntimeError(f"particles are still on their way after {p.rounds} rounds; raise TraceParams.rounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


Seeds = Callable[[int, int], DataFrame]


def stream_particle_system(ticks: DataFrame, voxels: DataFrame, info: VolumeInfo, seeds: Seeds, path: str, checkpoint: str, p: TraceParams | None = None, rate: float = 1.0, capacity: int = 64, speed: float = SPEED, trigger: dict | None = None) -> StreamingQuery:
    """Runs the system: ticks is a clock, a row (tick, dt in seconds, and ts if there is one) for each frame, in order.

    seeds(first, n): line, emission, x, y, z of emissions first to first + n - 1; line numbers the seed lines from 0. A particle's line_id
    is its emission times a million of millions, plus its line. A tick counts for TICK_MOST seconds at most as a step, and whole for the clock.
    How ticks fall into batches, kept in order, changes nothing. The few rows of a batch's ticks pass through the driver.
    """
    p = p or TraceParams(scheme="rk4")
    packed = None

    def batch(df: DataFrame, number: int) -> None:
        nonlocal packed
        spark = df.sparkSession
        files = Files(spark, path)
        clock = published(spark, path)
        if clock.batch >= number:
            return  # this batch ran before a crash
        order = [c for c in ("ts", "tick") if c in df.columns]
        times = [r.dt for r in df.orderBy(*order).select("dt").collect()]
        new, emitted = schedule(clock, times, rate)
        steps = [p.dt * speed * min(dt, TICK_MOST) for dt in times]
        if packed is None:
            packed = cut(_bricks(voxels, info, p))
        emitted = emitted[-capacity:]
        filled = [n % capacity for n, _ in emitted]
        parts = []
        if clock.batch >= 0:
            parts.append(particles(spark, path).where(~F.col("slot").isin(filled)).withColumn("k", F.lit(0)).select(*_NAMES))
        if emitted:
            first = emitted[0][0]
            begins = F.element_at(F.array(*[F.lit(k + 1) for _, k in emitted]), (F.col("emission") - first + 1).cast("int"))
            fresh = seeds(first, len(emitted)).select((F.col("emission") * 10**12 + F.col("line")).alias("line_id"), F.col("emission").cast("long").alias("emission"), (F.col("emission") % capacity).cast("int").alias("slot"), *AXES, F.lit(0.0).alias("age"), begins.cast("int").alias("k"))
            parts.append(fresh.where(F.col("x").between(-info.half_size_world[0], info.half_size_world[0]) & F.col("y").between(-info.half_size_world[1], info.half_size_world[1]) & F.col("z").between(-info.half_size_world[2], info.half_size_world[2])))
        rows = parts[0] if parts else spark.createDataFrame([], STATE)
        for part in parts[1:]:
            rows = rows.unionByName(part)
        move(rows, packed, info, p, steps).write.mode("overwrite").parquet(f"{path}/particles/batch={number}")
        files.publish("clock.json", json.dumps({"now": new.now, "last": new.last, "emissions": new.emissions, "batch": number}))
        for name in files.names("particles"):
            if name.startswith("batch=") and int(name[6:]) < number - 1:
                files.remove(f"particles/{name}")  # the version before stays for those who read it

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def published(spark: SparkSession, path: str) -> Clock:
    """The clock as of the last published batch."""
    files = Files(spark, path)
    return Clock(**json.loads(files.read("clock.json"))) if files.fs.exists(files.at(f"{path}/clock.json")) else Clock()


def particles(spark: SparkSession, path: str) -> DataFrame:
    """line_id, emission, slot, place and age of all particles after the last published batch."""
    clock = published(spark, path)
    if clock.batch < 0:
        return spark.createDataFrame([], STATE).drop("k")
    return spark.read.schema(STATE).parquet(f"{path}/particles/batch={clock.batch}").drop("k")
