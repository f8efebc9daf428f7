"""Ingest in pieces, and the particle system, whatever the batches, bricks and copies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo
from fieldspark.operators import seeds
from fieldspark.operators.trace import BrickField, TraceParams
from fieldspark.operators.bricks import pack_bricks, with_halo
from fieldspark.sources import store
from fieldspark.sources import volumes as VOL
from fieldspark.streaming import particles as PS
from fieldspark.streaming import streams


def in_batches(spark, df, batches, at):
    """A stream that gives the rows of each batch (column b) as one trigger."""
    for k in range(batches):
        df.where(F.col("b") == k).drop("b").coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(df.drop("b").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(at)


@pytest.mark.parametrize("again", ["replace", "refuse"])
def test_steps_are_published_whole_and_once(spark, tmp_path, again):
    info = VolumeInfo(6, 5, 4, 2, brick=4, overlap=1)
    rows = VOL.synth_vortex(spark, 6, 5, 4, nt=2).select("t", "x", "y", "z", "u", "temp")
    sent = rows.where("t = 0 and z < 2").withColumn("b", F.lit(0)).unionByName(rows.where("t = 1 and z < 3").withColumn("b", F.lit(1))).unionByName(rows.where("t = 0 and z >= 2").withColumn("b", F.lit(2)))
    sent = sent.unionByName(rows.where("t = 0").withColumn("temp", F.lit(9.0)).withColumn("b", F.lit(3)))
    at, from_ = f"{tmp_path}/v", f"{tmp_path}/in"
    seen = []
    for k in range(4):  # a restart after each batch
        source = in_batches(spark, sent.where(f"b = {k}").withColumn("b", F.lit(0)), 1, from_)
        streams.stream_ingest(source, info, at, ["u", "temp"], f"{tmp_path}/state", again=again).awaitTermination()
        seen.append(sorted(store.manifest(spark, at)))
    assert seen == [[], [], [0], [0]]
    cells, got = VOL.read_volume(spark, at)
    assert got.nt == 1 and cells.count() == 120
    assert cells.agg(F.max("temp")).first()[0] == (9.0 if again == "replace" else 0.0)
    stats = {r.channel: r for r in streams.ingested_stats(spark, at).collect()}
    assert stats["u"].n == 120 and stats["temp"].vmax == (9.0 if again == "replace" else 0.0)
    with pytest.raises(Exception, match="nx differs"):
        source = in_batches(spark, rows.withColumn("b", F.lit(0)), 1, f"{tmp_path}/other")
        streams.stream_ingest(source, VolumeInfo(7, 5, 4, 2, brick=4, overlap=1), at, ["u", "temp"], f"{tmp_path}/state2").awaitTermination()


INFO = VolumeInfo(8, 8, 8, 1, brick=8, overlap=2)
BOX = ((-6.0, -6.0, -3.0), (12.0, 12.0, 6.0))


@pytest.fixture(scope="module")
def volume(spark):
    return VOL.synth_vortex(spark, 8, 8, 8, jitter=0.3).cache()


def alone(volume, times, p, rate, capacity, lines):
    """The system in one process: a ring of slots, a tick at a time."""
    whole = VolumeInfo(8, 8, 8, 1, brick=16, overlap=4)
    field = BrickField(pack_bricks(with_halo(volume.select("t", "x", "y", "z", "u", "v", "w"), whole, halo=2), ["u", "v", "w"]).toPandas(), whole, p.kernel, False)
    clock, ring = PS.Clock(), {}
    for dt in times:
        clock, born = PS.schedule(clock, [dt], rate)
        h = p.dt * PS.SPEED * min(dt, 0.1)
        for slot, rows in ring.items():
            kept = {}
            for i, (x, age) in rows.items():
                v = field(x[None], np.array([age]))[0]
                if (v**2).sum() < p.min_velocity**2:
                    continue
                k2 = field((x + h * v)[None], np.array([age]))[0]
                x = x + h / 2 * (v + k2)
                if (np.abs(x) <= 8).all():
                    kept[i] = (x, age + h)
            ring[slot] = kept
        for e, _ in born:
            ring[e % capacity] = {e * 10**12 + k: (np.array(lines[e, k]), 0.0) for k in range(25)}
    return {i: (*np.round(x, 9).tolist(), round(age, 9)) for rows in ring.values() for i, (x, age) in rows.items()}


@pytest.mark.parametrize("batches,bound,brick", [(1, 20_000, 8), (3, 7, 8), (10, 20_000, 16)])
def test_particles_are_those_of_a_ring_in_one_process(spark, volume, tmp_path, batches, bound, brick):
    r = np.random.default_rng(4)
    times = np.round(r.random(30) * 0.15, 3).tolist()
    p = TraceParams(scheme="heun", dt=0.02, min_velocity=1.9, lines_a_task=bound)
    ticks = spark.createDataFrame([(k, dt, k * batches // 30) for k, dt in enumerate(times)], "tick long, dt double, b int")
    at = f"{tmp_path}/p"
    make = lambda first, n: seeds.emissions(spark, 25, BOX, first, n, True)
    info = VolumeInfo(8, 8, 8, 1, brick=brick, overlap=2 if brick == 8 else 4)
    PS.stream_particle_system(in_batches(spark, ticks, batches, f"{tmp_path}/in"), volume, info, make, at, f"{tmp_path}/state", p, rate=6.0, capacity=4).awaitTermination()
    got = {r.line_id: (*np.round([r.x, r.y, r.z], 9).tolist(), round(r.age, 9)) for r in PS.particles(spark, at).collect()}
    lines = {(r.emission, r.line): (r.x, r.y, r.z) for r in make(0, 30).collect()}
    want = alone(volume, times, p, 6.0, 4, lines)
    assert got == want and 0 < len(want) < 100
    assert len({r.slot for r in PS.particles(spark, at).select("slot").distinct().collect()}) == 4


def test_a_batch_that_runs_again_changes_nothing(spark, volume, tmp_path):
    at = f"{tmp_path}/p"
    ticks = spark.createDataFrame([(k, 0.05, 0) for k in range(5)], "tick long, dt double, b int")
    make = lambda first, n: seeds.emissions(spark, 10, BOX, first, n, False)
    for state in ("one", "two"):  # the second run has lost its own notes, not the published clock
        PS.stream_particle_system(in_batches(spark, ticks, 1, f"{tmp_path}/{state}-in"), volume, INFO, make, at, f"{tmp_path}/{state}", TraceParams(scheme="rk4", dt=0.01), rate=100.0, capacity=3).awaitTermination()
        clock = PS.published(spark, at)
        assert clock.batch == 0 and clock.emissions == 5 and abs(clock.now - 0.25) < 1e-12
    rows = PS.particles(spark, at)
    assert rows.count() == 30 and sorted(r.emission for r in rows.select("emission").distinct().collect()) == [2, 3, 4]
