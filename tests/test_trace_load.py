"""Traces whose lines crowd in few bricks: even tasks, no copies of other bricks, the same results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo, with_brick_of
from fieldspark.operators import seeds
from fieldspark.operators import trace as TR
from fieldspark.sources import volumes as VOL

INFO = VolumeInfo(8, 8, 8, 2, brick=8, overlap=2, dt=0.5)
LINES = 3000


@pytest.fixture(scope="module")
def volume(spark):
    return VOL.synth_vortex(spark, 8, 8, 8, jitter=0.2, nt=2).cache()


@pytest.fixture(scope="module")
def crowd(spark):
    """All lines but 20 begin in one brick of eight."""
    most = seeds.seed_random(spark, LINES, ((1.0, 1.0, 1.0), (2.0, 2.0, 2.0)))
    return most.unionByName(seeds.seed_random(spark, 20, ((-7.0, -7.0, -7.0), (14.0, 14.0, 14.0)), seed=2).withColumn("pid", F.col("pid") + LINES)).cache()


def keyed(crowd, path):
    rows = with_brick_of(crowd, INFO).withColumnRenamed("pid", "line_id")
    return rows.withColumn("tk", F.lit(0)) if path else rows


@pytest.mark.parametrize("path", [False, True])
def test_only_crowded_bricks_are_copied_and_tasks_are_even(volume, crowd, path):
    bricks = TR._bricks(volume if path else volume.where("t = 0"), INFO, TR.TraceParams())
    keys = ["bx", "by", "bz"] + (["tk"] if path else [])
    lines, near = TR._deal(keyed(crowd, path), bricks, keys, 100)
    sizes = {(r.bx, r.by, r.bz, r["copy"]): r["count"] for r in lines.groupBy("bx", "by", "bz", "copy").count().collect()}
    assert sum(sizes.values()) == LINES + 20 and max(sizes.values()) < 150 and len(sizes) >= 30
    copies = {tuple(r)[:3]: r["count"] for r in near.groupBy("bx", "by", "bz").count().collect()}
    steps = 2 if path else 1
    crowded = sum(n for k, n in sizes.items() if k[:3] == (1, 1, 1))
    assert crowded >= LINES and copies.pop((1, 1, 1)) == steps * -(-crowded // 100)
    assert set(copies.values()) == {steps} and len(copies) < 8
    assert TR._deal(keyed(crowd, path).where("false"), bricks, keys, 100) is None


def test_results_are_free_of_the_split(volume, crowd):
    def ends(bound, path):
        trace = TR.trace_path if path else TR.trace_stream
        cells = volume if path else volume.where("t = 0")
        v, s = trace(cells, INFO, crowd, scheme="dopri5", kernel="catrom", dt=0.05, tol=0.1, dt_max=0.2, max_age=0.4, max_len=40, normals=True, lines_a_task=bound)
        return sorted(map(tuple, v.collect())), sorted(map(tuple, s.collect()))

    for path in (False, True):
        assert ends(1 << 20, path) == ends(170, path)


def test_a_sweep_copies_no_brick_for_its_runs(volume, crowd, monkeypatch):
    seen = []
    deal = TR._deal

    def spy(live, bricks, keys, bound):
        out = deal(live, bricks, keys, bound)
        if out:
            seen.append((out[1].count(), out[0].select("bx", "by", "bz").distinct().count()))
        return out

    monkeypatch.setattr(TR, "_deal", spy)
    runs = [TR.TraceParams(scheme="euler", dt=0.01 * (k + 1), max_age=0.1) for k in range(10)]
    got = TR.trace_runs(volume.where("t = 0"), INFO, crowd.where("pid % 100 = 0"), runs)[1]
    assert got.groupBy("run").count().where(f"count = {LINES // 100 + 1}").count() == 10
    assert all(rows == bricks for rows, bricks in seen)
    one = TR.trace_stream(volume.where("t = 0"), INFO, crowd.where("pid % 100 = 0"), runs[3])[1]
    assert sorted(map(tuple, one.select("line_id", "x", "y", "z").collect())) == sorted(map(tuple, got.where("run = 3").select("line_id", "x", "y", "z").collect()))


def test_ftle_joins_no_seeds(spark, volume):
    # Spark doesn't count what the seeds' explode adds: on 5 million seeds the join was a broadcast of all through the driver
    res, box, sep = 5, ((-4.0, -4.0, 0.0), (8.0, 8.0, 0.0)), (0.1, 0.1, 0.1)
    got = TR.ftle(volume.where("t = 0"), INFO, res, box, 0.0, sep, 0.05, scheme="rk4", dt=0.01)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.gx, r.gy): r.ftle for r in got.collect()}
    assert set(found) == {(x, y) for x in range(res) for y in range(res)}
    starts = seeds.seed_ftle(spark, res, box, 0.0, sep)
    ends = {r.pid: r for r in TR.advect_points(starts, volume.where("t = 0"), INFO, 0.05, scheme="rk4", dt=0.01).collect()}
    at = {(r.gx, r.gy, r.k): ends[r.pid] for r in starts.collect()}
    for (x, y), value in found.items():
        q = [at[x, y, k] for k in range(6)]
        d = np.array([[(q[2 * c + 1][a] - q[2 * c][a]) / 0.2 for c in range(3)] for a in "xyz"])
        assert value == pytest.approx(np.log(np.sqrt(np.linalg.eigvalsh(d.T @ d)[-1])) / max(e["time"] for e in q), abs=1e-6)
