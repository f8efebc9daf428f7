"""Scans of long keys, range joins, composited bricks and gaps, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import iso as ISO
from fieldspark.operators import quantize as Q
from fieldspark.operators import select as S
from fieldspark.operators import ranges, smoothing, stats, stencil


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scans_by_ranges(spark, keys, exclusive):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", None, "z"]), i, r.choice([None, 0, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    got = {r_.i: r_.prefix for r_ in stats.prefix_sum(df, keys, ["i"], "v", exclusive=exclusive, blocks=9).collect()}
    want, sums = {}, {}
    for k, i, v in rows:
        key = k if keys else 0
        before = sums.get(key)
        if v is not None:
            sums[key] = (before or 0) + v
        want[i] = (before or 0) if exclusive else sums.get(key)
    assert got == want
    parts = [n["count"] for n in stats.in_ranges(df, keys, ["i"], 9).groupBy("scan_block").count().collect()]
    assert len(parts) == 9 and max(parts) < 2 * 3000 / 9


def test_zero_runs_of_one_long_series(spark):
    r = random.Random(1)
    series = [r.choice([0, 0, 0, 0, 3, -2]) for _ in range(2000)] + [0] * 50
    df = spark.createDataFrame(list(enumerate(series)), "i int, s int").repartition(5)
    want, zeros = [], 0
    for s in series:
        if s:
            want.append((len(want), zeros, s))
            zeros = 0
        else:
            zeros += 1
    want.append((len(want), zeros, None))
    got = sorted(map(tuple, Q.zero_runs(df, "s", [], ["i"], blocks=6).select("run", "zeros", "s").collect()))
    assert got == want
    assert sorted(map(tuple, Q.zero_runs(df, "s", [], ["i"]).select("run", "zeros", "s").collect())) == want


def test_boxes_of_all_sizes(spark):
    r = random.Random(7)
    points = [(i, *(r.choice([r.uniform(-9, 9), float(r.randint(-3, 3)), -0.0]) for _ in range(3))) for i in range(400)] + [(1000, 1e12, 0.0, 0.0), (1001, None, 0.0, 0.0)]
    boxes = []
    for b in range(300):
        size = 10 ** r.uniform(-3, 1.5)
        lo = [r.choice([r.uniform(-9, 9), float(r.randint(-3, 3))]) for _ in range(3)]
        boxes.append((b, *lo, *(x + r.choice([size, size * 0.01, 1.0]) for x in lo)))
    inf = float("inf")
    boxes += [(500, -inf, -inf, -inf, inf, inf, inf), (501, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), (502, 2.0, -1.0, -1.0, 1.0, 1.0, 1.0), (503, -1e9, -1e9, -1e9, 1e13, 1e9, 1e9), (504, 0.0, -inf, 0.0, 1.0, inf, 1.0), (505, 0.0, None, 0.0, 1.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "pid int, x double, y double, z double")
    names = "box int, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"
    joined = S.points_in_boxes(p, spark.createDataFrame(boxes, names))
    want = sorted((i, b[0]) for i, *x in points for b in boxes if None not in x and None not in b and all(lo <= v < hi for lo, v, hi in zip(b[1:4], x, b[4:], strict=True)))
    assert sorted((r_.pid, r_.box) for r_ in joined.collect()) == want and len(want) > 1000
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert S.points_in_boxes(p, spark.createDataFrame([], names)).count() == 0


@pytest.mark.parametrize("opaque", [False, True])
def test_bricks_over_one_another_are_the_ray(spark, opaque):
    g = np.random.default_rng(2)
    cells = [(0, x, y, z, *g.random(3).tolist(), 1.0 if opaque and z == 7 else float(g.random() * 0.9)) for x in range(3) for y in range(2) for z in range(20) if (x + y + z) % 4]
    df = spark.createDataFrame(cells, "t int, x int, y int, z int, r double, g double, b double, a double")
    rows = lambda d: {(r.x, r.y): np.array([r.r, r.g, r.b, r.a]) for r in d.collect()}
    for clip in (None, (3.0, 15.0)):
        one, two = rows(ISO.composite(df, "z", clip)), rows(ISO.composite_bricks(df, "z", 6, clip))
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-12) for k in one)
    alone = {(r.x, r.y, r.z): r["pass"] for r in df.withColumn("pass", ISO.transmittance(F.col("a"), "z")).collect()}
    bricks = ISO.with_transmittance(df, F.col("a"), "z", 6)
    assert bricks.columns == [*df.columns, "pass"]
    got = {(r.x, r.y, r.z): r["pass"] for r in bricks.collect()}
    assert got.keys() == alone.keys() and all(abs(got[k] - alone[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("edge", ["zero", "shrink", "clamp"])
def test_radii_together_are_radii_alone(spark, edge):
    g = np.random.default_rng(3)
    df = spark.createDataFrame([(0, x, y, z, float(g.random())) for x in range(5) for y in range(4) for z in range(6)], "t int, x int, y int, z int, u double")
    wide = smoothing.filter_pyramid(df, ["u"], [2, 0, 1], edge)
    for level, r in enumerate([0, 2, 0, 1]):
        one = {(c.x, c.y, c.z): c.u for c in (smoothing.box_filter(df, ["u"], r, edge) if r else df).collect()}
        got = {(c.x, c.y, c.z): c.u for c in smoothing.select_level(wide, level).collect()}
        assert one.keys() == got.keys() and all(abs(one[k] - got[k]) < 1e-12 for k in one)
    plan = smoothing.box_filters(df, ["u"], [1, 2, 4, 8], edge)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("boundary", ["null", "clamp", "periodic"])
@pytest.mark.parametrize("k", [-3, -1, 1, 2])
def test_neighbours_are_cells_not_rows(spark, boundary, k):
    cells = {0: 1.0, 1: 2.0, 4: 5.0, 5: 6.0, 7: 8.0}
    df = spark.createDataFrame([(0, 0, 0, z, u) for z, u in cells.items()], "t int, x int, y int, z int, u double")
    got = {r.z: r.n for r in stencil.shift(df, "u", "z", k, boundary, "n", size=8).collect()}
    place = {"null": lambda z: z, "clamp": lambda z: min(7, max(0, z)), "periodic": lambda z: z % 8}[boundary]
    assert got == {z: cells.get(place(z + k)) for z in cells}


def test_nothing_crosses_a_gap(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0.0), (0, 0, 0, 5, 10.0), (0, 0, 0, 6, 0.0)], "t int, x int, y int, z int, u double")
    assert [(r["at"], r.enters) for r in ISO.iso_crossings(df, "u", 5.0, "z").collect()] == [(5.5, False)]
    assert ISO.transitions(ISO.classify_iso(df, "u", 5.0), "inside", "z").count() == 1
    assert [r.d for r in stencil.derivative(df, "u", "z", out="d", size=8).orderBy("z").collect()] == [None, None, None]
    assert df.where(F.col("u") > 99).count() == stencil.derivative(df.where("u > 99"), "u", "z").count() == 0


def test_sums_in_boxes_are_those_of_all_pairs(spark):
    r = random.Random(8)
    inf, nan = float("inf"), float("nan")
    pts = [(r.choice([k, None]), r.randint(0, 30) / 4.0, r.gauss(0, 1), 0.5 if k % 3 else r.random()) for k in range(900)]
    pts += [(k * 2**40 - 2**44, 3.25, 0.125, 0.5) for k in range(700)]  # a crowded place
    pts += [(k, 5.0 + k * 1e-9, 0.25, 0.5) for k in range(300)] + [(1, None, 0.0, 0.0), (7, inf, 0.0, 0.0), (9, -inf, 0.0, 0.5), (3, nan, 0.0, 0.0)]
    boxes = []
    for k in range(200):
        lo = [r.uniform(-2, 9), r.uniform(-3, 3), r.uniform(-0.5, 1)]
        boxes.append((k if k % 9 else None, *lo, *[v + r.choice([0.0, 1e-9, 0.3, 2.0, 20.0]) for v in lo]))
    boxes += [(500, -inf, -inf, -inf, inf, inf, inf), (501, 3.25, 0.125, 0.5, 3.5, 0.25, 0.75), (502, 0.0, -1.0, 0.0, None, 1.0, 1.0), (503, 9.0, 0.0, 0.0, 8.0, 1.0, 1.0)]
    names = ["box", *[f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]]
    p, b = spark.createDataFrame(pts, "pid long, x double, y double, z double"), spark.createDataFrame(boxes, ", ".join(f"{c} {'long' if c == 'box' else 'double'}" for c in names))
    want = {}
    for box in boxes:
        hits = [q for q in pts if None not in (*box[1:], *q[1:]) and all(box[1 + k] <= q[1 + k] < box[4 + k] for k in range(3))]
        if hits:
            n, total = want.get(box[0], (0, None))
            own = [q[0] for q in hits if q[0] is not None]
            want[box[0]] = (n + len(hits), (total or 0) + sum(own) if own else total)
    for places, boxes_a_task in ((1024, 50_000), (32, 20), (8, 50_000)):
        got = ranges.sums_in_boxes(p, b, "box", ["pid"], places, boxes_a_task)
        assert got.columns == ["box", "n", "pid"]
        assert {x.box: (x.n, x.pid) for x in got.collect()} == want
    assert ranges.sums_in_boxes(p.where("false"), b, "box", ["pid"]).count() == 0
    assert ranges.sums_in_boxes(p, b.where("false"), "box", ["pid"]).count() == 0


def test_boxes_of_orders_list_no_pairs(spark, monkeypatch):
    from fieldspark.plans import catalog

    def pairs(*_):
        raise AssertionError("a row for each point of each box")

    monkeypatch.setattr(S, "points_in_boxes", pairs)
    assert catalog.queries()["jon6_order_boxes"](spark, "/root/testdata/sf0.001").count() > 0
