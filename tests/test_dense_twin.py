"""trc3_dense_lines against a line at a time in plain Python: its own interpolation, curve and normals; the tableau is the published one."""

from __future__ import annotations

import math

import pytest

from fieldspark.functions.schemes import SCHEMES
from fieldspark.plans import catalog
from fieldspark.plans.fixtures import grid, world_points

SF = "/root/testdata/sf0.001"
DT, TOL, DT_MIN, DT_MAX, AGE, STEP, MOST = 0.01, 1.0, 1e-4, 0.02, 0.04, 0.25, 64


def plus(a, b, k=1.0):
    return [x + k * y for x, y in zip(a, b, strict=True)]


def size(a):
    return math.sqrt(sum(x * x for x in a))


def cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a):
    n = size(a)
    return [x / n for x in a]


def field_of(cells):
    def velocity(p):
        g = [(x + 8.0) / 2.0 - 0.5 for x in p]
        low = [math.floor(x) for x in g]
        out = [0.0, 0.0, 0.0]
        for corner in range(8):
            place, w = [], 1.0
            for d in range(3):
                up = corner >> d & 1
                part = g[d] - low[d]
                w *= part if up else 1.0 - part
                place.append(min(7, max(0, low[d] + up)))
            out = plus(out, cells[tuple(place)], 2.0 * w)  # physical velocity to world units
        return out

    return velocity


def line(start, velocity):
    """Vertices (place, time, velocity, normal) of one line."""
    s = SCHEMES["dopri5"]
    pos, time, dt, vel = list(start), 0.0, DT, velocity(start)
    least = min(range(3), key=lambda d: abs(vel[d]))
    normal = unit(cross(vel, [float(d == least) for d in range(3)]))
    across = lambda v, n: unit(cross(cross(v, n), v))
    out, last = [(pos, time, vel, normal)], pos
    while time < AGE - 1e-12 and len(out) < MOST:
        h = min(dt, AGE - time)
        k = [vel]
        for row in s.a:
            at = pos
            for w, q in zip(row, k, strict=False):
                at = plus(at, q, h * w)
            k.append(velocity(at))
        weighted = lambda ws, k=k: [sum(w * q[d] for w, q in zip(ws, k, strict=True)) for d in range(3)]
        move, error = weighted(s.b), size(weighted(s.e))
        new = plus(pos, move, h)
        accepted = error < TOL or h <= DT_MIN
        grown = min(DT_MAX, max(DT_MIN, h * (4.0 if error == 0 else min(4.0, max(0.125, 0.8 * (TOL / error) ** (1.0 / s.order))))))
        if not accepted:
            dt = grown
            continue
        dt = max(grown, dt)
        middle = plus(plus(pos, move, h / 2), weighted(s.dense), h / 6)
        curve = [pos, plus(pos, k[0], h / 4), middle, plus(new, k[-1], -h / 4), new]
        before, side, pos, vel = time, normal, new, k[-1]
        time += h
        normal = across(vel, normal)
        moved = size(plus(pos, last, -1.0))
        outside = any(abs(x) > 8.0 for x in pos)
        if moved >= STEP or outside:
            parts = min(max(1, math.floor(moved / STEP)), MOST - len(out))
            for part in range(1, parts):
                u = part / parts
                binomial = [math.comb(4, i) * u**i * (1 - u) ** (4 - i) for i in range(5)]
                place = [sum(b * c[d] for b, c in zip(binomial, curve, strict=True)) for d in range(3)]
                slopes = [math.comb(3, i) * u**i * (1 - u) ** (3 - i) for i in range(4)]
                v = [4 * sum(b * (curve[i + 1][d] - curve[i][d]) for i, b in enumerate(slopes)) / h for d in range(3)]
                side = across(v, side)
                out.append((place, before + u * h, v, side))
            out.append((pos, time, vel, normal))
            last = pos
        if outside:
            break
    return out


def test_dense_lines_are_those_of_a_plain_twin(spark):
    cells = {(r.x, r.y, r.z): [r.u, r.v, r.w] for r in grid(spark, SF).where("t = 0").collect()}
    velocity = field_of(cells)
    got: dict[int, list] = {}
    for r in catalog.queries()["trc3_dense_lines"](spark, SF).collect():
        got.setdefault(r.line_id, []).append(r)
    starts = {r.pid: [r.x, r.y, r.z] for r in world_points(spark, SF).collect()}
    assert got.keys() == starts.keys() and max(map(len, got.values())) > 4
    for i, start in starts.items():
        want = line(start, velocity)
        rows = sorted(got[i], key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(len(want)))
        for r, (place, time, vel, normal) in zip(rows, want, strict=True):
            assert [r.x, r.y, r.z, r.time] == pytest.approx([*place, time], abs=3e-6)
            assert [r.vel_x, r.vel_y, r.vel_z] == pytest.approx(vel, abs=2e-5)
            assert [r.nrm_x, r.nrm_y, r.nrm_z] == pytest.approx(normal, abs=2e-5)
