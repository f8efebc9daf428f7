"""Sampling by bricks against a join of support cells, whatever the copies, borders and columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions.info import VolumeInfo, resolve_spacing
from fieldspark.functions.kernels import KERNELS
from fieldspark.operators import sampling
from fieldspark.sources import volumes as VOL

SIZE = (9, 7, 8)


@pytest.fixture(scope="module")
def volume(spark):
    return VOL.synth_vortex(spark, *SIZE, jitter=0.5, nt=2).cache()


@pytest.fixture(scope="module")
def points(spark):
    g = np.random.default_rng(1)
    rows = [(int(i), int(i % 2), *(float(v) for v in g.uniform(-3, 12, 3)), "a b") for i in range(300)]
    rows += [(1000 + i, 0, 4.2, 4.1, 4.3, "c") for i in range(400)]  # a crowd
    return spark.createDataFrame(rows, "pid long, t int, gx double, gy double, gz double, `some name` string").repartition(3).cache()


def table(df, cols=("u", "v", "w")):
    return {r.pid: np.array([r[c] for c in cols]) for r in df.collect()}


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("kernel", sorted(KERNELS))
def test_bricks_give_what_a_join_gives(volume, points, monkeypatch, kernel, periodic):
    if kernel == "lagrange16" and periodic:
        pytest.skip("sixteen cells don't fit a volume of seven")
    monkeypatch.setattr(sampling, "POINTS_A_TASK", 90)
    info = VolumeInfo(*SIZE, 2, hx=0.5, hy=0.25, periodic=periodic)
    inside = points.where(" and ".join(f"g{a} between 0 and {n}" for a, n in zip("xyz", SIZE, strict=True))) if kernel == "lagrange16" else points
    got, want = table(sampling.sample(inside, volume, info, kernel)), table(sampling.sample_by_join(inside, volume, info, kernel))
    assert got.keys() == want.keys() and len(got) > 400 and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("kernel", ["bspline", "catrom"])
def test_derivatives_are_slopes_and_columns_travel(volume, points, kernel):
    info = VolumeInfo(*SIZE, 2, hx=0.5, hy=0.25)
    inner = points.where(" and ".join(f"g{a} between 1 and {n - 1}" for a, n in zip("xyz", SIZE, strict=True)))
    got = sampling.sample_at(inner, volume, info, kernel, ("u", "w"), derivatives=True, keep=["pid", "some name"])
    assert got.columns == ["pid", "some name", "u", "w", *[f"d{c}_d{a}" for c in "uw" for a in "xyz"]]
    rows = table(got, got.columns[2:])
    eps = 1e-5
    for d, (a, h) in enumerate(zip("xyz", info.spacing, strict=True)):
        up, down = (table(sampling.sample(inner.withColumn(f"g{a}", F.col(f"g{a}") + s * eps), volume, info, kernel, ("u", "w")), ("u", "w")) for s in (1, -1))
        for k, v in rows.items():
            assert np.allclose([v[2 + d], v[5 + d]], (up[k] - down[k]) / (2 * eps * h), atol=1e-4)


def test_missing_cells_are_an_error_and_no_points_no_rows(spark, volume, points):
    info = VolumeInfo(*SIZE, 2)
    with pytest.raises(Exception, match="lacks cells"):
        sampling.sample(points, volume.where("x <> 4 or y <> 4"), info).count()
    assert sampling.sample(points.where("false"), volume, info).count() == 0


def test_spacing_by_aspect():
    h = resolve_spacing((5, 9, 3), aspect=(1.0, 4.0, 2.0))  # of z, y, x
    assert np.allclose(h, np.array([0.5, 0.5, 0.5]) / 4.5)
    assert max(a * n for a, n in zip(h, (5, 9, 3), strict=True)) == 1.0
    with pytest.raises(ValueError):
        resolve_spacing((4, 4, 4), spacing=1.0, aspect=(1.0, 1.0, 1.0))
    with pytest.raises(ValueError):
        resolve_spacing((4, 1, 4), aspect=(1.0, 1.0, 1.0))
