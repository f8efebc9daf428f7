"""Column arithmetic on vectors of three and matrices of nine columns; all stays in whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V3 = tuple[Column, Column, Column]
M3 = tuple[V3, V3, V3]


def v3(prefix: str, axes: tuple[str, ...] = ("x", "y", "z")) -> V3:
    return tuple(F.col(prefix + a) for a in axes)  # type: ignore[return-value]


def dot(a: V3, b: V3) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: V3) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: V3, b: V3) -> V3:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def normalize(a: V3) -> V3:
    """Unit vector; nulls for the zero vector."""
    n = length(a)
    return tuple(F.try_divide(c, n) for c in a)  # type: ignore[return-value]


def m3(prefix: str = "j") -> M3:
    return tuple(tuple(F.col(f"{prefix}{r}{c}") for c in range(3)) for r in range(3))  # type: ignore[return-value]


def transpose(m: M3) -> M3:
    return tuple(tuple(m[c][r] for c in range(3)) for r in range(3))  # type: ignore[return-value]


def product(a: M3, b: M3) -> M3:
    bt = transpose(b)
    return tuple(tuple(dot(a[r], bt[c]) for c in range(3)) for r in range(3))  # type: ignore[return-value]


def add(a: M3, b: M3, scale: float = 1.0) -> M3:
    return tuple(tuple((a[r][c] + b[r][c]) * scale for c in range(3)) for r in range(3))  # type: ignore[return-value]


def subtract(a: M3, b: M3, scale: float = 1.0) -> M3:
    return tuple(tuple((a[r][c] - b[r][c]) * scale for c in range(3)) for r in range(3))  # type: ignore[return-value]


def trace(m: M3) -> Column:
    return m[0][0] + m[1][1] + m[2][2]


def det(m: M3) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def frobenius_sq(m: M3) -> Column:
    """Sum of squares: the trace of m times its transpose."""
    return dot(m[0], m[0]) + dot(m[1], m[1]) + dot(m[2], m[2])


def apply(m: M3, v: V3) -> V3:
    return tuple(dot(m[r], v) for r in range(3))  # type: ignore[return-value]


def strain(j: M3) -> M3:
    return add(j, transpose(j), 0.5)


def spin(j: M3) -> M3:
    return subtract(j, transpose(j), 0.5)


def columns(m: M3, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{r}{c}": m[r][c] for r in range(3) for c in range(3)}


def transform_pos(v: V3, m: list[list[float]]) -> V3:
    """Affine map, 3 x 4, of a position."""
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] + r[3] for r in m)  # type: ignore[return-value]


def transform_dir(v: V3, m: list[list[float]]) -> V3:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m)  # type: ignore[return-value]


def sort3(a: Column, b: Column, c: Column) -> V3:
    """Largest, middle and least."""
    high, low = F.greatest(a, b, c), F.least(a, b, c)
    return high, a + b + c - high - low, low


def eigenvalues_sym(m: M3) -> V3:
    """Eigenvalues of a symmetric matrix (its upper triangle), largest first, by the trigonometric solution of the cubic."""
    (a, d, e), (_, b, f), (_, _, c) = m
    mean = (a + b + c) / 3.0
    off = d * d + e * e + f * f
    p = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2.0 * off) / 6.0)
    ca, cb, cc = a - mean, b - mean, c - mean
    half_det = (ca * (cb * cc - f * f) - d * (d * cc - f * e) + e * (d * f - cb * e)) / 2.0
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(half_det, p * p * p), F.lit(1.0))))
    phi = F.acos(r) / 3.0
    high = mean + 2.0 * p * F.cos(phi)
    low = mean + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    return high, 3.0 * mean - high - low, low


def with_eigenvalues(df: DataFrame, m: M3, names: tuple[str, str, str]) -> DataFrame:
    """Adds the eigenvalues of eigenvalues_sym, largest first, in steps: what a formula needs often is a column of its own, so the
    expression doesn't grow with each use. Columns _mean, _size and _phi come and go."""
    (a, d, e), (_, b, f), (_, _, c) = m
    mean, p = F.col("_mean"), F.col("_size")
    df = df.withColumn("_mean", (a + b + c) / 3.0)
    off = d * d + e * e + f * f
    df = df.withColumn("_size", F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2.0 * off) / 6.0))
    ca, cb, cc = a - mean, b - mean, c - mean
    half_det = (ca * (cb * cc - f * f) - d * (d * cc - f * e) + e * (d * f - cb * e)) / 2.0
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(half_det, p * p * p), F.lit(1.0))))
    df = df.withColumn("_phi", F.acos(r) / 3.0)
    high, low = mean + 2.0 * p * F.cos("_phi"), mean + 2.0 * p * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0)
    df = df.withColumns({names[0]: high, names[2]: low})
    return df.withColumn(names[1], 3.0 * mean - F.col(names[0]) - F.col(names[2])).drop("_mean", "_size", "_phi")


def eigenvector_sym(m: M3, value: Column) -> V3:
    """Unit eigenvector of a simple eigenvalue: the largest cross product of two rows of m - value; nulls if there is none."""
    (a, d, e), (_, b, f), (_, _, c) = m
    rows = ((a - value, d, e), (d, b - value, f), (e, f, c - value))
    tries = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    norms = [dot(t, t) for t in tries]
    best = F.greatest(*norms)
    pick = lambda k: F.when(norms[0] >= best, tries[0][k]).when(norms[1] >= best, tries[1][k]).otherwise(tries[2][k])
    return tuple(F.try_divide(pick(k), F.sqrt(best)) for k in range(3))  # type: ignore[return-value]


def with_strain(df: DataFrame) -> DataFrame:
    return df.withColumns(columns(strain(m3("j")), "s"))


def with_spin(df: DataFrame) -> DataFrame:
    return df.withColumns(columns(spin(m3("j")), "o"))
