"""Neighbour access and derivatives on voxel tables (t, x, y, z, channels).

Each axis is one window over a whole pencil of cells, so three axes cost three exchanges. `halo_map` is the other way: one
exchange by brick, and numpy on each halo'd brick.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES, VolumeInfo

PENCIL = {"x": ("t", "y", "z"), "y": ("t", "x", "z"), "z": ("t", "x", "y")}


def pencil(axis: str):
    return Window.partitionBy(*PENCIL[axis]).orderBy(axis)


def neighbour(col: str, axis: str, k: int, boundary: str = "clamp", size: int | None = None) -> Column:
    """The value of the cell k on along an axis, matched by its place; null where the table has no such cell.

    Beyond the border: the border cell's value (clamp), the wrapped cell's (periodic), or null. size: cells of the volume
    along the axis. Without it the first and last cell of a pencil count as its border, so a table that holds parts of pencils only needs it.
    """
    w = pencil(axis)
    if abs(k) == 1:
        step = F.lead if k > 0 else F.lag
        value = F.when(step(axis).over(w) == F.col(axis) + k, step(col).over(w))
    else:
        value = F.first(col).over(w.rangeBetween(k, k)) if k else F.col(col)
    if boundary == "null" or not k:
        return value
    if boundary == "clamp" and abs(k) == 1:  # only the border cell itself looks beyond the border
        last = (F.col(axis) == (size - 1 if k > 0 else 0)) if size else step(axis).over(w).isNull()
        return F.when(last, F.col(col)).otherwise(value)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.lit(size - 1) if size else (F.max(axis).over(whole) if k > 0 else F.lit(0))
    low = F.lit(0) if size else (F.min(axis).over(whole) if k < 0 else F.lit(0))
    if boundary == "clamp":
        edge, beyond = (F.last(F.struct(axis, col)), F.col(axis) + k > top) if k > 0 else (F.first(F.struct(axis, col)), F.col(axis) + k < low)
        edge = edge.over(whole)
        return F.when(beyond, F.when(edge[axis] == (top if k > 0 else low), edge[col])).otherwise(value)
    if boundary == "periodic":
        n = F.lit(size) if size else F.max(axis).over(whole) - F.min(axis).over(whole) + 1
        first = F.lit(0) if size else F.min(axis).over(whole)
        last = first + n - 1
        m, cell = abs(k), F.struct(axis, col)
        if k > 0:
            far, beyond = [F.nth_value(cell, j).over(whole) for j in range(1, m + 1)], F.col(axis) + k > last
        else:
            back = Window.partitionBy(*PENCIL[axis]).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            far, beyond = [F.last(cell).over(whole)] if m == 1 else [F.nth_value(cell, j).over(back) for j in range(1, m + 1)], F.col(axis) + k < first
        # only the |k| cells of the far end travel with a row
        place = first + F.pmod(F.col(axis) + k - first, n)
        wrapped = F.get(F.filter(F.array(*far), lambda c: c[axis] == place), F.lit(0))[col]
        return F.when(beyond, wrapped).otherwise(value)
    raise ValueError(boundary)


def shift(df: DataFrame, col: str, axis: str, k: int, boundary: str = "clamp", out: str | None = None, size: int | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_{axis}{k:+d}", neighbour(col, axis, k, boundary, size))


def partial(col: str, axis: str, h: float = 1.0, boundary: str = "clamp", size: int | None = None) -> Column:
    return (neighbour(col, axis, 1, boundary, size) - neighbour(col, axis, -1, boundary, size)) / (2.0 * h)


def derivative(df: DataFrame, col: str, axis: str, h: float = 1.0, boundary: str = "clamp", out: str | None = None, size: int | None = None) -> DataFrame:
    """Central difference along one axis; null beside a gap. size: the volume's cells along the axis, see neighbour."""
    return df.withColumn(out or f"d{col}_d{axis}", partial(col, axis, h, boundary, size))


Size = tuple[int | None, int | None, int | None]
WHOLE: Size = (None, None, None)


def jacobian(df: DataFrame, cols: tuple[str, str, str] = ("u", "v", "w"), h: tuple[float, float, float] = (1.0, 1.0, 1.0), boundary: str = "clamp", size: Size = WHOLE) -> DataFrame:
    """Adds j00..j22; the row is the component, the column the direction. size: the volume's cells, needed where df is a part of it."""
    for c, axis in enumerate(AXES):
        df = df.withColumns({f"j{r}{c}": partial(col, axis, h[c], boundary, size[c]) for r, col in enumerate(cols)})
    return df


def gradient(df: DataFrame, col: str, h: tuple[float, float, float] = (1.0, 1.0, 1.0), boundary: str = "clamp", prefix: str | None = None, size: Size = WHOLE) -> DataFrame:
    """Adds the partial derivatives of a scalar: <prefix>x, y, z."""
    prefix = prefix or f"grad_{col}_"
    for c, axis in enumerate(AXES):
        df = df.withColumn(prefix + axis, partial(col, axis, h[c], boundary, size[c]))
    return df


def measure_gradient(df: DataFrame, col: str, boundary: str = "clamp", size: Size = WHOLE) -> DataFrame:
    """Adds the unit vector of differences one cell on and back: n_x, n_y, n_z; nulls where they vanish."""
    for c, axis in enumerate(AXES):
        df = df.withColumn(f"_d{axis}", neighbour(col, axis, 1, boundary, size[c]) - neighbour(col, axis, -1, boundary, size[c]))
    n = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2 + F.col("_dz") ** 2)
    return df.withColumns({f"n_{a}": F.try_divide(F.col(f"_d{a}"), n) for a in AXES}).drop(*[f"_d{a}" for a in AXES])


def moving_sum(df: DataFrame, col: str, axis: str, r: int, out: str | None = None) -> DataFrame:
    """Sum over the cells within r along an axis."""
    return df.withColumn(out or f"sum_{col}", F.sum(col).over(pencil(axis).rangeBetween(-r, r)))


def neighbours(df: DataFrame, offsets: list[tuple[int, int, int]], cols: list[str]) -> DataFrame:
    """Stencil self-join: (t, x, y, z, ox, oy, oz, columns of the neighbour) for every neighbour that exists."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy"), F.lit(c).alias("oz")) for a, b, c in offsets])).alias("o")
    to = df.select("t", *AXES, *cols, o).select("t", *[(F.col(a) - F.col(f"o.o{a}")).alias(a) for a in AXES], "o.ox", "o.oy", "o.oz", *[F.col(c).alias(f"nb_{c}") for c in cols])
    return df.select("t", *AXES).join(to, ["t", *AXES])


def halo_map(df: DataFrame, info: VolumeInfo, cols: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: list[str], halo: int = 1) -> DataFrame:
    """fn on each brick's arrays [z, y, x] with `halo` ghost cells; its results for core cells: one exchange in all."""
    from fieldspark.operators.bricks import with_halo

    core, size = info.core, info.size
    cells = with_halo(df, info, "periodic" if info.periodic else "clamp", halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, bx, by, bz = (int(pdf[c].iloc[0]) for c in ("t", "bx", "by", "bz"))
        lo = [b * core for b in (bx, by, bz)]
        n = [min(core, s - a) for a, s in zip(lo, size, strict=True)]
        at = tuple(pdf[f"g{a}"].to_numpy() - lo[k] + halo for k, a in enumerate(AXES))[::-1]
        arrays = {}
        for c in cols:
            arrays[c] = np.zeros([m + 2 * halo for m in n[::-1]])
            arrays[c][at] = pdf[c].to_numpy()
        got = fn(arrays)
        z, y, x = np.meshgrid(*[np.arange(a, a + m) for a, m in zip(lo[::-1], n[::-1], strict=True)], indexing="ij")
        inner = tuple(slice(halo, halo + m) for m in n[::-1])
        return pd.DataFrame({"t": t, "x": x.ravel(), "y": y.ravel(), "z": z.ravel()} | {c: got[c][inner].ravel() for c in out})

    return cells.groupBy("t", "bx", "by", "bz").applyInPandas(run, "t int, x int, y int, z int, " + ", ".join(f"{c} double" for c in out))


def jacobian_by_brick(df: DataFrame, info: VolumeInfo, cols: tuple[str, str, str] = ("u", "v", "w")) -> DataFrame:
    """jacobian() in one exchange: halo'd bricks and numpy."""
    h = info.spacing

    def run(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for r, c in enumerate(cols):
            for d, axis in enumerate((2, 1, 0)):
                out[f"j{r}{d}"] = (np.roll(a[c], -1, axis) - np.roll(a[c], 1, axis)) / (2 * h[d])
        return out

    return halo_map(df, info, list(cols), run, [f"j{r}{c}" for r in range(3) for c in range(3)])
