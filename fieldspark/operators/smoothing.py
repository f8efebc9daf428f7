"""Separable box filters, and pyramids of several radii."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES
from fieldspark.operators.stencil import PENCIL


def _mean(col: str, axis: str, r: int, edge: str) -> Column:
    w = Window.partitionBy(*PENCIL[axis]).orderBy(axis)
    near = w.rangeBetween(-r, r)
    if edge == "zero":
        return F.sum(col).over(near) / float(2 * r + 1)
    if edge == "shrink":
        return F.avg(col).over(near)
    if edge == "clamp":
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low = F.greatest(F.lit(0), F.lit(r) - (F.col(axis) - F.min(axis).over(whole)))
        high = F.greatest(F.lit(0), F.lit(r) - (F.max(axis).over(whole) - F.col(axis)))
        return (F.sum(col).over(near) + low * F.first(col).over(whole) + high * F.last(col).over(whole)) / float(2 * r + 1)
    raise ValueError(edge)


def box_filter_axis(df: DataFrame, cols: list[str], axis: str, r: int, edge: str = "zero") -> DataFrame:
    """Mean over 2r + 1 cells along an axis. Outside cells count as zeros, as the border's value (clamp), or not (shrink)."""
    return df.withColumns({c: _mean(c, axis, r, edge) for c in cols})


def box_filter(df: DataFrame, cols: list[str], r: int, edge: str = "zero") -> DataFrame:
    """Along x, then y on its result, then z."""
    return fold(lambda d, a: box_filter_axis(d, cols, a, r, edge), AXES, df)


def box_filters(df: DataFrame, cols: list[str], radii: list[int], edge: str = "zero") -> DataFrame:
    """df with <column>_r<radius> for each radius: all radii share an axis's window, so there are three exchanges in all."""
    some = sorted({r for r in radii if r})
    df = df.withColumns({f"{c}_r{r}": F.col(c) for c in cols for r in some})
    for axis in AXES:
        df = df.withColumns({f"{c}_r{r}": _mean(f"{c}_r{r}", axis, r, edge) for c in cols for r in some})
    return df.withColumns({f"{c}_r0": F.col(c) for c in cols}) if 0 in radii else df


def filter_pyramid(df: DataFrame, cols: list[str], radii: list[int], edge: str = "zero") -> DataFrame:
    """The volume (level 0), and filtered volumes for each radius up to the last that isn't 0."""
    while radii and radii[-1] == 0:
        radii = radii[:-1]
    rest = [c for c in df.columns if c not in cols]
    wide = box_filters(df, cols, radii, edge)
    levels = [F.struct(F.lit(0).alias("level"), *[F.col(c).cast("double").alias(c) for c in cols])]
    levels += [F.struct(F.lit(k + 1).alias("level"), *[F.col(f"{c}_r{r}").cast("double").alias(c) for c in cols]) for k, r in enumerate(radii)]
    rows = wide.select(*rest, F.explode(F.array(*levels)).alias("_l"))
    return rows.select(*[F.col(c) if c in rest else F.col(f"_l.{c}").alias(c) for c in df.columns], "_l.level")


def select_level(pyramid: DataFrame, k: int) -> DataFrame:
    return pyramid.where(F.col("level") == k).drop("level")
