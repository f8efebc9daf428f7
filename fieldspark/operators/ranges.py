"""Sums over the points in each of many boxes, without a row for each pair of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES
from fieldspark.functions.session import cut
from fieldspark.operators.bricks import deal
from fieldspark.operators.select import small

CELL = ["bx", "by", "bz"]
BOXES = 1024  # boxes whose points are marked at a time


def _lines(at: DataFrame, bricks: int) -> dict[str, list[float]]:
    """Where the lattice is cut along each axis: near equal counts of places, no more cuts than an axis has values."""
    values = at.agg(*[F.approx_count_distinct(a).alias(a) for a in AXES]).first()
    out, left = {}, float(bricks)
    for k, a in enumerate(sorted(AXES, key=lambda a: values[a])):
        n = max(1, min(int(np.ceil(left ** (1 / (3 - k)) - 1e-9)), values[a]))
        out[a] = sorted({*at.approxQuantile(a, [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
        left /= n
    return out


def _place(x: Column, lines: list[float]) -> Column:
    """The number of lines up to a value; grows with it, so what lies strictly between the places of two values lies between them."""
    return reduce(Column.__add__, [(x >= F.lit(v)).cast("int") for v in lines], F.lit(0))


def _marked(order: np.ndarray) -> np.ndarray:
    """At [r] a bit for each of the first r points of an order."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bits = np.packbits(rank[None] < np.arange(len(order) + 1)[:, None], axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def _summed(names: list[str], ident: str, places: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(boxes: pa.Table, at: pa.Table) -> pa.Table:
        total = np.zeros((boxes.num_rows, len(names)), np.int64)
        ends = [(boxes[f"lo_{a}"].to_numpy(), boxes[f"hi_{a}"].to_numpy()) for a in AXES]
        weights = [at[c].to_numpy() for c in names]
        for s in range(0, at.num_rows if boxes.num_rows else 0, places):
            some = slice(s, s + places)
            sides = []
            for a, (lo, hi) in zip(AXES, ends, strict=True):
                x = at[a].to_numpy()[some]
                order = np.argsort(x, kind="stable")
                sides.append((_marked(order), np.searchsorted(x[order], lo), np.searchsorted(x[order], hi)))
            for b in range(0, len(total), BOXES):
                own = slice(b, b + BOXES)
                inside = reduce(np.bitwise_and, [marked[hi[own]] ^ marked[lo[own]] for marked, lo, hi in sides])
                who = np.flatnonzero(np.unpackbits(inside.view(np.uint8)).view(bool)) % (64 * inside.shape[1])
                edge = np.r_[0, np.cumsum(np.bitwise_count(inside).sum(1, dtype=np.int64))]
                for k, w in enumerate(weights):
                    upto = np.r_[0, np.cumsum(w[some].take(who))]
                    total[own, k] += upto[edge[1:]] - upto[edge[:-1]]
        hit = total[:, 0] > 0
        return pa.table({ident: boxes[ident].filter(pa.array(hit))} | {c: total[hit, k] for k, c in enumerate(names)})

    return run


def sums_in_boxes(points: DataFrame, boxes: DataFrame, ident: str, sums: list[str], places: int = 512, boxes_a_task: int = 50_000) -> DataFrame:
    """ident, n, and the sums of columns of longs, of the points (x, y, z) in each box (lo_x..hi_z, half open) that holds any.

    Points of one place are added up, and places are dealt to the bricks of a lattice with about `places` in each. A box goes to
    the bricks that its surface crosses; there its points are marked by bits, by their order along each axis. Bricks inside a box
    come from cumulative sums over the lattice, by its eight corners. A crowded brick is worked off in parts; one that many boxes
    cross is copied (`deal`). Rows that share an ident add up.
    """
    names = ["_n", *[f"_{k}{c}" for c in sums for k in "sn"]]
    aggs = [F.count("*").alias("_n"), *[x for c in sums for x in (F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"_s{c}"), F.count(c).alias(f"_n{c}"))]]
    points = points.select(*[F.col(a).cast("double").alias(a) for a in AXES], *sums)
    at = cut(points.where(" and ".join(f"{a} is not null" for a in AXES)).groupBy(*AXES).agg(*aggs))
    lines = _lines(at, -(-at.count() // places))
    at = at.withColumns({f"b{a}": _place(F.col(a), lines[a]) for a in AXES})
    totals = cut(at.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in names]))

    ends = [f"{e}_{a}" for e in ("lo", "hi") for a in AXES]
    rows = boxes.select(ident, *[F.col(c).cast("double").alias(c) for c in ends]).where(" and ".join(f"lo_{a} < hi_{a}" for a in AXES))
    rows = rows.withColumns({f"_{e}{a}": _place(F.col(f"{e}_{a}"), lines[a]) for e in ("lo", "hi") for a in AXES})
    within = lambda a: (F.col(f"b{a}") > F.col(f"_lo{a}")) & (F.col(f"b{a}") < F.col(f"_hi{a}"))
    row = lambda a: F.sequence(f"_lo{a}", f"_hi{a}")
    crossed = rows.withColumn("bz", F.explode(row("z"))).withColumn("by", F.explode(row("y")))
    crossed = crossed.withColumn("bx", F.explode(F.when(within("z") & within("y") & (F.col("_hix") > F.col("_lox")), F.array("_lox", "_hix")).otherwise(row("x"))))
    crossed = crossed.join(small(totals.select(*CELL)), CELL, "left_semi").select(ident, *ends, *CELL)
    schema = ", ".join([f"`{ident}` {dict(boxes.dtypes)[ident]}", *[f"`{c}` long" for c in names]])
    dealt = deal(crossed, at, CELL, boxes_a_task, ident)
    found = []
    if dealt is not None:
        mine, near = (df.groupBy(*CELL, "copy") for df in dealt)
        found.append(mine.cogroup(near).applyInArrow(_summed(names, ident, places), schema))

    lattice = reduce(DataFrame.crossJoin, [at.sparkSession.range(len(lines[a]) + 1).select(F.col("id").cast("int").alias(f"b{a}")) for a in AXES])
    upto = lattice.join(totals, CELL, "left").fillna(0, names)
    for a in AXES:
        window = Window.partitionBy(*[c for c in CELL if c != f"b{a}"]).orderBy(f"b{a}")
        upto = upto.withColumns({c: F.sum(c).over(window) for c in names})
    # the bricks strictly inside, by inclusion and exclusion
    inner = rows.where(" and ".join(f"_hi{a} - _lo{a} > 1" for a in AXES)).withColumn("_sign", F.lit(1))
    for a in AXES:
        end = F.explode(F.array(F.struct((F.col(f"_hi{a}") - 1).alias("at"), F.lit(1).alias("sign")), F.struct(F.col(f"_lo{a}").alias("at"), F.lit(-1).alias("sign"))))
        inner = inner.withColumn("_end", end).withColumns({f"b{a}": F.col("_end.at"), "_sign": F.col("_sign") * F.col("_end.sign")})
    inner = inner.select(ident, "_sign", *CELL).join(small(upto), CELL)
    found.append(inner.groupBy(ident).agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in names]))
    out = reduce(DataFrame.unionByName, found).groupBy(ident).agg(*[F.sum(c).alias(c) for c in names]).where("_n > 0")
    return out.select(ident, F.col("_n").alias("n"), *[F.when(F.col(f"_n{c}") > 0, F.col(f"_s{c}")).alias(c) for c in sums])
