"""Trajectory tables: segments, step lengths, heat maps, time in cells, brick scores, sweeps."""

from __future__ import annotations

from functools import reduce as fold

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES, VolumeInfo, heat_map_dims
from fieldspark.operators.bricks import DIRECTIONS, brick_neighbors
from fieldspark.operators.select import with_region


def _line():
    return Window.partitionBy("line_id").orderBy("seq")


def segments(vertices: DataFrame) -> DataFrame:
    """line_id, seq and the two ends of each segment: x0..z0, x1..z1."""
    out = vertices.select("line_id", "seq", *[F.col(a).alias(f"{a}0") for a in AXES], *[F.lead(a).over(_line()).alias(f"{a}1") for a in AXES])
    return out.where("x1 is not null")


def step_lengths(vertices: DataFrame) -> DataFrame:
    """Adds the distance and the time from the vertex before; nulls for a line's first."""
    d = F.sqrt(sum(((F.col(a) - F.lag(a).over(_line())) * (F.col(a) - F.lag(a).over(_line())) for a in AXES[1:]), (F.col("x") - F.lag("x").over(_line())) * (F.col("x") - F.lag("x").over(_line()))))
    return vertices.withColumn("step_length", d).withColumn("step_time", F.col("time") - F.lag("time").over(_line()))


def cap_lines(vertices: DataFrame, n: int) -> DataFrame:
    return vertices.withColumn("_n", F.row_number().over(_line())).where(F.col("_n") <= n).drop("_n")


def union_lines(*sets: DataFrame) -> DataFrame:
    """Line sets together, told apart by `line_set`."""
    return fold(DataFrame.unionByName, [s.withColumn("line_set", F.lit(k)) for k, s in enumerate(sets)])


def heat_map(vertices: DataFrame, info: VolumeInfo, weight: str = "vertex", channel: str | None = None, dims: tuple[int, int, int] | None = None) -> DataFrame:
    """channel, gx, gy, gz, cnt: vertices in each cell of the volume.

    weight "segment_end" counts a vertex for each segment that it ends, so inner ones twice. Cells come by truncation, so
    places within one cell below the border fall to cell 0; others outside count nowhere.
    """
    dims = dims or heat_map_dims(info)
    rows = vertices
    if weight == "segment_end":
        first, last = F.lag("x").over(_line()).isNotNull().cast("long"), F.lead("x").over(_line()).isNotNull().cast("long")
        rows = rows.withColumn("_w", first + last)
    else:
        rows = rows.withColumn("_w", F.lit(1).cast("long"))
    for a, n, half in zip(AXES, dims, info.half_size_world, strict=True):
        q = (F.col(a) + half) / (2.0 * half) * n
        rows = rows.withColumn(f"g{a}", F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("int")).where(F.col(f"g{a}").between(0, n - 1))
    c = (F.col(channel) if channel else F.lit(0)).cast("long").alias("channel")
    return rows.where("_w > 0").groupBy(c, "gx", "gy", "gz").agg(F.sum("_w").alias("cnt"))


def heat_map_by_region(vertices: DataFrame, info: VolumeInfo, regions: DataFrame, picked: list[int], width: int, height: int, seed: tuple[str, str] = ("sx", "sy"), dims: tuple[int, int, int] | None = None) -> DataFrame:
    """A channel for each picked region: that of the line's seed."""
    rows = with_region(vertices, regions, info, width, height, *seed).where(F.col("region").isin(picked))
    return heat_map(rows, info, channel="region", dims=dims)


def accumulate_heat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("channel", "gx", "gy", "gz").agg(F.sum("cnt").alias("cnt"))


def heat_map_scale(heat: DataFrame, mode: str) -> DataFrame:
    """One number: the largest count, or the mean over channels of the mean, or of the upper median (1 at least), of counts."""
    rows = heat.where("cnt > 0")
    if mode == "off":
        return heat.sparkSession.range(1).select(F.lit(1.0).alias("scale"))
    if mode == "max":
        return rows.agg(F.coalesce(F.max("cnt"), F.lit(1)).cast("double").alias("scale"))
    if mode == "mean":
        return rows.groupBy("channel").agg(F.avg("cnt").alias("m")).agg(F.coalesce(F.avg("m"), F.lit(1.0)).alias("scale"))
    if mode == "median":
        # counts of counts: the window orders distinct counts, not cells
        sizes = rows.groupBy("channel", "cnt").agg(F.count("*").alias("k"))
        w = Window.partitionBy("channel")
        sizes = sizes.withColumn("upto", F.sum("k").over(w.orderBy("cnt"))).withColumn("n", F.sum("k").over(w))
        middle = sizes.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("channel").agg(F.min("cnt").alias("m"))
        return middle.agg(F.coalesce(F.avg(F.greatest("m", F.lit(1))), F.lit(1.0)).alias("scale"))
    raise ValueError(mode)


def normalize_heat_map(heat: DataFrame, mode: str) -> DataFrame:
    """Adds value: the count over the map's scale."""
    return heat.crossJoin(F.broadcast(heat_map_scale(heat, mode))).withColumn("value", F.col("cnt") / F.col("scale")).drop("scale")


# ---------------------------------------------------------------- time in cells


def cell_step(state: tuple[int, float, float, int, float], cell: int, dt: float, threshold: float) -> tuple[int, float, float, int, float]:
    """One visit: (cell, time in it, time outside, longest cell, its time). The outside timer is not reset on return."""
    own, inside, outside, longest, most = state
    if own == cell:
        inside += dt
    elif own == 0:
        own, inside = cell, dt
    else:
        outside += dt
        if outside > threshold:
            own, inside, outside = cell, outside, 0.0
    if inside > most:
        longest, most = own, inside
    return own, inside, outside, longest, most


CELL_TIMES = "pid long, seq long, current_cell long, time_in_cell double, longest_cell long, longest_time double"


def time_in_cell(visits: DataFrame, threshold: float) -> DataFrame:
    """Of each visit (pid, seq, region, dt): the cell a particle counts for, its time there, and its longest cell so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        state, out = (0, 0.0, 0.0, 0, 0.0), []
        for seq, cell, dt in zip(pdf["seq"].tolist(), pdf["region"].tolist(), pdf["dt"].tolist(), strict=True):
            state = cell_step(state, int(cell), float(dt), threshold)
            out.append((seq, state[0], state[1], state[3], state[4]))
        return pd.DataFrame(out, columns=["seq", "current_cell", "time_in_cell", "longest_cell", "longest_time"]).assign(pid=pdf["pid"].iloc[0])[[c.split()[0] for c in CELL_TIMES.split(", ")]]

    return visits.select("pid", "seq", "region", "dt").groupBy("pid").applyInPandas(run, CELL_TIMES)


# ---------------------------------------------------------------- brick scores


def neighbour_score(counts: DataFrame, info: VolumeInfo, resident: DataFrame, flow: DataFrame | None = None, bonus: float = 0.1, penalty: float = 0.1, sqrt: bool = False) -> DataFrame:
    """bx, by, bz, score. counts: bx, by, bz, n; resident: bx, by, bz; flow: bx, by, bz, dir, freq (else 1/6).

    A brick's n, plus bonus for exchange with resident neighbours, less penalty for what others would still send.
    """
    n = F.sqrt("n") if sqrt else F.col("n").cast("double")
    counts = counts.select("bx", "by", "bz", n.alias("n"))
    pairs = brick_neighbors(counts, info)
    nb = counts.select(*[F.col(f"b{a}").alias(f"nb{a}") for a in AXES], F.col("n").alias("nb_n"))
    here = resident.select(*[F.col(f"b{a}").alias(f"nb{a}") for a in AXES], F.lit(True).alias("here"))
    rows = pairs.join(counts, ["bx", "by", "bz"]).join(nb, ["nbx", "nby", "nbz"], "left").join(here, ["nbx", "nby", "nbz"], "left")
    if flow is None:
        rows = rows.withColumns({"p_out": F.lit(1 / 6), "p_in": F.lit(1 / 6)})
    else:
        rows = rows.join(flow.select("bx", "by", "bz", "dir", F.col("freq").alias("p_out")), ["bx", "by", "bz", "dir"], "left")
        back = flow.select(*[F.col(f"b{a}").alias(f"nb{a}") for a in AXES], ((F.col("dir") + 3) % len(DIRECTIONS)).alias("dir"), F.col("freq").alias("p_in"))
        rows = rows.join(back, ["nbx", "nby", "nbz", "dir"], "left").fillna(0.0, ["p_out", "p_in"])
    sent = F.col("p_in") * F.coalesce("nb_n", F.lit(0.0))
    rows = rows.groupBy("bx", "by", "bz").agg((bonus * F.sum(F.when(F.col("here"), F.col("p_out") * F.col("n") + sent).otherwise(0.0)) - penalty * F.sum(F.when(F.col("here"), 0.0).otherwise(sent))).alias("more"))
    return counts.join(rows, ["bx", "by", "bz"], "left").select("bx", "by", "bz", (F.col("n") + F.coalesce("more", F.lit(0.0))).alias("score"))


def top_bricks(scores: DataFrame, k: int) -> DataFrame:
    """The k highest scores: a top-k, not a full sort."""
    return scores.orderBy(F.desc("score"), "bz", "by", "bx").limit(k)
