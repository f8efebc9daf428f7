"""Interpolation of voxel channels at points: points are dealt to the halo'd bricks they lie in, and summed up there in numpy.

Points hold pid, gx, gy, gz (grid coordinates, cell i has its centre at i + 0.5) and t, or time. Cells beyond the border are
the border's (clamp) or wrap (periodic).
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES, VolumeInfo
from fieldspark.functions.kernels import KERNELS
from fieldspark.functions.session import cut
from fieldspark.operators.bricks import deal, pack_bricks, with_halo


def _cell(c: Column, n: int, periodic: bool) -> Column:
    return F.pmod(c, F.lit(n)) if periodic else F.least(F.lit(n - 1), F.greatest(F.lit(0), c))


def support(points: DataFrame, info: VolumeInfo, kernel: str, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), derivative: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row for each point and support cell: x, y, z and weight."""
    k = KERNELS[kernel]
    keep = keep or ["pid", "t"]
    cols = []
    for a, n, s in zip(AXES, info.size, shift, strict=True):
        g = F.col(f"g{a}") - 0.5 - s
        base = F.floor(g).cast("int")
        t = g - F.floor(g)
        if derivative == a:
            if k.derivative is None:
                raise ValueError(f"{kernel} has no derivative weights")
            ws = k.derivative(t)
        else:
            ws = k.weights(t)
        cols.append(F.array(*[F.struct(_cell(base + o, n, info.periodic).cast("int").alias("i"), w.alias("w")) for o, w in zip(k.offsets, ws, strict=True)]).alias(f"s{a}"))
    rows = points.select(*keep, *cols)
    for a in AXES:
        rows = rows.withColumn(f"s{a}", F.explode(f"s{a}"))
    return rows.select(*keep, *[F.col(f"s{a}.i").alias(a) for a in AXES], (F.col("sx.w") * F.col("sy.w") * F.col("sz.w")).alias("weight"))


def sample_by_join(points: DataFrame, voxels: DataFrame, info: VolumeInfo, kernel: str = "linear", cols: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """sample() of points with t as a join of support cells, for volumes with missing cells, which count as zeros."""
    shifts = [tuple(0.5 * (i == k) for i in range(3)) for k in range(3)] if KERNELS[kernel].staggered else [(0.0, 0.0, 0.0)]
    out = None
    for shift, own in zip(shifts, [(c,) for c in cols] if len(shifts) > 1 else [cols], strict=False):
        rows = support(points, info, kernel, shift, keep=["pid", "t"]).join(voxels.select("t", *AXES, *own), ["t", *AXES])
        part = rows.groupBy("pid").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in own])
        out = part if out is None else out.join(part, "pid")
    return out


def sample(points: DataFrame, voxels: DataFrame, info: VolumeInfo, kernel: str = "linear", cols: tuple[str, ...] = ("u", "v", "w"), time: str | None = None) -> DataFrame:
    """pid and interpolated channels; time: the column from which two steps are blended linearly, else points hold t."""
    return sample_at(points, voxels, info, kernel, cols, time=time)


def derivative_at(points: DataFrame, voxels: DataFrame, info: VolumeInfo, kernel: str = "bspline", cols: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """pid and the partial derivatives of channels at points: d<channel>_d<axis>."""
    return sample_at(points, voxels, info, kernel, cols, values=False, derivatives=True)


def sample_by_brick(points: DataFrame, voxels: DataFrame, info: VolumeInfo, kernel: str, cols: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """sample() with the bricks of info."""
    return sample_at(points, voxels, info, kernel, cols, own_bricks=True)


#: Points of one task.
POINTS_A_TASK = 20_000
#: Support cells looked at together.
TAPS = 1 << 21


def sample_at(points: DataFrame, voxels: DataFrame, info: VolumeInfo, kernel: str = "linear", cols: tuple[str, ...] = ("u", "v", "w"), values: bool = True, derivatives: bool = False, time: str | None = None, keep: list[str] | None = None, own_bricks: bool = False) -> DataFrame:
    """The columns `keep` of points (else pid), and channels and, if asked for, their derivatives d<channel>_d<axis>.

    Points meet halo'd bricks, each once (twice with time, for its two steps), so no support cell travels by itself; values and derivatives come from the same
    cells. A brick with many points is copied, and they are dealt to its copies. Bricks are four times the halo wide at least, unless own_bricks.
    The volume must have all its cells; see sample_by_join. Points beyond the border take the cells they stand for.
    """
    k = KERNELS[kernel]
    if derivatives and k.derivative is None:
        raise ValueError(f"{kernel} has no derivative weights")
    keep = keep or ["pid"]
    halo = k.radius + 2
    if not own_bricks:
        size = 1
        while size < max(4 * halo, info.core):
            size *= 2
        info = replace(info, brick=size, overlap=0)
    out = [*(cols if values else ()), *(f"d{c}_d{a}" for c in cols for a in AXES if derivatives)]
    packed = cut(pack_bricks(with_halo(voxels.select("t", *AXES, *cols), info, halo=halo), list(cols)))
    rows = points
    if info.periodic:
        rows = rows.withColumns({f"g{a}": F.col(f"g{a}") - F.floor(F.col(f"g{a}") / n) * n for a, n in zip(AXES, info.size, strict=True)})
    if time is not None:
        q = F.col(time) / info.dt
        low, part = F.floor(q).cast("int"), q - F.floor(q)
        steps = F.array(F.struct(F.least(F.lit(info.nt - 1), low).alias("t"), (1.0 - part).alias("wt")), F.struct(F.least(F.lit(info.nt - 1), low + 1).alias("t"), part.alias("wt")))
        rows = rows.withColumn("_s", F.explode(steps)).withColumns({"_step": F.col("_s.t"), "_wt": F.col("_s.wt")}).drop("_s").where("_wt > 0")
    else:
        rows = rows.withColumns({"_step": F.col("t"), "_wt": F.lit(1.0)})
    own = {f"_b{a}": F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(f"g{a}") / info.core))).cast("int") for a, n in zip(AXES, info.brick_count, strict=True)}
    rows = rows.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], *[F.col(f"g{a}").cast("double").alias(f"_g{a}") for a in AXES], F.col("_step").cast("int").alias("t"), "_wt", *[c.alias(n[1:]) for n, c in own.items()])
    keys = ["t", "bx", "by", "bz"]
    kept = [f"_keep{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept), "_wt double", *(f"`{c}` double" for c in out)])
    dealt = deal(rows.withColumn("_id", F.xxhash64(*kept)), packed, keys, POINTS_A_TASK, "_id")
    if dealt is None:
        return rows.select(*[F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)], *[F.lit(None).cast("double").alias(c) for c in out]).where("false")
    shift = [0.5 * np.eye(3)[min(i, 2)] for i in range(len(cols))] if k.staggered else [np.zeros(3)] * len(cols)

    def one(at: np.ndarray, arrays: list[np.ndarray], origin: tuple, n: tuple) -> dict[str, np.ndarray]:
        got: dict[str, np.ndarray] = {}
        weights, slopes, cells, last = [], [], [], None
        for c, array, s in zip(cols, arrays, shift, strict=True):
            if last is None or (s != last).any():
                q = at - 0.5 - s
                base = np.floor(q)
                weights = [np.stack(k.weights(q[:, d] - base[:, d]), 1) for d in range(3)]
                slopes = [np.stack(k.derivative(q[:, d] - base[:, d]), 1) for d in range(3)] if derivatives else []
                cells = [np.clip(base[:, d].astype(np.int64)[:, None] + np.array(k.offsets) - origin[d], 0, n[d] - 1) for d in range(3)]
                last = s
            total = np.zeros((4, len(at)))
            for i, z in enumerate(cells[2].T):
                plane = array[z[:, None, None], cells[1][:, :, None], cells[0][:, None, :]]
                along_x = np.einsum("nyx,nx->ny", plane, weights[0])
                flat = np.einsum("ny,ny->n", along_x, weights[1])
                total[0] += weights[2][:, i] * flat
                if derivatives:
                    total[1] += weights[2][:, i] * np.einsum("ny,ny->n", np.einsum("nyx,nx->ny", plane, slopes[0]), weights[1])
                    total[2] += weights[2][:, i] * np.einsum("ny,ny->n", along_x, slopes[1])
                    total[3] += slopes[2][:, i] * flat
            if values:
                got[c] = total[0]
            if derivatives:
                got |= {f"d{c}_d{a}": total[1 + d] / info.spacing[d] for d, a in enumerate(AXES)}
        return got

    def run(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({c: [] for c in (*kept, "_wt", *out)})
        if not len(b):
            raise ValueError("a brick of the volume has no cells")
        r = b.iloc[0]
        n, origin = (int(r["nx"]), int(r["ny"]), int(r["nz"])), (r["ox"], r["oy"], r["oz"])
        if len(r[cols[0]]) != n[0] * n[1] * n[2]:
            raise ValueError("a brick of the volume lacks cells; see sample_by_join")
        arrays = [np.asarray(r[c], float).reshape(n[::-1]) for c in cols]
        at = p[[f"_g{a}" for a in AXES]].to_numpy(float)
        many = max(1, TAPS // len(k.offsets) ** 2)
        parts = [one(at[i : i + many], arrays, origin, n) for i in range(0, len(at), many)]
        return pd.DataFrame({**{c: p[c] for c in (*kept, "_wt")}, **{c: np.concatenate([q[c] for q in parts]) for c in out}})

    lines, near = (df.groupBy(*keys, "copy") for df in dealt)
    got = lines.cogroup(near).applyInPandas(run, schema)
    if time is not None:
        got = got.groupBy(*kept).agg(*[F.sum(F.col("_wt") * F.col(c)).alias(c) for c in out])
    return got.select(*[F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)], *out)
