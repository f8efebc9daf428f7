"""Stream lines, path lines and particles through bricked volumes.

The work is dealt by brick. In a round each line is advanced, in numpy and together with all others in its brick, until it
leaves the brick; then its state is dealt to the next brick. Rounds so follow bricks crossed, not steps. State and vertices
of a round are written to the shared folder.

The load is balanced in each round: live lines are counted by brick, and a brick that holds more than `lines_a_task` of them is copied as often
as that bound goes into its lines, for this round alone, and its lines are dealt to the copies. Bricks without lines stay where they are. The lines of
all runs of a sweep share a brick's copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import tensor as T
from fieldspark.functions.info import AXES, VolumeInfo, velocity_scale, with_brick_of
from fieldspark.functions.kernels import KERNELS
from fieldspark.functions.schemes import SCHEMES, advance, bezier, bezier_slope, scheme_info
from fieldspark.functions.session import cut
from fieldspark.operators.bricks import deal as _deal
from fieldspark.operators.bricks import pack_bricks, with_halo
from fieldspark.operators.seeds import Box, checkpoints, seed_ftle

CHANNELS = ("u", "v", "w")


@dataclass(frozen=True)
class TraceParams:
    scheme: str = "dopri5"
    kernel: str = "linear"
    dt: float = 0.005
    tol: float = 0.01
    dt_min: float = 1e-4
    dt_max: float = 1.0
    max_age: float = 2.0
    max_len: int = 64
    pos_diff: float = 0.0  # a vertex is written if the line has moved so far,
    time_diff: float = 0.0  # or so much time has passed
    steps_per_round: int = 100_000
    limit_step: bool = False  # hold a step within the brick's safe margin
    vmax: float | None = None
    normals: bool = False
    dense: bool = False
    backward: bool = False
    min_velocity: float = 0.0
    rounds: int = 200
    lines_a_task: int = 20_000


VERTEX = "line_id long, seq int, x double, y double, z double, time double, vel_x double, vel_y double, vel_z double, nrm_x double, nrm_y double, nrm_z double"
STATE = "line_id long, x double, y double, z double, sx double, sy double, sz double, time double, dt double, nrm_x double, nrm_y double, nrm_z double, steps_total long, steps_accepted long, length int, status string"
_STATE = [c.split()[0] for c in STATE.split(", ")]
_VERTEX = [c.split()[0] for c in VERTEX.split(", ")]
STATUS = ("active", "moved", "boundary", "old", "long", "left", "slow", "left_brick", "lost")
ACTIVE = 0


class BrickField:
    """Velocity of a brick with its ghost cells, at world places; of two steps, blended by time, for path lines."""

    def __init__(self, rows: pd.DataFrame, info: VolumeInfo, kernel: str, backward: bool):
        self.info, self.k = info, KERNELS[kernel]
        self.half = np.array(info.half_size_world)
        self.cell = 2.0 * np.array(info.spacing)
        self.scale = np.array(velocity_scale(info)) * (-1.0 if backward else 1.0)
        self.steps: dict[int, tuple[np.ndarray, np.ndarray, tuple[int, int, int]]] = {}  # cells by channels, origin, size
        for r in rows.itertuples():
            cells = np.stack([np.asarray(getattr(r, c), float) for c in CHANNELS], 1)
            self.steps[int(r.t)] = (cells, np.array([r.ox, r.oy, r.oz]), (r.nx, r.ny, r.nz))

    def _at(self, t: int, g: np.ndarray, shift: np.ndarray | float, channels: list[int]) -> np.ndarray:
        a, origin, n = self.steps[t]
        q = g - 0.5 - shift
        base = np.floor(q)
        w = [self.k.weights(q[:, d] - base[:, d]) for d in range(3)]
        cells = [[np.clip(base[:, d].astype(int) + o - origin[d], 0, n[d] - 1) for o in self.k.offsets] for d in range(3)]
        part = a if len(channels) == len(CHANNELS) else np.ascontiguousarray(a[:, channels])
        out = np.zeros((len(g), len(channels)))
        for wz, iz in zip(w[2], cells[2], strict=True):
            for wy, iy in zip(w[1], cells[1], strict=True):
                row, wyz = (iz * n[1] + iy) * n[0], wy * wz
                for wx, ix in zip(w[0], cells[0], strict=True):
                    out += (wx * wyz)[:, None] * part.take(row + ix, 0)
        return out

    def _step(self, t: int, g: np.ndarray) -> np.ndarray:
        if not self.k.staggered:
            return self._at(t, g, 0.0, [0, 1, 2])
        return np.concatenate([self._at(t, g, 0.5 * np.eye(3)[d], [d]) for d in range(3)], 1)

    def __call__(self, pos: np.ndarray, time: np.ndarray) -> np.ndarray:
        g = (pos + self.half) / self.cell
        if len(self.steps) == 1:
            return self._step(next(iter(self.steps)), g) * self.scale
        low = min(self.steps)
        part = np.clip(time / self.info.dt - low, 0, 1)[:, None]
        return ((1 - part) * self._step(low, g) + part * self._step(max(self.steps), g)) * self.scale


def _normal(vel: np.ndarray) -> np.ndarray:
    """A unit vector across each velocity: crossed with the axis it has least of."""
    axis = np.eye(3)[np.abs(vel).argmin(1)]
    n = np.cross(vel, axis)
    return n / np.maximum(np.linalg.norm(n, axis=1), 1e-30)[:, None]


def _across(vel: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of each normal across its velocity, of unit length; the normal as it was where there is none."""
    n = np.cross(np.cross(vel, normal), vel)
    size = np.linalg.norm(n, axis=1)[:, None]
    return np.where(size > 1e-30, n / np.maximum(size, 1e-30), normal)


def _run(lines: pd.DataFrame, rows: pd.DataFrame, info: VolumeInfo, p: TraceParams, brick: np.ndarray, until: float, hold: bool) -> pd.DataFrame:
    """Lines of one brick, to its border; vertices and states in one table (`kind`). hold: stop there for good."""
    f = BrickField(rows, info, p.kernel, p.backward)
    half = np.array(info.half_size_world)
    size = np.array(info.brick_size_world)
    lo = -half + brick * size
    hi = np.minimum(lo + size, half)
    pos, time, dt = lines[list(AXES)].to_numpy(float), lines["time"].to_numpy(float).copy(), lines["dt"].to_numpy(float).copy()
    length, total, took = (lines[c].to_numpy().astype(np.int64).copy() for c in ("length", "steps_total", "steps_accepted"))
    nrm, ids = lines[["nrm_x", "nrm_y", "nrm_z"]].to_numpy(float), lines["line_id"].to_numpy()
    status = np.full(len(lines), ACTIVE, np.int8)
    vel = f(pos, time)
    if p.normals:
        new = ~nrm.any(1)
        nrm[new] = _normal(vel[new])
    out: list[tuple] = []

    def write(who: np.ndarray, at: np.ndarray, when: np.ndarray, v: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        if len(who):
            out.append((ids[who], length[who].copy(), at.copy(), when.copy(), (vel[who] if v is None else v).copy(), (nrm[who] if n is None else n).copy()))
            length[who] += 1

    fresh = np.flatnonzero(length == 0)
    write(fresh, pos[fresh], time[fresh])
    out_pos, out_time = pos.copy(), time.copy()
    end = np.minimum(lines["limit"].to_numpy(float), until)
    margin = max(0.1, info.overlap - 0.5 - KERNELS[p.kernel].radius) * 2.0 * min(info.spacing)
    for _ in range(p.steps_per_round):
        status[(status == ACTIVE) & (time >= end - 1e-12)] = STATUS.index("boundary" if until < 1e300 else "old")
        status[(status == ACTIVE) & (length >= p.max_len)] = STATUS.index("long")
        live = np.flatnonzero(status == ACTIVE)
        if not len(live):
            break
        h = np.minimum(dt[live], end[live] - time[live])
        if p.limit_step:
            near = np.minimum(pos[live] - lo, hi - pos[live]).min(1).clip(0)
            h = np.minimum(h, (margin + near) / (p.vmax or max(1e-9, float(np.abs(f.steps[min(f.steps)][0]).max() * np.abs(f.scale).max()))))
        s = advance(p.scheme, f, pos[live], time[live], vel[live], h, p.tol, p.dt_min, p.dt_max, p.dense)
        before = time[live].copy()
        pos[live], time[live], vel[live] = s.pos, s.time, s.vel
        dt[live] = np.where(s.accepted, np.maximum(s.dt, dt[live]) if SCHEMES[p.scheme].adaptive else dt[live], s.dt)
        total[live] += 1
        took[live] += s.accepted
        if p.normals:
            old_nrm = nrm[live]
            nrm[live] = _across(vel[live], old_nrm)
        done = live[s.accepted]
        moved = np.linalg.norm(pos[done] - out_pos[done], axis=1)
        outside = (np.abs(pos[done]) > half).any(1)
        emit = (moved >= p.pos_diff) | (time[done] - out_time[done] >= p.time_diff) | outside
        if s.coeffs is not None and p.pos_diff > 0:
            room = np.maximum(p.max_len - length[done], 1)  # the last part is the step's own end
            parts = np.minimum(np.floor(moved / p.pos_diff).clip(1), room).astype(int)
            curves, t0, span = s.coeffs[s.accepted], before[s.accepted], (time[live] - before)[s.accepted]
            side = old_nrm[s.accepted] if p.normals else nrm[done]
            for k in range(1, int(parts.max(initial=1))):
                sel = np.flatnonzero((parts > k) & emit)
                if len(sel):
                    part = k / parts[sel]
                    v = bezier_slope(curves[sel], part) / span[sel][:, None]
                    n = _across(v, side[sel]) if p.normals else nrm[done[sel]]
                    side[sel] = n
                    write(done[sel], bezier(curves[sel], part[:, None, None]), t0[sel] + part * span[sel], v, n)
        who = done[emit]
        write(who, pos[who], time[who])
        out_pos[who], out_time[who] = pos[who], time[who]
        status[done[outside]] = STATUS.index("left")
        if p.min_velocity > 0:
            status[done[(vel[done] ** 2).sum(1) < p.min_velocity**2]] = STATUS.index("slow")
        inside = ((pos[done] >= lo) & ((pos[done] < hi) | (hi >= half))).all(1)
        gone = done[~inside]
        status[gone[status[gone] == ACTIVE]] = STATUS.index("left_brick" if hold else "moved")
    v = [np.concatenate([o[k] for o in out]) if out else np.empty((0, 3) if k in (2, 4, 5) else 0) for k in range(6)]
    vertices = pd.DataFrame({"kind": 0, "line_id": v[0], "seq": v[1].astype(np.int64), "x": v[2][:, 0], "y": v[2][:, 1], "z": v[2][:, 2], "time": v[3], "vel_x": v[4][:, 0], "vel_y": v[4][:, 1], "vel_z": v[4][:, 2], "nrm_x": v[5][:, 0], "nrm_y": v[5][:, 1], "nrm_z": v[5][:, 2]})
    state = pd.DataFrame({"kind": 1, "line_id": ids, "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2], "sx": lines["sx"].to_numpy(), "sy": lines["sy"].to_numpy(), "sz": lines["sz"].to_numpy(), "time": time, "dt": dt, "nrm_x": nrm[:, 0], "nrm_y": nrm[:, 1], "nrm_z": nrm[:, 2], "steps_total": total, "steps_accepted": took, "length": length, "code": status.astype(np.int32), "limit": lines["limit"].to_numpy()})
    return pd.concat([vertices, state], ignore_index=True)


_OUT = "kind int, line_id long, seq int, x double, y double, z double, time double, vel_x double, vel_y double, vel_z double, nrm_x double, nrm_y double, nrm_z double, sx double, sy double, sz double, dt double, steps_total long, steps_accepted long, length int, code int, limit double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _bricks(voxels: DataFrame, info: VolumeInfo, p: TraceParams) -> DataFrame:
    halo = max(info.overlap, KERNELS[p.kernel].radius + 1)
    cells = with_halo(voxels.select("t", *AXES, *CHANNELS), info, halo=halo)
    return pack_bricks(cells, list(CHANNELS))


def _loop(seeds: DataFrame, bricks: DataFrame, info: VolumeInfo, p: TraceParams, path: bool, hold: bool = False, runs: list[TraceParams] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and final states. runs: parameters by the remainder of a line's id."""
    many = runs or [p]
    keys = ["bx", "by", "bz"] + (["tk"] if path else [])
    bricks = cut(bricks)
    horizon = (info.nt - 1) * info.dt if path else 1e300
    run = F.pmod("line_id", F.lit(len(many))).cast("int")
    own = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), run)
    state = cut(checkpoints(seeds, dt=p.dt).withColumn("dt", own([q.dt for q in many])).withColumn("limit", F.least(F.col("time") + own([q.max_age for q in many]), F.lit(horizon))))
    vertices, finals = [], []

    def solve(key: tuple, lines: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(lines):
            return pd.DataFrame({c: [] for c in _NAMES})
        if not len(rows):
            return lines.assign(kind=1, code=STATUS.index("lost")).reindex(columns=_NAMES)
        until = (key[3] + 1) * info.dt if path and key[3] < info.nt - 2 else 1e301
        lines, rows, brick = lines.sort_values("line_id"), rows.sort_values("t"), np.array([int(v) for v in key[:3]])
        of = lines["line_id"].to_numpy() % len(many)
        return pd.concat([_run(lines[of == k], rows, info, many[k], brick, until, hold) for k in np.unique(of).tolist()]).reindex(columns=_NAMES)

    for _ in range(p.rounds):
        inside = F.lit(True)
        for a, h in zip(AXES, info.half_size_world, strict=True):
            inside = inside & F.col(a).between(-h, h)
        state = state.withColumn("status", F.when(inside & (F.col("time") < F.col("limit")), "active").when(~inside, "left").otherwise("old"))
        finals.append(state.where("status <> 'active'").select(*_STATE))
        live = with_brick_of(state.where("status = 'active'").drop("status"), info)
        live = live.withColumns({f"b{a}": F.least(F.col(f"b{a}"), F.lit(n - 1)) for a, n in zip(AXES, info.brick_count, strict=True)})
        if path:
            live = live.withColumn("tk", F.least(F.floor(F.col("time") / info.dt + 1e-9), F.lit(max(0, info.nt - 2))).cast("int"))
        dealt = _deal(live, bricks, keys, p.lines_a_task)
        if dealt is None:
            break
        lines, near = (df.groupBy(*keys, "copy") for df in dealt)
        got = cut(lines.cogroup(near).applyInPandas(solve, _OUT))
        got = got.withColumn("status", F.get(F.array(*[F.lit(x) for x in STATUS]), F.col("code")))
        vertices.append(got.where("kind = 0").select(*_VERTEX))
        ended = got.where("kind = 1 and status not in ('active', 'moved', 'boundary')")
        finals.append(ended.select(*_STATE))
        state = got.where("kind = 1 and status in ('active', 'moved', 'boundary')").select(*_STATE, "limit")
    else:
        if not hold and state.limit(1).count():
            raise RuntimeError(f"lines are still on their way after {p.rounds} rounds; raise TraceParams.rounds")
        finals.append(state.select(*_STATE))
    union = lambda parts, like: parts[0] if len(parts) == 1 else _all(parts)
    spark = seeds.sparkSession
    return (union(vertices, None) if vertices else spark.createDataFrame([], VERTEX)), union(finals, None)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trace_stream(voxels: DataFrame, info: VolumeInfo, seeds: DataFrame, params: TraceParams | None = None, **changes) -> tuple[DataFrame, DataFrame]:
    """Vertices and final states of stream lines of one time step (the least of voxels). seeds: pid, x, y, z."""
    p = replace(params or TraceParams(), **changes)
    return _loop(seeds, _bricks(voxels, info, p), info, p, False)


def trace_runs(voxels: DataFrame, info: VolumeInfo, seeds: DataFrame, runs: list[TraceParams]) -> tuple[DataFrame, DataFrame]:
    """Vertices and final states, by run, of the same seeds under several parameters: one trace, whose volume is bricked once.

    pid, times the number of runs, must fit a long.
    """
    widest = max(runs, key=lambda p: KERNELS[p.kernel].radius)
    p = replace(widest, rounds=max(q.rounds for q in runs), lines_a_task=min(q.lines_a_task for q in runs))
    n = len(runs)
    rows = seeds.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pid", F.col("pid") * n + F.col("_run")).drop("_run")
    out = _loop(rows, _bricks(voxels, info, p), info, p, False, runs=runs)
    number, line = F.pmod("line_id", F.lit(n)), F.expr(f"(line_id - pmod(line_id, {n})) div {n}")
    return tuple(df.withColumn("run", number.cast("int")).withColumn("line_id", line) for df in out)  # type: ignore[return-value]


def trace_path(voxels: DataFrame, info: VolumeInfo, seeds: DataFrame, params: TraceParams | None = None, **changes) -> tuple[DataFrame, DataFrame]:
    """The same of path lines: velocity is blended between steps."""
    p = replace(params or TraceParams(), **changes)
    return _loop(seeds, _bricks(voxels, info, p), info, p, True)


def advect_points(points: DataFrame, voxels: DataFrame, info: VolumeInfo, age: float, **changes) -> DataFrame:
    """pid and place after `age`; points that leave stop there."""
    p = TraceParams(max_age=age, max_len=1 << 30, pos_diff=1e300, time_diff=1e300, **changes)
    return _loop(points, _bricks(voxels, info, p), info, p, False)[1].select(F.col("line_id").alias("pid"), *AXES, "time", "status")


def step_particles(particles: DataFrame, voxels: DataFrame, info: VolumeInfo, dt: float, ticks: int = 1, min_velocity: float = 0.0, scheme: str = "rk4", kernel: str = "linear") -> DataFrame:
    """Particles (pid, x, y, z) after some ticks of dt; those that left or are too slow are gone."""
    p = TraceParams(scheme=scheme, kernel=kernel, dt=dt, max_age=dt * ticks, max_len=1 << 30, pos_diff=1e300, time_diff=1e300, min_velocity=min_velocity)
    ends = _loop(particles, _bricks(voxels, info, p), info, p, False)[1]
    return ends.where("status = 'old'").select(F.col("line_id").alias("pid"), *AXES, "time")


def ftle(voxels: DataFrame, info: VolumeInfo, res: int, box: Box, slice_at: float, sep: tuple[float, float, float], age: float, backward: bool = False, scale: float = 1.0, **changes) -> DataFrame:
    """gx, gy, ftle: the finite-time Lyapunov exponent on a slice.

    A seed's number tells its place in the grid, so its end needs no join with the seeds (which Spark takes for few, as it doesn't
    count what an explode adds, and would broadcast).
    """
    seeds = seed_ftle(voxels.sparkSession, res, box, slice_at, sep)
    ends = advect_points(seeds, voxels, info, age, backward=backward, **changes)
    place = {"gx": f"int(pid div {6 * res})", "gy": f"int(pid div 6 % {res})", "k": "int(pid % 6)"}
    rows = ends.withColumns({c: F.expr(e) for c, e in place.items()})
    at = [F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{k}_{a}") for k in range(6) for a in AXES]
    wide = rows.groupBy("gx", "gy").agg(F.max("time").alias("time"), *at)
    d = tuple(tuple((F.col(f"{2 * c + 1}_{a}") - F.col(f"{2 * c}_{a}")) / (2.0 * sep[c]) for c in range(3)) for a in AXES)
    wide = wide.withColumns({f"d{r}{c}": d[r][c] for r in range(3) for c in range(3)})
    d = T.m3("d")
    wide = T.with_eigenvalues(wide, T.product(T.transpose(d), d), ("e1", "e2", "e3"))
    value = F.when(F.col("time") > 0, F.log(F.sqrt(F.greatest(F.col("e1"), F.lit(1e-30)))) / F.col("time") * scale).otherwise(0.0)
    return wide.select("gx", "gy", value.alias("ftle"))


def enrich_vertices(vertices: DataFrame, voxels: DataFrame, info: VolumeInfo, kernel: str = "catrom") -> DataFrame:
    """Vertices with sampled velocity, temperature, their Jacobian and temperature gradient; they meet the bricks once, as they are."""
    from fieldspark.functions.info import world_to_grid
    from fieldspark.operators.sampling import sample_at

    points = world_to_grid(vertices.withColumn("t", F.lit(0)) if "t" not in vertices.columns else vertices.withColumn("_t", F.col("t")).withColumn("t", F.lit(0)), info)
    keep = ["_t" if c == "t" else c for c in vertices.columns]
    got = sample_at(points, voxels, info, kernel, ("u", "v", "w", "temp"), derivatives=True, keep=keep)
    names = {f"d{c}_d{a}": f"j{r}{k}" for r, c in enumerate(CHANNELS) for k, a in enumerate(AXES)} | {f"dtemp_d{a}": f"grad_temp_{a}" for a in AXES}
    return got.withColumnsRenamed(names | {"_t": "t"})


def thin_vertices(vertices: DataFrame, pos_diff: float, time_diff: float) -> DataFrame:
    """Vertices that lie far enough, in place or time, from the last one kept; first and last vertices stay."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, last, held = None, None, None  # the line at hand, its last vertex kept, its latest vertex if not kept
        for pdf in parts:
            keep: list[int] = []
            ends: list[pd.DataFrame] = []
            ids, at, when = pdf["line_id"].tolist(), pdf[list(AXES)].to_numpy(float), pdf["time"].tolist()
            for k in range(len(pdf)):
                if ids[k] != line:
                    if held is not None:
                        ends.append(held) if isinstance(held, pd.DataFrame) else keep.append(held)
                    line, last, held = ids[k], None, None
                if last is None or ((at[k] - last[0]) ** 2).sum() >= pos_diff**2 or when[k] - last[1] >= time_diff:
                    keep.append(k)
                    last, held = (at[k], when[k]), None
                else:
                    held = k
            yield pd.concat([*ends, pdf.iloc[sorted(keep)]]) if ends else pdf.iloc[sorted(keep)]
            if held is not None and not isinstance(held, pd.DataFrame):
                held = pdf.iloc[[held]]
        if isinstance(held, pd.DataFrame):
            yield held

    return vertices.repartition("line_id").sortWithinPartitions("line_id", "seq").mapInPandas(run, vertices.schema)


def euler_step(points: DataFrame, voxels: DataFrame, info: VolumeInfo, dt: float) -> DataFrame:
    """One Euler step in grid coordinates as a join and column arithmetic: pid, t, gx, gy, gz."""
    from fieldspark.operators.sampling import sample

    v = sample(points, voxels, info, "linear").withColumnsRenamed({"u": "_u", "v": "_v", "w": "_w"})
    return points.join(v, "pid").select("pid", "t", *[(F.col(f"g{a}") + dt * F.col(c) / h).alias(f"g{a}") for a, c, h in zip(AXES, ("_u", "_v", "_w"), info.spacing, strict=True)])


def trace_stats(states: DataFrame, scheme: str) -> DataFrame:
    """Lines, steps, evaluations and why lines ended, in one row."""
    i = scheme_info(scheme)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    total, took = F.sum("steps_total"), F.sum("steps_accepted")
    return states.agg(F.count("*").alias("lines"), total.alias("steps_total"), took.alias("steps_accepted"), (took * i["evaluations_accepted"] + (total - took) * i["evaluations_rejected"]).alias("evaluations"), n("old"), n("left"), n("long"), (F.count("*") - F.count_if(F.col("status").isin("old", "left", "long"))).alias("other"))


def trace_progress(states: DataFrame, max_len: int, max_age: float) -> DataFrame:
    """Mean share done: of a line, the larger of its length's and its age's."""
    return states.agg(F.avg(F.least(F.lit(1.0), F.greatest(F.col("length") / max_len, F.col("time") / max_age))).alias("progress"))


def flow_graph(voxels: DataFrame, info: VolumeInfo, seeds: DataFrame, dt: float, steps: int, scheme: str = "rk4") -> DataFrame:
    """bx, by, bz, dir, freq: the share of a brick's particles that leave through each side. seeds: x, y, z in [0, 1), the same
    for each brick; those beyond a cut brick's border don't count, a particle may leave through several sides."""
    from fieldspark.functions.info import with_brick_box
    from fieldspark.operators.select import cross_bricks

    spark = voxels.sparkSession
    cx, cy, cz = info.brick_count
    lattice = spark.range(cx * cy * cz).select(F.expr(f"int(id % {cx})").alias("bx"), F.expr(f"int((id div {cx}) % {cy})").alias("by"), F.expr(f"int(id div {cx * cy})").alias("bz"), F.col("id").alias("brick"))
    n = seeds.count()
    rows = cross_bricks(seeds.select(F.col("pid").alias("slot"), *AXES), with_brick_box(lattice, info)).withColumn("pid", F.col("brick") * n + F.col("slot"))
    for a, size in zip(AXES, info.brick_size_world, strict=True):
        rows = rows.withColumn(a, F.col(f"lo_{a}") + F.col(a) * size).where(F.col(a) <= F.col(f"hi_{a}"))
    rows = cut(rows)
    p = TraceParams(scheme=scheme, dt=dt, max_age=dt * steps, max_len=1 << 30, pos_diff=1e300, time_diff=1e300, rounds=1)
    ends = _loop(rows.select("pid", *AXES), _bricks(voxels, info, p), info, p, False, hold=True)[1]
    ends = ends.select(F.col("line_id").alias("pid"), *[F.col(a).alias(f"e{a}") for a in AXES])
    rows = rows.join(ends, "pid")
    sides = [F.avg((F.col(f"e{a}") < F.col(f"lo_{a}")).cast("double")) for a in AXES] + [F.avg((F.col(f"e{a}") > F.col(f"hi_{a}")).cast("double")) for a in AXES]
    wide = rows.groupBy("bx", "by", "bz").agg(*[s.alias(f"d{k}") for k, s in enumerate(sides)])
    return wide.select("bx", "by", "bz", F.posexplode(F.array(*[f"d{k}" for k in range(6)])).alias("dir", "freq"))
