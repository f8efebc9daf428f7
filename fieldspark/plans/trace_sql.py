"""Traces in SQL for another engine: a recursive query whose rows are the lines, a step each, with the volume as lists of cells.

Places are in grid units (world = 2 g - 8), where velocity needs no scale. A stage of a scheme is a handful of projections
over the row, so that a step is plain arithmetic and the recursion has no join.
"""

from __future__ import annotations

from fieldspark.functions.kernels import KERNELS
from fieldspark.functions.schemes import SCHEMES
from fieldspark.plans.catalog import G, P, _weights_sql

AXES, CH = "xyz", "uvw"
WORLD = ", ".join(f"2*g{a}-8 {a}" for a in AXES)
FIELD = f"""{G}, fld AS MATERIALIZED (SELECT {", ".join(f"list({c} ORDER BY t,z,y,x) f{c}" for c in CH)} FROM g)"""
SEEDS = f"{P}, seed AS (SELECT CAST(pid AS BIGINT) id, px gx, py gy, pz gz FROM p)"


def velocity(src: str, at: dict[str, str], j: int, kernel: str, when: str | None = None) -> str:
    """src with the velocity at a place in columns k<j>u, k<j>v, k<j>w; when: the time by which the two steps are blended."""
    offsets = KERNELS[kernel].offsets
    q = f"SELECT *, {', '.join(f'{at[a]}-0.5 q{a}{j}' for a in AXES)} FROM ({src})"
    b = f"SELECT *, {', '.join(f'floor(q{a}{j}) b{a}{j}' for a in AXES)} FROM ({q})"
    taps = [f"CAST(least(7,greatest(0,b{a}{j}+({o}))) AS BIGINT)*{8**n} c{a}{j}_{i}" for n, a in enumerate(AXES) for i, o in enumerate(offsets)]
    taps += [f"{w} w{a}{j}_{i}" for a in AXES for i, w in enumerate(_weights_sql(kernel, f"(q{a}{j}-b{a}{j})"))]
    c = f"SELECT *, {', '.join(taps)} FROM ({b})"
    n = range(len(offsets))
    cells = [(x, y, z) for z in n for y in n for x in n]
    pairs = [f"wx{j}_{x}*wy{j}_{y}*wz{j}_{z} w{j}_{m}, 1+cx{j}_{x}+cy{j}_{y}+cz{j}_{z} i{j}_{m}" for m, (x, y, z) in enumerate(cells)]
    d = f"SELECT *, {', '.join(pairs)} FROM ({c})"
    total = lambda f, plus="": "(" + "+".join(f"w{j}_{m}*f{f}[i{j}_{m}{plus}]" for m in range(len(cells))) + ")"
    if when is None:
        sums = [f"{total(f)} k{j}{f}" for f in CH]
    else:
        part = f"least(1.0,greatest(0.0,{when}))"
        sums = [f"(1-{part})*{total(f)}+{part}*{total(f, '+512')} k{j}{f}" for f in CH]
    return f"SELECT *, {', '.join(sums)} FROM ({d})"


def trace(scheme: str, dt: float, age: float, *, kernel: str = "linear", tol: float = 0.01, dt_min: float = 1e-4, dt_max: float = 1.0, path: bool = False, most: int | None = 64, slow: float = 0.0, hold: bool = False, limit_step: bool = False, name: str = "tr") -> str:
    """CTE <name>: id, n, gx, gy, gz, time, dt, total, took, len, status of each line (of CTE seed) after each step; its last row alone isn't active."""
    s = SCHEMES[scheme]
    src = f"SELECT * FROM {name}, fld WHERE status='active'"
    end = min(age, 1.0) if path else age
    h = f"least(dt,{end!r}-time)"
    if limit_step:  # the safe margin of a brick of 4 cells with 2 ghost cells, by the brick's greatest velocity
        near = "greatest(0.0,least(" + ",".join(f"g{a}-4*e{a},4*e{a}+4-g{a}" for a in AXES) + "))"
        src = f"SELECT {name}.*, fld.*, vmax FROM {name}, fld, vm WHERE status='active' AND " + " AND ".join(f"vm.e{a}={name}.e{a}" for a in AXES)
        h = f"least({h},(1.0+2*{near})/greatest(1e-9,2*vmax))"
    src = f"SELECT *, {h} h FROM ({src})"
    for j, row in enumerate(((), *s.a)):
        at = {a: "+".join([f"g{a}", *[f"h*({w!r})*k{m}{f}" for m, w in enumerate(row) if w]]) for a, f in zip(AXES, CH, strict=True)}
        src = velocity(src, at, j, kernel, f"time+({s.c[j]!r})*h" if path else None)
    total = lambda weights, f: "+".join(f"({w!r})*k{m}{f}" for m, w in enumerate(weights) if w)
    new = ", ".join(f"g{a}+h*({total(s.b, f)}) n{a}" for a, f in zip(AXES, CH, strict=True))
    err = "+".join(f"4*pow({total(s.e, f)},2)" for f in CH) if s.adaptive else "0.0"
    src = f"SELECT *, {new}, {err} err2 FROM ({src})"
    ok = f"(err2<{tol * tol!r} OR h<={dt_min!r})" if s.adaptive else "true"
    src = f"SELECT *, {ok} ok, least({dt_max!r},greatest({dt_min!r},h*CASE WHEN err2=0 THEN 4.0 ELSE least(4.0,greatest(0.125,0.8*pow({tol * tol!r}/err2,{0.5 / s.order!r}))) END)) nd FROM ({src})"
    step = "CASE WHEN ok THEN greatest(nd,dt) ELSE nd END" if s.adaptive else "dt"
    moved = ", ".join(f"CASE WHEN ok THEN n{a} ELSE g{a} END g{a}" for a in AXES)
    src = f"SELECT id, n+1 n, {moved}, CASE WHEN ok THEN time+h ELSE time END AS time, {step} dt, total+1 total, took+CASE WHEN ok THEN 1 ELSE 0 END took, len+CASE WHEN ok THEN 1 ELSE 0 END len, ex, ey, ez, ok FROM ({src})"
    cases = "WHEN ok AND (" + " OR ".join(f"abs(2*g{a}-8)>8" for a in AXES) + ") THEN 'left' "
    if hold:
        cases += "WHEN ok AND NOT (" + " AND ".join(f"g{a}>=4*e{a} AND (g{a}<4*e{a}+4 OR e{a}=1)" for a in AXES) + ") THEN 'left_brick' "
    if slow:  # the velocity at the new place
        src = velocity(f"SELECT * FROM ({src}), fld", {a: f"g{a}" for a in AXES}, 9, kernel)
        cases += f"WHEN ok AND 4*(k9u*k9u+k9v*k9v+k9w*k9w)<{slow * slow!r} THEN 'slow' "
    cases += f"WHEN time>={end!r}-1e-12 THEN 'old' " + (f"WHEN len>={most} THEN 'long' " if most else "")
    brick = ", ".join(f"e{a}" if hold else f"CAST(least(1,greatest(0,floor(g{a}/4))) AS INT) e{a}" for a in AXES)
    src = f"SELECT id, n, gx, gy, gz, time, dt, total, took, len, CASE {cases}ELSE 'active' END status, {brick} FROM ({src})"
    first = ", ".join(f"CAST(least(1,floor(g{a}/4)) AS INT)" + f" e{a}" for a in AXES)
    return f"{name} AS (SELECT id, 0 n, CAST(gx AS DOUBLE) gx, CAST(gy AS DOUBLE) gy, CAST(gz AS DOUBLE) gz, CAST(0.0 AS DOUBLE) AS time, CAST({dt!r} AS DOUBLE) dt, CAST(0 AS BIGINT) total, CAST(0 AS BIGINT) took, 1 len, 'active' status, {first} FROM seed UNION ALL {src})"


#: Greatest velocity of each brick with its ghost cells.
VMAX = "vm AS MATERIALIZED (SELECT ex,ey,ez,max(greatest(abs(u),abs(v),abs(w))) vmax FROM g, (SELECT CAST(i%2 AS INT) ex, CAST((i//2)%2 AS INT) ey, CAST(i//4 AS INT) ez FROM range(8) r(i)) WHERE t=0 AND x BETWEEN 4*ex-2 AND 4*ex+5 AND y BETWEEN 4*ey-2 AND 4*ey+5 AND z BETWEEN 4*ez-2 AND 4*ez+5 GROUP BY 1,2,3)"


def ctes(*parts: str, seeds: str = SEEDS) -> str:
    return "WITH RECURSIVE " + ", ".join([FIELD, seeds, *parts])
