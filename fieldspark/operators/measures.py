"""Flow measures on the Jacobian (j00..j22), velocity (u, v, w), temperature (temp) and its gradient (grad_temp_x, y, z).

The registry maps a name to its column, what it needs, and default scale and quantisation step; users add their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import tensor as T
from fieldspark.operators.stencil import gradient, jacobian

RA, PR = 7e5, 0.7


def velocity() -> T.V3:
    return F.col("u"), F.col("v"), F.col("w")


def vorticity(j: T.M3 | None = None) -> T.V3:
    j = j or T.m3()
    return j[2][1] - j[1][2], j[0][2] - j[2][0], j[1][0] - j[0][1]


def _squares() -> tuple[T.M3, T.M3]:
    j = T.m3()
    s, o = T.strain(j), T.spin(j)
    return T.product(s, s), T.product(o, o)


def lambda2() -> Column:
    """Middle eigenvalue of S*S + O*O."""
    s2, o2 = _squares()
    return T.eigenvalues_sym(T.add(s2, o2))[1]


def _staged_lambda2(df: DataFrame) -> tuple[DataFrame, Column]:
    s2, o2 = _squares()
    m = T.add(s2, o2)
    df = df.withColumns({f"_m{r}{c}": m[r][c] for r in range(3) for c in range(r, 3)})
    return T.with_eigenvalues(df, _upper("_m"), ("_e1", "_e2", "_e3")), F.col("_e2")


def _upper(prefix: str) -> T.M3:
    """A symmetric matrix whose upper triangle is in columns."""
    return tuple(tuple(F.col(f"{prefix}{min(r, c)}{max(r, c)}") for c in range(3)) for r in range(3))  # type: ignore[return-value]


def q_hunt() -> Column:
    j = T.m3()
    return 0.5 * (T.frobenius_sq(T.spin(j)) - T.frobenius_sq(T.strain(j)))


def delta_chong() -> Column:
    s2, o2 = _squares()
    q, r = -0.5 * (T.trace(s2) + T.trace(o2)), T.det(T.m3())
    return (q / 3.0) * (q / 3.0) * (q / 3.0) + (r / 2.0) * (r / 2.0)


def enstrophy_production() -> Column:
    w = vorticity()
    return T.dot(w, T.apply(T.strain(T.m3()), w))


def strain_production() -> Column:
    s = T.strain(T.m3())
    return T.trace(T.product(T.product(s, s), s))


def square_rotation() -> Column:
    o = T.spin(T.m3())
    return -0.5 * T.trace(T.product(o, o))


def square_rate_of_strain() -> Column:
    s = T.strain(T.m3())
    return T.trace(T.product(s, s))


def pva(on: str = "jacobian") -> Column:
    """|e2 . vorticity|, e2 of the middle eigenvalue; on the Jacobian's upper triangle, or on the strain tensor. 0 where no
    such vector is defined."""
    m = T.m3() if on == "jacobian" else T.strain(T.m3())
    return F.coalesce(F.abs(T.dot(T.eigenvector_sym(m, T.eigenvalues_sym(m)[1]), vorticity())), F.lit(0.0))


def _staged_pva(df: DataFrame, on: str = "jacobian") -> tuple[DataFrame, Column]:
    j = T.m3()
    m = j if on == "jacobian" else T.strain(j)
    df = df.withColumns({f"_m{r}{c}": m[r][c] for r in range(3) for c in range(r, 3)})
    df = T.with_eigenvalues(df, _upper("_m"), ("_e1", "_e2", "_e3"))
    rows = [[F.col(f"_m{min(r, c)}{max(r, c)}") - (F.col("_e2") if r == c else 0.0) for c in range(3)] for r in range(3)]
    tries = [T.cross(rows[i], rows[k]) for i, k in ((0, 1), (0, 2), (1, 2))]
    df = df.withColumns({f"_t{k}{i}": t[i] for k, t in enumerate(tries) for i in range(3)})
    long = [tuple(F.col(f"_t{k}{i}") for i in range(3)) for k in range(3)]
    df = df.withColumns({f"_n{k}": T.dot(t, t) for k, t in enumerate(long)})
    best, w = F.greatest("_n0", "_n1", "_n2"), vorticity()
    with_w = [T.dot(t, w) for t in long]
    picked = F.when(F.col("_n0") >= best, with_w[0]).when(F.col("_n1") >= best, with_w[1]).otherwise(with_w[2])
    return df, F.coalesce(F.abs(F.try_divide(picked, F.sqrt(best))), F.lit(0.0))


def heat_current(ra: float = RA, pr: float = PR) -> T.V3:
    k = 1.0 / (ra * pr) ** 0.5
    return tuple(c * F.col("temp") - k * F.col(f"grad_temp_{a}") for c, a in zip(velocity(), "xyz", strict=True))  # type: ignore[return-value]


def heat_current_alignment(ra: float = RA, pr: float = PR) -> Column:
    """Cosine between heat current and velocity; 0 where one vanishes."""
    j, v = heat_current(ra, pr), velocity()
    return F.coalesce(F.try_divide(T.dot(j, v), T.length(j) * T.length(v)), F.lit(0.0))


@dataclass(frozen=True)
class Measure:
    column: Callable[..., Column]
    source: str  # raw, jacobian, heat or vertex
    scale: float = 1.0
    step: float = 0.01
    staged: Callable[..., tuple[DataFrame, Column]] | None = None  # the same by helper columns, for formulas that use parts often


REGISTRY: dict[str, Measure] = {}


def register_measure(name: str, column: Callable[..., Column], source: str = "raw", scale: float = 1.0, step: float = 0.01, staged: Callable[..., tuple[DataFrame, Column]] | None = None) -> None:
    if source not in ("raw", "jacobian", "heat", "vertex"):
        raise ValueError(source)
    REGISTRY[name] = Measure(column, source, scale, step, staged)


register_measure("velocity", lambda: T.length(velocity()))
register_measure("velocity_z", lambda: F.col("w"))
register_measure("temperature", lambda: F.col("temp"))
register_measure("vorticity", lambda: T.length(vorticity()), "jacobian")
register_measure("lambda2", lambda2, "jacobian", scale=-0.001, staged=_staged_lambda2)
register_measure("q_hunt", q_hunt, "jacobian")
register_measure("delta_chong", delta_chong, "jacobian")
register_measure("enstrophy_production", enstrophy_production, "jacobian")
register_measure("strain_production", strain_production, "jacobian")
register_measure("square_rotation", square_rotation, "jacobian")
register_measure("square_rate_of_strain", square_rate_of_strain, "jacobian")
register_measure("trace_jjt", lambda: T.frobenius_sq(T.m3()), "jacobian")
register_measure("pva", pva, "jacobian", staged=_staged_pva)
register_measure("heat_current", lambda ra=RA, pr=PR: T.length(heat_current(ra, pr)), "heat")
for _k, _a in enumerate("xyz"):
    register_measure(f"heat_current_{_a}", lambda ra=RA, pr=PR, k=_k: heat_current(ra, pr)[k], "heat")
register_measure("heat_current_alignment", heat_current_alignment, "heat")
register_measure("current_cell", lambda: F.col("current_cell").cast("double"), "vertex")
register_measure("longest_cell", lambda: F.col("longest_cell").cast("double"), "vertex")
register_measure("time_in_current_cell", lambda: F.col("time_in_cell"), "vertex")


def prepare(df: DataFrame, names: list[str], h: tuple[float, float, float] = (1.0, 1.0, 1.0), boundary: str = "clamp") -> DataFrame:
    """Adds the derivatives that the named measures need and df lacks."""
    sources = {REGISTRY[n].source for n in names}
    if "jacobian" in sources and "j00" not in df.columns:
        df = jacobian(df, h=h, boundary=boundary)
    if "heat" in sources and "grad_temp_x" not in df.columns:
        df = gradient(df, "temp", h, boundary)
    return df


def with_measure(df: DataFrame, name: str, scale: float = 1.0, out: str | None = None, **parameters) -> DataFrame:
    """Adds a measure of voxels or vertices that hold what it needs. Cell measures are 0 on voxels."""
    m = REGISTRY[name]
    if m.source == "vertex" and not {"current_cell", "longest_cell", "time_in_cell"} & set(df.columns):
        return df.withColumn(out or name, F.lit(0.0))
    if m.staged is None:
        return df.withColumn(out or name, m.column(**parameters) * scale)
    kept = [c for c in df.columns if c != (out or name)]
    df, value = m.staged(df, **parameters)
    return df.select(*kept, (value * scale).alias(out or name))


def with_eigensystem(df: DataFrame, prefix: str = "j") -> DataFrame:
    """Adds e1 >= e2 >= e3 of the symmetric matrix in <prefix>00.. (its upper triangle), and unit vectors e1x..e3z."""
    m = T.m3(prefix)
    df = T.with_eigenvalues(df, m, ("e1", "e2", "e3"))
    a, b = (T.eigenvector_sym(m, F.col(f"e{k}")) for k in (1, 2))
    df = df.withColumns({f"e{k}{c}": v[i] for k, v in ((1, a), (2, b)) for i, c in enumerate("xyz")})
    c = T.cross(T.v3("e1"), T.v3("e2"))
    return df.withColumns({f"e3{x}": c[i] for i, x in enumerate("xyz")})
