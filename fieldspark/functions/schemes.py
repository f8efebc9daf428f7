"""Explicit integration schemes as tableaus, advanced in numpy for many particles at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Velocity = Callable[[np.ndarray, np.ndarray], np.ndarray]  # positions, times -> velocities


@dataclass(frozen=True)
class Scheme:
    a: tuple[tuple[float, ...], ...]  # stages after the first
    b: tuple[float, ...]  # advances
    e: tuple[float, ...] = ()  # error weights, adaptive schemes alone
    order: int = 1  # the step control's
    fsal: bool = False
    dense: tuple[float, ...] = field(default=())  # inner weights of dense output

    @property
    def adaptive(self) -> bool:
        return bool(self.e)

    @property
    def c(self) -> tuple[float, ...]:
        return (0.0, *(sum(r) for r in self.a))


_F45 = ((0.25,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8.0, 3680 / 513, -845 / 4104), (-8 / 27, 2.0, -3544 / 2565, 1859 / 4104, -11 / 40))
_F45_E = (1 / 360, 0.0, -128 / 4275, -2197 / 75240, 0.02, 2 / 55)
_DP = (35 / 384, 0.0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84)

#: The published tableaus.
SCHEMES: dict[str, Scheme] = {
    "euler": Scheme((), (1.0,), order=1),
    "heun": Scheme(((1.0,),), (0.5, 0.5), order=2),
    "rk3": Scheme(((0.5,), (-1.0, 2.0)), (1 / 6, 4 / 6, 1 / 6), order=3),
    "rk4": Scheme(((0.5,), (0.0, 0.5), (0.0, 0.0, 1.0)), (1 / 6, 2 / 6, 2 / 6, 1 / 6), order=4),
    "bs32": Scheme(((0.5,), (0.0, 0.75), (2 / 9, 1 / 3, 4 / 9)), (2 / 9, 1 / 3, 4 / 9, 0.0), (-5 / 72, 1 / 12, 1 / 9, -1 / 8), 3, True),
    "rkf34": Scheme(
        ((2 / 7,), (77 / 900, 343 / 900), (805 / 1444, -77175 / 54872, 97125 / 54872), (79 / 490, 0.0, 2175 / 3626, 2166 / 9065)),
        (229 / 1470, 0.0, 1125 / 1813, 13718 / 81585, 1 / 18),
        (-888 / 163170, 0.0, 3375 / 163170, -11552 / 163170, 9065 / 163170),
        3,
    ),
    "rkf45": Scheme(_F45, (25 / 216, 0.0, 1408 / 2565, 2197 / 4104, -0.2, 0.0), _F45_E, 4),
    "rkf54": Scheme(_F45, (16 / 135, 0.0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55), _F45_E, 5),
    "dopri5": Scheme(
        ((0.2,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729), (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656), _DP),
        (*_DP, 0.0),
        (71 / 57600, 0.0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40),
        5,
        True,
        (-12715105075 / 11282082432 + 1.0, 0.0, 87487479700 / 32700410799, -10690763975 / 1880347072, 701980252875 / 199316789632, -1453857185 / 822651844, 69997945 / 29380423 - 1.0),
    ),
}


def scheme_info(name: str) -> dict[str, int | bool]:
    """Adaptive? Dense output? Velocity evaluations per accepted and per rejected step."""
    s = SCHEMES[name]
    own = len(s.a)  # the first stage is at hand
    return {"adaptive": s.adaptive, "dense": bool(s.dense), "evaluations_accepted": own + (0 if s.fsal else 1), "evaluations_rejected": own if s.adaptive else 0}


SAFETY, SHRINK, GROW = 0.8, 0.125, 4.0


@dataclass
class Step:
    pos: np.ndarray
    time: np.ndarray
    vel: np.ndarray
    dt: np.ndarray  # of the next step
    accepted: np.ndarray
    coeffs: np.ndarray | None  # 5 control points of each particle, dense output alone


def advance(name: str, f: Velocity, pos: np.ndarray, time: np.ndarray, vel: np.ndarray, dt: np.ndarray, tol: float, dt_min: float, dt_max: float, dense: bool = False) -> Step:
    """One step of each particle; adaptive schemes may refuse it and change dt."""
    s = SCHEMES[name]
    h = dt[:, None]
    k = [vel]
    for row, c in zip(s.a, s.c[1:], strict=True):
        k.append(f(pos + h * sum(w * q for w, q in zip(row, k, strict=False) if w), time + c * dt))
    move = h * sum(w * q for w, q in zip(s.b, k, strict=True) if w)
    new = pos + move
    if not s.adaptive:
        return Step(new, time + dt, f(new, time + dt), dt, np.ones(len(dt), bool), None)
    error = sum(w * q for w, q in zip(s.e, k, strict=True) if w)
    err2 = (error * error).sum(1)
    ok = (err2 < tol * tol) | (dt <= dt_min)
    with np.errstate(divide="ignore"):
        scale = np.clip(SAFETY * (tol * tol / err2) ** (0.5 / s.order), SHRINK, GROW)
    coeffs = None
    if dense and s.dense:
        mid = pos + 0.5 * move + h * sum(w * q for w, q in zip(s.dense, k, strict=True) if w) / 6.0
        coeffs = np.stack([pos, pos + h * k[0] / 4.0, mid, new - h * k[-1] / 4.0, new], 1)
    out = np.where(ok[:, None], new, pos)
    after = np.where(ok[:, None], k[-1] if s.fsal else f(out, time + dt), vel)
    return Step(out, np.where(ok, time + dt, time), after, np.clip(dt * scale, dt_min, dt_max), ok, coeffs)


def bezier(coeffs: np.ndarray, s: float | np.ndarray) -> np.ndarray:
    """A point of each curve of five control points (n, 5, 3), by repeated linear interpolation."""
    while coeffs.shape[1] > 1:
        coeffs = (1 - s) * coeffs[:, :-1] + s * coeffs[:, 1:]
    return coeffs[:, 0]


def bezier_slope(coeffs: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The derivative of each curve at its own s: a curve of one degree less, over the differences of the control points."""
    return (coeffs.shape[1] - 1) * bezier(np.diff(coeffs, axis=1), s[:, None, None])
