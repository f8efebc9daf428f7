"""Weights of the one-dimensional interpolation kernels, for numpy arrays and for columns alike.

Grid points sit at integers; t is the fraction beyond the grid point at `floor`; a kernel names its offsets and weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

Number = Any  # a numpy array or a Column


def _linear(t: Number) -> list[Number]:
    return [1.0 - t, t * 1.0]


def _bspline(t: Number) -> list[Number]:
    s = 1.0 - t
    return [s * s * s / 6.0, (4.0 - 6.0 * t * t + 3.0 * t * t * t) / 6.0, (4.0 - 6.0 * s * s + 3.0 * s * s * s) / 6.0, t * t * t / 6.0]


def _bspline_d(t: Number) -> list[Number]:
    s = 1.0 - t
    return [-0.5 * s * s, 1.5 * t * t - 2.0 * t, -1.5 * s * s + 2.0 * s, 0.5 * t * t]


def _catrom(t: Number) -> list[Number]:
    t2, t3 = t * t, t * t * t
    return [0.5 * (2.0 * t2 - t3 - t), 0.5 * (3.0 * t3 - 5.0 * t2 + 2.0), 0.5 * (4.0 * t2 - 3.0 * t3 + t), 0.5 * (t3 - t2)]


def _catrom_d(t: Number) -> list[Number]:
    t2 = t * t
    return [0.5 * (4.0 * t - 3.0 * t2 - 1.0), 0.5 * (9.0 * t2 - 10.0 * t), 0.5 * (8.0 * t - 9.0 * t2 + 1.0), 0.5 * (3.0 * t2 - 2.0 * t)]


def _lagrange(n: int) -> Callable[[Number], list[Number]]:
    """Polynomials of degree n - 1 through n points, those of the middle interval between points 0 and 1."""
    places = range(1 - n // 2, n // 2 + 1)

    def weights(t: Number) -> list[Number]:
        out = []
        for i in places:
            w: Number = 1.0
            for k in places:
                if k != i:
                    w = w * ((t - float(k)) / float(i - k))
            out.append(w)
        return out

    return weights


@dataclass(frozen=True)
class Kernel:
    offsets: tuple[int, ...]
    weights: Callable[[Number], list[Number]]
    derivative: Callable[[Number], list[Number]] | None = None
    radius: int = 1  # cells needed around a point, for the halo
    staggered: bool = False


_four = (-1, 0, 1, 2)
KERNELS: dict[str, Kernel] = {
    "linear": Kernel((0, 1), _linear, None, 1),
    "bspline": Kernel(_four, _bspline, _bspline_d, 1),
    "catrom": Kernel(_four, _catrom, _catrom_d, 1),
    "catrom_staggered": Kernel(_four, _catrom, _catrom_d, 2, True),
    "lagrange4": Kernel(_four, _lagrange(4), None, 1),
    "lagrange6": Kernel(tuple(range(-2, 4)), _lagrange(6), None, 2),
    "lagrange8": Kernel(tuple(range(-3, 5)), _lagrange(8), None, 3),
    "lagrange16": Kernel(tuple(range(-7, 9)), _lagrange(16), None, 7),
}


def kernel_radius(name: str) -> int:
    """Cell radius of a kernel; 0 for the nearest grid point."""
    return 0 if name == "nearest" else KERNELS[name].radius
