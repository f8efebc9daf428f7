"""Description of a gridded volume, and column functions on its indices, coordinates and times."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class VolumeInfo:
    """Sizes, spacings, boundary and bricking of a volume. A brick of `brick` cells has `overlap` ghost cells on each side."""

    nx: int
    ny: int
    nz: int
    nt: int = 1
    hx: float = 1.0
    hy: float = 1.0
    hz: float = 1.0
    dt: float = 1.0
    periodic: bool = False
    brick: int = 4
    overlap: int = 1

    @property
    def size(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def spacing(self) -> tuple[float, float, float]:
        return self.hx, self.hy, self.hz

    @property
    def core(self) -> int:
        """Cells of a brick without its ghost cells."""
        return self.brick - 2 * self.overlap

    @property
    def brick_count(self) -> tuple[int, int, int]:
        return tuple(-(-n // self.core) for n in self.size)  # type: ignore[return-value]

    @property
    def half_size_world(self) -> tuple[float, float, float]:
        """The volume spans plus and minus this much."""
        return tuple(n * h for n, h in zip(self.size, self.spacing, strict=True))  # type: ignore[return-value]

    @property
    def brick_size_world(self) -> tuple[float, float, float]:
        return tuple(2.0 * self.core * h for h in self.spacing)  # type: ignore[return-value]

    @property
    def overlap_world(self) -> tuple[float, float, float]:
        return tuple(s * self.overlap / self.core for s in self.brick_size_world)  # type: ignore[return-value]

    def check(self) -> VolumeInfo:
        if self.brick & (self.brick - 1) or self.brick <= 0:
            raise ValueError(f"brick size {self.brick} is not a power of two")
        if self.core <= 0:
            raise ValueError("the overlap leaves no core cells")
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row, as it is stored beside a volume."""
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in self.__dict__.items()])


def resolve_spacing(size: tuple[int, int, int], spacing=None, domain: tuple[float, float, float] | None = None, aspect: tuple[float, float, float] | None = None) -> tuple[float, float, float]:
    """Grid spacing from a number, three numbers, a domain's size, or an aspect ratio; else 2 / the largest size. More than one is an error.

    aspect: of the volume along z, y, x, from its first cells to its last; the largest side then measures 1 from border to border.
    """
    if sum(v is not None for v in (spacing, domain, aspect)) > 1:
        raise ValueError("give one of spacing, domain and aspect")
    if spacing is not None:
        return (float(spacing),) * 3 if isinstance(spacing, int | float) else tuple(map(float, spacing))
    if domain is not None:
        return tuple(d / n for d, n in zip(domain, size, strict=True))
    if aspect is not None:
        if min(size) < 2:
            raise ValueError("an aspect ratio needs two cells an axis")
        h = [a / (n - 1) for a, n in zip(reversed(aspect), size, strict=True)]
        side = max(a * n for a, n in zip(h, size, strict=True))
        return tuple(a / side for a in h)
    return (2.0 / max(size),) * 3


def expand_masks(mask: str, channels: list[str], tmin: int, tmax: int, tstep: int = 1) -> list[tuple[int, str, int, str]]:
    """(time step, channel, components, path) for a mask with %s for the channel and %d (or %04d) for the step."""
    out = []
    for t in range(tmin, tmax + 1, tstep):
        for c in channels:
            name, _, n = c.partition(":")
            path = mask.replace("%s", name)
            out.append((t, name, int(n or 1), path % t if "%" in path else path))
    return out


# ---------------------------------------------------------------- columns


def brick_linear(info: VolumeInfo, bx="bx", by="by", bz="bz") -> Column:
    cx, cy, _ = info.brick_count
    return (F.col(bx) + cx * (F.col(by) + cy * F.col(bz))).cast("int")


def brick_spatial(info: VolumeInfo, lin="lin") -> list[Column]:
    cx, cy, _ = info.brick_count
    return [(F.col(lin) % cx).cast("int").alias("bx"), F.expr(f"int(({lin} div {cx}) % {cy})").alias("by"), F.expr(f"int({lin} div {cx * cy})").alias("bz")]


def with_brick_box(df: DataFrame, info: VolumeInfo) -> DataFrame:
    """Adds the world box of each brick, clamped to the volume: lo_x..hi_z."""
    out = df
    for a, half, size in zip(AXES, info.half_size_world, info.brick_size_world, strict=True):
        low = F.lit(-half) + F.col(f"b{a}") * size
        out = out.withColumn(f"lo_{a}", low).withColumn(f"hi_{a}", F.least(low + size, F.lit(half)))
    return out


def with_brick_of(df: DataFrame, info: VolumeInfo) -> DataFrame:
    """Adds the brick that holds a world position (x, y, z)."""
    cols = {f"b{a}": F.floor((F.col(a) + half) / size).cast("int") for a, half, size in zip(AXES, info.half_size_world, info.brick_size_world, strict=True)}
    return df.withColumns(cols)


def inside(info: VolumeInfo) -> Column:
    """Is the world position in the volume's closed box?"""
    test = F.lit(True)
    for a, half in zip(AXES, info.half_size_world, strict=True):
        test = test & F.col(a).between(-half, half)
    return test


def inside_domain(df: DataFrame, info: VolumeInfo) -> DataFrame:
    return df.where(inside(info))


def world_to_grid(df: DataFrame, info: VolumeInfo) -> DataFrame:
    """Adds grid coordinates gx, gy, gz, in which cell i has its centre at i + 0.5."""
    return df.withColumns({f"g{a}": (F.col(a) + half) / (2.0 * h) for a, half, h in zip(AXES, info.half_size_world, info.spacing, strict=True)})


def grid_to_world(df: DataFrame, info: VolumeInfo) -> DataFrame:
    return df.withColumns({a: F.col(f"g{a}") * 2.0 * h - half for a, half, h in zip(AXES, info.half_size_world, info.spacing, strict=True)})


def velocity_scale(info: VolumeInfo) -> tuple[float, float, float]:
    """Physical velocity to world units: the volume's world extent over its physical one."""
    return tuple(2.0 * half / (n * h) for half, n, h in zip(info.half_size_world, info.size, info.spacing, strict=True))  # type: ignore[return-value]


def with_timestep(df: DataFrame, info: VolumeInfo, how: str = "floor", time: str = "time") -> DataFrame:
    """Adds the step at or before a time, after it, or nearest to it."""
    q = F.col(time) / info.dt
    step = {"floor": F.floor(q), "ceil": F.floor(q) + 1, "nearest": F.floor(q + 0.5)}[how]
    return df.withColumn("step", step.cast("int"))


def select_timesteps(df: DataFrame, tmin: int, tmax: int, tstep: int = 1, toffset: int = 0) -> DataFrame:
    """Every tstep-th step of a range, numbered anew from toffset in `t_out`."""
    t = F.col("t")
    return df.where(t.between(tmin, tmax) & ((t - tmin) % tstep == 0)).withColumn("t_out", ((t - tmin) / tstep).cast("int") + toffset)


def heat_map_dims(info: VolumeInfo) -> tuple[int, int, int]:
    """Cells of a heat map: the volume's, made coarser so that the largest axis has about 128; 4 at least."""
    f = max(1, max(info.size) // 128)
    return tuple(max(4, n // f) for n in info.size)  # type: ignore[return-value]


def isqrt(n: int) -> int:
    return math.isqrt(n)
