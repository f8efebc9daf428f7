"""Raw volumes as a Spark data source: `spark.read.format("raw_volume")`, as a batch, a stream and a sink.

A raw file holds one channel of one time step: interleaved float32, x fastest. The path is a mask with %s for the channel
and %d (or %04d) for the step. Options: dims ("nx,ny,nz"), channels ("velocity:3,temp"; a count above 1 makes
velocity0..), tmin, tmax, tstep, slab_bytes.

A partition is a slab of z of one step; its task reads the slab's byte ranges and no more, through Arrow's file systems (local, HDFS
and object stores, by the path's scheme). Filters on t and z narrow the partitions. As a stream a step is new data once all its files are
there in full; steps come in order, each once. The sink writes each step's files aside and moves them into place at commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from fieldspark.functions.info import expand_masks

SLAB_BYTES = 16 << 20
BATCH_CELLS = 1 << 18


@dataclass(frozen=True)
class Layout:
    """What the options say."""

    mask: str
    nx: int
    ny: int
    nz: int
    channels: tuple[str, ...]
    tmin: int = 0
    tmax: int | None = None
    tstep: int = 1
    slab_bytes: int = SLAB_BYTES

    @classmethod
    def of(cls, options: dict) -> Layout:
        o = {k.lower(): v for k, v in dict(options).items()}
        missing = [k for k in ("path", "dims", "channels") if k not in o]
        if missing:
            raise ValueError(f"raw_volume needs {', '.join(missing)}")
        nx, ny, nz = (int(v) for v in o["dims"].split(","))
        layout = cls(o["path"], nx, ny, nz, tuple(c.strip() for c in o["channels"].split(",")), int(o.get("tmin", 0)), int(o["tmax"]) if "tmax" in o else None, int(o.get("tstep", 1)), int(o.get("slab_bytes", SLAB_BYTES)))
        if min(nx, ny, nz, layout.tstep) < 1:
            raise ValueError("dims and tstep must be positive")
        return layout

    def columns(self) -> list[tuple[str, str, int, int]]:
        """Column, channel, component and components of each column."""
        out = []
        for c in self.channels:
            name, _, n = c.partition(":")
            count = int(n or 1)
            out += [(f"{name}{k}" if count > 1 else name, name, k, count) for k in range(count)]
        return out

    def files(self, t: int) -> list[tuple[str, int, str]]:
        """Channel, components and path of a step's files."""
        return [(c, n, path) for _, c, n, path in expand_masks(self.mask, list(self.channels), t, t)]

    def schema(self) -> str:
        return "t int, x int, y int, z int, " + ", ".join(f"`{c[0]}` float" for c in self.columns())

    def arrow(self) -> pa.Schema:
        return pa.schema([(a, pa.int32()) for a in "txyz"] + [(c[0], pa.float32()) for c in self.columns()])

    def whole(self, t: int) -> bool:
        """Are all files of a step there, in full?"""
        for _, n, path in self.files(t):
            fs, at = file_system(path)
            info = fs.get_file_info(at)
            if not info.is_file or info.size < 4 * n * self.nx * self.ny * self.nz:
                return False
        return True

    def steps(self, first: int, last: int | None) -> list[int]:
        """Steps of a range; without an end as many as there are in full, one after the other."""
        if last is not None:
            return list(range(first, last + 1, self.tstep))
        out, t = [], first
        while self.whole(t):
            out.append(t)
            t += self.tstep
        return out

    def slabs(self, t: int, z0: int, z1: int) -> list[Slab]:
        widest = max(c[3] for c in self.columns())
        deep = max(1, self.slab_bytes // (4 * widest * self.nx * self.ny))
        return [Slab(t, z, min(z + deep, z1)) for z in range(z0, z1, deep)]


class Slab(InputPartition):
    """Layers z0 to z1 - 1 of a step."""

    def __init__(self, t: int, z0: int, z1: int):
        super().__init__((t, z0, z1))
        self.t, self.z0, self.z1 = t, z0, z1


def file_system(path: str):
    """Arrow's file system for a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def read_slab(layout: Layout, slab: Slab) -> Iterator[pa.RecordBatch]:
    plane = layout.nx * layout.ny
    deep = max(1, BATCH_CELLS // plane)
    opened = []
    try:
        for channel, n, path in layout.files(slab.t):
            fs, at = file_system(path)
            opened.append((channel, n, path, fs.open_input_file(at)))
        for z0 in range(slab.z0, slab.z1, deep):
            cells = (min(z0 + deep, slab.z1) - z0) * plane
            i = np.arange(cells)
            out = [np.full(cells, slab.t, np.int32), (i % layout.nx).astype(np.int32), (i // layout.nx % layout.ny).astype(np.int32), (z0 + i // plane).astype(np.int32)]
            for _, n, path, f in opened:
                f.seek(4 * n * z0 * plane)
                data = f.read(4 * n * cells)
                if len(data) < 4 * n * cells:
                    raise ValueError(f"{path} ends before layer {z0 + cells // plane}")
                values = np.frombuffer(data, np.float32).reshape(cells, n)
                out += [np.ascontiguousarray(values[:, k]) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in out], schema=layout.arrow())
    finally:
        for *_, f in opened:
            f.close()


class RawReader(DataSourceReader):
    def __init__(self, layout: Layout):
        self.layout = layout
        self.low = {"t": None, "z": None}
        self.high = {"t": None, "z": None}
        self.only: dict[str, set | None] = {"t": None, "z": None}

    def pushFilters(self, filters: list[Filter]):
        """Bounds on t and z are kept for the partitions; Spark tests all filters again."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.low:
                if isinstance(f, EqualTo):
                    self._meet(name, {f.value})
                elif isinstance(f, In):
                    self._meet(name, set(f.value))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    v = f.value + isinstance(f, GreaterThan)
                    self.low[name] = v if self.low[name] is None else max(v, self.low[name])
                elif isinstance(f, LessThan | LessThanOrEqual):
                    v = f.value - isinstance(f, LessThan)
                    self.high[name] = v if self.high[name] is None else min(v, self.high[name])
            yield f

    def _meet(self, name: str, values: set) -> None:
        now = self.only[name]
        self.only[name] = values if now is None else now & values

    def wanted(self, name: str, v: int) -> bool:
        return (self.low[name] is None or v >= self.low[name]) and (self.high[name] is None or v <= self.high[name]) and (self.only[name] is None or v in self.only[name])

    def partitions(self) -> list[Slab]:
        layout = self.layout
        steps = [t for t in layout.steps(layout.tmin, layout.tmax) if self.wanted("t", t)]
        layers = [z for z in range(layout.nz) if self.wanted("z", z)]
        runs: list[list[int]] = []
        for z in layers:
            if runs and runs[-1][1] == z:
                runs[-1][1] = z + 1
            else:
                runs.append([z, z + 1])
        return [s for t in steps for z0, z1 in runs for s in layout.slabs(t, z0, z1)] or [Slab(layout.tmin, 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if partition.z0 < partition.z1:
            yield from read_slab(self.layout, partition)


class RawStream(DataSourceStreamReader):
    """Steps as they come: an offset is the next step that hasn't been given."""

    def __init__(self, layout: Layout):
        self.layout = layout

    def initialOffset(self) -> dict:
        return {"t": self.layout.tmin}

    def latestOffset(self) -> dict:
        t = getattr(self, "next", self.layout.tmin)
        top = self.layout.tmax
        while (top is None or t <= top) and self.layout.whole(t):
            t += self.layout.tstep
        self.next = t
        return {"t": t}

    def partitions(self, start: dict, end: dict) -> list[Slab]:
        return [s for t in range(start["t"], end["t"], self.layout.tstep) for s in self.layout.slabs(t, 0, self.layout.nz)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        yield from read_slab(self.layout, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept."""


@dataclass
class Moves(WriterCommitMessage):
    paths: list[tuple[str, str]]


class RawWriter(DataSourceArrowWriter):
    """Rows must come step by step, in the order of z, y, x, a whole step to one task (see write_raw)."""

    def __init__(self, layout: Layout):
        self.layout = layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        layout, moves = self.layout, []
        cells, now, streams, done = layout.nx * layout.ny * layout.nz, None, [], 0

        def close() -> None:
            for *_, out in streams:
                out.close()
            if now is not None and done != cells:
                raise ValueError(f"step {now} has {done} cells of {cells}")

        for batch in iterator:
            t = batch.column("t").to_numpy()
            place = (batch.column("z").to_numpy().astype(np.int64) * layout.ny + batch.column("y").to_numpy()) * layout.nx + batch.column("x").to_numpy()
            edges = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if int(t[a]) != now:
                    close()
                    now, done, streams = int(t[a]), 0, []
                    for channel, n, path in layout.files(now):
                        aside = f"{path}.{uuid.uuid4().hex}.tmp"
                        fs, at = file_system(aside)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        streams.append((channel, n, fs.open_output_stream(at)))
                        moves.append((aside, path))
                if (place[a:b] != np.arange(done, done + b - a)).any():
                    raise ValueError(f"cells of step {now} are missing, double or out of order")
                done += b - a
                for channel, n, out in streams:
                    names = [c[0] for c in layout.columns() if c[1] == channel]
                    out.write(np.column_stack([batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in names]).astype(np.float32).tobytes())
        close()
        return Moves(moves)

    def commit(self, messages: list[Moves | None]) -> None:
        for m in messages:
            for aside, path in m.paths if m else []:
                fs, at = file_system(aside)
                fs.move(at, file_system(path)[1])

    def abort(self, messages: list[Moves | None]) -> None:
        for m in messages:
            for aside, _ in m.paths if m else []:
                fs, at = file_system(aside)
                if fs.get_file_info(at).is_file:
                    fs.delete_file(at)


class RawVolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_volume"

    def schema(self) -> str:
        return Layout.of(self.options).schema()

    def reader(self, schema: StructType) -> RawReader:
        return RawReader(Layout.of(self.options))

    def streamReader(self, schema: StructType) -> RawStream:
        return RawStream(Layout.of(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RawWriter:
        return RawWriter(Layout.of(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and lets its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVolumeSource)
    return spark


def write_raw(df: DataFrame, path: str, dims: tuple[int, int, int], channels: list[str]) -> None:
    """Writes all steps of df (t, x, y, z, columns) as raw files; a step is one task's stream, for its file is one."""
    register(df.sparkSession)
    layout = Layout(path, *dims, tuple(channels))
    rows = df.select(*[df[a].cast("int").alias(a) for a in "txyz"], *[df[c[0]].cast("float").alias(c[0]) for c in layout.columns()])
    rows.repartition("t").sortWithinPartitions("t", "z", "y", "x").write.format("raw_volume").options(path=path, dims=",".join(map(str, dims)), channels=",".join(channels)).mode("append").save()
