"""A brick-ordered volume store: steps in many files along a space-filling curve, a directory of bricks, atomic commits.

    <path>/info/          the description, as one row
    <path>/voxels/        store_step=<t>-<version>/store_part=<p>/   cells with the Morton number of their brick, in that order
    <path>/directory/     store_step=<t>-<version>/      a row for each brick and channel: part, cells, least and greatest value
    <path>/stats/         store_step=<t>-<version>/      statistics of a step, where it was ingested as a stream
    <path>/manifest/      <t>.json                       the version of a step that counts

A step is written under a new version and then published by renaming its manifest file into place, which is atomic; a reader
takes what the manifest names, so files of a broken write, or of a replaced step, are never seen. The number of steps follows
from the manifest. All files are read and written through Spark and Hadoop's file systems.

The directory's ranges cover a brick and one layer of cells around it, so that whatever lies between two neighbouring bricks
(a crossing of an iso value) is in the range of both.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.info import AXES, VolumeInfo
from fieldspark.operators.bricks import around, assert_appendable, assign_bricks, ghost_ranges, with_ghosts
from fieldspark.operators.select import small

#: Bytes of cells for a file, of 8 bytes a value.
FILE_BYTES = 128 << 20
#: Files that are named one by one in a pruned read; where more survive, all of the steps' files are opened, and bricks joined.
MOST_PATHS = 10_000


def morton(info: VolumeInfo, bx: str = "bx", by: str = "by", bz: str = "bz") -> Column:
    """The place of a brick on the Morton curve: the bits of its numbers, interleaved."""
    bits = max(1, max(n - 1 for n in info.brick_count).bit_length())
    out = F.lit(0).cast("long")
    for k in range(bits):
        for d, c in enumerate((bx, by, bz)):
            bit = F.shiftright(F.col(c).cast("long"), k).bitwiseAND(1)
            out = out.bitwiseOR(F.shiftleft(bit, 3 * k + d))
    return out


def part_of(info: VolumeInfo, m: Column, parts: int) -> Column:
    """The file of a brick: the curve is cut into equal ranges."""
    bits = max(1, max(n - 1 for n in info.brick_count).bit_length())
    return F.shiftright(m * parts, 3 * bits).cast("int")


def parts_of(info: VolumeInfo, channels: int, file_bytes: int) -> int:
    """Files of one step."""
    bricks = 1
    while bricks < max(info.brick_count):
        bricks *= 2
    cells = info.nx * info.ny * info.nz
    return max(1, min(bricks**3, -(-cells * 8 * channels // file_bytes)))


# ---------------------------------------------------------------- manifest


class Files:
    """The few file operations that Spark's readers and writers lack, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self.at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file aside and renames it into place, over an earlier one."""
        aside, last = self.at(f"{self.path}/{name}.{uuid.uuid4().hex}.tmp"), self.at(f"{self.path}/{name}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(aside, last, how)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.path}/{name}"), True)


def manifest(spark: SparkSession, path: str) -> dict[int, dict]:
    """What counts: for each step its version, files and cells."""
    files = Files(spark, path)
    return {int(n.removesuffix(".json")): json.loads(files.read(f"manifest/{n}")) for n in files.names("manifest") if n.endswith(".json")}


# ---------------------------------------------------------------- writing


def create(spark: SparkSession, path: str, info: VolumeInfo) -> None:
    """A store without steps; an earlier one at this place is emptied."""
    info.check()
    files = Files(spark, path)
    for name in ("manifest", "voxels", "directory", "stats", "staged", "info"):
        files.remove(name)
    info.frame(spark).write.parquet(f"{path}/info")


def described(spark: SparkSession, path: str) -> VolumeInfo:
    """The description, with as many steps as are published."""
    row = spark.read.parquet(f"{path}/info").first().asDict()
    return VolumeInfo(**row | {"nt": max(manifest(spark, path), default=-1) + 1})


def append(voxels: DataFrame, info: VolumeInfo, path: str, cols: list[str], again: str = "error", file_bytes: int = FILE_BYTES, also: Callable[[DataFrame], None] | None = None, note: dict | None = None) -> dict[int, int]:
    """Writes and publishes the steps of voxels (t, x, y, z, cols; a cell once a step); returns their cells.

    also: is called with the written cells (t, store_step, ...) before they are published. note: is kept with the steps.

    The description must be that of the store (but for nt). A step that is there already is an error (again="error"), left as it is
    ("refuse") or replaced ("replace"). A cell that lies outside the volume or comes twice, and another set of columns, are errors.
    """
    if again not in ("error", "refuse", "replace"):
        raise ValueError(again)
    clash = {"t", *AXES, "bx", "by", "bz", "store_morton", "store_part", "store_step"} & set(cols)
    if clash:
        raise ValueError(f"a store keeps columns of its own by these names: {sorted(clash)}")
    spark = voxels.sparkSession
    stored = described(spark, path)
    assert_appendable(stored, info)
    there = manifest(spark, path)
    if there and sorted(next(iter(there.values()))["cols"]) != sorted(cols):
        raise ValueError(f"columns differ: {next(iter(there.values()))['cols']} and {cols}")
    voxels = voxels.select(F.col("t").cast("int").alias("t"), *[F.col(a).cast("int").alias(a) for a in AXES], *cols)
    outside = F.lit(False)
    for a, n in zip(AXES, info.size, strict=True):
        outside = outside | F.col(a).isNull() | ~F.col(a).between(0, n - 1)
    steps = {r["t"]: r for r in voxels.groupBy("t").agg(F.count("*").alias("cells"), F.count_if(outside).alias("outside")).collect()}  # steps, few
    bad = [t for t, r in steps.items() if t is None or t < 0 or r["outside"]]
    if bad:
        raise ValueError(f"cells outside the volume in steps {bad}")
    if again == "error" and set(steps) & set(there):
        raise ValueError(f"steps {sorted(set(steps) & set(there))} are there already")
    new = sorted(t for t in steps if again == "replace" or t not in there)
    if not new:
        return {}
    version = uuid.uuid4().hex[:12]
    parts = parts_of(info, len(cols), file_bytes)
    cells = assign_bricks(voxels.where(F.col("t").isin(new)), info)
    cells = cells.withColumn("store_morton", morton(info)).withColumn("store_part", part_of(info, F.col("store_morton"), parts)).withColumn("store_step", F.concat(F.col("t").cast("string"), F.lit(f"-{version}")))
    # each file of each step is one task's, whatever the number of steps
    dealt = cells.repartition(max(1, len(new) * parts), "t", "store_part").sortWithinPartitions("t", "store_part", "store_morton", "z", "y", "x")
    dealt.write.mode("append").partitionBy("store_step", "store_part").parquet(f"{path}/voxels")
    written = spark.read.option("basePath", f"{path}/voxels").parquet(*[f"{path}/voxels/store_step={t}-{version}" for t in new])
    twice = written.groupBy("t", *AXES).count().where("count > 1").select("t").limit(1).collect()
    if twice:
        raise ValueError(f"cells come twice in step {twice[0][0]}")
    ranges = ghost_ranges(written, info, cols)
    own = written.groupBy("t", "bx", "by", "bz").agg(F.count("*").alias("cells"), F.first("store_morton").alias("store_morton"), F.first("store_part").alias("store_part"))
    rows = ranges.join(own, ["t", "bx", "by", "bz"]).withColumn("store_step", F.concat(F.col("t").cast("string"), F.lit(f"-{version}")))
    rows.repartition(max(1, len(new)), "t").sortWithinPartitions("store_morton", "measure").write.mode("append").partitionBy("store_step").parquet(f"{path}/directory")
    if also:
        also(written)
    files = Files(spark, path)
    for t in new:
        files.publish(f"manifest/{t}.json", json.dumps({"step": f"{t}-{version}", "parts": parts, "cells": steps[t]["cells"], "cols": cols} | (note or {})))
    return {t: steps[t]["cells"] for t in new}


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes steps that no manifest names, of broken or replaced writes; not to be run beside a writer. Returns how many."""
    live = {f"store_step={m['step']}" for m in manifest(spark, path).values()}
    files = Files(spark, path)
    gone = 0
    for folder in ("voxels", "directory", "stats"):
        for name in files.names(folder):
            if name.startswith("store_step=") and name not in live:
                files.remove(f"{folder}/{name}")
                gone += folder == "voxels"
    return gone


# ---------------------------------------------------------------- reading


def directory(spark: SparkSession, path: str) -> DataFrame:
    """t, bx, by, bz, measure, vmin, vmax, cells, store_morton, store_part of all published bricks."""
    live = manifest(spark, path)
    if not live:
        raise ValueError(f"no step is published in {path}")
    return spark.read.option("basePath", f"{path}/directory").parquet(*[f"{path}/directory/store_step={m['step']}" for m in live.values()]).drop("store_step")


def read(spark: SparkSession, path: str, bricks: DataFrame | None = None, ghosts: int = 0, steps: list[int] | None = None) -> DataFrame:
    """t, x, y, z, columns, bx, by, bz of the published steps.

    bricks: t, bx, by, bz of those that are wanted; only files that hold one of them are opened. ghosts: layers of cells around them, from
    bricks that aren't wanted, which come with is_halo true.
    """
    live = {t: m for t, m in manifest(spark, path).items() if steps is None or t in steps}
    if not live:
        raise ValueError(f"no such step is published in {path}")
    info = described(spark, path)
    at = f"{path}/voxels"
    paths = [f"{at}/store_step={m['step']}" for m in live.values()]
    if bricks is not None:
        keys = ["t", "bx", "by", "bz"]
        bricks = bricks.select(*keys).where(F.col("t").isin(list(live))).distinct()
        near = around(bricks, info) if ghosts else bricks
        parts = F.lit(0)
        for t, m in live.items():  # steps may differ in their number of files
            parts = F.when(F.col("t") == t, part_of(info, morton(info), m["parts"])).otherwise(parts)
        wanted = near.select("t", parts.alias("part")).distinct().limit(MOST_PATHS + 1).collect()
        if len(wanted) <= MOST_PATHS:
            files = Files(spark, path)
            there = {t: set(files.names(f"voxels/store_step={live[t]['step']}")) for t in {r.t for r in wanted}}  # a listing for each step
            paths = [f"{at}/store_step={live[r.t]['step']}/store_part={r.part}" for r in sorted(wanted) if f"store_part={r.part}" in there[r.t]]
    any_step = spark.read.option("basePath", at).parquet(f"{at}/store_step={next(iter(live.values()))['step']}")
    cells = spark.read.option("basePath", at).schema(any_step.schema).parquet(*paths) if paths else any_step.where("false")
    cells = cells.drop("store_step", "store_part", "store_morton")
    if bricks is None:
        return cells
    return with_ghosts(cells, bricks, info, ghosts) if ghosts else cells.join(small(bricks), keys, "left_semi")
