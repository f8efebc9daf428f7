"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read; other columns, whatever their names, are left behind."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """64 bits of a text (XXH64, seed 42; 42 for null), which with the id name a row."""
    return F.xxhash64(text.cast("string"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs less the rows whose id and text key are in rows (doc_id, text_key); rows without an id stay. Other columns, whatever their names, stay."""
    ident, key = unused(docs, "_id", "_key")
    rows = rows.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).distinct()
    return docs.join(rows, (F.col("doc_id").cast("long") == F.col(ident)) & (text_key(F.col("text")) == F.col(key)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/fieldspark-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, a single machine), a folder of this process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")  # one machine, one process
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialises a frame in the shared folder, which survives lost executors, and cuts its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def each(column) -> Iterator:
    """Values of an Arrow column one by one, so that a batch's texts don't lie in memory twice."""
    for v in column:
        yield v.as_py()


class WordHashes:
    """64-bit hashes of byte words, kept for words seen lately (two generations, so its size is bounded)."""

    def __init__(self, limit: int = 60_000):
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, items: list[bytes]) -> np.ndarray:
        import xxhash

        young, old, one = self.young, self.old, xxhash.xxh3_64_intdigest
        if len(young) > self.limit:
            self.old = old = young
            self.young = young = {}
        get = young.get
        out = []
        for w in items:
            h = get(w)
            if h is None:
                h = old.get(w)
                if h is None:
                    h = one(w)
                young[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Order-dependent 64-bit combination of two hash arrays."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15) + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n entries, by doubling: n-gram = 2^k-grams joined."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    powers, size = [(1, h)], 1
    while size * 2 <= n:
        g = powers[-1][1]
        powers.append((size * 2, mix(g[: len(g) - size], g[size:])))
        size *= 2
    out, done = None, 0
    m = len(h) - n + 1
    for size, g in reversed(powers):
        if done + size <= n:
            part = g[done : done + m]
            out = part if out is None else mix(out, part)
            done += size
    return out
