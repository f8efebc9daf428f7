"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of other non-space characters; features are token uni- and bigrams hashed to
2**BITS places; a document's value of a feature is its count over the square root of the summed squares. Training takes at
most `train_rows` labelled documents (those with the least xxhash64 of their id), dealt to SHARDS workers, whose weights are
averaged. Scoring is a sparse dot product over all documents.

Null and empty texts have no features and get the intercept's probability. Labels with null quality are skipped, a
document's repeated labels count once each, rows with a null id are scored and held in (no remainder). Without any training
rows every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import each, table, texts

BITS = 18
TRAIN_ROWS = 12_000
SHARDS = 4
EPOCHS = 4
THRESHOLD = 0.7
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Features:
    """Hashed n-gram indices of texts; the token hashes of recent chunks are kept, in two generations."""

    def __init__(self, bits: int = BITS, limit: int = 60_000):
        self.mask, self.limit = np.uint64((1 << bits) - 1), limit
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def chunk(self, c: str) -> tuple[int, ...]:
        import xxhash

        got = self.old.get(c)
        if got is None:
            got = tuple(xxhash.xxh3_64_intdigest(t) for t in TOKEN.findall(c))
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[c] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        out: list[int] = []
        for c in (text or "").split():
            got = self.young.get(c)
            out += self.chunk(c) if got is None else got
        h = np.array(out, np.uint64)
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
            pairs ^= pairs >> np.uint64(31)
        again = [h[k:][h[k:] == h[:-k]] * np.uint64(0) + np.uint64(k) for k in (1, 2)]  # an n-gram that ends as it begins is one feature, whatever its word
        return (np.concatenate([h, pairs, *again]) & self.mask).astype(np.int64)


def scaled(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their normed counts."""
    i, n = np.unique(index, return_counts=True)
    v = np.log1p(n)
    return i, v / max(np.sqrt((v * v).sum()), 1e-12)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.02, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights after FTRL-proximal updates; the last place is the intercept."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rows = [(np.append(i, size), np.append(v, 1.0)) for i, v in rows]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v = rows[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y[k]) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights from a bounded sample of labelled documents (doc_id, text; doc_id, quality)."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(train_rows)  # a documented bound on training alone
    rows = texts(docs).join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Features(bits)
        pdf = pdf.sort_values(["doc_id", "y"], kind="stable")
        w = ftrl([scaled(f(t)) for t in pdf["text"]], pdf["y"].to_numpy(float), 1 << bits)
        return pd.DataFrame({"rows": [len(pdf)], "w": [w.astype(np.float32).tobytes()]})

    got = rows.groupBy("shard").applyInPandas(fit, "rows long, w binary").collect()  # SHARDS rows of a fixed size
    total = sum(r["rows"] for r in got)
    if not total:
        return np.zeros((1 << bits) + 1, np.float32)
    return sum(np.frombuffer(r["w"], np.float32) * (r["rows"] / total) for r in got).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score."""
    bits = (len(weights) - 1).bit_length() - 1
    held = docs.sparkSession.sparkContext.broadcast(weights)  # of a fixed size, 4 bytes a place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, f = held.value, Features(bits)
        for b in batches:
            out = []
            for t in each(b.column(1)):
                i, v = scaled(f(t))
                out.append(float(1 / (1 + np.exp(-np.clip(w[i] @ v + w[-1], -35, 35)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from."""
    return labels.where(~held_out())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    w = train(docs, training_rows(table(spark, sf_dir, "labels")))
    return score(docs, w).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that the classifier doesn't reject, with their columns. A repeated id is judged row by row."""
    w = train(table(spark, sf_dir, "documents"), training_rows(table(spark, sf_dir, "labels")))
    names, bits = docs.columns, (len(w) - 1).bit_length() - 1
    held, at = spark.sparkContext.broadcast(w), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, f = held.value, Features(bits)
        for b in batches:
            keep = []
            for t in each(b.column(at)):
                i, v = scaled(f(t))
                keep.append(bool(1 / (1 + np.exp(-np.clip(w[i] @ v + w[-1], -35, 35))) >= THRESHOLD))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
