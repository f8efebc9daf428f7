"""Periodic runs of words: seeds on diagonals, extended.

A run of period q is a stretch of words in which words q apart are the same, at least `least` words and `turns` periods long,
that can't be made longer at either end, and has no smaller period. On the diagonal of lag q (words i and i + q) it is a stretch of equal pairs, at
least max(least, turns * q) - q long: the guaranteed overlap.

Lags are searched in bands (1, 2, 3 and 4, 5 to 8, ...). A band's seeds are the k-grams of the least overlap that its lags
guarantee; k is no less than any lag of the band. So a k-gram within a run of period q comes again exactly q words later and
not before: seeds are pairs of *next* occurrences in one document, at most one for each word and band, and all pairs are
never listed. A seed is extended both ways along its diagonal by the words themselves, unless the table of the furthest place
covered on its lag says that an earlier seed's stretch holds it. For the same reason a stretch found by next occurrences that is
long enough has no smaller period.

A text's work is near linear in its words, for each band. Documents of an Arrow batch are searched side by side; none is dealt or shuffled.

Null and empty texts have no words and no runs. Words are split at ASCII white space and compared exactly. Texts of any length
are searched whole, repeated rows each by itself; an empty table gives no rows; null ids are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import each, mix, ngram_hashes, table, texts
from fieldspark.llm.crc_sql import CRC_STEPS, crc_of

#: A run holds so many words and so many periods at least.
LEAST, TURNS = 6, 4
#: Words of documents that are searched side by side.
TOGETHER = 1 << 18
Run = tuple[int, int, int]


def bands(longest: int, least: int, turns: int) -> Iterator[tuple[int, int, int]]:
    """First lag, last lag and seed length of each band, for texts of so many words."""
    first, last = 1, 1
    while max(least, turns * first) <= longest:
        turning = least // turns  # up to here the overlap falls as the lag grows
        yield first, last, min(max(least, turns * q) - q for q in (first, last, turning, turning + 1) if first <= q <= last)
        first, last = last + 1, last * 2


def stretch(words: np.ndarray, i: int, lag: int, lo: int, hi: int) -> tuple[int, int]:
    """Start and end of the equal pairs around the pair (i, i + lag) in words[lo:hi]."""

    def reach(limit: int, step: int) -> int:
        """Pairs that are equal from i on, in the direction of step; looked at in parts of doubling length."""
        done, size = 0, 16
        while done < limit:
            size = min(size, limit - done)
            a = i + done if step > 0 else i - done - size + 1
            odd = np.flatnonzero(words[a : a + size] != words[a + lag : a + lag + size])
            if len(odd):
                return done + int(odd[0] if step > 0 else size - 1 - odd[-1])
            done, size = done + size, size * 2
        return done

    return i - reach(i - lo + 1, -1) + 1, i + reach(hi - lag - i, 1)


def find(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, turns: int = TURNS) -> list[list[Run]]:
    """Runs (start, length, period) of each document, by start, then period; words holds the documents one after the other."""
    if turns < 3 or least <= 1:
        raise ValueError("seeds need runs of three periods and two words at least")
    out: list[list[Run]] = [[] for _ in lengths]
    edge = np.r_[0, np.cumsum(lengths)]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    for first, last, k in bands(int(lengths.max(initial=0)), least, turns):
        long_enough = lengths >= max(least, turns * first)
        at = np.flatnonzero(long_enough[doc])
        own, who = words[at], doc[at]
        grams = ngram_hashes(mix(own.astype(np.uint64), np.uint64(0x51)), k)
        if not len(grams):
            continue
        m = len(grams)
        inside = who[:m] == who[k - 1 :]
        grams, place = mix(grams, who[:m].astype(np.uint64))[inside], at[:m][inside]
        order = np.argsort(grams, kind="stable")
        grams, place = grams[order], place[order]
        lag = place[1:] - place[:-1]
        seeds = np.flatnonzero((grams[1:] == grams[:-1]) & (lag >= first) & (lag <= last))
        start, lag = place[seeds], lag[seeds]
        order = np.argsort(start, kind="stable")
        covered: dict[int, int] = {}  # lag -> end of its furthest stretch; places ascend over all documents
        for i, q in zip(start[order].tolist(), lag[order].tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            d = int(doc[i])
            lo, hi = int(edge[d]), int(edge[d + 1])
            s, e = stretch(words, i, q, lo, hi)
            covered[q] = e
            if e - s + q >= max(least, turns * q):
                out[d].append((s - lo, e - s + q, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Mask of the words that stay: those in no run, and those that each run around them has in its first period."""
    gone = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        gone[s + q] += 1
        gone[s + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def searched(batch: pa.RecordBatch, least: int, turns: int) -> Iterator[tuple[int | None, list[bytes], list[Run]]]:
    """Id, words and runs of each row of a batch."""
    ids, split, held = [], [], 0

    def flush() -> Iterator[tuple[int | None, list[bytes], list[Run]]]:
        number: dict[bytes, int] = {}
        flat = [number.setdefault(w, len(number)) for words in split for w in words]
        yield from zip(ids, split, find(np.array(flat, np.int64), np.array([len(w) for w in split], np.int64), least, turns), strict=True)

    for i, t in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
        ids.append(i)
        split.append((t or "").encode("utf-8", "surrogatepass").split())
        held += len(split[-1])
        if held >= TOGETHER:
            yield from flush()
            ids, split, held = [], [], 0
    if ids:
        yield from flush()


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """doc_id, start, length, period: all runs of all documents, counted in words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, _, found in searched(b, least, turns) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "length", "period"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, period long")


_COLLAPSED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("kept", pa.string())])


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and kept: the text with each run cut to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, words, found in searched(b, least, turns):
                stay = kept(len(words), found).tolist() if found else None
                text = b" ".join(words if stay is None else [w for w, s in zip(words, stay, strict=True) if s]).decode("utf-8", "surrogatepass")
                rows.append({"doc_id": i, "n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], "kept": text})
            yield pa.RecordBatch.from_pylist(rows, schema=_COLLAPSED)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def repeated(docs: DataFrame) -> DataFrame:
    """documents in which one in ten, by the checksum of its id, repeats a part of itself to its end; texts without an id stay."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))

    def rewritten(w: Column) -> Column:
        n, g = F.size(w), F.expr("h div 10")
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        turns = F.ceil((n - a) / p).cast("int")
        return F.concat_ws(" ", F.slice(F.concat(F.slice(w, F.lit(1), a), F.flatten(F.array_repeat(F.slice(w, a + 1, p), turns))), F.lit(1), n))

    edited = F.when((F.col("h") % 10 == 0) & (F.size("words") > 0), rewritten(F.col("words"))).otherwise(F.col("text"))
    due = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    return due.select("doc_id", edited.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of collapsed documents."""
    r = F.col("runs")
    best = F.array_sort(r, lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    top = found.withColumn("top", F.get(best, F.lit(0)))
    return top.select(
        "doc_id", F.size(r).cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_STEPS},
w AS (SELECT row_number() OVER () r, doc_id, {crc_of("CAST(doc_id AS VARCHAR)")} h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents, crc_steps),
g AS (SELECT *, len(ws) n, (h // 10) % len(ws) a, CAST(1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS BIGINT) p FROM w),
d AS MATERIALIZED (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(CAST(n AS BIGINT)), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END ws FROM g),
x AS MATERIALIZED (SELECT r, len(ws) n, unnest(ws) word, unnest(range(CAST(len(ws) AS BIGINT))) i FROM d),
pairs AS (SELECT a.r, b.i - a.i q, a.i FROM x a JOIN x b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
isles AS (SELECT r, q, min(i) s, count(*) + q len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) isle FROM pairs) GROUP BY r, q, isle),
runs AS MATERIALIZED (SELECT r, s, len, min(q) q FROM isles WHERE len >= greatest(6, 4 * q) GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY len DESC, s, q) = 1),
said AS (SELECT r, count(*) n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) i FROM runs),
stay AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) t FROM x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) n_runs, s start, len length, q period, 1000 * len // q exponent_milli, sha256(coalesce(said.t, '')) runs_sha256, sha256(coalesce(stay.t, '')) collapsed_sha256
FROM d LEFT JOIN best ON best.r = d.r LEFT JOIN said ON said.r = d.r LEFT JOIN stay ON stay.r = d.r
"""


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, after one in ten was made to repeat itself."""
    return digests(collapse(repeated(table(spark, sf_dir, "documents"))))
