"""Hierarchical Pitman-Yor language model: bigram restaurants over one unigram restaurant over a uniform base.

A context restaurant serves the words that follow a word; all of them share one parent, the unigram restaurant, whose
customers are the tables of its children; its base is uniform over the vocabulary and one unknown word. The seating of the
whole hierarchy is sampled by Gibbs, in SWEEPS over all dishes; the predictive probability is averaged over the last SAMPLES.

A sweep draws, each given the state at hand: the parent's tables by word; `zeta`, a Gamma number of the parent's tables; the
parent's probability of each word, as a mass over the sum of all masses; for each context a Gamma number of its tables; and,
a dish at a time, the tables of all its customers, however many, by the exact weights of their seatings. The two Gamma
numbers stand for what dishes of one restaurant have to do with each other (d^T Gamma(s / d + T), as an integral): given
them, and the parent's probabilities, all dishes are independent. So the draws of a sweep run side by side and are those of a
Gibbs sampler still, with no stale totals. A word's mass is Gamma(customers - d tables) for the parent's tables it has, and
for those to come, with the parent's discount of 1/2, inverse Gaussian (Pitman and Yor 1997, proposition 21).

How it is dealt. Types (a word in a context) are counted in buckets of words; a word too frequent for one bucket is dealt by
word and context. What restaurants hold in all buckets is summed by context and sent back to the buckets that asked, by packed
exchanges: before the sweeps (customers, and dishes as the tables to begin with), in each (tables, of contexts that have a dish
with two customers there: others have nothing to draw) and after them. Then tokens, with the documents they came from, meet
their bucket's seating. All of this grows with the input and is only ever shuffled; the driver gets sums, and the totals of the
frequent words (at most eight for each bucket).

No score depends on the layout: draws are by random numbers keyed by word, context and sweep, from exact totals. Which
words are frequent is looked up in a sample chosen by hash, and decides the layout alone. Words are told by 64 bits of hash,
contexts by 48.

Null and empty texts are one end token. Rows with a null id are learned from. Repeated rows count and score by themselves.
Texts of any length are scored whole. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import WordHashes, cut, each, mix, table, texts
from fieldspark.llm.packed import NO_ID, byte_words, runs, unz, z

END, START = np.uint64(0x5F3759DF5F3759DF), np.uint64(0x9D2C5680EFC60000)
CONTEXT = np.uint64((1 << 48) - 1)
DISCOUNT, STRENGTH = 0.8, 20.0  # of context restaurants
DISCOUNT0, STRENGTH0 = 0.5, 10.0  # of the unigram restaurant; for another discount `masses` needs other draws
SWEEPS, SAMPLES = 5, 2
UNIT = 2.0**20  # masses are summed in whole numbers, so that the sum doesn't depend on its order
ROWS = 1024  # dishes with more customers get their weights by an integral, others from a table
CELLS = 1 << 19  # weights at a time
TOKEN_BUCKET = 13 << 20
FLUSH = 2_000_000
LAYOUT_DOCS = 4000
ROW = "kind long, bucket long, part long, data binary"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


# ---------------------------------------------------------------- seating


def unit(key: np.ndarray, n: int) -> np.ndarray:
    """The n-th random number in [0, 1) of each key."""
    return (mix(mix(key, np.uint64(n)), np.uint64(n + 77)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def normal(key: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(-2 * np.log1p(-unit(key, n))) * np.cos(2 * np.pi * unit(key, n + 1))


def gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A Gamma number of each shape, 0 for shape 0 (Marsaglia and Tsang; under 1 from that of one more)."""
    more = shape < 1
    d = np.where(more, shape + 1, shape) - 1 / 3
    out, left, n = np.zeros(len(shape)), np.flatnonzero(shape > 0), 1
    while len(left):
        x, dl = normal(key[left], n), d[left]
        v = (1 + x / np.sqrt(9 * dl)) ** 3
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = (v > 0) & (np.log(unit(key[left], n + 2)) < x * x / 2 + dl * (1 - v + np.log(v)))
        out[left[ok]], left, n = dl[ok] * v[ok], left[~ok], n + 3
    more &= shape > 0
    out[more] *= (1 - unit(key[more], 0)) ** (1 / shape[more])
    return out


def inverse_gauss(a: float, key: np.ndarray) -> np.ndarray:
    """Inverse Gaussian numbers with E exp(-s X) = exp(-a (sqrt(1 + s) - 1)) (Michael, Schucany and Haas)."""
    y = normal(key, 0) ** 2
    low = (a / 2) ** 2 / (a / 2 + y / 4 + np.sqrt(a * y + y * y / 4) / 2)
    return np.where(unit(key, 2) * (a / 2 + low) <= a / 2, low, (a / 2) ** 2 / low)


@cache
def triangle(d: float) -> np.ndarray:
    """At [n, t] the logarithm of what all ways to seat n customers at t tables weigh: the generalised Stirling numbers."""
    s, t = np.full((ROWS + 1, ROWS + 1), -np.inf), np.arange(ROWS + 1)
    s[1, 1] = 0
    for n in range(1, ROWS):
        s[n + 1, 1 : n + 2] = np.logaddexp(s[n, : n + 1], s[n, 1 : n + 2] + np.log(np.maximum(n - d * t[1 : n + 2], 1e-300)))
    return s


def log_one_minus(w: np.ndarray) -> np.ndarray:
    near = 0.5 * np.log1p(w.real * (w.real - 2) + w.imag**2) + 1j * np.arctan2(-w.imag, 1 - w.real)
    return np.where(np.abs(w) < 0.5, near, np.log(1 - w))


def many_customers(c: int, alpha: float, d: float) -> tuple[int, np.ndarray]:
    """What t tables weigh, for t from the number returned on; those left out weigh less than a random number can tell.

    alpha^t S(c, t) is c! times the coefficient of z^c in (a f)^t / t!, where f = 1 - (1 - z)^d and a = alpha / d. It is the
    integral of (a f)^t / t! z^(-c - 1) along a parabola around the cut from 1 on, with its vertex at the saddle point (or, so
    near the cut that the saddle is flat, at a distance of 8 / c), by the trapezoid rule, which converges geometrically.
    """
    a, low, high = alpha / d, -700.0, 700.0
    for _ in range(60):  # the saddle point of exp(a f) z^-c, by the logit of w = 1 - z
        x = (low + high) / 2
        over = math.log(c / alpha) - (1 - d) * math.log1p(math.exp(-x)) + math.log1p(math.exp(x)) > 0
        low, high = (low, x) if over else (x, high)
    w0 = max(1 / (1 + math.exp(-low)), 8 / c)
    curve = a * d * (1 - d) * w0 ** (d - 2) + c / (1 - w0) ** 2
    h = min(0.1, 0.25 / (w0 * math.sqrt(curve)))
    mean = a * (1 - w0**d)
    shift = mean - (c + 1) * math.log1p(-w0)
    reach = 9 * math.sqrt(mean) + 30
    while True:
        first, last = max(1, int(mean - reach)), min(c, int(mean + reach) + 1)
        t = np.arange(first, last + 1)[:, None]
        base = t * math.log(a) - (math.lgamma(first + 1) + np.log(np.r_[1, t[1:, 0]]).cumsum())[:, None] - shift
        few = int(np.searchsorted(-t[:, 0] * math.log1p(-(w0**d)), 1))  # there the integral of z^(-c - 1), 0, is taken off
        weight, k = np.zeros(len(t)), 0
        while True:
            u = 1 + 1j * h * np.arange(k, k + 64)
            w, log_f = w0 * u * u, log_one_minus(w0**d * np.exp(2 * d * np.log(u)))
            rest = base - (c + 1) * log_one_minus(w)
            g = np.concatenate([np.expm1(t[:few] * log_f) * np.exp(rest[:few]), np.exp(t[few:] * log_f + rest[few:])]) * u
            if not k:
                g[:, 0] /= 2
            weight += g.real.sum(1)
            k += 64
            if np.abs(g[:, -1]).max() <= 1e-18 * np.abs(weight).max():
                break
        weight = np.maximum(weight, 0)
        least = 1e-13 * weight.sum()
        if (first == 1 or weight[0] < least) and (last == c or weight[-1] < least):
            return first, weight
        reach *= 2


def seat(c: np.ndarray, alpha: np.ndarray, d: float, key: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Tables of each dish, as many draws as samples: a row each. alpha: the weight of a new table.

    All customers of a dish leave and are seated again at once: t tables have the weight alpha^t S(c, t) of all their seatings.
    """
    out = np.repeat((c > 0).astype(np.float64)[None], samples, 0)
    at = np.flatnonzero(c >= 2)
    at = at[np.lexsort((alpha[at], c[at]))]
    c, alpha = c[at].astype(np.int64), np.maximum(alpha[at], 1e-12)
    draws = np.stack([unit(key[at], k) for k in range(samples)])
    few = int(np.searchsorted(c, ROWS, side="right"))
    for s, e in runs(c[:few]):
        n = int(c[s])
        ways, t, step = triangle(d)[n, 1 : n + 1], np.arange(1, n + 1), max(1, CELLS // n)
        step = min(step, max(64, -(-(e - s) // 8))) if n > 8 else step  # of near weights, which have near numbers of tables
        for i in range(s, e, step):
            some = slice(i, min(e, i + step))
            least, most = (ways + np.log(x) * t for x in (alpha[i], alpha[some][-1]))
            first, last = int(np.argmax(least > least.max() - 50)), n - int(np.argmax((most > most.max() - 50)[::-1]))  # others weigh less than a random number can tell
            weight = ways[first:last] + np.log(alpha[some])[:, None] * t[first:last]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            for k in range(samples):
                out[k, at[some]] = 1 + first + (weight[:, :-1] <= draws[k, some, None] * weight[:, -1:]).sum(1)
    for i in range(few, len(c)):
        first, weight = many_customers(int(c[i]), float(alpha[i]), d)
        weight = np.cumsum(weight)
        out[:, at[i]] = first + np.searchsorted(weight[:-1], draws[:, i] * weight[-1], side="right")
    return out


def masses(words: np.ndarray, customers: np.ndarray, tables: np.ndarray, zeta: float, v: float, sweep: int) -> np.ndarray:
    """Of words, what the unigram restaurant's probabilities are proportional to, given its tables."""
    return gamma(customers - DISCOUNT0 * tables, mix(words, np.uint64(8 * sweep + 1))) + inverse_gauss(zeta / (v + 1), mix(words, np.uint64(8 * sweep + 2)))


def seat_words(customers: np.ndarray, words: np.ndarray, zeta: float, v: float, sweep: int) -> np.ndarray:
    """Tables of words in the unigram restaurant."""
    return seat(customers, np.full(len(words), DISCOUNT0 * zeta / (v + 1)), DISCOUNT0, mix(words, np.uint64(8 * sweep + 3)), 1)[0]


# ---------------------------------------------------------------- exchange


def small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def planes(a: np.ndarray, width: int | None = None) -> bytes:
    """Bytes of equal weight side by side, which pack better; of each number the `width` lowest."""
    if not len(a):
        return b""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(len(a), -1)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def bundle(**arrays) -> bytes:
    """Named arrays as one packed value."""
    flat = {}
    for name, a in arrays.items():
        if a.dtype == np.uint64:
            flat[name] = ("<u8", len(a), planes(a, 6 if name == "contexts" else 8))
        elif a.dtype.kind in "iu":
            a = small(a)
            flat[name] = (a.dtype.str, len(a), planes(a))
        else:
            flat[name] = (a.dtype.str, len(a), a.tobytes())
    return z(pickle.dumps(flat, 5))


def unbundle(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, n, raw) in pickle.loads(unz(data)).items():
        dtype = np.dtype(kind)
        if dtype.kind == "f":
            out[name] = np.frombuffer(raw, dtype)
            continue
        part = np.frombuffer(raw, np.uint8).reshape(-1, n).T if n else np.empty((0, dtype.itemsize), np.uint8)
        full = np.zeros((n, dtype.itemsize), np.uint8)
        full[:, : part.shape[1]] = part
        out[name] = full.view(dtype).ravel()
    return out


def bucket_of(w: np.ndarray, u: np.ndarray, buckets: int, heavy: np.ndarray, spread: np.ndarray) -> np.ndarray:
    b = (w >> np.uint64(20)) % np.uint64(buckets)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, w), len(heavy) - 1)
        hot = np.flatnonzero(heavy[at] == w)
        b[hot] = (b[hot] + (mix(w[hot], u[hot]) >> np.uint64(20)) % spread[at[hot]]) % np.uint64(buckets)
    return b.astype(np.uint16 if buckets < 65536 else np.uint32)


def distinct(w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and contexts of the distinct types, by word, then context; and of each pair its type."""
    _, first, at = np.unique(mix(w, u), return_index=True, return_inverse=True)
    order = np.lexsort((u[first], w[first]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = first[order]
    return w[first], u[first], place[at]


def of_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique of ascending values, with their places."""
    new = np.r_[True, values[1:] != values[:-1]][: len(values)]
    return values[new], np.cumsum(new) - 1


def deal(docs: DataFrame, buckets: int, heavy: np.ndarray, spread: np.ndarray, owners: bool) -> DataFrame:
    """Types of each input batch by bucket: counted over the batch, or (owners) by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), (TaskContext.get().partitionId() << 32)
        ids, toks, held = [], [], 0

        def flush() -> pa.RecordBatch:
            w = np.concatenate([np.append(t, END) for t in toks])
            u = np.concatenate([np.insert(t, 0, START) for t in toks]) & CONTEXT
            doc = np.repeat(np.arange(len(toks), dtype=np.uint64), [len(t) + 1 for t in toks])
            kind = mix(w, u)
            out_of = np.array([held_out(i) for i in ids], np.uint8)
            if owners:
                _, first, n = np.unique(mix(kind, doc), return_index=True, return_counts=True)
                order = np.argsort(first, kind="stable")  # by document
                first, n = first[order], n[order]
            else:
                _, first, at = np.unique(kind, return_index=True, return_inverse=True)
                n = np.bincount(at, weights=out_of[doc.astype(np.int64)] == 0, minlength=len(first)).astype(np.int64)
            w, u, doc = w[first], u[first], doc[first]
            b = bucket_of(w, u, buckets, heavy, spread)
            order = np.argsort(b, kind="stable") if owners else np.lexsort((w, b))
            w, u, doc, n, b = w[order], u[order], doc[order], n[order], b[order]
            out = []
            for s, e in runs(b):
                contexts, ui = np.unique(u[s:e], return_inverse=True)
                words, wi = np.unique(w[s:e], return_inverse=True) if owners else of_sorted(w[s:e])
                own = dict(words=words, contexts=contexts, ui=ui, n=n[s:e])
                if owners:
                    d = doc[s:e].astype(np.int64)
                    edge = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    own |= dict(wi=wi, docs=np.diff(d[edge], prepend=0), counts=np.diff(np.r_[edge, e - s]), held=out_of[d[edge]])
                    if not out:
                        own |= dict(ids=np.array([NO_ID if i is None else i for i in ids], np.int64).view(np.uint64))
                else:
                    own |= dict(counts=np.bincount(wi))
                out.append({"kind": 0, "bucket": int(b[s]), "part": number, "data": bundle(**own)})
            return pa.RecordBatch.from_pylist(out, schema=MESSAGE)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                toks.append(hashes(byte_words(t, True)))
                ids.append(i)
                held += len(toks[-1]) + 1
                if held >= FLUSH:
                    yield flush()
                    ids, toks, held, number = [], [], 0, number + 1
        if toks:
            yield flush()

    return texts(docs).mapInArrow(run, ROW)


MESSAGE = pa.schema([("kind", pa.int64()), ("bucket", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])


def rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["kind", "bucket", "part", "data"])


def by_part(contexts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts by the part of the exchange that sums them, and the place of each there."""
    names, at = np.unique(contexts, return_inverse=True)
    order = np.argsort(names % np.uint64(parts), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return names[order], place[at]


def ask(bucket: int, contexts: np.ndarray, parts: int, **sums: np.ndarray) -> list[tuple]:
    """A bucket's sums for its contexts, to the parts."""
    return [(0, bucket, int(contexts[s] % np.uint64(parts)), bundle(contexts=contexts[s:e], **{k: v[s:e] for k, v in sums.items()})) for s, e in runs(contexts % np.uint64(parts))]


def answer(asked: pd.DataFrame, added: list[pd.DataFrame] | None = None) -> pd.DataFrame:
    """Of a part: the sums over all buckets, back to each bucket in its own order. added: tables of samples, which buckets sent for contexts among these."""
    got = [unbundle(d) for d in asked["data"]]
    names, at = np.unique(np.concatenate([g["contexts"] for g in got]), return_inverse=True)
    totals = {k: np.bincount(at, weights=np.concatenate([g[k] for g in got])).astype(np.int64) for k in got[0] if k != "contexts"}
    for k, pdf in enumerate(added or []):
        totals[f"t{k}"] = totals["one"].copy()
        for g in map(unbundle, pdf["data"]):
            totals[f"t{k}"][np.searchsorted(names, g["contexts"])] += g["t"].astype(np.int64)
    totals = {k: x[at] for k, x in totals.items()}
    edge = np.r_[0, np.cumsum([len(g["contexts"]) for g in got])]
    return rows([(0, int(b), int(p), bundle(**{k: v[edge[i] : edge[i + 1]] for k, v in totals.items()})) for i, (b, p) in enumerate(zip(asked["bucket"], asked["part"], strict=True))])


def answered(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Answers of all parts to a bucket, in the order of by_part."""
    got = [unbundle(d) for d in pdf.sort_values("part")["data"]]
    return {k: np.concatenate([g[k] for g in got]) for k in got[0]}


# ---------------------------------------------------------------- passes


@dataclass
class Sums:
    """What the driver knows: sums over all buckets, and of each frequent word (by number of sample)."""

    heavy: np.ndarray
    n: float = 0.0  # training tokens, their distinct words
    v: float = 0.0
    heavy_c: np.ndarray | None = None
    sweep: int = 0
    zeta: float = 0.0
    mass: float = 0.0  # of all words
    heavy_p: np.ndarray | None = None  # the parent's probabilities
    customers: np.ndarray | None = None  # of each sample: tables of all contexts; of the unigram restaurant
    tables0: np.ndarray | None = None
    heavy_t: np.ndarray | None = None  # samples x frequent words
    heavy_t0: np.ndarray | None = None


def heavy_rows(words: np.ndarray, heavy: np.ndarray, *values: np.ndarray) -> list[tuple]:
    at = np.flatnonzero(np.isin(words, heavy))
    return [(2, 0, int(np.searchsorted(heavy, words[k])), pickle.dumps([float(v[k]) for v in values], 5)) for k in at.tolist()]


def drawn(c: np.ndarray, kinds: np.ndarray, wi: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Words with anything to draw: in one context, once, a word has one table and so has its parent."""
    return hot | (kinds > 1) | (np.bincount(wi[c > 1], minlength=len(kinds)) > 0)


def count(pdf: pd.DataFrame, heavy: np.ndarray, parts: int) -> pd.DataFrame:
    """A bucket's types: sums for contexts (0), the types with two customers or more (1), words to be drawn (4), of frequent words (2), in all (3)."""
    got = [unbundle(d) for d in pdf["data"]]
    w, u, at = distinct(np.concatenate([np.repeat(g["words"], g["counts"]) for g in got]), np.concatenate([g["contexts"][g["ui"]] for g in got]))
    c = np.bincount(at, weights=np.concatenate([g["n"] for g in got])).astype(np.int64)
    del got, at
    words, wi = of_sorted(w)
    contexts, ui = by_part(u, parts)
    of_word, of_context = (lambda x: np.bincount(wi, weights=x, minlength=len(words)).astype(np.int64)), (lambda x: np.bincount(ui, weights=x, minlength=len(contexts)).astype(np.int64))
    c_word, kinds, hot = of_word(c), of_word(c > 0), np.isin(words, heavy)
    more, mine = np.flatnonzero(c > 1), drawn(c, kinds, wi, hot)
    own = np.zeros(len(contexts), bool)
    own[ui[more]] = True
    number = lambda x: np.cumsum(x) - 1
    state = bundle(own=np.flatnonzero(own), contexts=contexts[own], ui=number(own)[ui[more]], wi=number(mine)[wi[more]], c=c[more], one=of_word(c == 1)[mine])
    first = bundle(words=words[mine], n=kinds[mine], z=((kinds > 0) & ~hot)[mine].astype(np.int64))
    sums = [float(c.sum()), float((c_word[~hot] > 0).sum()), float((c_word[~mine] > 0).sum())]
    bucket = int(pdf["bucket"].iloc[0])
    return rows([*ask(bucket, contexts, parts, c=of_context(c), t=of_context(c > 0), one=of_context(c == 1)), (1, bucket, 0, state), (4, bucket, -1, first), *heavy_rows(words, heavy, c_word, kinds), (3, 0, 0, pickle.dumps(sums, 5))])


def add_masses(words: DataFrame, s: Sums) -> float:
    """The mass of all words: those of buckets, the frequent ones, those with nothing to draw and the unknown one (whose sums are drawn as one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = 0
            for g in map(unbundle, b.column(0).to_pylist()):
                light = ~np.isin(g["words"], s.heavy)
                total += int(np.rint(masses(g["words"][light], g["n"][light], g["z"][light], s.zeta, s.v, s.sweep) * UNIT).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["mass"])

    return (words.select("data").mapInArrow(run, "mass long").agg(F.sum("mass")).first()[0] or 0) / UNIT


def sweep(state: pd.DataFrame, found: pd.DataFrame, s: Sums, parts: int) -> pd.DataFrame:
    """A bucket's seating: tables for contexts (0), of types (5) and words (4), of frequent words (2), in all (3); the first time also what later sweeps need (1)."""
    if not len(state):
        return rows([])
    bucket, out = int(state["bucket"].iloc[0]), []
    answers = found[found["part"] >= 0]
    b, before = unbundle(state["data"].iloc[0]), unbundle(found[found["part"] < 0]["data"].iloc[0])
    there = answered(answers) if len(answers) else {"t": np.empty(0, np.int64)}
    words, contexts, ui, wi, c = before["words"], b["contexts"], b["ui"].astype(np.int64), b["wi"].astype(np.int64), b["c"].astype(np.int64)
    if "own" in b:
        tables, fixed = (there[k][b["own"]] for k in ("t", "one"))
        out.append((1, bucket, 0, bundle(fixed=fixed, **{k: v for k, v in b.items() if k != "own"})))
    else:
        tables = b["fixed"].astype(np.int64) + there["t"]
    hot = np.isin(words, s.heavy)
    p = np.zeros(len(words))
    p[~hot] = masses(words[~hot], before["n"][~hot], before["z"][~hot], s.zeta, s.v, s.sweep) / s.mass
    p[hot] = s.heavy_p[np.searchsorted(s.heavy, words[hot])]
    x = DISCOUNT * gamma(STRENGTH / DISCOUNT + tables, mix(contexts, np.uint64(8 * s.sweep + 4)))
    t = seat(c, x[ui] * p[wi], DISCOUNT, mix(mix(words[wi], contexts[ui]), np.uint64(8 * s.sweep + 5)), 1)[0].astype(np.int64)
    n = b["one"].astype(np.int64) + np.bincount(wi, weights=t, minlength=len(words)).astype(np.int64)
    z0 = np.zeros(len(words), np.int64)
    z0[~hot] = seat_words(n[~hot], words[~hot], s.zeta, s.v, s.sweep)
    of_context = np.bincount(ui, weights=t, minlength=len(contexts)).astype(np.int64)
    sums = [float(n[~hot].sum()), float(z0.sum())]
    return rows([*out, *ask(bucket, contexts, parts, t=of_context), (5, bucket, -1, bundle(t=t)), (4, bucket, -1, bundle(words=words, n=n, z=z0)), *heavy_rows(words, s.heavy, n), (3, 0, 0, pickle.dumps(sums, 5))])


def add_up(found: DataFrame, heavy: np.ndarray, width: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all buckets, and those of frequent words: one row from each part of a partial sum, and one for each such word."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "part": [pdf["part"].iloc[0]], "data": [pickle.dumps(np.sum([pickle.loads(d) for d in pdf["data"]], axis=0).tolist(), 5)]})

    total, of_heavy = np.zeros(own), np.zeros((width, len(heavy)))
    for r in found.where("kind in (2, 3)").groupBy("kind", "part").applyInPandas(run, "kind long, part long, data binary").collect():
        if r["kind"] == 3:
            total = np.array(pickle.loads(r["data"]))
        else:
            of_heavy[:, r["part"]] = pickle.loads(r["data"])
    return total, of_heavy


def scores(tokens: pd.DataFrame, known: pd.DataFrame, s: Sums, parts: int) -> pd.DataFrame:
    """Sums over each document's tokens in a bucket, by the batch that sent them."""
    if not len(tokens):
        return rows([])
    got = [unbundle(d) for d in tokens["data"]]
    w, u, at = distinct(np.concatenate([g["words"][g["wi"]] for g in got]), np.concatenate([g["contexts"][g["ui"]] for g in got]))
    n = np.concatenate([g["n"] for g in got]).astype(np.int64)
    train = np.concatenate([np.repeat(g["held"] == 0, g["counts"]) for g in got])
    c = np.bincount(at, weights=n * train, minlength=len(w))
    words, wi = of_sorted(w)
    ui = by_part(u, parts)[1]
    there = answered(known[known["part"] >= 0])
    mine = {int(k): unbundle(d) for k, d in known[known["part"] < 0][["kind", "data"]].itertuples(index=False)}
    kinds = np.bincount(wi, weights=c > 0, minlength=len(words))
    c_word, more, hot = np.bincount(wi, weights=c, minlength=len(words)), c > 1, np.isin(words, s.heavy)
    own = drawn(c, kinds, wi, hot)
    at_heavy = np.searchsorted(s.heavy, words[hot])
    if hot.any():
        c_word[hot] = s.heavy_c[at_heavy]
    p = np.zeros(len(w))
    samples = len(s.customers)
    for k in range(samples):
        t = (c > 0).astype(float)
        t[more] = mine[10 * k + 5]["t"]
        customers, tables0 = kinds.copy(), kinds.copy()
        customers[own], tables0[own] = (mine[10 * k + 4][name] for name in ("n", "z"))
        if hot.any():
            customers[hot], tables0[hot] = s.heavy_t[k, at_heavy], s.heavy_t0[k, at_heavy]
        parent = (np.maximum(customers - DISCOUNT0 * tables0, 0) + (STRENGTH0 + DISCOUNT0 * s.tables0[k]) / (s.v + 1)) / (STRENGTH0 + s.customers[k])
        p += (np.maximum(c - DISCOUNT * t, 0) + (STRENGTH + DISCOUNT * there[f"t{k}"][ui]) * parent[wi]) / (STRENGTH + there["c"][ui])
    log_p, log_c, seen = (np.log10(p / samples)[at] * n), np.log10(c_word + 0.1)[wi][at] * n, (c_word > 0)[wi][at] * n
    out, edge = [], np.r_[0, np.cumsum([len(g["n"]) for g in got])]
    for i, (g, flush) in enumerate(zip(got, tokens["part"], strict=True)):
        own, first = slice(edge[i], edge[i + 1]), np.r_[0, np.cumsum(g["counts"].astype(np.int64))[:-1]]
        add = lambda x: np.add.reduceat(x[own], first)  # noqa: E731, B023
        more_ = {"ids": g["ids"]} if "ids" in g else {}
        out.append((0, 0, int(flush), bundle(docs=g["docs"], n=add(n), seen=add(seen), base=add(log_c), score=add(log_p), **more_)))
    return rows(out)


def finish(pdf: pd.DataFrame, n: float, v: float) -> pd.DataFrame:
    """A batch's documents."""
    got = [unbundle(d) for d in pdf["data"]]
    ids = next(g["ids"] for g in got if "ids" in g).view(np.int64).tolist()
    docs = np.concatenate([np.cumsum(g["docs"].astype(np.int64)) for g in got])
    total = lambda name: np.bincount(docs, weights=np.concatenate([g[name] for g in got]), minlength=len(ids))
    tokens = total("n")
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if i == NO_ID else i for i in ids], "Int64"),
            "held_out": [i != NO_ID and held_out(i) for i in ids],
            "n_tokens": tokens.astype(np.int64),
            "n_known": total("seen").astype(np.int64),
            "train_tokens": int(n),
            "base_score": total("base") - tokens * np.log10(n + 0.1 * (v + 1)),
            "score": total("score"),
        }
    )


def frequent(docs: DataFrame, rows_: int, buckets: int, sample: int = LAYOUT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that may be too many for one bucket, and over how many to spread each, by a sample of about `sample` documents chosen by hash.

    Counted in tasks; only words over the share come back, at most eight for each bucket. Scores don't depend on them.
    """
    share = max(1, rows_ // sample)
    some = texts(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            words, n = np.unique(np.concatenate([np.append(hashes(byte_words(t, True)), END) for t in each(b.column(1))] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = cut(some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = counts.where(F.col("n") > max(5, total / buckets / 8)).orderBy(F.desc("n"), "word").limit(8 * buckets)  # layout alone
    got = sorted((r["word"] % (1 << 64), min(buckets, int(np.ceil(8 * buckets * r["n"] / total)))) for r in many.collect())
    return np.array([w for w, _ in got], np.uint64), np.array([n for _, n in got], np.uint64)


def language_model(docs: DataFrame, buckets: int | None = None, heavy: np.ndarray | None = None, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every row.

    buckets and heavy lay the work out; by default they follow the input's bytes and its frequent words. samples: of the sweeps, how many of the last count.
    """
    size, n_rows = texts(docs).agg(F.sum(F.octet_length("text")), F.count("*")).first()
    buckets = buckets or max(64, int(np.ceil((size or 0) / TOKEN_BUCKET)))
    heavy, spread = frequent(docs, n_rows, buckets) if heavy is None else (np.sort(heavy), np.full(len(heavy), 3, np.uint64))
    s = Sums(heavy)
    parts = max(8, buckets // 8)

    counted = cut(deal(docs, buckets, s.heavy, spread, False).groupBy("bucket").applyInPandas(lambda p: count(p, s.heavy, parts), ROW))
    (s.n, s.v, alone), (s.heavy_c, heavy_n) = add_up(counted, s.heavy, 2, 3)
    heavy_z = (heavy_n > 0).astype(float)
    tables0, s.v = s.v + heavy_z.sum(), s.v + heavy_z.sum()  # to begin with, a table for each word; and for each word and context
    state, found = counted.where("kind = 1"), counted
    kept: list[tuple[DataFrame, float, float, np.ndarray, np.ndarray]] = []
    for k in range(1, sweeps + 1):
        one = lambda n: mix(np.array([END]), np.uint64(8 * k + n))  # noqa: E731, B023
        s.sweep, s.zeta = k, float(gamma(np.array([STRENGTH0 / DISCOUNT0 + tables0]), one(6))[0])
        of_heavy = np.where(heavy_n > 0, masses(s.heavy, heavy_n, heavy_z, s.zeta, s.v, k), 0)
        rest = gamma(np.array([(1 - DISCOUNT0) * alone]), one(7)) + inverse_gauss(s.zeta * (alone + 1) / (s.v + 1), one(0))
        s.mass = add_masses(found.where("kind = 4"), s) + float(of_heavy.sum() + rest[0])
        s.heavy_p = of_heavy / s.mass
        given = Sums(**vars(s))
        answers = found.where("kind = 0").groupBy("part").applyInPandas(lambda p: answer(p), ROW).unionByName(found.where("kind = 4"))
        found = cut(state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(lambda a, b: sweep(a, b, given, parts), ROW))  # noqa: B023
        if k == 1:
            state = found.where("kind = 1")
        (customers, tables0), (heavy_n,) = add_up(found, s.heavy, 1, 2)
        heavy_z = seat_words(heavy_n.astype(np.int64), s.heavy, s.zeta, s.v, k)
        customers, tables0 = customers + alone + heavy_n.sum(), tables0 + alone + heavy_z.sum()
        if k > sweeps - samples:
            kept.append((found, customers, tables0, heavy_n, heavy_z))
    s.customers, s.tables0, s.heavy_t, s.heavy_t0 = (np.stack([x[i] for x in kept]) for i in range(1, 5))

    asked = counted.where("kind = 0")
    labelled = [x[0].withColumn("kind", F.col("kind") + 10 * k) for k, x in enumerate(kept)]
    tables = everything([x.where(F.col("kind") % 10 == 0) for x in labelled])
    split = lambda pdf: [pdf[pdf["kind"] == 10 * k] for k in range(samples)]
    after = asked.groupBy("part").cogroup(tables.groupBy("part")).applyInPandas(lambda a, b: answer(a, split(b)), ROW)
    known = everything([after, *[x.where("kind % 10 in (4, 5)") for x in labelled]])
    part = deal(docs, buckets, s.heavy, spread, True).groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(lambda a, b: scores(a, b, s, parts), ROW)
    n, v = s.n, s.v
    return part.groupBy("part").applyInPandas(lambda p: finish(p, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def everything(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return language_model(table(spark, sf_dir, "documents"))
