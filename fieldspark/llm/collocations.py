"""Collocations: phrases whose words come together more often than their parts would, by weighted acyclic automata.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and these into words at blanks and tabs. Each place of a piece gives
one sequence, its language and the next `most` words (fewer at a piece's end), so the weight of a prefix of sequences is the
number of occurrences of a phrase, and that of the language alone is the number of words.

1. A task sorts the sequences of its shard, builds count transducers from them incrementally, and cuts the sorted order into
   prefix ranges, whose bounds are quantiles of a sample of sequences; the bounds decide the layout alone.
2. The transducers of a range are united and their weights summed. A prefix whose sequences go over a bound is told by all
   its ranges and added up. Phrases seen `least` times stay.
3. Parts of phrases are looked up by composition: a range collects the distinct parts of its candidates in an acceptor for
   each range that holds such parts; there it is composed with that range's count transducer, and the weights go back. A part
   so is asked for once by a range, however many phrases share it. With the parts goes the largest weight of a candidate one
   word longer, which tells whether a phrase is contained in a longer one as frequent.
4. Scores are computed in integers of any size; a range keeps its first `top` of each language, and these are ranked.

No word, phrase or language makes a range large: a shard tells each distinct sequence once, and bounds lie between sequences.

A null language is `und`; null and empty texts have no words; a text without an id counts as any other; repeated rows count as
often as they come; texts of any length count whole; an empty table gives no rows; other columns are not read. Ties of the
score are broken by count, then phrase in the order of its UTF-8 bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.automaton import Automaton, pack, summed
from fieldspark.llm.common import cut, each, table

MOST, LEAST, ABSORB, TOP = 5, 100, 100, 2000
#: Bytes of text for a range, and the most ranges there are.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 18
#: The sample that bounds are taken from: bytes of text and sequences for each range.
SAMPLE_BYTES, SAMPLES = 64 << 10, 8
#: Words of one shard, sorted at a time.
SHARD = 1_500_000
#: Bytes of a bound's word.
BOUND_WORD = 64
NO_LANGUAGE = "und"
END = b"\xff"  # in no UTF-8
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz" + END * len(_SEPARATORS))
Part = tuple[bytes, ...]  # a language and words


def rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


class Shard:
    """Sequences of some texts."""

    def __init__(self, most: int):
        self.most = most
        self.number: dict[bytes, int] = {END: 0}
        self.parts: list[np.ndarray] = []
        self.langs: list[int] = []
        self.held = 0

    def add(self, lang: str, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(END, b" " + END + b" ").split()
        if not words:
            return
        number = self.number
        add = number.setdefault
        self.langs.append(add(lang.encode("utf-8", "surrogatepass"), len(number)))
        self.parts.append(np.array([add(w, len(number)) for w in words] + [0], np.int32))
        self.held += len(words)

    def sequences(self) -> tuple[list[bytes], list[np.ndarray]]:
        """Sorted words, and a column of symbols plus one (0 past the end) for the language and each word."""
        names = list(self.number)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        symbol = np.zeros(len(names), np.int32)
        symbol[order] = np.arange(1, len(names), dtype=np.int32)
        flat = symbol[np.concatenate(self.parts)] if self.parts else np.zeros(0, np.int32)
        lang = np.repeat(symbol[np.array(self.langs, np.int64)], [len(p) for p in self.parts])
        at = np.flatnonzero(flat)
        flat = np.r_[flat, np.zeros(self.most, np.int32)]
        columns = [lang[at], flat[at]]
        for k in range(1, self.most):
            columns.append(np.where(columns[-1] > 0, flat[at + k], 0).astype(np.int32))
        return [names[k] for k in order], columns


def lower(keys: list[np.ndarray], bound: list[int]) -> int:
    """Where the first row not less than bound lies."""
    lo, hi = 0, len(keys[0])
    for key, b in zip(keys, bound, strict=True):
        lo, hi = lo + int(np.searchsorted(key[lo:hi], np.uint64(b), "left")), lo + int(np.searchsorted(key[lo:hi], np.uint64(b), "right"))
    return lo


def cuts(keys: list[np.ndarray], words: list[bytes], bounds: list[Part], width: int) -> list[int]:
    """Where each range's sequences begin, and the end."""
    out = [0]
    for bound in bounds:
        code = []
        for w in bound:
            k = bisect_left(words, w)
            code.append(k + 1)
            if k == len(words) or words[k] != w:
                break  # all sequences from the next greater word on
        code += [0] * (width - len(code))
        out.append(lower(keys, [int(k[0]) for k in pack([np.array([c]) for c in code], len(words) + 1)]))
    return [*out, len(keys[0])]


def transducers(docs: DataFrame, bounds: list[Part], most: int) -> DataFrame:
    """home, counts: count transducers of each shard's prefix ranges."""

    def flush(shard: Shard) -> pa.RecordBatch:
        words, columns = shard.sequences()
        keys, at, weights = summed(pack(columns, len(words) + 1))
        edges = cuts(keys, words, bounds, most + 1)
        out = []
        for home, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            if s < e:
                own = [c[at[s:e]] for c in columns]
                used = np.zeros(len(words) + 1, bool)
                for c in own:
                    used[c] = True
                used[0] = False
                few = np.cumsum(used) * used
                out.append({"home": home, "counts": Automaton.build([words[k - 1] for k in np.flatnonzero(used).tolist()], [few[c] for c in own], weights[s:e]).dump()})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("home", pa.int32()), ("counts", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(most)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                shard.add(lang, text)
                if shard.held >= SHARD:
                    yield flush(shard)
                    shard = Shard(most)
        if shard.held:
            yield flush(shard)

    return docs.mapInArrow(run, "home int, counts binary")


def range_bounds(docs: DataFrame, most: int) -> list[Part]:
    """Bounds between ranges, from a sample of texts. They pass through the driver: at most MOST_RANGES of some words each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, -(-total // RANGE_BYTES))
    if ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLE_BYTES / total)
    stride = max(1, int(share * total / 8 / (ranges * SAMPLES)))  # words are taken to have some eight bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                shard = Shard(most)
                shard.add(lang, text)
                words, columns = shard.sequences()
                n = len(columns[0])
                picked = np.arange(-passed % stride, n, stride)
                passed += n
                found = [[words[c[p] - 1][:BOUND_WORD] for c in columns if c[p] > 0] for p in picked.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], ["bound"])

    sample = docs if share >= 1.0 else docs.sample(share, seed=5)
    found = sorted(tuple(bytes(w) for w in r.bound) for r in sample.mapInArrow(run, "bound array<binary>").collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


FOUND = "home int, lang string, phrase string, m int, f long"


def said(home: int, part: Part, f: int) -> tuple:
    return home, part[0].decode("utf-8", "surrogatepass"), b" ".join(part[1:]).decode("utf-8", "surrogatepass"), len(part) - 1, f


def part_of(lang: str, phrase: str) -> Part:
    return (lang.encode("utf-8", "surrogatepass"), *phrase.encode("utf-8", "surrogatepass").split(b" ")) if phrase else (lang.encode("utf-8", "surrogatepass"),)


def frame(found: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(found, columns=names, dtype=object)


def count_phrases(docs: DataFrame, bounds: list[Part], most: int, least: int) -> DataFrame:
    """home, lang, phrase, m (words), f: phrases of up to `most` words that occur `least` times; m = 0: all words of a language."""

    def unite(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = Automaton.union([Automaton.load(b) for b in pdf["counts"]], most + 1)
        home = int(key[0])
        edge = [b for b in bounds[max(0, home - 1) : home + 1] if b]
        shared = Automaton.of({b[:k]: 1 for b in edge for k in range(1, len(b) + 1)}).compose(counts) if edge else []
        out = []
        for d, (_, _, weights) in enumerate(counts.levels):
            told = weights >= least
            if d < len(shared):
                told[shared[d][shared[d] >= 0]] = True  # sequences of these prefixes may lie in the ranges next to it
            at = np.flatnonzero(told)
            out += [said(bisect_right(bounds, part), part, f) for part, f in zip(counts.sequence(d, at), weights[at].tolist(), strict=True)]
        return frame(out, FOUND)

    told = transducers(docs, bounds, most).groupBy("home").applyInPandas(unite, FOUND)
    return told.groupBy("home", "lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def weights_of(pdf: pd.DataFrame) -> dict[Part, int]:
    return {part_of(lang, phrase): f for lang, phrase, f in zip(pdf["lang"], pdf["phrase"], pdf["f"].tolist(), strict=True)}


def asked(own: dict[Part, int], bounds: list[Part]) -> dict[int, dict[Part, int]]:
    """By range the parts of its candidates, each with the largest weight of a candidate one word longer (else 0)."""
    parts: dict[Part, int] = {}
    for phrase, f in own.items():
        lang, words = phrase[:1], phrase[1:]
        if len(words) < 2:
            continue
        parts.setdefault(lang, 0)
        for k in range(1, len(words)):
            for part in (lang + words[:k], lang + words[k:]):
                longer = f if len(part) == len(words) else 0
                parts[part] = max(parts.get(part, 0), longer)
    out: dict[int, dict[Part, int]] = {}
    for part, longer in parts.items():
        out.setdefault(bisect_right(bounds, part), {})[part] = longer
    return out


def by_depth(parts) -> list[Part]:
    """In the order of an automaton's states."""
    return sorted(parts, key=lambda p: (len(p), p))


def scored(found: DataFrame, bounds: list[Part], absorb: int, top: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer phrase absorbs; the first `top` of each range and language."""

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = asked(weights_of(pdf), bounds)
        return frame([(home, int(key[0]), Automaton.of({p: 1 + longer for p, longer in parts.items()}).dump()) for home, parts in wanted.items()], "home int, source int, parts binary")

    def answer(key: tuple, pdf: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
        own = weights_of(pdf)
        counts = Automaton.of(own)
        longest = [np.zeros(len(w), np.int64) for _, _, w in counts.levels]
        out = []
        for source, data in zip(requests["source"].tolist(), requests["parts"], strict=True):
            acceptor, told = Automaton.load(data), []
            for d, met in enumerate(acceptor.compose(counts)):
                want = acceptor.levels[d][2]
                at = np.flatnonzero(want)
                state = met[at]
                told.append(np.where(state >= 0, counts.levels[d][2][state] if d < len(counts.levels) else 0, 0))
                if d < len(counts.levels):
                    there = state >= 0
                    np.maximum.at(longest[d], state[there], want[at][there] - 1)
            out.append((source, int(key[0]), squeezed(told)))
        own_weights = [w for _, _, w in counts.levels]
        out.append((int(key[0]), -1, squeezed([c[w > 0] for c, w in zip(longest, own_weights, strict=True)])))
        return frame(out, "home int, source int, weights binary")

    def score(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        own = weights_of(pdf)
        wanted = asked(own, bounds)
        f: dict[Part, int] = {}
        longer: dict[Part, int] = {}
        for source, data in zip(replies["source"].tolist(), replies["weights"], strict=True):
            into, names = (longer, own) if source < 0 else (f, wanted[source])
            into.update(zip(by_depth(names), np.frombuffer(zstandard.decompress(data), np.int64).tolist(), strict=True))
        best: dict[bytes, list[tuple]] = {}
        for phrase, a in own.items():
            lang, words = phrase[:1], phrase[1:]
            if len(words) < 2 or (longer[phrase] and 100 * longer[phrase] >= absorb * a):
                continue
            n = f[lang]
            parts = [(f[lang + words[:k]], f[lang + words[k:]]) for k in range(1, len(words))]
            value, _, left, right = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(parts))
            best.setdefault(lang[0], []).append((-value, -a, b" ".join(words), left, right, n))
        out = []
        for lang, some in best.items():
            name = lang.decode("utf-8", "surrogatepass")
            out += [(name, p.decode("utf-8", "surrogatepass"), -a, left, right, n, -value) for value, a, p, left, right, n in sorted(some)[:top]]
        return frame(out, SCORED)

    home = found.groupBy("home")
    requests = home.applyInPandas(ask, "home int, source int, parts binary")
    replies = home.cogroup(requests.groupBy("home")).applyInPandas(answer, "home int, source int, weights binary")
    return home.cogroup(replies.groupBy("home")).applyInPandas(score, SCORED)


SCORED = "lang string, phrase string, a long, l long, r long, n long, score long"


def squeezed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.compress(np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64).tobytes(), 1)


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, absorb: int = ABSORB, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `most` words that occur `least` times.

    a is the phrase's count, l and r those of its parts at the cut of least score (the first such cut), n all words of the
    language, score floor(1000 a n / (l r)). A phrase within a longer one that has `absorb` percent of its count is left out.
    """
    if most < 2 or least < 1 or not 0 < absorb <= 100:
        raise ValueError("phrases have two words, occur once and are absorbed by 1 to 100 percent, at least")
    docs = rows(docs, text_col, lang_col)
    bounds = range_bounds(docs, most)
    found = cut(count_phrases(docs, bounds, most, least))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = scored(found, bounds, absorb, top)
    # the first of each language among those of some ranges, then among all
    some = F.pmod(F.xxhash64("phrase"), F.lit(max(1, int(len(bounds) ** 0.5))))
    first = first.withColumn("some", some).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "some").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () piece, lang, regexp_extract_all(t, '[^\x20\x09]+') ws FROM (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) t FROM documents)),
places AS (SELECT lang, ws, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) i FROM pieces),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') phrase FROM places, range(1, 6) k(m) WHERE i + m - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) n FROM places GROUP BY 1),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') ws FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.f a, k, array_to_string(ws[1:k], ' ') lp, array_to_string(ws[k + 1:], ' ') rp FROM cand c, range(1, 5) r(k) WHERE k < c.m),
s AS (SELECT c.lang, c.phrase, a, k, x.f l, y.f r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (SELECT DISTINCT lang, array_to_string(ws[i:i + q - 1], ' ') phrase, f FROM cand, range(1, 5) a(i), range(2, 5) b(q) WHERE q < m AND i + q - 1 <= m),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN subs USING (lang, phrase) WHERE 100 * subs.f >= 100 * c.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) "rank", phrase, a, l, r, n, score FROM low ANTI JOIN gone USING (lang, phrase)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations."""
    return collocations(table(spark, sf_dir, "documents"))
