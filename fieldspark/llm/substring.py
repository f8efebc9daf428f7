"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words of one document. Recurring passages are confirmed first: all windows' 64-bit hashes
meet by hash value, and where one value occurs again, each later occurrence (by document id, then start) is traced to the
first. Runs of later occurrences that follow one first occurrence word by word make a passage. The passages are dealt to the
buckets of the documents that hold them; there each distinct one is put once into shards of bounded size, which are compiled
into Aho-Corasick automata (pyahocorasick), and every document of the bucket, whether hashes told of it or not, is streamed
through them; each occurrence that isn't the passage's first is cut out.

Nulls and empty texts have no words; texts of any length are searched whole; an empty table gives no rows. Repeated rows (same id, same text) are one document: no row is cut because of the other;
windows at the same start of rows that share an id count as one occurrence. Null ids come last in the order of documents.
Two windows are taken as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import ngram_hashes, table
from fieldspark.llm.packed import NO_ID, byte_words, hash_bits, pack_hashes, pack_texts, runs, size_of, text_buckets, undeltas, unpack_keys, unpack_texts, unz, wide, z

WINDOW = 20
#: Characters of passages in one automaton.
SHARD = 3 << 20
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) s FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) r FROM g) WHERE r > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) p FROM late),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) t, count(*) n FROM (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p FROM w) x ANTI JOIN cut ON cut.doc_id = x.doc_id AND cut.p = x.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def later_windows(pdf: pd.DataFrame, width: int, buckets: int) -> pd.DataFrame:
    """Of a bucket's windows those that have occurred earlier, with the first occurrence; packed by document bucket."""
    key, ids, start, h = [], [], [], []
    for i, tag, c, hs, st in zip(pdf["ids"], pdf["tags"], pdf["counts"], pdf["hashes"], pdf["starts"], strict=True):
        n = unz(c, np.uint32)
        own, ident = unpack_keys(i, tag)
        key.append(np.repeat(own, n))
        ids.append(np.repeat(ident, n))
        h.append(wide(hs, width))
        start.append(undeltas(unz(st, np.uint32), n))
    h = np.concatenate(h)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    again = np.r_[False, hs[1:] == hs[:-1]]
    order = order[again | np.r_[again[1:], False]]
    if not len(order):
        return pd.DataFrame({c: [] for c in LATER})
    key, ids, start = np.concatenate(key)[order], np.concatenate(ids)[order], np.concatenate(start)[order]
    h = h[order]
    order = np.lexsort((start, ids, h))
    key, ids, start, h = key[order], ids[order], start[order], h[order]
    new = np.r_[True, h[1:] != h[:-1]]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = (ids != ids[first]) | (start != start[first])
    key, start, fid, fstart = key[late], start[late], ids[first][late], start[first][late]
    which = key % np.uint64(buckets)
    order = np.lexsort((start, key, which))
    which, key, start, fid, fstart = which[order], key[order], start[order], fid[order], fstart[order]
    out = [{"dbucket": int(which[s]), "keys": z(key[s:e]), "starts": z(start[s:e].astype(np.uint32)), "first_ids": z(fid[s:e]), "first_starts": z(fstart[s:e].astype(np.uint32))} for s, e in runs(which)]
    return pd.DataFrame(out, columns=list(LATER))


LATER = ("dbucket", "keys", "starts", "first_ids", "first_starts")


def passages(late: pd.DataFrame) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each row key its passages: start, windows, id and start of the first occurrence."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    if not len(late):
        return out
    key, start, fid, fstart = (np.concatenate([unz(b, kind) for b in late[c]]) for c, kind in zip(LATER[1:], (np.uint64, np.uint32, np.int64, np.uint32), strict=True))
    start, fstart = start.astype(np.int64), fstart.astype(np.int64)
    order = np.lexsort((start, key))
    key, start, fid, fstart = key[order], start[order], fid[order], fstart[order]
    same = np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1])]  # a repeated row's windows come twice
    key, start, fid, fstart = key[same], start[same], fid[same], fstart[same]
    new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (fid[1:] != fid[:-1]) | (fstart[1:] != fstart[:-1] + 1)]
    edge = np.flatnonzero(new)
    for s, n in zip(edge.tolist(), np.diff(np.r_[edge, len(key)]).tolist(), strict=True):
        out.setdefault(int(key[s]), []).append((int(start[s]), n, int(fid[s]), int(fstart[s])))
    return out


def strip(docs: pd.DataFrame, late: pd.DataFrame, window: int):
    """doc_id, words, and a mask of the words that stay, of every document of a bucket.

    Each distinct passage is put into one shard; shards are compiled one after the other, and every document is streamed
    through each.
    """
    import ahocorasick

    found = passages(late)
    rows = [(NO_ID if i is None else i, i, byte_words(t, False)) for _, i, t in unpack_texts(docs)]
    known: dict[str, int] = {}
    firsts: list[tuple[int, set[tuple[int, int]]]] = []
    for (key, _, _), (_, _, w) in zip(unpack_texts(docs), rows, strict=True):
        for start, n, fid, fstart in found.get(key, ()):
            at = known.setdefault(phrase(w[start : start + n + window - 1]), len(firsts))
            if at == len(firsts):
                firsts.append((n + window - 1, set()))
            firsts[at][1].add((fid, fstart))
    masks = [np.ones(len(w), bool) for _, _, w in rows]
    for shard in shards(known):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for text in shard:
            automaton.add_word(text, known[text])
        automaton.make_automaton()
        for (own, _, w), keep in zip(rows, masks, strict=True):
            ends = None
            for last, at in automaton.iter(phrase(w)):
                if ends is None:  # the place of each word's last character
                    ends = np.cumsum([len(x.decode("utf-8", "surrogatepass")) + 1 for x in w])
                n, first = firsts[at]
                start = int(np.searchsorted(ends, last)) + 1 - n
                if (own, start) not in first:
                    keep[start : start + n] = False
        del automaton
    for (_, i, w), keep in zip(rows, masks, strict=True):
        yield i, w, keep


def shards(known: dict[str, int]) -> Iterator[list[str]]:
    """Passages in lists of about SHARD characters, so that an automaton's size is bounded but for one longer passage."""
    some, held = [], 0
    for text in known:
        some.append(text)
        held += len(text)
        if held >= SHARD:
            yield some
            some, held = [], 0
    if some:
        yield some


def phrase(w: list[bytes]) -> str:
    """Words as a string in which a match begins and ends with whole words."""
    return " " + b" ".join(w).decode("utf-8", "surrogatepass") + " "


def strip_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (digest=True: their SHA-256)."""
    total = size_of(docs)
    bits, buckets = hash_bits(total), text_buckets(total)
    width = 8 - bits // 8

    def grams(h: np.ndarray):
        g = ngram_hashes(h, window)
        return g, np.arange(len(g))

    hashes = pack_hashes(docs, grams, False, bits, width)
    late = hashes.groupBy("bucket").applyInPandas(lambda pdf: later_windows(pdf, width, buckets), "dbucket long, keys binary, starts binary, first_ids binary, first_starts binary")
    last = "kept_sha256" if digest else "kept"

    def cut(texts_: pd.DataFrame, late_: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, w, keep in strip(texts_, late_, window):
            kept = b" ".join([x for x, k in zip(w, keep.tolist(), strict=True) if k])
            out.append((i, len(w), int(len(w) - keep.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame({"doc_id": pd.array([r[0] for r in out], "Int64"), "n_words": [r[1] for r in out], "n_removed": [r[2] for r in out], last: [r[3] for r in out]})

    packed = pack_texts(docs, buckets)
    return packed.groupBy("dbucket").cogroup(late.groupBy("dbucket")).applyInPandas(cut, f"doc_id long, n_words long, n_removed long, {last} string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats cut out of every document."""
    return strip_repeats(table(spark, sf_dir, "documents"), digest=True)
