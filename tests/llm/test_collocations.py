"""Count transducers and collocations against brute force, with ranges and shards of any size."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldspark.llm import collocations as C
from fieldspark.llm.automaton import Automaton, pack, summed, unpack

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, home string, f string"


def sequences(r, n):
    return [tuple(r.choice([b"a", b"b", b"c", b"dd", b"\xc3\xa9"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def summing(found, width=4):
    words = sorted({w for s in found for w in s})
    columns = [np.array([words.index(s[k]) + 1 if k < len(s) else 0 for s in found]) for k in range(width)]
    keys, _, total = summed(pack(columns, len(words) + 1))
    return Automaton.build(words, unpack(keys, len(words) + 1, width), total)


def weights(a):
    return {s: w for d, (_, _, ws) in enumerate(a.levels) for s, w in zip(a.sequence(d, np.arange(len(ws))), ws.tolist(), strict=True)}


def test_transducers_hold_prefix_counts_and_add_up():
    r = random.Random(2)
    parts = [sequences(r, n) for n in (1, 40, 300)]
    autos = [Automaton.load(summing(p).dump()) for p in parts]
    for p, a in zip(parts, autos, strict=True):
        assert weights(a) == Counter(s[:k] for s in p for k in range(1, len(s) + 1))
    both = Automaton.union(autos, 4)
    assert weights(both) == Counter(s[:k] for p in parts for s in p for k in range(1, len(s) + 1))
    asked = Automaton.of({(b"a",): 1, (b"a", b"zz"): 1, (b"dd", b"a"): 1})
    got = {s: (weights(both).get(s), int(m)) for d, met in enumerate(asked.compose(both)) for s, m in zip(asked.sequence(d, np.arange(len(met))), met, strict=True)}
    assert all((w is None) == (m < 0) for w, m in got.values()) and got[(b"a", b"zz")][1] == -1


@pytest.mark.parametrize("symbols,width", [(3, 6), (1 << 20, 6), (1 << 25, 6), (1 << 31, 6)])
def test_keys_sort_as_rows(symbols, width):
    g = np.random.default_rng(1)
    columns = [g.integers(0, symbols + 1, 500) for _ in range(width)]
    keys = pack(columns, symbols)
    assert all((a == b).all() for a, b in zip(unpack(keys, symbols, width), columns, strict=True))
    order = np.lexsort(tuple(keys[::-1]))
    rows = list(zip(*[c.tolist() for c in columns], strict=True))
    assert [rows[k] for k in order] == sorted(rows)


def brute(rows, most, least, absorb, top):
    f: dict = {}
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, most + 1):
                    if i + k <= len(w):
                        key = (lang, tuple(w[i : i + k]))
                        f[key] = f.get(key, 0) + 1
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, w), a in cand.items():
        around = [v for (x, y), v in cand.items() if x == lang and len(y) > len(w) and any(y[i : i + len(w)] == w for i in range(len(y)))]
        if any(100 * v >= absorb * a for v in around):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, n[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, total, -score))
    return ranked


@pytest.mark.parametrize("most,least,absorb,top,range_bytes,shard", [(5, 3, 100, 2000, 300, 200), (5, 3, 100, 2000, 8 << 20, 1 << 20), (3, 5, 60, 4, 1000, 50), (2, 1, 100, 10, 500, 1000)])
def test_collocations_agree_with_brute_force(spark, monkeypatch, most, least, absorb, top, range_bytes, shard):
    monkeypatch.setattr(C, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "SAMPLE_BYTES", 200)
    r = random.Random(most)
    vocabulary = ["The", "the", "of", "house", "é", "x" * 90, "river-boat", "\x1f", "a b", "“q”"]
    rows = []
    for k in range(120):
        words = [r.choices(vocabulary, [9, 5, 5, 2, 1, 1, 1, 1, 1, 1])[0] + r.choice(["", "", "", ".", ",", "!\n"]) for _ in range(r.randint(0, 30))]
        rows.append((k if k % 7 else None, r.choice([" ", "  ", "\t"]).join(words), r.choice(["en", "en", "de", None, "und", ""])))
    rows += [(1, None, "en"), (2, "", None), (3, " . ,, \n", "en"), (4, "new york " * 300, "en"), (5, "a" * 3000, "fr")] + [(6, "same text, the same text", "en")] * 20
    docs = spark.createDataFrame([(*x, "p", "n", "h", "f") for x in rows], SCHEMA).repartition(4)
    got = C.collocations(docs, most, least, absorb, top)
    assert sorted(map(tuple, got.collect())) == sorted(brute([(lang, t) for _, t, lang in rows], most, least, absorb, top))


def test_scores_pass_64_bits():
    a, n = 10**12, 10**14
    assert 1000 * a * n > 2**63  # the arithmetic is that of integers of any size
    part = Automaton.of({(b"en",): n, (b"en", b"new"): a, (b"en", b"york"): a, (b"en", b"new", b"york"): a})
    back = Automaton.load(part.dump())
    assert weights(back)[(b"en", b"new", b"york")] == a


def test_empty_table_and_texts_without_words(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, "", "", "", ""), (2, " ", "en", "", "", "", "")], SCHEMA)).count() == 0
