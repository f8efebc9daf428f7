"""The corpus operators on a fixture with nulls, empty and long texts, ties, repeated rows and clashing columns, held against
brute force, the tokenizers library, round trips or planted cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from fieldspark.llm import bpe, decontaminate, hpy, html, jaccard, licenses, pii, quality, spotsigs, substring
from fieldspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, digest string, component_id long, bucket string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice("the of and house river stone cloud tree light water field bird road hill wind sea sand moon star rain snow leaf".split()) + (str(r.randint(0, 40)) if r.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    base = prose(r, 120)
    words = base.split()
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(words))
    far = " ".join(words[:40] + prose(r, 80).split())
    passage = prose(r, 30)
    out = [
        (1, base), (2, base.upper()), (3, near), (4, far), (5, ""), (6, None), (7, "   \n\t "), (8, "two words"), (9, "Two  words"), (10, "one"),
        (11, prose(r, 50) + " " + passage), (12, passage + " " + prose(r, 50)), (None, base), (None, None), (14, "x" * 5000), (15, "x" * 5000),
        (16, prose(r, 9000)), (17, passage + " " + passage + " é " + passage), (1, base), (18, prose(r, 20)), (19, prose(r, 19)),
    ]
    return out + [(100 + k, prose(r, r.randint(1, 60))) for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "d", 7, "b") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_jaccard_links_agree_with_brute_force(docs, rows, none):
    sets = []
    for _, t in rows:
        w = split((t or "").encode().lower().decode())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 75 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    want = sorted(((i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=str)
    assert got == want
    assert jaccard.link(none).count() == 0


def test_blocks_of_near_copies_link_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    r = random.Random(1)
    w = prose(r, 80).split()
    copies = [(k, " ".join(x if j != k else f"odd{k}" for j, x in enumerate(w))) for k in range(40)]
    got = jaccard.link(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and len(got) == 40


def test_count_tree_loses_no_pair():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 400, 60).astype(np.uint64)) for _ in range(200)] + [np.arange(k, k + 60, dtype=np.uint64) for k in range(0, 60, 3)]
    points = np.stack([np.bincount((s % 64).astype(int), minlength=64) for s in sets]).astype(np.int32)
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    for a, s in enumerate(sets):
        near = set(tree.near(points[a], len(s), 75).tolist())
        assert {b for b, q in enumerate(sets) if 100 * len(np.intersect1d(s, q)) >= 75 * len(np.union1d(s, q))} <= near


def test_one_document_of_each_group_stays(spark, docs, rows):
    kept = [r.doc_id for r in jaccard.one_of_each(spark, docs, "").collect()]
    assert sorted(k for k in kept if k is not None) == sorted({i for i, _ in rows if i not in (None, 2, 3, 9, 15)})
    assert kept.count(None) == 2


def test_texts_of_one_id_are_apart(spark, tmp_path):
    r = random.Random(7)
    base, other, free = prose(r, 60), prose(r, 60), prose(r, 60)
    rows = [(1, base), (2, base + " more"), (2, other), (3, free), (3, "é short"), (3, free)]
    kept = jaccard.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == sorted({(1, base), (2, other), (3, free), (3, "é short")})

    item = "We know that John has 12 apples and gives 5 km of them to Mary before he goes home"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = spark.createDataFrame([(4, item), (4, " ".join(f"w{k}" for k in range(30))), (5, "clean")], "doc_id long, text string")
    assert {(x.doc_id, x.reparameterised) for x in decontaminate.leaks(texts, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()} == {(4, False)}
    assert {(x.doc_id, x.text[:2]) for x in decontaminate.drop_leaks(spark, texts, str(tmp_path)).collect()} == {(4, "w0"), (5, "cl")}


def brute_strip(rows, n=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = {}, {}
    for k in order:
        i, t = rows[k]
        w, keep = split(t), [True] * len(split(t))
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            at = (i if i is not None else "null", s)
            if seen.setdefault(g, at) != at:
                keep[s : s + n] = [False] * n
        out[k] = (i, len(w), keep.count(False), hashlib.sha256(" ".join(a for a, b in zip(w, keep, strict=True) if b).encode()).hexdigest())
    return sorted(out.values(), key=str)


def test_repeats_are_cut_as_by_brute_force(docs, rows, none):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.strip_repeats(docs, digest=True).collect()), key=str)
    assert got == brute_strip(rows)
    assert substring.strip_repeats(none).count() == 0


def test_spotsigs(spark, docs, rows, none):
    import tempfile

    at = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{at}/documents.parquet")
    got = spotsigs.op1_spotsigs(spark, at).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    ids = sorted({i for i, _ in rows if i is not None})
    texts = {i: t or "" for i, t in rows if i is not None}
    for i, j in zip(ids[3:], ids[4:] , strict=False):
        t, n = texts[i], texts[j]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by[i].n_chars == len(t)
    assert by[14].fingerprint == by[15].fingerprint and by[14].near_next == 1.0
    assert by[5].fingerprint == by[6].fingerprint
    none.write.parquet(f"{at}/empty/documents.parquet")
    assert spotsigs.op1_spotsigs(spark, f"{at}/empty").count() == 0


def brute_spots(t):
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
    out = {tuple([y for y in w[k + 1 :] if y not in spotsigs.ANCHORS.split()][:2]) for k, x in enumerate(w) if x in spotsigs.ANCHORS.split()}
    return {x for x in out if len(x) == 2} or ({t} if t else set())


def test_likeness_agrees_with_brute_force_whatever_the_ids(spark, tmp_path):
    r = random.Random(8)
    ids = [*range(0, 60, 2), 10**15, 7, 7, 9, None, None]
    rows = [(i, " ".join(r.choice("the of and house river stone cloud tree is in light".split()) for _ in range(r.randint(0, 60)))) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    jaccard_of = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    spotsigs.ROWS_A_CELL = 5
    try:
        got = spotsigs.op1_spotsigs(spark, str(tmp_path)).collect()
    finally:
        spotsigs.ROWS_A_CELL = 2000
    assert len(got) == len(rows)
    by = {r_.doc_id: r_ for r_ in got}
    text = dict(rows)
    for i, j in [*zip(range(10, 58, 2), range(12, 60, 2), strict=True), (58, 10**15)]:
        t, n = text[i], text[j]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(by[i].near_edited - jaccard_of(brute_spots(t), brute_spots(edited))) < 1e-9
        assert abs(by[i].near_next - jaccard_of(brute_spots(t), brute_spots(n))) < 1e-9
        own, other = set(by[i].fingerprint.split()), set(by[j].fingerprint.split())
        assert abs(by[i].near_next - jaccard_of(own, other)) < 1e-9  # the fingerprints carry it


def test_similar_pairs_agree_with_brute_force(docs):
    sigs = {r.doc_id: set(r.spots) for r in spotsigs.fingerprints(docs).where("doc_id is not null and size(spots) > 0").collect()}
    same, reps = {}, {}
    for i in sorted(sigs):
        same.setdefault(frozenset(sigs[i]), i)
    reps = {v: set(k) for k, v in same.items()}
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(reps[a] & reps[b]) >= 75 * len(reps[a] | reps[b])}
    assert {(r.doc_a, r.doc_b) for r in spotsigs.similar_pairs(docs).collect()} == want


def test_leaks(spark, none):
    item = "We know that John has 12 apples and gives 5 km of them to Mary before he goes home"
    other = item.replace("John", "Peter").replace("12", "30").replace("Mary", "Anna")
    mixed = "A train goes 7 km to the town then 7 km back to the hills and rests"
    docs = spark.createDataFrame([(1, "Start. " + item + " and more"), (2, other), (3, "nothing at all here"), (4, None), (None, item), (5, ""), (6, mixed.replace("7 km to", "3 km to"))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, "one two", 1), (9, None, 1), (None, item, 1), (7, item, 2), (10, mixed, 1)], "item_id long, text string, at int")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 7): False, (2, 7): True}  # document 6 gives one slot value of item 10 two values
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items.where("false")).count() == 0


def test_leaks_of_short_and_numeric_items(spark):
    texts = {1: "What is the deepest lake?", 2: "Compute 12 + 7 + 5 + 3", 3: "2 + 2 = 4", 4: "Compute 1 + 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9 + 10", 5: "Add the two numbers 3 4 5 6 7 8 9 1 2 3 4 5 6 7"}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    rows = [(k, f"some foo {t} and more") for k, t in texts.items()] + [(11, "some foo Where is the deepest lake?"), (12, "Compute 12 + 7 + 5 + 4"), (13, texts[4][:-5]), (14, "so what is the deepest lake?")]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {*((k, k) for k in texts), (14, 1)}
    assert not any(r.reparameterised for r in found)


def test_licenses(spark, none):
    texts = ["Intro line.\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "He lost his driving license again and the copyright of the song is old.", "", None, "plain text without any"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = {(r.doc_id, r.family): r for r in licenses.scan(docs).collect()}
    assert {(0, "mit"), (1, "apache"), (2, "gpl"), (3, "cc-by-nc")} == set(got)
    assert all(r.confirmed and r.probability > 0.5 for r in got.values()) and got[0, "mit"].n_paragraphs == 2
    assert licenses.scan(none).count() == 0


def test_licence_lines_of_all_kinds(spark):
    from pyspark.sql import functions as F

    from fieldspark.llm.license_texts import FAMILIES, OTHER

    own = [(f, t) for f, ts in FAMILIES.items() for t in ts] + [("unknown", t) for t in OTHER]
    r = random.Random(9)
    long = " ".join(prose(r, 20) for _ in range(30))
    rows = [(k, t) for k, (_, t) in enumerate(own)] + [(1000, long + " " + FAMILIES["mit"][4] + " " + long), (1001, long), (1002, None), (None, FAMILIES["isc"][1]), (1003, "License plates of cars; you can use any of the source files in the document under public terms.")]
    rows += [(2000 + k, prose(r, 60)) for k in range(200)]  # what the class of no licence is learned from
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, family int, p string")
    model = licenses.Classifier(spark, docs)
    want = {(x.doc_id, x.family) for x in model.classify(licenses.pieces(docs)).collect()}  # sums over all lines
    got = {(x.doc_id, x.family): x for x in licenses.scan(docs).collect()}
    assert set(got) == want
    assert sum((k, f) in got for k, (f, _) in enumerate(own)) >= 0.95 * len(own)
    assert got[1000, "mit"].confirmed and got[1000, "mit"].n_paragraphs == 1 and (None, "isc") in got
    assert not any(k in (1001, 1002) for k, _ in got)
    assert docs.where(~model.undecided(F.col("text"))).count() > 0


def test_quality_learns_and_scores_all_rows(spark, docs, rows, none):
    r = random.Random(3)
    labelled = [(k, prose(r, 40) if k % 2 else " ".join(w + "###" for w in prose(r, 40).split())) for k in range(300)]
    d = spark.createDataFrame(labelled, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(d, labels)
    got = {x.doc_id: x.score for x in quality.score(d, w).collect()}
    right = [(got[k] >= 0.5) == bool(k % 2) for k in range(200, 300)]
    assert np.mean(right) > 0.95
    assert quality.score(docs, w).count() == len(rows) and quality.score(none, w).count() == 0
    assert {x.score for x in quality.score(docs, quality.train(d, labels.where("false"))).collect()} == {0.5}


def test_language_model(docs, rows, none):
    import math
    import zlib
    from collections import Counter

    toks = [(i, [*split((t or "").encode().lower().decode()), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(t), sum(w in c for w in t), n, round(sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in toks), key=str)
    out = hpy.language_model(docs).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == want
    assert all(r.score <= 1e-9 and np.isfinite(r.score) for r in out)
    assert sum(r.score for r in out if not r.held_out) > sum(r.base_score for r in out if not r.held_out)
    assert hpy.language_model(none).count() == 0


def test_scores_are_free_of_the_layout(docs):
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, round(r.score, 4), r.n_known, round(r.base_score, 8))
    want = sorted(map(key, hpy.language_model(docs).collect()))
    for other in (hpy.language_model(docs.orderBy(docs.text.desc()).repartition(5), 1), hpy.language_model(docs, 200, np.array([hpy.END], np.uint64))):
        assert sorted(map(key, other.collect())) == want


def brute_seating(pairs, sweeps, seed):
    """Gibbs over customers one by one, restaurants and parent up to date at each move; mean log10 probability of the pairs."""
    from collections import defaultdict

    r, d, s, d0, s0 = random.Random(seed), hpy.DISCOUNT, hpy.STRENGTH, hpy.DISCOUNT0, hpy.STRENGTH0
    v = len({w for _, w in pairs})
    tables, t_u, c_u = defaultdict(list), defaultdict(int), defaultdict(int)
    top, c0, t0 = defaultdict(list), 0, 0

    def parent(w):
        return (sum(x - d0 for x in top[w]) + (s0 + d0 * t0) / (v + 1)) / (s0 + c0)

    def join(sizes, dd, new):
        x = r.random() * (sum(n - dd for n in sizes) + new)
        for k, n in enumerate(sizes):
            x -= n - dd
            if x < 0:
                sizes[k] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        k = r.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    total = np.zeros(len(pairs))
    for sweep in range(sweeps):
        for u, w in pairs:
            if sweep:
                c_u[u] -= 1
                if leave(tables[u, w]):
                    t_u[u] -= 1
                    c0 -= 1
                    t0 -= leave(top[w])
            c_u[u] += 1
            if join(tables[u, w], d, (s + d * t_u[u]) * parent(w)):
                t_u[u] += 1
                t0 += join(top[w], d0, (s0 + d0 * t0) / (v + 1))
                c0 += 1
        if sweep >= sweeps // 2:
            total += [(sum(n - d for n in tables[u, w]) + (s + d * t_u[u]) * parent(w)) / (s + c_u[u]) for u, w in pairs]
    return np.log10(total / (sweeps - sweeps // 2)).mean()


def test_scores_are_near_those_of_a_brute_force_sampler(spark):
    r = random.Random(12)
    rows = [(k, " ".join(r.choice(["the", "the", "of"] + [f"w{int(r.paretovariate(0.8))}" for _ in range(3)]) for _ in range(40))) for k in range(60)]
    rows = [(i, t) for i, t in rows if not hpy.held_out(i)]
    pairs = [p for _, t in rows for p in zip([None, *t.split()], [*t.split(), ""], strict=True)]
    got = hpy.language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mean = sum(x.score for x in got) / len(pairs)
    assert abs(mean - brute_seating(pairs, 30, 1)) < 0.03 * abs(mean)


def test_the_hierarchy_is_sampled_jointly(spark):
    # with one draw, given a table for each other dish and the parent as it was, the mean is off by a hundredth
    r = random.Random(12)
    rows = [(k, " ".join(r.choice(["the", "the", "of"] + [f"w{int(r.paretovariate(0.8))}" for _ in range(3)]) for _ in range(40))) for k in range(60)]
    rows = [(i, t) for i, t in rows if not hpy.held_out(i)]
    pairs = [p for _, t in rows for p in zip([None, *t.split()], [*t.split(), ""], strict=True)]
    got = hpy.language_model(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), 4, sweeps=16, samples=10).collect()
    mean = sum(x.score for x in got) / len(pairs)
    assert abs(mean - brute_seating(pairs, 100, 1)) < 0.002 * abs(mean)


def test_random_draws_have_their_moments():
    key = np.arange(200_000).astype(np.uint64)
    for a in (0.5, 1.0, 3.0, 2500.0):
        x = hpy.gamma(np.full(len(key), a), key)
        assert abs(x.mean() / a - 1) < 0.02 and abs(x.var() / a - 1) < 0.03
        assert abs(np.exp(-x / a).mean() / (1 + 1 / a) ** -a - 1) < 0.01
        x = hpy.inverse_gauss(a, key)
        assert abs(x.mean() / (a / 2) - 1) < 0.02 and abs(x.var() / (a / 4) - 1) < 0.03
        assert abs(np.exp(-x / a).mean() / np.exp(-a * (np.sqrt(1 + 1 / a) - 1)) - 1) < 0.01
    assert (hpy.gamma(np.zeros(3), key[:3]) == 0).all()


def test_seating_keeps_to_its_customers():
    c = np.array([0, 1, 2, 5, 12, 40, 5000])
    t = hpy.seat(c, np.full(len(c), 0.5), 0.8, np.arange(len(c)).astype(np.uint64))
    assert (t[:, 0] == 0).all() and (t[:, 1] == 1).all() and (t <= c).all() and (t[:, 1:] >= 1).all()


def test_seating_is_that_of_the_exact_distribution():
    # two customers share a table by weight 1 - d, or sit apart by alpha
    n, d, alpha = 20000, 0.8, 0.3
    t = hpy.seat(np.full(n, 2), np.full(n, alpha), d, np.arange(n).astype(np.uint64))
    assert abs(t.mean() - (1 + alpha / (alpha + 1 - d))) < 0.01


def seatings(c, d):
    """What c customers at 1, 2, ... tables weigh, by the sizes of all tables of all seatings."""
    found = {(): 1.0}
    for _ in range(c):
        more = {}
        for sizes, weight in found.items():
            for k in range(len(sizes) + 1):
                now = tuple(sorted((*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]) if k < len(sizes) else (*sizes, 1)))
                more[now] = more.get(now, 0) + weight * (sizes[k] - d if k < len(sizes) else 1)
        found = more
    return np.array([sum(x for sizes, x in found.items() if len(sizes) == t + 1) for t in range(c)])


def ways(c, d):
    """The same up to a factor, for many customers, who come one after the other."""
    logs, t = np.full(c + 1, -np.inf), np.arange(c + 1)
    logs[1] = 0
    for n in range(1, c):
        logs[1:] = np.logaddexp(logs[:-1], logs[1:] + np.log(np.maximum(n - d * t[1:], 1e-300)))
    return logs[1:]


@pytest.mark.parametrize("d", [0.8, 0.5])
@pytest.mark.parametrize("c, alpha", [(7, 1.5), (30, 0.4), (300, 2.0), (1024, 9.0), (1025, 9.0), (2500, 0.5), (2500, 40.0)])
def test_all_customers_of_a_dish_are_seated_anew(c, alpha, d):
    # with a few moved customers the tables stay near those to begin with, and spread too little
    n = 3000
    t = hpy.seat(np.full(n, c), np.full(n, alpha), d, np.arange(n).astype(np.uint64))
    logs = np.log(seatings(c, d)) if c < 10 else ways(c, d)
    p = logs + np.log(alpha) * np.arange(1, c + 1)
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    got = np.bincount(t.astype(int).ravel(), minlength=c + 1)[1:] / t.size
    assert np.abs(np.cumsum(got) - np.cumsum(p)).max() < 0.025


def test_weights_of_many_customers_are_exact():
    for d, c, alpha in ((0.8, 1024, 0.3), (0.8, 1024, 60.0), (0.8, 2500, 2000.0), (0.5, 1024, 0.5), (0.5, 2500, 30.0), (0.8, 2500, 1e-12)):
        first, weight = hpy.many_customers(c, alpha, d)
        p = ways(c, d) + np.log(alpha) * np.arange(1, c + 1)
        p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
        got = np.zeros(c)
        got[first - 1 : first - 1 + len(weight)] = weight / weight.sum()
        assert np.abs(got - p).max() < 1e-9
    for c, alpha in ((10**5, 3.0), (10**8, 100.0), (10**10, 0.5)):  # for d = 1/2 the ratio of neighbours is known
        first, weight = hpy.many_customers(c, alpha, 0.5)
        t = np.arange(1.0, first + len(weight) - 1)
        logs = np.r_[0, np.cumsum(np.log(4 * alpha * (c - t) / ((2 * c - t - 1) * t)))]
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert np.abs(p[first - 1 :] - weight / weight.sum()).max() < 1e-10


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def test_base_spans_agree_with_the_patterns():
    r = random.Random(2)
    for _ in range(5000):
        t = "".join(r.choice("ab@.1+ -()%_é25") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(t) if pii.valid(k, m.group()))


def test_network_finds_spans_that_the_patterns_miss(spark, none, tmp_path):
    r, g = random.Random(5), np.random.default_rng(6)
    some = lambda k: pii.made_up(k % 4, np.random.default_rng(k), ["anna", "post", "river"])
    rows = [(k, f"{prose(r, 12)} {some(k)} {prose(r, 12)} {r.randint(1, 10**6)}") for k in range(300)]
    planted, plain = [], []
    for k in range(200):
        left = " ".join(re.sub(r"[0-9]", "", w) for w in prose(r, 15).split()) + " "
        span = pii.disguised(k % 4, pii.made_up(k % 4, g, ["anna", "tree", "mail"]), g)
        planted.append((left + span + " and more words", (len(left), k % 4, len(left) + len(span))))
        plain.append(left + pii.no_span(g) + " and more words")
    extra = [(1000, None), (1001, ""), (None, "mail me at anna@post.org"), (5, rows[5][1]), (1002, "x " * 3000 + planted[0][0])]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows + extra], "doc_id long, text string, base string, n_ip int")
    w = pii.train(docs)
    base, every = pii.spans_of([t for t, _ in planted], w)
    assert not any(x in b for (_, x), b in zip(planted, base, strict=True))
    assert np.mean([x in e for (_, x), e in zip(planted, every, strict=True)]) >= 0.85
    base, every = pii.spans_of(plain, w)
    assert sum(len(e) - len(b) for b, e in zip(base, every, strict=True)) <= 4
    assert all(set(a) <= set(b) for a, b in zip(base, every, strict=True))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op6_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(extra)
    for x in got:
        if x.doc_id in (1000, 1001):
            assert x.spans == "" and x.n_email + x.n_ip + x.n_card + x.n_phone == 0
        if x.doc_id == 7:
            assert x.base_sha256 == hashlib.sha256(pii.written(pii.base_spans(rows[7][1])).encode()).hexdigest()
    assert pii.find(none, w).count() == 0
    assert pii.mask("a 1.2.3.4 b", pii.base_spans("a 1.2.3.4 b")) == "a <ip> b"
    kept = pii.mask_private(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_the_more_central_window_decides(monkeypatch):
    text = "a" * 30 + "1" + "a" * 200
    seen = []

    def tags(s, t):
        out = np.zeros((s.shape[1], pii.WINDOW), np.int8)
        out[:, 30] = 3  # each window calls its 31st place an address
        seen.append(len(out))
        return out

    monkeypatch.setattr(pii, "viterbi", tags)
    spans = pii.tag([text], pii.start_weights())[0]
    assert seen and (30, 1, 31) in spans


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A&amp;B</h1><p>First <b>bold</b>\n text.<p>Second</article><div class=comments><p>I like this very much indeed, it is good.</p></div><footer>f</footer>"
    assert html.main_text(page) == "A&B\nFirst bold text.\nSecond"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 4 and sorted(r.text for r in got) == ["", "", html.main_text(page), html.main_text(page)]


def test_html_of_odd_markup(spark):
    assert html.main_text("<article><h1>Title</h1><p title=it's>First text of it.</p><p class=\"a>b\">Second 'quoted' one.</p></article>") == "Title\nFirst text of it.\nSecond 'quoted' one."
    assert html.main_text('<article><div class="entry-header"><h1>Big title</h1></div><p>Some text follows here.</p></article>') == "Big title\nSome text follows here."
    assert html.main_text('<div class="site-header"><p>Menu of the site</p></div><article><p>Some text follows here.</p></article>') == "Some text follows here."
    long = "<article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(20000)) + "</article>"
    assert html.main_text(long).count("\n") == 19999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


def test_bpe_agrees_with_the_tokenizers_library(docs, none):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    t, mine = Tokenizer.from_file(path), bpe.Bpe(path)
    r = random.Random(1)
    letters = "abAB'sdrelΣς éÉ̈ßİ日１² ​\x1c\x1f　\t\n!?#…ǅ👍"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["a<|endoftext|>b <|startoftext|>", "don't I'LL", "x" * 3000, ""]
    for s in texts:
        ids = t.encode(s, add_special_tokens=False).ids
        assert mine.encode(s) == (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False), len(ids))
        assert bpe.decode(ids, path) == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs, path).count() == docs.count() and bpe.encode(none, path).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (52, 51), (60, 60), (50, 51)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(31)) and got[52] == 50 and got[60] == 60
    assert components(edges.where("false")).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] and "pipeline" in __spark_entry__.queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and docs.count() == seen[-1] and seen[1] > 0.6 * seen[0]
    assert isinstance(docs.toPandas(), pd.DataFrame)


def test_labels_of_components_pass_no_driver(spark, monkeypatch):
    # rows few enough for Spark to broadcast them in every round
    from fieldspark.llm import components as C

    plans, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.range(300).selectExpr("id a", "if(id % 5 = 0, id, id - 1) b")
    assert {(r.node, r.comp) for r in C.components(edges).collect()} == {(k, k - k % 5) for k in range(300)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
