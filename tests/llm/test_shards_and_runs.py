"""Sharding and periodic runs on rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldspark.llm import runs, sharding

SCHEMA = "doc_id long, text string, shard string, slot string, n string, rank string, words string, h string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = lambda n: " ".join(r.choice("a b c dd ee".split()) for _ in range(n))
    out = [(1, "a b " * 9), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (None, "a a a a a a a"), (None, None), (7, words(4000) + " q r s" * 400), (7, "other text"), (8, "é ü é ü é ü é ü é"), (9, "a " * 3000)]
    return out + [(1, "a b " * 9)] * 40 + [(100 + k, words(r.randint(1, 60))) for k in range(60)] + [(k, words(30)) for k in range(10**15, 10**15 + 40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, *"svxyzw") for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def jump(key: int, n: int) -> int:
    """The published loop, in plain integers."""
    last, place = -1, 0
    while place < n:
        last = place
        key = (key * 2862933555777941757 + 1) % 2**64
        place = int((last + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return last


def key_of(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 40, 5000])
def test_shards_are_those_of_the_published_loop(docs, shards):
    got = sharding.assign(docs, shards).select("doc_id", "shard").collect()
    assert all(r.shard == jump(key_of(r.doc_id), shards) for r in got) and len(got) == docs.count()


def test_long_walks_go_on(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JUMPS", 1)
    got = sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), 500).collect()
    assert all(r.shard == jump(key_of(r.doc_id), 500) for r in got)


@pytest.mark.parametrize("cell", [3, 100_000])
def test_slots_have_no_gaps_and_rows_move_only_to_the_new_shard(docs, rows, none, monkeypatch, cell):
    monkeypatch.setattr(sharding, "ROWS_A_CELL", cell)
    got = sharding.slots(docs, 6).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got))) == sorted(map(str, ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)))
    for k, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    assert all(r.grown_shard == jump(key_of(r.doc_id), 7) and r.grown_shard in (r.shard, 6) for r in got)
    order = sorted(got, key=lambda r: (r.shard, hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{r.size}:{r.text_crc32}".encode()).hexdigest()))
    assert [(r.doc_id, r.size, r.shard) for r in order] == [(r.doc_id, r.size, r.shard) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sharding.slots(none).count() == 0


def test_moves_and_written_shards(spark, docs, rows, none, tmp_path, monkeypatch):
    moved = sharding.moves(docs.drop("shard"), 40, 41).collect()
    assert all(r.shard == 40 and jump(key_of(r.doc_id), 40) == r.from_shard for r in moved)
    monkeypatch.setattr(sharding, "FILE_BYTES", 1000)
    sharding.write_shards(docs.drop("shard"), f"{tmp_path}/s", 3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == len(rows) and set(back.columns) == {*docs.columns}
    assert all(r.shard == jump(key_of(r.doc_id), 3) for r in back.collect())
    sharding.write_shards(none.drop("shard"), f"{tmp_path}/none", 3)


def brute(w, least=6, turns=4):
    found, n = {}, len(w)
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, turns * q):
                found.setdefault((s, i - s + q), q)  # smaller periods come first
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,turns", [(6, 4), (3, 3), (20, 5), (9, 3)])
def test_runs_agree_with_brute_force(least, turns):
    r = random.Random(3)
    texts = [[]]
    for _ in range(150):
        w: list[int] = []
        while len(w) < r.randint(0, 200):
            part = [r.randint(0, 2) for _ in range(r.randint(1, 12))]
            w += part * r.choice([1, 1, 3, 4, 5, 9]) + part[: r.randint(0, len(part))]
        texts.append(w)
    flat = np.array([x for w in texts for x in w], np.int64)
    assert runs.find(flat, np.array([len(w) for w in texts]), least, turns) == [brute(w, least, turns) for w in texts]


def test_work_on_long_repeats_is_small():
    import time

    began = time.perf_counter()
    n = 400_000
    assert runs.find(np.zeros(n, np.int64), np.array([n])) == [[(0, n, 1)]]
    w = np.arange(n) % 50_000
    assert runs.find(w, np.array([n])) == [[(0, n, 50_000)]]
    assert time.perf_counter() - began < 30


def test_runs_of_documents(docs, rows, none, monkeypatch):
    split = lambda t: [w.decode() for w in (t or "").encode().split()]
    short = {str((i, t)): brute(split(t)) for i, t in rows if len(split(t)) < 500}
    monkeypatch.setattr(runs, "TOGETHER", 100)
    got = runs.collapse(docs).collect()
    assert len(got) == len(rows)
    left = Counter()
    for i, t in rows:
        if str((i, t)) in short:
            w, found = split(t), short[str((i, t))]
            gone = {p for s, m, q in found for p in range(s + q, s + m)}
            left[str((i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    have = Counter(str((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.kept)) for r in got)
    assert not left - have
    long = next(r for r in got if r.doc_id == 7 and r.n_words > 1000)
    assert (long.runs[-1].length, long.runs[-1].period) == (1200, 3)
    assert next(r for r in got if r.doc_id == 9).kept == "a"
    assert runs.runs(docs).count() == sum(len(r.runs) for r in got)
    assert runs.collapse(none).count() == runs.runs(none).count() == 0


def test_repeated_parts_and_digests(docs, rows):
    edited = runs.repeated(docs).collect()
    want = Counter()
    for i, t in rows:
        w, h = (t or "").encode().split(), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = b" ".join(w[a + (k - a) % p] if k >= a else w[k] for k in range(n)).decode()
        want[(i, t)] += 1
    assert Counter((r.doc_id, r.text) for r in edited) == want
    for r in runs.digests(runs.collapse(runs.repeated(docs))).collect():
        assert (r.n_runs == 0) == (r.start is None) and (r.start is None or r.exponent_milli == 1000 * r.length // r.period)
