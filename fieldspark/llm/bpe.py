"""Byte-level BPE with word ends, encoded through a segment tree over adjacent pair ranks.

Texts are cut at the special tokens, composed (NFC), lower-cased character by character and split at white space; each
chunk is split by the pre-tokenizer's pattern, and each piece is merged with a tree whose leaves hold the rank of the pair
that starts there. The root gives the lowest rank, its leftmost leaf the place; a merge updates three leaves. The trees of
many short pieces are rows of one array and are merged side by side. Chunks and pieces met lately are kept, in bounded
numbers and across a worker's tasks.

Nulls and empty texts give no tokens; ids, extra columns and repeated rows do not matter: one row out for each row in. Texts
of any length are encoded whole, and so are pieces: a place has 32 bits, more than a string can have bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import each, table, texts

#: A leaf is rank << BITS | place; NONE is above all. Ranks have 28 bits.
BITS = 32
NONE, PLACE = 1 << 60, (1 << BITS) - 1
#: Pieces of more bytes are merged one by one; characters of texts that are encoded together.
ALONE, TOGETHER = 64, 1 << 20
#: The pre-tokenizer's pattern, of the tokenizer's file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of Unicode, without U+001C to U+001F, which Python's split() adds.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class RankTree:
    """Minimum tree over adjacent pairs; a leaf holds its pair's rank, then its place, so that the root names both."""

    def __init__(self, leaves: list[int]):
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        self.t = t = [NONE] * size + leaves + [NONE] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a <= b else b

    def put(self, i: int, leaf: int) -> None:
        t = self.t
        i += self.size
        t[i] = leaf
        while i > 1:
            sister = t[i ^ 1]
            i >>= 1
            if leaf > sister:
                leaf = sister
            if t[i] == leaf:
                return
            t[i] = leaf


class Bpe:
    """A vocabulary file of the tokenizers library with byte-level pieces and word ends.

    The pre-tokenizer and normaliser are those of this kind of file; a file without a word end is refused.
    """

    def __init__(self, path: str, cache: int = 60_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        if not self.end or model.get("type", "BPE") != "BPE":
            raise ValueError(f"{path} is no BPE vocabulary with a word end")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[a] << 20) | self.vocab[b]: (i << BITS, self.vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        keys = np.array(list(self.merges), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.made = np.zeros(len(pairs), np.int32)  # by rank
        self.made[self.ranks >> BITS] = np.array([t for _, t in self.merges.values()], np.int32)[order]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.piece = regex.compile(PIECES)
        self.space = re.compile(f"[{SPACES}]+")
        self.letter = [self.vocab.get(c, -1) for c in byte_letters()]
        self.last = [self.vocab.get(c + self.end, -1) for c in byte_letters()]
        self.whole = min(self.letter + self.last) >= 0 and len(pairs) > 0
        self.limit = cache
        self.chunks, self.old_chunks = Kept(), Kept()
        self.pieces, self.old_pieces = Kept(), Kept()

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges of one piece, over symbols' ids."""
        n = len(symbols)
        get = self.merges.get
        tree = RankTree([get((p[0] << 20) | p[1], (NONE, 0))[0] | i for i, p in enumerate(zip(symbols, symbols[1:], strict=False))])
        put, t = tree.put, tree.t
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := t[1]) < NONE:
            i = low & PLACE
            j = after[i]
            symbols[i] = merged = get((symbols[i] << 20) | symbols[j])[1]
            symbols[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                found = get((merged << 20) | symbols[k])
                put(i, found[0] | i if found else NONE)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                found = get((symbols[h] << 20) | merged)
                put(h, found[0] | h if found else NONE)
        return [s for s in symbols if s >= 0]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A leaf for each pair: its rank and place, or NONE."""
        key = (left.astype(np.int64) << 20) | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.ranks[k] | at, NONE)

    def merge_many(self, symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for many pieces side by side: a row each, of n symbols; their trees are one array. Merged places are -1."""
        m, most = symbols.shape
        size = 1 << max(0, most - 2).bit_length()
        tree = np.full((m, 2 * size), NONE, np.int64)
        place = np.arange(most - 1)
        tree[:, size : size + most - 1] = np.where(place < n[:, None] - 1, self.leaves(symbols[:, :-1], symbols[:, 1:], place), NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after, before = (np.broadcast_to(np.arange(most) + d, (m, most)).copy().ravel() for d in (1, -1))
        tree, flat = tree.ravel(), symbols.ravel()

        def put(rows: np.ndarray, at: np.ndarray, leaf: np.ndarray | int) -> None:
            base, at = rows * (2 * size), at + size
            tree[base + at] = leaf
            for _ in range(size.bit_length() - 1):
                at = at >> 1
                pair = base + 2 * at
                tree[base + at] = np.minimum(tree[pair], tree[pair + 1])

        live = np.arange(m)
        while len(live):
            root = tree[live * (2 * size) + 1]
            going = root < NONE
            live, root = live[going], root[going]
            row, i = live * most, root & PLACE
            j = after[row + i]
            k = after[row + j]
            merged = self.made[root >> BITS]
            flat[row + i], flat[row + j] = merged, -1
            after[row + i] = k
            more, h = k < n[live], before[row + i]
            before[(row + k)[more]] = i[more]
            back = h >= 0
            found = self.leaves(np.r_[merged[more], flat[(row + h)[back]]], np.r_[flat[(row + k)[more]], merged[back]], np.r_[i[more], h[back]])
            own, some = np.full(len(live), NONE, np.int64), int(more.sum())
            own[more] = found[:some]
            inner = j < size
            put(live[inner], j[inner], NONE)
            put(live, i, own)
            put(live[back], h[back], found[some:])
        return symbols

    def tokens(self, piece: bytes) -> list[int]:
        symbols = [self.letter[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        symbols = [s for s in symbols if s >= 0]  # a letter that the vocabulary lacks gives no token
        return self.merge(symbols) if len(symbols) > 1 else symbols

    def all_tokens(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each piece; short ones of alike lengths are merged together."""
        if not self.whole:
            return [self.tokens(p) for p in pieces]
        out: list[list[int]] = [[]] * len(pieces)
        n = np.array([len(p) for p in pieces], np.int64)
        for k in np.flatnonzero(n > ALONE).tolist():
            out[k] = self.tokens(pieces[k])
        lengths, letter, last = 1 << np.ceil(np.log2(np.maximum(n - 1, 1))).astype(np.int64), np.array(self.letter, np.int32), np.array(self.last, np.int32)
        for size in np.unique(lengths[n <= ALONE]).tolist():
            group = np.flatnonzero((lengths == size) & (n <= ALONE))
            for at in np.array_split(group, max(1, len(group) * size >> 19)):
                own, most = n[at], int(n[at].max())
                raw = np.frombuffer(b"".join([pieces[k].ljust(most, b"\0") for k in at.tolist()]), np.uint8).reshape(len(at), most)
                symbols = letter[raw]
                symbols[np.arange(len(at)), own - 1] = last[raw[np.arange(len(at)), own - 1]]
                symbols[np.arange(most) >= own[:, None]] = -1
                if most > 1:
                    symbols = self.merge_many(symbols, own)
                keep = symbols >= 0
                ids, edge = symbols[keep].tolist(), np.r_[0, np.cumsum(keep.sum(1))].tolist()
                for k, s, e in zip(at.tolist(), edge[:-1], edge[1:], strict=True):
                    out[k] = ids[s:e]
        return out

    def learn(self, new: set[str]) -> None:
        """Puts chunks (without white space) into the cache."""
        todo, found = [], {}
        for c in new:
            if c in self.old_chunks.ids:
                self.chunks.ids[c], self.chunks.text[c] = self.old_chunks.ids[c], self.old_chunks.text[c]
            else:
                found[c] = self.piece.findall(c)
        ids, text = self.pieces.ids, self.pieces.text
        for p in {p for ps in found.values() for p in ps}.difference(ids):
            if p in self.old_pieces.ids:
                ids[p], text[p] = self.old_pieces.ids[p], self.old_pieces.text[p]
            else:
                todo.append(p)
        names = self.names
        for p, toks in zip(todo, self.all_tokens([p.encode("utf-8") for p in todo]), strict=True):
            ids[p], text[p] = " ".join(map(str, toks)), " ".join([names[t] for t in toks])
        for c, ps in found.items():
            if len(ps) > 1:
                ps = [p for p in ps if ids[p]]
                self.chunks.ids[c], self.chunks.text[c] = " ".join([ids[p] for p in ps]), " ".join([text[p] for p in ps])
            else:
                self.chunks.ids[c], self.chunks.text[c] = (ids[ps[0]], text[ps[0]]) if ps else ("", "")

    def age(self) -> None:
        """What was not met for two generations is forgotten, so that the caches are bounded."""
        if len(self.chunks.ids) > self.limit:
            self.old_chunks, self.chunks = self.chunks, Kept()
        if len(self.pieces.ids) > self.limit:
            self.old_pieces, self.pieces = self.pieces, Kept()

    def split(self, text: str) -> list[str]:
        """Chunks of a text without special tokens."""
        text = lower(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text))
        return [c for c in self.space.split(text) if c] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """Ids joined by spaces, decoded text and number of tokens of each text."""
        parts = [self.cut.split(t) if t and self.cut and "<|" in t else [t or ""] for t in texts]
        chunks = [[self.split(p) if k % 2 == 0 else p for k, p in enumerate(ps)] for ps in parts]
        self.age()
        self.learn(set().union(*[c for cs in chunks for c in cs[::2]]).difference(self.chunks.ids))
        ids, text = self.chunks.ids, self.chunks.text
        blank = "" in ids.values() if len(ids) < 64 else any(not v for v in ids.values())
        for cs in chunks:
            a, b = [], []
            for k, c in enumerate(cs):
                if k % 2:
                    a.append(str(self.special[c]))
                    b.append(c)
                elif c:
                    c = [x for x in c if ids[x]] if blank else c
                    a.append(" ".join(map(ids.__getitem__, c)))
                    b.append(" ".join(map(text.__getitem__, c)))
            a = a[0] if len(a) == 1 else " ".join(filter(None, a))
            yield a, b[0] if len(b) == 1 else " ".join(filter(None, b)), a.count(" ") + 1 if a else 0

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """Ids joined by spaces, decoded text, number of tokens."""
        return next(self.encode_all([text]))


class Kept:
    """Ids and text of chunks or pieces met lately."""

    __slots__ = ("ids", "text")

    def __init__(self):
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}


def lower(text: str) -> str:
    """Lower case of each character by itself: no final sigma."""
    return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def bunches(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    """Texts in lists of about TOGETHER characters; a longer one by itself or with those before it."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if held >= TOGETHER:
            yield some
            some, held = [], 0
    if some:
        yield some


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space), decoded; with_text=False gives their SHA-256 instead."""
    names = ["ids", "decoded"] if with_text else ["ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids, dec = [], [], []
            for some in bunches(each(b.column(1))):
                for i, d, k in bpe.encode_all(some):
                    n.append(k)
                    if not with_text:
                        i, d = (hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (i, d))
                    ids.append(i)
                    dec.append(d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", *names])

    return texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")


def decode(ids: list[int], path: str) -> str:
    """Tokens of ids joined by spaces, special ones too."""
    bpe = load(path)
    back = bpe.names | {v: k for k, v in bpe.special.items()}
    return " ".join(back[i] for i in ids if i in back)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return encode(table(spark, sf_dir, "documents"), default_path(), with_text=False)
