"""Weighted acyclic automata over word sequences: count transducers.

An automaton reads a sequence of words from its one start and gives a weight for each place it comes to; so it holds the weights of
all prefixes of its sequences. It is built from sorted sequences, each of which adds the states past the longest prefix it shares with the one
before, and lies in flat arrays by depth: a state is numbered by the arc that leads to it, in the order of the sequences.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard

Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # first arc of each state of the depth before (and their end), symbols, weights


def pack(columns: Sequence[np.ndarray], symbols: int) -> list[np.ndarray]:
    """Rows of symbols (0 to `symbols`) as few 64-bit keys, which sort as the rows do."""
    bits = max(1, int(symbols).bit_length())
    per = 64 // bits
    keys = []
    for k in range(0, len(columns), per):
        key = np.zeros(len(columns[0]), np.uint64)
        for c in range(k, k + per):
            key = (key << np.uint64(bits)) | (columns[c].astype(np.uint64) if c < len(columns) else np.uint64(0))
        keys.append(key)
    return keys


def unpack(keys: Sequence[np.ndarray], symbols: int, width: int) -> list[np.ndarray]:
    """The columns of pack."""
    bits = max(1, int(symbols).bit_length())
    per = 64 // bits
    mask = np.uint64((1 << bits) - 1)
    return [((keys[c // per] >> np.uint64(bits * (per - 1 - c % per))) & mask).astype(np.int64) for c in range(width)]


def summed(keys: Sequence[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, where each first lies in the order of all, and their summed weights (counts, if none are given)."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(tuple(keys[::-1]))
    keys = [k[order] for k in keys]
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    total = np.diff(np.r_[at, n]) if weights is None else (np.add.reduceat(weights[order], at) if n else weights)
    return [k[at] for k in keys], order[at], total.astype(np.int64)


@dataclass
class Automaton:
    words: list[bytes]  # sorted; a symbol is a place in it
    levels: list[Level]

    @classmethod
    def build(cls, words: list[bytes], columns: Sequence[np.ndarray], weights: np.ndarray, sums: bool = True) -> Automaton:
        """Of distinct sequences in order. columns hold their symbols plus one, 0 past a sequence's end.

        sums: a state weighs as much as all sequences that go through it; otherwise as the sequence that ends there, or 0.
        """
        n = len(weights)
        levels: list[Level] = []
        state, states = np.zeros(n, np.int64), 1
        live, new = np.ones(n, bool), np.zeros(n, bool)
        new[:1] = True
        for d, c in enumerate(columns):
            live = live & (c > 0)
            new[1:] |= c[1:] != c[:-1]  # the sequence leaves the one before at this depth or earlier
            begins = new & live
            at = np.flatnonzero(begins)
            if not len(at):
                break
            if sums:
                run = np.r_[0, np.cumsum(np.where(live, weights, 0))]
                w = run[np.r_[at[1:], n]] - run[at]
            else:
                ends = columns[d + 1][at] == 0 if d + 1 < len(columns) else np.ones(len(at), bool)
                w = np.where(ends, weights[at], 0)
            first = np.r_[0, np.cumsum(np.bincount(state[at], minlength=states))]
            levels.append((first, c[at].astype(np.int64) - 1, w.astype(np.int64)))
            state, states = np.cumsum(begins) - 1, len(at)
        return cls(words, levels)

    @classmethod
    def of(cls, weights: dict[tuple[bytes, ...], int]) -> Automaton:
        """Of a few sequences, each with its own weight."""
        words = sorted({w for s in weights for w in s})
        number = {w: k for k, w in enumerate(words, 1)}
        order = sorted(weights)
        width = max(map(len, order), default=0)
        rows = np.zeros((len(order), width), np.int64)
        for k, s in enumerate(order):
            rows[k, : len(s)] = [number[w] for w in s]
        return cls.build(words, list(rows.T), np.array([weights[s] for s in order], np.int64), sums=False)

    def parents(self, d: int) -> np.ndarray:
        """The state of depth d - 1 that each state of depth d (from 0) hangs on."""
        first = self.levels[d][0]
        return np.repeat(np.arange(len(first) - 1), np.diff(first))

    def ends(self, number: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns and weights of the sequences it was summed from, in any order; number maps its symbols, to one or more."""
        kept: list[list[np.ndarray]] = []
        weights: list[np.ndarray] = []
        columns: list[np.ndarray] = []
        for d, (_, symbols, w) in enumerate(self.levels):
            up = self.parents(d)
            columns = [c[up] for c in columns] + [number[symbols]]
            own = w
            if d + 1 < len(self.levels):
                first, _, below = self.levels[d + 1]
                run = np.r_[0, np.cumsum(below)]
                own = w - (run[first[1:]] - run[first[:-1]])
            at = np.flatnonzero(own > 0)
            kept.append([c[at] for c in columns] + [np.zeros(len(at), np.int64)] * (width - d - 1))
            weights.append(own[at])
        if not kept:
            return [np.zeros(0, np.int64)] * width, np.zeros(0, np.int64)
        return [np.concatenate([k[c] for k in kept]) for c in range(width)], np.concatenate(weights)

    @classmethod
    def union(cls, parts: Sequence[Automaton], width: int) -> Automaton:
        """One automaton in which the weights of equal sequences are added up."""
        words = sorted(set().union(*(p.words for p in parts)))
        number = {w: k for k, w in enumerate(words, 1)}
        keys, weights = [], []
        for p in parts:
            columns, w = p.ends(np.array([number[x] for x in p.words], np.int64), width)
            keys.append(pack(columns, len(words) + 1))
            weights.append(w)
        found, _, total = summed([np.concatenate(k) for k in zip(*keys, strict=True)], np.concatenate(weights))
        return cls.build(words, unpack(found, len(words) + 1, width), total)

    def sequence(self, d: int, states: np.ndarray) -> Iterator[tuple[bytes, ...]]:
        """The words that lead to states of depth d (from 0)."""
        columns = []
        for k in range(d, -1, -1):
            columns.append([self.words[s] for s in self.levels[k][1][states].tolist()])
            states = self.parents(k)[states]
        return zip(*columns[::-1], strict=True)

    def compose(self, counts: Automaton) -> list[np.ndarray]:
        """For each depth and state of this acceptor the state that counts comes to by the same words, or -1."""
        number = {w: k for k, w in enumerate(counts.words)}
        symbol = np.array([number.get(w, -1) for w in self.words], np.int64)
        base = len(counts.words) + 1
        out: list[np.ndarray] = []
        met = np.zeros(1, np.int64)
        for d, (_, symbols, _) in enumerate(self.levels):
            if d >= len(counts.levels):
                out.append(np.full(len(symbols), -1))
                met = out[-1]
                continue
            there = counts.parents(d) * base + counts.levels[d][1]
            on, s = met[self.parents(d)], symbol[symbols]
            want = on * base + s
            at = np.searchsorted(there, want).clip(0, len(there) - 1)
            met = np.where((on >= 0) & (s >= 0) & (there[at] == want), at, -1)
            out.append(met)
        return out

    def dump(self) -> bytes:
        """As bytes."""
        kind = np.uint16 if len(self.words) < 1 << 16 else np.uint32
        parts = [np.array([len(w) for w in self.words], np.uint32).tobytes(), b"".join(self.words)]
        head = [len(self.words), len(parts[1]), len(self.levels)]
        for first, symbols, weights in self.levels:
            wide = int(weights.max(initial=0)) >= 1 << 32
            head += [len(first) - 1, len(symbols), int(wide)]
            parts += [np.diff(first).astype(np.uint32).tobytes(), symbols.astype(kind).tobytes(), weights.astype(np.uint64 if wide else np.uint32).tobytes()]
        return zstandard.compress(struct.pack(f"<I{len(head)}Q", len(head), *head) + b"".join(parts), 1)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        """The inverse of dump."""
        raw = zstandard.decompress(data)
        n = struct.unpack_from("<I", raw)[0]
        head = list(struct.unpack_from(f"<{n}Q", raw, 4))
        at = 4 + 8 * n

        def take(kind, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, k, at)
            at += out.nbytes
            return out

        edge = np.r_[0, np.cumsum(take(np.uint32, head[0]), dtype=np.int64)].tolist()
        text = raw[at : at + head[1]]
        at += head[1]
        words = [text[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        kind = np.uint16 if len(words) < 1 << 16 else np.uint32
        levels = []
        for k in range(3, len(head), 3):
            states, arcs, wide = head[k : k + 3]
            first = np.r_[0, np.cumsum(take(np.uint32, states), dtype=np.int64)]
            levels.append((first, take(kind, arcs).astype(np.int64), take(np.uint64 if wide else np.uint32, arcs).astype(np.int64)))
        return cls(words, levels)
