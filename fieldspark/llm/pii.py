"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds spans in forms they can't match.

The network is trained in numpy on windows of a bounded sample of texts (`train_docs` documents with a digit or `@`, least
xxhash64 of id and text, and at most TRAIN_WINDOWS windows of each): around the spans that the base patterns find there, around those
spans and made-up ones written in other ways (disguised addresses, numbers with other separators or without a plus), and
around numbers that are no personal data. A well-formed span holds a digit, an `@`, the word "dot", or "at" before a host with
a full stop (HINT), so overlapping windows that hold none of these decode to no span and are passed over; all others are decoded (Viterbi). Each place takes the tag of the
window in whose middle it lies most, be it "outside" or not, and the spans so joined over the whole text are kept where they
are well formed, once separators are put right, and clear of every base span. Base spans always stay.

Null and empty texts have no spans; texts of any length are searched whole, in windows. One row out for each row in, repeated
rows too; null ids pass through; columns besides id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import table, texts

KINDS = ("email", "ip", "card", "phone")
#: What every well-formed span holds: a digit, an @, the word "dot", or "at" before a host's first full stop.
HINT = re.compile(r"[0-9@]|\b[dD][oO][tT]\b|(?:[\[({<]\s*[aA][tT]\s*[\])}>]\s*|\s[aA][tT]\s+)[A-Za-z0-9-]+\s*[\[({<]?\s*\.\s*[\])}>]?\s*[A-Za-z0-9-]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start alone: a match inside it would have begun there
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 16, 10
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, BATCH = 600, 12, 6, 64

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    """Is the text well formed for its kind?"""
    if kind == 0:
        return "@" in text
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = "".join(DIGITS.findall(text))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


#: How separators are disguised.
AT, DOT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s*@\s*", re.I), re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s*\.\s*", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def plausible(kind: int, text: str) -> bool:
    """Is the text well formed for its kind once its separators are put right?"""
    if kind == 0:
        return bool(ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", text, count=1))))
    if kind == 1:
        return valid(1, DOT.sub(".", text))
    if any(c.isalpha() for c in text) or not valid(kind, text):
        return False
    return kind == 2 or any(c in text for c in " ().-/")  # a bare run of digits is no phone number


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free, at = max(free, at + 1), text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    if not text or not HINT.search(text):
        return []
    out = emails(text)
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---------------------------------------------------------------- the network


def codes(text: str) -> np.ndarray:
    """A class for each character: ASCII by itself, all others by what they are."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, 128).astype(np.int64)


def start_weights(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"E": n(130, EMBED), "O": n(2 * HIDDEN, TAGS), "o": np.zeros(TAGS, np.float32), "T": n(TAGS, TAGS)}
    for d in "fb":
        w |= {f"W{d}": n(EMBED + HIDDEN, 4 * HIDDEN), f"b{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool = False):
    """x: steps, rows, EMBED. Hidden states, and what the backward pass needs."""
    steps, rows, _ = x.shape
    h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    out, held = np.empty((steps, rows, HIDDEN), np.float32), []
    xin = x @ w[:EMBED] + b
    for t in range(steps):
        a = xin[t] + h @ w[EMBED:]
        s = sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
        before, hb = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            held.append((i, f, o, g, before, tc, hb))
    return out, held


def lstm_back(x, w, dh_all, held):
    steps, rows, _ = x.shape
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
    dh, dc = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, hb = held[t]
        dh = dh + dh_all[t]
        do = dh * tc
        dc = dc + dh * o * (1 - tc * tc)
        a = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw[:EMBED] += x[t].T @ a
        dw[EMBED:] += hb.T @ a
        db += a.sum(0)
        dx[t] = a @ w[:EMBED].T
        dh, dc = a @ w[EMBED:].T, dc * f
    return dw, db, dx


def emissions(ids: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    """ids: rows, steps. Scores of tags: steps, rows, TAGS."""
    x = w["E"][ids.T]
    f, hf = lstm(x, w["Wf"], w["bf"], keep)
    b, hb = lstm(x[::-1], w["Wb"], w["bb"], keep)
    h = np.concatenate([f, b[::-1]], 2)
    return h @ w["O"] + w["o"], (x, h, hf, hb)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


def crf_grad(s: np.ndarray, y: np.ndarray, t: np.ndarray):
    """Negative log likelihood and its gradients: scores (steps, rows, TAGS), tags (steps, rows), transitions."""
    steps, rows, _ = s.shape
    a, b = np.empty_like(s), np.zeros_like(s)
    a[0] = s[0]
    for k in range(1, steps):
        a[k] = lse(a[k - 1][:, :, None] + t[None], 1) + s[k]
    for k in range(steps - 2, -1, -1):
        b[k] = lse(t[None] + (s[k + 1] + b[k + 1])[:, None, :], 2)
    z = lse(a[-1], 1)
    ds = np.exp(a + b - z[None, :, None])
    dt = np.zeros_like(t)
    r = np.arange(rows)
    for k in range(1, steps):
        dt += np.exp(a[k - 1][:, :, None] + t[None] + (s[k] + b[k])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dt, (y[k - 1], y[k]), -1)
    gold = s[np.arange(steps)[:, None], r[None], y].sum(0) + t[y[:-1], y[1:]].sum(0)
    ds[np.arange(steps)[:, None], r[None], y] -= 1
    return float((z - gold).mean()), ds / rows, dt / rows


def viterbi(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags: rows, steps."""
    steps, rows, n = s.shape
    back = np.empty((steps, rows, n), np.int8)
    v = s[0].copy()
    v[:, 2::2] = -1e4  # an inside tag needs a beginning
    bar = np.zeros_like(t)
    for k in range(len(KINDS)):
        i = 2 + 2 * k
        bar[:, i] = -1e4
        bar[[i - 1, i], i] = 0
    t = t + bar
    for k in range(1, steps):
        x = v[:, :, None] + t[None]
        back[k] = x.argmax(1)
        v = x.max(1) + s[k]
    out = np.empty((rows, steps), np.int8)
    out[:, -1] = v.argmax(1)
    for k in range(steps - 1, 0, -1):
        out[:, k - 1] = back[k][np.arange(rows), out[:, k]]
    return out


def made_up(kind: int, r: np.random.Generator, words: list[str]) -> str:
    """A span in the form of the base patterns."""
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))
    if kind == 0:
        w = [w.lower() for w in words if w.isascii() and w.isalpha()] or ["post"]
        pick = lambda: w[int(r.integers(len(w)))]
        return f"{pick()}{r.choice(['', '.', '_'])}{pick() if r.random() < 0.5 else n(2)}@{pick()}{r.choice(['', n(1), '.example'])}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
    if kind == 1:
        return ".".join(str(x) for x in r.integers(0, 256, 4))
    if kind == 2:
        d = f"{r.integers(3, 7)}{n(14)}"
        return next(d + str(k) for k in range(10) if luhn(d + str(k)))
    return f"+{r.integers(1, 99)} ({n(3)}) {n(3)}-{n(4)}"


def disguised(kind: int, span: str, r: np.random.Generator) -> str:
    """The span in a form that its base pattern doesn't match whole."""
    pick = lambda *forms: forms[int(r.integers(len(forms)))]
    if kind == 0:
        at = pick(" at ", " [at] ", "(at)", " (at) ", "[at]", " @ ", " AT ")
        dot = pick(" dot ", "(dot)", " [dot] ", "[dot]", " (dot) ", " DOT ") if at != " @ " else pick(".", " . ")
        name, _, host = span.partition("@")
        return name + at + (host.replace(".", dot) if "dot" in dot.lower() or r.random() < 0.7 else host)
    if kind == 1:
        return span.replace(".", pick("[.]", "(.)", " . ", ". ", " dot ", "[dot]"))
    digits = "".join(DIGITS.findall(span))
    if kind == 2:
        return pick(".", "/", "_", "  ", " - ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    own = digits[-10:] if len(digits) > 10 else digits
    sep = pick(" ", "-", ".", "/")
    body = pick(f"({own[:3]}) {own[3:6]}-{own[6:]}", sep.join((own[:3], own[3:6], own[6:])), sep.join((own[:4], own[4:7], own[7:])))
    return pick("", "", "00" + digits[: max(1, len(digits) - 10)] + " ", "0") + body


def no_span(r: np.random.Generator) -> str:
    """A number that is no personal data."""
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))
    forms = (f"20{n(2)}-0{r.integers(1, 10)}-1{n(1)}", f"{n(2)}.{n(2)}", f"{n(1)}.{n(1)}.{n(2)}", f"{r.integers(1, 24)}:{n(2)}", n(int(r.integers(1, 9))), f"{n(3)},{n(3)}.{n(2)}", f"{n(2)}-{n(2)}", f"at {n(2)} dot", f"{n(2)}/{n(2)}/20{n(2)}", f"{n(4)}-{n(4)}", f"({n(2)})", f"{n(18)}{n(4)}", f"dot {n(1)} at")
    return forms[int(r.integers(len(forms)))]


def examples(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """Windows with their spans: as found, found or made up and disguised, and around numbers that are no span."""
    r = np.random.default_rng(seed)
    spans, out = base_spans(text), []

    def window(left: str, span: str, right: str, kind: int | None, others: list[Span] = ()) -> None:
        shift = max(0, len(left) - int(r.integers(4, WINDOW - 60)))
        piece = (left + span + right)[shift : shift + WINDOW]
        own = [(len(left) - shift, kind, len(left) - shift + len(span))] if kind is not None else []
        out.append((piece, sorted([x for x in own if x[2] <= WINDOW] + [(a - shift, b, c - shift) for a, b, c in others if a >= shift and c <= shift + WINDOW])))

    for s, _, e in spans[:4]:
        window(text[:s], text[s:e], text[e : e + WINDOW], None, spans)
    plain = HINT.split(text[: 50 * WINDOW])
    words = text[: 50 * WINDOW].split()[:200]
    for kind in range(len(KINDS)):
        left, right = (plain[int(r.integers(len(plain)))] for _ in range(2))
        found = [text[s:e] for s, k, e in spans if k == kind]
        span = found[0] if found and r.random() < 0.4 else made_up(kind, r, words)
        left = left[-WINDOW:].rstrip() + " " if r.random() < 0.95 else ""
        right = str(r.choice([" ", " ", ". ", ", ", "\n"])) + right[:WINDOW].lstrip()
        window(left, disguised(kind, span, r), right, kind)
    for m in list(re.finditer(r"[0-9]+", text[: 50 * WINDOW]))[:2]:
        if not any(s < m.end() and m.start() < e for s, _, e in spans):
            window(text[: m.start()], m.group(), text[m.end() : m.end() + WINDOW], None, spans)
    for _ in range(2):
        left, right = (plain[int(r.integers(len(plain)))] for _ in range(2))
        window(left[-WINDOW:].rstrip() + " ", no_span(r), " " + right[:WINDOW].lstrip(), None)
    return [(p, x) for p, x in out if p]


def fit(rows: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights trained on windows, by Adam."""
    w = start_weights()
    if not rows:
        return w
    ids, tags = np.full((len(rows), WINDOW), 129, np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(rows):
        c = codes(text)[:WINDOW]
        ids[k, : len(c)] = c
        for s, kind, e in spans:
            if not tags[k, s:e].any():
                tags[k, s:e], tags[k, s] = 2 + 2 * kind, 1 + 2 * kind
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    order, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        mixed = order.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = mixed[at : at + BATCH]
            x, y = ids[pick], tags[pick].T
            s, (emb, h, hf, hb) = emissions(x, w, True)
            _, ds, dt = crf_grad(s, y, w["T"])
            dh = ds @ w["O"].T
            g = {"T": dt, "O": np.einsum("tri,trj->ij", h, ds), "o": ds.sum((0, 1)), "E": np.zeros_like(w["E"])}
            g["Wf"], g["bf"], dx = lstm_back(emb, w["Wf"], dh[:, :, :HIDDEN], hf)
            g["Wb"], g["bb"], dy = lstm_back(emb[::-1], w["Wb"], dh[::-1, :, HIDDEN:], hb)
            np.add.at(g["E"], x.T, dx + dy[::-1])
            step += 1
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            for k in w:
                q = g[k] * min(1, 5 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.999 * v[k] + 0.001 * q * q
                w[k] = (w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a HINT."""
    last = max(0, len(text) - WINDOW)
    found = set()
    for m in HINT.finditer(text):
        k = max(0, (m.start() - WINDOW + STRIDE) // STRIDE) * STRIDE
        while k <= m.start():
            found.add(min(k, last))
            k += STRIDE
    return sorted(found)


def tag(items: list[str], w: dict[str, np.ndarray], rows: int = 256) -> list[list[Span]]:
    """Spans of whole texts by the network, before any check against the base."""
    todo = [(k, s) for k, text in enumerate(items) for s in windows(text)]
    depth = {k: np.full(len(items[k]), -1, np.int16) for k in {k for k, _ in todo}}
    tags = {k: np.zeros(len(items[k]), np.int8) for k in depth}
    middle = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for at in range(0, len(todo), rows):
        part = todo[at : at + rows]
        ids = np.full((len(part), WINDOW), 129, np.int64)
        for r, (k, s) in enumerate(part):
            c = codes(items[k][s : s + WINDOW])
            ids[r, : len(c)] = c
        best = viterbi(emissions(ids, w)[0], w["T"])
        for r, (k, s) in enumerate(part):
            n = min(WINDOW, len(items[k]) - s)
            own = middle[:n].copy()
            if s == 0:  # beyond the text's ends there is nothing to see
                own[: WINDOW // 2] = WINDOW
            if s + WINDOW >= len(items[k]):
                own[WINDOW // 2 :] = WINDOW
            deeper = own > depth[k][s : s + n]
            depth[k][s : s + n][deeper] = own[deeper]
            tags[k][s : s + n][deeper] = best[r, :n][deeper]
    out = []
    for k in range(len(items)):
        spans, start, kind, end = [], -1, -1, -1
        for p in np.flatnonzero(tags[k]).tolist() if k in tags else ():
            t = int(tags[k][p])
            if t % 2 or p != end or (t - 1) // 2 != kind:
                if start >= 0:
                    spans.append((start, kind, end))
                start, kind = p, (t - 1) // 2
            end = p + 1
        if start >= 0:
            spans.append((start, kind, end))
        out.append(spans)
    return out


def reconcile(text: str, base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans, and those of the network, grown to whole words, that are well formed and clear of them.

    An address that isn't well formed may have taken in the next word; then it ends before it.
    """
    out = list(base)
    for s, k, e in more:
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while e > s > 0 and (LOCAL.match(text[s - 1]) if k == 0 else text[s - 1].isalnum()):
            s -= 1
        while s < e < len(text) and text[e].isalnum():
            e += 1
        if k == 0 and not plausible(k, text[s:e]):
            e = s + len(text[s:e].rpartition(" ")[0].rstrip())
        if e - s >= 5 and plausible(k, text[s:e]) and not any(a < e and s < b for a, _, b in out):
            out.append((s, k, e))
    return sorted(out)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """The network, trained in one task from at most train_docs texts."""
    docs = texts(docs).where("doc_id is not null")
    order = F.xxhash64("doc_id", "text")
    keys = docs.where(F.col("text").rlike("[0-9@]")).select(order.alias("key")).distinct().orderBy("key").limit(train_docs)  # a documented bound on training alone
    some = docs.withColumn("key", order).join(F.broadcast(keys), "key").dropDuplicates(["key"])
    names = list(start_weights())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        rows = [x for i, t in zip(pdf["key"], pdf["text"], strict=True) for x in examples(t, int(i) & 0xFFFFFFFF)[:TRAIN_WINDOWS]]
        w = fit(rows)
        return pd.DataFrame({"name": names, "w": [w[k].tobytes() for k in names]})

    got = {r["name"]: np.frombuffer(r["w"], np.float32) for r in some.groupBy().applyInPandas(run, "name string, w binary").collect()}
    return {k: got[k].reshape(x.shape) if k in got else x for k, x in start_weights().items()}


def find(docs: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, base (its spans), spans (all), each array of start, kind, end."""
    kinds = "array<struct<start:int, kind:string, end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [t or "" for t in b.column(1).to_pylist()]
            base, every = spans_of(items, w)
            as_rows = lambda x: [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans] for spans in x]
            of = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_rows(base), of), pa.array(as_rows(every), of)], ["doc_id", "base", "spans"])

    return texts(docs).mapInArrow(run, f"doc_id long, base {kinds}, spans {kinds}")


def spans_of(items: list[str], w: dict[str, np.ndarray]) -> tuple[list[list[Span]], list[list[Span]]]:
    base = [base_spans(t) for t in items]
    hot = [k for k, t in enumerate(items) if HINT.search(t)]
    every = list(base)
    for k, more in zip(hot, tag([items[k] for k in hot], w), strict=True):
        every[k] = reconcile(items[k], base[k], more)
    return base, every


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    docs = table(spark, sf_dir, "documents")
    w = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = spans_of([t or "" for t in b.column(1).to_pylist()], w)
            counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in base], pa.int64()) for kind in range(len(KINDS))]
            digest = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest), pa.array([written(x) for x in every], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: personal data in texts is masked and n_chars follows; all rows and columns stay."""
    w, names = train(docs), docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            _, every = spans_of([t or "" for t in old], w)
            new = [mask(t, x) if x else t for t, x in zip(old, every, strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if chars >= 0:
                cols[chars] = pa.array([len(t) if x else n for t, x, n in zip(new, every, b.column(chars).to_pylist(), strict=True)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
