"""Packed exchanges: the hashes of n-grams, and texts, travel between tasks as few rows of compressed arrays.

A row stands for the documents of one input batch that fall to one bucket. What is exchanged is linear in the input, and
every bucket holds a share of hash values, so no frequent word, passage or source makes a bucket large but its own repeats
of one hash value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import WordHashes, each, mix, texts

#: Bytes of text a bucket of hashes, and a bucket of documents, are meant for.
HASH_BUCKET, TEXT_BUCKET = 4 << 20, 12 << 20
FLUSH = 1_000_000
NO_ID = np.int64(0x7FFFFFFFFFFFFFFF)


def z(a: np.ndarray | bytes) -> bytes:
    return zstandard.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), 1)


def unz(b: bytes, kind=None):
    raw = zstandard.decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def size_of(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0


def hash_bits(total: int, bucket: int = HASH_BUCKET, least: int = 8) -> int:
    """Leading bits of a hash that name its bucket, as many as the input needs."""
    return max(least, int(np.ceil(np.log2(max(1, total / bucket)))))


def text_buckets(total: int) -> int:
    return max(12, int(np.ceil(total / TEXT_BUCKET)))


def text_tag(text: bytes | None) -> int:
    """32 bits of a text, another for null."""
    import xxhash

    return xxhash.xxh3_64_intdigest((text or b"") + (b"" if text is None else b"\1")) >> 32


def row_keys(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Names rows by what they hold (id and text), so that repeated rows count as one document, and a null id does no harm."""
    return (mix(ids.astype(np.int64).view(np.uint64), np.uint64(17)) & np.uint64(0xFFFFFFFF00000000)) | tags.astype(np.uint64)


def pack_keys(ids: np.ndarray, tags: np.ndarray) -> tuple[bytes, bytes]:
    """Ids, which mostly ascend, as differences; tags as they are."""
    return z(np.diff(ids, prepend=0)), np.ascontiguousarray(tags, dtype=np.uint32).tobytes()


def unpack_keys(ids: bytes, tags: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Row keys and ids."""
    own = np.cumsum(unz(ids, np.int64))
    return row_keys(own, np.frombuffer(tags, np.uint32)), own


def byte_words(text: str | None, lower: bool) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def pack_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """dbucket, keys, ids, lens (-1: null text), data: the documents, dealt by row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            items = [None if t is None else t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            keys = row_keys(np.array([NO_ID if i is None else i for i in ids], np.int64), np.array([text_tag(t) for t in items], np.uint64))
            which = keys % np.uint64(buckets)
            order = np.argsort(which, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []:
                out.append(
                    {
                        "dbucket": int(which[part[0]]),
                        "keys": keys[part].tobytes(),
                        "ids": np.array([NO_ID if ids[k] is None else ids[k] for k in part], np.int64).tobytes(),
                        "lens": np.array([-1 if items[k] is None else len(items[k]) for k in part], np.int64).tobytes(),
                        "data": z(b"".join(items[k] or b"" for k in part)),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=PACKED_TEXTS)

    return texts(docs).mapInArrow(run, "dbucket long, keys binary, ids binary, lens binary, data binary")


PACKED_TEXTS = pa.schema([("dbucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("lens", pa.binary()), ("data", pa.binary())])


def unpack_texts(pdf: pd.DataFrame) -> Iterator[tuple[int, int | None, str | None]]:
    """Row key, id and text of every document of packed rows."""
    for keys, ids, lens, data in zip(pdf["keys"], pdf["ids"], pdf["lens"], pdf["data"], strict=True):
        raw, at = unz(data), 0
        for key, i, n in zip(np.frombuffer(keys, np.uint64).tolist(), np.frombuffer(ids, np.int64).tolist(), np.frombuffer(lens, np.int64).tolist(), strict=True):
            text = None if n < 0 else raw[at : at + n].decode("utf-8", "surrogatepass")
            at += max(0, n)
            yield key, (None if i == NO_ID else i), text


PACKED_HASHES = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("tags", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("starts", pa.binary())])


def pack_hashes(docs: DataFrame, grams: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]], lower: bool, bits: int, width: int) -> DataFrame:
    """bucket, ids, tags, counts, hashes, starts: n-gram hashes of all documents by their leading bits.

    grams makes a document's hashes, and their starts if those are needed, from its words' hashes. Of each hash the `width`
    bytes after the bucket's whole bytes are kept. Within a bucket a document's hashes keep the order that grams gave them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        tags, ids, parts, starts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            all_h = np.concatenate(parts)
            doc = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
            top = (all_h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(top, kind="stable")
            all_h, doc, top = all_h[order], doc[order], top[order]
            at = np.concatenate(starts)[order] if starts[0] is not None else None
            tag, ident = np.array(tags, np.uint32), np.array([NO_ID if i is None else i for i in ids], np.int64)
            drop = bits // 8
            low = all_h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, drop : drop + width]
            out = []
            for s, e in runs(top):
                d = doc[s:e]
                edge = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                who = d[edge]
                out.append(
                    {
                        "bucket": int(top[s]),
                        **dict(zip(("ids", "tags"), pack_keys(ident[who], tag[who]), strict=True)),
                        "counts": z(np.diff(np.r_[edge, e - s]).astype(np.uint32)),
                        "hashes": np.ascontiguousarray(low[s:e]).tobytes(),
                        "starts": z(deltas(at[s:e], edge)) if at is not None else b"",
                    }
                )
            return pa.RecordBatch.from_pylist(out, schema=PACKED_HASHES)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                g, s = grams(hashes(byte_words(t, lower)))
                if not len(g):
                    continue
                tags.append(text_tag(None if t is None else t.encode("utf-8", "surrogatepass")))
                ids.append(i)
                parts.append(g)
                starts.append(s)
                held += len(g)
                if held >= FLUSH:
                    yield flush()
                    tags, ids, parts, starts, held = [], [], [], [], 0
        if held:
            yield flush()

    return texts(docs).mapInArrow(run, "bucket long, ids binary, tags binary, counts binary, hashes binary, starts binary")


def runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(sorted_values):
        return []
    edge = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return list(zip(np.r_[0, edge].tolist(), np.r_[edge, len(sorted_values)].tolist(), strict=True))


def deltas(a: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Differences within runs that begin at edge; a run's first value as it is. Values ascend within a run."""
    out = np.r_[a[:1], np.diff(a)].astype(np.int64)
    out[edge] = a[edge]
    return out.astype(np.uint32)


def undeltas(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The inverse of deltas."""
    total = np.cumsum(d.astype(np.int64))
    edge = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    base = np.where(edge > 0, total[edge - 1], 0)
    return total - np.repeat(base, counts)


def wide(hashes: bytes, width: int) -> np.ndarray:
    """Kept bytes as numbers."""
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - width :] = raw
    return full.view(">u8").ravel().astype(np.uint64)
