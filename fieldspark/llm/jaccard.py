"""N-gram Jaccard join through count-vector R-trees.

A document's set holds the 64-bit hashes of its distinct word n-grams. Tokens of a set are hashed into groups; the group
counts are a point, and the summed coordinate minima of two points bound the overlap of their sets. Points are indexed in an
R-tree whose boxes give the same bound for whole subtrees; pairs that survive are verified on the sets.

So that trees stay small and no pair is missed, documents meet as follows. All n-gram hashes are counted over the corpus (a
packed exchange); a document of which less than the threshold's share of n-grams occurs elsewhere can have no partner. Of
the others, equal sets become one class; a class's prefix (its rarest n - ceil(t * n) + 1 n-grams, in one order for all)
must meet the prefix of any partner, so classes that share a prefix n-gram, taken transitively, form a block, and each block
gets a tree. In a block, pairs that are already connected need no verification, so copies cost one check each. Blocks of
more than CHUNK classes are dealt as pairs of chunks, about as many chunks as the root of the block's size, so that neither
a task nor the number of copies of a set grows faster than that root.

Texts with fewer than n words are one n-gram; null texts and texts without words have the empty set and no links. Repeated
rows link as any other copies; rows of one id with different texts are documents of their own. A null id is never a component's least id; a component of null ids alone has a null id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import WordHashes, cut, mix, ngram_hashes, table, text_key, without
from fieldspark.llm.components import components
from fieldspark.llm.packed import byte_words, hash_bits, pack_hashes, pack_keys, pack_texts, runs, size_of, text_buckets, unpack_keys, unpack_texts, unz, wide, z

WORDS, PERCENT = 5, 75
CHUNK = 512
HASH_BUCKET = 16 << 20
GROUPS = 64
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id node, doc_id r FROM w UNION SELECT b, r FROM reach JOIN link ON a = node)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) n_shingles, CAST(min(r) AS BIGINT) component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON node = w.doc_id GROUP BY 1
"""
LEAF, FAN = 32, 8


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes, ascending; fewer words than n make one n-gram."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return mix(ngram_hashes(h, len(h)), np.uint64(len(h)))
    return np.unique(ngram_hashes(h, n))


class CountTree:
    """R-tree over group counts: boxes of LEAF points, then of FAN boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points, np.lexsort((points[:, 0], sizes)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while not self.levels or len(self.levels[-1][0]) > FAN:
            edge = np.arange(0, len(top), step)
            top, low, high = np.maximum.reduceat(top, edge), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)
            self.levels.append((top, low, high))
            step = FAN

    def _pack(self, points: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Places near points side by side: halves along the widest coordinate, down to a leaf."""
        if len(order) <= LEAF:
            return order
        part = points[order]
        order = order[np.argsort(part[:, np.argmax(part.var(0))], kind="stable")]
        half = (len(order) // 2 + LEAF - 1) // LEAF * LEAF
        return np.concatenate([self._pack(points, order[:half]), self._pack(points, order[half:])])

    def near(self, p: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Indices of points whose overlap bound lets them reach the threshold."""
        least, most = -(-percent * n // 100), 100 * n // percent

        def passing(top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            bound = np.minimum(top, p).sum(1)
            return (high >= least) & (low <= most) & ((100 + percent) * bound >= percent * (n + np.maximum(low, least)))

        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[k]
            at = at[passing(top[at], low[at], high[at])]
            fan, end = (LEAF, len(self.points)) if k == 0 else (FAN, len(self.levels[k - 1][0]))
            at = (at[:, None] * fan + np.arange(fan)[None]).ravel()
            at = at[at < end]
        at = at[passing(self.points[at], self.sizes[at], self.sizes[at])]
        return self.order[at]


def link_block(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Component number (its least index) of each set of a block."""
    m = len(sets)
    comp, sizes = np.arange(m), np.array([len(s) for s in sets])
    points = np.zeros((m, GROUPS), np.int32)
    for k, s in enumerate(sets):
        points[k] = np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    tree = CountTree(points, sizes)
    for a in range(m):
        todo = tree.near(points[a], int(sizes[a]), percent)
        todo = np.sort(todo[(todo > a) & (comp[todo] != comp[a])])
        while len(todo):
            some, todo = todo[:48], todo[48:]
            joined = np.concatenate([sets[b] for b in some])
            at = np.minimum(np.searchsorted(sets[a], joined), len(sets[a]) - 1)
            shared = np.add.reduceat((sets[a][at] == joined).astype(np.int64), np.r_[0, np.cumsum(sizes[some])[:-1]])
            linked = some[100 * shared >= percent * (sizes[a] + sizes[some] - shared)]
            for c in np.unique(comp[linked]).tolist():
                if c != comp[a]:
                    low, gone = min(c, int(comp[a])), max(c, int(comp[a]))
                    comp[comp == gone] = low
            if len(todo):
                todo = todo[comp[todo] != comp[a]]
    return comp


def frequencies(pdf: pd.DataFrame, width: int, buckets: int) -> pd.DataFrame:
    """How many documents hold each n-gram of a bucket (255 at most), back to the documents' buckets."""
    h = np.concatenate([wide(x, width) for x in pdf["hashes"]])
    order = np.argsort(h)
    h = h[order]
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.diff(np.r_[edge, len(h)])
    df, at = np.empty(len(h), np.uint8), 0
    df[order] = np.repeat(np.minimum(n, 255).astype(np.uint8), n)
    del h, order
    out: dict[int, list[list[np.ndarray]]] = {}
    for i, tag, c in zip(pdf["ids"], pdf["tags"], pdf["counts"], strict=True):
        keys, ids = unpack_keys(i, tag)
        tags, counts = np.frombuffer(tag, np.uint32), unz(c, np.uint32).astype(np.int64)
        own, at = df[at : at + counts.sum()], at + int(counts.sum())
        which = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        start = np.r_[0, np.cumsum(counts)]
        for s, e in runs(which[order]):
            docs = order[s:e]
            out.setdefault(int(which[docs[0]]), []).append([ids[docs], tags[docs], counts[docs].astype(np.uint32), np.concatenate([own[start[d] : start[d + 1]] for d in docs])])
    bucket = int(pdf["bucket"].iloc[0])
    rows = []
    for d, parts in out.items():
        ids, tags, counts, dfs = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows.append((d, bucket, *pack_keys(ids, tags), z(counts), z(dfs)))
    return pd.DataFrame(rows, columns=["dbucket", "bucket", "ids", "tags", "counts", "dfs"])


def aligned(dfs: pd.DataFrame) -> dict[int, np.ndarray]:
    """Row key -> document frequencies of its n-grams, in ascending order of the hashes."""
    if not len(dfs):
        return {}
    dfs = dfs.sort_values("bucket")
    keys = [unpack_keys(i, t)[0] for i, t in zip(dfs["ids"], dfs["tags"], strict=True)]
    bucket = np.repeat(dfs["bucket"].to_numpy(np.int64), [len(k) for k in keys])
    keys, counts = np.concatenate(keys), np.concatenate([unz(b, np.uint32) for b in dfs["counts"]]).astype(np.int64)
    values, start = np.concatenate([unz(b, np.uint8) for b in dfs["dfs"]]), np.r_[0, np.cumsum(counts)[:-1]]
    order = np.lexsort((bucket, keys))
    keys, bucket, counts, start = keys[order], bucket[order], counts[order], start[order]
    once = np.r_[True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])]  # a repeated row comes twice
    keys, counts, start = keys[once], counts[once], start[once]
    return {int(keys[s]): np.concatenate([values[a : a + n] for a, n in zip(start[s:e].tolist(), counts[s:e].tolist(), strict=True)]) for s, e in runs(keys)}


def set_rows(texts_: pd.DataFrame, dfs: pd.DataFrame, n: int, percent: int) -> pd.DataFrame:
    """A row for each document; those that may have partners bring their set, its digest and its prefix."""
    import xxhash

    known, hashes, out = aligned(dfs), WordHashes(), []
    for key, i, t in unpack_texts(texts_):
        g = shingles(hashes(byte_words(t, True)), n)
        own = 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42)).view(np.int64))
        row = [i, len(g), None, None, None, own]
        if len(g):
            df = known[key]
            if 100 * int((df > 1).sum()) >= percent * len(g):
                rare = np.lexsort((g, df))[: len(g) - -(-percent * len(g) // 100) + 1]
                row[2:5] = np.int64(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).view(np.int64)), g.tobytes(), g[rare[df[rare] > 1]].view(np.int64)
        out.append(row)
    return pd.DataFrame({"doc_id": pd.array([r[0] for r in out], "Int64"), "n_shingles": [r[1] for r in out], "digest": pd.array([r[2] for r in out], "Int64"), "items": [r[3] for r in out], "prefix": [r[4] for r in out], "text_key": [r[5] for r in out]})


def link_rows(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, least (doc_id and text_key of the first row of the component) of every row of docs."""
    spark = docs.sparkSession
    total = size_of(docs)
    bits, buckets = hash_bits(total, HASH_BUCKET, 6), text_buckets(total)
    width = 5 if bits < 8 else 4  # 40 bits at least, the bucket's among them
    packed = pack_hashes(docs, lambda h: (shingles(h, n), None), True, bits, width)
    dfs = packed.groupBy("bucket").applyInPandas(lambda pdf: frequencies(pdf, width, buckets), "dbucket long, bucket long, ids binary, tags binary, counts binary, dfs binary")
    rows = pack_texts(docs, buckets).groupBy("dbucket").cogroup(dfs.groupBy("dbucket")).applyInPandas(lambda t, d: set_rows(t, d, n, percent), "doc_id long, n_shingles long, digest long, items binary, prefix array<long>, text_key long")
    rows = cut(rows)

    some = rows.where("digest is not null")
    heads = some.select("digest", F.explode("prefix").alias("h")).distinct()
    least = heads.groupBy("h").agg(F.min("digest").alias("b"), F.count("*").alias("n")).where("n > 1")
    blocks = components(heads.join(least.hint("merge"), "h").select(F.col("digest").alias("a"), "b").distinct())
    large = blocks.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1")
    blocks = blocks.join(large.hint("merge"), "comp").select(F.col("node").alias("digest"), "comp", F.when(F.col("size") <= CHUNK, 1).otherwise(F.ceil(F.sqrt(F.col("size") * 8 / CHUNK))).cast("int").alias("chunks"))
    sets = some.groupBy("digest").agg(F.first("items").alias("items")).join(blocks.hint("merge"), "digest")
    own = F.pmod(F.xxhash64("digest"), F.col("chunks"))
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.expr("filter(sequence(0L, cast(chunks - 1 as bigint)), x -> x <> own)"))))
    sets = sets.select("digest", "items", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "chunks")
    sets = sets.withColumn("deal", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("comp"), F.lit(4 * buckets))).otherwise(F.xxhash64("comp", "i", "j")))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby(["comp", "i", "j"], sort=True):
            part = part.sort_values("digest")
            digests = part["digest"].to_numpy(np.int64)
            comp = link_block([np.frombuffer(x, np.uint64) for x in part["items"]], percent)
            a.append(digests)
            b.append(digests[comp])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    edges = sets.groupBy("deal").applyInPandas(join, "a long, b long").where("a <> b")
    comps = components(edges)
    every = rows.select("doc_id", "text_key", "n_shingles", "digest").join(comps.withColumnRenamed("node", "digest").hint("merge"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    linked = every.where("comp is not null")
    least = linked.groupBy("comp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least"))
    linked = linked.join(least.hint("merge"), "comp").select("doc_id", "text_key", "n_shingles", "least")
    return linked.unionByName(rows.where("digest is null").select("doc_id", "text_key", "n_shingles", F.struct("doc_id", "text_key").alias("least")))


def link(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return link_rows(docs, n, percent).select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of every document."""
    return link(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: one row of each component, the one with the least id (of one id, the least text key); rows without an id all stay.

    A row is named by id and text: an id's other texts stay unless they are near copies themselves.
    """
    kept = without(docs, link_rows(docs).where("doc_id is not null and (doc_id <> least.doc_id or text_key <> least.text_key)"))
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null")) if twice else kept
