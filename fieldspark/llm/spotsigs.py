"""SpotSigs fingerprints, by DataFrame functions alone.

A signature is the chain of the next CHAIN content words after an anchor, a common word; content words are all others. A
fingerprint is the set of a text's signatures, as numbers in order. Texts are alike as their sets' Jaccard index.

A text without any chain has one signature, the whole text; the empty text (and null) has none. Two empty sets are alike by
1, an empty and another by 0. A null id comes before all ids; the texts of one id follow one another in the order of their
hashes. An empty table gives no rows. Texts of any length count
whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import cut, table, texts

#: Common words of the four languages.
ANCHORS = (
    "a an and are as at be by for from has have he in is it not of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour qui que sur un une "
    "als auf aus bei das dem den der die ein eine für ist mit nicht sich sie und von zu "
    "al como con del el es la las los lo no para por se su una y"
)
CHAIN = 2
ROWS_A_CELL, MOST_CELLS = 2000, 1 << 16
_WORD, _GAP, _MARK = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]++", "\u0001"


def by_letters(words: list[str]) -> str:
    """A pattern of all the words, branching letter by letter, so that a word is compared with few."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (by_letters(rest) if rest != [""] else "") for h, rest in sorted(heads.items()) if h]
    inner = parts[0] if len(parts) == 1 and "" not in words else "(?:" + "|".join(parts) + ")"
    return inner + ("?+" if "" in words else "")


def signatures(text: Column) -> Column:
    """Distinct signatures of a text, as 64-bit hashes, ascending.

    The text is cut at its anchors. What lies between two of them is content words alone, so an anchor's chain is the first
    CHAIN words of the pieces that follow it; each piece but the last has a word at least.
    """
    text = F.coalesce(text, F.lit(""))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _GAP, " "), F.lit(" "))
    pieces = F.split(spaced, rf" (?:{by_letters(sorted(set(ANCHORS.split())))} )++")

    def chains(p: Column) -> Column:
        after = lambda k: F.slice(p, F.lit(k + 1), F.size(p))
        found = after(1)
        for k in range(2, CHAIN + 1):
            found = F.zip_with(found, after(k), lambda a, b: F.concat_ws(" ", a, b))
        heads = F.transform(found, lambda s: F.substring_index(F.trim(s), " ", CHAIN))
        return F.array_sort(F.array_distinct(F.transform(F.filter(heads, lambda s: F.instr(s, " ") > 0), lambda s: F.xxhash64(s))))

    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text, F.lit("whole"))))
    return once(once(pieces, chains), lambda spots: F.when(F.size(spots) > 0, spots).otherwise(whole))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(spots: Column) -> Column:
    """The signatures themselves, as numbers joined by spaces: likeness can be told from two fingerprints alone."""
    return F.array_join(spots.cast("array<string>"), " ")


def spots_of(fingerprint: Column) -> Column:
    """The signatures of a fingerprint."""
    return F.when(fingerprint == "", F.array().cast("array<bigint>")).otherwise(F.split(fingerprint, " ").cast("array<bigint>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of signatures."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared.cast("double") / union)


def cells(docs: DataFrame, n: int) -> Column:
    """The cell of a row (doc_id, key) in the order of ids, then keys, of about ROWS_A_CELL rows each and at most MOST_CELLS.

    Cells end at quantiles of the ids, so that outlying ids empty none and crowd none. An id that fills several cells is dealt
    to them by ranges of its rows' keys. Null ids come first.
    """
    wanted = min(MOST_CELLS, max(1, n // ROWS_A_CELL))
    shares = [k / wanted for k in range(1, wanted)]
    ends = docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted)).first()[0] if shares else None
    if not ends:
        return F.lit(0)
    bounds = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(ends).bit_length() - 1, -1, -1)])
    below = lambda test: F.aggregate(steps, F.lit(0), lambda at, step: F.when(test(F.get(bounds, at + step - 1)), at + step).otherwise(at))
    low, high = below(lambda e: e < F.col("doc_id")), below(lambda e: e <= F.col("doc_id"))
    share = F.col("key") / F.lit(2.0**64) + 0.5
    return F.when(F.col("doc_id").isNull(), 0).otherwise(low + F.floor(share * (high - low) * 0.999999).cast("int"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots, next_text, next_spots: every document beside the next by id; the first follows the last.

    Documents meet in cells of neighbours; each cell also gets, as a guest, the first row of the next one that has any. There
    is one such row for each cell, so these are broadcast, and put in order by one small task.
    """
    docs = texts(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))
    docs = docs.withColumn("cell", cells(docs, docs.count()))
    heads = docs.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "key")).alias("head")).withColumn("all", F.lit(0))
    ring = Window.partitionBy("all").orderBy("cell")
    last = F.last("cell").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("head.doc_id").alias("head_id"), F.col("head.key").alias("head_key"), F.coalesce(F.lag("cell").over(ring), last).alias("to"))
    guests = docs.join(F.broadcast(cut(heads)), docs["doc_id"].eqNullSafe(F.col("head_id")) & (docs["key"] == F.col("head_key")))
    guests = guests.select("doc_id", "text", "key", F.col("to").alias("cell"), F.lit(True).alias("guest")).dropDuplicates(["cell"])
    rows = docs.withColumn("guest", F.lit(False)).select("doc_id", "text", "key", "cell", "guest").unionByName(guests)
    rows = rows.repartition("cell").withColumn("spots", signatures(F.col("text")))
    after = Window.partitionBy("cell").orderBy("guest", F.col("doc_id").asc_nulls_first(), "key")
    rows = rows.withColumn("next_text", F.lead("text").over(after)).withColumn("next_spots", F.lead("spots").over(after))
    return rows.where("not guest").select("doc_id", "text", "spots", "next_text", "next_spots")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, spots of every document."""
    return texts(docs).select("doc_id", signatures(F.col("text")).alias("spots")).select("doc_id", fingerprint(F.col("spots")).alias("fingerprint"), "spots")


def similar_pairs(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_a, doc_b, likeness of representatives of equal fingerprints that reach the threshold.

    Sets are dealt to partitions of lengths so wide that a partner falls to the same or the next; there they meet by the
    signatures of their prefixes (rarest first), and a pair is compared only if its lengths let it reach the threshold.
    """
    base = 100 / percent
    sets = fingerprints(docs).where("size(spots) > 0 and doc_id is not null").groupBy(F.md5("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.first("spots").alias("spots"))
    sets = sets.withColumn("n", F.size("spots")).withColumn("part", F.floor(F.log(base, F.col("n") + 1e-9)))
    long = sets.select("doc_id", "n", "part", F.explode("spots").alias("s"))
    rare = long.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("doc_id").orderBy("df", "s")
    heads = long.join(rare, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", F.row_number().over(order))
    heads = heads.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("df > 1")
    a = heads.select(F.col("doc_id").alias("doc_a"), F.col("n").alias("n_a"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("p"))
    b = heads.select(F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b"), "s", F.col("part").alias("p"))
    pairs = a.join(b, ["s", "p"]).where((F.col("doc_a") != F.col("doc_b")) & (F.col("n_a") <= F.col("n_b")) & ((F.col("n_a") < F.col("n_b")) | (F.col("doc_a") < F.col("doc_b"))) & (F.col("n_a") * 100 >= F.col("n_b") * percent))
    pairs = pairs.select("doc_a", "doc_b").distinct()
    left, right = sets.select(F.col("doc_id").alias("doc_a"), F.col("spots").alias("spots_a")), sets.select(F.col("doc_id").alias("doc_b"), F.col("spots").alias("spots_b"))
    out = pairs.join(left, "doc_a").join(right, "doc_b").withColumn("likeness", likeness(F.col("spots_a"), F.col("spots_b")))
    return out.where(F.col("likeness") * 100 >= percent).select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "likeness")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to it and to the next document's."""
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    # a generator of one struct keeps what is computed once from being computed for each use
    rows = rows.select("doc_id", "spots", "next_spots", F.inline(F.array(F.struct(n.cast("long").alias("n_chars"), edited.alias("edited")))))
    spots = F.struct("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("spots").alias("own"), signatures(F.col("edited")).alias("changed"), F.col("next_spots").alias("next"))
    rows = rows.select(F.inline(F.array(spots)))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
