"""Sharding by jump consistent hashing, by DataFrame functions alone.

A stable key walks along the shard numbers by jumps drawn from a 64-bit linear congruential generator that the key seeds; the
last place before the number of shards is its shard. No table of the ring is kept, and where shards are appended, a key
either stays or goes to one of the new ones. A key here is the first 64 bits of the MD5 of the id as text, so ids in any
pattern spread alike.

Slots number the rows of a shard from 0, without gaps, in the order of the MD5 of (id, size, checksum); so a shard is read in
a shuffled order that doesn't depend on the layout of the input. Rows alike in all three are counted before they are dealt, so
repeats of one row, however many, meet in no task.

A null id is a key of its own (the empty text), as is each id; rows that share an id share a shard, by the law. A null text
has no bytes and checksum 0. Texts of any length count whole; an empty table gives no rows; other columns are not read by
`slots`, and kept, whatever their names but `shard`, by `assign` and `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import cut, table
from fieldspark.llm.crc_sql import CRC_STEPS, crc_of

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Distinct rows numbered by one task, and bytes of text in one written file.
ROWS_A_CELL, FILE_BYTES = 100_000, 256 << 20
#: Jumps walked in the first place; few keys of few walks need more, and those walk on.
JUMPS = 16
#: Fixed value: the multiplier of the generator.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64, by 32-bit halves of the key and 16-bit parts of the multiplier: nothing passes 2^51."""
    m0, m1, m2, m3 = ((MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48))
    mid = lo * m1
    low = lo * m0 + 1 + F.shiftleft(mid.bitwiseAND(0xFFFF), 16)
    high = F.shiftright(low, 32) + F.shiftright(mid, 16) + lo * m2 + F.shiftleft((lo * m3).bitwiseAND(0xFFFF), 16) + hi * m0 + F.shiftleft((hi * m1).bitwiseAND(0xFFFF), 16)
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def key_of(ident: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of an id's key."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, p, 8), 16, 10).cast("long") for p in (1, 9))  # type: ignore[return-value]


def walk(ident: Column, shards: int) -> Column:
    """hi, lo, last, place: the last place before `shards`, and the first one at or past it."""
    hi, lo = key_of(ident)

    def jump(at: Column, _: Column) -> Column:
        up, down = _next(at["hi"], at["lo"])
        place = F.floor((at["place"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(up, 1) + 1).cast("double")))
        return F.when(at["place"] < shards, F.struct(up.alias("hi"), down.alias("lo"), at["place"].alias("last"), place.alias("place"))).otherwise(at)

    begin = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("place"))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(JUMPS)), begin, jump)
    # places ascend, so at most `shards` jumps lie before the end
    return F.aggregate(F.when(first["place"] >= shards, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(shards))), first, jump)


def jump_hash(ident: Column, shards: int) -> Column:
    """The shard of an id, 0 to shards - 1."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    return walk(ident, shards)["last"].cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """docs with their `shard`."""
    return docs.withColumn("shard", jump_hash(F.col(f"`{id_col}`"), shards))


def moves(docs: DataFrame, before: int, after: int, id_col: str = "doc_id") -> DataFrame:
    """docs whose shard changes when the number of shards goes from before to after, with the column `from_shard` and `shard`."""
    old = jump_hash(F.col(f"`{id_col}`"), before)
    return assign(docs.withColumn("from_shard", old), after, id_col).where("from_shard <> shard")


def slots(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # equal rows are counted by task, so a row that fills a third of the table comes as one row from each task
    rows = cut(rows.groupBy("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")))
    rank = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    cells, digits = max(1, rows.count() // ROWS_A_CELL), 1
    while 16**digits * shards < cells:
        digits += 1
    seen = rows.withColumn("rank", rank).withColumn("cell", F.substring("rank", 1, digits)).withColumn("walk", walk(F.col("doc_id"), shards))
    seen = seen.select("doc_id", "size", "text_crc32", "part", "n", "rank", "cell", F.col("walk.last").cast("int").alias("shard"), F.when(F.col("walk.place") == shards, F.lit(shards)).otherwise(F.col("walk.last")).cast("int").alias("grown_shard"))
    # shards x 16^digits rows, about one for ROWS_A_CELL distinct rows
    counts = seen.groupBy("shard", "cell").agg(F.sum("n").alias("of_cell"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("of_cell").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "cell").orderBy("rank", "doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(inner), F.lit(0))
    numbered = seen.withColumn("first", first).join(counts, ["shard", "cell"]).withColumn("first", F.col("first") + F.col("offset"))
    dealt = numbered.repartition("part", "rank")  # so that the repeats of a frequent row are written out by many tasks
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    return dealt.select("doc_id", "size", "text_crc32", "shard", each.alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet with a folder for each shard; a large shard is dealt to files of about FILE_BYTES of text."""
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) + ROW_BYTES
    total = docs.agg(F.sum(size)).first()[0] or 0
    files = max(1, -(-total // (FILE_BYTES * shards)))
    mixed = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`").cast("string"), F.spark_partition_id()), F.lit(files))
    assign(docs, shards, id_col).repartition(shards * files, "shard", mixed).write.partitionBy("shard").parquet(path)


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_STEPS},
d AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) size, {crc_of("coalesce(text, '')")} text_crc32, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) k FROM documents, crc_steps),
walk(k, key, last, place) AS (SELECT DISTINCT k, k, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d UNION ALL
  SELECT k, step, place, CAST(floor((place + 1) * (CAST(2147483648 AS DOUBLE) / CAST((step >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, CAST((CAST(key AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS UBIGINT) step FROM walk WHERE place < 40)),
ends AS (SELECT k, last, place FROM walk WHERE place >= 40)
SELECT doc_id, size, text_crc32, 'key' law, CAST(last AS INT) shard,
  CAST(row_number() OVER (PARTITION BY last ORDER BY md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', size, ':', text_crc32)), doc_id, size, text_crc32) - 1 AS BIGINT) slot, CAST(CASE WHEN place = 40 THEN 40 ELSE last END AS INT) grown_shard
FROM d JOIN ends USING (k)
"""


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and its place there, and its shard of 41."""
    return slots(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
