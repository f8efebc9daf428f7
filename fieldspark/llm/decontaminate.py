"""Benchmark decontamination by template canonicalisation, by DataFrame functions alone.

Numbers, names (capitalised words within a sentence) and units after numbers become typed placeholders; a template is the
run of WINDOW words of the canonical text, lower-cased and without punctuation. Templates of the benchmark and of all
documents are hash-joined; matches of a document and an item are gathered by alignment (document place minus item place).
In an alignment the slots must be consistent: each value of the item's slots stands for one value of the document's. Such an
alignment is a leak if it has MATCHES templates or SHARE of the item's.

The first word of a text is never a placeholder, but may be one where a document quotes the text within a sentence; so a
document's templates that begin with a name or unit are also put with that word as it is.

Items with fewer than WINDOW words are one template of their own length. Templates with fewer than SOLID plain words are
passed over and not counted. Items that have no other templates, or fewer than LEAST words, are leaked where all their words
follow each other as they are. Null texts, texts without words and items without an id are never found. Repeated items and repeated documents give one
row for each pair of ids; items that share an id but not the text are each looked for, and the best match tells the row; a null document id finds nothing. Texts of one id are compared each by itself. The item side is broadcast up to BROADCAST templates and
shuffled beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import cut, table, text_key, texts, without

WINDOW, LEAST, SOLID = 8, 4, 3
MATCHES, SHARE = 5, 0.5
BROADCAST = 500_000
#: This library's own choice: placeholders, and units.
NUMBER, NAME, UNIT = "xnumx", "xnamex", "xunitx"
UNITS = "km m cm mm nm mi ft kg g mg t lb oz l ml s ms min h hr hrs hz khz mhz ghz w kw kwh v a j kj pa kpa bar usd eur gbp dollars euros pounds cents percent degrees hours minutes seconds days weeks months years miles meters metres grams liters litres kilometers kilometres kilograms"
_TOKEN = r"[\p{L}\p{N}]+(?:[.,][0-9]+)*"


def canonical(text: Column) -> tuple[Column, Column]:
    """Words of a text as they are, and as canonical words, place by place."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}][,;:]? )\p{Lu}[\p{Ll}]+(?![\p{L}\p{N}])", NAME)
    numbered = F.regexp_replace(named, r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*", f" {NUMBER} ")
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    numbered = F.regexp_replace(numbered, rf"(?i)(?<= {NUMBER} ) *(?:{units})(?![\p{{L}}\p{{N}}])", f" {UNIT} ")
    plain = F.regexp_replace(text, r"(?<![\p{L}\p{N}])([0-9]+(?:[.,][0-9]+)*)", " $1 ")
    pick = lambda t: F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))
    has = text.rlike("[0-9]")
    return pick(F.when(has, plain).otherwise(text)), pick(F.lower(F.when(has, numbered).otherwise(named)))


def _starts(words: Column, size: Column) -> Column:
    """Places at which a run of `size` words begins."""
    n = F.size(words)
    return F.when((size > 0) & (n >= size), F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _run(words: Column, size: Column):
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + 1, size)).alias("template"))


def _run_from(own: Column, canon: Column, size: Column):
    """A run whose first word is as it is."""
    return lambda i: F.struct(i.alias("at"), F.xxhash64(F.concat(F.array(F.lower(F.get(own, i))), F.slice(canon, i + 2, size - 1))).alias("template"))


def templates(rows: DataFrame, canonical_sizes: list[int], plain_sizes: list[int]) -> DataFrame:
    """rows without (words, canon), with (at, template) of every run of those sizes of canonical, and of plain, words."""
    own, canon = F.col("words"), F.col("canon")
    found = []
    for n in canonical_sizes:
        starts = _starts(canon, F.lit(n))
        found.append(F.transform(starts, _run(canon, F.lit(n))))
        masked = F.filter(starts, lambda i: F.get(canon, i).isin(NAME, UNIT))
        found.append(F.transform(masked, _run_from(own, canon, F.lit(n))))
    for n in plain_sizes:
        plain = F.transform(own, lambda w: F.lower(w))
        found.append(F.transform(_starts(own, F.lit(n)), _run(plain, F.lit(n))))
    return rows.select(*[c for c in rows.columns if c not in ("words", "canon")], F.inline(F.concat(*found)))


def item_templates(items: DataFrame, window: int) -> DataFrame:
    """item_id, size, exact, item_at, template, item_words, item_canon, n_templates: one row for each template of an item.

    item_id here is the id with the text's hash: items that share an id but not the text are items of their own.
    exact: templates can't carry the item, so its runs are of plain words, and all of them are needed.
    """
    rows = items.where("item_id is not null").distinct().select(F.struct("item_id", F.xxhash64("text").alias("text_key")).alias("item_id"), "text")
    own, canon = canonical(F.col("text"))
    rows = rows.select("item_id", own.alias("item_words"), canon.alias("canon")).withColumn("size", F.least(F.size("canon"), F.lit(window))).where("size > 0")
    solid = lambda i: F.size(F.filter(F.slice("canon", i + 1, F.col("size")), lambda w: ~w.isin(NUMBER, NAME, UNIT))) >= SOLID
    rows = rows.withColumn("solid", F.filter(_starts(F.col("canon"), F.col("size")), solid))
    rows = rows.withColumn("exact", (F.size("canon") < LEAST) | (F.size("solid") == 0))
    rows = rows.withColumn("item_canon", F.when(F.col("exact"), F.transform("item_words", lambda w: F.lower(w))).otherwise(F.col("canon")))
    rows = rows.withColumn("places", F.when(F.col("exact"), _starts(F.col("item_canon"), F.col("size"))).otherwise(F.col("solid"))).withColumn("n_templates", F.size("places"))
    runs = F.inline(F.transform("places", _run(F.col("item_canon"), F.col("size"))))
    return rows.select("item_id", "size", "exact", "item_words", "item_canon", "n_templates", runs).withColumnRenamed("at", "item_at")


def leaking_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, item_id, n_matched, n_templates, reparameterised of every leak. items has item_id, text."""
    items = cut(item_templates(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), window))
    counts = items.groupBy("size", "exact").agg(F.count("*").alias("n")).collect()  # at most two rows for each size up to `window`
    docs = texts(docs).where("doc_id is not null")
    if not counts:
        return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_matched"), F.lit(0).alias("n_templates"), F.lit(False).alias("reparameterised")).where("false")
    small = items.select("template", "item_id", "item_at")
    small = F.broadcast(small) if sum(r["n"] for r in counts) <= BROADCAST else small
    own, canon = canonical(F.col("text"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), own.alias("words"), canon.alias("canon"))
    found = templates(rows, [r["size"] for r in counts if not r["exact"]], [r["size"] for r in counts if r["exact"]]).join(small, "template")
    hits = found.groupBy("doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.countDistinct("item_at").alias("n_matched"), F.collect_set("item_at").alias("places"))
    hits = hits.join(items.groupBy("item_id").agg(F.first("n_templates").alias("n_templates"), F.first("size").alias("size"), F.first("exact").alias("exact"), F.first("item_canon").alias("item_canon"), F.first("item_words").alias("item_words")), "item_id")
    hits = cut(hits.where(F.when(F.col("exact"), F.col("n_matched") == F.col("n_templates")).otherwise((F.col("n_matched") >= MATCHES) | (F.col("n_matched") >= SHARE * F.col("n_templates")))))
    slotted = hits.where(~F.col("exact")).where(F.exists("item_canon", lambda w: w.isin(NUMBER, NAME, UNIT)))
    slots = slotted.select("doc_id", "text_key", "item_id", "shift", "item_words", "item_canon", F.explode(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1))))).alias("p"))
    slots = slots.where(F.get("item_canon", F.col("p")).isin(NUMBER, NAME, UNIT)).select("doc_id", "text_key", "item_id", "shift", "p", F.lower(F.get("item_words", F.col("p"))).alias("item_value"))
    own = docs.withColumn("text_key", text_key(F.col("text"))).join(slots.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"]).select("doc_id", "text_key", canonical(F.col("text"))[0].alias("words"))
    values = slots.join(own, ["doc_id", "text_key"]).select("doc_id", "text_key", "item_id", "shift", "item_value", F.lower(F.get("words", F.col("p") + F.col("shift"))).alias("value"))
    values = values.groupBy("doc_id", "text_key", "item_id", "shift", "item_value").agg(F.countDistinct("value").alias("n"), F.max(F.col("value") != F.col("item_value")).alias("changed"))
    slot = values.groupBy("doc_id", "text_key", "item_id", "shift").agg(F.max("n").alias("most"), F.max("changed").alias("changed"))
    done = hits.join(slot, ["doc_id", "text_key", "item_id", "shift"], "left").where("coalesce(most, 1) = 1")
    return _best(done.withColumn("reparameterised", F.coalesce("changed", F.lit(False))).withColumn("item_id", F.col("item_id.item_id")), "doc_id", "text_key", "item_id")


def _best(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys).agg(F.max("n_matched").alias("n_matched"), F.max("n_templates").alias("n_templates"), F.min("reparameterised").alias("reparameterised"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, n_matched, n_templates, reparameterised of every leak. items has item_id, text."""
    return _best(leaking_rows(docs, items, window), "doc_id", "item_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it leaks."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: rows (id and text) without a leak; rows without an id stay."""
    return without(docs, leaking_rows(docs, table(spark, sf_dir, "benchmark")))
