"""Licence scans: a paragraph classifier, confirmed by templates; DataFrame and ML pipeline stages of Spark alone.

Paragraphs are a document's lines. All of them are scored, whatever their length, in overlapping windows of WINDOW words, and a
line holds what one of its windows holds. Windows are put as sparse word 1- and 2-grams (features are those of the module's
texts that are not made of common words alone) before a multinomial logistic regression with an L1
penalty: a sparse sum of weight rows. It is trained on the licence texts of each family, on notices of other licences (class `unknown`), and on what is no licence (class
`none`): the paragraphs of the module, and the longest window each of at most BACKGROUND documents at hand, least xxhash64 of
the text, of LEAST words or more that share no 3-gram with a licence text. A window that looks like a licence but whose best family is less likely
than a cut is `unknown`; the cut is calibrated on held-back rows of all classes. A family is confirmed if the window holds most
of one of its texts, or lies in one.

Most lines need no sum: where all features that a line could have besides the strong ones together can't outweigh the lead of
`none`, a line without the words of strong features is `none` by the model itself. The strong features follow from the
trained weights; a test holds this against sums over all lines.

Null and empty texts hold no licence. Repeated rows count as often as they come, in one row for each id; a null id gives rows
with a null id. An empty table gives no rows. Columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import cut, table, texts
from fieldspark.llm.license_texts import FAMILIES, NONE, OTHER
from fieldspark.llm.spotsigs import ANCHORS, by_letters, once

COMMON = sorted(set(ANCHORS.split()))
UNKNOWN, NO_LICENCE = "unknown", "none"
CONFIRM = 0.8
PRECISION = 0.98
PENALTY = 0.0003
BACKGROUND, LEAST = 2000, 12
#: Words of a window, and between the starts of two: a text of up to WINDOW - STEP words lies whole in one.
WINDOW, STEP = 96, 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def grams(w: Column, most: int = 2) -> Column:
    """Word n-grams of up to `most` words."""
    runs = [w]
    for k in range(2, most + 1):
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(0))), F.slice(w, F.lit(k), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*runs)


def windows(w: Column) -> Column:
    """The words of a line as one window, or as overlapping ones, the last of which ends the line."""
    n = F.size(w)
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + STEP, F.lit(1)), F.lit(STEP))
    return F.transform(starts, lambda i: F.slice(w, i, WINDOW))


def pieces(docs: DataFrame, of: Callable[[Column], Column] = lambda text: text.isNotNull()) -> DataFrame:
    """doc_id, row, line, w: the windows of all lines of all documents of which `of` holds."""
    rows = texts(docs).where(of(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", r"[\r\n]+")).alias("line", "text")).where(of(F.col("text")))
    found = lines.select("doc_id", "row", "line", F.explode(F.array(words(F.col("text")))).alias("w")).where("size(w) > 0")
    return found.select("doc_id", "row", "line", F.explode(windows(F.col("w"))).alias("w"))


def known_runs() -> Column:
    """The 3-grams of all licence texts."""
    every = [t for ts in FAMILIES.values() for t in ts] + OTHER
    return F.array_distinct(F.flatten(F.array(*[F.filter(grams(words(F.lit(t)), 3), lambda g: F.size(F.split(g, " ")) == 3) for t in every])))


def training_rows(spark: SparkSession, docs: DataFrame | None = None) -> DataFrame:
    """family, w, fold: the texts, their halves, and the texts with words around them; windows of docs that are no licence."""
    rows = [(f, t) for f, ts in FAMILIES.items() for t in ts] + [(UNKNOWN, t) for t in OTHER] + [(NO_LICENCE, t) for t in NONE]
    base = spark.createDataFrame(rows, "family string, text string")
    w = F.split("text", " ")
    n = F.size(w)
    forms = F.array(
        F.col("text"),
        F.concat_ws(" ", F.lit("Note:"), "text"),
        F.concat_ws(" ", "text", F.lit("See the file for details.")),
        F.when(n >= 12, F.array_join(F.slice(w, F.lit(1), (n * 2 / 3).cast("int")), " ")),
        F.when(n >= 12, F.array_join(F.slice(w, (n / 3).cast("int") + 1, n), " ")),
    )
    found = base.select("family", F.explode(forms).alias("text")).where("text is not null").select("family", words(F.col("text")).alias("w"))
    if docs is not None:
        some = texts(docs).where("length(text) > 0").select(F.xxhash64("text").alias("h"), "text").orderBy("h").limit(BACKGROUND)  # a documented bound on training alone
        some = pieces(some.select(F.col("h").alias("doc_id"), "text")).groupBy("doc_id").agg(F.max(F.struct(F.size("w").alias("n"), "w")).alias("x")).select("x.*").where(F.col("n") >= LEAST)
        runs = F.slice(grams(F.col("w"), 3), 2 * F.size("w"), F.size("w"))
        found = found.unionByName(some.where(~F.arrays_overlap(runs, known_runs())).select(F.lit(NO_LICENCE).alias("family"), "w"))
    return found.withColumn("fold", F.pmod(F.xxhash64("w"), F.lit(4)))


class Classifier:
    """The trained weights, class names and the cut below which what looks like a licence is unknown."""

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None):
        self.spark, self.names = spark, [*sorted(FAMILIES), UNKNOWN, NO_LICENCE]
        every = [t for ts in FAMILIES.values() for t in ts] + OTHER + NONE
        own = spark.createDataFrame([(t,) for t in every], "text string").select(F.explode(grams(words(F.col("text")))).alias("g")).distinct()
        own = own.where(F.exists(F.split("g", " "), lambda w: ~w.isin(COMMON))).orderBy("g")
        self.grams = [r["g"] for r in own.collect()]  # n-grams of the module's texts alone
        numbers = F.broadcast(spark.createDataFrame([(g, k) for k, g in enumerate(self.grams)], "g string, i int"))
        rows = cut(training_rows(spark, docs).withColumn("id", F.monotonically_increasing_id()))
        have = rows.select("id", F.explode(F.array_distinct(grams(F.col("w")))).alias("g")).join(numbers, "g").groupBy("id").agg(F.collect_list("i").alias("own"))
        flags = F.transform(F.sequence(F.lit(0), F.lit(len(self.grams) - 1)), lambda i: F.array_contains("own", i).cast("double"))
        label = F.array_position(F.array(*[F.lit(n) for n in self.names]), F.col("family")).cast("double") - 1
        table_ = rows.join(have, "id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>"))).select("fold", array_to_vector(flags).alias("features"), label.alias("label")).repartition(1).cache()
        fit = LogisticRegression(maxIter=30, regParam=PENALTY, elasticNetParam=1.0, family="multinomial", standardization=False)
        half = self._table(fit.fit(table_.where("fold > 0")))
        best = self._best(half, rows.where("fold = 0")).where(~F.col("best").isin(UNKNOWN, NO_LICENCE))
        seen = [(r["p"], r["ok"]) for r in best.select("p", (F.col("best") == F.col("family")).alias("ok")).collect()]  # a few dozen rows
        self.cut = self._calibrate(seen)
        self.weights = self._table(fit.fit(table_))
        self.strong = self._strong(*self.weights)
        table_.unpersist()

    def _table(self, model) -> tuple[list[list[float]], list[float]]:
        """A row of weights for each feature; intercepts."""
        return model.coefficientMatrix.toArray().T.tolist(), model.interceptVector.toArray().tolist()

    def _strong(self, m: list[list[float]], intercepts: list[float]) -> list[str]:
        """Words of the features without which `none` keeps its lead."""
        none = self.names.index(NO_LICENCE)
        gain = [max(0.0, *(x - r[none] for x in r)) for r in m]
        lead = intercepts[none] - max(x for k, x in enumerate(intercepts) if k != none)
        weak, strong = 0.0, set()
        for g, name in sorted(zip(gain, self.grams, strict=True)):
            weak += g
            if weak >= 0.999 * lead:
                strong.add(next(w for w in sorted(name.split(" "), key=len, reverse=True) if w not in COMMON))
        return sorted(strong)

    def _best(self, weights: tuple[list[list[float]], list[float]], rows: DataFrame) -> DataFrame:
        """rows (id, w) with best (the likeliest class) and p (its probability): a join of their n-grams to the weights.

        The weights have a row for each feature that bears any, so their number is bounded by the module's texts.
        """
        m, intercepts = weights
        some = self.spark.createDataFrame([(g, *r) for g, r in zip(self.grams, m, strict=True) if any(r)], ", ".join(["g string", *(f"c{k} double" for k in range(len(self.names)))]))
        sums = rows.select("id", F.explode(F.array_distinct(grams(F.col("w")))).alias("g")).join(F.broadcast(some), "g").groupBy("id").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(self.names))])
        total = F.array(*[F.coalesce(F.col(f"c{k}"), F.lit(0.0)) + x for k, x in enumerate(intercepts)])
        out = rows.join(sums, "id", "left").select(*rows.columns, F.explode(F.array(total)).alias("sums")).withColumn("top", F.array_max("sums"))
        p = 1 / F.aggregate("sums", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
        return out.select(*rows.columns, p.alias("p"), F.get(F.array(*[F.lit(n) for n in self.names]), F.array_position("sums", F.col("top")).cast("int") - 1).alias("best"))

    def undecided(self, text: Column) -> Column:
        """False where the text has no word of a strong feature."""
        return F.lower(text).rlike(rf"(?<![a-z0-9])(?:{by_letters(self.strong)})(?![a-z0-9])") if self.strong else F.lit(False)

    @staticmethod
    def _calibrate(seen: list[tuple[float, bool]]) -> float:
        """The least cut from which on the share of right answers is PRECISION; 1 if no cut has it, 0 without answers."""
        right = n = 0
        cut = 1.0 if seen else 0.0
        for p, ok in sorted(seen, reverse=True):
            n, right = n + 1, right + ok
            if right >= PRECISION * n:
                cut = p
        return float(cut)

    def classify(self, windows_: DataFrame) -> DataFrame:
        """windows (with w) that are no `none`, and family, p."""
        out = self._best(self.weights, cut(windows_.withColumn("id", F.monotonically_increasing_id()))).drop("id").where(F.col("best") != NO_LICENCE)
        return out.withColumn("family", F.when(F.col("p") < self.cut, UNKNOWN).otherwise(F.col("best"))).drop("best")


def confirmed(family: Column, w: Column) -> Column:
    """Does the window hold most of a text of the family, or lie in one?"""

    def tests(own: Column) -> Column:
        out = F.lit(False)
        for name, forms in FAMILIES.items():
            hit = F.lit(False)
            for form in forms:
                t = F.array_distinct(grams(words(F.lit(form)), 3))
                shared = F.size(F.array_intersect(own, t))
                hit = hit | (shared >= CONFIRM * F.size(t)) | ((shared >= CONFIRM * F.size(own)) & (F.size(own) >= 9))
            out = F.when(family == name, hit).otherwise(out)
        return out

    return once(F.array_distinct(grams(w, 3)), tests)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, family, n_paragraphs, probability, confirmed: licences that documents hold."""
    model = Classifier(docs.sparkSession, docs)
    found = model.classify(pieces(docs, model.undecided)).withColumn("confirmed", confirmed(F.col("family"), F.col("w")))
    by_line = found.groupBy("doc_id", "row", "line", "family").agg(F.max("p").alias("p"), F.max("confirmed").alias("confirmed"))
    return by_line.groupBy("doc_id", "family").agg(F.count("*").alias("n_paragraphs"), F.round(F.max("p"), 6).alias("probability"), F.max("confirmed").alias("confirmed"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan(table(spark, sf_dir, "documents"))
