"""Corpus pipeline: quality, near copies, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import bpe
from fieldspark.llm.common import shared_dir, table
from fieldspark.llm.decontaminate import drop_leaks
from fieldspark.llm.jaccard import one_of_each
from fieldspark.llm.pii import mask_private
from fieldspark.llm.quality import keep_good


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: token ids and decoded text of each document."""
    return bpe.encode(docs, bpe.default_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("personal data", mask_private),
    ("BPE encoding", to_ids),
]

#: The trained stages and the tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is a Parquet table in the shared folder."""
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
    return docs
