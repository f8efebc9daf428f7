"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this subpackage
MODULES = {
    "op1_spotsigs": "spotsigs",
    "op2_decontaminate": "decontaminate",
    "op3_licenses": "licenses",
    "op4_quality": "quality",
    "op5_language_model": "hpy",
    "op6_pii": "pii",
    "op7_jaccard": "jaccard",
    "op8_substrings": "substring",
    "op9_html": "html",
    "op10_bpe": "bpe",
    "op11_collocations": "collocations",
    "op12_shards": "sharding",
    "op13_runs": "runs",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return getattr(import_module(f"fieldspark.llm.{MODULES[name]}"), name)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"fieldspark.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
