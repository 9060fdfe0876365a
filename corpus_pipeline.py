"""A corpus pipeline of five stages; each reads what the one before it has written.

The stages keep the columns of their input; the last adds ``shard`` and ``slot``. Rows without a text go at the first stage, which keeps only what
the quality rules accept. Rows without a doc_id link with nothing and leak nothing. Of rows that repeat, the second stage keeps one; the mix may
then take a row up to three times. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, ngram_join, quality_rules, resharding
from tidemark.llm.common import scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_docs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resharding.placed(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("resharding", shards),
]

#: The fit of the quality rules iterates, which SQL cannot express; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # what a stage wrote on its way goes when its result is written
            docs = keep(written(stage(spark, docs, sf_dir), name))
    return docs
