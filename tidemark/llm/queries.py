"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, mixing, ngram_join, quality_rules, resharding, substring_dedup, token_counts, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": lambda s, d: substring_dedup.digest(table(s, d, "documents")),
        "op2_quality_rules": lambda s, d: quality_rules.digest(table(s, d, "documents")),
        "op3_token_counts": lambda s, d: token_counts.counted(table(s, d, "documents")),
        "op4_decontamination": lambda s, d: decontaminate.contained(table(s, d, "documents"), table(s, d, "benchmark")),
        "op5_mixing": lambda s, d: mixing.digest(table(s, d, "documents")),
        "op6_line_dedup": lambda s, d: line_dedup.repeated_lines(table(s, d, "documents"), line_dedup.NEAR, classes=True),
        "op7_toxicity": lambda s, d: toxicity.scored(table(s, d, "documents"), table(s, d, "labels")),
        "op8_resharding": lambda s, d: resharding.digest(table(s, d, "documents")),
        "op9_ngram_jaccard": lambda s, d: ngram_join.classes(table(s, d, "documents")),
        "op10_url_filter": lambda s, d: url_filter.digest(table(s, d, "pages"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op4_decontamination": decontaminate.SQL,
        "op5_mixing": mixing.SQL,
        "op9_ngram_jaccard": ngram_join.SQL,
        "op10_url_filter": url_filter.SQL,
    }
