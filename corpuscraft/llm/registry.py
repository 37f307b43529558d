"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import charforms, duplicates, language, leaks, mixture, reading, repetition, splits, tokens

_QUERIES = (
    splits.p1_found, splits.p1_report,
    language.p2_found, language.p2_documents, language.p2_segments, language.p2_statistics,
    duplicates.p3_found, duplicates.p3_groups,
    charforms.p4_found, charforms.p4_lines, charforms.p4_documents, charforms.p4_rows, charforms.p4_sources,
    repetition.p5_found, repetition.p5_shares,
    tokens.p6_found, tokens.p6_budget,
    mixture.p7_found, mixture.p7_quotas, mixture.p7_shards, mixture.p7_records, mixture.p7_reached,
    tokens.p8_found, tokens.p8_fill,
    leaks.p9_found, leaks.p9_report,
    reading.p10_found, reading.p10_levels, reading.p10_validation,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": tokens.P6_FOUND_SQL,
        "p6_budget": tokens.P6_BUDGET_SQL,
        "p7_found": mixture.P7_FOUND_SQL,
        "p7_quotas": mixture.P7_QUOTAS_SQL,
        "p7_shards": mixture.P7_SHARDS_SQL,
        "p7_records": mixture.P7_RECORDS_SQL,
        "p7_reached": mixture.P7_REACHED_SQL,
        "p8_found": tokens.P8_FOUND_SQL,
    }
