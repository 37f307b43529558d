"""Resuming: what can be reused of earlier parts, and whether counts agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signature(*columns: str) -> object:
    """Fingerprint of a file: its columns joined by ``|``, nulls as empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def reuse_plan(files: DataFrame, parts: DataFrame) -> DataFrame:
    """``source_path, action``: reuse if a stored part has the file's signature, redo if it has another, else new."""
    known = parts.select("source_path", F.col("signature").alias("stored"))
    action = F.when(F.col("stored").isNull(), "new").when(F.col("stored") == F.col("signature"), "reuse").otherwise("redo")
    return files.join(known, "source_path", "left").select("source_path", action.alias("action"))


def missing_chunks(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that have no stored result."""
    return chunks.join(done.select(key), key, "left_anti")


def reconciled(parts: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: tokens of parts and of shards, and whether they agree."""
    a = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("part_tokens"))
    b = shards.agg(F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("shard_tokens"))
    return a.crossJoin(b).withColumn("agree", F.col("part_tokens") == F.col("shard_tokens"))  # one row each


def part_totals(parts: DataFrame) -> DataFrame:
    """One row: parts, documents, skipped documents and tokens over all parts, and how many parts were reused."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return parts.agg(F.count("*").alias("parts"), total("docs"), total("skipped"), total("tokens"), F.count_if("reused").alias("reused"))
