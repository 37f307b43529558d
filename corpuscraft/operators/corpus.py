"""Filters, statistics and limits of document streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, scratch

RANGE_ROWS = 1_000_000  # rows of a range when running totals are taken


def emitted(docs: DataFrame, least: int, most: int, text: str = "text") -> DataFrame:
    """Rows whose text has ``least`` code points or more, cut to ``most`` (0: uncut). Null and empty texts go."""
    t = F.col(text)
    kept = docs.where(t.isNotNull() & (F.length(t) >= max(1, least)))
    return kept.withColumn(text, F.substring(t, 1, most)) if most > 0 else kept


def stream_stats(docs: DataFrame, by: str | Column, least: int, most: int, text: str = "text") -> DataFrame:
    """Counters of one pass per group: scanned, emitted, missing (null), short (empty too), truncated, characters emitted."""
    size = F.length(F.col(text))
    good = size >= max(1, least)
    cut = F.least(size, F.lit(most)) if most > 0 else size
    return docs.groupBy(by).agg(
        F.count("*").alias("docs_scanned"),
        F.count_if(good).alias("docs_emitted"),
        F.count_if(F.col(text).isNull()).alias("skipped_missing"),
        F.count_if(size < max(1, least)).alias("skipped_short"),
        F.count_if(good & (size > most) if most > 0 else F.lit(False)).alias("truncated_docs"),
        F.coalesce(F.sum(F.when(good, cut)), F.lit(0)).cast("bigint").alias("emitted_chars"),
    )


def first_per_group(docs: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group; the per-group limit is pushed below the exchange by the engine."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return docs.withColumn("rn", rank).where(F.col("rn") <= most)


def except_values(docs: DataFrame, column: str, gone: list[str]) -> DataFrame:
    """Distinct non-null values of a column other than ``gone``."""
    return docs.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(gone)).distinct()


def json_text(line: Column, field: str = "text") -> Column:
    """The string under ``field`` of a JSON object in a line; null unless the line is valid and the value a string."""
    value = F.try_variant_get(F.try_parse_json(line), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(line), f"$.{field}", "string"))


def ordinal(rows: DataFrame, order: str, name: str, count: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the running total of ``count`` (1: the row number) before each row, in the order of a unique column; within each
    group of ``by`` where that is given.

    Rows are cut into ranges of the order column, one for about ``RANGE_ROWS`` rows, and written with their range. Ranges are
    summed, and the running total is taken inside each, so no task sees more than a range, however large a group is.
    """
    value = F.lit(1) if count is None else count
    cut = scratch(rows.withColumn("_value", value.cast("bigint")), "ordered")
    ranges = max(1, -(-cut.count() // RANGE_ROWS))
    if ranges > 1:
        whole, cut = cut, scratch(cut.repartitionByRange(ranges, order).withColumn("_bucket", F.spark_partition_id()), "ranges")
        discard(whole)
    else:
        cut = cut.withColumn("_bucket", F.lit(0))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if ranges > 1:
        along = Window.partitionBy(*(by or (F.lit(0),))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = cut.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))  # a row for a range (and group)
        cut = cut.join(totals.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_base")), [*by, "_bucket"])
    else:
        cut = cut.withColumn("_base", F.lit(0).cast("bigint"))
    return cut.withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_bucket", "_value", "_base")
