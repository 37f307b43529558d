"""Word and symbol-pair counts, exact and lossy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import byte_level, gpt2_pieces, pieces


SPLIT = {"whitespace": pieces, "gpt2": gpt2_pieces}


def words(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), mode: str = "whitespace") -> DataFrame:
    """``keep, word``: one row per piece of the mode's pre-tokenizer. Pieces are mapped to the byte alphabet after counting."""
    return docs.where(F.col(text).isNotNull()).select(*keep, F.explode(SPLIT[mode](F.col(text))).alias("word"))


def word_counts(docs: DataFrame, text: str = "text", least: int = 1, mode: str = "whitespace") -> DataFrame:
    """``word, freq`` with ``freq >= least``; words are mapped to the byte alphabet once each, behind the aggregation."""
    counted = words(docs, text, mode=mode).groupBy("word").agg(F.count("*").alias("freq"))
    return counted.where(F.col("freq") >= least).select(byte_level(F.col("word")).alias("word"), "freq")


def top_words(docs: DataFrame, most: int) -> DataFrame:
    """The ``most`` frequent words, ties in binary order."""
    return word_counts(docs).orderBy(F.desc("freq"), "word").limit(most)


def rollup_counts(docs: DataFrame, group: str, least: int) -> DataFrame:
    """``group, word, freq, total``: counts per group and over all (``total`` = 1). The overall counts are summed from the
    group counts, so every text is read and split once and the expansion works on aggregated rows."""
    per = words(docs, keep=(group,)).groupBy(group, "word").agg(F.count("*").alias("n"))
    both = per.groupingSets([[group, "word"], ["word"]], group, "word").agg(F.sum("n").alias("freq"), F.grouping(group).cast("int").alias("total"))
    return both.where(F.col("freq") >= least).select(group, byte_level(F.col("word")).alias("word"), "freq", "total")


def lossy_counts(docs: DataFrame, chunk: Column, most: int, mode: str = "whitespace") -> DataFrame:
    """Counts summed over chunks of which each keeps its ``most`` frequent words (ties in binary order; 0 keeps all)."""
    per = words(docs.withColumn("_chunk", chunk), keep=("_chunk",), mode=mode).groupBy("_chunk", "word").agg(F.count("*").alias("n"))
    per = per.select("_chunk", byte_level(F.col("word")).alias("word"), "n")
    if most > 0:
        per = per.withColumn("_rn", F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("n"), "word"))).where(F.col("_rn") <= most)
    return per.groupBy("word").agg(F.sum("n").alias("freq"), F.count("*").alias("chunks"))


def pair_counts(counted: DataFrame) -> DataFrame:
    """``left, right, freq``: weighted counts of adjacent symbols of ``word, freq``; overlapping pairs all count."""
    s = F.split("word", "")
    n = F.length("word") - 1
    pairs = F.arrays_zip(F.slice(s, F.lit(1), n).alias("left"), F.slice(s, F.lit(2), n).alias("right"))
    exploded = counted.where(F.length("word") > 1).select(F.explode(pairs).alias("p"), "freq")
    return exploded.groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def vocabulary_sizes(docs: DataFrame, least: int, text: str = "text") -> DataFrame:
    """One row: ``words`` (occurrences), ``unique_words`` and ``training_words`` (those that occur ``least`` times or more)."""
    counted = words(docs, text).groupBy("word").agg(F.count("*").alias("freq"))
    return counted.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("words"), F.count("*").alias("unique_words"), F.count_if(F.col("freq") >= least).alias("training_words"))
