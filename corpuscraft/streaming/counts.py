"""Streaming forms: incremental word counts, statistics, and token sequences with a carried remainder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pieces
from ..operators.corpus import stream_stats
from ..operators.shards import windows


def stream_documents(spark: SparkSession, folder: str, name: str, files: int = 4) -> DataFrame:
    """A table's files as a stream of micro-batches of ``files`` files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def incremental_counts(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends each micro-batch's word counts as a partial result in a folder of its own, so a batch that runs again
    replaces what it wrote, and returns when what is there has been read."""

    def keep(batch: DataFrame, number: int) -> None:
        part = batch.where("text is not null").select(F.explode(pieces(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_counts(spark: SparkSession, out: str) -> DataFrame:
    """``word, freq`` over all partial results."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").groupBy("word").agg(F.sum("n").alias("freq"))


def streamed_stats(stream: DataFrame, by: str, least: int, most: int, name: str, checkpoint: str) -> DataFrame:
    """The counters of ``stream_stats`` kept by the streaming aggregation itself; few groups, so no watermark is needed."""
    query = stream_stats(stream, by, least, most).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def carried_sequences(stream: DataFrame, length: int, out: str, checkpoint: str) -> None:
    """Sequences of a token stream (``batch order, pos, id``), a micro-batch at a time: the tokens behind the last whole
    window (at most ``length``) are written beside the batch and read by the next, so windows run across batches."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start, seq = 0, 0
        rest: list[int] = []
        state = f"{out}/state/{number - 1}"
        if number > 0:
            row = spark.read.parquet(state).first()
            rest, start, seq = list(row.rest), row.next, row.seq
        tokens = batch.select((F.col("pos") - start + len(rest)).alias("pos"), "id")
        if rest:
            tokens = tokens.union(spark.createDataFrame(list(enumerate(rest)), "pos bigint, id bigint"))
        n = batch.count()
        total = n + len(rest)
        whole = max(0, (total - 1) // length)
        windows(tokens, length, length, total).select((F.col("seq_id") + seq).alias("seq_id"), "x", "y").write.mode("overwrite").parquet(f"{out}/sequences/batch={number}")
        left = [r.id for r in tokens.where(F.col("pos") >= whole * length).orderBy("pos").collect()]  # at most ``length`` tokens
        spark.createDataFrame([(left, start + n, seq + whole)], "rest array<bigint>, next bigint, seq bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/state/{number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
