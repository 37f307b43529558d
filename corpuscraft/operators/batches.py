"""Batches for training: contiguous, at seeded random starts, permuted, over epochs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import drawn, shuffled, windows


def contiguous_batches(sequences: DataFrame, size: int) -> DataFrame:
    """Adds ``batch_id`` and ``row`` to sequences in stream order; the last batch may be short."""
    return sequences.withColumn("batch_id", F.expr(f"seq_id div {size}")).withColumn("row", (F.col("seq_id") % size).cast("int"))


def random_starts(total: int, length: int, size: int, seed: int) -> list[int]:
    """``size`` sorted starts of windows of ``length + 1`` tokens, the same for one seed (with replacement)."""
    last = total - length - 1
    draw = lambda k: int(hashlib.md5(f"{k}|{seed}".encode()).hexdigest()[:15], 16)
    return sorted(draw(k) % (last + 1) for k in range(size)) if last >= 0 else []


def random_batch(runs: DataFrame, total: int, length: int, size: int, seed: int) -> DataFrame:
    """``seq_id, x, y`` at seeded random starts over runs of tokens (``start, ids``). The starts, ``size`` of them, go along as
    literals; a run gives a slice to each window that it meets."""
    starts = random_starts(total, length, size, seed)
    if not starts:
        return runs.sparkSession.createDataFrame([], "seq_id bigint, x array<int>, y array<int>")
    end = F.col("start") + F.size("ids")

    def part(m: Column) -> Column:
        begin = F.greatest(F.col("start"), m["at"])
        stop = F.least(end, m["at"] + length + 1)
        return F.struct(m["seq_id"].alias("seq_id"), begin.alias("at"), F.slice("ids", (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int")).alias("part"))

    marks = F.array(*[F.struct(F.lit(k).cast("bigint").alias("seq_id"), F.lit(at).cast("bigint").alias("at")) for k, at in enumerate(starts)])
    near = F.filter(marks, lambda m: (m["at"] < end) & (m["at"] + length + 1 > F.col("start")))
    cut = runs.where(F.size("ids") > 0).select(F.explode(F.transform(near, part)).alias("c")).select("c.*")
    w = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]))
    return cut.groupBy("seq_id").agg(w.alias("w")).select("seq_id", F.slice("w", 1, length).alias("x"), F.slice("w", 2, length).alias("y"))


def shard_windows(tokens: DataFrame, base: int, length: int, count: int) -> DataFrame:
    """``count`` windows from ``base`` on that share no token (stride ``length + 1``)."""
    end = base + count * (length + 1)
    inside = tokens.where((F.col("pos") >= base) & (F.col("pos") < end)).withColumn("pos", F.col("pos") - base)
    return windows(inside, length, length + 1, count * (length + 1))


def permuted(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A batch in a seeded order."""
    return shuffled(rows, key, seed).orderBy("place", key).drop("place")


def epochs(rows: DataFrame, key: str, count: int, seed: int, rank: int = 0) -> DataFrame:
    """Every row once an epoch with its ``place`` in that epoch's own order (seed + epoch + rank)."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return each.withColumn("place", drawn(F.col(key), F.col("epoch") + F.lit(seed + rank)))


def valid_texts(docs: DataFrame, least: int, wanted: int, text: str = "text") -> DataFrame:
    """``wanted`` rows with a usable text; an error where there is none."""
    good = docs.where(F.length(F.col(text)) >= max(1, least)).limit(wanted)
    if good.isEmpty():
        raise ValueError("the stream has no valid text")
    return good
