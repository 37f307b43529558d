"""Token stream layout: offsets, fixed-size shards, manifests, splits and windows of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch
from .corpus import ordinal


def offsets(sizes: DataFrame, order: str = "doc_id", size: str = "n") -> DataFrame:
    """Adds ``start`` and ``stop`` (exclusive) of each document in the concatenated stream, in the order of a unique key."""
    return ordinal(sizes, order, "start", F.col(size)).withColumn("stop", F.col("start") + F.col(size))


def shard_parts(placed: DataFrame, most: int) -> DataFrame:
    """``doc_id, shard_id, begin, size``: the part of each document in each shard; a document may straddle shards."""
    spread = placed.where("stop > start").withColumn("shard_id", F.explode(F.sequence(F.expr(f"start div {most}"), F.expr(f"(stop - 1) div {most}"))))
    begin = F.greatest("start", F.col("shard_id") * most)
    return spread.select("doc_id", "shard_id", begin.alias("begin"), (F.least("stop", (F.col("shard_id") + 1) * most) - begin).alias("size"))


def cut_to_shards(coded: DataFrame, most: int) -> DataFrame:
    """``shard_id, begin, ids``: the parts of ``doc_id, ids`` in each shard of ``most`` tokens, in document order."""
    placed = offsets(coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n"))).where("stop > start")

    def part(k: Column) -> Column:
        begin = F.greatest(F.col("start"), k * most)
        size = F.least(F.col("stop"), (k + 1) * most) - begin
        return F.struct(k.alias("shard_id"), begin.alias("begin"), F.slice("ids", (begin - F.col("start") + 1).cast("int"), size.cast("int")).alias("ids"))

    return placed.select(F.explode(F.transform(F.sequence(F.expr(f"start div {most}"), F.expr(f"(stop - 1) div {most}")), part)).alias("c")).select("c.*")


def sequences(coded: DataFrame, length: int, stride: int, most: int = 0) -> DataFrame:
    """``seq_id, x, y``: windows over the concatenated ``doc_id, ids``; only the first ``most`` where that is not 0, and then only
    their tokens are laid out."""
    placed = scratch(offsets(coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n"))).select("start", "stop", "ids"), "placed")
    total = placed.agg(F.max("stop")).first()[0] or 0
    if most:
        total = min(total, (most - 1) * stride + length + 1)
        placed = placed.where(F.col("start") < total)
    return window_slices(placed, length, stride, total)


def manifest(parts: DataFrame) -> DataFrame:
    """``shard_id, file, num_tokens, docs``; every shard but the last is full by construction of ``shard_parts``."""
    by = parts.groupBy("shard_id").agg(F.sum("size").alias("num_tokens"), F.count("*").alias("docs"))
    return by.select("shard_id", F.format_string("train_%06d.bin", "shard_id").alias("file"), "num_tokens", "docs")


def split_shards(shards: DataFrame, ratio: float, length: int) -> DataFrame:
    """Adds ``part`` (train or val: the last ``clamp(int(n * ratio), 1, n - 1)`` shards; all train for a ratio of 0 or one
    shard) and ``usable``: enough tokens for one window. A manifest is small, one window over it is one task's work."""
    everything = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everything)
    row = F.row_number().over(everything.orderBy("shard_id"))
    val = F.when((n < 2) | F.lit(ratio <= 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(ratio)))))
    return shards.select("*", F.when(row > n - val, "val").otherwise("train").alias("part"), (F.col("num_tokens") - length - 1 > 0).alias("usable"))


def allocate(shards: DataFrame, length: int, batch: int) -> DataFrame:
    """``shard_id, weight, picks``: sampling weight by last possible start, and an even split of a batch, the first shards
    taking the rest."""
    last = F.col("num_tokens") - length - 1
    usable = shards.where(last > 0)
    everything = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everything)
    row = F.row_number().over(everything.orderBy("shard_id"))
    b = F.lit(batch).cast("bigint")
    picks = F.floor(b / n) + F.when(row <= b % n, 1).otherwise(0)
    return usable.select("shard_id", (last / F.sum(last).over(everything)).alias("weight"), picks.cast("bigint").alias("picks"))


def windows(tokens: DataFrame, length: int, stride: int, total: int) -> DataFrame:
    """``seq_id, x, y`` from ``pos, id``, a row for each token, as ``window_slices`` gives them."""
    return window_slices(tokens.select(F.col("pos").alias("start"), F.array("id").alias("ids")), length, stride, total)


def window_slices(runs: DataFrame, length: int, stride: int, total: int) -> DataFrame:
    """``seq_id, x, y`` from ``start, ids`` (runs of tokens and where they begin): windows of ``length + 1`` tokens every
    ``stride`` (``length``: neighbours share one token; ``length + 1``: they do not); the tail is dropped; y is x shifted by one.

    Each run is cut at the bounds of the windows it meets, so slices are exchanged, not tokens.
    """
    rows = max(0, (total - length - 1) // stride + 1) if total > length else 0
    n = F.size("ids")
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("start") - length) / stride))
    last = F.least(F.lit(rows - 1).cast("bigint"), F.expr(f"(start + size(ids) - 1) div {stride}"))

    def part(k: Column) -> Column:
        begin = F.greatest(F.col("start"), k * stride)
        end = F.least(F.col("start") + n, k * stride + length + 1)
        return F.struct(k.alias("seq_id"), begin.alias("at"), F.slice("ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("part"))

    cut = runs.where((n > 0) & (last >= first)).select(F.explode(F.transform(F.sequence(first, last), part)).alias("c")).select("c.*").where(F.size("part") > 0)
    w = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]))
    return cut.groupBy("seq_id").agg(w.alias("w")).select("seq_id", F.slice("w", 1, length).alias("x"), F.slice("w", 2, length).alias("y"))


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Adds ``place``, a seeded order that is the same on every run: by hash of key, seed and epoch."""
    return rows.withColumn("place", drawn(F.col(key), F.lit(seed + epoch)))


def drawn(*values: Column) -> Column:
    """60 bits drawn by hash of some values, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 15), 16, 10).cast("bigint")


def rank_of(row: Column, world: int) -> Column:
    """Process that reads a row of the stream."""
    return F.pmod(row, F.lit(world))


def weighted_sample(shards: DataFrame, weight: str, most: int, seed: int) -> DataFrame:
    """``most`` shards without replacement in proportion to weight (Efraimidis-Spirakis keys), the same for one seed."""
    unit = (F.pmod(drawn(F.col("shard_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return shards.withColumn("_key", -F.log(unit) / F.col(weight)).orderBy("_key", "shard_id").limit(most).drop("_key")
