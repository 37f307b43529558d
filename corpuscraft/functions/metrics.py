"""Closed formulas: losses, schedules, sizes and formats."""

from __future__ import annotations

import fnmatch
import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_loss(rows: DataFrame, by: str, loss: str, weight: str) -> DataFrame:
    """Weighted mean loss and perplexity ``exp(min(loss, 30))`` per group."""
    mean = F.sum(F.col(loss) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1))
    out = rows.groupBy(by).agg(mean.alias("val_loss"), F.sum(weight).alias("eval_rows"), F.avg(loss).alias("plain_loss"))
    return out.withColumn("ppl", perplexity(F.col("val_loss")))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(30.0)))


def best_row(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """The row with the least value, the earlier by ``tie`` among equals."""
    return rows.orderBy(value, tie).limit(1)


def learning_rate(step: Column, peak: float, floor: float, warmup: int, total: int) -> Column:
    """Linear warm-up to ``peak``, cosine decay to ``floor`` at ``total``, then ``floor``."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = floor + 0.5 * (1 + F.cos(F.lit(math.pi) * progress)) * (peak - floor)
    return F.when(step < warmup, F.lit(peak) * (step + 1) / F.lit(float(max(1, warmup)))).when(step > total, F.lit(floor)).otherwise(cosine)


def parameter_count(layers: Column, width: Column, vocab: Column, length: Column) -> Column:
    """Parameters of a tied, bias-free decoder with learned positions."""
    return vocab * width + length * width + layers * (12 * width * width + 2 * width) + width


def duration(seconds: Column) -> Column:
    """hh:mm:ss; negative or null as ``--:--:--``."""
    s = F.floor(seconds).cast("bigint")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.when(s.isNull() | (s < 0), "--:--:--").otherwise(text)


def byte_size(size: Column) -> Column:
    """Binary units with two digits."""
    out = F.format_string("%.2f TB", size / float(1 << 40))
    for limit, name in ((40, "GB"), (30, "MB"), (20, "KB")):
        out = F.when(size < float(1 << limit), F.format_string(f"%.2f {name}", size / float(1 << (limit - 10)))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size.cast("bigint"))).otherwise(out)


def iteration(name: Column) -> Column:
    """Number in a checkpoint's name; null if it has none."""
    return F.nullif(F.regexp_extract(name, r"ckpt_(\d{1,18})", 1), F.lit("")).cast("bigint")


def checkpoint_catalog(paths: DataFrame, most: int) -> DataFrame:
    """``name, path, iter_num, place``: one row per real path (the first by name), by number, unnumbered last."""
    first = F.row_number().over(Window.partitionBy("real_path").orderBy("name"))
    once = paths.withColumn("_n", first).where("_n = 1").withColumn("iter_num", iteration(F.col("name")))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("iter_num", F.lit(10**18)), "name"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("name", "real_path", "iter_num", "place")


def running_best(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Adds ``best``, the least value of a run so far, and ``improved``: whether the row is the first to reach it."""
    along = Window.partitionBy(by).orderBy(order)
    before = F.min(value).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("best", F.min(value).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("improved", before.isNull() | (F.col(value) < before))


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """Per cent done, rate a second and remaining time as hh:mm:ss (``--:--:--`` without a rate)."""
    rate = F.when(seconds > 0, done / seconds)
    left = F.when(rate > 0, F.greatest(F.lit(0), total - done) / rate)
    return F.when(total > 0, 100.0 * done / total).otherwise(0.0), F.coalesce(rate, F.lit(0.0)), duration(left)


def tokens_per_iteration(micro: Column, length: Column, accumulate: Column, world: Column) -> Column:
    return micro * length * accumulate * world


def out_of_memory(message: Column) -> Column:
    """Whether an error message tells that a device ran out of memory."""
    return F.coalesce(F.lower(message).rlike("out of memory|oom|alloc.*fail|fail.*alloc"), F.lit(False))


def checkpoint_files(spark: SparkSession, folder: str, pattern: str = "ckpt_*.pt", last: bool = True, most: int = 0) -> DataFrame:
    """``name, real_path, iter_num, place`` of the checkpoints in a folder: one row for a real file, by number, unnumbered ones
    last; ``last`` tells whether those named so count. A folder lists few files, so it is listed here."""
    found = [(n, os.path.realpath(os.path.join(folder, n))) for n in sorted(os.listdir(folder)) if fnmatch.fnmatch(n, pattern) and (last or "last" not in n)]
    return checkpoint_catalog(spark.createDataFrame(found, "name string, real_path string"), most or len(found) or 1)
