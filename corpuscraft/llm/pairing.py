"""Writes out every pair of ids between groups of them, however large a group is.

Groups are cut into blocks of ids. What is joined are blocks, so a group of m ids costs
(m / size)**2 rows, not m**2; the pairs of blocks are then dealt evenly to all tasks and
written out there. No pair is left out and none comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch


def blocks(members: DataFrame, size: int) -> DataFrame:
    """``class, side, loose, block, ids``: blocks of about ``size`` ids from ``class, side, id, members`` (ids of the class).

    ``loose`` blocks hold the ids that stand in more than one class or side; only their pairs can come twice.
    """
    own = members.groupBy("id").agg(F.collect_set(F.struct("class", "side", "members")).alias("own"))
    each = own.select("id", (F.size("own") > 1).alias("loose"), F.explode("own").alias("m")).select("id", "loose", "m.*")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / size)).alias("block")
    return each.groupBy("class", "side", "loose", block).agg(F.collect_list("id").alias("ids"))


def pairs(met: DataFrame, one: str, two: str) -> DataFrame:
    """Distinct pairs of different ids, smaller first, from pairs of blocks ``x, y, loose, same`` (x and y are one block)."""
    met = scratch(met.select("x", "y", "loose", "same"), "block-pairs")
    tasks = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = met.repartition(tasks).select("loose", "same", "y", F.explode("x").alias("i")).select("loose", "same", "i", F.explode("y").alias("j"))
    found = spread.where((F.col("i") < F.col("j")) | (~F.col("same") & (F.col("i") > F.col("j")))).select("loose", F.least("i", "j").alias(one), F.greatest("i", "j").alias(two))
    return found.where("not loose").drop("loose").union(found.where("loose").drop("loose").distinct())
