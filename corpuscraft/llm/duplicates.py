"""Problem 3: near-duplicate records with small edits (see ``positional`` for the method).

Defined results: null, empty and short texts (under ``LEAST`` letters) resemble nothing
and stand alone; rows with a null id are left out; repeated rows of one id count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch, table
from .pairing import blocks, pairs
from .positional import EXPAND, similar_classes

LEAST = 100
THRESHOLD = 0.6


def written_out(marked: DataFrame, reps: DataFrame, links: DataFrame, cross: bool, one: str, two: str) -> DataFrame:
    """All pairs of ids from links between classes and within the classes, whatever their size.

    Members are taken in blocks of about ``EXPAND``; pairs of blocks are spread over tasks (``pairing``).
    With ``cross`` only pairs with one id on side 1 and the other on side 2 count.
    """
    many = reps.where("members > 1").select("d1", "d2", "rep", "members")
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    single = reps.where("members = 1").join(linked, "rep", "left_semi").select(F.col("rep").alias("class"), F.col("rep").alias("id"), F.col("sides").alias("side"), "members")
    grown = marked.join(many, ["d1", "d2"]).select(F.col("rep").alias("class"), "id", "side", "members")
    parts = scratch(blocks(grown.union(single), EXPAND), "blocks")
    a = parts.select(F.col("class").alias("a"), F.struct("class", "side", "loose", "block").alias("ka"), F.col("ids").alias("x"))
    b = parts.select(F.col("class").alias("b"), F.struct("class", "side", "loose", "block").alias("kb"), F.col("ids").alias("y"))
    within = many.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    met = links.select("a", "b").union(within).distinct().join(a, "a").join(b, "b").where("ka <= kb")
    if cross:
        met = met.where("ka.side <> kb.side")
    return pairs(met.select("x", "y", F.expr("ka.loose or kb.loose").alias("loose"), F.expr("ka = kb").alias("same")), one, two)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``id, component``: least id reachable over ``a, b`` links.

    Each round sends every node its neighbours' least label and then that label's own
    label (pointer jumping), so the rounds grow with the logarithm of a chain's length.
    Only a changed count reaches the driver; each round's labels are a written table.
    """
    edges = scratch(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct(), "edges")
    label = scratch(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).select(F.col("u").alias("id"), "c"), "labels")
    held = label
    for _ in range(most):
        near = edges.join(label.select(F.col("id").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        best = label.join(near, label.id == near.u).select("id", "c", F.least("c", "m").alias("n"))
        hop = label.select(F.col("id").alias("n"), F.col("c").alias("h"))
        new = scratch(best.join(hop, "n", "left").select("id", "c", F.least("n", F.coalesce("h", "n")).alias("n")), "labels")
        discard(held)
        held = new
        changed = new.where("n <> c").limit(1).count()
        label = new.select("id", F.col("n").alias("c"))
        if not changed:
            return label.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicate_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_a, doc_b``, smaller first."""
    marked, reps, links = similar_classes(docs, docs[key], docs[text], LEAST, THRESHOLD)
    one = F.lit(0).alias("side")
    return written_out(marked.select("*", one), reps.select("*", F.lit(0).alias("sides")), links, False, "doc_a", "doc_b")


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id`` (least id of its near-duplicates), ``copies`` (documents with
    the same letters), ``links`` (other classes that resemble its own directly)."""
    marked, reps, links = similar_classes(docs, docs[key], docs[text], LEAST, THRESHOLD)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    found = (
        reps.join(degree, "rep", "left")
        .join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
        .select("d1", "d2", F.coalesce("component", "rep").alias("class_id"), F.col("members").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    known = marked.select(F.col("id").alias("doc_id"), "d1", "d2").join(found, ["d1", "d2"]).select("doc_id", "class_id", "copies", "links")
    rest = docs.select(docs[key].cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().join(known, "doc_id", "left_anti")
    return known.union(rest.select("doc_id", "doc_id", F.lit(1), F.lit(0)))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, folder, "documents"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "documents"))
