"""Text sources: globs that reach across folders, JSON lines plain or compressed, environment files."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.corpus import json_text
from ..session import scratch


def matching(pattern: str) -> list[str]:
    """Files of a glob, sorted; ``*`` and ``?`` also match across ``/``. Without a wildcard, the file if it exists."""
    if not re.search(r"[*?]", pattern):
        return [pattern] if os.path.exists(pattern) else []
    root = re.split(r"[*?]", pattern)[0].rpartition("/")[0] or ("/" if pattern.startswith("/") else ".")
    rule = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), re.DOTALL)
    found = (os.path.join(d, f) for d, _, names in os.walk(root) for f in names)
    return sorted(p for p in (os.path.normpath(p) if root == "." else p for p in found) if rule.fullmatch(p))


def candidates(pattern: str) -> list[str]:
    """Files of a pattern; if there are none, of the pattern with the other usual endings."""
    for p in (pattern, *([pattern + ".gz"] if pattern.endswith(".json") else []), *([pattern[:-3]] if pattern.endswith(".gz") else [pattern + ".gz"])):
        if got := matching(p):
            return got
    return glob.glob(pattern, recursive=True)


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, line`` and their order, ``block`` (where the split of the file begins) and ``place`` (grows within a split). Lines
    end at LF only, a trailing CR goes, bytes that are not UTF-8 become U+FFFD; gzip by ending."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.make_valid_utf8("value"), "\r$", "").alias("line"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )


def documents(spark: SparkSession, paths: list[str], field: str = "text") -> DataFrame:
    """``path, text, block, place`` of the JSON lines whose ``field`` is a string that is not empty."""
    return lines(spark, paths).where(~F.col("line").rlike(r"^[ \t\r\x0b\f]*$")).select("path", json_text(F.col("line"), field).alias("text"), "block", "place").where(F.length("text") > 0)


def numbered(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """Adds the number of each row in the order of files (by path) and lines: rows of a split are numbered behind those of the
    splits before it. ``docs`` has ``path, block, place``, as ``documents`` gives them, and is written once."""
    docs = scratch(docs, "documents")
    order = Window.partitionBy(F.lit(0)).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = docs.groupBy("path", "block").agg(F.count("*").alias("_n"))  # a row for a split of a file
    base = base.select("path", "block", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("place"))
    return docs.withColumn("_row", inside).join(base, ["path", "block"]).withColumn(name, F.col("_base") + F.col("_row") - 1).drop("_base", "_row", "block", "place")


def environment(path: str) -> dict[str, str]:
    """``KEY=VALUE`` lines; a byte-order mark, comments, blank lines and quotes around values are dropped."""
    out: dict[str, str] = {}
    if not os.path.exists(path):
        return out
    with open(path, encoding="utf-8-sig") as f:
        for raw in f:
            line = raw.strip()
            if not line or line.startswith("#") or "=" not in line:
                continue
            key, _, value = line.removeprefix("export ").partition("=")
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            out[key.strip()] = value
    return out
