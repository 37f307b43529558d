"""Headerless token shards: flat arrays of unsigned 16- or 32-bit ids, and their manifest."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

SLICE = 1 << 20  # tokens of a shard in one row


def token_dtype(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 65535 else "uint32"


def write_shards(parts: DataFrame, folder: str, dtype: str) -> DataFrame:
    """Writes ``train_%06d.bin`` files from ``shard_id, begin, ids`` (pieces of the stream); returns ``shard_id, num_tokens``.

    Each shard is one sorted group of one task, written to a temporary name and renamed, so a task that runs again
    replaces its file. ``folder`` must be shared by all executors. Ids beyond the dtype raise.
    """
    prepare(parts.sparkSession)
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        if name.startswith("train_") and name.endswith(".bin"):
            os.remove(os.path.join(folder, name))
    top = np.iinfo(dtype).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, current, count = None, None, 0
        done: list[tuple[int, int]] = []

        def close() -> None:
            if file is not None:
                file.close()
                os.replace(file.name, os.path.join(folder, f"train_{current:06d}.bin"))
                done.append((current, count))

        for got in batches:
            for shard, ids in zip(got.column(0).to_pylist(), got.column(2), strict=True):
                if shard != current:
                    close()
                    file = open(os.path.join(folder, f".train_{shard:06d}.{uuid.uuid4().hex}"), "wb")  # noqa: SIM115
                    current, count = shard, 0
                values = ids.values.to_numpy()
                if len(values) and (values.min() < 0 or values.max() > top):
                    raise OverflowError(f"a token id does not fit {dtype}")
                file.write(values.astype(dtype).tobytes())
                count += len(values)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["shard_id", "num_tokens"])

    ordered = parts.select("shard_id", "begin", "ids").repartition("shard_id").sortWithinPartitions("shard_id", "begin")
    return ordered.mapInArrow(run, "shard_id bigint, num_tokens bigint")


def read_shards(spark: SparkSession, folder: str, dtype: str) -> DataFrame:
    """``file, begin, tokens`` of the shards of a mounted folder: slices of at most ``SLICE`` tokens, each read on its own."""
    prepare(spark)
    width, root = np.dtype(dtype).itemsize, urlparse(folder).path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for file, begin in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                ids = np.fromfile(os.path.join(root, file), dtype=dtype, count=SLICE, offset=begin * width).astype(np.int64)
                tokens = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin]), tokens], names=["file", "begin", "tokens"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "train_*.bin").load(folder)
    size = F.expr(f"length div {width}")
    slices = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0)), F.lit(SLICE).cast("bigint"))).alias("begin"))
    return slices.repartition("file", "begin").mapInArrow(run, "file string, begin bigint, tokens array<bigint>")


def write_manifest(path: str, shards: list[tuple[str, int]], **fields: object) -> None:
    """meta.json: the given fields and the shards with their token counts."""
    whole = {**fields, "total_tokens": sum(n for _, n in shards), "shards": [{"file": f, "num_tokens": n} for f, n in shards]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, ensure_ascii=False, indent=2)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, num_tokens, dtype`` rows of a manifest."""
    meta = spark.read.option("multiLine", True).json(path)
    return meta.select("dtype", F.explode("shards").alias("s")).select("s.file", "s.num_tokens", "dtype")


def listed_shards(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``file, num_tokens, dtype, n_bytes, whole``: what a manifest lists against the files there are (``file, n_bytes``).
    ``whole`` tells whether a file has the bytes its tokens need; a listed file that is missing has null bytes."""
    width = F.when(F.col("dtype") == "uint16", 2).otherwise(4)
    both = manifest.join(files.select("file", "n_bytes"), "file", "left")
    return both.withColumn("whole", F.coalesce(F.col("n_bytes") == F.col("num_tokens") * width, F.lit(False)))


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, n_bytes`` of the shards of a folder; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "train_*.bin").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"))
