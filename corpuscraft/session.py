"""Session helpers: tables of a data folder, scratch tables in the shared folder, Arrow batch bounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[object, object]] = []
_TABLES: weakref.WeakKeyDictionary[DataFrame, tuple[object, object]] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only where none is named (local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscraft-"))
    return spark.sparkContext.getCheckpointDir()


def _remove(jvm_path: object, fs: object) -> None:
    try:
        fs.delete(jvm_path, True)  # type: ignore[attr-defined]
    except Exception:  # the JVM may be gone already
        pass


def _kept(spark: SparkSession, path: str) -> tuple[object, object]:
    """Notes a path for removal when the interpreter ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    entry = (jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration()))
    _SCRATCH.append(entry)
    return entry


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back, which cuts its lineage.

    A lost executor costs no more than the tasks it ran, for the table outlives it. The
    files go when the interpreter ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _TABLES[back] = _SCRATCH[-1]
    return back


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for files that go when the interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept(spark, path)
    return path


def discard(df: DataFrame) -> None:
    """Removes the files of a table that ``scratch`` gave, once nothing reads it any more."""
    entry = _TABLES.pop(df, None)
    if entry in _SCRATCH:
        _SCRATCH.remove(entry)
        _remove(*entry)


@atexit.register
def _sweep() -> None:
    while _SCRATCH:
        _remove(*_SCRATCH.pop())


_READY: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def prepare(spark: SparkSession) -> None:
    """Readies a session for the Python operators: ships this package to the workers, wherever it lies, and
    keeps Arrow batches of long texts small (at most 2,000 rows and 16 MB each)."""
    if spark in _READY:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpuscraft-")) / "corpuscraft.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    _READY.add(spark)
