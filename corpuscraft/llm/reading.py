"""Problem 10: reading level of each document.

Gradient-boosted regression trees (``boosting``) over distributions of length, vocabulary,
syntax and cohesion. Vocabulary is scored by a table of short letter stretches (five
letters, two in Chinese) with the shrunken mean level of the labelled documents that hold
them, so the same features serve every language. The model is fitted on a bounded sample
of labelled documents (``SAMPLE_DOCS``; the label is the median of the raters), on features
whose vocabulary scores come from the other folds, and its predictions are calibrated by
isotonic regression on held-out folds. Folds are sets of sources, so the
cross-validation tells how the level holds on sources never seen.

Sampled texts, however long, stay on the executors. What reaches the driver is of fixed
size: the counts and sums of the vocabulary table by fold (``FOLDS`` x 2**17 slots) and the
features of ``SAMPLE_DOCS`` documents.

The cross-validation is nested: for the documents of one fold, the vocabulary scores, the
trees and the calibration are all made without any label of that fold.

Defined results: texts under ``LEAST`` letters, null and empty ones have no level; rows with
a null id are left out; without labels no document has a level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch, table
from .boosting import Boosted, Isotonic
from .letters import LetterBatch, distinct, mix, rounds

LEAST = 80
SAMPLE_DOCS = 4000
FOLDS = 5
BASIC = 2.25  # ordinary texts lie close to 3; the few between belong to the outer levels
ADVANCED = 3.75
_SLOTS = 1 << 17
_U = np.uint64

_END = re.compile(r"[.!?。！？\n]+")
_BLANKS = re.compile(r"[^\S\n]{2,}")
FEATURES = (
    "sentence_mean", "sentence_weighted", "sentence_short", "sentence_long", "commas", "word_mean", "word_long", "chinese",
    "vocabulary", "vocabulary_low", "vocabulary_high", "vocabulary_spread", "new_stretches", "half_gap",
)


def _stretches(batch: LetterBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """slot and owner of each short stretch, its place, and whether each text is mostly Chinese."""
    n = len(batch.size)
    chinese = np.bincount(batch.owner[(batch.points >= 0x3400) & (batch.points < 0xA000)], minlength=n) * 2 > batch.size
    slots, owners, places = [], [], []
    for width, wanted in ((5, ~chinese), (2, chinese)):
        values, at = batch.grams(width, seed=width)
        own = batch.owner[at]
        ok = wanted[own]
        slots.append((mix(values[ok]) >> _U(47)).astype(np.int64) & (_SLOTS - 1))
        owners.append(own[ok].astype(np.int64))
        places.append((at[ok] - batch.start[own[ok]]))
    return np.concatenate(slots), np.concatenate(owners), np.concatenate(places), chinese


class Vocabulary:
    """Documents that hold a stretch and the sum of their level - 3, per fold; scores are means shrunken to 0 by two documents."""

    def __init__(self, count: np.ndarray, total: np.ndarray) -> None:
        self.count, self.total = count, total

    def scores(self, *without: int) -> np.ndarray:
        rest = [k for k in range(FOLDS) if k not in without]
        return self.total[rest].sum(axis=0) / (self.count[rest].sum(axis=0) + 2.0)


def features(texts: list[str | None], scores: np.ndarray | list[np.ndarray], batch: LetterBatch | None = None, fold: np.ndarray | None = None) -> np.ndarray:
    """(texts, features); with ``fold``, text k uses ``scores[fold[k]]``."""
    batch = batch or LetterBatch(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    col = {f: k for k, f in enumerate(FEATURES)}
    for k, t in enumerate(texts):
        if not t:
            continue
        t = _BLANKS.sub(" ", t)
        sizes = [len(s) for s in _END.split(t) if len(s) > 1]
        words = [len(w) for w in t.split()]
        total, count = sum(sizes) or 1, len(sizes) or 1
        wsum, wn = sum(words) or 1, len(words) or 1
        out[k, 0] = total / count
        out[k, 1] = sum(s * s for s in sizes) / total
        out[k, 2] = sum(s for s in sizes if s < 30) / total
        out[k, 3] = sum(s for s in sizes if s > 160) / total
        out[k, 4] = (t.count(",") + t.count("，") + t.count(";") + t.count("、")) / count
        out[k, 5] = wsum / wn
        out[k, 6] = sum(w for w in words if w >= 11) / wsum
    slot, owner, place, chinese = _stretches(batch)
    out[:, col["chinese"]] = chinese
    out[chinese, 5:7] = 0
    for f in ("sentence_mean", "sentence_weighted"):
        out[chinese, col[f]] *= 3  # a Chinese sentence says as much in a third of the characters
    many = np.maximum(np.bincount(owner, minlength=n), 1)
    value = scores[slot] if fold is None else np.stack(scores)[fold[owner], slot]  # type: ignore[index]
    mean = np.bincount(owner, value, minlength=n) / many
    out[:, col["vocabulary"]] = mean
    out[:, col["vocabulary_low"]] = np.bincount(owner, value < -0.6, minlength=n) / many
    out[:, col["vocabulary_high"]] = np.bincount(owner, value > 0.6, minlength=n) / many
    out[:, col["vocabulary_spread"]] = np.sqrt(np.maximum(np.bincount(owner, value**2, minlength=n) / many - mean**2, 0))
    first = place * 2 < batch.size[owner]
    halves = [np.bincount(owner[h], value[h], minlength=n) / np.maximum(np.bincount(owner[h], minlength=n), 1) for h in (first, ~first)]
    out[:, col["half_gap"]] = np.abs(halves[0] - halves[1])
    key = distinct(owner * _SLOTS + slot)
    out[:, col["new_stretches"]] = np.bincount(key // _SLOTS, minlength=n) / many
    return out


class HeldOut:
    """Per fold of sources the scores, trees and calibration that were made without it. A source that no fold holds takes
    those of the first. With labels of one fold alone nothing is held out."""

    def __init__(self, fold: dict[str, int], scores: list[np.ndarray], trees: dict[int, Boosted], calibrated: dict[int, Isotonic]) -> None:
        self.fold, self.scores, self.trees, self.calibrated = fold, scores, trees, calibrated

    def __call__(self, texts: list[str | None], source: list[str], batch: LetterBatch) -> np.ndarray:
        fold = np.array([self.fold.get(s, 0) for s in source], dtype=np.int64)
        x = features(texts, self.scores, batch, fold)
        out = np.zeros(len(texts))
        for k in np.unique(fold):
            k = int(k) if int(k) in self.trees else min(self.trees)
            mine = fold == k
            out[mine] = self.calibrated[k](self.trees[k].predict(x[mine]))
        return out


def _apart(fold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fold ``k`` and the others; with one fold alone the others are all rows."""
    mine = fold == k
    return mine, ~mine if (~mine).any() else mine


class Level:
    """A fitted model with its held-out predictions (``held``), labels and folds."""

    def __init__(self, x: np.ndarray, level: np.ndarray, fold: np.ndarray, vocabulary: Vocabulary) -> None:
        self.level, self.fold = level, fold
        self.held = np.zeros(len(level))
        for k in np.unique(fold):
            mine, others = _apart(fold, k)
            self.held[mine] = Boosted().fit(x[others], level[others]).predict(x[mine])
        self.calibrated = Isotonic(self.held, level)
        self.scores = vocabulary.scores().astype(np.float32)
        self.trees = Boosted().fit(x, level)

    def __call__(self, texts: list[str | None], batch: LetterBatch) -> np.ndarray:
        return self.calibrated(self.trees.predict(features(texts, self.scores, batch)))


def nested(x: list[np.ndarray], level: np.ndarray, fold: np.ndarray, folds: dict[str, int], vocabulary: Vocabulary) -> HeldOut:
    """For each fold k what is made without it: ``x[k]`` has features whose scores leave out k besides a document's own fold."""
    trees, calibrated = {}, {}
    for k in np.unique(fold).tolist():
        _, others = _apart(fold, k)
        x_k, y_k, f_k = x[k][others], level[others], fold[others]
        trees[k] = Boosted().fit(x_k, y_k)
        inner = np.zeros(len(y_k))
        for j in np.unique(f_k):
            mine, rest = _apart(f_k, j)
            inner[mine] = Boosted().fit(x_k[rest], y_k[rest]).predict(x_k[mine])
        calibrated[k] = Isotonic(inner, y_k)
    return HeldOut(folds, [vocabulary.scores(k) for k in range(FOLDS)], trees, calibrated)


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, level``: the median of a document's raters."""
    return labels.where("reading_level is not null and doc_id is not null").select("doc_id", "rater", "reading_level").distinct().groupBy("doc_id").agg(F.median("reading_level").alias("level"))


class Sample:
    """The labelled documents that a model is fitted on: their folds, levels and vocabulary; features are made where the texts are."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most: int) -> None:
        prepare(docs.sparkSession)
        chosen = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        texts = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")).where((F.length("text") >= LEAST))
        found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "source", "level")).alias("r"))
        self.rows = scratch(found.select("doc_id", "r.text", "r.source", F.col("r.level").cast("double").alias("level")), "sample")
        names = sorted(r.source for r in self.rows.select("source").distinct().collect())  # at most one a document of the sample
        self.folds = {s: k % FOLDS for k, s in enumerate(names)}
        self.vocabulary = self._vocabulary() if names else None

    def _vocabulary(self) -> Vocabulary:
        folds = self.folds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in batches:
                fold = np.array([folds[s] for s in got.column(1).to_pylist()], dtype=np.int64)
                level = got.column(2).to_numpy()
                for first, part in rounds(got.column(0).to_pylist()):
                    slot, owner, _, _ = _stretches(LetterBatch(part))
                    own, slot = np.divmod(distinct(owner * _SLOTS + slot), _SLOTS)
                    key, where = np.unique(fold[first + own] * _SLOTS + slot, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(where)), pa.array(np.bincount(where, level[first + own] - 3.0))], names=["key", "n", "total"])

        sums = self.rows.select("text", "source", "level").mapInArrow(run, "key bigint, n bigint, total double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        got = sums.toArrow()  # at most FOLDS * 2**17 rows
        count, total = np.zeros(FOLDS * _SLOTS), np.zeros(FOLDS * _SLOTS)
        key = got.column("key").to_numpy()
        count[key], total[key] = got.column("n").to_numpy(), got.column("total").to_numpy()
        return Vocabulary(count.reshape(FOLDS, -1), total.reshape(FOLDS, -1))

    def features(self, *without: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, levels and folds of the documents, by id; scores leave out a document's own fold and those given."""
        folds = self.folds
        shared = self.rows.sparkSession.sparkContext.broadcast([self.vocabulary.scores(j, *without) for j in range(FOLDS)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in batches:
                fold = np.array([folds[s] for s in got.column(2).to_pylist()], dtype=np.int64)
                for first, part in rounds(got.column(1).to_pylist()):
                    s = slice(first, first + len(part))
                    x = features(part, shared.value, None, fold[s])
                    ends = np.arange(len(part) + 1) * len(FEATURES)
                    yield pa.RecordBatch.from_arrays(
                        [got.column(0)[s], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel())), got.column(3)[s], pa.array(fold[s])], names=["doc_id", "x", "level", "fold"]
                    )

        rows = self.rows.select("doc_id", "text", "source", "level").mapInArrow(run, "doc_id bigint, x array<double>, level double, fold bigint").toArrow().sort_by("doc_id")
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
        return x, rows.column("level").to_numpy(), rows.column("fold").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Level | None:
    """A model from at most ``most`` labelled documents, chosen by hash of their id; None where none is labelled."""
    sample = Sample(docs, labels, most)
    return Level(*sample.features(), sample.vocabulary) if sample.vocabulary else None


def held_out(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> HeldOut | None:
    """For each fold of sources a model of the same sample without that fold; None where no document is labelled."""
    sample = Sample(docs, labels, most)
    if not sample.vocabulary:
        return None
    by = [sample.features(k) for k in range(FOLDS)]
    return nested([x for x, _, _ in by], by[0][1], by[0][2], sample.folds, sample.vocabulary)


def reading_levels(docs: DataFrame, model: Level | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, level`` (1 to 5) of documents with ``LEAST`` letters or more; one scan."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for got in batches if model else ():
            ids = got.column(0).to_numpy()
            for first, part in rounds(got.column(1).to_pylist()):
                batch = LetterBatch(part)
                level = model(part, batch)
                ok = np.nonzero(batch.size >= LEAST)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + ok]), pa.array(level[ok])], names=["doc_id", "level"])

    chosen = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null and text is not null")
    return chosen.mapInArrow(run, "doc_id bigint, level double")


def _fit(spark: SparkSession, folder: str) -> Level:
    return fit(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    level = F.col("level")
    name = F.when(level <= BASIC, "basic").when(level >= ADVANCED, "advanced")
    return reading_levels(table(spark, folder, "documents"), _fit(spark, folder)).select("doc_id", name.alias("reading_level")).where("reading_level is not null")


def p10_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Per source and language label: documents and their mean level."""
    docs = table(spark, folder, "documents")
    levels = reading_levels(docs, _fit(spark, folder))
    return docs.select("doc_id", "source", "content_domain").join(levels, "doc_id").groupBy("source", "content_domain").agg(F.count("*").alias("documents"), F.round(F.avg("level"), 4).alias("level"))


def validation(docs: DataFrame, labels: DataFrame, model: HeldOut) -> DataFrame:
    """``source, documents, rmse`` over all labelled documents with ``LEAST`` letters or more, each scored by the model and
    calibration of the folds that do not hold its source."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            source, wanted = got.column(1).to_pylist(), got.column(2).to_numpy()
            for first, part in rounds(got.column(0).to_pylist()):
                batch = LetterBatch(part)
                of = source[first : first + len(part)]
                error = (shared.value(part, of, batch) - wanted[first : first + len(part)]) ** 2
                ok = np.nonzero(batch.size >= LEAST)[0]
                yield pa.RecordBatch.from_arrays([pa.array([of[k] for k in ok], pa.string()), pa.array(error[ok])], names=["source", "error"])

    rows = docs.where("text is not null").join(labelled(labels), "doc_id").select("text", F.coalesce("source", F.lit("")).alias("source"), F.col("level").cast("double").alias("level"))
    return rows.mapInArrow(run, "source string, error double").groupBy("source").agg(F.count("*").alias("documents"), F.sqrt(F.avg("error")).alias("rmse"))


def p10_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validation by source: labelled documents and the root mean squared error of calibrated held-out predictions."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "reading_labels")
    model = held_out(docs, labels)
    if model is None:
        return spark.createDataFrame([], "source string, documents bigint, rmse double")
    return validation(docs, labels, model)
