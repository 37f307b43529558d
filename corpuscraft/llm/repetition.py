"""Problem 5: repetition inside a single document.

Each document is measured once: the share of its letters in long stretches that began
earlier in it, the shares of its sentences and lines that repeat, and the share of its
short stretches that are not new. Five rules turn these into votes (repetitive, clean)
or abstain; the rules on sentences and lines abstain where there are few. Expectation-maximisation over the counts of vote patterns (at most 3**5
rows, whatever the input) estimates each rule's accuracies and the share of repetitive
documents, and every document gets the posterior probability of its pattern.

Defined results: a null, empty or letterless text has a share of 0; a null id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch, table
from .letters import LetterBatch, mix, rounds

LONG = 40
LONG_CJK = 16
SHARE = 0.3
POSTERIOR = 0.5
_U = np.uint64

#: rule -> (measure, repetitive from, clean up to); between the two it abstains.
RULES = {
    "v_long": ("share", 0.30, 0.20),
    "v_sentence": ("sentence_share", 0.25, 0.05),
    "v_line": ("line_share", 0.25, 0.02),
    "v_short": ("short_share", 0.35, 0.15),
    "v_runs": ("most_share", 0.10, 0.04),
}
MEASURES = ("share", "sentence_share", "line_share", "short_share", "most_share")

FEW = ("few_sentences", "few_lines")
_ABSTAINS = {"v_sentence": "few_sentences", "v_runs": "few_sentences", "v_line": "few_lines"}

_SENTENCE = re.compile(r"[.!?。！？\n]+")


def repeated_letters(batch: LetterBatch, width: int) -> np.ndarray:
    """Of each text, the letters inside stretches of ``width`` or more that also occur, beginning earlier, in it."""
    values, at = batch.grams(width)
    n = len(batch.size)
    if not len(values):
        return np.zeros(n, dtype=np.int64)
    owner = batch.owner[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        hashed = mix(values ^ (owner * _U(0x9E3779B97F4A7C15)))
    # sorted by 40 bits of the hash, then by place; the whole hash decides
    wide = _U(max(1, int(len(batch.points)).bit_length()))
    key = np.sort(((hashed >> wide) << wide) | at.astype(np.uint64))
    place = (key & ((_U(1) << wide) - _U(1))).astype(np.int64)
    full = np.zeros(len(batch.points), dtype=np.uint64)
    full[at] = hashed
    again = place[1:][full[place[1:]] == full[place[:-1]]]
    edge = np.zeros(len(batch.points) + 1, dtype=np.int32)
    edge[again] += 1
    np.add.at(edge, again + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(batch.owner[covered], minlength=n)


def _repeats(parts: list[str]) -> tuple[float, float]:
    """Share of the characters in parts that came before, and of those in the part that repeats most."""
    seen: dict[str, int] = {}
    total = again = 0
    for p in parts:
        size = len(p)
        if size < 4:
            continue
        total += size
        k = seen.get(p, 0)
        again += size if k else 0
        seen[p] = k + 1
    if not again:
        return 0.0, 0.0
    return again / total, max((k - 1) * len(p) for p, k in seen.items()) / total


def measured(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The measures of some texts."""
    batch = LetterBatch(texts)
    n = len(texts)
    size = np.maximum(batch.size, 1)
    cjk = np.bincount(batch.owner[(batch.points >= 0x3400) & (batch.points < 0xA000)], minlength=n) * 2 > batch.size
    long = repeated_letters(batch, LONG)
    if cjk.any():
        short_rows = np.nonzero(cjk)[0]
        long[short_rows] = repeated_letters(LetterBatch([texts[k] for k in short_rows]), LONG_CJK)
    values, at = batch.grams(8)
    with np.errstate(over="ignore"):
        key = mix(values ^ (batch.owner[at].astype(np.uint64) * _U(0xD1342543DE82EF95)))
    order = np.sort((key >> _U(20) << _U(20)) | (batch.owner[at].astype(np.uint64) & _U(0xFFFFF)))
    old = order[1:][order[1:] >> _U(20) == order[:-1] >> _U(20)]
    twice = np.bincount((old & _U(0xFFFFF)).astype(np.int64), minlength=n)
    sentences, lines = np.zeros((n, 2)), np.zeros(n)
    few, single = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    for k, t in enumerate(texts):
        if t:
            low = t.lower()
            parts = [p.strip() for p in _SENTENCE.split(low)]
            few[k] = len(parts) < 4
            sentences[k] = _repeats(parts)
            rows = low.split("\n")
            single[k] = len(rows) < 3
            if not single[k]:
                lines[k] = _repeats([p.strip() for p in rows])[0]
    return {
        "letters": batch.size,
        "share": long / size,
        "sentence_share": sentences[:, 0],
        "line_share": lines,
        "short_share": twice / np.maximum(batch.size - 7, 1),
        "most_share": sentences[:, 1],
        "few_sentences": few,
        "few_lines": single,
    }


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, letters`` and the measures, one scan without an exchange."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for first, part in rounds(got.column(1).to_pylist()):
                m = measured(part)
                ids = got.column(0).slice(first, len(part))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(m[c]) for c in ("letters", *MEASURES, *FEW))], names=["doc_id", "letters", *MEASURES, *FEW])

    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id bigint, letters bigint, " + ", ".join([*(f"{m} double" for m in MEASURES), *(f"{f} boolean" for f in FEW)]))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> np.ndarray:
    """Posterior probability of the positive class for each vote pattern (1, 0, or -1 for an abstention).

    Two-class expectation-maximisation with a rate of positive votes per rule and class,
    started from the share of positive votes and smoothed by one vote each way. Estimates are bounded: a rule misses
    at least a twentieth of its class, and the class has at least a thousandth of the rows.
    """
    cast, yes = patterns >= 0, patterns == 1
    votes = cast.sum(axis=1)
    p = np.where(votes > 0, (yes.sum(axis=1) + 0.02) / (votes + 1.0), 0.02)
    for _ in range(steps):
        prior = np.clip((counts @ p + 1) / (counts.sum() + 2), 0.001, 0.999)
        w1, w0 = counts * p, counts * (1 - p)
        r1 = np.clip((w1 @ yes + 0.9) / (w1 @ cast + 1), 1e-4, 0.95)
        r0 = np.clip((w0 @ yes + 0.1) / (w0 @ cast + 1), 1e-4, 1 - 1e-4)
        r1 = np.maximum(r1, r0)  # a rule is never taken as better reversed
        l1 = np.log(prior) + (cast * np.where(yes, np.log(r1), np.log1p(-r1))).sum(axis=1)
        l0 = np.log1p(-prior) + (cast * np.where(yes, np.log(r0), np.log1p(-r0))).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(l0 - l1, -500, 500)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, letters``, the measures and ``posterior``, the probability that the document is repetitive."""
    spark = docs.sparkSession
    known = measures(docs, key, text)
    for rule, (measure, high, low) in RULES.items():
        vote = F.when(F.col(measure) >= high, 1).when(F.col(measure) <= low, 0).otherwise(-1)
        known = known.withColumn(rule, F.when(F.col(_ABSTAINS[rule]), -1).otherwise(vote) if rule in _ABSTAINS else vote)
    known = scratch(known, "measures")
    rules = list(RULES)
    seen = known.groupBy(*rules).count().collect()  # at most 3**5 rows
    if not seen:
        return known.drop(*rules, *FEW).withColumn("posterior", F.lit(0.0))
    posterior = fit_votes(np.array([[r[v] for v in rules] for r in seen]), np.array([r["count"] for r in seen], dtype=float))
    model = spark.createDataFrame([(*(int(r[v]) for v in rules), float(p)) for r, p in zip(seen, posterior, strict=True)], ", ".join(f"{v} int" for v in rules) + ", posterior double")
    return known.join(F.broadcast(model), rules).drop(*rules, *FEW)


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` of the documents that the votes call repetitive (a posterior of ``POSTERIOR`` or more) and whose exact share
    confirms it (``SHARE`` or more)."""
    return repetition(docs, key, text).where((F.col("posterior") >= POSTERIOR) & (F.col("share") >= SHARE)).select("doc_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetitive(table(spark, folder, "documents"))


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(table(spark, folder, "documents")).select("doc_id", "letters", *[F.round(c, 6).alias(c) for c in (*MEASURES, "posterior")])
