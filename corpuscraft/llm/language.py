"""Problem 2: missing or wrong language labels, by prediction by partial matching.

For each language a variable-order context tree over bytes (contexts of up to four bytes
of lower-case UTF-8) is counted on a bounded sample of labelled documents and frozen. The
code length of a byte follows the longest context the language knows: -log2(count / (n +
d)) for a byte seen n-of-d there, else the escape -log2(d / (n + d)) and the next shorter
context, and 8 bits below all. Labels are noisy, so sample documents that trees
of other sample documents call otherwise are dropped, and the trees are counted again.

Texts are cut into sentences and lines. Each unit has a code length in every language; the
cheapest path through the units of a document, a change of language costing ``SWITCH``
bits, gives the stretches. A stretch's confidence is the posterior of its language from
the code lengths of its units.

All languages' trees are merged into one table of contexts per order, so that a position is
looked up once for all languages; its size is bounded by the sample (``SAMPLE_DOCS`` a
language), and it is broadcast.

Defined results: null, empty and letterless texts have no language (no row in segments,
null language with confidence 0 in documents); so have all texts where no document has a
label that names a language. Rows with a null id are left out, repeated rows count as one
text each, a statistic's redelivered rows once.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch, table
from .letters import rounds
from .tokens import label_language, latest

ORDER = 4
SWITCH = 14.0
SAMPLE_DOCS = 250
MIN_ALPHA = 60
PART = 0.2
SHORT = 12  # characters of a unit that may be mere filler
ROUND = 400_000

_UNIT = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]+\s*|[^.!?。！？\n]+")
_BLANKS = re.compile(r"[^\S\n]+")
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_START = b"\n" * ORDER


def _alpha_table() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[[c for c in range(0x30000) if chr(c).isalpha()]] = True
    return out


_ALPHA: list[np.ndarray] = []


def _plain(text: str) -> str:
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", text))


def _usable(text: str) -> bool:
    """Whether a sample text is not mostly one thing again and again, which would weigh too much in its tree."""
    raw = text.encode("utf-8", "replace")
    return 6 * len(zlib.compress(raw, 1)) > len(raw)


class _Slots:
    """Open addressing for 64-bit keys; answers with the place of a key in ``keys`` or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, _EMPTY)
        self.row = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._home(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.key[at] == _EMPTY
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(todo), dtype=bool)
            mine[first] = True
            mine &= free
            self.key[at[mine]], self.row[at[mine]] = keys[todo[mine]], todo[mine]
            todo, step = todo[~mine], step + 1
        self.probes = max(1, step)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = np.where(self.key[at] == keys, self.row[at], -1)
        todo = np.nonzero((out < 0) & (self.key[at] != _EMPTY))[0]
        step = 0
        while len(todo) and step < self.probes:
            step += 1
            at2 = (at[todo] + step) & ((1 << self.bits) - 1)
            hit = self.key[at2] == keys[todo]
            out[todo[hit]] = self.row[at2[hit]]
            todo = todo[~hit & (self.key[at2] != _EMPTY)]
        return out


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each position from ``ORDER`` on, as one number."""
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out << _U(8)) | data[ORDER - size + 1 + k : ORDER - size + 1 + k + n]
    return out


class ContextTrees:
    """Frozen code lengths of all languages. ``cost[k]``: rows (languages x grams) of the seen grams of k + 1 bytes;
    ``escape[k]``: the escape of a context of k bytes, on the rows of its gram of order k - 1 (one row at k = 0)."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        joined = {k: np.frombuffer(b"".join(_START + _plain(t).lower().encode() for t in samples[k]) or _START, dtype=np.uint8) for k in self.languages}
        n = len(self.languages)
        self.slots: list[_Slots] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        if not n:
            return
        keys_before = np.zeros(0, dtype=np.uint64)
        cost_before = np.full((n, 1), 8.0)
        for order in range(ORDER + 1):
            grams = {k: np.unique(_grams(v, order + 1), return_counts=True) for k, v in joined.items()}
            keys = np.unique(np.concatenate([g for g, _ in grams.values()]))
            context = keys >> _U(8)
            # row of the context and of the shorter gram among the grams of the order before
            up = np.searchsorted(keys_before, context) if order else np.zeros(len(keys), dtype=np.int64)
            down = np.searchsorted(keys_before, keys & _U((1 << (8 * order)) - 1)) if order else np.zeros(len(keys), dtype=np.int64)
            rows = max(1, len(keys_before))
            known = np.isin(context, keys_before) if order else np.ones(len(keys), dtype=bool)
            cost = np.empty((n, len(keys)))
            escape = np.zeros((n, rows))
            for l, k in enumerate(self.languages):
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, grams[k][0])] = grams[k][1]
                total = np.bincount(up[known], count[known], minlength=rows)
                kinds = np.bincount(up[known], count[known] > 0, minlength=rows)
                seen = total > 0
                escape[l, seen] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                own = np.maximum(total + kinds, 1)[np.minimum(up, rows - 1)]
                cost[l] = np.where((count > 0) & known, -np.log2(np.maximum(count, 1) / own), escape[l, np.minimum(up, rows - 1)] * known + cost_before[l, np.minimum(down, cost_before.shape[1] - 1)])
            self.slots.append(_Slots(keys))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            keys_before, cost_before = keys, cost

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(languages, units) code lengths. ``data`` begins with ``ORDER`` bytes of context; ``starts`` are the units'
        first positions behind it."""
        n = len(data) - ORDER
        full = _grams(data, ORDER + 1)
        todo: np.ndarray | None = None  # all positions
        steps: list[tuple[np.ndarray | None, np.ndarray, np.ndarray]] = []  # positions, table, rows
        key = full
        for order in range(ORDER, -1, -1):
            row = self.slots[order].find(key)
            hit = row >= 0
            steps.append((np.nonzero(hit)[0] if todo is None else todo[hit], self.cost[order], row[hit]))
            miss = np.nonzero(~hit)[0]
            if not len(miss):
                todo = miss
                break
            todo = miss if todo is None else todo[miss]
            context = key[miss] >> _U(8)
            if order:
                at = self.slots[order - 1].find(context)
                steps.append((todo[at >= 0], self.escape[order], at[at >= 0]))
                key = key[miss] & _U((1 << (8 * order)) - 1)
            else:
                steps.append((todo, self.escape[0], np.zeros(len(todo), dtype=np.int64)))
        out = np.empty((len(self.languages), len(starts)))
        for l in range(len(self.languages)):
            cost = np.zeros(n, dtype=np.float32)
            for at, tab, row in steps:
                cost[at] += tab[l][row]
            if todo is not None and len(todo):
                cost[todo] += 8
            out[l] = np.add.reduceat(cost, starts)
        return out


def path(bits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Language of each unit: the cheapest path through the units of each text, all texts advancing together."""
    langs, n = bits.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    first = np.nonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[0]
    size = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    back = np.empty((langs, n), dtype=np.int8)
    cost = bits[:, first].copy()
    for step in range(1, int(size.max())):
        live = int(np.searchsorted(-size, -step, side="left"))  # texts with more than ``step`` units
        unit = first[:live] + step
        least = cost[:, :live].argmin(axis=0)
        change = cost[least, np.arange(live)] + SWITCH
        stay = cost[:, :live] <= change
        back[:, unit] = np.where(stay, np.arange(langs, dtype=np.int8)[:, None], least.astype(np.int8))
        cost[:, :live] = np.where(stay, cost[:, :live], change) + bits[:, unit]
    out = np.empty(n, dtype=np.int64)
    now = cost.argmin(axis=0)
    for step in range(int(size.max()) - 1, -1, -1):
        live = int(np.searchsorted(-size, -step, side="left"))
        unit = first[:live] + step
        out[unit] = now[:live]
        if step:
            now[:live] = back[now[:live], unit]
    return out


def units_of(trees: ContextTrees, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, characters, letters, bits and language of the units of some texts."""
    if not _ALPHA:
        _ALPHA.append(_alpha_table())
    owner: list[int] = []
    parts: list[str] = []
    again: list[bool] = []
    for k, t in enumerate(texts):
        if t:
            found = _UNIT.findall(t)
            parts += found
            owner += [k] * len(found)
            many = Counter(p for p in found if len(p) <= SHORT)
            again += [many[p] > 3 for p in found] if many else [False] * len(found)
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros((len(trees.languages), 0)), none
    own = np.array(owner)
    chars = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    alpha = np.add.reduceat(_ALPHA[0][points].astype(np.int64), np.cumsum(chars) - chars)
    # full-width letters and odd or doubled blanks say nothing of the language; units with some are read in plain form
    odd = ((points >= 0xFF21) & (points <= 0xFF5A)) | (points == 0xA0) | ((points >= 0x2000) & (points <= 0x206F)) | (points == 0x3000)
    odd[1:] |= (points[1:] == 0x20) & (points[:-1] == 0x20)
    for k in np.nonzero(np.add.reduceat(odd.astype(np.int64), np.cumsum(chars) - chars))[0]:
        parts[k] = _plain(parts[k])
    lowered = "\0".join(parts).lower().encode("utf-8", "replace").split(b"\0") if not any("\0" in p for p in parts) else [p.lower().encode("utf-8", "replace") for p in parts]
    size = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    data = np.frombuffer(_START + b"".join(lowered), dtype=np.uint8)
    bits = trees.bits(data, np.cumsum(size) - size)
    bits[:, np.array(again)] *= 0.002  # a word said over and over is hardly new evidence; it follows its neighbours
    return own, chars, alpha, bits, path(bits, own)


def sample_trees(docs: DataFrame, codes: DataFrame, text: str = "text", label: str = "lang", most: int = SAMPLE_DOCS) -> ContextTrees:
    """Trees of a sample of at most about ``most`` labelled documents a language, chosen by hash of the text."""
    rows = docs.select(docs[text].alias("text"), label_language(docs[label], codes).alias("language")).where("language is not null and length(text) >= 60 and length(text) <= 20000")
    sizes = {r["language"]: r["count"] for r in rows.groupBy("language").count().collect()}
    if not sizes:
        return ContextTrees({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("language")] * (1 << 20)
    samples: dict[str, list[str]] = {k: [] for k in sizes}
    drawn = rows.where(draw).dropDuplicates(["text", "language"])  # copies of a text count once
    for r in drawn.orderBy(F.xxhash64("text"), "language").limit(4 * most * len(sizes)).collect():
        if len(samples[r["language"]]) < 2 * most and _usable(r["text"]):
            samples[r["language"]].append(r["text"])
    for k in samples:
        samples[k].sort()
    return cleaned_trees(samples)


def cleaned_trees(samples: dict[str, list[str]], folds: int = 3) -> ContextTrees:
    """Trees of the texts that trees of the *other* folds call by their label, for a text's own counts would excuse it."""
    kept: dict[str, list[str]] = {k: [] for k in samples}
    for fold in range(folds):
        trees = ContextTrees({k: [t for i, t in enumerate(v) if i % folds != fold] or v for k, v in samples.items()})
        for l, k in enumerate(trees.languages):
            for _, part in rounds([t for i, t in enumerate(samples[k]) if i % folds == fold], ROUND):
                own, _, alpha, _, lang = units_of(trees, part)
                agree = np.bincount(own, alpha * (lang == l), minlength=len(part)) >= 0.95 * np.bincount(own, alpha, minlength=len(part))
                kept[k] += [t for t, ok in zip(part, agree, strict=True) if ok]
    return ContextTrees({k: v or samples[k] for k, v in kept.items()})


def _posterior(bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Probability of the chosen language of each column from code lengths."""
    gap = bits - bits[chosen, np.arange(bits.shape[1])]
    return 1 / np.exp2(np.clip(-gap, -1000, 1000)).sum(axis=0)


def segments(df: DataFrame, key: str, trees: ContextTrees, text: str = "text") -> DataFrame:
    """``id, first, size`` (characters), ``letters, language, confidence`` of each one-language stretch."""
    spark = df.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for got in batches if trees.languages else ():
            ids = got.column(0).to_numpy()
            for first, part in rounds(got.column(1).to_pylist(), ROUND):
                own, chars, alpha, bits, lang = units_of(trees, part)
                if not len(own):
                    continue
                head = np.nonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (lang[1:] != lang[:-1])]))[0]
                start = np.cumsum(chars) - chars
                base = np.zeros(len(part), dtype=np.int64)
                text_head = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
                base[own[text_head]] = start[text_head]
                letters = np.add.reduceat(alpha, head)
                sums = np.add.reduceat(bits, head, axis=1)
                sure = _posterior(sums, lang[head])
                ok = letters > 0
                names = pa.array(np.array(trees.languages, dtype=object)[lang[head][ok]], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + own[head]][ok]), pa.array((start[head] - base[own[head]])[ok]), pa.array(np.add.reduceat(chars, head)[ok]), pa.array(letters[ok]), names, pa.array(sure[ok])],
                    names=["id", "first", "size", "letters", "language", "confidence"],
                )

    chosen = df.select(df[key].cast("bigint").alias("id"), df[text].alias("text")).where("id is not null and text is not null")
    return chosen.mapInArrow(run, "id bigint, first bigint, size bigint, letters bigint, language string, confidence double")


def _by_language(cut: DataFrame) -> DataFrame:
    """``id, language, letters, confidence, all_letters``"""
    by = cut.groupBy("id", "language").agg(F.sum("letters").alias("letters"), (F.sum(F.col("letters") * F.col("confidence")) / F.sum("letters")).alias("confidence"))
    return by.join(by.groupBy("id").agg(F.sum("letters").alias("all_letters")), "id")


def document_languages(docs: DataFrame, trees: ContextTrees, key: str = "doc_id") -> DataFrame:
    """``doc_id, language, confidence``: the language of most letters of each document; confidence is its share of the
    letters times the confidence of its stretches."""
    by = _by_language(segments(docs, key, trees))
    best = by.groupBy("id").agg(F.max(F.struct("letters", "language", "confidence", "all_letters")).alias("b"))
    known = best.select(F.col("id").alias("doc_id"), F.col("b.language").alias("language"), (F.col("b.confidence") * F.col("b.letters") / F.col("b.all_letters")).alias("confidence"))
    return docs.select(docs[key].cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().join(known, "doc_id", "left").na.fill(0.0, ["confidence"])


def statistic_languages(rows: DataFrame, stats: DataFrame, trees: ContextTrees) -> DataFrame:
    """``stat_id, language, confidence``: the language of most letters of a statistic's distinct stream rows."""
    owner = rows.select("row_id", "stat_id").where("row_id is not null and stat_id is not null").distinct()
    once = segments(rows, "row_id", trees).groupBy("id", "first", "language").agg(F.max("letters").alias("letters"), F.max("confidence").alias("confidence"))
    by = once.groupBy("id", "language").agg(F.sum("letters").alias("letters"), F.sum(F.col("letters") * F.col("confidence")).alias("weight"))
    total = owner.join(by, owner.row_id == by.id).groupBy("stat_id", "language").agg(F.sum("letters").alias("letters"), F.sum("weight").alias("weight"))
    best = total.groupBy("stat_id").agg(F.max(F.struct("letters", "language", "weight")).alias("b"), F.sum("letters").alias("n"))
    known = best.select("stat_id", F.col("b.language").alias("language"), (F.col("b.weight") / F.col("n")).alias("confidence"))
    return stats.select("stat_id").where("stat_id is not null").distinct().join(known, "stat_id", "left").na.fill(0.0, ["confidence"])


def _trees(spark: SparkSession, folder: str) -> ContextTrees:
    return sample_trees(table(spark, folder, "documents"), table(spark, folder, "lang_codes"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, codes, stats = table(spark, folder, "documents"), table(spark, folder, "lang_codes"), table(spark, folder, "stream_stats")
    trees = _trees(spark, folder)
    named = docs.select("doc_id", label_language(docs["lang"], codes).alias("named")).where("doc_id is not null").distinct()
    by = _by_language(scratch(segments(docs, "doc_id", trees), "segments")).where((F.col("all_letters") >= MIN_ALPHA) & (F.col("letters") >= PART * F.col("all_letters")))
    wrong = by.join(named, by.id == named.doc_id).where(~F.col("language").eqNullSafe(F.col("named"))).select(F.lit("doc").alias("kind"), "id", "language")
    valid = latest(stats.select("stat_id", "finished_at", "language"), "stat_id", "finished_at").select(F.col("stat_id").alias("id"), label_language(F.col("language"), codes).alias("named"))
    said = statistic_languages(table(spark, folder, "stream_rows"), stats, trees).where("language is not null")
    stat = said.join(valid, said.stat_id == valid.id).where(~F.col("language").eqNullSafe(F.col("named"))).select(F.lit("stat").alias("kind"), "id", "language")
    return wrong.union(stat).select("kind", F.col("id").alias("key_id"), F.col("language").alias("lang"))


def p2_documents(spark: SparkSession, folder: str) -> DataFrame:
    return document_languages(table(spark, folder, "documents"), _trees(spark, folder)).withColumn("confidence", F.round("confidence", 6))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of documents that mix languages."""
    cut = scratch(segments(table(spark, folder, "documents"), "doc_id", _trees(spark, folder)), "segments")
    mixed = cut.groupBy("id").agg(F.count_distinct("language").alias("n")).where("n > 1").select("id")
    return cut.join(mixed, "id", "left_semi").select(F.col("id").alias("doc_id"), "first", "size", "language", F.round("confidence", 6).alias("confidence"))


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return statistic_languages(table(spark, folder, "stream_rows"), table(spark, folder, "stream_stats"), _trees(spark, folder)).withColumn("confidence", F.round("confidence", 6))
