"""Problem 9: evaluation passages inside training documents.

Q-gram lemma filtering. The letters of the evaluation items give an index of their
stretches of eight letters. Each document's stretches are looked up in it; a hit has a
diagonal (place in the document minus place in the item). Hits are gathered per document,
item and diagonal band, and what counts is how many letters of the item they cover; bands
are 32 wide and overlap by half, so that a passage with shifts of up to 16 letters lies
whole in one of them. By the lemma an edit uncovers at most eight letters, so a passage of h
letters with e edits keeps at least h - 7 - 8 e covered; with half of the item's letters and
edits in ``EDITS`` of them, that is the least cover of a band (at least half of h). Bands that
reach it, of overlapping ones the one with the greater cover, are verified by banded local
alignment (match 1, edit -2): the item leaks if the best alignment spans at least half of its
letters with edits in at most ``MOST_EDITS`` of them.

Up to ``EDITS`` the lemma holds wherever the edits are. Beyond, up to ``MOST_EDITS``, a passage is
found if the places of its edits leave enough stretches whole, as edits at random places do;
the tests measure that by brute force, README has the figures.

The items are cut into blocks of at most about ``BLOCK_LETTERS`` characters, each block one
pass over the documents with a broadcast index of that bounded size; the driver holds one
block at a time. The usual test set is one block.

Defined results: null, empty and short items (under ``LEAST`` letters) leak nowhere; null
documents hold nothing; repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import ordinal
from ..session import prepare, scratch, table
from .letters import LetterBatch, rounds

WIDTH = 8
BAND = 32
MARGIN = 8
EDITS = 0.05
MOST_EDITS = 0.15  # of a passage's letters; sentences of one pattern with other words in it have more
MOST_HITS = 4_000_000  # that are worked on at once
LEAST = 24
BLOCK_LETTERS = 4_000_000
_BITS = 20


class _Index:
    """Sorted stretches of the items with their places, behind a bitmap of their low bits."""

    def __init__(self, ids: tuple[int, ...], texts: tuple[str, ...]) -> None:
        self.ids = np.array(ids, dtype=np.int64)
        self.items = LetterBatch(list(texts))
        values, at = self.items.grams(WIDTH)
        order = np.argsort(values, kind="stable")
        values, at = values[order], at[order]
        self.item = self.items.owner[at].astype(np.int64)
        self.place = at - self.items.start[self.item]
        self.key, self.first, self.many = np.unique(values, return_index=True, return_counts=True)
        self.map = np.zeros(1 << _BITS, dtype=bool)
        self.map[(self.key & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        half = np.ceil(self.items.size / 2)
        self.least = np.maximum(np.ceil(half / 2), half - WIDTH + 1 - WIDTH * np.floor(half * EDITS)).astype(np.int64)
        self.least[self.items.size < LEAST] = 1 << 40

    def hits(self, batch: LetterBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """document, item, diagonal and place in the item of every shared stretch; whole documents, about ``MOST_HITS`` at a time."""
        values, at = batch.grams(WIDTH)
        maybe = np.nonzero(self.map[(values & np.uint64((1 << _BITS) - 1)).astype(np.int64)])[0]
        row = np.minimum(np.searchsorted(self.key, values[maybe]), len(self.key) - 1)
        sure = self.key[row] == values[maybe]
        row, at = row[sure], at[maybe[sure]]
        if not len(row):
            return
        turn = np.append(_runs(batch.owner[at]), len(at))  # where documents begin
        before = np.concatenate([[0], np.cumsum(self.many[row])])[turn]
        part = before[:-1] // MOST_HITS
        for cut in np.split(np.arange(len(turn) - 1), _runs(part)[1:]):
            s = slice(turn[cut[0]], turn[cut[-1] + 1])
            r, where = row[s], at[s]
            n = self.many[r]
            which = np.repeat(np.arange(len(r)), n)
            entry = self.first[r][which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
            doc = batch.owner[where[which]].astype(np.int64)
            yield doc, self.item[entry], where[which] - batch.start[doc] - self.place[entry], self.place[entry]


@lru_cache(maxsize=2)
def _index(ids: tuple[int, ...], texts: tuple[str, ...]) -> _Index:
    return _Index(ids, texts)


def _runs(key: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal keys."""
    return np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, dtype=np.int64)


def _covers(key: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many letters the stretches at the places of each cover."""
    if not len(key):
        return key, place
    if int(key.max()).bit_length() + bits < 63:
        value = np.sort(key << bits | place)
        key, place = value >> bits, value & ((1 << bits) - 1)
    else:
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
    begin = _runs(key)
    step = np.minimum(WIDTH, np.diff(place, append=0))
    step[np.append(begin[1:], len(key)) - 1] = WIDTH  # the last stretch of a key is covered whole
    return key[begin], np.add.reduceat(step, begin)


def bands(index: _Index, batch: LetterBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, item, lowest diagonal of the bands whose hits cover enough letters of the item.

    A band is two strips of diagonals; strips that cannot make a band with a neighbour are left out first.
    """
    low = int(index.items.size.max(initial=0)) + BAND  # diagonals begin at minus the longest item
    half, n, bits = BAND // 2, len(index.ids), max(1, low.bit_length())
    wide = (int(batch.size.max(initial=0)) + 2 * low) // half + 3
    found = [np.zeros((3, 0), dtype=np.int64)]
    for doc, item, diagonal, place in index.hits(batch):
        strip = (doc * n + item) * wide + (diagonal + low) // half
        key, cover = _covers(strip, place, bits)
        least = index.least[(key // wide) % n]
        beside = np.where(key[1:] == key[:-1] + 1, cover[1:] + cover[:-1], 0)
        open_ = cover >= least
        open_[1:] |= beside >= least[1:]
        open_[:-1] |= beside >= least[:-1]
        kept = np.isin(strip, key[open_])
        strip, place = strip[kept], place[kept]
        key, cover = _covers(np.concatenate([strip, strip + 1]), np.concatenate([place, place]), bits)
        # of overlapping bands the one with the greater cover
        next_to = key[1:] == key[:-1] + 1
        best = np.ones(len(key), dtype=bool)
        best[:-1] &= ~(next_to & (cover[1:] > cover[:-1]))
        best[1:] &= ~(next_to & (cover[:-1] >= cover[1:]))
        ok = best & (cover >= index.least[(key // wide) % n])
        pair = key[ok] // wide
        found.append(np.stack([pair // n, pair % n, (key[ok] % wide - 1) * half - low]))
    return tuple(np.concatenate(found, axis=1))  # type: ignore[return-value]


def aligned_span(one: np.ndarray, one_start: np.ndarray, one_size: np.ndarray, two: np.ndarray, two_start: np.ndarray, two_size: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each item (``one``) that its best local alignment with its document (``two``) spans, within a
    band of diagonals from ``diagonal - MARGIN``. Also the
    alignment's score. All pairs advance together, an item letter at a time.

    A cell holds score * 2**20 + (2**20 - 1 - first item letter), so the greater cell is the better, then longer one.
    """
    width = BAND + 2 * MARGIN
    pairs = len(diagonal)
    unit, low = 1 << 20, (1 << 20) - 1
    offset = np.arange(width, dtype=np.int64)
    gap = offset * (2 * unit)
    cell = np.zeros((pairs, width + 1), dtype=np.int64)
    best = np.zeros(pairs, dtype=np.int64)
    span = np.zeros(pairs, dtype=np.int64)
    for i in range(int(one_size.max(initial=0))):
        live = i < one_size
        letter = one[np.where(live, one_start + i, 0)]
        j = (i + diagonal - MARGIN)[:, None] + offset
        inside = (j >= 0) & (j < two_size[:, None]) & live[:, None]
        other = two[np.where(inside, two_start[:, None] + j, 0)]
        fresh = low - i
        before = np.maximum(cell[:, :width], fresh)  # nothing before scores 0 from here
        step = np.where(inside & (other == letter[:, None]), unit, -2 * unit)
        new = np.maximum(before + step, cell[:, 1:] - 2 * unit)
        new = np.maximum.accumulate(new + gap, axis=1) - gap
        new[(new < unit) | ~inside] = 0
        cell[:, :width] = new
        top = new.max(axis=1)
        better = (top >> 20) > best
        best = np.where(better, top >> 20, best)
        span = np.where(better, i + 1 - (low - (top & low)), span)
    return span, best


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, doc_id, share``: share of the item's letters that the passage in the document spans."""
    prepare(docs.sparkSession)
    chosen = docs.select(docs[doc_key].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null and text is not null")
    rows = items.select(items[item_key].cast("bigint").alias("item_id"), items[text].alias("text")).where("item_id is not null and text is not null").distinct()
    sized = ordinal(rows, "item_id", "before", F.length("text"))
    parts = scratch(sized.select("item_id", "text", F.expr(f"before div {BLOCK_LETTERS}").alias("block")), "items")
    last = parts.agg(F.max("block")).first()[0] or 0
    found = []
    for block in range(last + 1):
        got = sorted((r.item_id, r.text) for r in parts.where(F.col("block") == block).collect())
        hits = _leaked(chosen, tuple(i for i, _ in got), tuple(t for _, t in got))
        found.append(scratch(hits, "leaks") if last else hits)
    return reduce(DataFrame.union, found).groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))


def _leaked(docs: DataFrame, ids: tuple[int, ...], texts: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(ids, texts)
        for got in batches:
            keys = got.column(0).to_numpy()
            for first, part in rounds(got.column(1).to_pylist()):
                if not len(index.key):
                    return
                batch = LetterBatch(part)
                doc, item, diagonal = bands(index, batch)
                if not len(doc):
                    continue
                size = index.items.size[item]
                span, score = aligned_span(index.items.points, index.items.start[item], size, batch.points, batch.start[doc], batch.size[doc], diagonal)
                ok = (2 * span >= size) & (score >= (1 - 3 * MOST_EDITS) * span)
                yield pa.RecordBatch.from_arrays([pa.array(index.ids[item[ok]]), pa.array(keys[first + doc[ok]]), pa.array(span[ok] / size[ok])], names=["item_id", "doc_id", "share"])

    return docs.mapInArrow(run, "item_id bigint, doc_id bigint, share double")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: documents that hold it and the greatest share, 0 where none does."""
    items = table(spark, folder, "eval_items").select("item_id", "benchmark_name", "split").distinct()
    found = leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    by = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share"), 6).alias("greatest_share"))
    return items.join(by, "item_id", "left").na.fill(0, ["documents", "greatest_share"])
