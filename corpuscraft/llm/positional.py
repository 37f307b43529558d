"""Near-duplicate search with a byte-position inverted index and count filtering.

A text is reduced to a *sketch* of bytes at fixed positions. Several hash functions each
throw the text's letter shingles into 64 bins; the smallest hash value of a bin gives one
byte at one position. Two texts with resemblance J agree at a position with probability
J + (1 - J) / 256. Empty bins borrow from the next full one.

The inverted index lists, for a group of positions and the bytes found there, the texts that
have them. Texts that meet in a list share the bytes of the group; the shared bytes are
tallied per pair, and pairs that meet in fewer than two lists go. The others have all
positions compared; those with fewer equal ones than ``Grid.least`` go. What remains is
verified exactly on the whole texts. Single bytes as keys would make lists of 1/256 of all
texts.

Chance meetings grow with the square of the texts, so the group grows with them (``GRIDS``), and
the positions with the group, so that a pair at J = 0.6, the lowest resemblance that counts
here, is expected in 6 lists or more at every size: groups of four of 192 positions (48 lists,
such a pair is lost with a probability of 1.5 %, at J = 0.7 of 0.01 %) up to four million texts,
of six of 1,024 (160 lists, 0.4 %) up to sixty-four million, of eight of 3,072 (384 lists,
1.1 %) beyond.

Skew: texts with equal letters form one class before anything is indexed, so a group
of copies has one set of postings. A list longer than ``BLOCK`` texts is cut into
blocks and its pairs of blocks are spread over tasks that compare sketches, so no task
holds more than two blocks and no pair is emitted before it passes the count filter.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare, scratch
from .letters import LetterBatch, mix, rounds

WIDTH = 8  # letters of a shingle
BINS = 64
MIN_LISTS = 2

BLOCK = 1024
BROADCAST_IDS = 500_000  # ids of paired texts up to which they are broadcast to the scan
EXPAND = 256  # ids in a block when the pairs of classes are written out

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Grid:
    """Positions of a sketch: ``rounds`` hash functions of 64 bins each, lists for groups of ``group`` positions."""

    group: int
    rounds: int

    @property
    def lists(self) -> int:
        return self.rounds * (BINS // self.group)

    @property
    def size(self) -> int:
        return self.rounds * BINS

    @property
    def least(self) -> int:
        """Equal positions a pair needs; at J = 0.6 three fifths are expected."""
        return self.size * 13 // 32

    def order(self) -> np.ndarray:
        """Bins of a round with those of a group side by side; a group's bins lie apart, for neighbours borrow from each other."""
        many = BINS // self.group
        return np.concatenate([np.arange(many * self.group).reshape(self.group, many).T.ravel(), np.arange(many * self.group, BINS)])

    def keys(self, marks: np.ndarray) -> np.ndarray:
        """(texts, lists): number of the list and its bytes, as one number."""
        many = BINS // self.group
        parts = marks.reshape(len(marks), self.rounds, BINS)[:, :, : many * self.group].reshape(len(marks), self.lists, self.group).astype(np.int64)
        if self.group < 7:
            return (parts << (8 * np.arange(self.group))).sum(axis=2) | np.arange(self.lists, dtype=np.int64) << (8 * self.group)
        whole = np.zeros(parts.shape[:2], dtype=np.uint64)
        for k in range(self.group):
            whole = mix(whole ^ parts[:, :, k].astype(np.uint64), k)
        return mix(whole ^ np.arange(self.lists, dtype=np.uint64)).view(np.int64)


#: Texts up to which a grid serves.
GRIDS = ((4_000_000, Grid(4, 3)), (64_000_000, Grid(6, 16)), (1 << 62, Grid(8, 48)))


def grid_for(texts: int) -> Grid:
    return next(g for most, g in GRIDS if texts <= most)


def sketches(batch: LetterBatch, grid: Grid, width: int = WIDTH) -> np.ndarray:
    """(texts, positions) bytes; those of a list are neighbours."""
    values, at = batch.grams(width)
    owner = batch.owner[at].astype(np.int64)
    n = len(batch.size)
    out = np.empty((n, grid.rounds, BINS), dtype=np.uint8)
    for r in range(grid.rounds):
        h = mix(values, 11 + 13 * r)
        least = np.full(n * BINS, _FULL)
        np.minimum.at(least, owner * BINS + (h >> _U(58)).astype(np.int64), h)
        least = least.reshape(n, BINS)
        empty = least == _FULL
        empty[empty.all(axis=1)] = False  # texts without a shingle
        step, value = 0, least.copy()
        while empty.any():
            step += 1
            row, col = np.nonzero(empty)
            got = least[row, (col + step) % BINS]
            value[row, col] = np.where(got == _FULL, _FULL, got + _U(step))
            empty[row, col] = got == _FULL
        out[:, r] = (mix(value) & _U(0xFF)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :, grid.order()]).reshape(n, grid.size)


def digests(batch: LetterBatch) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole letters."""
    n = len(batch.size)
    place = (np.arange(len(batch.points)) - batch.start[batch.owner]).astype(np.uint64)
    base = (place << _U(32)) | batch.points.astype(np.uint64)
    full = np.nonzero(batch.size)[0]
    out = []
    for seed in (3, 5):
        total = np.zeros(n, dtype=np.uint64)
        if full.size:
            total[full] = np.add.reduceat(mix(base, seed), batch.start[full])
        out.append(mix(total ^ batch.size.astype(np.uint64), seed).view(np.int64))
    return out[0], out[1]


def sketch_table(df: DataFrame, key: Column, text: Column, least: int, grid: Grid, width: int = WIDTH) -> DataFrame:
    """``id, d1, d2, sketch`` of the texts with ``least`` letters or more; one scan, no exchange."""
    prepare(df.sparkSession)
    schema = "id bigint, d1 bigint, d2 bigint, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            ids = got.column(0).to_numpy(zero_copy_only=False)
            for first, texts in rounds(got.column(1).to_pylist()):
                batch = LetterBatch(texts)
                keep = np.nonzero(batch.size >= max(least, width))[0]
                if not keep.size:
                    continue
                d1, d2 = digests(batch)
                marks = sketches(batch, grid, width)[keep]
                packed = pa.Array.from_buffers(pa.binary(grid.size), len(keep), [None, pa.py_buffer(marks.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + keep]), pa.array(d1[keep]), pa.array(d2[keep]), packed],
                    names=["id", "d1", "d2", "sketch"],
                )

    chosen = df.select(key.cast("bigint").alias("id"), text.alias("text"))
    return chosen.where("id is not null and text is not null").mapInArrow(run, schema)


def classes(marked: DataFrame) -> DataFrame:
    """One row for texts with equal letters: ``d1, d2, rep`` (least id), ``members``, ``sketch``."""
    return marked.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.first("sketch").alias("sketch"))


def _marks(column: pa.Array, grid: Grid) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, grid.size)


def postings(reps: DataFrame, grid: Grid) -> DataFrame:
    """``list`` (number of the position group and its bytes), ``rep``: a row for each list of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if got.num_rows:
                keys = grid.keys(_marks(got.column(1), grid)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(got.column(0).to_numpy(), grid.lists))], names=["list", "rep"])

    return reps.select("rep", "sketch").mapInArrow(run, "list bigint, rep bigint")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal ``list`` in sorted rows. Short runs give pairs (``block`` is null); rows of long ones come out as (list, rep, block)."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    seen = 0  # rows of the held run that have been put out as blocks

    def out(a: np.ndarray, b: np.ndarray, block: np.ndarray | None) -> pa.RecordBatch:
        blocks = pa.nulls(len(a), pa.int32()) if block is None else pa.array(block.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), blocks], names=["a", "b", "block"])

    def work(k: np.ndarray, rep: np.ndarray, before: int) -> Iterator[pa.RecordBatch]:
        start = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
        size = np.diff(np.concatenate([start, [len(k)]]))
        long = size > BLOCK
        if before:
            long[0] = True
        short = np.nonzero(~long & (size > 1))[0]
        for n in np.unique(size[short]):  # all runs of one length together
            i, j = np.triu_indices(int(n), 1)
            runs = start[short[size[short] == n]]
            for part in range(0, len(runs), max(1, 2_000_000 // len(i))):
                p = (runs[part : part + max(1, 2_000_000 // len(i)), None] + i).ravel()
                q = (runs[part : part + max(1, 2_000_000 // len(i)), None] + j).ravel()
                a, b = rep[p], rep[q]
                yield out(np.minimum(a, b), np.maximum(a, b), None)
        for r in np.nonzero(long)[0]:
            s = slice(start[r], start[r] + size[r])
            yield out(k[s], rep[s], (np.arange(size[r]) + (before if r == 0 else 0)) // BLOCK)

    for got in batches:
        if not got.num_rows:
            continue
        rows = [np.concatenate([h, got.column(c).to_numpy(zero_copy_only=False)]) for c, h in enumerate(held)]
        k = rows[0]
        last = int(np.searchsorted(k, k[-1], side="left"))
        if last == 0 and (seen or len(k) > BLOCK):  # one long run: put it out block by block
            cut = len(k) // BLOCK * BLOCK
            if cut:
                yield out(k[:cut], rows[1][:cut], (np.arange(cut) + seen) // BLOCK)
                seen += cut
            held = [x[cut:] for x in rows]
            if not len(held[0]):
                held = [x[-1:] for x in rows]  # keeps the key; the row comes twice, which is harmless
            continue
        if last:
            yield from work(*(x[:last] for x in rows), seen)
            seen = 0
        held = [x[last:] for x in rows]
    if len(held[0]):
        yield from work(*held, seen)


def _block_pairs(hot: DataFrame, reps: DataFrame, grid: Grid) -> DataFrame:
    """Pairs from long lists: every pair of blocks is one group of two blocks at most, compared by sketch."""
    hot = hot.select(F.col("a").alias("list"), F.col("b").alias("rep"), "block").distinct()
    top = hot.groupBy("list").agg(F.max("block").alias("top"))
    spread = (
        hot.join(top, "list")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top"))))
        .select("list", "rep", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        .join(reps.select("rep", "sketch"), "rep")
    )

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        block = group.column("block").to_numpy()
        rep = group.column("rep").to_numpy()
        marks = _marks(group.column("sketch"), grid)
        left, right = np.nonzero(block == x)[0], np.nonzero(block == y)[0]
        found = [np.zeros((2, 0), np.int64)]
        for i in left:
            same = (marks[right] == marks[i]).sum(axis=1)
            ok = right[(same >= grid.least) & (rep[right] != rep[i])]
            if x == y:
                ok = ok[rep[ok] > rep[i]]
            found.append(np.stack([np.minimum(rep[ok], rep[i]), np.maximum(rep[ok], rep[i])]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return spread.groupBy("list", "x", "y").applyInArrow(run, "a bigint, b bigint").distinct()


def candidates(reps: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of classes (``a < b``) that share enough positional bytes."""
    lists = postings(reps, grid).repartition("list").sortWithinPartitions("list")
    met = scratch(lists.mapInArrow(_meetings, "a bigint, b bigint, block int"), "meetings")
    tallied = met.where("block is null").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_LISTS).select("a", "b")
    s = reps.select(F.col("rep"), "sketch")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if not got.num_rows:
                continue
            ok = (_marks(got.column(2), grid) == _marks(got.column(3), grid)).sum(axis=1) >= grid.least
            yield pa.RecordBatch.from_arrays([pa.array(got.column(c).to_numpy()[ok]) for c in (0, 1)], names=["a", "b"])

    pairs = tallied.join(s.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = pairs.select("a", "b", "sa", "sb").mapInArrow(agree, "a bigint, b bigint")
    return pairs.union(_block_pairs(met.where("block is not null"), reps, grid)).distinct()


def overlap(one: list[str], two: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each first text, of each second text, and of both."""
    n = len(one)
    batch = LetterBatch([*one, *two])
    values, at = batch.grams(width)
    owner = batch.owner[at]
    side, pair = owner >= n, np.where(owner >= n, owner - n, owner)
    key = mix(values ^ (pair.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    sizes, sets, owners = [], [], []
    for s in (~side, side):
        distinct, first = np.unique(key[s], return_index=True)
        sets.append(distinct)
        owners.append(pair[s][first])
        sizes.append(np.bincount(owners[-1], minlength=n))
    both = np.isin(sets[0], sets[1], assume_unique=True)
    return sizes[0], sizes[1], np.bincount(owners[0][both], minlength=n)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH, contained: float = 2.0) -> DataFrame:
    """``a, b, n_a, n_b, n_both`` of the pairs whose exact resemblance on whole texts is ``threshold`` or more, or of
    whose smaller text ``contained`` or more stands in the other.

    ``texts`` has ``id, text``; an id that occurs again has the same letters. Only texts that
    are in a pair leave the scan's exchange.
    """
    pairs = scratch(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # else their texts are found by an exchange
        wanted = F.broadcast(wanted)
    mine = scratch(texts.where("text is not null").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "paired-texts")
    both = pairs.join(mine.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(mine.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            one, two = got.column(2).to_pylist(), got.column(3).to_pylist()
            a, b = got.column(0).to_numpy(), got.column(1).to_numpy()
            for first, part in rounds(x + y for x, y in zip(one, two, strict=True)):
                s = slice(first, first + len(part))
                na, nb, nab = overlap(one[s], two[s], width)
                ok = (nab >= threshold * (na + nb - nab) - 1e-9) | (nab >= contained * np.minimum(na, nb) - 1e-9) & (nab > 0)
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a[s], b[s], na, nb, nab)], names=["a", "b", "n_a", "n_b", "n_both"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, n_both bigint")


def similar_classes(df: DataFrame, key: Column, text: Column, least: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole join: ``marked`` rows (id, d1, d2), ``reps`` and verified ``links`` between classes."""
    grid = grid_for(df.count())
    marked = scratch(sketch_table(df, key, text, least, grid), "sketches")
    reps = scratch(classes(marked), "classes")
    texts = df.select(key.cast("bigint").alias("id"), text.alias("text"))
    links = scratch(verified(candidates(reps, grid), texts, threshold), "links")
    return marked.select("id", "d1", "d2").distinct(), reps, links
