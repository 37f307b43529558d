"""Byte-level BPE encoding with an existing vocabulary, whole documents at a time.

Pieces recur, so a task remembers what it has encoded (``PieceCounter``). Documents are
encoded where they are read: no exchange by piece, of which a few make up most rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PIECE_PATTERN, byte_level, byte_level_inverse
from ..session import prepare

MOST_MERGES = 1_000_000
MODES = ("whitespace", "gpt2")
REMEMBER = 300_000  # pieces whose counts a task keeps

Model = tuple[tuple[tuple[str, int], ...], tuple[tuple[str, str], ...]]


def load_model(vocab: DataFrame, merges: DataFrame, first: int = MOST_MERGES) -> Model:
    """Vocabulary and the ``first`` merges (lower rank first) as tuples; a vocabulary is small by nature, and more than
    ``MOST_MERGES`` rows are refused."""
    v = vocab.select("token", "token_id").where("token is not null").limit(MOST_MERGES + 1).collect()
    m = merges.select("left_token", "right_token", "merge_rank").orderBy("merge_rank").limit(min(first, MOST_MERGES + 1)).collect()
    if max(len(v), len(m)) > MOST_MERGES:
        raise ValueError("that is not the vocabulary of a tokenizer")
    return tuple((r.token, r.token_id) for r in v), tuple((r.left_token, r.right_token) for r in m)


class PieceCounter:
    """Token counts and ids of texts under a model. A symbol outside the vocabulary becomes ``<unk>`` if there is one, else nothing.

    Mode ``whitespace`` encodes the pieces of the white-space pre-tokenizer and remembers short ones, which recur. Mode ``gpt2``
    first splits off the ``added`` tokens where they stand in a text, then encodes the pieces of the second pre-tokenizer.
    """

    def __init__(self, model: Model, mode: str = "whitespace", added: tuple[str, ...] = ()) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
        vocab = dict(model[0])
        unknown = "<unk>" if "<unk>" in vocab else None
        self.bpe = Tokenizer(models.BPE(vocab=vocab, merges=list(model[1]), unk_token=unknown))
        self.bpe.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=mode == "gpt2")
        if mode == "gpt2" and added:
            self.bpe.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in added if t in vocab])
        self.whole = mode == "gpt2"
        self.pieces = re.compile(PIECE_PATTERN).findall
        self.known: dict[str, int] = {}
        self.known_ids: dict[str, list[int]] = {}

    def _split(self, texts: list[str | None], known: dict, value: Callable) -> list[list[str] | None]:
        """The pieces of each text, all of them known afterwards."""
        split = [self.pieces(t) if t is not None else None for t in texts]
        new = list({p for s in split if s for p in s if p not in known})
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = list({p for s in split if s for p in s})
        for p, e in zip(new, self.bpe.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[p] = value(e)
        return split

    def counts(self, texts: list[str | None]) -> list[int | None]:
        if self.whole:
            return [len(i) if i is not None else None for i in self.ids(texts)]
        split = self._split(texts, self.known, len)
        return [sum(map(self.known.__getitem__, s)) if s is not None else None for s in split]

    def ids(self, texts: list[str | None]) -> list[list[int] | None]:
        if self.whole:
            coded = iter(self.bpe.encode_batch_fast([t for t in texts if t is not None], add_special_tokens=False))
            return [next(coded).ids if t is not None else None for t in texts]
        split = self._split(texts, self.known_ids, lambda e: e.ids)
        return [list(chain.from_iterable(map(self.known_ids.__getitem__, s))) if s is not None else None for s in split]

    def piece_ids(self, found: list[str]) -> list[list[int]]:
        """Ids of pieces as they are, not split any further."""
        return [e.ids for e in self.bpe.encode_batch_fast(found, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(model: Model, mode: str = "whitespace", added: tuple[str, ...] = ()) -> PieceCounter:
    """One encoder a worker and model."""
    return PieceCounter(model, mode, added)


def encode_documents(
    docs: DataFrame, model: Model, bos: int | None = None, eos: int | None = None, key: str = "doc_id", text: str = "text", mode: str = "whitespace", added: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, ids`` in one scan without an exchange; empty texts give only bos and eos, null texts no row."""
    prepare(docs.sparkSession)
    head, tail = ([] if t is None else [t] for t in (bos, eos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(model, mode, added)
        for got in batches:
            coded = [head + i + tail for i in encoder.ids(got.column(1).to_pylist())]
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)))])
            flat = np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([got.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("text is not null").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", mode: str = "whitespace", added: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens`` in one scan, with the piece memo of each task."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(counter(model, mode, added).counts(got.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text")).where("text is not null").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; ids outside the vocabulary vanish. The vocabulary, at most ``MOST_MERGES`` rows, is an
    array that each row's ids index; nothing is exchanged."""
    rows = vocab.select("token_id", "token").where("token_id is not null and token is not null").limit(MOST_MERGES + 1).collect()
    if len(rows) > MOST_MERGES:
        raise ValueError("that is not the vocabulary of a tokenizer")
    token = {r.token_id: r.token for r in rows}
    prepare(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            words = ["".join(token.get(i, "") for i in row) if row is not None else "" for row in got.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(words, pa.string())], names=["doc_id", "word"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, word string").select("doc_id", byte_level_inverse(F.col("word")).alias("text"))


def merged_natively(words: DataFrame, merges: list[tuple[str, str]], word: str = "word") -> DataFrame:
    """``word, symbols`` for a short merge list, all in the JVM: symbols are delimited and each merge, in rank order, is one
    replacement. Equals lowest-rank-first encoding while no two merges give the same symbol."""
    symbols = F.concat(F.lit("\x02"), F.array_join(F.split(byte_level(F.col(word)), ""), "\x03\x02"), F.lit("\x03"))
    for a, b in merges:
        symbols = F.replace(symbols, F.lit(f"\x02{a}\x03\x02{b}\x03"), F.lit(f"\x02{a}{b}\x03"))
    return words.withColumn("symbols", symbols)


def n_symbols(symbols: object) -> object:
    """Number of delimited symbols."""
    return F.length(symbols) - F.length(F.replace(symbols, F.lit("\x02"), F.lit("")))  # type: ignore[arg-type]
