"""Command line: ``python -m corpuscraft train|shards|sequences --data 'GLOB' --out FOLDER [settings]``."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .config import Settings, settings
from .functions.text import byte_level_inverse
from .operators import bpe_encode, bpe_train, corpus, shards, wordcount
from .session import scratch
from .sources.records import write_vocab
from .sources.shard_files import token_dtype, write_manifest, write_shards
from .sources.text import candidates, documents, numbered
from .sources.tokenizer_file import read_tokenizer, special_id, special_tokens, write_merges, write_tokenizer


def _corpus(spark: SparkSession, s: Settings) -> DataFrame:
    """``doc_id, path, text``: usable documents, numbered in file and line order; the first ``max_docs`` if that is set."""
    paths = candidates(s.data)
    if not paths:
        raise FileNotFoundError(f"nothing matches {s.data}")
    rows = numbered(corpus.emitted(documents(spark, paths, s.text_field), s.min_chars, s.max_chars))
    return rows.where(F.col("doc_id") < s.max_docs) if s.max_docs else rows


def train(spark: SparkSession, s: Settings) -> list[str]:
    """Writes tokenizer.json, vocab.json and merges.txt; returns the vocabulary.

    Words are counted exactly; with ``top_k``, each group of ``chunk_files`` files counts its ``top_k`` most frequent words only.
    In mode ``gpt2`` words are the pieces of the second pre-tokenizer and rare ones count too (pairs have the limit).
    """
    specials = special_tokens(s.special_tokens)
    docs = _corpus(spark, s)
    if s.top_k:
        files = docs.select("path").distinct()
        chunk = F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1) / max(1, s.chunk_files))
        counted = wordcount.lossy_counts(docs.join(files.withColumn("chunk", chunk), "path"), F.col("chunk"), s.top_k, s.mode)
        counted = counted.select(byte_level_inverse(F.col("word")).alias("raw"), "freq")
    else:
        counted = wordcount.words(docs, mode=s.mode).groupBy(F.col("word").alias("raw")).agg(F.count("*").alias("freq"))
    if s.mode != "gpt2":
        counted = counted.where(F.col("freq") >= s.min_freq)
    merges = [(a, b) for a, b, _ in bpe_train.train(counted, bpe_train.target_merges(s.vocab_size, len(specials)), s.min_pair_freq)]
    vocab = bpe_train.assembled_vocabulary(merges, specials)
    os.makedirs(s.out, exist_ok=True)
    write_tokenizer(os.path.join(s.out, "tokenizer.json"), vocab, merges, specials, "<unk>")
    write_vocab(os.path.join(s.out, "vocab.json"), vocab)
    write_merges(os.path.join(s.out, "merges.txt"), merges)
    return vocab


def write_token_shards(spark: SparkSession, s: Settings) -> int:
    """Writes token shards and meta.json (with the shards kept for validation by ``val_ratio``) from ``out/tokenizer.json``;
    returns the number of tokens."""
    vocab, merges, _ = read_tokenizer(os.path.join(s.out, "tokenizer.json"))
    model = (tuple(vocab.items()), tuple(merges))
    bos, eos = (special_id(vocab, t) if t in vocab else None for t in ("<bos>", "<eos>"))
    coded = scratch(bpe_encode.encode_documents(_corpus(spark, s), model, bos, eos, mode=s.mode, added=tuple(special_tokens(s.special_tokens))).withColumn("n", F.size("ids").cast("bigint")), "coded")
    dtype = token_dtype(len(vocab))
    written = write_shards(shards.cut_to_shards(coded, s.max_tokens_per_shard), s.out, dtype)
    split = shards.split_shards(written, s.val_ratio, s.seq_len).orderBy("shard_id").collect()  # a row for a shard
    files = [(f"train_{r.shard_id:06d}.bin", r.num_tokens) for r in split]
    held = [f for (f, _), r in zip(files, split, strict=True) if r.part == "val"]
    write_manifest(os.path.join(s.out, "meta.json"), files, dtype=dtype, vocab_size=len(vocab), bos_id=bos, eos_id=eos, max_tokens_per_shard=s.max_tokens_per_shard, num_docs=coded.count(), val_shards=held)
    return sum(n for _, n in files)


def write_sequences(spark: SparkSession, s: Settings) -> int:
    """Writes training sequences of ``seq_len`` tokens as Parquet to ``out/sequences``, in an order drawn by ``seed``; returns
    their number."""
    vocab, merges, _ = read_tokenizer(os.path.join(s.out, "tokenizer.json"))
    bos, eos = (special_id(vocab, t) if t in vocab else None for t in ("<bos>", "<eos>"))
    coded = bpe_encode.encode_documents(_corpus(spark, s), (tuple(vocab.items()), tuple(merges)), bos, eos, mode=s.mode, added=tuple(special_tokens(s.special_tokens)))
    packed = shards.sequences(coded, s.seq_len, s.seq_len, s.max_sequences)
    shards.shuffled(packed, "seq_id", s.seed).repartitionByRange("place").sortWithinPartitions("place", "seq_id").write.mode("overwrite").parquet(os.path.join(s.out, "sequences"))
    return spark.read.parquet(os.path.join(s.out, "sequences")).count()


COMMANDS = {"train": lambda spark, s: len(train(spark, s)), "shards": write_token_shards, "sequences": write_sequences}


def main(arguments: list[str]) -> None:
    if not arguments or arguments[0] not in COMMANDS:
        sys.exit(__doc__)
    s = settings(arguments[1:], ".env")
    spark = SparkSession.builder.appName("corpuscraft").getOrCreate()
    print(COMMANDS[arguments[0]](spark, s))


if __name__ == "__main__":
    main(sys.argv[1:])
