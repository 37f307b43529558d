import itertools
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscraft.functions.text import BYTE_ALPHABET
from corpuscraft.operators import bpe_encode, bpe_train, wordcount
from corpuscraft.sources import tokenizer_file

TEXTS = ["aaa aaaa abab", "the cat the hat", None, "", "  ", "été été", "the cat the hat", "陶柯 陶柯", "a\x00b"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("ids", F.lit(1))


def slow_train(words, merges, least):
    words = [(list(w), f) for w, f in words]
    out = []
    while len(out) < merges:
        count = Counter()
        for s, f in words:
            for p in itertools.pairwise(s):
                count[p] += f
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], p[0].encode(), p[1].encode()))
        if count[pair] < least:
            break
        out.append((*pair, count[pair]))
        new = []
        for s, f in words:
            t, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    t.append(pair[0] + pair[1])
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            new.append((t, f))
        words = new
    return out


def test_counts(spark):
    got = {r.word: r.freq for r in wordcount.word_counts(docs(spark)).collect()}
    assert got["Ġcat"] == 2 and got["Ġthe"] == 2 and got["the"] == 2 and got["Ã©tÃ©"] == 1 and got["aĀb"] == 1
    assert wordcount.top_words(docs(spark), 2).collect()[0].word == min(w for w, f in got.items() if f == 2)
    pairs = {(r.left, r.right): r.freq for r in wordcount.pair_counts(wordcount.word_counts(docs(spark))).collect()}
    true = Counter()
    for w, f in got.items():
        for p in itertools.pairwise(w):
            true[p] += f
    assert pairs == dict(true)


def test_rollup_and_lossy(spark):
    df = docs(spark).withColumn("lang", F.when(F.col("doc_id") < 2, "x"))
    rows = wordcount.rollup_counts(df, "lang", 1).collect()
    assert sum(r.freq for r in rows if r.total) == sum(r.freq for r in rows if not r.total)
    exact = {r.word: r.freq for r in wordcount.word_counts(df).collect()}
    assert {r.word: r.freq for r in wordcount.lossy_counts(df, F.col("doc_id") % 2, 0).collect()} == exact
    lossy = {r.word: r.freq for r in wordcount.lossy_counts(df, F.col("doc_id"), 1).collect()}
    assert all(exact[w] >= f for w, f in lossy.items()) and len(lossy) < len(exact)


@pytest.mark.parametrize("merges", [0, 5, 40])
def test_training_agrees(spark, merges, monkeypatch):
    counted = wordcount.words(docs(spark)).groupBy("word").agg(F.count("*").alias("freq")).select(F.col("word").alias("raw"), "freq")
    words = [(r.word, r.freq) for r in wordcount.word_counts(docs(spark)).collect()]
    driver = bpe_train.train_on_driver(words, merges)
    assert driver == slow_train(words, merges, 1)
    if merges <= 5:
        assert bpe_train.train_relational(counted, merges) == driver
        assert bpe_train.train(counted, merges) == driver
        monkeypatch.setattr(bpe_train, "KEEP", 2)
        monkeypatch.setattr(bpe_train, "DRIVER_WORDS", 1)  # beyond the driver's bound
        assert bpe_train.train(counted, merges) == driver


def test_training_on_the_test_corpus(spark):
    folder = "/root/testdata/sf0.001"
    words = [(r.word, r.freq) for r in wordcount.word_counts(spark.read.parquet(f"{folder}/documents.parquet"), least=2).collect()]
    assert bpe_train.train_on_driver(words, 60, 2) == slow_train(words, 60, 2)
    assert bpe_train.train_on_driver(words, 10**6, 50)[-1][2] >= 50
    assert bpe_train.target_merges(50000, 3) == 49741 and bpe_train.target_merges(10, 3) == 0


def test_encoding(spark):
    vocab = bpe_train.assembled_vocabulary([("a", "a"), ("aa", "a"), ("t", "h"), ("th", "e"), ("Ġ", "the")], ["<unk>", "<bos>", "<eos>"])
    model = (tuple((t, k) for k, t in enumerate(vocab)), (("a", "a"), ("aa", "a"), ("t", "h"), ("th", "e"), ("Ġ", "the")))
    got = {r.doc_id: r.ids for r in bpe_encode.encode_documents(docs(spark), model, 1, 2).collect()}
    name = lambda ids: [vocab[i] for i in ids]
    assert name(got[0])[1:4] == ["aaa", "Ġ", "aa"] and name(got[0])[4] == "aa" and got[3] == [1, 2] and 2 not in got
    assert name(got[1])[1] == "the" and "Ġthe" in name(got[1])
    counts = {r.doc_id: r.n_tokens for r in bpe_encode.count_documents(docs(spark), model).collect()}
    assert counts == {k: len(v) - 2 for k, v in got.items()}
    table = spark.createDataFrame(list(enumerate(vocab)), "token_id int, token string")
    plain = bpe_encode.encode_documents(docs(spark), model)
    assert {r.doc_id: r.text for r in bpe_encode.decode(plain, table).collect()} == {k: t for k, t in enumerate(TEXTS) if t is not None}
    words = docs(spark).where("text is not null").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    native = {r.word: r.n for r in bpe_encode.merged_natively(words, list(model[1])).select("word", bpe_encode.n_symbols(F.col("symbols")).alias("n")).collect()}
    assert native == {w: len(x) for w, x in zip(native, bpe_encode.PieceCounter(model).piece_ids(list(native)), strict=True)}
    assert bpe_encode.encode_documents(docs(spark).limit(0), model).count() == 0


def test_unknown_symbols():
    some = tuple((c, k) for k, c in enumerate(["<unk>", *BYTE_ALPHABET[97:123]]))
    assert bpe_encode.PieceCounter((some, ())).piece_ids(["a1b"]) == [[1, 0, 2]]
    assert bpe_encode.PieceCounter((some[1:], ())).piece_ids(["a1b"]) == [[1, 2]]


def test_tokenizer_file(spark, tmp_path):
    vocab = bpe_train.assembled_vocabulary([("a", "b"), ("ab", "c")], ["<unk>"])
    path = str(tmp_path / "tokenizer.json")
    tokenizer_file.write_tokenizer(path, vocab, [("a", "b"), ("ab", "c")], ["<unk>"], "<unk>")
    v, m, unk = tokenizer_file.read_tokenizer(path)
    assert (v, m, unk) == ({t: k for k, t in enumerate(vocab)}, [("a", "b"), ("ab", "c")], "<unk>")
    from tokenizers import Tokenizer

    assert Tokenizer.from_file(path).encode("abc").tokens == ["abc"]
    whole = json.loads(open(path, encoding="utf-8").read())
    whole["model"] |= {"merges": [["a", "b"], ["a", "b"]], "unk_token": None}
    open(path, "w", encoding="utf-8").write(json.dumps(whole))
    assert tokenizer_file.read_tokenizer(path)[1:] == ([("a", "b")], None)
    tables = tokenizer_file.tokenizer_tables(spark, path)
    assert tables[0].count() == len(vocab) and tables[1].count() == 1
    assert tokenizer_file.special_tokens(" <bos>,,<eos>, <bos>") == ["<unk>", "<bos>", "<eos>"]
    assert tokenizer_file.special_id({"x": 3}, "x") == 3 and tokenizer_file.special_id({}, None) is None
    with pytest.raises(KeyError):
        tokenizer_file.special_id({}, "x")


def test_driver_training_takes_every_counted_word(spark, tmp_path):
    from corpuscraft.plans import catalogue

    common, late = [f"{k:05x}" for k in range(200_000)], [f"zq{k}" for k in range(3000)]
    texts = [*[" ".join(common)] * 6, *[" ".join(late)] * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.left, r.right): r.freq for r in catalogue.bpe_train_driver(spark, str(tmp_path)).collect()}
    assert found["z", "q"] == 15_000
