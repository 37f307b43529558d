import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscraft.functions import metrics
from corpuscraft.functions.text import BYTE_ALPHABET, PIECE_PATTERN, byte_level, byte_level_inverse, gpt2_pieces, pieces, truncated
from corpuscraft.operators import corpus
from corpuscraft.sources.text import candidates, documents, environment, matching

CASES = ["a  b ", "  ", "", "　你好 world! 123", "a᠎b", "a\x1cb", "a\x00b", "a\x85b c", "it's  we'll", "²３Ⅳ", "é", "x😀y", None]


def col(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_pieces(spark):
    got = {r.k: r.p for r in col(spark, CASES).select("k", pieces(F.col("t")).alias("p")).collect()}
    assert got[0] == ["a", "  b", " "] and got[1] == ["  "] and got[2] == [] and got[12] is None
    assert got[3] == ["　你好", " world!", " 123"]
    assert got[4] == ["a", "᠎b"] and got[5] == ["a\x1cb"] and got[7] == ["a", "\x85b", " c"]
    for k, t in enumerate(CASES[:-1]):
        assert "".join(got[k]) == t and got[k] == re.findall(PIECE_PATTERN, t)


def test_gpt2_pieces(spark):
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    got = {r.k: r.p for r in col(spark, CASES).select("k", gpt2_pieces(F.col("t")).alias("p")).collect()}
    for k, t in enumerate(CASES[:-1]):
        assert ["".join(BYTE_ALPHABET[b] for b in p.encode()) for p in got[k]] == [w for w, _ in split.pre_tokenize_str(t)]


def test_byte_alphabet():
    from tokenizers import pre_tokenizers

    assert len(set(BYTE_ALPHABET)) == 256 and set(BYTE_ALPHABET) == set(pre_tokenizers.ByteLevel.alphabet())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=20))
def test_byte_level_round_trip(spark, texts):
    rows = col(spark, texts).select("k", byte_level(F.col("t")).alias("w"), byte_level_inverse(byte_level(F.col("t"))).alias("back")).collect()
    for r in rows:
        assert r.w == "".join(BYTE_ALPHABET[b] for b in texts[r.k].encode()) and r.back == texts[r.k]


def test_emitted_and_stats(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "xy"), ("a", "éééé"), ("b", "x" * 9), (None, "abc")], "lang string, text string")
    assert sorted(r.text for r in corpus.emitted(df, 3, 4).collect()) == ["abc", "xxxx", "éééé"]
    s = {r.lang: r for r in corpus.stream_stats(df, "lang", 3, 4).collect()}
    assert (s["a"].docs_scanned, s["a"].docs_emitted, s["a"].skipped_missing, s["a"].skipped_short, s["a"].truncated_docs, s["a"].emitted_chars) == (4, 1, 1, 2, 0, 4)
    assert (s["b"].truncated_docs, s["b"].emitted_chars) == (1, 4)
    assert corpus.stream_stats(df, "lang", 1, 0).where("lang = 'b'").first().emitted_chars == 9
    assert df.select(truncated(F.col("text"), 0)).count() == 6 and corpus.emitted(df.limit(0), 1, 0).count() == 0


def test_json_guard(spark):
    lines = ['{"text":"a\\u00e9"}', '{"text":5}', '{"text":null}', '{"a":{"text":"x"}}', "[1]", "{", "", None, '{"text":{"b":1}}', '{"x":1,"text":"\\ud83d\\ude00"}', '{"text":"true"}']
    got = [r.t for r in col(spark, lines).orderBy("k").select(corpus.json_text(F.col("t")).alias("t")).collect()]
    assert got == ["aé", None, None, None, None, None, None, None, None, "😀", "true"]


@pytest.mark.parametrize("most", [1000, 40, 2])
def test_ordinal(spark, most, monkeypatch):
    monkeypatch.setattr(corpus, "RANGE_ROWS", most)
    df = spark.createDataFrame([(k * 7 % 101, k % 5, k % 3) for k in range(101)], "k bigint, n bigint, g int")
    got = sorted((r.k, r.row, r.before) for r in corpus.ordinal(corpus.ordinal(df, "k", "row"), "k", "before", F.col("n")).collect())
    n = {r.k: r.n for r in df.collect()}
    assert [(k, row) for k, row, _ in got] == [(k, k) for k in range(101)]
    assert all(b == sum(n[j] for j in range(k)) for k, _, b in got)
    group = {r.k: r.g for r in df.collect()}
    for r in corpus.ordinal(df, "k", "before", F.col("n"), by=("g",)).collect():
        assert r.before == sum(n[j] for j in range(r.k) if group[j] == r.g)
    assert corpus.ordinal(df.limit(0), "k", "row").count() == 0


def test_formulas(spark):
    lr = [r[0] for r in spark.createDataFrame([(0,), (9,), (10,), (60,), (110,), (200,)], "i int").orderBy("i").select(metrics.learning_rate(F.col("i"), 1.0, 0.1, 10, 110)).collect()]
    assert lr == pytest.approx([0.1, 1.0, 1.0, 0.55, 0.1, 0.1])
    t = [tuple(r) for r in spark.createDataFrame([(0,), (3661,), (-1,), (None,), (360000,)], "s bigint").select(metrics.duration(F.col("s")), metrics.byte_size(F.col("s"))).collect()]
    assert [a for a, _ in t] == ["00:00:00", "01:01:01", "--:--:--", "--:--:--", "100:00:00"]
    assert t[1][1] == "3.58 KB" and t[4][1] == "351.56 KB"
    n = spark.range(1).select(metrics.parameter_count(F.lit(14), F.lit(640), F.lit(50000), F.lit(2048))).first()[0]
    assert n == 102_142_080


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.json").write_bytes(b'{"text":"one"}\r\n\n{"text":"t\xc3\xa9"}\n{"text":7}\n{"te')
    with gzip.open(tmp_path / "c.json.gz", "wb") as f:
        f.write(b'{"text":"two\xff"}\n{"text":""}\n')
    assert [p.rpartition("/")[2] for p in matching(f"{tmp_path}/*.json")] == ["b.json"]
    assert candidates(f"{tmp_path}/c.json") == [f"{tmp_path}/c.json.gz"]
    assert matching(f"{tmp_path}/nothing") == [] and matching(f"{tmp_path}/?/b.json")
    got = sorted(r.text for r in documents(spark, [f"{tmp_path}/a/b.json", f"{tmp_path}/c.json.gz"]).collect())
    assert got == ["one", "two�", "té"]
    (tmp_path / ".env").write_text('﻿A=1\n# c\nB = "x y"\nbad\nexport C=\'z\'\n', encoding="utf-8")
    assert environment(f"{tmp_path}/.env") == {"A": "1", "B": "x y", "C": "z"}
    assert environment(f"{tmp_path}/none") == {}


def test_settings(tmp_path):
    from corpuscraft.config import settings as read

    (tmp_path / ".env").write_text("MIN_CHARS=7\nMAX_CHARS=9\nOTHER=1\n")
    got = read(["--max-chars", "50"], str(tmp_path / ".env"))
    assert (got.min_chars, got.max_chars, got.seed) == (7, 50, 42)
