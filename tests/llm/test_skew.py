"""A third of all rows is one text, one source and one key: results stay whole."""

import random

from corpuscraft.llm import charforms, duplicates, mixture, registry, repetition, splits, tokens

from .test_duplicates import corpus
from .test_tokens import tables

ROWS = 900


def rows():
    rng = random.Random(6)
    texts = corpus(31, 60)
    hot = texts[0]
    out = []
    for k in range(ROWS):
        t = hot if k % 3 == 0 else rng.choice(texts)
        out.append((k, k, k, t, rng.choice(["train", "test", "dev"]), "lanting_web" if k % 3 == 0 else f"s{k % 5}", "en", None, k % 7))
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, row_id bigint, line_id bigint, text string, split string, source string, lang string, content_domain string, shard_id bigint")


def test_copies(spark):
    df, data = frame(spark), rows()
    hot = [r[0] for r in data if r[3] == data[0][3]]
    assert len(hot) > duplicates.EXPAND
    pairs = {tuple(r) for r in duplicates.near_duplicate_pairs(df).collect()}
    assert {(hot[0], k) for k in hot[1:]} <= pairs
    groups = {r.doc_id: r for r in duplicates.near_duplicate_groups(df).collect()}
    assert len(groups) == ROWS and len({groups[k].class_id for k in hot}) == 1 and {groups[k].copies for k in hot} == {len(hot)}
    text = {}
    for r in data:
        text.setdefault(r[3], []).append(r[0])
    for same in text.values():
        if len(same) <= duplicates.EXPAND:
            assert {(a, b) for a in same for b in same if a < b} <= pairs


def test_cross_split_copies(spark):
    data = rows()
    found = {tuple(r) for r in splits.split_overlaps(frame(spark)).collect()}
    side = {r[1]: r[4] == "train" for r in data}
    assert all(side[a] != side[b] for a, b in found)
    hot = {r[1] for r in data if r[3] == data[0][3]}
    assert hot <= {x for p in found for x in p}  # each hot row stands in a pair
    report = splits.split_report(frame(spark)).collect()
    assert sum(r.rows for r in report) == ROWS and sum(r.overlapping for r in report) == len({x for p in found for x in p})


def test_sums(spark):
    df, model = frame(spark), tables(spark)
    n = {t: c for t, c in zip({r[3] for r in rows()}, tokens.counter(model).counts(list({r[3] for r in rows()})), strict=True)}
    codes = spark.createDataFrame([("en", "en")], "alias string, lang string")
    budget = tokens.token_budget(df, model, codes).collect()
    assert sum(r.tokens for r in budget) == sum(n[r[3]] for r in rows()) and sum(r.documents for r in budget) == ROWS
    packed = tokens.packed_documents(df, model).collect()
    assert sum(r.size for r in packed) == sum(n[r[3]] for r in rows())
    assert repetition.repetition(df).count() == ROWS


def test_hot_line(spark):
    lines = frame(spark).withColumn("text", charforms.F.concat("text", charforms.F.when(charforms.F.col("line_id") == 3, "​").otherwise("")))
    pairs = {tuple(r) for r in charforms.alike_lines(lines).collect()}
    assert (0, 3) in pairs and all(3 in p for p in pairs)


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert {f"p{n}_found" for n in range(1, 11)} <= set(registry.queries())
    assert callable(mixture.p7_found)


def test_sql(spark):
    """Queries with SQL equal it on the smallest tables."""
    import os

    import duckdb

    from tests.test_catalogue import FOLDER
    from tests.test_catalogue import rows as sorted_rows

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, FOLDER).toPandas(), c.sql(sql).df()
        assert sorted_rows(got) == sorted_rows(want), name
