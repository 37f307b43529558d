import random
from collections import Counter

import numpy as np
import pandas as pd

from corpuscraft.llm import language, reading
from corpuscraft.llm.boosting import Boosted, Isotonic

from .test_letters import plain

FOLDER = "/root/testdata/sf0.01"


def test_code_lengths_like_a_plain_implementation():
    samples = {"x": ["abracadabra abra", "cad"], "y": ["banana band", "ban"]}
    trees = language.ContextTrees(samples)
    counts = {k: [{} for _ in range(language.ORDER + 1)] for k in samples}
    for k, texts in samples.items():
        data = b"".join(language._START + t.encode() for t in texts)
        for i in range(language.ORDER, len(data)):
            for o in range(language.ORDER + 1):
                c = counts[k][o].setdefault(data[i - o : i], {})
                c[data[i]] = c.get(data[i], 0) + 1

    def bits(k, data):
        total = 0.0
        for i in range(language.ORDER, len(data)):
            for o in range(language.ORDER, -1, -1):
                c = counts[k][o].get(data[i - o : i])
                if not c:
                    continue
                n = sum(c.values()) + len(c)
                if data[i] in c:
                    total -= np.log2(c[data[i]] / n)
                    break
                total -= np.log2(len(c) / n)
            else:
                total += 8
        return total

    for text in ("abra", "banana", "zebra band", "q"):
        data = language._START + text.encode()
        got = trees.bits(np.frombuffer(data, dtype=np.uint8), np.array([0]))[:, 0]
        assert np.allclose(got, [bits(k, data) for k in trees.languages], atol=1e-3)


def test_path_like_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    bits = rng.integers(0, 40, (3, 11)).astype(float)
    owner = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2, 2, 4])
    got = language.path(bits, owner)

    def cost(p, at):
        return sum(bits[l, k] for l, k in zip(p, at, strict=True)) + language.SWITCH * sum(a != b for a, b in itertools.pairwise(p))

    for t in set(owner):
        at = np.nonzero(owner == t)[0]
        least = min(cost(p, at) for p in itertools.product(range(3), repeat=len(at)))
        assert abs(cost(got[at], at) - least) < 1e-9


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    codes = spark.read.parquet(f"{FOLDER}/lang_codes.parquet")
    trees = language.sample_trees(docs, codes)
    test = spark.read.parquet(f"{FOLDER}/eval_items.parquet").where("language is not null and length(text) > 60")
    said = {r.doc_id: r.language for r in language.document_languages(test.drop("language"), trees, "item_id").collect()}
    true = {r.item_id: r.language for r in test.collect()}
    assert np.mean([said[k] == v for k, v in true.items()]) > 0.95
    mixed = spark.createDataFrame([(1, "Die Fahrkarten liegen neben der alten Bank am Hafen. The old dictionaries are near the school under the bridge. " * 3), (2, None), (3, ""), (4, "123 ...")], "doc_id bigint, text string")
    cut = language.segments(mixed, "doc_id", trees).collect()
    assert {r.language for r in cut} == {"de", "en"} and len(cut) == 6 and {r.id for r in cut} == {1}
    assert all(cut[k].first + cut[k].size == cut[k + 1].first for k in range(5))
    rows = {r.doc_id: r for r in language.document_languages(mixed, trees).collect()}
    assert rows[2].language is None and rows[2].confidence == 0 and rows[4].language is None


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text " * 50, None, "s")], "doc_id bigint, text string, lang string, source string")
    codes = spark.read.parquet(f"{FOLDER}/lang_codes.parquet")
    assert language.document_languages(docs, language.sample_trees(docs, codes)).first().language is None
    labels = spark.createDataFrame([(1, "r", None)], "doc_id bigint, rater string, reading_level int")
    assert reading.reading_levels(docs, reading.fit(docs, labels)).count() == 0


def test_boosting():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4))
    y = np.where(x[:, 0] > 0.5, 3.0, 1.0) + x[:, 1]
    model = Boosted().fit(x[:400], y[:400])
    assert np.sqrt(((model.predict(x[400:]) - y[400:]) ** 2).mean()) < 0.2
    assert np.allclose(Boosted().fit(x[:3], y[:3]).predict(x[:2]), y[:3].mean())
    level = Isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert np.allclose(level(np.array([0, 2.5, 9])), [1, 2.5, 4])


def test_reading_levels_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_labels.parquet")
    model = reading.fit(docs, labels)
    held = model.calibrated(model.held)
    sure = np.isin(model.level, (1, 3, 5))
    assert (np.abs(held - model.level)[sure] < 1).mean() > 0.95
    rng = random.Random(1)
    few = spark.createDataFrame([(1, "See the cat. I run. " * 10, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny", "x"), (None, "a" * 100, "x"), (5, "".join(rng.choice("abc d") for _ in range(200000)), "x")], "doc_id bigint, text string, level string")
    got = {r.doc_id: r.level for r in reading.reading_levels(few, model).collect()}
    assert set(got) == {1, 5} and got[1] < 2.5
    assert isinstance(pd.Series(list(got.values())).mean(), float)


def test_validation_covers_every_labelled_document(spark, monkeypatch):
    folder, made = "/root/testdata/sf0.01", reading.held_out
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_labels.parquet")
    monkeypatch.setattr(reading, "held_out", lambda d, l: made(d, l, 50))
    got = {r.source: r for r in reading.p10_validation(spark, folder).collect()}
    rated = docs.join(labels.where("reading_level is not null").select("doc_id").distinct(), "doc_id").where("text is not null").collect()
    want = Counter(r.source or "" for r in rated if len(plain(r.text)) >= reading.LEAST)
    assert {s: r.documents for s, r in got.items()} == want


def test_no_label_of_a_fold_reaches_its_own_predictions():
    rng = np.random.default_rng(2)
    n = 300
    fold, level = rng.integers(0, reading.FOLDS, n), rng.integers(1, 6, n).astype(float)
    texts = [" ".join(rng.choice(["short", "words", "go", "here", "extraordinarily", "consequential"], 30)) for _ in range(n)]
    source = [f"s{k}" for k in fold]
    names = {f"s{k}": k for k in range(reading.FOLDS)}
    batch = reading.LetterBatch(texts)
    slot, owner, _, _ = reading._stretches(batch)

    def held(level):
        count, total = np.zeros((reading.FOLDS, reading._SLOTS)), np.zeros((reading.FOLDS, reading._SLOTS))
        own, s = np.divmod(np.unique(owner * reading._SLOTS + slot), reading._SLOTS)
        np.add.at(count, (fold[own], s), 1)
        np.add.at(total, (fold[own], s), level[own] - 3)
        v = reading.Vocabulary(count, total)
        x = [reading.features(texts, [v.scores(j, k) for j in range(reading.FOLDS)], batch, fold) for k in range(reading.FOLDS)]
        return reading.nested(x, level, fold, names, v)(texts, source, batch)

    other = np.where(fold == 1, 6 - level, level)
    a, b = held(level), held(other)
    assert np.allclose(a[fold == 1], b[fold == 1]) and not np.allclose(a[fold != 1], b[fold != 1])
