import random

import numpy as np

from corpuscraft.llm import repetition
from corpuscraft.llm.letters import LetterBatch

from .test_letters import plain


def covered(text, width):
    p, seen, marks = plain(text), {}, set()
    for i in range(len(p) - width + 1):
        w = p[i : i + width]
        if w in seen:
            marks.update(range(i, i + width))
        seen.setdefault(w, i)
    return len(marks)


def texts():
    rng = random.Random(3)
    out = [None, "", "...", "a" * 100, "ab " * 300]
    for _ in range(40):
        s = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 90))) for _ in range(8)]
        out.append(". ".join(rng.choice(s) if rng.random() < 0.5 else x for x in s))
    return out


def test_share_like_brute_force():
    t = texts()
    for width in (16, 40):
        assert repetition.repeated_letters(LetterBatch(t), width).tolist() == [covered(x, width) for x in t]


def test_chinese_takes_shorter_stretches():
    once = "今天下午我们在石桥下面的集市摊位旁边喝茶"
    m = repetition.measured([once + "。然后。" + once, once])
    assert m["share"][0] > 0.45 and m["share"][1] == 0


def test_votes_find_the_two_classes():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.1
    accuracy = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(5000) < 0.3, -1, np.where(rng.random(5000) < a, truth, ~truth)) for a in accuracy], axis=1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = repetition.fit_votes(patterns, counts.astype(float))[back.ravel()]
    assert ((p > 0.5) == truth).mean() > 0.95
    assert ((p >= 0) & (p <= 1)).all()


def test_operator(spark):
    t = texts()
    df = spark.createDataFrame([(k, x, 0.5, 1) for k, x in enumerate(t)] + [(3, t[3], 0.5, 1)], "doc_id bigint, text string, share double, letters int")
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    assert all(abs(got[k].share - covered(x, 40) / max(1, len(plain(x)))) < 1e-9 for k, x in enumerate(t))
    assert got[3].posterior > 0.5 and got[4].posterior > 0.5 and got[0].share == 0 and got[0].posterior < 0.5
    assert repetition.repetition(df.limit(0)).count() == 0


def test_found_by_posterior_and_confirmed_by_the_share(spark, tmp_path, monkeypatch):
    t = texts()
    spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id for r in repetition.p5_found(spark, str(tmp_path)).collect()}
    assert found == {k for k, x in enumerate(t) if covered(x, 40) >= repetition.SHARE * max(1, len(plain(x)))} and found
    monkeypatch.setattr(repetition, "fit_votes", lambda patterns, *_: np.zeros(len(patterns)))
    assert repetition.p5_found(spark, str(tmp_path)).count() == 0  # the votes decide
