import random

import numpy as np

from corpuscraft.llm import leaks


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_planted_passages(spark, monkeypatch):
    rng = random.Random(4)
    items = [words(rng, 30) for _ in range(6)]
    half = " ".join(items[1].split()[8:26])
    edited = items[2].upper().split()
    for k in (4, 12, 20):
        edited[k] = edited[k][:-1] + "z"
    third = " ".join(items[3].split()[:9])
    docs = {
        0: words(rng, 50) + " " + items[0] + " " + words(rng, 50), 1: words(rng, 10) + ". " + half + "! " + words(rng, 10), 2: "\n".join(edited), 3: third + " " + words(rng, 40),
        4: " ".join(x for pair in zip(items[4].split(), words(rng, 30).split(), strict=True) for x in pair), 5: words(rng, 400), 6: None, 7: "", 8: "x" * 50000 + items[5],
    }
    df = spark.createDataFrame([(k, t, 3) for k, t in docs.items()] + [(0, docs[0], 3)], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([*((100 + k, t, "b") for k, t in enumerate(items)), (200, None, "b"), (201, "", "b"), (202, "short", "b")], "item_id bigint, text string, benchmark_name string")
    want = {(100, 0), (101, 1), (102, 2), (105, 8)}
    assert {(r.item_id, r.doc_id) for r in leaks.leaked_items(df, it).collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_LETTERS", 150)  # several blocks of items
    assert {(r.item_id, r.doc_id) for r in leaks.leaked_items(df, it).collect()} == want
    assert leaks.leaked_items(df.limit(0), it).count() == 0
    assert leaks.leaked_items(df, it.limit(0)).count() == 0


def edited(rng, text, share):
    """About ``share`` of the letters replaced, left out or doubled, at random places."""
    out = []
    for c in text:
        if c != " " and rng.random() < share:
            out.append(rng.choice([rng.choice("abcdefghijklmnop"), "", c + rng.choice("abcdefghijklmnop")]))
        else:
            out.append(c)
    return "".join(out)


def recall(share, part, size=160, count=300, seed=12):
    """Share of the items found whose passage of ``part`` of the letters has edits in ``share`` of them."""
    from corpuscraft.llm.letters import LetterBatch

    rng = random.Random(seed)
    items = [words(rng, size // 5)[:size] for _ in range(count)]
    docs = [words(rng, 60) + " " + edited(rng, t[: int(len(t) * part)], share) + " " + words(rng, 60) for t in items]
    index, batch = leaks._Index(tuple(range(count)), tuple(items)), LetterBatch(docs)
    doc, item, diagonal = leaks.bands(index, batch)
    own = index.items.size[item]
    span, score = leaks.aligned_span(index.items.points, index.items.start[item], own, batch.points, batch.start[doc], batch.size[doc], diagonal)
    ok = (2 * span >= own) & (score >= (1 - 3 * leaks.MOST_EDITS) * span)
    found = set(zip(doc[ok].tolist(), item[ok].tolist(), strict=True))
    assert all(d == i for d, i in found)
    return len(found) / count


def test_recall_up_to_the_budget():
    for share in (0.02, leaks.EDITS, 0.1):
        assert recall(share, 0.6) >= 0.9
    assert recall(leaks.MOST_EDITS - 0.03, 0.8) >= 0.9
    assert recall(0.0, 0.52) == 1.0 and recall(0.0, 0.4) == 0.0


def test_hits_by_parts(monkeypatch):
    from corpuscraft.llm.letters import LetterBatch

    rng = random.Random(1)
    items = [words(rng, 30) for _ in range(5)]
    docs = [words(rng, 20) + items[k % 5] + words(rng, 5) + items[(k + 1) % 5] for k in range(12)]
    index, batch = leaks._Index(tuple(range(5)), tuple(items)), LetterBatch(docs)
    whole = sorted(zip(*(x.tolist() for x in leaks.bands(index, batch)), strict=True))
    monkeypatch.setattr(leaks, "MOST_HITS", 50)
    assert sorted(zip(*(x.tolist() for x in leaks.bands(index, batch)), strict=True)) == whole and whole


def slow_align(a, b):
    best = (0, 0)
    cell = {}
    for i in range(len(a)):
        for j in range(len(b)):
            options = [(1 if a[i] == b[j] else -2) + cell.get((i - 1, j - 1), (0, 0))[0], cell.get((i - 1, j), (0, 0))[0] - 2, cell.get((i, j - 1), (0, 0))[0] - 2]
            starts = [-cell[i - 1, j - 1][1] if cell.get((i - 1, j - 1), (0, 0))[0] > 0 else -i, -cell.get((i - 1, j), (0, 0))[1], -cell.get((i, j - 1), (0, 0))[1]]
            score, start = max(zip(options, starts, strict=True))
            cell[i, j] = (score, -start) if score > 0 else (0, 0)
            if score > best[0]:
                best = (score, i + 1 + start)
    return best


def test_alignment_like_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        a = [rng.randrange(4) for _ in range(rng.randint(5, 20))]
        b = [x for x in a if rng.random() < 0.9]
        b[rng.randrange(len(b)) :] += [rng.randrange(4) for _ in range(3)]
        one, two = np.array(a, np.uint32), np.array(b, np.uint32)
        z = np.zeros(1, np.int64)
        span, score = leaks.aligned_span(one, z, z + len(a), two, z, z + len(b), z - 10)
        assert (score[0], span[0]) == slow_align(a, b)
