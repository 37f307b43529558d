import random

from corpuscraft.llm import tokens
from corpuscraft.operators.bpe_encode import load_model


def tables(spark):
    folder = "/root/testdata/sf0.001"
    return load_model(spark.read.parquet(f"{folder}/vocab.parquet"), spark.read.parquet(f"{folder}/merges.parquet"))


def slow_count(model, text):
    """Lowest rank first, piece by piece."""
    import re

    from corpuscraft.functions.text import BYTE_ALPHABET, PIECE_PATTERN

    rank = {p: k for k, p in enumerate(model[1])}
    n = 0
    for piece in re.findall(PIECE_PATTERN, text):
        s = [BYTE_ALPHABET[b] for b in piece.encode()]
        while True:
            best = min((rank.get(p, 1 << 30) for p in zip(s, s[1:], strict=False)), default=1 << 30)
            if best == 1 << 30:
                break
            a, b = model[1][best]
            new, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    new.append(a + b)
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            s = new
        n += len(s)
    return n


def test_counts_and_audit(spark):
    model = tables(spark)
    texts = [None, "", "  ", "The bakery orders of the evening shift.", "陶柯旁边的课堂讲义", "a  b ", "été  \n x", "The bakery orders of the evening shift.", "word " * 3000]
    rows = [(k, t, 1 if k < 4 else 2 if k < 7 else None, "zh" if k % 2 else "junk", "s", None, -1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard_id bigint, lang string, source string, content_domain string, tokens int")
    want = [None if t is None else slow_count(model, t) for t in texts]
    got = {r.doc_id: r for r in tokens.token_counts(docs, model, {"doc_id": docs["doc_id"]}).collect()}
    assert [got[k].tokens for k in range(len(texts))] == want
    assert [got[k].blank for k in range(4)] == [True, True, True, False]
    codes = spark.createDataFrame([("ZH ", "zh"), ("English", "en")], "alias string, lang string")
    budget = {r.language: r for r in tokens.token_budget(docs, model, codes).collect()}
    assert budget["zh"].tokens + budget["und"].tokens == sum(w or 0 for w in want)
    true = [want[3] + 1, sum(want[4:7]) + 3]
    shards = [(1, true[0], 1), (1, 10**6, 0), (2, true[1] * 2, 3), (3, None, 1), (4, 0, 1)]
    table = spark.createDataFrame(shards, "shard_id bigint, num_tokens bigint, written_at int")
    audit = {r.shard_id: r for r in tokens.shard_audit(docs, model, table).collect()}
    assert (audit[1].counted, audit[2].counted) == tuple(true)
    assert {k for k, r in audit.items() if r.wrong} == {2, 3}
    assert tokens.token_counts(docs.limit(0), model, {"source": docs["source"]}).count() == 0


def brute_pack(sizes, capacity, most):
    """Best fit over a list of open bins, without a bitset."""
    bins, closed = [], 0
    for size in sizes:
        fit = [b for b in bins if b >= size]
        if fit:
            bins.remove(min(fit))
            left = min(fit) - size
        else:
            if len(bins) >= most:
                bins.remove(min(bins))
                closed += 1
            left = capacity - size
        if left:
            bins.append(left)
        else:
            closed += 1
    return closed + len(bins)


def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 100, 700, 2048, 2049, 5000, rng.randint(1, 2048)]) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(sizes), (900, None), (None, 5)], "doc_id bigint, size bigint")
    rows = tokens.pack(df, most=5).collect()
    used: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        used.setdefault(r.container, []).append((r.offset, r.offset + r.size))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= tokens.CAPACITY
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    per: dict[int, int] = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.size
    assert per == {k: s for k, s in enumerate(sizes) if s}
    assert {r.doc_id for r in rows if r.part > 0} == {k for k, s in enumerate(sizes) if s > tokens.CAPACITY}
    pieces = [p for s in sizes if s for p in [tokens.CAPACITY] * (s // tokens.CAPACITY) + ([s % tokens.CAPACITY] if s % tokens.CAPACITY else [])]
    assert len(used) == brute_pack(pieces, tokens.CAPACITY, 5)
    assert tokens.pack(df.limit(0)).count() == 0
