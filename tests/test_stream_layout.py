import pytest
from pyspark.sql import functions as F

from corpuscraft.functions import metrics
from corpuscraft.operators import resume, shards
from corpuscraft.sources.shard_files import read_manifest, read_shards, token_dtype, write_manifest, write_shards
from corpuscraft.streaming import counts


def sizes(spark, n=(5, 0, 17, 3, 10, 1)):
    return spark.createDataFrame(list(enumerate(n)), "doc_id bigint, n bigint")


@pytest.mark.parametrize("most", [1, 4, 6, 36, 100])
def test_shards(spark, most):
    placed = shards.offsets(sizes(spark))
    parts = shards.shard_parts(placed, most).collect()
    per: dict[int, int] = {}
    for r in parts:
        per[r.shard_id] = per.get(r.shard_id, 0) + r.size
        assert r.size > 0 and r.begin >= r.shard_id * most
    assert sum(per.values()) == 36 and all(v == most for k, v in per.items() if k < max(per))
    named = shards.manifest(shards.shard_parts(placed, most)).orderBy("shard_id").first()
    assert named.file == "train_000000.bin" and named.num_tokens == min(most, 36)
    assert shards.manifest(shards.shard_parts(shards.offsets(sizes(spark, ())), most)).count() == 0


@pytest.mark.parametrize(("length", "stride", "total"), [(4, 4, 23), (4, 5, 23), (4, 4, 5), (4, 4, 4), (4, 4, 0), (7, 7, 50), (7, 8, 64)])
def test_windows(spark, length, stride, total):
    tokens = [100 + k for k in range(total)]
    df = spark.createDataFrame(list(enumerate(tokens)), "pos bigint, id bigint")
    got = [(r.seq_id, r.x, r.y) for r in shards.windows(df, length, stride, total).orderBy("seq_id").collect()]
    true = [tokens[i : i + length + 1] for i in range(0, total, stride) if i + length + 1 <= total]
    assert got == [(k, w[:-1], w[1:]) for k, w in enumerate(true)]
    if stride == length:
        assert len(got) == max(0, (total - 1) // length)


def test_split_and_allocation(spark):
    df = spark.createDataFrame([(k, 100 if k else 5) for k in range(10)], "shard_id bigint, num_tokens bigint")
    got = shards.split_shards(df, 0.25, 10).orderBy("shard_id").collect()
    assert [r.part for r in got] == ["train"] * 8 + ["val"] * 2 and [r.usable for r in got] == [False] + [True] * 9
    assert {r.part for r in shards.split_shards(df, 0.0, 10).collect()} == {"train"}
    assert {r.part for r in shards.split_shards(df.limit(1), 0.5, 10).collect()} == {"train"}
    picks = shards.allocate(df, 10, 20).orderBy("shard_id").collect()
    assert [r.picks for r in picks] == [3, 3] + [2] * 7 and sum(r.weight for r in picks) == pytest.approx(1)
    a, b = (shards.weighted_sample(shards.allocate(df, 10, 20), "weight", 3, 5).collect() for _ in range(2))
    assert a == b and len({r.shard_id for r in a}) == 3


def test_files_round_trip(spark, tmp_path):
    ids = [list(range(k * 10, k * 10 + k)) for k in range(7)]
    coded = spark.createDataFrame([(k, v, len(v)) for k, v in enumerate(ids)], "doc_id bigint, ids array<int>, n bigint")
    placed = shards.offsets(coded.select("doc_id", "n"))
    parts = shards.shard_parts(placed, 8).join(placed, "doc_id").join(coded, "doc_id")
    cut = parts.select("shard_id", "begin", F.slice("ids", (F.col("begin") - F.col("start") + 1).cast("int"), F.col("size").cast("int")).alias("ids"))
    out = str(tmp_path / "shards")
    written = {r.shard_id: r.num_tokens for r in write_shards(cut, out, "uint16").collect()}
    assert written == {0: 8, 1: 8, 2: 5}
    back = [t for r in read_shards(spark, out, "uint16").orderBy("file", "begin").collect() for t in r.tokens]
    assert back == [t for v in ids for t in v]
    write_manifest(str(tmp_path / "meta.json"), [(f"train_{k:06d}.bin", n) for k, n in written.items()], dtype="uint16")
    assert [(r.num_tokens, r.dtype) for r in read_manifest(spark, str(tmp_path / "meta.json")).orderBy("file").collect()] == [(8, "uint16"), (8, "uint16"), (5, "uint16")]
    assert token_dtype(65535) == "uint16" and token_dtype(65536) == "uint32"
    with pytest.raises(Exception, match="fit"):
        write_shards(spark.createDataFrame([(0, 0, [70000])], "shard_id bigint, begin bigint, ids array<int>"), out, "uint16").collect()


def test_resume(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_path string, signature string")
    parts = spark.createDataFrame([("a", "1"), ("b", "x")], "source_path string, signature string")
    assert {r.source_path: r.action for r in resume.reuse_plan(files, parts).collect()} == {"a": "reuse", "b": "redo", "c": "new"}
    chunks = spark.range(5).toDF("chunk_id")
    assert {r.chunk_id for r in resume.missing_chunks(chunks, chunks.where("chunk_id < 3")).collect()} == {3, 4}
    row = resume.reconciled(sizes(spark), spark.createDataFrame([(36,)], "num_tokens bigint")).first()
    assert row.agree and row.part_tokens == 36


def test_catalog_and_losses(spark):
    names = ["ckpt_10.pt", "ckpt_2.pt", "ckpt_last.pt", "x.pt"]
    df = spark.createDataFrame([(n, "ckpt_10.pt" if n == "ckpt_last.pt" else n) for n in names], "name string, real_path string")
    assert [r.name for r in metrics.checkpoint_catalog(df, 9).orderBy("place").collect()] == ["ckpt_2.pt", "ckpt_10.pt", "x.pt"]
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 3), ("b", 50.0, 2)], "k string, loss double, n bigint")
    got = {r.k: r for r in metrics.weighted_loss(rows, "k", "loss", "n").collect()}
    assert got["a"].val_loss == 2.5 and got["b"].ppl == pytest.approx(2.718281828**30, rel=1e-6)
    assert metrics.best_row(rows, "loss", "k").first().k == "a"


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    texts = ["a b a", "b", None, "", "c a", "a"]
    for k, t in enumerate(texts):
        spark.createDataFrame([(t, "x" if k % 2 else "y")], "text string, lang string").coalesce(1).write.mode("append").parquet(f"{src}/t.parquet")
    stream = counts.stream_documents(spark, src, "t", files=2)
    counts.incremental_counts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.word: r.freq for r in counts.merged_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": 2, " b": 1, " a": 2, "b": 1, "c": 1}
    stats = {r.lang: r for r in counts.streamed_stats(stream, "lang", 1, 2, "stats_test", str(tmp_path / "state2")).collect()}
    assert stats["y"].skipped_missing == 1 and sum(r.docs_scanned for r in stats.values()) == 6


def test_carried_sequences(spark, tmp_path):
    src = str(tmp_path / "tok")
    cuts = [0, 3, 11, 12, 30]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame([(k, 500 + k) for k in range(a, b)], "pos bigint, id bigint").coalesce(1).write.mode("append").parquet(f"{src}/t.parquet")
    import os
    import time

    files = sorted((f for f in os.listdir(f"{src}/t.parquet") if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{src}/t.parquet/{f}"))
    for k, f in enumerate(files):  # a stream takes the oldest file first
        os.utime(f"{src}/t.parquet/{f}", (time.time() - 100 + k * 10,) * 2)
    counts.carried_sequences(counts.stream_documents(spark, src, "t", files=1), 4, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r.seq_id, r.x, r.y) for r in spark.read.parquet(f"{tmp_path}/out/sequences/batch=*").orderBy("seq_id").collect()]
    t = [500 + k for k in range(30)]
    assert got == [(k, t[4 * k : 4 * k + 4], t[4 * k + 1 : 4 * k + 5]) for k in range(7)]
