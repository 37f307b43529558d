import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscraft import __main__ as cli
from corpuscraft.functions import metrics
from corpuscraft.operators import batches
from corpuscraft.operators.bpe_encode import PieceCounter
from corpuscraft.sources import records
from corpuscraft.sources.shard_files import listed_shards, read_manifest, read_shards, shard_files
from corpuscraft.sources.tokenizer_file import read_tokenizer, write_merges


def test_random_batch(spark):
    t = [500 + k for k in range(200)]
    df = spark.createDataFrame(list(enumerate(t)), "pos bigint, id bigint")
    starts = batches.random_starts(200, 16, 5, 3)
    cuts = [0, 1, 40, 41, 90, 200]
    runs = spark.createDataFrame([(a, t[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] + [(200, [])], "start bigint, ids array<bigint>")
    got = [(r.x, r.y) for r in batches.random_batch(runs, 200, 16, 5, 3).orderBy("seq_id").collect()]
    assert got == [(t[s : s + 16], t[s + 1 : s + 17]) for s in starts]
    assert batches.random_batch(runs, 10, 16, 5, 3).count() == 0
    assert batches.random_starts(10, 16, 5, 3) == []
    got = [r.x for r in batches.shard_windows(df, 7, 4, 3).orderBy("seq_id").collect()]
    assert got == [t[7 + 5 * k : 11 + 5 * k] for k in range(3)]


def test_orders(spark):
    df = spark.range(50).toDF("k")
    a, b = ([r.k for r in batches.permuted(df, "k", 1).collect()] for _ in range(2))
    assert a == b and sorted(a) == list(range(50)) and a != list(range(50))
    e = batches.epochs(df, "k", 2, 1)
    first, second = ([r.k for r in e.where(F.col("epoch") == k).orderBy("place").collect()] for k in (0, 1))
    assert sorted(first) == sorted(second) == list(range(50)) and first != second
    rows = batches.contiguous_batches(df.toDF("seq_id"), 16).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in rows] == [16, 16, 16, 2]
    with pytest.raises(ValueError, match="valid"):
        batches.valid_texts(spark.createDataFrame([(None,), ("",)], "text string"), 1, 5)


def test_records(spark, tmp_path):
    p = str(tmp_path / "r.meta")
    records.write_record(p, source_path="a=b", bos_id=None, n=3)
    assert records.read_record(p) == {"source_path": "a=b", "bos_id": "-1", "n": "3"}
    records.write_scores(str(tmp_path), [{"checkpoint": "b", "val_loss": 2.0, "x": 1}, {"checkpoint": "a", "val_loss": 1.0}, {"checkpoint": "c", "val_loss": 1.0}])
    assert json.load(open(tmp_path / "val_scores.json"))["best"]["checkpoint"] == "a"
    assert open(tmp_path / "val_scores.csv").readline().strip() == ",".join(records.SCORE_COLUMNS)
    stats = spark.createDataFrame([("en", 3), ("zh", 4)], "lang string, docs bigint")
    assert records.run_manifest(stats, seed=1)["global"] == {"docs": 7}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f").write_bytes(b"12345")
    assert records.folder_bytes([str(tmp_path / "sub"), str(tmp_path / "sub" / "."), str(tmp_path / "sub")]) == 5
    with pytest.raises(RuntimeError, match="budget"):
        records.within_budget([str(tmp_path / "sub")], 4)
    records.write_vocab(str(tmp_path / "vocab.json"), ["a", "b", "ab"])
    write_merges(str(tmp_path / "merges.txt"), [("a", "b")])
    records.rebuild_tokenizer(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"), str(tmp_path / "t.json"))
    assert read_tokenizer(str(tmp_path / "t.json")) == ({"a": 0, "b": 1, "ab": 2}, [("a", "b")], None)


def test_checkpoints(spark, tmp_path):
    for name in ("ckpt_10.pt", "ckpt_2.pt", "ckpt_x.pt", "notes.txt"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "ckpt_last.pt").symlink_to(tmp_path / "ckpt_10.pt")
    names = lambda **k: [r.name for r in metrics.checkpoint_files(spark, str(tmp_path), **k).orderBy("place").collect()]
    assert names() == ["ckpt_2.pt", "ckpt_10.pt", "ckpt_x.pt"] and names(last=False, most=1) == ["ckpt_2.pt"]
    header = json.dumps({"__metadata__": {"iter_num": "7", "kind": "a"}, "w": {"dtype": "F32"}}).encode()
    (tmp_path / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + b"\0" * 64)
    (tmp_path / "m.json").write_text(json.dumps({"iter_num": 5, "loss": 1.5}))
    assert records.checkpoint_meta(str(tmp_path / "m.safetensors")) == {"iter_num": "7", "kind": "a", "loss": "1.5"}
    assert records.checkpoint_meta(str(tmp_path / "ckpt_2.pt")) == {} and records.header_fields(str(tmp_path / "none")) == {}


def test_command_line(spark, tmp_path):
    with open(tmp_path / "c.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"text": f"the cat and the hat number {k % 7} are here"}) + "\n" for k in range(60))
    out = str(tmp_path / "out")
    common = ["--data", f"{tmp_path}/*.json", "--out", out, "--vocab-size", "300", "--max-tokens-per-shard", "100"]
    vocab = cli.train(spark, cli.settings(common))
    assert 259 < len(vocab) <= 300 and os.path.exists(f"{out}/merges.txt")
    total = cli.write_token_shards(spark, cli.settings(common))
    sizes = [r.num_tokens for r in read_manifest(spark, f"{out}/meta.json").orderBy("file").collect()]
    assert sum(sizes) == total and set(sizes[:-1]) == {100}
    ids = [t for r in read_shards(spark, out, "uint16").orderBy("file", "begin").collect() for t in r.tokens]
    assert len(ids) == total and ids[0] == vocab.index("<bos>") and ids[-1] == vocab.index("<eos>") and ids.count(vocab.index("<bos>")) == 60
    n = cli.write_sequences(spark, cli.settings([*common, "--seq-len", "50"]))
    x = spark.read.parquet(f"{out}/sequences").orderBy("seq_id").collect()
    assert n == len(x) == (total - 1) // 50 and [r.x for r in x] == [ids[50 * k : 50 * k + 50] for k in range(n)]
    assert cli.write_sequences(spark, cli.settings([*common, "--seq-len", "50", "--max-sequences", "3"])) == 3


def test_files_in_order(spark, tmp_path):
    """Shards of several files, plain and packed, equal those of one sequential run, byte for byte."""
    from tokenizers import Tokenizer

    texts = []
    sizes = {"c.json": 300, "a.json": 5, "b.json": 40}
    for name in sorted(sizes):
        with open(tmp_path / name, "w", encoding="utf-8") as f:
            for k in range(sizes[name]):
                texts.append(f"{name} line {k} <bos> don't  stop" + " x" * (k % 7))
                f.write(json.dumps({"text": texts[-1]}) + "\n\t\n")
    out = str(tmp_path / "out")
    for mode in ("whitespace", "gpt2"):
        common = ["--data", f"{tmp_path}/*.json", "--out", out, "--vocab-size", "320", "--max-tokens-per-shard", "1000", "--mode", mode, "--val-ratio", "0.2"]
        vocab = cli.train(spark, cli.settings(common))
        split = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits a file
        try:
            total = cli.write_token_shards(spark, cli.settings(common))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        encoder = PieceCounter(*_model(out), mode, ("<unk>", "<bos>", "<eos>"))
        want = [i for ids in encoder.ids(texts) for i in [vocab.index("<bos>"), *ids, vocab.index("<eos>")]]
        ids = [t for r in read_shards(spark, out, "uint16").orderBy("file", "begin").collect() for t in r.tokens]
        assert ids == want and len(ids) == total
        if mode == "gpt2":
            whole = Tokenizer.from_file(f"{out}/tokenizer.json")
            assert [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] == encoder.ids(texts)
            assert ids.count(vocab.index("<bos>")) == 2 * len(texts)
    held = json.load(open(f"{out}/meta.json", encoding="utf-8"))["val_shards"]
    shards = json.load(open(f"{out}/meta.json", encoding="utf-8"))["shards"]
    assert held == [s["file"] for s in shards][-len(held) :] and held
    listed = listed_shards(read_manifest(spark, f"{out}/meta.json"), shard_files(spark, f"file://{out}")).collect()
    assert len(listed) == len(shards) and all(r.whole for r in listed)


def _model(out):
    vocab, merges, _ = read_tokenizer(f"{out}/tokenizer.json")
    return ((tuple(vocab.items()), tuple(merges)),)
