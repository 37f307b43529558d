"""tokenizer.json, vocab.json and merges.txt: writing, reading, and as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def tokenizer_dict(vocab: list[str], merges: list[tuple[str, str]], specials: list[str], unk: str | None) -> dict:
    added = [{"id": k, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, s in enumerate(specials)]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
    return {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level,
        "model": {
            "type": "BPE", "dropout": None, "unk_token": unk, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
            "vocab": {t: k for k, t in enumerate(vocab)}, "merges": [f"{a} {b}" for a, b in merges],
        },
    }


def write_tokenizer(path: str, vocab: list[str], merges: list[tuple[str, str]], specials: list[str], unk: str | None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(tokenizer_dict(vocab, merges, specials, unk), f, ensure_ascii=False)


def write_merges(path: str, merges: list[tuple[str, str]]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("#version: 0.2\n" + "".join(f"{a} {b}\n" for a, b in merges))


def read_tokenizer(path: str) -> tuple[dict[str, int], list[tuple[str, str]], str | None]:
    """Vocabulary (added tokens win), merges (strings or pairs; the first rule of a pair counts), unknown token or None."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    vocab = {**model["vocab"], **{t["content"]: t["id"] for t in whole.get("added_tokens") or []}}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return vocab, list(dict.fromkeys(merges)), model.get("unk_token")  # type: ignore[arg-type]


def tokenizer_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vocab(token_id, token)`` and ``merges(merge_rank, left_token, right_token)``."""
    vocab, merges, _ = read_tokenizer(path)
    return (
        spark.createDataFrame([(i, t) for t, i in vocab.items()], "token_id int, token string"),
        spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "merge_rank int, left_token string, right_token string"),
    )


def special_tokens(listed: str, unk: str = "<unk>") -> list[str]:
    """Specials of a comma-separated list without blanks and repeats; ``unk`` comes first if it is not listed."""
    names = list(dict.fromkeys(s.strip() for s in listed.split(",") if s.strip()))
    return names if unk in names or not unk else [unk, *names]


def special_id(vocab: dict[str, int], token: str | None) -> int | None:
    """Id of a special token; None for none; one that is missing raises."""
    if not token:
        return None
    if token not in vocab:
        raise KeyError(f"the vocabulary has no token {token!r}")
    return vocab[token]
