"""Small records beside the data: vocabularies, part and run records, scores, checkpoint metadata, folder sizes."""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .tokenizer_file import write_tokenizer

# Fixed value: columns of a score row, in order.
SCORE_COLUMNS = ("checkpoint", "name", "iter_num", "val_loss", "ppl", "eval_rows", "eval_batch_size", "oom_retries", "eval_seconds")


def write_vocab(path: str, vocab: list[str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({t: k for k, t in enumerate(vocab)}, f, ensure_ascii=False)


def rebuild_tokenizer(vocab_path: str, merges_path: str, out: str, unk: str | None = None) -> None:
    """tokenizer.json from vocab.json and merges.txt; there are no added tokens then."""
    with open(vocab_path, encoding="utf-8") as f:
        ids = json.load(f)
    with open(merges_path, encoding="utf-8") as f:
        merges = [tuple(line.rstrip("\n").split(" ", 1)) for line in f if line.strip() and not line.startswith("#version")]
    write_tokenizer(out, sorted(ids, key=ids.get), merges, [], unk)  # type: ignore[arg-type]


def write_record(path: str, **fields: object) -> None:
    """``key=value`` lines; None as -1."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{k}={-1 if v is None else v}\n" for k, v in fields.items())


def read_record(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as f:
        return dict(line.rstrip("\n").split("=", 1) for line in f if "=" in line)


def run_manifest(stats: DataFrame, **fields: object) -> dict:
    """Run parameters with the statistics of each language (a few rows) and of all together."""
    rows = [r.asDict(recursive=True) for r in stats.collect()]
    numbers = [c for c, kind in stats.dtypes if kind in ("bigint", "int")]
    return {**fields, "runs": rows, "global": {c: sum(r[c] or 0 for r in rows) for c in numbers}}


def write_scores(folder: str, rows: Iterable[dict]) -> None:
    """val_scores.csv with fixed columns and val_scores.json with the best (least loss, first of equals)."""
    rows = list(rows)
    with open(os.path.join(folder, "val_scores.csv"), "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, SCORE_COLUMNS, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)
    with open(os.path.join(folder, "val_scores.json"), "w", encoding="utf-8") as f:
        json.dump({"scores": rows, "best": min(rows, key=lambda r: r["val_loss"]) if rows else None}, f, ensure_ascii=False, indent=2)


def header_fields(path: str) -> dict[str, str]:
    """The text fields in the header of a tensor file: eight bytes of length, then JSON with ``__metadata__``. Nothing else of
    the file is read; a file without such a header has none."""
    try:
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            whole = json.loads(f.read(size)) if 0 < size <= 100_000_000 else {}
    except (OSError, ValueError):
        return {}
    fields = whole.get("__metadata__") if isinstance(whole, dict) else None
    return {k: str(v) for k, v in fields.items()} if isinstance(fields, dict) else {}


def checkpoint_meta(path: str) -> dict[str, str]:
    """Fields of a checkpoint: those of the record beside it (same name, ending ``.json``), over which its header wins."""
    beside = os.path.splitext(path)[0] + ".json"
    fields: dict[str, str] = {}
    if os.path.exists(beside):
        with open(beside, encoding="utf-8") as f:
            said = json.load(f)
        fields = {k: v if isinstance(v, str) else json.dumps(v) for k, v in said.items()} if isinstance(said, dict) else {}
    return fields | header_fields(path)


def folder_bytes(roots: Iterable[str]) -> int:
    """Bytes of all files below some folders; a folder inside another counts once."""
    whole = sorted({os.path.realpath(r) for r in roots})
    outer = [r for k, r in enumerate(whole) if not any(r.startswith(o.rstrip("/") + "/") for o in whole[:k])]
    return sum(os.path.getsize(os.path.join(d, f)) for r in outer for d, _, names in os.walk(r) for f in names if os.path.exists(os.path.join(d, f)))


def within_budget(roots: Iterable[str], most_bytes: int) -> int:
    """The bytes of the folders; more than ``most_bytes`` raise."""
    used = folder_bytes(roots)
    if used > most_bytes:
        raise RuntimeError(f"the folders take {used} bytes; the budget is {most_bytes}")
    return used
