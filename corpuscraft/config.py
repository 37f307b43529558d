"""Settings: defaults, an environment file, then the command line; the later wins."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, fields

from .sources.text import environment


@dataclass(frozen=True)
class Settings:
    data: str = ""
    text_field: str = "text"
    min_chars: int = 1
    max_chars: int = 20000
    max_docs: int = 0
    vocab_size: int = 50000
    min_freq: int = 2
    min_pair_freq: int = 2
    top_k: int = 0
    chunk_files: int = 1
    special_tokens: str = "<unk>,<bos>,<eos>"
    mode: str = "whitespace"
    max_tokens_per_shard: int = 50_000_000
    seq_len: int = 2048
    val_ratio: float = 0.01
    seed: int = 42
    max_sequences: int = 0
    out: str = ""


def truth(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def settings(arguments: Sequence[str] = (), env: str = "") -> Settings:
    """Settings from ``--name value`` arguments over ``NAME=value`` lines of ``env`` over the defaults."""
    parser = argparse.ArgumentParser(description="Corpus and token pipeline")
    for f in fields(Settings):
        parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=None)
    said = {k: v for k, v in vars(parser.parse_args(list(arguments))).items() if v is not None}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    filed = {k.lower(): kinds[k.lower()](v) for k, v in (environment(env) if env else {}).items() if k.lower() in kinds}
    return Settings(**{**filed, **said})
