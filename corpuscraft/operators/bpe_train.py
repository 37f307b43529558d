"""Byte-level BPE training: a relational form, one aggregation a merge, and a driver loop over counted words."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BYTE_ALPHABET, byte_level
from ..session import scratch
from .bpe_encode import merged_natively

DRIVER_WORDS = 1_000_000  # distinct words up to which the driver merges
KEEP = 16  # merges after which rewritten words are written


def best_pair(rows: DataFrame) -> tuple[str, str, int] | None:
    """The most frequent adjacent pair of ``symbols, freq`` (ties: least left, then right); one row reaches the driver."""
    s = F.split(F.regexp_replace("symbols", "^\x02|\x03$", ""), "\x03\x02")
    rows = rows.select(s.alias("s"), "freq").where(F.size("s") > 1)
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("l"), F.slice("s", F.lit(2), F.size("s") - 1).alias("r"))
    best = rows.select(F.explode(pairs).alias("p"), "freq").groupBy("p.l", "p.r").agg(F.sum("freq").alias("n")).orderBy(F.desc("n"), "l", "r").first()
    return (best.l, best.r, best.n) if best else None


def train_relational(counted: DataFrame, merges: int, least: int = 1) -> list[tuple[str, str, int]]:
    """Merges of ``raw, freq`` (words as text), each from one distributed aggregation over the words as they stand; nothing but
    the best pair of each reaches the driver. Words rewritten by ``KEEP`` merges are written as a table."""
    rows = merged_natively(counted, merges=[], word="raw").select("symbols", "freq")
    out: list[tuple[str, str, int]] = []
    while len(out) < merges:
        found = best_pair(rows)
        if found is None or found[2] < max(1, least):
            break
        out.append(found)
        a, b, _ = found
        rows = rows.withColumn("symbols", F.replace("symbols", F.lit(f"\x02{a}\x03\x02{b}\x03"), F.lit(f"\x02{a}{b}\x03")))
        if len(out) % KEEP == 0 and len(out) < merges:
            rows = scratch(rows, "symbols")
    return out


def train(counted: DataFrame, merges: int, least: int = 1) -> list[tuple[str, str, int]]:
    """Merges of ``raw, freq``: by the driver's loop where there are at most ``DRIVER_WORDS`` words (about half a GB there), by
    ``train_relational`` beyond; both give the same merges."""
    counted = scratch(counted, "counted")
    if counted.count() > DRIVER_WORDS:
        return train_relational(counted, merges, least)
    return train_on_driver([(r.word, r.freq) for r in counted.select(byte_level(F.col("raw")).alias("word"), "freq").toLocalIterator()], merges, least)


def train_on_driver(words: list[tuple[str, int]], merges: int, least: int = 1) -> list[tuple[str, str, int]]:
    """Merges of counted byte-level words, with an inverted index from pairs to words and a lazy heap.

    Counts of the pairs around each rewritten word are kept exact; a heap entry counts only if it is still the pair's
    count. Ties go to the least left, then right symbol, in binary order of UTF-8.
    """
    symbols = [list(w) for w, _ in words]
    freq = [f for _, f in words]
    count: Counter[tuple[str, str]] = Counter()
    where: defaultdict[tuple[str, str], set[int]] = defaultdict(set)
    for k, s in enumerate(symbols):
        for p in zip(s, s[1:], strict=False):
            count[p] += freq[k]
            where[p].add(k)
    rank = lambda p: (-count[p], p[0].encode(), p[1].encode(), p)
    heap = [rank(p) for p in count]
    heapq.heapify(heap)
    out: list[tuple[str, str, int]] = []
    while len(out) < merges and heap:
        negative, _, _, pair = heapq.heappop(heap)
        n = count.get(pair, 0)
        if n != -negative:
            if n > 0 and -negative > n:
                heapq.heappush(heap, rank(pair))
            continue
        if n < max(1, least):
            break
        out.append((*pair, n))
        joined = pair[0] + pair[1]
        touched = set()
        for k in where.pop(pair, ()):
            s = symbols[k]
            new, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    new.append(joined)
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            if len(new) == len(s):
                continue
            for p in zip(s, s[1:], strict=False):
                count[p] -= freq[k]
                touched.add(p)
            for p in zip(new, new[1:], strict=False):
                count[p] += freq[k]
                where[p].add(k)
                touched.add(p)
            symbols[k] = new
        for p in touched:
            if count[p] > 0:
                heapq.heappush(heap, rank(p))
            else:
                count.pop(p, None)
    return out


def target_merges(vocab_size: int, specials: int) -> int:
    """Merges that a vocabulary has room for; 256 symbols and the specials come first."""
    return max(256, vocab_size - specials) - 256


def assembled_vocabulary(merges: list[tuple[str, str]], specials: list[str]) -> list[str]:
    """Specials, the 256 byte symbols in byte order, merged symbols; each string once, at its first place."""
    return list(dict.fromkeys([*specials, *BYTE_ALPHABET, *(a + b for a, b in merges)]))
