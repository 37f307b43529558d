"""Letters: the comparable form of a text, for whole batches at once.

Every operator that compares texts works on *letters*: the letters and digits
left after the text is composed, folded in case, full-width and other
compatibility forms are replaced, and look-alike characters of other scripts
are mapped to one representative. Blanks, punctuation, marks that compose with
nothing and invisible characters vanish.

``LetterBatch`` turns a list of texts into one flat array of code points with
offsets, so that shingles of millions of letters are hashed by a handful of
numpy calls. A ``None`` text has no letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

# Lower-case letters of the Cyrillic and Greek scripts that look
# like a Latin letter in at least one case.
LOOKALIKE_LOWER = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "y", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i",
}

#: Letters held by one round of work; bounds a Python worker's memory.
ROUND_CHARS = 1_000_000

_U = np.uint64


def _fold(ch: str) -> str:
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", ch).casefold())
    return "".join(LOOKALIKE_LOWER.get(c, c) for c in out if c.isalnum())


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first[cp], count[cp] and the further characters of the few long expansions."""
    first = np.arange(0x110000, dtype=np.uint32)
    count = np.ones(0x110000, dtype=np.uint8)
    more: dict[int, str] = {}
    plain = [range(0x3400, 0x4DC0), range(0x4E00, 0xA000), range(0xAC00, 0xD7A4), range(0xE000, 0xF900)]
    skip = np.zeros(0x110000, dtype=bool)
    for r in plain:
        skip[r.start : r.stop] = True
    count[0xE000:0xF900] = 0  # private use
    count[0xD800:0xE000] = 0
    todo = [c for c in range(0x10000) if not skip[c] and not 0xD800 <= c < 0xE000]
    todo += [*range(0x10400, 0x10450), *range(0x1D400, 0x1D800), *range(0x1F000, 0x1FB00), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
    for c in todo:
        out = _fold(chr(c))
        count[c] = min(len(out), 255)
        if out:
            first[c] = ord(out[0])
        if len(out) > 1:
            more[c] = out
    keys = np.array(sorted(more), dtype=np.uint32)
    tail = np.zeros((len(keys), 18), dtype=np.uint32)
    for k, c in enumerate(keys):
        tail[k, : len(more[int(c)])] = [ord(x) for x in more[int(c)]]
    return first, count, np.concatenate([keys[:, None], tail], axis=1)


def fold_points(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of code points, and the owner of each letter."""
    first, count, more = _tables()
    n = count[points]
    if n.size and n.max() <= 1:
        keep = n > 0
        return first[points[keep]], owner[keep]
    where = np.repeat(np.arange(len(points)), n)
    out = first[points[where]]
    starts = np.cumsum(n.astype(np.int64)) - n
    step = np.arange(len(where)) - starts[where]
    late = np.nonzero(step > 0)[0]
    if late.size:
        row = np.searchsorted(more[:, 0], points[where[late]])
        out[late] = more[row, 1 + step[late]]
    return out, owner[where]


class LetterBatch:
    """Letters of some texts: ``points`` (uint32), ``owner`` (index of the text of each), ``start`` (offsets)."""

    def __init__(self, texts: list[str | None]) -> None:
        whole = [t if t is not None else "" for t in texts]
        whole = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in whole]
        sizes = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        points = np.frombuffer("".join(whole).encode("utf-32-le", "replace"), dtype=np.uint32)
        self.points, self.owner = fold_points(points, np.repeat(np.arange(len(whole), dtype=np.int32), sizes))
        self.size = np.bincount(self.owner, minlength=len(whole)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def grams(self, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the stretch of ``width`` letters that begins at each position, and those positions."""
        values = window_hash(self.points, width, seed)
        if not len(values):
            return values, np.zeros(0, dtype=np.int64)
        inside = np.nonzero(self.owner[: len(values)] == self.owner[width - 1 :])[0]
        return values[inside], inside


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185 + 2 * seed)
        x ^= x >> _U(27)
        x *= _U(0x81DADEF4BC2DD44D)
        return x ^ (x >> _U(33))


def window_hash(points: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every window of ``width`` elements, by binary decomposition of ``width``."""
    if len(points) < width:
        return np.zeros(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    part, size = mix(points.astype(np.uint64) + _U(0x5851F42D4C957F2D), seed), 1
    done: np.ndarray | None = None
    got = 0
    n = len(points) - width + 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                piece = part[got : got + n]
                done = piece.copy() if done is None else done * _U(pow(base, size, 1 << 64)) + piece
                got += size
            if got == width:
                break
            part = part[:-size] * _U(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return mix(done, seed)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct integers in order; sorting them is several times faster than the hashing of ``np.unique``."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def rounds(texts: Iterable[str | None], limit: int = ROUND_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Cuts texts into runs of about ``limit`` characters; yields (index of the first, texts)."""
    first, run, size = 0, [], 0
    for k, t in enumerate(texts):
        run.append(t)
        size += len(t) if t else 1
        if size >= limit:
            yield first, run
            first, run, size = k + 1, [], 0
    if run:
        yield first, run
