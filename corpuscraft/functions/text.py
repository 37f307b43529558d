"""Text functions of the tokenizer pipeline as column expressions: pre-tokenizers, the byte alphabet and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the pre-tokenizer (26 code points, with U+180E, without U+001C to U+001F).
WHITE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

_CLASS = "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in WHITE_RANGES)

#: A piece keeps the white space before it; trailing white space is a piece of its own.
PIECE_PATTERN = f"[{_CLASS}]*[^{_CLASS}]+|[{_CLASS}]+"

# Fixed value: the published pattern of the second pre-tokenizer (needs look-ahead and Unicode classes).
GPT2_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    printable = [b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


#: Byte -> character, 256 entries by rule.
BYTE_ALPHABET = _byte_alphabet()

_MOVED = [b for b in range(256) if BYTE_ALPHABET[b] != chr(b)]


def pieces(text: Column) -> Column:
    """Pieces of the white-space pre-tokenizer; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def gpt2_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GPT2_PATTERN), F.lit(0))


def byte_level(text: Column) -> Column:
    """Each byte of the UTF-8 form as one printable character."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "".join(map(chr, _MOVED)), "".join(BYTE_ALPHABET[b] for b in _MOVED))


def byte_level_inverse(word: Column) -> Column:
    """The text of a byte-level word. ``translate`` drops what maps to NUL, so byte 0 is replaced apart."""
    moved = [b for b in _MOVED if b]
    latin = F.translate(word, "".join(BYTE_ALPHABET[b] for b in moved), "".join(map(chr, moved)))
    raw = F.encode(F.replace(latin, F.lit(BYTE_ALPHABET[0]), F.lit("\0")), "ISO-8859-1")
    return F.make_valid_utf8(raw.cast("string"))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` code points; 0 is no limit."""
    return F.when(F.lit(most) > 0, F.substring(text, 1, most)).otherwise(text) if most > 0 else text
