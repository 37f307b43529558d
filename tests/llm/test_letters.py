import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscraft.llm.letters import LOOKALIKE_LOWER, LetterBatch, rounds, window_hash


def plain(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", unicodedata.normalize("NFC", text or "")).casefold())
    return "".join(LOOKALIKE_LOWER.get(c, c) for c in t if c.isalnum())


def letters(texts):
    b = LetterBatch(texts)
    return ["".join(map(chr, b.points[s : s + n])) for s, n in zip(b.start, b.size, strict=False)]


def test_forms_that_look_the_same_have_the_same_letters():
    same = ["Straße 12", "STRASSE 12", "Ｓｔｒａßｅ　１２", "Str​aße-12", "Stra­ße 12!", "Strаße 12"]
    assert len(set(letters(same))) == 1


def test_null_and_empty():
    assert letters([None, "", "  ", "a"]) == ["", "", "", "a"]
    assert len(LetterBatch([]).points) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs", "Mn", "Me", "Mc", "Co", "Cn"])))))
def test_like_brute_force(texts):
    assert letters(texts) == [plain(t) for t in texts]


def test_window_hash_depends_on_its_letters_only():
    a = np.frombuffer("xabcdefghy".encode("utf-32-le"), dtype=np.uint32)
    b = np.frombuffer("abcdefgh".encode("utf-32-le"), dtype=np.uint32)
    assert window_hash(a, 8)[1] == window_hash(b, 8)[0]
    assert len(set(window_hash(a, 8).tolist())) == 3
    assert window_hash(b, 9).size == 0
    for width in (1, 3, 5, 40):
        long = np.tile(a, 10)
        assert window_hash(long, width)[2] == window_hash(long[2:], width)[0]


def test_rounds_keep_every_text():
    texts = ["a" * 10, None, "", "b" * 30, "c"]
    got = [(k + i, t) for k, part in rounds(texts, 20) for i, t in enumerate(part)]
    assert got == list(enumerate(texts))
