import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscraft.llm import charforms, registry


def brute(text):
    if text is None:
        return None
    out = "".join(charforms._plain(c) for c in text)
    return unicodedata.normalize("NFC", out).strip(" ")


CASES = [
    None, "", "  ", "plain", "é", "é", "ậ", "ậ", "ậ", "a᷀́", "ｆｕｌｌ　１", "full 1", "so­ft​ hy‍phen", "soft hyphen",
    "ﬁn", "fin", "⼦", "子", "Сор", "Cop", "сор", "οmega", "x²", "x2", "a b", "a b", "a  b", "Á", "A", "한글", "é", "́alone", "e​́", "a\tb", "a\nb", " x ", "ё", "ë", "й", "й",
    "，。", ",｡", "İ", "𝐀", "😀é", "x" * 5000 + "é",
]


def forms(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "line_id bigint, text string, form string")
    return {r.line_id: r.form for r in charforms.consistent_form(df, "line_id").collect()}


def test_forms_like_brute_force(spark):
    got = forms(spark, CASES)
    assert got == {k: brute(t) for k, t in enumerate(CASES)}


def test_looks(spark):
    got = forms(spark, CASES)
    at = CASES.index
    same = [("ｆｕｌｌ　１", "full 1"), ("ﬁn", "fin"), ("⼦", "子"), ("сор", "cop"), ("so­ft​ hy‍phen", "soft hyphen"), ("a b", "a b")]
    for a, b in same:
        assert got[at(a)] == got[at(b)] if b in CASES else got[at(a)] == b
    for a, b in [("x²", "x2"), ("a b", "a  b"), ("é", "Á"), ("Á", "A")]:
        assert got[at(a)] != got[at(b)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab eẹ́́̈аЁｆ​ 1²子⼦ﬁ\n", max_size=12), max_size=20))
def test_forms_on_random_texts(spark, texts):
    assert forms(spark, texts) == {k: brute(t) for k, t in enumerate(texts)}


def test_pairs(spark):
    lines = [*enumerate(CASES), (100, "plain"), (101, "рlain"), (102, "рlain"), (103, "pl​ain")]
    df = spark.createDataFrame(lines, "line_id bigint, text string")
    true = {(i, j) for (i, a), (j, b) in itertools.combinations(lines, 2) if brute(a) and brute(a) == brute(b) and a != b}
    assert {tuple(r) for r in charforms.alike_lines(df).collect()} == true
    assert charforms.alike_lines(df.limit(0)).count() == 0


def test_wide_spellings_keep_every_line(spark):
    lines = [*((k, "the same") for k in range(300)), *((k, "the\u200b same") for k in range(300, 600)), (600, "thе same"), (601, "The same"), (9, "thе same")]
    df = spark.createDataFrame(lines, "line_id bigint, text string")
    found = sorted(tuple(r) for r in charforms.alike_lines(df).collect())
    assert found == sorted({(min(i, j), max(i, j)) for i, a in lines for j, b in lines if i != j and a != b and "The same" not in (a, b)})


def test_every_document_and_stream_row_has_its_form(spark, tmp_path):
    texts = [*enumerate(CASES), (500, None), (501, ""), (3, CASES[3])]
    for name, key, query in (("documents", "doc_id", "p4_documents"), ("stream_rows", "row_id", "p4_rows")):
        spark.createDataFrame(texts, f"{key} bigint, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        found = [tuple(r) for r in registry.queries()[query](spark, str(tmp_path)).collect()]
        assert sorted(found) == sorted((k, None if t is None else brute(t), None if t is None else brute(t) != t) for k, t in dict(texts).items())
