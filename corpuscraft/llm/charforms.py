"""Problem 4: visually identical text with different characters.

Texts are exploded to positioned code points. A broadcast mapping (built by rule from the
Unicode database, a few thousand rows, whatever the input) replaces what looks the same:
canonical decompositions, full-width and half-width forms, presentation ligatures,
radicals, blanks, look-alike letters of other scripts; invisible characters vanish.
Combining marks are ordered by class behind their base, clusters are recomposed, and the
text is rebuilt. Letter case, accents, digits, punctuation and styled forms such as
superscripts stay different. Outer blanks do not count.

The explosion keeps the partitioning by row, so only texts travel, never code points;
texts without any changed character skip it,
and so do the runs of a text that hold none; only bases with loose marks are decomposed. Look-alikes are mapped one way (to Latin where
a Latin letter looks the same), so two texts look the same exactly if their forms are
equal; the form is for comparing, not for display.

Defined results: a null text has a null form; blank texts have the form ''.
"""

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..session import scratch, table
from .pairing import blocks, pairs

# Letters that look the same as a Latin one, case by case.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j",
    "ɡ": "g", "ɑ": "a", "ѵ": "v", "ν": "v", "ɩ": "i",
}

MARK = r"\p{M}"
BLOCK_LINES = 256  # lines in a block when pairs are written out

_COMPAT = [(0x2000, 0x200A), (0x2E80, 0x2FD5), (0xFB00, 0xFB06), (0xFF00, 0xFFEF), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xF900, 0xFAFF)]


def _plain(ch: str) -> str:
    """What one character becomes: decomposed, without styles that are seen."""
    if unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace():
        return ""
    if ch.isspace():
        return " " if ch not in "\r\n" else "\n" if ch == "\n" else ""
    kind = unicodedata.decomposition(ch).split(" ")[0]
    near = any(a <= ord(ch) <= z for a, z in _COMPAT) or kind in ("<wide>", "<narrow>", "<noBreak>")
    out = unicodedata.normalize("NFKD" if near else "NFD", ch)
    return "".join(LOOKALIKES.get(c, c) for c in out)


@cache
def mapping() -> tuple[tuple[str, str, str, int], ...]:
    """(character, its form alone, its decomposed form before a combining mark, combining class) of every character that
    changes, decomposes or combines; Hangul syllables, which decompose by arithmetic and recompose to themselves, stay."""
    out = []
    for c in [*range(0xAC00), *range(0xF900, 0x10000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0080)]:
        ch = chr(c)
        apart, order = _plain(ch), unicodedata.combining(ch)
        if apart != ch or order:
            out.append((ch, apart if order else unicodedata.normalize("NFC", apart), apart, order))
    return tuple(out)


def _changed() -> list[str]:
    """Characters whose form differs even when they stand alone, and those that combine."""
    return [c for c, alone, _, order in mapping() if alone != c or order]


@cache
def compositions() -> tuple[tuple[str, str], ...]:
    """Cluster of a base and its marks, in order -> composed character, one mark or several."""
    out = {}
    for c in [*range(0xC0, 0x3400), *range(0xF900, 0xFB50)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(c):  # not excluded from composition
            key = "".join(LOOKALIKES.get(x, x) for x in d)
            out.setdefault(key, unicodedata.normalize("NFC", key))
    return tuple(out.items())


@cache
def _patterns() -> tuple[str, str, str]:
    """Regular expressions: a character that may change; the runs of a text without combining marks; of one with some.

    The characters that surely stay are given as the few long ranges of them, for a class of many ranges is slow; others
    are looked up and may turn out to stay. A run is a base with its marks (invisible characters between them included),
    characters that may change, or characters that stay.
    """
    changed = set(_changed())
    stays = lambda c: chr(c) not in changed and unicodedata.category(chr(c))[0] not in "MC"
    runs: list[list[int]] = []
    for c in range(0x20, 0xD800):
        if stays(c):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    long = sorted(runs, key=lambda r: (r[0] > 0x7F, r[0] - r[1]))[:12]
    plain = "\n" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in long)
    bound = r"\P{M}(?:\p{Cf}*\p{M})+"
    return f"[^{plain}]", f"[{plain}]+|[^{plain}]+", rf"(?s){bound}|\p{{M}}+|(?:(?!{bound})[^{plain}\p{{M}}])+|(?:(?!{bound})[{plain}])+"


@F.pandas_udf(StringType())
def _composed(cluster: pd.Series) -> pd.Series:
    return cluster.map(lambda c: unicodedata.normalize("NFC", c))


def consistent_form(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, text, form`` for every row with a key; a key that is repeated with other texts keeps each row's own form."""
    spark = df.sparkSession
    changed, runs_of, marked_runs = _patterns()
    base = df.select(df[key].alias(key), df[text].alias(text)).where(df[key].isNotNull())
    flagged = base.withColumn("_odd", F.coalesce(F.col(text).rlike(changed), F.lit(False)))
    simple = flagged.where("not _odd").select(key, text, F.trim(text).alias("form"))
    alone = F.broadcast(spark.createDataFrame([(c, a) for c, a, _, order in mapping() if not order], "_c string, _alone string"))
    apart = F.broadcast(spark.createDataFrame([(c, d) for c, _, d, _ in mapping()], "_c string, _apart string"))
    order = F.broadcast(spark.createDataFrame([(c, o) for c, _, _, o in mapping() if o], "_d string, _class int"))
    whole = F.broadcast(spark.createDataFrame(list(compositions()), "_cluster string, _whole string"))

    one = flagged.where("_odd").select(key, text).withColumn("_id", F.xxhash64(key, text)).repartition("_id").distinct()
    cut = F.when(F.col(text).rlike(MARK), F.regexp_extract_all(F.col(text), F.lit(marked_runs), F.lit(0))).otherwise(F.regexp_extract_all(F.col(text), F.lit(runs_of), F.lit(0)))
    runs = one.select("_id", F.posexplode(cut).alias("_r", "_run"))
    runs = runs.withColumn("_bound", F.col("_run").rlike(MARK))
    # characters that stand alone: one lookup each; a run without changes is one piece
    free = runs.where("not _bound").select("_id", "_r", F.posexplode(F.when(F.col("_run").rlike(changed), F.split("_run", "")).otherwise(F.array("_run"))).alias("_i", "_c"))
    place = F.col("_r").cast("bigint") * (1 << 31) + F.col("_i")
    free = free.join(alone, "_c", "left").select("_id", place.alias("_p"), F.coalesce("_alone", "_c").alias("_piece"))
    free = free.groupBy("_id").agg(F.collect_list(F.struct("_p", "_piece")).alias("_free"))
    # bases with marks: decomposed, marks ordered by class behind their base, recomposed
    points = runs.where("_bound").select("_id", "_r", F.posexplode(F.split("_run", "")).alias("_i", "_c")).where("_c <> ''")
    points = points.join(apart, "_c", "left").withColumn("_apart", F.coalesce("_apart", "_c"))
    parts = points.select("_id", "_r", "_i", F.posexplode(F.split("_apart", "")).alias("_q", "_d")).where("_d <> ''").join(order, "_d", "left").withColumn("_class", F.coalesce("_class", F.lit(0)))
    along = Window.partitionBy("_id", "_r").orderBy("_i", "_q").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_start", F.sum(F.when(F.col("_class") == 0, 1).otherwise(0)).over(along))
    clusters = parts.groupBy("_id", "_r", "_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_class", "_i", "_q", "_d"))), lambda s: s["_d"]), "").alias("_cluster"))
    known = clusters.join(whole, "_cluster", "left").select("_id", (F.col("_r").cast("bigint") * (1 << 31) + F.col("_start")).alias("_p"), F.coalesce("_whole", _composed("_cluster")).alias("_piece"))
    known = known.groupBy("_id").agg(F.collect_list(F.struct("_p", "_piece")).alias("_marked"))
    none = F.array().cast("array<struct<_p: bigint, _piece: string>>")
    built = one.join(free, "_id", "left").join(known, "_id", "left")
    pieces = F.array_sort(F.concat(F.coalesce("_free", none), F.coalesce("_marked", none)))
    return simple.union(built.select(key, text, F.trim(F.array_join(F.transform(pieces, lambda s: s["_piece"]), "")).alias("form")))


def alike_lines(lines: DataFrame, key: str = "line_id", text: str = "text", one: str = "line_a", two: str = "line_b") -> DataFrame:
    """All pairs of ids, smaller first, of non-blank texts that have one form but not the same characters.

    Lines with the same characters form one spelling, taken in blocks of about ``BLOCK_LINES``; the pairs of blocks of two
    spellings of one form are spread over tasks (``pairing``).
    """
    forms = scratch(consistent_form(lines, key, text).where("form <> ''"), "forms")
    variants = forms.groupBy("form", text).agg(F.count("*").alias("members"))
    several = variants.groupBy("form").agg(F.count("*").alias("kinds")).where("kinds > 1").select("form")
    mixed = forms.join(several, "form", "left_semi").join(variants, ["form", text])
    parts = scratch(blocks(mixed.select(F.col("form").alias("class"), F.col(text).alias("side"), F.col(key).alias("id"), "members"), BLOCK_LINES), "alike")
    other = parts.select("class", F.col("side").alias("u"), F.col("loose").alias("v"), F.col("ids").alias("y"))
    met = parts.join(other, "class").where("side < u").select(F.col("ids").alias("x"), "y", F.expr("loose or v").alias("loose"), F.lit(False).alias("same"))
    return pairs(met, one, two)


def document_forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, form, changed`` of every id and text, repeated rows once."""
    forms = consistent_form(docs.select(key, text).distinct(), key, text)
    return forms.select(key, "form", (F.col(text) != F.col("form")).alias("changed"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike_lines(table(spark, folder, "corpus_lines"))


def p4_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line: its form and how many lines and spellings share it."""
    forms = scratch(consistent_form(table(spark, folder, "corpus_lines"), "line_id"), "forms")
    by = forms.where("form is not null").groupBy("form").agg(F.count("*").alias("lines"), F.count_distinct("text").alias("spellings"))
    return forms.join(by, "form", "left").select("line_id", "form", "lines", "spellings")


def p4_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its form and whether that differs from the text."""
    return document_forms(table(spark, folder, "documents"))


def p4_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents and how many of them change in their consistent form."""
    docs = table(spark, folder, "documents")
    forms = consistent_form(docs, "doc_id")
    return docs.select("doc_id", "source").join(forms, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("text") != F.col("form")).alias("changed"))


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per row of the stream, redelivered ones once: its form and whether that differs from the text."""
    return document_forms(table(spark, folder, "stream_rows"), "row_id")
