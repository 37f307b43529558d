"""Queries of the engine by name, and for each the SQL it is held against."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics
from ..functions.text import BYTE_ALPHABET, WHITE_RANGES, byte_level, byte_level_inverse, gpt2_pieces, pieces
from ..operators import batches, bpe_encode, bpe_train, corpus, resume, shards, wordcount
from ..session import scratch, scratch_folder, table
from ..sources.shard_files import listed_shards, read_manifest, read_shards, shard_files, token_dtype, write_manifest, write_shards
from ..sources.tokenizer_file import special_tokens
from ..streaming import counts as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LEAST, MOST = 20, 500  # code points
TOP = 1000
MERGES = 12
LENGTH = 128  # tokens of a sequence
SHARD = 50_000  # tokens of a shard
SPECIALS = ("<unk>", "<bos>", "<eos>")

_WS = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WHITE_RANGES)
WHITE_SQL = _WS  # the white space of the pre-tokenizer, for classes in SQL
#: The pieces of a text, for SQL.
_PIECES = f"regexp_extract_all(text, '[{_WS}]*[^{_WS}]+|[{_WS}]+')"
_ALPHABET = "[" + ",".join(f"chr({ord(c)})" for c in BYTE_ALPHABET) + "]"


def _mapped(word: str) -> str:
    """SQL for the byte-level form of a word; the alphabet comes as the CTE ``abc``."""
    return f"array_to_string([abc[('0x' || substr(hex({word}), 2 * i + 1, 2))::INT + 1] for i in range(strlen({word}))], '')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


# --- filters, statistics, limits ----------------------------------------------------------------


@query(f"SELECT doc_id, substr(text, 1, {MOST}) AS text, length(text)::BIGINT AS n_chars_before FROM documents WHERE length(text) >= {LEAST}")
def scan_filter_truncate(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars_before"))
    return corpus.emitted(docs, LEAST, MOST).select("doc_id", "text", "n_chars_before")


def _stats_sql(by: str, source: str, least: int, most: int) -> str:
    return f"""
SELECT {by}, count(*) AS docs_scanned, count(*) FILTER (length(text) >= {least}) AS docs_emitted, count(*) FILTER (text IS NULL) AS skipped_missing,
  count(*) FILTER (length(text) < {least}) AS skipped_short, count(*) FILTER (length(text) > {most}) AS truncated_docs,
  coalesce(sum(least(length(text), {most})) FILTER (length(text) >= {least}), 0)::BIGINT AS emitted_chars
FROM {source} GROUP BY {by}"""


@query(_stats_sql("lang", "documents", LEAST, MOST))
def stream_stats_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.stream_stats(_docs(spark, folder).select("lang", "text"), "lang", LEAST, MOST)


@query(_stats_sql("stat_id", "(SELECT row_id, any_value(stat_id) AS stat_id, min(text) AS text FROM stream_rows GROUP BY row_id)", 20, 1200))
def stream_stats_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that distinct stream rows give."""
    rows = table(spark, folder, "stream_rows").groupBy("row_id").agg(F.first("stat_id").alias("stat_id"), F.min("text").alias("text"))
    return corpus.stream_stats(rows, "stat_id", 20, 1200)


@query("SELECT stat_id, run_id, phase, language, docs_emitted, emitted_chars FROM (SELECT *, row_number() OVER (PARTITION BY stat_id ORDER BY finished_at DESC) AS rn FROM stream_stats) WHERE rn = 1")
def stream_stats_final(spark: SparkSession, folder: str) -> DataFrame:
    """Of repeated statistics the finished one."""
    kept = ["run_id", "phase", "language", "docs_emitted", "emitted_chars"]
    best = table(spark, folder, "stream_stats").groupBy("stat_id").agg(F.max_by(F.struct(*kept), "finished_at").alias("r"))
    return best.select("stat_id", "r.*")


@query(
    f"SELECT lang, doc_id, rn::INT AS rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= {LEAST}) WHERE rn <= 50"
)
def lang_limit(spark: SparkSession, folder: str) -> DataFrame:
    kept = _docs(spark, folder).where(F.length("text") >= LEAST).select("lang", "doc_id")
    return corpus.first_per_group(kept, "lang", "doc_id", 50)


@query("SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de')")
def lang_except(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.except_values(_docs(spark, folder), "lang", ["en", "de"])


_BAD_LINES = ('{"doc_id":-1,"text":5}', '{"doc_id":-2,"text":{"text":"x"}}', '{"doc_id":-3,"text":null}', '{"doc_id":-4,"te', '{"doc_id":-5}', "[1]", "", '{"a":{"text":"no"},"text":"yes \\u00e9 \\ud83d\\ude00"}')


@query(
    "WITH l AS (SELECT to_json({doc_id: doc_id, text: text})::VARCHAR AS line FROM documents UNION ALL SELECT unnest(["
    + ",".join("'" + x + "'" for x in _BAD_LINES)
    + "])), t AS (SELECT CASE WHEN json_valid(line) THEN CASE WHEN json_type(line, '$.text') = 'VARCHAR' THEN json_extract_string(line, '$.text') END END AS text FROM l)\nSELECT text, count(*) AS n FROM t WHERE text IS NOT NULL GROUP BY text"
)
def json_extract_guard(spark: SparkSession, folder: str) -> DataFrame:
    lines = _docs(spark, folder).select(F.to_json(F.struct("doc_id", "text")).alias("line")).union(spark.createDataFrame([(x,) for x in _BAD_LINES], "line string"))
    return lines.select(corpus.json_text(F.col("line")).alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("n"))


# --- pre-tokenizers and the byte alphabet ---------------------------------------------------------


@query(f"SELECT doc_id, len({_PIECES})::BIGINT AS n_pieces FROM documents WHERE text IS NOT NULL")
def pretokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text is not null").select("doc_id", F.size(pieces(F.col("text"))).cast("bigint").alias("n_pieces"))


_BREAK = "\ufdd0"  # no character


def _gpt2_pieces_sql() -> str:
    """The pieces without look-ahead: a mark is set before the last white space ahead of a word; what is not matched falls out."""
    white = r"\x{20}\x{9}-\x{D}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    found = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}{_BREAK}]+|[{white}]+"
    return rf"regexp_extract_all(regexp_replace(text, '([{white}]*)([{white}])([^{white}])', '\1{_BREAK}\2\3', 'g'), '{found}')"


_GPT2_PIECES = _gpt2_pieces_sql()


@query(f"SELECT doc_id, len({_GPT2_PIECES})::BIGINT AS n_pieces FROM documents WHERE text IS NOT NULL")
def pretokenize_gpt2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text is not null").select("doc_id", F.size(gpt2_pieces(F.col("text"))).cast("bigint").alias("n_pieces"))


_WORDS_SQL = f"c AS (SELECT raw, count(*) AS freq FROM (SELECT unnest({_PIECES}) AS raw FROM documents WHERE text IS NOT NULL) GROUP BY raw)"


@query(f"WITH {_WORDS_SQL}, a AS (SELECT {_ALPHABET} AS abc) SELECT raw, {_mapped('raw')} AS word FROM c, a")
def byte_level_words(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.words(_docs(spark, folder)).distinct().select(F.col("word").alias("raw"), byte_level(F.col("word")).alias("word"))


@query("SELECT count(*) AS docs, 0::BIGINT AS mismatches FROM documents WHERE text IS NOT NULL")
def byte_level_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    back = byte_level_inverse(byte_level(F.col("text")))
    return _docs(spark, folder).where("text is not null").agg(F.count("*").alias("docs"), F.count_if(back != F.col("text")).alias("mismatches"))


# --- counting --------------------------------------------------------------------------------------


@query(f"WITH {_WORDS_SQL}, a AS (SELECT {_ALPHABET} AS abc), m AS (SELECT {_mapped('raw')} AS word, freq FROM c, a) SELECT word, freq FROM m ORDER BY freq DESC, word LIMIT {TOP}")
def word_count_topk(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.top_words(_docs(spark, folder), TOP)


@query(f"""
WITH p AS (SELECT lang, unnest({_PIECES}) AS raw FROM documents WHERE text IS NOT NULL),
g AS (SELECT lang, raw, count(*) AS freq, grouping(lang)::INT AS total FROM p GROUP BY GROUPING SETS ((lang, raw), (raw)) HAVING count(*) >= 50),
a AS (SELECT {_ALPHABET} AS abc)
SELECT lang, {_mapped('raw')} AS word, freq, total FROM g, a""")
def word_count_lang_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.rollup_counts(_docs(spark, folder), "lang", 50)


@query(f"""
WITH p AS (SELECT doc_id // 100 AS chunk, unnest({_PIECES}) AS raw FROM documents WHERE text IS NOT NULL),
c AS (SELECT chunk, raw, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT {_ALPHABET} AS abc),
m AS (SELECT chunk, {_mapped('raw')} AS word, n FROM c, a),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n DESC, word) AS rn FROM m)
SELECT word, sum(n)::BIGINT AS freq, count(*) AS chunks FROM r WHERE rn <= 200 GROUP BY word""")
def word_count_lossy(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.lossy_counts(_docs(spark, folder), F.expr("doc_id div 100"), 200)


@query(f"WITH {_WORDS_SQL}, a AS (SELECT {_ALPHABET} AS abc) SELECT {_mapped('raw')} AS word, freq, strlen(raw)::BIGINT AS n_symbols FROM c, a WHERE freq >= 5")
def word_min_freq_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.word_counts(_docs(spark, folder), least=5).withColumn("n_symbols", F.length("word").cast("bigint"))


@query(f"""
WITH {_WORDS_SQL}, a AS (SELECT {_ALPHABET} AS abc), m AS (SELECT {_mapped('raw')} AS word, freq FROM c, a),
p AS (SELECT unnest([substr(word, i, 2) for i in range(1, length(word))]) AS pair, freq FROM m)
SELECT pair[1] AS "left", pair[2] AS "right", sum(freq)::BIGINT AS freq FROM p GROUP BY ALL ORDER BY freq DESC, 1, 2 LIMIT 200""")
def pair_counts_topk(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.pair_counts(wordcount.word_counts(_docs(spark, folder))).orderBy(F.desc("freq"), "left", "right").limit(200)


# --- BPE -------------------------------------------------------------------------------------------


def _training_sql(merges: int, counted: str = _WORDS_SQL, least: int = 2) -> str:
    """Unrolled CTEs: w<k> are the words after k merges, m<k> the k-th merge. Symbols stand between chr(2) and chr(3)."""
    steps = [
        f"{counted}, a AS (SELECT {_ALPHABET} AS abc), "
        f"w0 AS MATERIALIZED (SELECT chr(2) || array_to_string([abc[('0x' || substr(hex(raw), 2 * i + 1, 2))::INT + 1] for i in range(strlen(raw))], chr(3) || chr(2)) || chr(3) AS s, freq FROM c, a WHERE freq >= {least})"
    ]
    for k in range(merges):
        steps.append(
            f"p{k} AS (SELECT string_split(trim(s, chr(2) || chr(3)), chr(3) || chr(2)) AS v, freq FROM w{k}), "
            f"q{k} AS (SELECT unnest([{{'l': v[i], 'r': v[i + 1]}} for i in range(1, len(v))]) AS pr, freq FROM p{k}), "
            f"m{k} AS MATERIALIZED (SELECT {k} AS k, pr.l AS l, pr.r AS r, sum(freq)::BIGINT AS n FROM q{k} GROUP BY ALL ORDER BY n DESC, l, r LIMIT 1), "
            f"w{k + 1} AS MATERIALIZED (SELECT replace(s, chr(2) || l || chr(3) || chr(2) || r || chr(3), chr(2) || l || r || chr(3)) AS s, freq FROM w{k}, m{k})"
        )
    return "WITH " + ",\n".join(steps) + ",\nm AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(merges)) + ")\n"


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.words(_docs(spark, folder)).groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 2").select(F.col("word").alias("raw"), "freq")


@query(_training_sql(MERGES) + 'SELECT k::INT AS merge_rank, l AS "left", r AS "right", n AS freq FROM m')
def bpe_train_k(spark: SparkSession, folder: str) -> DataFrame:
    """The first merges, one distributed aggregation each."""
    found = bpe_train.train_relational(scratch(_counted(spark, folder), "words"), MERGES, 2)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(found)], "merge_rank int, left string, right string, freq bigint")


@query(
    _training_sql(MERGES)
    + f", t AS (SELECT unnest({list(SPECIALS)}) AS token, generate_subscripts({list(SPECIALS)}, 1) AS ord UNION ALL SELECT unnest(abc), 1000 + generate_subscripts(abc, 1) FROM a UNION ALL SELECT l || r, 10000 + k FROM m)\n"
    + "SELECT (row_number() OVER (ORDER BY min(ord)) - 1)::INT AS token_id, token FROM t GROUP BY token"
)
def vocab_assembly(spark: SparkSession, folder: str) -> DataFrame:
    merges = [(r.left, r.right) for r in bpe_train_k(spark, folder).orderBy("merge_rank").collect()]
    return spark.createDataFrame(list(enumerate(bpe_train.assembled_vocabulary(merges, special_tokens(",".join(SPECIALS))))), "token_id int, token string")


@query(_training_sql(MERGES, _WORDS_SQL.replace(_PIECES, _GPT2_PIECES), 1) + 'SELECT k::INT AS merge_rank, l AS "left", r AS "right", n AS freq FROM m')
def gpt2_train_k(spark: SparkSession, folder: str) -> DataFrame:
    """The first merges over the pieces of the second pre-tokenizer; words count however rare, pairs from two on."""
    counted = wordcount.words(_docs(spark, folder), mode="gpt2").groupBy(F.col("word").alias("raw")).agg(F.count("*").alias("freq"))
    found = bpe_train.train(counted, MERGES, 2)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(found)], "merge_rank int, left string, right string, freq bigint")


@query()
def bpe_train_driver(spark: SparkSession, folder: str) -> DataFrame:
    """2,000 merges over all words that occur 5 times or more, after a distributed count; the driver merges up to
    ``bpe_train.DRIVER_WORDS`` words, beyond that each merge is an aggregation."""
    counted = wordcount.words(_docs(spark, folder)).groupBy(F.col("word").alias("raw")).agg(F.count("*").alias("freq")).where("freq >= 5")
    found = bpe_train.train(counted, 2000, 2)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(found)], "merge_rank int, left string, right string, freq bigint")


def _ids_cte(found: str, merges: str = "merges", specials: bool = True) -> str:
    """``doc_ids(doc_id, ids)``: merges in rank order fold over the delimited symbols of each distinct piece, whose ids are joined
    back in order, between bos and eos."""
    ends = ("list_concat(list_concat([1], ", "), [2])") if specials else ("", "")
    return f"""split AS (SELECT doc_id, {found} AS found FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT raw FROM (SELECT unnest(found) AS raw FROM split)), a AS (SELECT {_ALPHABET} AS abc),
g AS (SELECT list(chr(2) || left_token || chr(3) || chr(2) || right_token || chr(3) || chr(1) || chr(2) || left_token || right_token || chr(3) ORDER BY merge_rank) AS rules FROM {merges}),
e0 AS (SELECT raw, chr(2) || array_to_string([abc[('0x' || substr(hex(raw), 2 * i + 1, 2))::INT + 1] for i in range(strlen(raw))], chr(3) || chr(2)) || chr(3) AS s FROM c, a),
e AS (SELECT raw, list_reduce(list_concat([s], rules), lambda x, m: replace(x, split_part(m, chr(1), 1), split_part(m, chr(1), 2))) AS s FROM e0, g),
symbols AS (SELECT raw, string_split(trim(s, chr(2) || chr(3)), chr(3) || chr(2)) AS v FROM e),
coded AS (SELECT raw, list(token_id ORDER BY i) AS ids FROM (SELECT raw, unnest(v) AS token, generate_subscripts(v, 1) AS i FROM symbols) JOIN vocab USING (token) GROUP BY raw),
placed AS (SELECT doc_id, unnest(found) AS raw, generate_subscripts(found, 1) AS pos FROM split),
doc_ids AS (SELECT d.doc_id, {ends[0]}coalesce(flatten(list(ids ORDER BY pos) FILTER (ids IS NOT NULL)), []){ends[1]} AS ids
  FROM split d LEFT JOIN placed p USING (doc_id) LEFT JOIN coded s ON p.raw = s.raw GROUP BY d.doc_id)"""


@query(f"WITH {_ids_cte(_PIECES, f'(SELECT * FROM merges WHERE merge_rank < {MERGES})', False)} SELECT doc_id, len(ids)::BIGINT AS n_tokens FROM doc_ids")
def bpe_encode_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts under a short merge list."""
    return bpe_encode.count_documents(_docs(spark, folder), bpe_encode.load_model(table(spark, folder, "vocab"), table(spark, folder, "merges"), MERGES))


@query(f"WITH {_ids_cte(_PIECES)} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM doc_ids")
def bpe_encode_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids with bos and eos under the whole vocabulary and all merges."""
    return _coded(spark, folder).select("doc_id", F.array_join("ids", " ").alias("ids"))


@query(f"WITH {_ids_cte(_GPT2_PIECES)} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM doc_ids")
def gpt2_encode_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids with bos and eos over the pieces of the second pre-tokenizer; specials that stand in a text are tokens of their own."""
    coded = bpe_encode.encode_documents(_docs(spark, folder), _model(spark, folder), 1, 2, mode="gpt2", added=SPECIALS)
    return coded.select("doc_id", F.array_join("ids", " ").alias("ids"))


#: Tokens of each document under all merges: merges in rank order fold over the delimited symbols of each distinct piece.
DOC_TOKENS_CTE = f"""{_WORDS_SQL}, a AS (SELECT {_ALPHABET} AS abc),
g AS (SELECT list(chr(2) || left_token || chr(3) || chr(2) || right_token || chr(3) || chr(1) || chr(2) || left_token || right_token || chr(3) ORDER BY merge_rank) AS rules FROM merges),
e0 AS (SELECT raw, chr(2) || array_to_string([abc[('0x' || substr(hex(raw), 2 * i + 1, 2))::INT + 1] for i in range(strlen(raw))], chr(3) || chr(2)) || chr(3) AS s FROM c, a),
e AS (SELECT raw, list_reduce(list_concat([s], rules), lambda x, m: replace(x, split_part(m, chr(1), 1), split_part(m, chr(1), 2))) AS s FROM e0, g),
sized AS (SELECT raw, length(s) - length(replace(s, chr(2), '')) AS n FROM e),
placed AS (SELECT doc_id, unnest({_PIECES}) AS raw FROM documents WHERE text IS NOT NULL),
doc_tokens AS (SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN placed p ON d.doc_id = p.doc_id LEFT JOIN sized s ON p.raw = s.raw GROUP BY d.doc_id)"""


def _model(spark: SparkSession, folder: str) -> bpe_encode.Model:
    return bpe_encode.load_model(table(spark, folder, "vocab"), table(spark, folder, "merges"))


def _coded(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_encode.encode_documents(_docs(spark, folder), _model(spark, folder), 1, 2)


@query(f"WITH {DOC_TOKENS_CTE} SELECT doc_id, n_tokens FROM doc_tokens")
def encode_udf_full_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_encode.count_documents(_docs(spark, folder), _model(spark, folder))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def decode_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded with the whole vocabulary and decoded again."""
    return bpe_encode.decode(bpe_encode.encode_documents(_docs(spark, folder), _model(spark, folder)), table(spark, folder, "vocab"))


# --- token stream -----------------------------------------------------------------------------------

# Offsets and manifests are over the numbers of pieces, sequences and shard files over token ids.
_SIZES_SQL = f"n AS (SELECT doc_id, len({_PIECES})::BIGINT AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY doc_id))::BIGINT AS stop FROM n)"
_PARTS_SQL = f"{_SIZES_SQL}, k AS (SELECT *, unnest(range(start // {SHARD}, (stop - 1) // {SHARD} + 1)) AS shard_id FROM o WHERE stop > start), s AS (SELECT shard_id::BIGINT AS shard_id, printf('train_%06d.bin', shard_id) AS file, sum(least(stop, (shard_id + 1) * {SHARD}) - greatest(start, shard_id * {SHARD}))::BIGINT AS num_tokens, count(*) AS docs FROM k GROUP BY shard_id)"


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return pretokenize_counts(spark, folder).withColumnRenamed("n_pieces", "n")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return shards.offsets(_sizes(spark, folder))


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.manifest(shards.shard_parts(_placed(spark, folder), SHARD))


@query(f"WITH {_SIZES_SQL} SELECT * FROM o")
def doc_token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).select("doc_id", "start", "stop")


@query(f"WITH {_PARTS_SQL} SELECT * FROM s")
def shard_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _shards(spark, folder)


@query(f"""WITH {_PARTS_SQL} SELECT *, CASE WHEN row_number() OVER (ORDER BY shard_id) > count(*) OVER () - CASE WHEN count(*) OVER () < 2 THEN 0 ELSE greatest(1, least(count(*) OVER () - 1, floor(count(*) OVER () * 0.1))) END
THEN 'val' ELSE 'train' END AS part, num_tokens - {LENGTH} - 1 > 0 AS usable FROM s""")
def shard_split(spark: SparkSession, folder: str) -> DataFrame:
    return shards.split_shards(_shards(spark, folder), 0.1, LENGTH)


@query(f"""WITH {_PARTS_SQL}, u AS (SELECT shard_id, num_tokens - {LENGTH} - 1 AS m, count(*) OVER () AS n, row_number() OVER (ORDER BY shard_id) AS rn FROM s WHERE num_tokens - {LENGTH} - 1 > 0)
SELECT shard_id, round(m / sum(m) OVER (), 6)::DOUBLE AS weight, (64 // n + CASE WHEN rn <= 64 % n THEN 1 ELSE 0 END)::BIGINT AS picks FROM u""")
def batch_allocation(spark: SparkSession, folder: str) -> DataFrame:
    return shards.allocate(_shards(spark, folder), LENGTH, 64).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_PARTS_SQL}, u AS (SELECT shard_id, num_tokens - {LENGTH} - 1 AS m, count(*) OVER () AS n, row_number() OVER (ORDER BY shard_id) AS rn FROM s WHERE num_tokens - {LENGTH} - 1 > 0),
w AS (SELECT shard_id, m / sum(m) OVER () AS weight, (64 // n + CASE WHEN rn <= 64 % n THEN 1 ELSE 0 END)::BIGINT AS picks FROM u)
SELECT shard_id, round(weight, 6)::DOUBLE AS weight, picks FROM w ORDER BY -ln((('0x' || substr(md5(shard_id || '|42'), 1, 15))::BIGINT % 4503599627370496 + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight, shard_id LIMIT 4""")
def shard_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded weighted sampling of shards without replacement; the limit is the size of the sample."""
    return shards.weighted_sample(shards.allocate(_shards(spark, folder), LENGTH, 64), "weight", 4, 42).withColumn("weight", F.round("weight", 6))


def _sums(packed: DataFrame) -> DataFrame:
    """Sums of the tokens of x and y, and one of x that tells their order."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    placed = F.transform("x", lambda v, i: v.cast("bigint") * (i + 1))
    return packed.select("seq_id", F.element_at("x", 1).cast("bigint").alias("first"), total("x").alias("sum_x"), total("y").alias("sum_y"), total(placed).alias("placed_x"))


_STREAM_CTE = f"""{_ids_cte(_PIECES)},
t AS (SELECT doc_id, unnest(ids)::BIGINT AS id, generate_subscripts(ids, 1) AS k FROM doc_ids),
p AS (SELECT (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS pos, id FROM t), n AS (SELECT count(*) AS total FROM p)"""


def _sums_sql(starts: str) -> str:
    """The sums of the windows that begin at ``q(seq_id, head)``."""
    return f"""WITH {_STREAM_CTE},
q AS ({starts})
SELECT seq_id::BIGINT AS seq_id, max(id) FILTER (pos = q.head) AS "first", (sum(id) FILTER (pos < q.head + {LENGTH}))::BIGINT AS sum_x, (sum(id) FILTER (pos > q.head))::BIGINT AS sum_y,
  (sum(id * (pos - q.head + 1)) FILTER (pos < q.head + {LENGTH}))::BIGINT AS placed_x
FROM q JOIN p ON pos BETWEEN q.head AND q.head + {LENGTH} GROUP BY seq_id"""


def _windows_sql(stride: int, most: str = "") -> str:
    return _sums_sql(f"SELECT seq_id, seq_id * {stride} AS head FROM (SELECT unnest(range(0, CASE WHEN total > {LENGTH} THEN (total - {LENGTH + 1}) // {stride} + 1 ELSE 0 END)) AS seq_id FROM n) {most}")


@query(_windows_sql(LENGTH))
def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(shards.sequences(_coded(spark, folder), LENGTH, LENGTH))


@query(_windows_sql(LENGTH + 1))
def pack_stride_l1(spark: SparkSession, folder: str) -> DataFrame:
    return _sums(shards.sequences(_coded(spark, folder), LENGTH, LENGTH + 1))


@query(_windows_sql(LENGTH, "WHERE seq_id < 100"))
def eval_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """An evaluation's limit: the first 100 sequences."""
    return _sums(shards.sequences(_coded(spark, folder), LENGTH, LENGTH, 100))


@query(f"SELECT seq_id // 16 AS batch_id, count(*) AS n, sum(sum_x)::BIGINT AS sum_x, sum(sum_y)::BIGINT AS sum_y FROM ({_windows_sql(LENGTH)}) GROUP BY 1")
def stream_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Contiguous batches of 16 sequences."""
    packed = batches.contiguous_batches(_sums(shards.sequences(_coded(spark, folder), LENGTH, LENGTH)), 16)
    return packed.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y"))


_DRAWN = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query(_sums_sql(f"SELECT row_number() OVER (ORDER BY head, k) - 1 AS seq_id, head FROM (SELECT k, {_DRAWN.format(chr(39) + chr(39) + ' || k || ' + chr(39) + '|42' + chr(39))} % (total - {LENGTH}) AS head FROM n, range(16) r(k) WHERE total > {LENGTH})"))
def random_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of 16 sequences at seeded random starts."""
    placed = scratch(shards.offsets(_coded(spark, folder).withColumn("n", F.size("ids").cast("bigint"))).select("start", "stop", "ids"), "placed")
    return _sums(batches.random_batch(placed, placed.agg(F.max("stop")).first()[0] or 0, LENGTH, 16, 42))


@query(f"SELECT doc_id, epoch, {_DRAWN.format(chr(39) + chr(39) + ' || doc_id || ' + chr(39) + '|' + chr(39) + ' || (epoch + 42)')} AS place FROM (SELECT doc_id, unnest([0, 1, 2])::INT AS epoch FROM documents)")
def stream_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Three passes over the stream, each row once in each."""
    return batches.epochs(_docs(spark, folder).select("doc_id"), "doc_id", 3, 42)


@query(f"SELECT doc_id, epoch, {_DRAWN.format(chr(39) + chr(39) + ' || doc_id || ' + chr(39) + '|' + chr(39) + ' || (epoch + 42)')} AS place FROM (SELECT doc_id, unnest([0, 1])::INT AS epoch FROM documents)")
def shuffle_deterministic(spark: SparkSession, folder: str) -> DataFrame:
    """Two epochs in their seeded orders."""
    docs = _docs(spark, folder).select("doc_id")
    return shards.shuffled(docs.withColumn("epoch", F.lit(0)), "doc_id", 42, 0).union(shards.shuffled(docs.withColumn("epoch", F.lit(1)), "doc_id", 42, 1))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::BIGINT AS rank FROM documents")
def rank_shard(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.ordinal(_docs(spark, folder).select("doc_id"), "doc_id", "row").select("doc_id", shards.rank_of(F.col("row"), 4).alias("rank"))


@query("SELECT source_path, ((row_number() OVER (ORDER BY source_path) - 1) // 8)::BIGINT AS chunk_id, lines FROM (SELECT source_path, count(*) AS lines FROM corpus_lines GROUP BY source_path)")
def file_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Files in chunks of eight, in path order; paths are few beside their lines."""
    files = table(spark, folder, "corpus_lines").groupBy("source_path").agg(F.count("*").alias("lines"))
    row = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_path")) - 1
    return files.withColumn("chunk_id", F.floor(row / 8)).select("source_path", "chunk_id", "lines")


# --- resume and checks --------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT source_path, concat_ws('|', source_path, count(*), max(line_id)) AS signature FROM corpus_lines GROUP BY source_path),
p AS (SELECT source_path, concat_ws('|', source_path, count(*), max(line_id)) AS stored FROM corpus_lines WHERE text IS NOT NULL AND source_path NOT LIKE '%1.json' GROUP BY source_path)
SELECT f.source_path, CASE WHEN stored IS NULL THEN 'new' WHEN stored = signature THEN 'reuse' ELSE 'redo' END AS action FROM f LEFT JOIN p ON f.source_path = p.source_path""")
def part_reuse_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Files against the parts of an earlier run, which saw no null lines and no files that end in 1."""
    lines = table(spark, folder, "corpus_lines")
    signed = lambda df: df.groupBy("source_path").agg(F.count("*").alias("size"), F.max("line_id").alias("stamp")).select("source_path", resume.signature("source_path", "size", "stamp").alias("signature"))
    return resume.reuse_plan(signed(lines), signed(lines.where("text is not null and source_path not like '%1.json'")))


@query(f"WITH {_PARTS_SQL} SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM n) AS part_tokens, (SELECT coalesce(sum(num_tokens), 0)::BIGINT FROM s) AS shard_tokens, (SELECT sum(n) FROM n) = (SELECT sum(num_tokens) FROM s) AS agree")
def token_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return resume.reconciled(_sizes(spark, folder), _shards(spark, folder))


@query(f"""WITH {_STREAM_CTE} SELECT printf('train_%06d.bin', pos // {SHARD}) AS file, count(*) AS num_tokens, sum(id)::BIGINT AS id_sum, sum(id * (pos % {SHARD} + 1))::BIGINT AS placed_sum, true AS whole FROM p GROUP BY ALL""")
def bin_shard_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Token shards written as files, listed against their manifest, and read again in slices."""
    out = urlparse(scratch_folder(spark, "shards")).path  # raw files need a mounted folder
    dtype = token_dtype(len(_model(spark, folder)[0]))
    written = write_shards(shards.cut_to_shards(scratch(_coded(spark, folder), "coded"), SHARD), out, dtype)
    os.makedirs(out, exist_ok=True)
    write_manifest(f"{out}/meta.json", [(f"train_{r.shard_id:06d}.bin", r.num_tokens) for r in written.collect()], dtype=dtype)
    at = F.transform("tokens", lambda v, i: v * (F.col("begin") + i + 1))
    total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v))
    back = read_shards(spark, f"file://{out}", dtype).groupBy("file").agg(F.sum(F.size("tokens")).alias("num_tokens"), total("tokens").alias("id_sum"), total(at).alias("placed_sum"))
    listed = listed_shards(read_manifest(spark, f"{out}/meta.json"), shard_files(spark, f"file://{out}")).select("file", F.col("num_tokens").alias("said"), "whole")
    return scratch(back.join(listed, "file").select("file", "num_tokens", "id_sum", "placed_sum", (F.col("whole") & (F.col("said") == F.col("num_tokens"))).alias("whole")), "shards")


@query(f"WITH {_WORDS_SQL} SELECT coalesce(sum(freq), 0)::BIGINT AS words, count(*) AS unique_words, count(*) FILTER (freq >= 5) AS training_words FROM c")
def vocabulary_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return wordcount.vocabulary_sizes(_docs(spark, folder), 5)


@query(f"""WITH f AS (SELECT source_path, count(*) FILTER (length(text) >= {LEAST}) AS docs, count(*) FILTER (text IS NULL OR length(text) < {LEAST}) AS skipped, coalesce(sum(len({_PIECES})) FILTER (length(text) >= {LEAST}), 0)::BIGINT AS tokens FROM corpus_lines GROUP BY source_path)
SELECT count(*) AS parts, coalesce(sum(docs), 0)::BIGINT AS docs, coalesce(sum(skipped), 0)::BIGINT AS skipped, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(*) FILTER (source_path LIKE '%1.json') AS reused FROM f""")
def part_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over the parts of a run, one for a file."""
    good = F.coalesce(F.length("text") >= LEAST, F.lit(False))
    by = table(spark, folder, "corpus_lines").groupBy("source_path").agg(F.count_if(good).alias("docs"), F.count_if(~good).alias("skipped"), F.sum(F.when(good, F.size(pieces(F.col("text"))))).alias("tokens"))
    return resume.part_totals(by.withColumn("reused", F.col("source_path").like("%1.json")))


# --- formulas -------------------------------------------------------------------------------------------


@query("""
SELECT i AS iter, round(CASE WHEN i < 2000 THEN 6e-4 * (i + 1) / 2000.0 WHEN i > 18000 THEN 6e-5 ELSE 6e-5 + 0.5 * (1 + cos(pi() * (i - 2000) / 16000.0)) * (6e-4 - 6e-5) END, 10)::DOUBLE AS lr
FROM range(0, 20001, 100) t(i)""")
def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(0, 20001, 100).select(F.col("id").alias("iter"), F.round(metrics.learning_rate(F.col("id"), 6e-4, 6e-5, 2000, 18000), 10).alias("lr"))


@query("""
WITH e AS (SELECT event_type AS checkpoint, value / 50 AS loss, user_id % 16 + 1 AS n FROM events WHERE value IS NOT NULL)
SELECT checkpoint, round(sum(loss * n) / greatest(sum(n), 1), 6)::DOUBLE AS val_loss, sum(n)::BIGINT AS eval_rows, round(avg(loss), 6)::DOUBLE AS plain_loss, round(exp(least(sum(loss * n) / greatest(sum(n), 1), 30)), 4)::DOUBLE AS ppl FROM e GROUP BY checkpoint""")
def weighted_eval_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("value is not null").select(F.col("event_type").alias("checkpoint"), (F.col("value") / 50).alias("loss"), (F.col("user_id") % 16 + 1).alias("n"))
    out = metrics.weighted_loss(rows, "checkpoint", "loss", "n")
    return out.select("checkpoint", F.round("val_loss", 6).alias("val_loss"), "eval_rows", F.round("plain_loss", 6).alias("plain_loss"), F.round("ppl", 4).alias("ppl"))


@query("""
WITH e AS (SELECT event_type AS checkpoint, value / 50 AS loss, user_id % 16 + 1 AS n FROM events WHERE value IS NOT NULL)
SELECT checkpoint, round(sum(loss * n) / greatest(sum(n), 1), 6)::DOUBLE AS val_loss FROM e GROUP BY checkpoint ORDER BY sum(loss * n) / greatest(sum(n), 1), checkpoint LIMIT 1""")
def best_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_row(weighted_eval_loss(spark, folder), "val_loss", "checkpoint").select("checkpoint", "val_loss")


_NAMES = ("ckpt_10.pt", "ckpt_2.pt", "ckpt_last.pt", "ckpt_2_copy.pt", "notes.pt", "ckpt_100.pt", "ckpt_000030.pt")


@query(
    "WITH n AS (SELECT unnest(["
    + ",".join(f"'{x}'" for x in _NAMES)
    + "]) AS name), p AS (SELECT name, CASE WHEN name = 'ckpt_last.pt' THEN 'ckpt_100.pt' ELSE name END AS real_path FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY real_path ORDER BY name) AS k FROM p),\n"
    "i AS (SELECT name, real_path, try_cast(nullif(regexp_extract(name, 'ckpt_(\\d{1,18})', 1), '') AS BIGINT) AS iter_num FROM o WHERE k = 1)\n"
    "SELECT name, real_path, coalesce(iter_num, -1) AS iter_num, (row_number() OVER (ORDER BY coalesce(iter_num, 1000000000000000000), name))::INT AS place FROM i"
)
def checkpoint_catalog(spark: SparkSession, folder: str) -> DataFrame:
    paths = spark.createDataFrame([(n,) for n in _NAMES], "name string").withColumn("real_path", F.when(F.col("name") == "ckpt_last.pt", "ckpt_100.pt").otherwise(F.col("name")))
    return metrics.checkpoint_catalog(paths, 100).na.fill(-1, ["iter_num"])


@query("SELECT n AS layers, e AS width, (50000 * e + 2048 * e + n * (12 * e * e + 2 * e) + e)::BIGINT AS parameters FROM (VALUES (14::BIGINT, 640::BIGINT), (12, 768), (24, 1024)) t(n, e)")
def model_param_count(spark: SparkSession, folder: str) -> DataFrame:
    sizes = spark.createDataFrame([(14, 640), (12, 768), (24, 1024)], "layers bigint, width bigint")
    return sizes.withColumn("parameters", metrics.parameter_count(F.col("layers"), F.col("width"), F.lit(50000).cast("bigint"), F.lit(2048).cast("bigint")))


@query("SELECT t.token, coalesce(v.token_id, -1)::INT AS token_id FROM (SELECT unnest(['<unk>', '<bos>', '<eos>', '<pad>']) AS token) t LEFT JOIN vocab v ON t.token = v.token")
def special_token_resolve(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame([(t,) for t in special_tokens("<bos>, <eos>,,<pad>,<bos>")], "token string")
    return listed.join(table(spark, folder, "vocab"), "token", "left").select("token", F.coalesce("token_id", F.lit(-1)).alias("token_id"))


@query("""
SELECT event_type, printf('%02d:%02d:%02d', (s // 3600)::BIGINT, (s % 3600 // 60)::BIGINT, (s % 60)::BIGINT) AS elapsed, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS size
FROM (SELECT event_type, count(*) * 7 AS s, count(*) * 100 AS n FROM events GROUP BY event_type)""")
def format_progress(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("k"))
    return by.select("event_type", metrics.duration(F.col("k") * 7).alias("elapsed"), metrics.byte_size(F.col("k") * 100).alias("size"))


@query("""
WITH e AS (SELECT event_type, user_id % 10 AS step, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT event_type, step, round(v, 6)::DOUBLE AS loss FROM e),
b AS (SELECT *, min(loss) OVER (PARTITION BY event_type ORDER BY step) AS best, min(loss) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT event_type, step, loss, best, before IS NULL OR loss < before AS improved FROM b""")
def running_best(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("value is not null").groupBy("event_type", (F.col("user_id") % 10).alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return metrics.running_best(rows, "event_type", "step", "loss")


@query("""
WITH e AS (SELECT event_type, count(*) AS done FROM events GROUP BY event_type), t AS (SELECT *, sum(done) OVER () AS total, done % 97 AS seconds FROM e)
SELECT event_type, round(100.0 * done / total, 6)::DOUBLE AS pct, round(CASE WHEN seconds > 0 THEN done / seconds ELSE 0 END, 6)::DOUBLE AS rate,
  CASE WHEN seconds > 0 THEN printf('%02d:%02d:%02d', (s // 3600)::BIGINT, (s % 3600 // 60)::BIGINT, (s % 60)::BIGINT) ELSE '--:--:--' END AS eta
FROM (SELECT *, CASE WHEN seconds > 0 THEN floor((total - done) / (done / seconds))::BIGINT END AS s FROM t)""")
def progress_rates(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("done"))
    by = by.withColumn("total", F.sum("done").over(Window.partitionBy(F.lit(0)))).withColumn("seconds", F.col("done") % 97)  # a row for an event type
    pct, rate, eta = metrics.progress(F.col("done"), F.col("total"), F.col("seconds"))
    return by.select("event_type", F.round(pct, 6).alias("pct"), F.round(rate, 6).alias("rate"), eta.alias("eta"))


@query("SELECT micro, length, accumulate, world, micro * length * accumulate * world AS tokens FROM (VALUES (2::BIGINT, 2048::BIGINT, 16::BIGINT, 1::BIGINT), (4, 1024, 8, 2)) t(micro, length, accumulate, world)")
def tokens_per_iteration(spark: SparkSession, folder: str) -> DataFrame:
    sizes = spark.createDataFrame([(2, 2048, 16, 1), (4, 1024, 8, 2)], "micro bigint, length bigint, accumulate bigint, world bigint")
    return sizes.withColumn("tokens", metrics.tokens_per_iteration(*(F.col(c) for c in sizes.columns)))


# --- streaming ------------------------------------------------------------------------------------------


@query(f"WITH {_WORDS_SQL} SELECT raw AS word, freq FROM c")
def stream_word_count(spark: SparkSession, folder: str) -> DataFrame:
    """Micro-batches append partial counts; their sum is the batch answer."""
    base = scratch_folder(spark, "stream")
    streaming.incremental_counts(streaming.stream_documents(spark, folder, "documents"), f"{base}/out", f"{base}/state")
    return streaming.merged_counts(spark, f"{base}/out")


@query(_stats_sql("lang", "documents", LEAST, MOST))
def stream_stats_streamed(spark: SparkSession, folder: str) -> DataFrame:
    base = scratch_folder(spark, "stream")
    stream = streaming.stream_documents(spark, folder, "documents").select("lang", "text")
    return streaming.streamed_stats(stream, "lang", LEAST, MOST, f"stats_{os.urandom(4).hex()}", base)
