"""Problem 6: token budgets per source and language under an existing tokenizer.

Whole documents are hashed (128 bits) and copies collapse before anything is tokenized:
partial aggregation keeps one text a hash on each side of the exchange, so a hot group
of copies never travels. Each distinct text is tokenized once, by byte-level BPE over
the pieces of the whitespace pre-tokenizer; a task remembers the token counts of short
pieces, which recur. How often each text occurs in a group of rows (a shard; a source,
language and domain) is counted, so a text that a third of all rows hold is one row a group
where the token counts are joined to these multiplicities by hash and summed.

Defined results: a null text has null tokens, an empty one none; labels that name no
language count as ``und``, null sources and domains as null groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe_encode import Model, count_documents, counter, load_model
from ..plans.catalogue import DOC_TOKENS_CTE, WHITE_SQL
from ..session import prepare, scratch, table

def token_counts(docs: DataFrame, model: Model, by: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns ``by``, ``documents`` (rows with one text), ``tokens`` and ``blank`` of that text: a row for each distinct text in
    a group. Each distinct text is tokenized once. Null texts, which have no tokens, are one row a group."""
    prepare(docs.sparkSession)
    t = docs[text]
    marked = docs.select(*[c.alias(n) for n, c in by.items()], t.alias("_text"), F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(1), t).alias("_h2"))
    distinct = marked.where("_text is not null").groupBy("_h1", "_h2").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(model)
        for got in batches:
            texts = got.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [got.column(0), got.column(1), pa.array(encoder.counts(texts), pa.int64()), pa.array([not t.strip() for t in texts])], names=["_h1", "_h2", "tokens", "blank"]
            )

    counted = distinct.mapInArrow(run, "_h1 bigint, _h2 bigint, tokens bigint, blank boolean")
    many = marked.withColumn("_none", F.col("_text").isNull()).groupBy(*by, "_h1", "_h2", "_none").agg(F.count("*").alias("documents"))
    known = many.where("not _none").join(counted, ["_h1", "_h2"]).select(*by, "documents", "tokens", "blank")
    return known.union(many.where("_none").select(*by, "documents", F.lit(None).cast("bigint"), F.lit(True)))


def label_language(label: Column, codes: DataFrame) -> Column:
    """The language an alias names (without outer blanks, in any case), from the bounded table of aliases; else null."""
    rows = codes.select("alias", "lang").where("alias is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("that is not a table of language aliases")
    if not rows:
        return F.lit(None).cast("string")
    pairs = {r.alias.strip().lower(): r.lang for r in rows}
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return known[F.lower(F.trim(label))]


def latest(rows: DataFrame, key: str, stamp: str) -> DataFrame:
    """The row of each ``key`` that counts: the one with the greatest ``stamp`` (ties: the greatest row)."""
    others = [c for c in rows.columns if c not in (key, stamp)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(stamp), *others)).alias("_r"))
    return best.select(key, "_r.*")


def token_budget(docs: DataFrame, model: Model, codes: DataFrame) -> DataFrame:
    """``source, language, content_domain, documents, tokens``; nulls of a group stay null."""
    language = F.coalesce(label_language(docs["lang"], codes), F.lit("und"))
    counted = token_counts(docs, model, {"source": docs["source"], "language": language, "content_domain": docs["content_domain"]})
    return counted.groupBy("source", "language", "content_domain").agg(F.sum("documents").alias("documents"), F.coalesce(F.sum(F.col("documents") * F.col("tokens")), F.lit(0)).alias("tokens"))


def shard_audit(docs: DataFrame, model: Model, shards: DataFrame) -> DataFrame:
    """``shard_id, num_tokens, counted, wrong``: the valid count of a shard against the tokens of its documents, with
    one end token for each that is not null or blank; wrong if null or off by more than a tenth."""
    own = token_counts(docs.where(docs["shard_id"].isNotNull()), model, {"shard_id": docs["shard_id"]})
    own = own.groupBy("shard_id").agg(F.sum(F.when(F.col("blank"), 0).otherwise(F.col("documents") * (F.col("tokens") + 1))).alias("counted"))
    valid = latest(shards.select("shard_id", "num_tokens", "written_at"), "shard_id", "written_at")
    both = valid.join(own, "shard_id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    wrong = F.col("num_tokens").isNull() | (10 * F.abs(F.col("num_tokens") - F.col("counted")) > F.col("counted"))
    return both.select("shard_id", "num_tokens", "counted", wrong.alias("wrong"))


def _model(spark: SparkSession, folder: str) -> Model:
    return load_model(table(spark, folder, "vocab"), table(spark, folder, "merges"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return shard_audit(table(spark, folder, "documents"), _model(spark, folder), table(spark, folder, "shard_info")).where("wrong").select("shard_id")


def p6_budget(spark: SparkSession, folder: str) -> DataFrame:
    return token_budget(table(spark, folder, "documents"), _model(spark, folder), table(spark, folder, "lang_codes"))


# --- Problem 8 --------------------------------------------------------------------------------

CAPACITY = 2048
OPEN_BINS = 128
RUN_TOKENS = 1 << 28  # tokens that one packing task takes on average


class OpenBins:
    """Bounded-space online best fit: at most ``most`` open bins, found by free space in a bitset.

    Bit f of ``free`` is set while an open bin has f left. An item goes into the bin with the least space that
    suffices; without one a new bin opens, and if that is one too many, the fullest closes first.
    """

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free = 0
        self.bins: dict[int, list[int]] = {}
        self.open = self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)"""
        fit = self.free >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            which = self._take(left)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            which, left = self.next, self.capacity
            self.next += 1
        offset = self.capacity - left
        if left > size:
            self.bins.setdefault(left - size, []).append(which)
            self.free |= 1 << (left - size)
            self.open += 1
        return which, offset

    def _take(self, left: int) -> int:
        same = self.bins[left]
        which = same.pop()
        self.open -= 1
        if not same:
            self.free &= ~(1 << left)
        return which


def pack(sizes: DataFrame, capacity: int = CAPACITY, most: int = OPEN_BINS) -> DataFrame:
    """``container, doc_id, part, offset, size`` from ``doc_id, size``.

    Ranges of ids are packed side by side, each by one online pass; a range ends with at most ``most`` bins that are
    not full, and there is one range for about ``RUN_TOKENS`` tokens, so their waste does not count. Items of no size
    take no place. An item larger than the capacity fills whole containers and its rest is an item again.
    """
    prepare(sizes.sparkSession)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-total // RUN_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head = TaskContext.get().partitionId() << 32
        bins = OpenBins(capacity, most)
        for got in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc, size in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                part = 0
                while size > 0:
                    piece = min(size, capacity)
                    which, offset = bins.place(piece)
                    out.append((head | which, doc, part, offset, piece))
                    part, size = part + 1, size - piece
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["container", "doc_id", "part", "offset", "size"])

    items = sizes.where("doc_id is not null and size > 0").select("doc_id", F.col("size").cast("bigint").alias("size"))
    ordered = items.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "size")
    return ordered.mapInArrow(run, "container bigint, doc_id bigint, part bigint, offset bigint, size bigint")


def packed_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``pack`` of the documents by their tokens, counted where the documents are read; rows with the same id are packed as items of
    their own."""
    return pack(scratch(count_documents(docs, model).select("doc_id", F.col("n_tokens").alias("size")), "sizes"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that stand in several containers: only those larger than one."""
    return packed_documents(table(spark, folder, "documents"), _model(spark, folder)).where("part > 0").select("doc_id").distinct()


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share left empty, for all containers."""
    packed = packed_documents(table(spark, folder, "documents"), _model(spark, folder))
    by = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return by.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.round(1 - F.sum("used") / (F.count("*") * CAPACITY), 6).alias("empty_share"))


# --- SQL ----------------------------------------------------------------------------------------

_BLANK = f"regexp_full_match(text, '[{WHITE_SQL}\\x{{1C}}-\\x{{1F}}]*')"

P6_FOUND_SQL = f"""WITH {DOC_TOKENS_CTE},
valid AS (SELECT * FROM (SELECT shard_id, num_tokens, row_number() OVER (PARTITION BY shard_id ORDER BY written_at DESC, num_tokens DESC NULLS LAST) AS rn FROM shard_info WHERE shard_id IS NOT NULL) WHERE rn = 1),
own AS (SELECT shard_id, sum(CASE WHEN {_BLANK} THEN 0 ELSE n_tokens + 1 END) AS counted FROM documents JOIN doc_tokens USING (doc_id) WHERE shard_id IS NOT NULL GROUP BY shard_id)
SELECT v.shard_id FROM valid v LEFT JOIN own o ON v.shard_id = o.shard_id WHERE num_tokens IS NULL OR 10 * abs(num_tokens - coalesce(counted, 0)) > coalesce(counted, 0)"""

P6_BUDGET_SQL = f"""WITH {DOC_TOKENS_CTE}
SELECT source, coalesce(c.lang, 'und') AS language, content_domain, count(*) AS documents, coalesce(sum(n_tokens), 0)::BIGINT AS tokens
FROM documents d LEFT JOIN lang_codes c ON lower(trim(d.lang)) = lower(trim(c.alias)) LEFT JOIN doc_tokens t ON d.doc_id = t.doc_id GROUP BY ALL"""

P8_FOUND_SQL = f"WITH {DOC_TOKENS_CTE} SELECT doc_id FROM doc_tokens WHERE n_tokens > {CAPACITY}"
