"""Problem 7: mixing sources to target weights.

A mixture wants shares of a total size from the languages of one run. The total is cut
into ``BLOCKS`` equal blocks; Sainte-Laguë apportionment gives each language blocks by the
highest quotients w / 1, w / 3, w / 5, ... up to what ``max_passes`` passes over its
material hold, and blocks that a full language cannot take go on to the next quotients.
A language is short if the blocks it would get without that limit exceed the limit: the
quotas say which languages come near it, and of those exact arithmetic decides.

A language's blocks are apportioned over its shards (statistics) in the same way, weighted
by their characters, so each shard has an integer quota of blocks. A shard's rows, in the
order of their ids, are cut into blocks of the same size (the last may be smaller); a
quota takes every block as often as it holds the whole shard, and the rest in a seeded
order. The records of the blocks taken, with how often each is read, are the mixture.

The languages of one mixture are few by nature (the list of languages). Shards, blocks and
records stay distributed: quotas come from ranked quotients near each shard's exact share
(a handful a shard), positions from range sums.

Defined results: of a statistic repeated by ``stat_id`` the row with the greatest
``finished_at`` counts, exact duplicate rows of the plan count once, aliases of one
language in one mixture add up (their passes: the greatest), labels that name no
language and null weights get nothing, a language without material has 0; a redelivered
record counts once, texts outside the statistic's limits hold no characters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.corpus import ordinal
from ..session import prepare, scratch, table
from .tokens import label_language, latest

BLOCKS = 4000  # blocks that a mixture is cut into
MIN_CHARS, MAX_CHARS = 20, 1200  # of a record, as its statistic counted them


def apportion(weights: list[float], most: list[int], seats: int) -> list[int]:
    """Sainte-Laguë quotas with an upper limit each; ties go to the earlier entry.

    The seats up to half a block short of proportion are given at once, the rest by quotient.
    """
    given = [0] * len(weights)
    total = sum(w for w in weights if w > 0)
    if total <= 0:
        return given
    for k, w in enumerate(weights):  # every entry has these seats in any case
        given[k] = max(0, min(most[k], int(seats * w / total - len(weights) / 2))) if w > 0 else 0
    heap = [(-w / (2 * given[k] + 1), k) for k, w in enumerate(weights) if w > 0 and given[k] < most[k]]
    heapq.heapify(heap)
    left = seats - sum(given)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        given[k] += 1
        left -= 1
        if given[k] < most[k]:
            heapq.heappush(heap, (-weights[k] / (2 * given[k] + 1), k))
    return given


def material(stats: DataFrame, codes: DataFrame) -> DataFrame:
    """``run_id, language, stat_id, emitted_chars`` of the statistics that count."""
    valid = latest(stats.select("stat_id", "finished_at", "run_id", "language", "emitted_chars"), "stat_id", "finished_at")
    return valid.select("run_id", label_language(F.col("language"), codes).alias("language"), "stat_id", F.coalesce("emitted_chars", F.lit(0)).alias("emitted_chars")).where("language is not null")


def mixtures(plan: DataFrame, stats: DataFrame, codes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``mix_id, run_id, language, wanted_share, wanted_chars, available_chars, max_passes, quota`` (blocks),
    ``passes, reached_chars, reached_share`` (of the total size), ``short`` (whether the wanted characters exceed what
    ``max_passes`` passes hold) and ``total_chars``.

    Sainte-Laguë quotas stray from the exact ones by at most (1 + entries) / 2 seats, so a language whose unlimited quota
    stays that far below its limit is not short; the others are compared exactly."""
    prepare(plan.sparkSession)
    wanted = (
        plan.select("mix_id", "run_id", "language", "target_weight", "max_passes", "total_chars")
        .distinct()
        .withColumn("language", label_language(F.col("language"), codes))
        .where("mix_id is not null and language is not null and target_weight is not null")
        .groupBy("mix_id", "run_id", "language")
        .agg(F.sum("target_weight").alias("weight"), F.max("max_passes").alias("max_passes"), F.max("total_chars").alias("total_chars"))
    )
    have = material(stats, codes).groupBy("run_id", "language").agg(F.sum("emitted_chars").alias("available"))
    rows = wanted.join(have, ["run_id", "language"], "left").na.fill(0, ["available", "max_passes", "total_chars"])
    mixes = rows.groupBy("mix_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("language", "weight", "max_passes", "total_chars", "available"))).alias("parts"))
    schema = (
        "mix_id bigint, run_id bigint, language string, wanted_share double, wanted_chars double, available_chars bigint, max_passes int, quota bigint, "
        "passes double, reached_chars bigint, reached_share double, short boolean, total_chars bigint"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            out: list[tuple] = []
            for mix, run_id, parts in zip(*(got.column(c).to_pylist() for c in range(3)), strict=True):
                weights = [max(0.0, p["weight"]) for p in parts]
                sum_of = sum(weights)
                total = max(p["total_chars"] for p in parts)
                limit = [p["max_passes"] * p["available"] for p in parts]
                free = apportion(weights, [blocks] * len(parts), blocks if total > 0 else 0)
                quota = apportion(weights, [m * blocks // total if total > 0 else 0 for m in limit], blocks if total > 0 else 0)
                for p, w, q, f, m in zip(parts, weights, quota, free, limit, strict=True):
                    near = total > 0 and (2 * f + len(parts) + 1) * total >= 2 * m * blocks
                    share = w / sum_of if sum_of > 0 else 0.0
                    reached = q * total // blocks
                    out.append(
                        (mix, run_id, p["language"], share, share * total, p["available"], p["max_passes"], q,
                         reached / p["available"] if p["available"] else 0.0, reached, reached / total if total > 0 else 0.0, near and share * total > m, total)
                    )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=names)

    return mixes.mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()]


def shard_quotas(mixed: DataFrame, stats: DataFrame, codes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``mix_id, run_id, language, stat_id, shard_blocks`` (blocks in one pass over the shard), ``quota`` (blocks to read,
    repeats included) and ``total_chars``.

    Sainte-Laguë over the shards of a language, weighted by characters, at most ``max_passes`` passes each. Only quotients
    within the method's greatest distance of a shard's exact share are ranked; the seats below them are certain.
    """
    have = material(stats, codes).where("emitted_chars > 0")
    size = have.groupBy("run_id", "language").agg(F.count("*").alias("n"))
    rows = mixed.where("quota > 0").select("mix_id", "run_id", "language", F.col("quota").alias("seats"), "max_passes", "total_chars", "available_chars")
    rows = rows.join(size, ["run_id", "language"]).join(have, ["run_id", "language"])
    rows = rows.withColumn("shard_blocks", F.expr(f"(emitted_chars * {blocks} + total_chars - 1) div total_chars"))
    share = F.col("emitted_chars") / F.col("available_chars")
    exact, slack, cap = share * F.col("seats"), 0.5 + share * F.col("n"), F.col("shard_blocks") * F.col("max_passes")
    rows = rows.withColumn("low", F.greatest(F.lit(0), F.least(cap, F.floor(exact - slack)))).withColumn("high", F.greatest("low", F.least(cap, F.ceil(exact + slack) + 1)))
    certain = rows.groupBy("mix_id", "language").agg(F.sum("low").alias("sure"))
    offers = rows.where("high > low").join(certain, ["mix_id", "language"]).select("mix_id", "language", "stat_id", "emitted_chars", (F.col("seats") - F.col("sure")).alias("left"), F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    order = Window.partitionBy("mix_id", "language").orderBy(F.desc(F.col("emitted_chars") / (2 * F.col("k") + 1)), "stat_id", "k")
    taken = offers.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.col("left")).groupBy("mix_id", "language", "stat_id").agg(F.count("*").alias("won"))
    quota = F.col("low") + F.coalesce("won", F.lit(0))
    return rows.join(taken, ["mix_id", "language", "stat_id"], "left").select("mix_id", "run_id", "language", "stat_id", "shard_blocks", quota.alias("quota"), "total_chars").where("quota > 0")


def mixed_records(quotas: DataFrame, records: DataFrame, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """``mix_id, language, stat_id, row_id, chars, copies``: the records of a mixture and how often each is read.

    A record belongs to the block in which it begins. ``quotas`` is what ``shard_quotas`` gives.
    """
    size = F.length("text")
    once = records.where("row_id is not null and stat_id is not null").groupBy("row_id").agg(F.min("stat_id").alias("stat_id"), F.min(F.when(size >= MIN_CHARS, F.least(size, F.lit(MAX_CHARS)))).alias("chars"))
    once = once.where("chars is not null").withColumn("chars", F.col("chars").cast("bigint"))
    placed = ordinal(once, "row_id", "before", F.col("chars"), by=("stat_id",))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), "mix_id", "stat_id", "block"))
    order = Window.partitionBy("mix_id", "stat_id").orderBy(drawn, "block")
    picks = quotas.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shard_blocks") - 1))).withColumn("rn", F.row_number().over(order))
    copies = F.expr("quota div shard_blocks") + F.when(F.col("rn") <= F.expr("quota % shard_blocks"), 1).otherwise(0)
    picks = picks.select("mix_id", "stat_id", "block", copies.alias("copies")).where("copies > 0")
    at = placed.join(quotas.select("mix_id", "language", "stat_id", "shard_blocks", "total_chars"), "stat_id")
    at = at.withColumn("block", F.least(F.col("shard_blocks") - 1, F.expr(f"before * {blocks} div total_chars")))
    return at.join(picks, ["mix_id", "stat_id", "block"]).select("mix_id", "language", "stat_id", "row_id", "chars", "copies")


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixtures(table(spark, folder, "mix_plan"), table(spark, folder, "stream_stats"), table(spark, folder, "lang_codes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).where("short").select("mix_id", "language")


def p7_quotas(spark: SparkSession, folder: str) -> DataFrame:
    rounded = ("wanted_share", "wanted_chars", "passes", "reached_share")
    mixed = _mixed(spark, folder)
    return mixed.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in mixed.columns])


def _quotas(spark: SparkSession, folder: str) -> DataFrame:
    mixed = scratch(_mixed(spark, folder), "mixed")
    return shard_quotas(mixed, table(spark, folder, "stream_stats"), table(spark, folder, "lang_codes"))


def p7_shards(spark: SparkSession, folder: str) -> DataFrame:
    return _quotas(spark, folder).select("mix_id", "language", "stat_id", "shard_blocks", "quota")


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_records(scratch(_quotas(spark, folder), "quotas"), table(spark, folder, "stream_rows"))


def p7_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Per mixture and language: records taken, times read, characters read and their share of the characters of the mixture's
    records."""
    by = p7_records(spark, folder).groupBy("mix_id", "language").agg(F.count("*").alias("records"), F.sum("copies").alias("reads"), F.sum(F.col("chars") * F.col("copies")).alias("chars"))
    return by.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy("mix_id")), 6))


_SHARES_SQL = """
WITH plan AS (SELECT DISTINCT mix_id, run_id, language, target_weight, max_passes, total_chars FROM mix_plan WHERE mix_id IS NOT NULL AND target_weight IS NOT NULL),
named AS (
  SELECT p.mix_id, p.run_id, c.lang AS language, sum(p.target_weight) AS weight, max(p.max_passes) AS max_passes, max(p.total_chars) AS total_chars
  FROM plan p JOIN lang_codes c ON lower(trim(p.language)) = lower(trim(c.alias)) GROUP BY ALL),
valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stat_id ORDER BY finished_at DESC) AS rn FROM stream_stats) WHERE rn = 1),
have AS (SELECT v.run_id, c.lang AS language, sum(v.emitted_chars) AS available FROM valid v JOIN lang_codes c ON lower(trim(v.language)) = lower(trim(c.alias)) GROUP BY ALL),
shares AS (
  SELECT n.mix_id, n.run_id, n.language, weight, max_passes, max(total_chars) OVER m AS total, weight / sum(weight) OVER m AS share, coalesce(available, 0)::BIGINT AS available
  FROM named n LEFT JOIN have h ON n.run_id = h.run_id AND n.language = h.language WINDOW m AS (PARTITION BY n.mix_id, n.run_id))
"""

P7_FOUND_SQL = _SHARES_SQL + "SELECT mix_id, language FROM shares WHERE share * total > max_passes * available"

# The apportionment as a ranking: a mixture's greatest quotients, of which a language offers as many as it may have.
P7_QUOTAS_SQL = (
    _SHARES_SQL
    + f""",
offers AS (SELECT mix_id, run_id, language, weight / (2 * k + 1) AS quotient, k FROM (SELECT *, unnest(range(least({BLOCKS}, max_passes * available * {BLOCKS} // total)::BIGINT)) AS k FROM shares WHERE total > 0)),
taken AS (SELECT mix_id, run_id, language, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY mix_id, run_id ORDER BY quotient DESC, language, k) AS rn FROM offers) WHERE rn <= {BLOCKS} GROUP BY ALL),
out AS (SELECT s.*, coalesce(quota, 0)::BIGINT AS quota, (coalesce(quota, 0) * total // {BLOCKS})::BIGINT AS reached_chars FROM shares s LEFT JOIN taken t ON s.mix_id = t.mix_id AND s.run_id = t.run_id AND s.language = t.language)
SELECT mix_id, run_id, language, round(share, 6) AS wanted_share, round(share * total, 6) AS wanted_chars, available AS available_chars, max_passes, quota,
  round(CASE WHEN available > 0 THEN reached_chars / available ELSE 0 END, 6)::DOUBLE AS passes, reached_chars, round(CASE WHEN total > 0 THEN reached_chars / total ELSE 0 END, 6)::DOUBLE AS reached_share,
  share * total > max_passes * available AS short, total AS total_chars
FROM out"""
)

# The seats of every shard by ranking all quotients.
_SHARDS_CTE = (
    _SHARES_SQL
    + f""",
offers AS (SELECT mix_id, run_id, language, weight / (2 * k + 1) AS quotient, k FROM (SELECT *, unnest(range(least({BLOCKS}, max_passes * available * {BLOCKS} // total)::BIGINT)) AS k FROM shares WHERE total > 0)),
taken AS (SELECT mix_id, run_id, language, count(*) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY mix_id, run_id ORDER BY quotient DESC, language, k) AS rn FROM offers) WHERE rn <= {BLOCKS} GROUP BY ALL),
parts AS (SELECT v.run_id, v.stat_id, v.emitted_chars, c.lang AS language FROM valid v JOIN lang_codes c ON lower(trim(v.language)) = lower(trim(c.alias)) WHERE v.emitted_chars > 0),
held AS (
  SELECT t.mix_id, t.run_id, t.language, p.stat_id, p.emitted_chars, t.seats, s.total, s.max_passes, ((p.emitted_chars * {BLOCKS} + s.total - 1) // s.total)::BIGINT AS shard_blocks
  FROM taken t JOIN shares s ON t.mix_id = s.mix_id AND t.run_id = s.run_id AND t.language = s.language JOIN parts p ON p.run_id = t.run_id AND p.language = t.language),
bids AS (SELECT *, unnest(range(least(seats, shard_blocks * max_passes)::BIGINT)) AS k FROM held),
won AS (SELECT *, row_number() OVER (PARTITION BY mix_id, language ORDER BY emitted_chars / (2 * k + 1) DESC, stat_id, k) AS rn FROM bids),
quotas AS (SELECT mix_id, language, stat_id, shard_blocks, any_value(total) AS total, count(*) AS quota FROM won WHERE rn <= seats GROUP BY ALL)"""
)

P7_SHARDS_SQL = _SHARDS_CTE + "SELECT mix_id, language, stat_id, shard_blocks, quota FROM quotas"

_RECORDS_CTE = (
    _SHARDS_CTE
    + f""",
once AS (SELECT row_id, min(stat_id) AS stat_id, least(min(length(text)), {MAX_CHARS})::BIGINT AS chars FROM stream_rows WHERE stat_id IS NOT NULL AND length(text) >= {MIN_CHARS} GROUP BY row_id),
placed AS (SELECT *, (sum(chars) OVER (PARTITION BY stat_id ORDER BY row_id) - chars)::BIGINT AS before FROM once),
drawn AS (SELECT *, row_number() OVER (PARTITION BY mix_id, stat_id ORDER BY md5(concat_ws('|', '7', mix_id, stat_id, block)), block) AS rn FROM (SELECT *, unnest(range(shard_blocks)) AS block FROM quotas)),
picks AS (SELECT mix_id, stat_id, block, quota // shard_blocks + CASE WHEN rn <= quota % shard_blocks THEN 1 ELSE 0 END AS copies FROM drawn),
records AS (
  SELECT q.mix_id, q.language, q.stat_id, p.row_id, p.chars, k.copies::BIGINT AS copies FROM placed p JOIN quotas q ON p.stat_id = q.stat_id
  JOIN picks k ON k.mix_id = q.mix_id AND k.stat_id = q.stat_id AND k.block = least(q.shard_blocks - 1, p.before * {BLOCKS} // q.total) WHERE copies > 0)"""
)

P7_RECORDS_SQL = _RECORDS_CTE + "SELECT * FROM records"

P7_REACHED_SQL = (
    _RECORDS_CTE
    + """, by_language AS (SELECT mix_id, language, count(*) AS records, sum(copies)::BIGINT AS reads, sum(chars * copies)::BIGINT AS chars FROM records GROUP BY ALL)
SELECT *, round(chars / sum(chars) OVER (PARTITION BY mix_id), 6)::DOUBLE AS share FROM by_language"""
)
