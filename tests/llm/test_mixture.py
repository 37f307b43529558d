from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscraft.llm import mixture


def brute(weights, most, seats):
    given_ = [0] * len(weights)
    for _ in range(seats):
        open_ = [k for k, w in enumerate(weights) if w > 0 and given_[k] < most[k]]
        if not open_:
            break
        best = max(open_, key=lambda k: (weights[k] / (2 * given_[k] + 1), -k))
        given_[best] += 1
    return given_


@given(st.lists(st.tuples(st.sampled_from([0.0, 1.0, 1.5, 2.0, 5.5, 30.0]), st.integers(0, 60)), max_size=7), st.integers(0, 120))
def test_apportionment_like_brute_force(parts, seats):
    weights, most = [w for w, _ in parts], [m for _, m in parts]
    assert mixture.apportion(weights, most, seats) == brute(weights, most, seats)


def test_mixtures(spark):
    codes = spark.createDataFrame([("en", "en"), ("English", "en"), ("zh", "zh"), ("ru", "ru")], "alias string, lang string")
    stats = spark.createDataFrame(
        [(1, 7, " ENGLISH", 100, 5.0), (1, 7, "en", 10, 1.0), (2, 7, "zh", 1000, 1.0), (3, 7, "junk", 50, 1.0), (4, 8, "ru", 9, 1.0), (5, 7, None, 5, 1.0)],
        "stat_id bigint, run_id bigint, language string, emitted_chars bigint, finished_at double",
    )
    plan = spark.createDataFrame(
        [(1, 7, "en", 50.0, 2, 1000, 0), (1, 7, "en", 50.0, 2, 1000, 0), (1, 7, "zh", 50.0, 1, 1000, 0), (2, 8, "ru", 1.0, 3, 20, 0), (2, 8, "zh", 1.0, 3, 20, 0), (3, 7, None, 1.0, 1, 10, 0), (4, 7, "en", None, 1, 10, 0)],
        "mix_id bigint, run_id bigint, language string, target_weight double, max_passes int, total_chars bigint, available bigint",
    )
    got = {(r.mix_id, r.language): r for r in mixture.mixtures(plan, stats, codes).collect()}
    assert set(got) == {(1, "en"), (1, "zh"), (2, "ru"), (2, "zh")}
    assert {k for k, r in got.items() if r.short} == {(1, "en"), (2, "zh")}
    assert (got[1, "en"].quota, got[1, "zh"].quota) == (800, 3200)  # what en cannot take goes on to zh
    assert got[2, "zh"].available_chars == 0 and got[2, "zh"].quota == 0
    quotas = mixture.shard_quotas(mixture.mixtures(plan, stats, codes), stats, codes)
    spread = {(r.mix_id, r.language): r for r in quotas.groupBy("mix_id", "language").agg(F.sum("quota").alias("n"), F.max("shard_blocks").alias("b")).collect()}
    assert {k: r.n for k, r in spread.items()} == {k: r.quota for k, r in got.items() if r.quota}
    assert spread[1, "zh"].b == 4000 and spread[2, "ru"].b == 1800
    assert mixture.mixtures(plan.limit(0), stats.limit(0), codes).count() == 0
    assert mixture.mixtures(plan, stats, codes.limit(0)).count() == 0


def test_shards_and_records(spark):
    codes = spark.createDataFrame([("en", "en")], "alias string, lang string")
    sizes = {1: 4000, 2: 2500, 3: 700, 4: 20}
    stats = spark.createDataFrame([(k, 1, "en", n, 1.0) for k, n in sizes.items()], "stat_id bigint, run_id bigint, language string, emitted_chars bigint, finished_at double")
    rows = [(1000 * k + j, k, "x" * 20) for k, n in sizes.items() for j in range(n // 20)] + [(9001, 1, "short"), (9002, 1, None), (1001, 1, "x" * 20), (None, 1, "x" * 30)]
    records = spark.createDataFrame(rows, "row_id bigint, stat_id bigint, text string").selectExpr("*", "7 as copies", "'zz' as language")
    plan = spark.createDataFrame([(1, 1, "en", 1.0, 2, 10000), (2, 1, "en", 1.0, 9, 2000)], "mix_id bigint, run_id bigint, language string, target_weight double, max_passes int, total_chars bigint")
    mixed = mixture.mixtures(plan, stats, codes, 100)
    quotas = mixture.shard_quotas(mixed, stats, codes, 100)
    seats = {(r.mix_id, r.stat_id): r.quota for r in quotas.collect()}
    for mix in (1, 2):
        want = brute([float(n) for n in sizes.values()], [10**6] * 4, 100)
        assert [seats.get((mix, k), 0) for k in sizes] == want
    got = mixture.mixed_records(quotas, records, 100).collect()
    assert len({(r.mix_id, r.row_id) for r in got}) == len(got) and {r.language for r in got} == {"en"}
    chars = {m: sum(r.chars * r.copies for r in got if r.mix_id == m) for m in (1, 2)}
    assert abs(chars[1] - 10000) <= 300 and abs(chars[2] - 2000) <= 100
    assert {r.copies for r in got if r.mix_id == 1} == {1, 2} and {r.copies for r in got if r.mix_id == 2} == {1}
    assert sorted(got) == sorted(mixture.mixed_records(quotas, records.repartition(3), 100).collect())
    assert mixture.mixed_records(quotas, records.limit(0), 100).count() == 0
    assert mixture.mixed_records(quotas.limit(0), records, 100).count() == 0
