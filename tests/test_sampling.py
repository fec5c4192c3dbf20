"""R1/R2/R3 invariants: quotas, distinct draws, exclusions, partition independence, uniformity."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ctxmix.operators import sampling as SM


def sample(spark, n_pool=200, n_req=40, need=5, excl=None, parts=8):
    pool_df = spark.range(0, n_pool).select((F.col("id") * 3).alias("doc_id")).repartition(parts)
    pool = SM.lay_out(pool_df, ["doc_id"])
    req = spark.range(0, n_req).select(F.col("id").alias("qid"), F.lit(need).alias("need"))
    return SM.sample_without_replacement(req, pool, keys=["qid"], exclude=excl), pool.size


def test_dense_index(spark):
    pool_df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("doc_id")).repartition(5)
    pool, n = SM.dense_index(pool_df, ["doc_id"])
    rows = pool.collect()
    assert n == 1000 and sorted(r["idx"] for r in rows) == list(range(1000))
    assert all(r["idx"] == r["doc_id"] for r in rows)


def test_quota_distinct_and_exclusions(spark):
    excl = spark.range(0, 40).select(F.col("id").alias("qid"), F.lit(0).cast("long").alias("doc_id"))
    got, _ = sample(spark, excl=excl)
    rows = got.collect()
    per = Counter(r["qid"] for r in rows)
    assert set(per.values()) == {5}
    assert len({(r["qid"], r["doc_id"]) for r in rows}) == len(rows)
    assert all(r["doc_id"] != 0 for r in rows)


def test_small_pool_takes_all_available(spark):
    got, _ = sample(spark, n_pool=4, n_req=3, need=10)
    per = Counter(r["qid"] for r in got.collect())
    assert set(per.values()) == {4}


def test_partition_independent(spark):
    a, _ = sample(spark, parts=1)
    b, _ = sample(spark, parts=13)
    key = lambda df: sorted((r["qid"], r["draw"], r["doc_id"]) for r in df.collect())
    assert key(a) == key(b)


def test_roughly_uniform(spark):
    got, _ = sample(spark, n_pool=20, n_req=2000, need=1)
    c = Counter(r["doc_id"] for r in got.collect())
    assert len(c) == 20 and max(c.values()) < 2.0 * min(c.values())


def test_shuffle_positions_are_a_permutation(spark):
    ctx = spark.range(0, 50).select((F.col("id") % 5).alias("qid"), F.lit("r").alias("role"),
                                    F.col("id").alias("ord"))
    out = SM.shuffle_contexts(ctx, ["qid"], ["role", "ord"]).collect()
    by = {}
    for r in out:
        by.setdefault(r["qid"], []).append(r["position"])
    assert all(sorted(v) == list(range(1, 11)) for v in by.values())


def test_exclude_docs_and_exclusion_set(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "qid int, doc_id int")
    gold = spark.createDataFrame([(1, 10)], "qid int, doc_id int")
    used = spark.createDataFrame([(1, 10), (2, 10)], "qid int, doc_id int")
    ex = SM.exclusion_set(gold, used)
    assert ex.count() == 2
    assert [(r["qid"], r["doc_id"]) for r in SM.exclude_docs(rows, ex, ["qid"]).collect()] == [(1, 11)]


def test_fully_excluded_pool_terminates_empty(spark):
    pool_df = spark.range(0, 5).select(F.col("id").alias("doc_id"))
    pool = SM.lay_out(pool_df, ["doc_id"])
    req = spark.createDataFrame([(1, 3), (2, 3)], "qid long, need int")
    excl = spark.range(0, 5).select(F.lit(1).cast("long").alias("qid"), F.col("id").alias("doc_id"))
    got = SM.sample_without_replacement(req, pool, keys=["qid"], exclude=excl).collect()
    assert {r["qid"] for r in got} == {2}
    assert len(got) == 3


def plain_hash(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain_place(j, n, seed, *keys):
    """The definition, one number at a time."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(j, b)
        for r in range(4):
            if r % 2:
                right = (right + plain_hash(seed, *keys, r, left)) % b
            else:
                left = (left + plain_hash(seed, *keys, r, right)) % a
        j = left * b + right
        if j < n:
            return j


def test_permutation_of_any_size(spark):
    sizes = [1, 2, 3, 5, 10, 17, 63, 64, 65, 250]
    rows = spark.createDataFrame([(n, j) for n in sizes for j in range(n)], "n long, j long").withColumns({"a": F.lit("a"), "b": F.lit("b")})
    got = SM.with_permuted(SM.with_permuted(rows, "j", "x", "n", 7, ["a"]), "j", "y", "n", 7, ["b"]).collect()
    for n in sizes:
        own = [r for r in got if r["n"] == n]
        assert sorted(r["x"] for r in own) == sorted(r["y"] for r in own) == list(range(n))
        assert all(r["x"] == plain_place(r["j"], n, 7, "a") for r in own)
        assert n < 10 or [r["x"] for r in own] != [r["y"] for r in own]


def test_draw_ranges(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 4094, 4099), (3, 10**7 - 2, 10**7 + 4098)], "k long, lo long, hi long")
    got = {}
    for r in SM._draws(rows, ["k"]).collect():
        got.setdefault(r["k"], []).append(r["j"])
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(5)), 2: list(range(4094, 4099)), 3: list(range(10**7 - 2, 10**7 + 4098))}


def test_groups_and_rows_excluded(spark):
    pool = SM.lay_out(spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, F.col("id") % 10).alias("g")), ["doc_id"], "g")
    req = spark.createDataFrame([(q, v, 50) for q in range(4) for v in range(2)], "qid long, v int, need int")
    banned = [(1, 0), (1, 1), (2, 3), (3, 77)] + [(0, g) for g in range(9)]
    used = [(1, 0, 10), (1, 0, 12), (0, 1, 9), (2, 1, 3), (2, 1, 4), (9, 9, 9)]
    got = SM.sample_without_replacement(req, pool, keys=["qid", "v"], exclude=spark.createDataFrame(used, "qid long, v int, doc_id long"),
                                        exclude_groups=spark.createDataFrame(banned + banned[:2], "qid long, g long")).collect()
    # every request against every row, in the pool's order: group (nulls first), then id
    group = lambda d: d % 10 if d % 10 < 9 else None
    order = sorted(range(90), key=lambda d: (group(d) is not None, group(d) or 0, d))
    for q in range(4):
        for v in range(2):
            free = [d for d in order if (q, group(d)) not in banned and (q, v, d) not in used]
            wanted = [free[plain_place(j, len(free), 42, q, v)] for j in range(min(50, len(free)))]
            assert [r["doc_id"] for r in sorted((r for r in got if (r["qid"], r["v"]) == (q, v)), key=lambda r: r["draw"])] == wanted


def test_draws_hit_available_rows_only(spark):
    """30 requests with 10 of 200,000 rows available, and one that may have nothing: 150 draws, all of them hits."""
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, 1).otherwise(0).cast("long").alias("g"))
    pool = SM.lay_out(rows, ["doc_id"], "g")
    req = spark.range(31).select(F.col("id").alias("qid"), F.lit(5).alias("need"))
    banned = spark.createDataFrame([(q, 0) for q in range(31)] + [(30, 1)], "qid long, g long")
    places = SM.draw_places(req, pool, keys=["qid"], exclude_groups=banned)
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3
    drawn = places.collect()
    assert len(drawn) == 150
    got = SM.sample_without_replacement(req, pool, keys=["qid"], exclude_groups=banned).collect()
    assert len(got) == 150 and {r["doc_id"] for r in got} == set(range(10)) and all(len({r["doc_id"] for r in got if r["qid"] == q}) == 5 for q in range(30))


def test_many_single_exclusions(spark):
    """A request that may have five rows only, the others named one by one."""
    pool = SM.lay_out(spark.range(5000).select(F.col("id").alias("doc_id")), ["doc_id"])
    req = spark.createDataFrame([(1, 9), (2, 2)], "qid long, need int")
    used = spark.range(5000).where("id % 1000 <> 7").select(F.lit(1).cast("long").alias("qid"), F.col("id").alias("doc_id"))
    got = SM.sample_without_replacement(req, pool, keys=["qid"], exclude=used).collect()
    assert sorted(r["doc_id"] for r in got if r["qid"] == 1) == [7, 1007, 2007, 3007, 4007] and sum(r["qid"] == 2 for r in got) == 2


@pytest.mark.parametrize("few", [0, 100])
def test_repeated_groups_are_not_broadcast(spark, tmp_path, monkeypatch, few):
    """Groups repeated for each salt and requests repeated for each variant stay out of the driver; only few groups, as they are, go there."""
    monkeypatch.setattr(SM, "_FEW", few, raising=False)
    spark.range(50).select(F.col("id").alias("qid")).write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    requests = asked.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("need", F.lit(2))
    pool = SM.lay_out(spark.range(400).select((F.col("id") % 50).alias("owner"), F.col("id").alias("doc_id")), ["owner", "doc_id"], "owner")
    part, = SM._intervals(pool, requests, ["variant", "qid"], None, ["doc_id"], asked.select("qid", F.col("qid").alias("owner")))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == (1 if few else 0)
    assert sorted((r.variant, r.qid, r.start, r.length) for r in part.collect()) == [(v, q, 8 * q, 8) for v in "ab" for q in range(50)]
    drawn = SM.sample_without_replacement(requests, pool, keys=["variant", "qid"], exclude_groups=asked.select("qid", F.col("qid").alias("owner")))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"BroadcastHashJoin \[(\w+)#", plan)) == ({"_pid", "owner"} if few else {"_pid"})
    assert drawn.count() == 200
