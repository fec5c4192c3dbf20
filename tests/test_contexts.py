"""P2-P7, K4/K5, U1, A3, A4, J2-J4 on hand fixtures."""

import pytest
from pyspark.sql import functions as F

from ctxmix.operators import contexts as C


def test_quotas():
    got = [(v["n_keep"], v["n_noise"]) for v in C.ratio_variants([0, .25, .5, .75, 1], 5)]
    assert got == [(5, 0), (4, 1), (3, 2), (2, 3), (0, 5)]


def test_variant_quotas_column(spark):
    df = spark.createDataFrame([(0.25,), (0.75,)], "ratio double")
    got = [(r["n_keep"], r["n_noise"]) for r in C.variant_quotas(df, 5).collect()]
    assert got == [(4, 1), (2, 3)]


def ranked_fixture(spark):
    # ranked docs g1 h1 g2 h2 h3 (g = gold)
    rows = [(1, "g1", 1, True), (1, "h1", 2, False), (1, "g2", 3, True), (1, "h2", 4, False),
            (1, "h3", 5, False)]
    return spark.createDataFrame(rows, "qid int, doc_id string, rank int, is_gold boolean") \
        .withColumn("score", F.lit(1.0))


@pytest.mark.parametrize("ratio,mq,want", [
    (0.0, 0, {"g1", "g2"}), (0.0, 1, {"g1", "g2", "h1"}),
    (0.5, 0, {"g1", "g2", "h1", "h2"}), (0.5, 1, {"g1", "g2", "h1", "h2"}),
    (1.0, 0, {"h1", "h2", "h3"}), (1.0, 1, {"h1", "h2", "h3", "g1"}),
])
def test_hard_negative_quota_rule(spark, ratio, mq, want):
    v = C.ratio_variants([ratio], 5, [mq])
    got = C.select_gold_and_hard(ranked_fixture(spark), v).collect()
    assert {r["doc_id"] for r in got} == want
    assert len(got) == len(want)


def test_mix_keeps_duplicates(spark):
    r = spark.createDataFrame([(1, "g1", 1, True), (1, "h1", 2, False)],
                              "qid int, doc_id string, rank int, is_gold boolean")
    cfg = [{"variant": "x", "k_gold": 1, "k_hard": 1, "mix_topk": 2}]
    got = sorted((x["doc_id"], x["role"]) for x in C.select_config_mix(r, cfg).collect())
    assert got == [("g1", "gold"), ("g1", "topk"), ("h1", "hard_negative"), ("h1", "topk")]


def test_slices_and_first_n(spark):
    r = spark.range(1, 101).select(F.lit(1).alias("qid"), F.col("id").cast("int").alias("rank"))
    assert C.top_k_slice(r, 5).count() == 5
    band = C.rank_band(r, 50, 100)
    assert band.count() == 50 and band.agg(F.min("rank")).first()[0] == 51
    q = spark.range(0, 1000).withColumn("seq", -F.col("id"))
    assert [x["id"] for x in C.first_n_questions(q, 3).collect()] == [999, 998, 997]


def test_gold_answers_and_keep_all(spark):
    recs = spark.createDataFrame([("a",), ("b",)], "qid string")
    gold = spark.createDataFrame([("a", "x")], "qid string, gold_answer string")
    got = {r["qid"]: (r["gold_answer"], r["has_gold"]) for r in
           C.attach_gold_answers(recs, gold).collect()}
    assert got == {"a": ("x", True), "b": ("", False)}
    run = spark.createDataFrame([("a", "d")], "qid string, doc_id string")
    assert [r["qid"] for r in C.keep_all_questions(recs, run).collect()] == ["a"]


def test_collect_and_counts(spark):
    ctx = spark.createDataFrame([(1, 2, "b", "gold"), (1, 1, "a", "hard_negative")],
                                "qid int, position int, doc_id string, role string")
    got = C.collect_contexts(ctx, ["qid"], ["doc_id"]).first()["contexts"]
    assert [c["doc_id"] for c in got] == ["a", "b"]
    req = spark.createDataFrame([(1,), (2,)], "qid int")
    counts = {r["qid"]: (r["num_gold"], r["num_hard_negative"])
              for r in C.context_counts(ctx, ["qid"], ["gold", "hard_negative"], req).collect()}
    assert counts == {1: (1, 1), 2: (0, 0)}


def test_min_quota_column_name_and_int(spark):
    v = [{"variant_id": 1, "n_keep": 0, "n_noise": 0, "mq": 1}]
    got = C.select_gold_and_hard(ranked_fixture(spark), v, min_quota="mq").collect()
    assert sorted(r["doc_id"] for r in got) == ["g1", "h1"]
    v2 = [{"variant_id": 1, "n_keep": 0, "n_noise": 0}]
    got2 = C.select_gold_and_hard(ranked_fixture(spark), v2, min_quota=1).collect()
    assert sorted(r["doc_id"] for r in got2) == ["g1", "h1"]
