"""Invariants over the registered queries: partition-count independence and plan shape."""

import pytest

import __spark_entry__ as E
from ctxmix.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["hard_negative_sweep", "random_negatives", "random_from_run",
                                  "shuffle_contexts", "gold_substring", "oracle_contexts",
                                  "benchmark_cover", "topk_ties", "random_negatives_scarce"])
def test_independent_of_shuffle_partitions(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(rows(E.queries()[name](spark, SF)))
        assert got[0] == got[1] == got[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_sweep_retrieves_once(spark):
    df = E.queries()["hard_negative_sweep"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F
    from ctxmix.operators import retrieval as R
    from ctxmix.sources import io as IO
    run = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.4, 7)],
                                "qid long, doc_id long, score double, rank int")
    IO.write_ranked(run, str(tmp_path / "ranked"))
    plan = IO.read_ranked(spark, str(tmp_path / "ranked"), 5)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "LessThanOrEqual(rank,5)" in plan
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    df = R.topk_cosine(e.select(F.col("vec_id").alias("qid"), "embedding"),
                       e.select(F.col("vec_id").alias("doc_id"), "embedding"), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1].split("\n")[0]
