"""Driver contract: entry() runs on sf0.001; every query has a stable schema."""

import __spark_entry__ as E
from ctxmix.plans.oracle_sql import ORACLE
from ctxmix.plans.queries import QUERIES


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["variant_id", "ratio", "min_quota", "qid", "doc_id", "role", "rank", "score"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) >= 42
