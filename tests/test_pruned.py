"""Pruned top-k: the rows of the plain one, from fewer pairs where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxmix.operators import retrieval as R
from ctxmix.operators.pruned import topk_pruned


def table(spark, vectors, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<double>")


def rows(df):
    return sorted((r["qid"], r["rank"], r["doc_id"], repr(r["score"])) for r in df.collect())


def clustered(rng, n, centres, noise):
    return centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, centres.shape[1]))


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    q, c = table(spark, clustered(rng, 150, centres, 0.05), "qid"), table(spark, clustered(rng, 900, centres, 0.05), "doc_id")
    found = topk_pruned(q, c, 5, cell_rows=100)
    assert rows(found.ranked) == rows(R.topk_cosine(q, c, 5))
    assert found.every == 150 * 900 and found.scored < found.every / 3


@pytest.mark.parametrize("k", [1, 7, 500])
def test_without_clusters(spark, k):
    """Ties, zero vectors, vectors with infinite and undefined components, more wanted than there are."""
    rng = np.random.default_rng(k)
    v = np.sign(rng.standard_normal((90, 4)))
    v[::9] = 0
    v[5, 1], v[6, 2] = np.inf, np.nan
    q, c = table(spark, v[:40], "qid"), table(spark, v, "doc_id")
    assert rows(topk_pruned(q, c, k, cell_rows=16).ranked) == rows(R.topk_cosine(q, c, k))


def test_hot_group_and_empty_sides(spark):
    """A third of all vectors are one; nothing but zero vectors; no rows."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((120, 8))
    v[:40] = v[0]
    q, c = table(spark, v, "qid"), table(spark, v, "doc_id")
    assert rows(topk_pruned(q, c, 3, exclude_self=False, cell_rows=10).ranked) == rows(R.topk_cosine(q, c, 3, exclude_self=False))
    zero = c.withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    assert rows(topk_pruned(q, zero, 2).ranked) == rows(R.topk_cosine(q, zero, 2))
    assert topk_pruned(q, c.limit(0), 2).ranked.collect() == [] == topk_pruned(q.limit(0), c, 2).ranked.collect()


def test_visits_leave_in_small_batches(monkeypatch):
    """without clusters each question visits every group; a worker holds a few rows of bounds and few copies of vectors."""
    from types import SimpleNamespace

    import pandas as pd

    from ctxmix.operators import pruned as P
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((1024, 16))
    groups = P._Groups(centres / np.linalg.norm(centres, axis=1, keepdims=True), np.append(np.full(1024, 5), 0), np.append(np.full(1024, 3.0), 0))
    batch = pd.DataFrame({"qid": np.arange(2_000), "vec": list(rng.standard_normal((2_000, 16))), "floor": -1.0})
    made = []
    q = SimpleNamespace(schema={"qid": P.T.StructField("qid", P.T.LongType()), "vec": P.T.StructField("vec", P.T.ArrayType(P.T.DoubleType()))},
                        mapInPandas=lambda run, schema: made.extend(len(x) for x in run(iter([batch]))))
    P._visits(q, groups, 10, -1.0, False)
    assert max(made) <= 20_000 and sum(made) > 2_000_000 - 2_000 * 20
