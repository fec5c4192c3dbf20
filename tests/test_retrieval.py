"""K1/K2/A1: exact top-k against NumPy brute force; partition independence; plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxmix.operators import retrieval as R

SF = "/root/testdata/sf0.01"


def brute(q, c, k, exclude_self=True):
    qi, qv = zip(*q)
    ci, cv = zip(*c)
    Q = np.array(qv, dtype=np.float64)
    Cm = np.array(cv, dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
        Cn = Cm / np.linalg.norm(Cm, axis=1, keepdims=True)
        S = Qn @ Cn.T
    S[np.isnan(S)] = -1.0
    out = {}
    for a, qid in enumerate(qi):
        cand = [(S[a, b], did) for b, did in enumerate(ci) if not (exclude_self and did == qid)]
        cand.sort(key=lambda t: (-t[0], -t[1]))
        out[qid] = [(did, round(s, 6)) for s, did in cand[:k]]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["doc_id"], round(r["score"], 6)))
    return out


@pytest.mark.parametrize("blocks", [None, (1, 1), (3, 5), (7, 2)])
def test_topk_matches_brute_force(spark, blocks):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    c = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    got = as_dict(R.topk_cosine(q, c, 7, blocks=blocks))
    assert got == brute(rows, rows, 7)


def test_zero_vector_scores_minus_one_and_self_kept(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "qid long, embedding array<float>")
    c = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])],
                              "doc_id long, embedding array<float>")
    got = as_dict(R.topk_cosine(q, c, 3, exclude_self=False))
    assert [s for _, s in got[1]] == [-1.0, -1.0, -1.0]
    assert [d for d, _ in got[1]] == [3, 2, 1]          # ties: doc_id descending
    assert got[2][0] == (2, 1.0)
    ex = as_dict(R.topk_cosine(q, c, 3))
    assert 2 not in [d for d, _ in ex[2]]


def test_plan_has_window_group_limit_and_no_cartesian(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    df = R.topk_cosine(e.select(F.col("vec_id").alias("qid"), "embedding"),
                       e.select(F.col("vec_id").alias("doc_id"), "embedding"), 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_mean_pool_masked(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0),
                                (2, [5.0, 5.0], 0)], "k int, v array<double>, m int")
    got = {r["k"]: r["v"] for r in R.mean_pool(df, "k", "v", "m").collect()}
    assert got[1] == [2.0, 3.0]
    assert got[2] is None


def test_plan_blocks_bounds():
    assert R.plan_blocks(10, 10, 64, 8) == (1, 8)
    # 768-dim vectors, 512 MB cells: at most ~43.7k question rows per block
    bq, bc = R.plan_blocks(100_000, 10_000_000, 768, 8, 512 << 20)
    q_block = catch_ceil(100_000, 3) * 768 * 8
    assert bq == 3 and bc == catch_ceil(10_000_000, ((512 << 20) - q_block) // (768 * 8))
    # a small question set leaves most of the cell to passages
    bq, bc = R.plan_blocks(12_000, 430_000_000, 768, 8, 512 << 20)
    assert bq == 1 and bc == catch_ceil(430_000_000, ((512 << 20) - 12_000 * 768 * 8) // (768 * 8))


def catch_ceil(a, b):
    return -(-a // b)


def test_cell_kernel_ties_and_steps(monkeypatch):
    """Scores in {-1, 0, 1} exactly (axis vectors scaled by powers of two): massive ties,
    several question and passage sub-steps; ties must go to the larger doc_id."""
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(R, "_Q_STEP", 3)
    monkeypatch.setattr(R, "_SCORE_ENTRIES", 3 * 256)
    eye = np.eye(4)
    axes = [eye[0], eye[1], -eye[0], eye[2]]
    qv = [axes[i % 4] for i in range(7)]
    cv = [axes[i % 4] * (2.0 ** (i % 3)) for i in range(700)]
    qpdf = pd.DataFrame({"qid": np.arange(7), "vec": qv})
    cpdf = pd.DataFrame({"doc_id": np.arange(700), "vec": cv})
    out = R._cell_topk(9, "cosine", True, -1.0)(qpdf, cpdf)
    for qid in range(7):
        scores = [float(np.dot(qv[qid], v) / (np.linalg.norm(qv[qid]) * np.linalg.norm(v)))
                  for v in cv]
        want = sorted(((sc, d) for d, sc in enumerate(scores) if d != qid),
                      key=lambda t: (-t[0], -t[1]))[:9]
        got = out[out["qid"] == qid].sort_values(["score", "doc_id"], ascending=False)
        assert list(zip(got["score"], got["doc_id"])) == want


def test_row_level_cosine_matches_cells(spark):
    from ctxmix.functions import vectors as V
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    run = R.topk_cosine(e.select(F.col("vec_id").alias("qid"), "embedding"),
                        e.select(F.col("vec_id").alias("doc_id"), "embedding"), 3)
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    d = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"))
    j = run.join(q, "qid").join(d, "doc_id").select("score", V.cosine("qv", "dv").alias("re"))
    assert all(abs(r["score"] - r["re"]) < 1e-12 for r in j.collect())
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert z.select(V.cosine("a", "b")).first()[0] == -1.0
    assert z.select(V.cosine("a", "b", floor=None)).first()[0] is None


def test_topk_with_empty_sides(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    c = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    assert R.topk_cosine(q.limit(0), c, 3).count() == 0
    assert R.topk_cosine(q, c.limit(0), 3).count() == 0
    assert R.plan_blocks(0, 0, 0, 8) == (1, 1)


@pytest.mark.parametrize("strings", [False, True])
def test_blocks_don_t_change_ids_or_scores(spark, strings):
    """Distinct dense vectors, each ten times, and zero vectors: exact ties everywhere."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(40, 24)), 10, axis=0), np.zeros((3, 24))])
    rows = [(f"v{i:04d}" if strings else i, [float(a) for a in v]) for i, v in enumerate(x)]
    e = spark.createDataFrame(rows, f"id {'string' if strings else 'long'}, embedding array<double>")
    q, c = e.select(F.col("id").alias("qid"), "embedding"), e.select(F.col("id").alias("doc_id"), "embedding")
    got = [sorted(tuple(r) for r in R.topk_cosine(q, c, 13, blocks=b).collect()) for b in ((1, 1), (1, 3), (2, 7), (5, 4))]
    assert got[0] == got[1] == got[2] == got[3]
    first = [r for r in got[0] if r[0] == rows[0][0]]
    assert [r[1] for r in sorted(first, key=lambda r: r[3])][:9] == [rows[i][0] for i in range(9, 0, -1)]


def test_each_cell_is_a_task_of_its_own(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    run = R.topk_cosine(e.select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding"), 3, blocks=(2, 9))
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 2 and ", 18), REPARTITION_BY_NUM" in plan
    assert "Exchange hashpartitioning(cell" not in plan


def test_mean_pool_has_the_same_bits_whatever_the_partitions(spark):
    """Terms that cancel, of sizes from 1e-200 to 1e200; the exact mean from fractions."""
    from fractions import Fraction
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 3)) * 10.0 ** rng.integers(-12, 12, (400, 3))
    x[::2, 1] = -x[1::2, 1]
    x[:4, 2] = [1e200, 1e-200, -1e200, 3.0]
    rows = [(i % 3 if i % 7 else None, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = []
    for parts in (1, 4, 17):
        out = R.mean_pool(df.repartition(parts), "k", "v").collect()
        got.append(sorted((-1 if r["k"] is None else r["k"], r["v"]) for r in out if r["v"]))
    assert got[0] == got[1] == got[2]
    for k, mean in got[0]:
        own = [r for j, r in rows if (-1 if j is None else j) == k]
        for d in range(3):
            exact = float(sum(Fraction(r[d]) for r in own) / len(own))
            assert mean[d] == exact
    odd = spark.createDataFrame([(1, [1.0, float("inf"), 0.0]), (1, [2.0, 1.0, 0.0]), (2, [float("nan"), -1.0, 5e-324])], "k int, v array<double>")
    out = {r["k"]: r["v"] for r in R.mean_pool(odd, "k", "v").collect()}
    assert out[1] == [1.5, float("inf"), 0.0] and np.isnan(out[2][0]) and out[2][1:] == [-1.0, 5e-324]


def test_exact_parts():
    rng = np.random.default_rng(0)
    x = np.append(rng.standard_normal(500) * 10.0 ** rng.integers(-290, 290, 500), [0.0, 1.0, -1.0, 2.0**52 + 1, 1.7e308, -2.0**-40])
    from fractions import Fraction
    for v, *parts in zip(x, *[list(zip(p, m)) for p, m in R.exact_parts(x)]):
        assert sum(Fraction(int(m)) * Fraction(2) ** (32 * int(p)) for p, m in parts) == Fraction(v)
        assert all(abs(m) < 2**32 and m == int(m) for _, m in parts)


def test_many_questions_are_not_merged_over_passage_blocks(spark, monkeypatch):
    """Where every core has questions of its own, passages stay whole; ranks are final without a second shuffle."""
    assert R._blocks(600_000, 600_000, 64, 100, 12, 128 << 20, item=4)[1] == 1
    monkeypatch.setattr(R, "_Q_CORE", 1)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q, c = e.select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding")
    run = R.topk_cosine(q, c, 9)
    assert "Window" not in run._jdf.queryExecution().executedPlan().toString()
    assert sorted(run.collect()) == sorted(R.topk_cosine(q, c, 9, blocks=(2, 3)).collect())


def test_cell_memory_is_bounded():
    """A cell of 4,000 questions and 60,000 passages needs little more than its vectors and results."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(0)
    q, c = (rng.standard_normal((n, 64)).astype(np.float32) for n in (4_000, 60_000))
    tables = [pa.table({name: np.arange(len(v)), "vec": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float32()))}) for name, v in (("qid", q), ("doc_id", c))]
    tracemalloc.start()
    out = R._cell_topk_arrow(20, "cosine", True, -1.0, ranks=True)(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 80_000 and peak < 60e6
    got = out.slice(0, 20).to_pydict()
    score = (c.astype(float) @ q[0].astype(float)) / (np.linalg.norm(c.astype(float), axis=1) * np.linalg.norm(q[0].astype(float)))
    score[0] = -2
    assert got["qid"] == [0] * 20 and got["doc_id"] == list(np.argsort(-score)[:20]) and got["rank"] == list(range(1, 21))


def test_cell_memory_grows_little_with_passages():
    """Besides its vector a passage takes a few numbers, also where all of them come as one Arrow batch."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(0)
    q, peaks = rng.standard_normal((300, 64)).astype(np.float32), []
    for n in (50_000, 200_000):
        c = rng.standard_normal((n, 64)).astype(np.float32)
        tables = [pa.table({name: np.arange(len(v)), "vec": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float32()))}) for name, v in (("qid", q), ("doc_id", c))]
        tracemalloc.start()
        out = R._cell_topk_arrow(10, "cosine", True, -1.0, ranks=True)(*tables)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(out) == 3_000
    assert peaks[1] - peaks[0] < 150_000 * 64


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("nan_score", [-1.0, None])
def test_odd_vectors(metric, nan_score):
    """Zero, infinite, undefined, vanishing and huge vectors among others, in small steps: the scores of all pairs, one by one."""
    import pandas as pd
    rng = np.random.default_rng(5)
    v = np.sign(rng.standard_normal((700, 6)))
    v[::9] = 0
    v[5, 1], v[6, 2], v[7, 0], v[8], v[10] = np.inf, np.nan, -np.inf, 1e-120, 1e130
    v[11:400:7] *= 1e-140
    got = R._cell_topk(8, metric, True, nan_score)(pd.DataFrame({"qid": np.arange(40), "vec": list(v[:40])}), pd.DataFrame({"doc_id": np.arange(700), "vec": list(v)}))
    for i in range(40):
        with np.errstate(all="ignore"):
            s = R._exact(np.repeat(v[i:i + 1], 700, axis=0), v, metric)
        s = s if nan_score is None else np.where(np.isnan(s), nan_score, s)
        want = sorted((j for j in range(700) if j != i), key=lambda j: (-np.inf if np.isnan(s[j]) else -s[j], -j))[:8]
        assert list(got[got["qid"] == i]["doc_id"]) == want


def test_only_final_candidates_are_scored_in_double_precision(monkeypatch):
    """Of 100 x 20,000 pairs little more than the 50 best are scored again, not all that were best for a time."""
    rng = np.random.default_rng(4)
    q, c = rng.standard_normal((100, 32)).astype(np.float32), rng.standard_normal((20_000, 32)).astype(np.float32)
    scored, exact = [], R._exact
    monkeypatch.setattr(R, "_exact", lambda x, y, metric: scored.append(len(x)) or exact(x, y, metric))
    order = rng.permutation(20_000)
    rows = list(R._scored_cell(q, [c[:7_000], c[7_000:]], order, np.full(100, -1), 50, "cosine", -1.0))
    assert sum(scored) < 100 * 50 * 1.1
    every = exact(np.repeat(q.astype(float), 20_000, axis=0), np.tile(c.astype(float), (100, 1)), "cosine").reshape(100, -1)
    row, place, score = (np.concatenate(x) for x in zip(*rows))
    for i in range(100):
        assert list(place[row == i]) == list(np.lexsort((-order, -every[i]))[:50])
        assert list(score[row == i]) == list(every[i][place[row == i]])


def test_alike_candidates_are_bounded(monkeypatch):
    """30,000 copies of one vector, then a better one: candidates of one score are cut by order, not gathered."""
    c = np.repeat([[1.0, 2.0, 3.0]], 30_001, axis=0).astype(np.float32)
    c[-1] = [2.0, 1.0, 0.0]
    q = np.array([[1.0, 2.0, 3.0]] * 50 + [[2.0, 1.0, 0.0]], np.float32)
    kept, cut = [], R._Step.cut
    monkeypatch.setattr(R._Step, "cut", lambda self: (cut(self), kept.append(len(self.kept[0])))[0])
    monkeypatch.setattr(R, "_SCORE_ENTRIES", 51 * 256)
    order = np.random.default_rng(1).permutation(30_001)
    row, place, score = (np.concatenate(x) for x in zip(*R._scored_cell(q, [c], order, np.full(51, -1), 5, "cosine", -1.0)))
    best = list(np.argsort(-order[:-1])[:5])
    assert all(list(place[row == i]) == best for i in range(50)) and list(place[row == 50]) == [30_000, *best[:4]]
    assert max(kept) < 51 * 1_000
