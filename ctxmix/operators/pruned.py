"""Exact top-k by cosine that skips blocks of passages that cannot hold a result.

Passages are grouped around centres (a bounded sample of them), each group with its radius: the largest angle
between its centre and a member. No member of a group can be nearer to a question than the angle to the
centre less the radius. A first pass scores each question in the nearest groups, until they hold enough
passages to give a k-th score; a second pass sends a question only to groups whose bound can still beat
that score. Groups and the questions that come to them are cut into cells of bounded size, so neither
a large group nor one that all questions visit meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_code
from .retrieval import _cell_topk_arrow, rank_within

#: Centres at most, and vectors of either side in a cell at most (about).
CENTRES, CELL_ROWS = 1024, 50_000
#: Passages of a group on average, where there are more than ``FEW`` centres: a question's vector is sent to a group
#: only for so many products at least. Rows of a batch that are compared with all centres at once, and visits
#: (a vector each) that leave a worker at once.
GROUP_ROWS, FEW, _ROWS, _VISITS = 4096, 32, 512, 20_000
#: Added to radii (angles lose about half of their digits near 0), and the share by which scores may differ.
_ANGLE, _SCORE = 1e-6, 1e-9
#: The group of zero vectors, whose cosine with any other is undefined.
_NONE = -1


class Pruned(NamedTuple):
    ranked: DataFrame   # (qid, doc_id, score, rank)
    scored: int         # question-passage pairs that were scored
    every: int          # pairs that there are


class _Groups(NamedTuple):
    centres: np.ndarray  # unit vectors
    size: np.ndarray     # passages by group; the last is that of vectors without a direction
    radius: np.ndarray


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64, copy=False)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, which rows have one, and which rows are zero. Others (infinite, no number) have no bound."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        norm = np.linalg.norm(m, axis=1)
        u = m / norm[:, None]
    good = np.isfinite(norm) & (norm > 0)
    return np.where(good[:, None], u, 0.0), good, norm == 0


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), _ROWS):
            yield pdf.iloc[i:i + _ROWS]


def _grouped(c: DataFrame, centres: np.ndarray) -> DataFrame:
    """Passages with their nearest centre and the angle to it."""
    schema = T.StructType([*c.schema.fields, T.StructField("group", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            u, good, zero = _unit(_matrix(pdf["vec"]))
            if not len(centres):
                yield pdf.assign(group=np.full(len(u), _NONE, np.int32), angle=0.0)
                continue
            cos = u @ centres.T
            near = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(u)), near], -1, 1))
            yield pdf.assign(group=np.where(zero, _NONE, near).astype(np.int32), angle=np.where(good, angle, np.where(zero, 0.0, math.pi)))

    return c.mapInPandas(run, schema)


def _visits(q: DataFrame, groups: _Groups, k: int, nan_score: float, first: bool) -> DataFrame:
    """(qid, vec, group) of the groups that a question is scored in. In the first pass these are the nearest ones with
    together more than ``k`` passages; in the second all others that can beat its ``floor``."""
    schema = T.StructType([q.schema["qid"], q.schema["vec"], T.StructField("group", T.IntegerType())])
    n = len(groups.centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            u, good, zero = _unit(_matrix(pdf["vec"]))
            bound = np.full((len(u), n + 1), nan_score if n else np.inf)
            if n:
                angle = np.arccos(np.clip(u @ groups.centres.T, -1, 1))
                bound[:, :n] = np.cos(np.clip(angle - groups.radius[:n] - _ANGLE, 0, math.pi))
            bound[zero] = nan_score
            bound[~good & ~zero] = np.inf
            order = np.argsort(np.where(groups.size > 0, -bound, np.inf), axis=1, kind="stable")
            before = np.cumsum(groups.size[order], axis=1) - groups.size[order]
            near = np.empty(bound.shape, bool)
            np.put_along_axis(near, order, before <= k, axis=1)
            near &= groups.size > 0
            go = near if first else ~near & (groups.size > 0) & (bound >= pdf["floor"].to_numpy()[:, None] - _SCORE)
            rows, visited = np.nonzero(go)
            for i in range(0, len(rows), _VISITS):
                row, group = rows[i:i + _VISITS], visited[i:i + _VISITS]
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[row], "vec": pdf["vec"].to_numpy()[row],
                                    "group": np.where(group == n, _NONE, group).astype(np.int32)})

    return q.mapInPandas(run, schema)


def _scored(visits: DataFrame, passages: DataFrame, groups: _Groups, k: int, exclude_self: bool, nan_score: float,
            cell_rows: int) -> tuple[DataFrame, int]:
    """Top k of every question in each cell, and the number of pairs. Cells are numbered group by group."""
    spark = visits.sparkSession
    asked = {r["group"]: r["n"] for r in visits.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each group
    rows, base, pairs = [], 0, 0
    for g, n in sorted(asked.items()):
        size = int(groups.size[g])
        q_parts, c_parts = -(-n // cell_rows), -(-size // cell_rows)
        rows.append((g, base, q_parts, c_parts))
        base, pairs = base + q_parts * c_parts, pairs + n * size
    plan = F.broadcast(spark.createDataFrame(rows, "group int, base int, q_parts int, c_parts int"))
    part = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    cell = (F.col("base") + F.col("qp") * F.col("c_parts") + F.col("cp")).alias("cell")
    left = visits.join(plan, "group").withColumn("qp", part("qid", "q_parts")).withColumn("cp", spread("c_parts")).select("qid", "vec", cell)
    right = passages.join(plan, "group").withColumn("cp", part("doc_id", "c_parts")).withColumn("qp", spread("q_parts")).select("doc_id", "vec", cell)
    schema = T.StructType([visits.schema["qid"], passages.schema["doc_id"], T.StructField("score", T.DoubleType())])
    left, right = (x.repartitionById(max(1, base), "cell") for x in (left, right))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell_topk_arrow(k, "cosine", exclude_self, nan_score), schema), pairs


def topk_pruned(queries: DataFrame, corpus: DataFrame, k: int, *, qid: str = "qid", doc_id: str = "doc_id", query_vec: str = "embedding",
                doc_vec: str = "embedding", exclude_self: bool = True, nan_score: float = -1.0, centres: int = CENTRES,
                cell_rows: int = CELL_ROWS) -> Pruned:
    """The rows of :func:`~ctxmix.operators.retrieval.topk_cosine`, found in the groups that can hold them.

    Worth it where passages cluster; without clusters most bounds are 1 and it scores all pairs, in two passes.
    The number of centres is the square root of that of passages, ``centres`` at most, and beyond ``FEW`` one for each
    ``GROUP_ROWS`` passages at most.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    ship_code(spark)
    q = queries.select(F.col(qid).alias("qid"), F.col(query_vec).alias("vec")).where(F.col("vec").isNotNull())
    c = corpus.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("vec")).where(F.col("vec").isNotNull())
    nq, nc = q.count(), c.count()
    wanted = min(centres, math.isqrt(nc) + 1, max(FEW, nc // GROUP_ROWS))
    sample = c.orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted).select("vec").toPandas()  # `centres` vectors at most
    unit = np.zeros((0, 1))
    if len(sample):
        unit, good, _ = _unit(_matrix(sample["vec"]))
        unit = unit[good]
    passages = materialize(_grouped(c, unit), "grouped")
    facts = passages.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # a row for each group
    size, radius = np.zeros(len(unit) + 1, np.int64), np.zeros(len(unit) + 1)
    for r in facts:
        size[r["group"]], radius[r["group"]] = r["n"], r["radius"]
    groups = _Groups(unit, size, radius)
    near = materialize(_visits(q, groups, k, nan_score, True), "near")
    found, pairs = _scored(near, passages, groups, k, exclude_self, nan_score, cell_rows)
    found = materialize(rank_within(found, "qid", k), "first")
    floor = found.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    left = q.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    far = materialize(_visits(left, groups, k, nan_score, False), "far")
    more, again = _scored(far, passages, groups, k, exclude_self, nan_score, cell_rows)
    return Pruned(rank_within(found.drop("rank").unionByName(more), "qid", k), pairs + again, nq * nc)
