"""Dense retrieval: exact distributed top-k by cosine (or dot) similarity, and vector means.

Design (no collect to the driver, no all-pairs join):

* Both sides are hash-assigned to blocks (``bq`` for questions, ``bc`` for passages).
  Every question row is replicated to each passage block and vice versa, so cell
  ``(bq, bc)`` holds one question block and one passage block. Blocks are sized from
  row counts so a cell always fits in one Python worker, whatever the table size.
* ``cogroup(...).applyInArrow`` scores a cell with one NumPy matrix product per
  passage chunk and question step; vectors are read in place from the Arrow batches. Cosines are
  multiplied in single precision: the product only picks candidates that its error bound
  does not rule out of the ``k`` best; what is left at the end is scored pair by pair in double precision and a
  fixed order, and ranked on that. Results don't depend on the blocks.
* Where questions are many, passages are not cut (``bc`` is 1 as long as they fit), and a cell's ranks are final.
  Else the global cut is a ``row_number()`` window per question; Catalyst plans it as a
  partial + final ``WindowGroupLimit`` around the exchange, so only ``k`` rows per
  question and cell cross the network. Each question has at most ``k * bc`` rows
  there, so no window partition can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship_code

# One step scores a few questions against a few passages; its score matrix has at most
# this many entries (8 MB in single precision), and two arrays of that size live at a time.
_SCORE_ENTRIES = 2_000_000
_Q_STEP = 1024
# Squared lengths between these bounds neither overflow nor vanish in a pair's score.
_SMALL, _LARGE = 1e-100, 1e100
# Questions for each core from which passages are not cut to give every core a cell.
_Q_CORE = 1024


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of row pairs, each from its own two vectors in a fixed order, so that they
    don't depend on the blocks that the pair was found in."""
    dot = (q * c).sum(axis=1)
    if metric == "dot":
        return dot
    with np.errstate(divide="ignore", invalid="ignore"):
        return dot / np.sqrt((q * q).sum(axis=1) * (c * c).sum(axis=1))


def _best(row: np.ndarray, score: np.ndarray, place: np.ndarray, order: np.ndarray, k: int):
    """The ``k`` best candidates of each row: larger score first (NaN above all), then larger id."""
    key = np.where(np.isnan(score), -np.inf, -score)
    turn = np.lexsort((-order, key, row))
    row = row[turn]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    turn = turn[nth < k]
    return row[nth < k], score[turn], place[turn], order[turn]


class _Side:
    """Vectors of one side of a cell, block by block, and what their lengths say of their scores."""

    def __init__(self, blocks: list[np.ndarray], metric: str):
        self.blocks = blocks
        self.square, largest = np.concatenate([np.zeros((2, 0)), *[self._lengths(b) for b in blocks]], axis=1)
        finite = np.isfinite(largest)
        # undefined: the cosine with any other vector is; odd: may be anything, so all pairs are scored one by one
        self.undefined = ~finite | (largest == 0) if metric == "cosine" else np.zeros(len(largest), bool)
        low = _SMALL if metric == "cosine" else 0.0
        self.plain = finite & (self.square >= low) & (self.square <= _LARGE) & ~self.undefined
        self.odd = ~self.plain & ~self.undefined

    @staticmethod
    def _lengths(block: np.ndarray) -> np.ndarray:
        """Squared length and largest size of an entry (NaN stays NaN) of each vector, without a copy of the block, which may be a whole side."""
        out = np.empty((2, len(block)))
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            for i in range(0, len(block), 8192):
                x = block[i:i + 8192].astype(np.float64)
                out[1, i:i + 8192] = np.abs(x).max(axis=1, initial=0.0)
                out[0, i:i + 8192] = (x * x).sum(axis=1)
        return out

    def comparable(self, block: np.ndarray, at: int, metric: str) -> np.ndarray:
        """Rows ``at ..`` for the matrix product: unit vectors in single precision, or as they are; zeros if not plain."""
        plain, square = self.plain[at:at + len(block)], self.square[at:at + len(block)]
        with np.errstate(all="ignore"):
            x = block / np.sqrt(square)[:, None] if metric == "cosine" else block.astype(np.float64)
        x[~plain] = 0.0
        return x.astype(np.float32 if metric == "cosine" else np.float64, copy=False)


def _down(x: np.ndarray) -> np.ndarray:
    """Single precision numbers not above ``x``, in the same order; NaN and infinity rank above all."""
    edge = np.finfo(np.float32).max
    with np.errstate(over="ignore"):
        low = np.nextafter(np.clip(x, -edge, edge).astype(np.float32), np.float32(-np.inf))
    return np.where(np.isnan(x) | (x == np.inf), np.float32(np.inf), low)


class _Step:
    """A few questions' candidates: pairs whose score in single precision (``s``) may be among the ``k`` best.

    ``floor`` is a bound below a question's k-th score so far. ``s`` is off by ``slack`` at most, so a pair with less than
    ``floor - slack`` is out. ``exact(row, place)`` scores pairs.
    """

    def __init__(self, n: int, k: int, slack: np.ndarray, order: np.ndarray, exact):
        self.n, self.k, self.slack, self.order, self.exact = n, k, slack, order, exact
        self.floor = np.full(n, -np.inf)
        self.kept = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, row: np.ndarray, place: np.ndarray, s: np.ndarray) -> None:
        self.new.append((row.astype(np.int32), place.astype(np.int32), s if s.dtype == np.float32 else _down(s)))
        self.waiting += len(row)
        if self.waiting > self.n * self.k // 2 + 4096:
            self.cut()
            if len(self.kept[0]) > 2 * self.n * self.k + 4096:  # very many scores that are alike: their order decides
                row, place, score = self.best()
                last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
                last = last[np.bincount(row, minlength=self.n)[row[last]] == self.k]
                self.kept = (row.astype(np.int32), place.astype(np.int32), s := _down(score))
                self.floor[row[last]] = np.maximum(self.floor[row[last]], s[last])

    def cut(self) -> None:
        """Raise the floors to the k-th candidates, and drop what is below."""
        row, place, s = self.kept = tuple(np.concatenate(x) for x in zip(self.kept, *self.new))
        self.new, self.waiting = [], 0
        # row and falling score as one whole number: sorted without an index
        bits = s.view(np.uint32)
        key = row.astype(np.uint64) << np.uint64(32) | np.where(bits >> 31, bits, ~(bits | np.uint32(1 << 31)))
        key.sort()
        count = np.bincount(row, minlength=self.n)
        full = np.flatnonzero(count >= self.k)
        kth = key[(np.cumsum(count) - count)[full] + self.k - 1].astype(np.uint32)
        kth = np.where(kth >> 31, kth, ~kth & np.uint32((1 << 31) - 1)).view(np.float32)
        self.floor[full] = np.maximum(self.floor[full], kth.astype(np.float64) - self.slack[full])
        keep = s >= _down(self.floor - self.slack)[row]
        self.kept = row[keep], place[keep], s[keep]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, passage, score) of the best candidates, by question and best first."""
        row, place, _ = self.kept
        row, score, place, _ = _best(row.astype(np.int64), self.exact(row, place), place.astype(np.int64), self.order[place], self.k)
        return row, place, score


def _true(flags: np.ndarray, n: int) -> np.ndarray:
    """Places of the true ones among the first ``n`` flags, of which few are; the buffer is a multiple of 8 long."""
    flags[n:-(-n // 8) * 8] = False
    eights = flags[:-(-n // 8) * 8].reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64).ravel() != 0)
    which, bit = np.nonzero(eights[some])
    return some[which] * 8 + bit


def _scored_cell(q: np.ndarray, blocks: list[np.ndarray], order: np.ndarray, own: np.ndarray, k: int, metric: str,
                 nan_score: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, passage, score) of each question's best passages, best first, for a few questions at a time.

    ``order`` is the place of a passage in ascending id order, ``own`` the passage that a question may not have, or -1.
    """
    side, asks = _Side(blocks, metric), _Side([q], metric)
    dim, total = q.shape[1], len(order)
    rank_of_undefined = np.inf if nan_score is None else nan_score
    # Passages without a defined score are alike to every question: only those of the largest ids can be among the best.
    dead = side.undefined.copy()
    alike = np.flatnonzero(dead)
    dead[alike[np.argsort(order[alike])[::-1][:k + 1]]] = False
    top = np.argsort(order)[::-1][:k + 1]  # all that a question without a defined score can get
    unit_q = asks.comparable(q, 0, metric)
    q_step = max(1, min(len(q), _Q_STEP))
    c_step = max(256, _SCORE_ENTRIES // q_step)
    scores, flags = np.empty(q_step * c_step, unit_q.dtype), np.empty(-(-q_step * c_step // 8) * 8, bool)
    # what rounding (of units, products and sums, twice over) can change
    slack = np.full(len(q), (dim + 16) * 2.0**-23 * max(1.0, abs(nan_score or 0.0)))
    if metric == "dot":
        slack = (dim + 16) * 2.0**-51 * np.sqrt(np.where(asks.plain, asks.square, 0.0) * side.square[side.plain].max(initial=0.0))
    starts = np.cumsum([0, *map(len, blocks)])

    def exact(row: np.ndarray, place: np.ndarray) -> np.ndarray:
        s, block = np.empty(len(row)), np.searchsorted(starts, place, side="right") - 1
        turn = np.argsort(block, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(block[turn], prepend=-1)), len(turn))
        for start, end in zip(edges[:-1], edges[1:]):
            for j in range(start, end, 2048):
                x = turn[j:min(j + 2048, end)]
                b = block[x[0]]
                s[x] = _exact(q[row[x]].astype(np.float64), blocks[b][place[x] - starts[b]].astype(np.float64), metric)
        return s if nan_score is None else np.where(np.isnan(s), nan_score, s)

    steps = []
    for qs in range(0, len(q), q_step):
        steps.append(_Step(min(q_step, len(q) - qs), k, slack[qs:qs + q_step], order, lambda row, place, qs=qs: exact(row + qs, place)))
    at = 0
    for block in blocks:
        for cs in range(0, len(block), c_step):
            c = block[cs:cs + c_step]
            width, unit_c = len(c), side.comparable(c, at, metric)
            undefined, gone, odd = (np.flatnonzero(x[at:at + width]) for x in (side.undefined, dead, side.odd))
            for i, step in enumerate(steps):
                qs, n = i * q_step, step.n
                sc = scores[:n * width].reshape(n, width)
                np.matmul(unit_q[qs:qs + n], unit_c.T, out=sc)
                mine = own[qs:qs + n]
                has = np.flatnonzero((mine >= at) & (mine < at + width))
                odd_q, no_q = np.flatnonzero(asks.odd[qs:qs + n]), np.flatnonzero(asks.undefined[qs:qs + n])
                sc[:, undefined] = rank_of_undefined
                sc[:, odd] = sc[:, gone] = -np.inf
                sc[odd_q] = -np.inf
                sc[has, mine[has] - at] = -np.inf
                floor = step.floor
                short = np.flatnonzero(floor == -np.inf)
                if len(short) and width > k:
                    kth = np.partition(sc[short], width - k, axis=1)[:, width - k]
                    floor[short] = kth.astype(np.float64) - slack[qs + short]
                if len(odd) or len(odd_q):
                    sc[:, odd] = sc[odd_q] = np.inf
                    sc[:, gone] = -np.inf
                    sc[has, mine[has] - at] = -np.inf
                sc[no_q] = -np.inf
                least = np.nextafter((floor - slack[qs:qs + n]).astype(sc.dtype), np.array(-np.inf, sc.dtype))
                hit = np.flatnonzero(sc.max(axis=1) >= least)
                if len(hit) < n // 2:
                    sc, least = sc[hit], least[hit]
                else:
                    hit = np.arange(n)
                np.greater_equal(sc, least[:, None], out=flags[:sc.size].reshape(sc.shape))
                found = _true(flags, sc.size)
                s = sc.reshape(-1)[found]
                found, s = found[s > -np.inf], s[s > -np.inf]
                if not len(found):
                    continue
                r, p = np.divmod(found, width)
                r, p = hit[r], p + at
                single = np.flatnonzero(s == np.inf)  # no product says what these are
                if len(single):
                    s = _down(s.astype(np.float64))
                    s[single] = _down(step.exact(r[single], p[single]))
                step.add(r, p, s)
            at += width
    for i, step in enumerate(steps):
        qs = i * q_step
        none = np.flatnonzero(asks.undefined[qs:qs + step.n])
        if len(none) and total:
            r, p = np.repeat(none, len(top)), np.tile(top, len(none))
            r, p = r[keep := p != own[qs + r]], p[keep]
            step.floor[none] = -np.inf
            step.add(r, p, np.full(len(r), rank_of_undefined))
        step.cut()
        row, place, score = step.best()
        steps[i] = step = None
        yield qs + row, place, score


def _floats(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.float32 else x.astype(np.float64, copy=False)


def _cell_topk(k: int, metric: str, exclude_self: bool, nan_score):
    """The cell on pandas frames ``(qid, vec)`` and ``(doc_id, vec)``."""
    def run(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        arrow = [pa.table({"id": pa.array(pdf[name]), "vec": pa.array(list(pdf["vec"]))}) for pdf, name in ((qpdf, "qid"), (cpdf, "doc_id"))]
        return _cell(*arrow, k, metric, exclude_self, nan_score).rename_columns(["qid", "doc_id", "score", "rank"]).drop(["rank"]).to_pandas()
    return run


def _cell_topk_arrow(k: int, metric: str, exclude_self: bool, nan_score, ranks: bool = False):
    """The cell on Arrow tables ``(qid, vec, cell)`` and ``(doc_id, vec, cell)``; with ``ranks`` these are returned too."""
    def run(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out = _cell(pa.table({"id": qs["qid"], "vec": qs["vec"]}), pa.table({"id": cs["doc_id"], "vec": cs["vec"]}), k, metric, exclude_self, nan_score)
        out = out.rename_columns(["qid", "doc_id", "score", "rank"])
        return out if ranks else out.drop(["rank"])
    return run


def _vectors(table: pa.Table) -> list[np.ndarray]:
    """The vectors of each Arrow batch as a matrix, without a copy if they are floating point numbers."""
    out = []
    for part in table["vec"].chunks:
        if not len(part):
            continue
        lengths = pc.list_value_length(part).to_numpy(zero_copy_only=False)
        if (lengths != lengths[0]).any():
            raise ValueError("vectors differ in length")
        out.append(_floats(part.flatten().to_numpy(zero_copy_only=False)).reshape(len(part), int(lengths[0])))
    return out


def _cell(qs: pa.Table, cs: pa.Table, k: int, metric: str, exclude_self: bool, nan_score) -> pa.Table:
    names = ["qid", "doc_id", "score", "rank"]
    empty = pa.table([qs["id"].slice(0, 0), cs["id"].slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.int32())], names)
    if not len(qs) or not len(cs):
        return empty
    blocks, q = _vectors(cs), _vectors(qs)
    q = np.concatenate(q) if len(q) > 1 else q[0]
    qids, dids = qs["id"].combine_chunks(), cs["id"].combine_chunks()
    order = np.empty(len(dids), np.int64)  # tie-break: place in ascending id order
    order[pc.sort_indices(dids).to_numpy()] = np.arange(len(dids))
    own = np.full(len(qids), -1)  # where a question's own id stands among the passages
    if exclude_self:
        own = pc.fill_null(pc.index_in(qids, value_set=dids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = [empty]
    for row, place, score in _scored_cell(q, blocks, order, own, k, metric, nan_score):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
        nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        out.append(pa.table([qids.take(pa.array(row)), dids.take(pa.array(place)), pa.array(score), pa.array((nth + 1).astype(np.int32))], names))
    return pa.concat_tables(out)


def plan_blocks(n_queries: int, n_docs: int, dim: int, parallelism: int,
                cell_bytes: int = 128 << 20) -> tuple[int, int]:
    """Block counts ``(bq, bc)`` for the scoring cells.

    A cell holds one question block and one passage block as float64 matrices within
    ``cell_bytes``; pandas, stacked and unit-length copies make about four times that
    in a Python worker. Questions take what they need, at most half; passages get the rest.
    Fewer, larger blocks mean less replication (questions are copied ``bc`` times,
    passages ``bq`` times), so blocks are as large as the budget allows, with at least
    ``parallelism`` cells so every core works. Passages are only replicated when the
    question set alone exceeds half a cell.
    """
    row_bytes = max(1, dim) * 8
    q_rows = max(1, (cell_bytes // 2) // row_bytes)
    bq = max(1, math.ceil(n_queries / q_rows))
    q_used = math.ceil(n_queries / bq) * row_bytes
    c_rows = max(1, (cell_bytes - q_used) // row_bytes)
    bc = max(math.ceil(n_docs / c_rows), math.ceil(max(1, parallelism) / bq))
    bc = max(1, min(bc, max(1, n_docs)))
    return bq, bc


def _blocks(n_queries: int, n_docs: int, dim: int, k: int, cores: int, cell_bytes: int, item: int = 8) -> tuple[int, int]:
    """Block counts for the cells as they are in memory: a question has its vector (``item`` bytes a number) twice and
    ``k`` results (about five numbers each while they are ranked), a passage its vector, its id and its places.

    Few questions leave cores idle unless passages are cut. Many are cut themselves, a block for each core at least,
    and passages only where they exceed a cell, so that a question has few lists of results to merge.
    """
    bq, bc = plan_blocks(n_queries, n_docs, dim, cores, cell_bytes)
    q_rows = max(1, cell_bytes // ((item + 8) * max(1, dim) + 40 * k))
    if n_queries < _Q_CORE * cores:
        return max(bq, math.ceil(n_queries / q_rows)), bc
    return max(cores, math.ceil(n_queries / q_rows)), max(1, math.ceil(n_docs * (item * dim + 32) / (2 * cell_bytes)))


def _sizes(q: DataFrame, c: DataFrame) -> tuple[int, int, int]:
    """Row counts of both sides and the vector width, in one job."""
    both = (q.select(F.lit(0).alias("side"), F.size("vec").alias("d"))
            .unionByName(c.select(F.lit(1).alias("side"), F.size("vec").alias("d"))))
    stats = {r["side"]: (r["n"], r["d"]) for r in
             both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()}
    nq, dq = stats.get(0, (0, 0))
    nc, dc = stats.get(1, (0, 0))
    return int(nq), int(nc), int(max(dq or 0, dc or 0))


def topk_cosine(queries: DataFrame, corpus: DataFrame, k: int, *,
                qid: str = "qid", doc_id: str = "doc_id",
                query_vec: str = "embedding", doc_vec: str = "embedding",
                metric: str = "cosine", exclude_self: bool = True, nan_score: float | None = -1.0,
                blocks: tuple[int, int] | None = None, cell_bytes: int = 128 << 20) -> DataFrame:
    """Exact top-k passages per question -> ``(qid, doc_id, score double, rank int)``.

    ``rank`` is 1-based in the total order (score desc, doc_id desc). ``exclude_self``
    drops the passage whose id equals the question id before the cut; ``nan_score``
    replaces undefined similarities (zero vectors) and ``None`` leaves them as NaN.
    Ids are expected to be unique on each side.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric!r}")
    if k <= 0:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    ship_code(spark)
    q = queries.select(F.col(qid).alias("qid"), F.col(query_vec).alias("vec")).where(
        F.col("vec").isNotNull())
    c = corpus.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("vec")).where(
        F.col("vec").isNotNull())
    cores = spark.sparkContext.defaultParallelism
    if blocks is None:
        single = all(x.schema["vec"].dataType == T.ArrayType(T.FloatType(), x.schema["vec"].dataType.containsNull) for x in (q, c))
        blocks = _blocks(*_sizes(q, c), k, cores, cell_bytes, 4 if single else 8)
    bq, bc = blocks
    # A partition is a cell: rows go straight to the partition that their cell's number names, so
    # no task gets two cells while another gets none, and the number of tasks grows with the cells.
    cell = (F.col("bq") * bc + F.col("bc")).cast("int")
    qb = (q.withColumn("bq", F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int"))
          .withColumn("bc", F.explode(F.sequence(F.lit(0), F.lit(bc - 1))))
          .select("qid", "vec", cell.alias("cell")).repartitionById(bq * bc, "cell"))
    cb = (c.withColumn("bc", F.pmod(F.xxhash64("doc_id"), F.lit(bc)).cast("int"))
          .withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
          .select("doc_id", "vec", cell.alias("cell")).repartitionById(bq * bc, "cell"))
    fields = [T.StructField("qid", q.schema["qid"].dataType), T.StructField("doc_id", c.schema["doc_id"].dataType),
              T.StructField("score", T.DoubleType())]
    cells = qb.groupBy("cell").cogroup(cb.groupBy("cell"))
    if bc == 1:  # a question met all passages in its cell
        return cells.applyInArrow(_cell_topk_arrow(k, metric, exclude_self, nan_score, ranks=True), T.StructType([*fields, T.StructField("rank", T.IntegerType())]))
    local = cells.applyInArrow(_cell_topk_arrow(k, metric, exclude_self, nan_score), T.StructType(fields))
    return rank_within(local, "qid", k)


def rank_within(scored: DataFrame, key: str, k: int | None) -> DataFrame:
    """Order a run by score (desc, doc_id desc) per ``key`` and cut at ``k`` (K3 ``rerank``)."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("doc_id").desc())
    out = scored.withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out


#: Doubles are taken apart into whole multiples of powers of 2**32, of which a double has three at most.
_BITS = 32


def exact_parts(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, multiple) pairs with ``x`` = the sum of ``multiple * 2**(32 * place)``; multiples are whole and below 2**32."""
    parts = []
    for _ in range(3):
        place = np.floor_divide(np.frexp(x)[1] - 1, _BITS).astype(np.int64)
        # scaled in two steps, as 2**(32 * place) may be too small for a double
        multiple = np.trunc(np.ldexp(x, -(_BITS * place).astype(np.int32)))
        parts.append((place, multiple))
        x = x - np.ldexp(multiple, (_BITS * place).astype(np.int32))
    return parts


def _vector_sums(df: DataFrame, key: str, vector: str, mask: str | None) -> DataFrame:
    """``(k, n, dim, place, total, odd)``: for each Arrow batch the exact sums of a key's unmasked vectors, by dimension and
    power of 2**32, as whole numbers; ``odd`` has bits for what else there is (1: infinite, 2: minus infinite, 4: no number). ``n`` counts vectors, on rows without a dimension."""
    keep = F.col(vector).isNotNull()
    if mask is not None:
        keep = keep & (F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) != 0)
    rows = df.where(keep).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    ship_code(df.sparkSession)
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()),
                           T.StructField("place", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("odd", T.IntegerType())])

    def run(batches):
        for b in batches:
            out = []
            for k, own in b.groupby("k", dropna=False, sort=False):
                k = None if pd.isna(k) else k
                out.append((k, len(own), None, None, None, None))
                m = np.stack(own["v"].to_numpy())
                finite = np.isfinite(m)
                for dim in np.flatnonzero(~finite.all(axis=0)):
                    c = m[:, dim]
                    out.append((k, 0, dim, 0, 0, int((c == np.inf).any()) | 2 * int((c == -np.inf).any()) | 4 * int(np.isnan(c).any())))
                for place, multiple in exact_parts(np.where(finite, m, 0.0)):
                    low = int(place.min())
                    sums = np.zeros((m.shape[1], int(place.max()) - low + 1), np.int64)
                    np.add.at(sums, (np.broadcast_to(np.arange(m.shape[1]), m.shape), place - low), multiple.astype(np.int64))
                    out += [(k, 0, int(d), int(p) + low, int(sums[d, p]), 0) for d, p in zip(*np.nonzero(sums))]
                out += [(k, 0, d, 0, 0, 0) for d in range(m.shape[1])]  # dimensions that are zero throughout
            yield pd.DataFrame(out, columns=schema.names).astype({"dim": "Int32", "place": "Int32", "total": "Int64", "odd": "Int32"})

    return rows.mapInPandas(run, schema)


def mean_pool_long(df: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """Masked mean of vectors per ``key`` -> ``(key, dim, value)``; an all-masked key has no rows.

    Sums are exact: each number goes apart into whole multiples of powers of 2**32, which are added as whole numbers,
    batch by batch and then by a grouped aggregate with map-side partial sums, so the result has the same bits
    whatever the partitions. A hot key never gathers its rows in one place.
    """
    each = materialize(_vector_sums(df, key, vector, mask), "sums")
    numbers = each.where("dim is null").groupBy("k").agg(F.sum("n").alias("n"))
    places = (each.where("dim is not null").groupBy("k", "dim", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.bit_or("odd").alias("odd"))
              .groupBy("k", "dim").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("ps"), F.bit_or("odd").alias("odd")))  # 70 places at most
    total = places.withColumn("k_", F.struct("k")).join(numbers.select(F.struct("k").alias("k_"), "n"), "k_").select("k", "dim", "ps", "odd", "n")
    schema = T.StructType([total.schema["k"], total.schema["dim"], total.schema["odd"], T.StructField("value", T.DoubleType())])

    def run(batches):  # a row for each key and dimension
        for b in batches:
            yield b[["k", "dim", "odd"]].assign(value=[_mean(ps, n) for ps, n in zip(b["ps"], b["n"])])

    odd = F.when(F.col("odd") == 0, F.col("value")).when(F.col("odd") == 1, float("inf")).when(F.col("odd") == 2, float("-inf")).otherwise(float("nan"))
    return total.mapInPandas(run, schema).select(F.col("k").alias(key), "dim", odd.alias("value"))


def _mean(places, n: int) -> float:
    """The mean nearest to the exact one."""
    low = min(p["place"] for p in places)
    whole = sum(int(p["total"]) << _BITS * (p["place"] - low) for p in places)
    try:
        return float(Fraction(whole, n) * Fraction(2) ** (_BITS * low))
    except OverflowError:
        return math.inf if whole > 0 else -math.inf


def mean_pool(df: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """A1: masked mean vector per ``key`` -> ``(key, vector array<double>)``; all-masked -> null."""
    # One row per dimension per key: the collected array is bounded by the vector width.
    means = mean_pool_long(df, key, vector, mask).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_dims"))
    return df.select(key).distinct().join(means, key, "left").select(
        key, F.transform("_dims", lambda d: d["value"]).alias(vector))
