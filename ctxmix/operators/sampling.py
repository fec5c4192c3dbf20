"""Reproducible sampling without replacement, and prompt-order shuffling.

Definition (independent of partitioning): the pool lies in one order, rows of an exclusion group next to each
other. For each request the rows that it may have are numbered ``0 .. available-1`` in that order, a keyed
permutation of these numbers decides, and the sample is the rows at the permuted places of
``0 .. min(need, available)-1``. Every draw hits a row of its own that is not excluded.

The permutation is a four-round Feistel network on ``a x b`` places, ``a`` the square root of the available rows
rounded up and ``b`` just large enough; a place beyond the available ones (fewer than ``a`` are) is permuted again
until it is one of them.

Execution (rank and select): what a request may not have is a list of intervals of the pool's order, one for
an excluded group however large it is, one for an excluded row. A running sum over a request's sorted intervals says
how many rows each leaves before it; a draw is put among these numbers by a second running sum, which
adds the excluded rows before it and so turns its number into a place in the pool. A request costs its
intervals and its draws, whatever it excludes; the draws are then joined to the pool by index. No
Q x N join is formed, nothing is drawn in vain, and nothing comes to the driver but the sizes of
the pool's partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import keyed_hash
from ..session import materialize
from .skew import salted_join

_STEP = 4096
#: Exclusion groups or rows of a pool that are broadcast at most.
_FEW = 20_000


class Pool(NamedTuple):
    rows: DataFrame           # pool columns and ``idx``, dense from 0
    size: int
    group: str | None         # column of exclusion groups
    spans: DataFrame | None   # (group, start, length): where a group's rows lie


def dense_index(pool: DataFrame, order: Sequence[str], idx: str = "idx") -> tuple[DataFrame, int]:
    """Add a dense 0-based ``idx`` in the total order of ``order`` (must be unique).

    Range-partitioned sort, then per-partition row counts turned into offsets (one
    row per partition, broadcast). No single-partition window over the pool.
    Returns the checkpointed indexed pool and its size.
    """
    tagged = (pool.orderBy(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, "indexed")
    # One count per partition of the pool (not per row): bounded by the partition count,
    # so it may come to the driver to become offsets, like RDD.zipWithIndex does.
    counts = sorted((r["_pid"], r["_n"]) for r in
                    tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, run = [], 0
    for pid, n in counts:
        offsets.append((pid, run))
        run += n
    spark = pool.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = (tagged.join(F.broadcast(off), "_pid")
           .withColumn(idx, F.col("_off") + local)
           .drop("_pid", "_mid", "_off"))
    return out, run


def lay_out(pool: DataFrame, order: Sequence[str], group: str | None = None) -> Pool:
    """Index the pool by group (nulls first), then ``order``, which names its rows uniquely."""
    rows, size = dense_index(pool, list(dict.fromkeys([*([group] if group else []), *order])))
    spans = None
    if group:
        spans = materialize(rows.where(F.col(group).isNotNull()).groupBy(group).agg(
            F.min("idx").alias("start"), F.count(F.lit(1)).alias("length")), "spans")
    return Pool(rows, size, group, spans)


def _rounds(left: Column, right: Column, a: Column, b: Column, seed: int, keys: Sequence[str]):
    """The halves after each round; every round changes one of them by a hash of the other."""
    for r in range(4):
        mix = keyed_hash(F.lit(seed), *keys, F.lit(r), left if r % 2 else right)
        left, right = (left, (right + mix) % b) if r % 2 else ((left + mix) % a, right)
        left, right = yield left, right


def _permuted_once(x: Column, a: Column, b: Column, seed: int, keys: Sequence[str]) -> Column:
    right = x % b
    halves = _rounds(((x - right) / b).cast("long"), right, a, b, seed, keys)
    pair = next(halves)
    for _ in range(3):
        pair = halves.send(pair)
    return pair[0] * b + pair[1]


def with_permuted(df: DataFrame, j: str, out: str, n: str, seed: int, keys: Sequence[str]) -> DataFrame:
    """Add ``out``: the place of ``j`` in the keyed permutation of ``0 .. n-1`` (column ``n``, 1 at least).
    A round is a pair of columns of its own, so that no hash is computed twice."""
    a, b, size = F.col("_a"), F.col("_b"), F.col(n)
    df = df.withColumn("_a", F.ceil(F.sqrt(size.cast("double")))).withColumn("_b", F.expr(f"({n} + _a - 1) div _a"))
    df = df.withColumns({"_l": F.expr(f"{j} div _b"), "_r": F.col(j) % b})
    halves = _rounds(F.col("_l"), F.col("_r"), a, b, seed, keys)
    left, right = next(halves)
    for r in range(4):
        df = df.withColumns({"_l": left, "_r": right})
        if r < 3:
            left, right = halves.send((F.col("_l"), F.col("_r")))
    df = df.withColumn(out, F.col("_l") * b + F.col("_r"))
    again = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - size), F.col(out), lambda x, _: F.when(x < size, x).otherwise(
        _permuted_once(x, a, b, seed, keys)))
    return df.withColumn(out, F.when(F.col(out) < size, F.col(out)).otherwise(again)).drop("_a", "_b", "_l", "_r")


def _draws(pending: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each draw ``lo <= j < hi`` of a request, generated in blocks of 4096 blocks of
    4096 and so on: no array grows with the pool."""
    out = pending
    for level in (_STEP**2, _STEP, 1):
        span = level * _STEP
        count = F.ceil((F.least(F.col("hi"), F.col("lo") + span) - F.col("lo")) / level)
        if level == _STEP**2:
            count = F.ceil((F.col("hi") - F.col("lo")) / level)
        out = (out.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
               .withColumn("lo", F.col("lo") + F.col("_b") * level)
               .withColumn("hi", F.least("hi", F.col("lo") + level)).drop("_b"))
    return out.select(*columns, F.col("lo").alias("j"))


def _intervals(pool: Pool, asked: DataFrame, keys: list[str], exclude: DataFrame | None, exclude_on: list[str],
               exclude_groups: DataFrame | None) -> list[DataFrame]:
    """What requests may not have, as (keys, start, length)."""
    parts = []
    if exclude_groups is not None:
        by = [k for k in keys if k in exclude_groups.columns]
        if not by or pool.group is None:
            raise ValueError("groups are excluded by request keys, from a pool laid out by group")
        banned = exclude_groups.select(*by, pool.group).where(F.col(pool.group).isNotNull()).distinct()
        if pool.spans.count() <= _FEW:  # a written table
            hit = banned.join(F.broadcast(pool.spans), pool.group)
        else:  # a group may be excluded by all
            hit = salted_join(banned, pool.spans, pool.group, by[-1], shuffled=True)
        # requests come from an explode: Spark takes them for fewer than they are, and must not broadcast them for it
        hit = hit if by == keys else hit.join(asked.select(*keys).hint("merge"), by)
        parts.append(hit.select(*keys, "start", "length"))
    if exclude is not None:
        used = exclude.select(*keys, *exclude_on).distinct().join(pool.rows.select(*exclude_on, "idx"), exclude_on)
        parts.append(used.select(*keys, F.col("idx").alias("start"), F.lit(1).cast("long").alias("length")))
    return parts


def draw_places(requests: DataFrame, pool: Pool, *, keys: Sequence[str], need: str = "need", seed: int = 42,
                exclude: DataFrame | None = None, exclude_on: Sequence[str] = ("doc_id",),
                exclude_groups: DataFrame | None = None) -> DataFrame:
    """(keys, draw, idx): each request's draws, from 1, and the pool rows they hit. One shuffle by request."""
    keys = list(keys)
    asked = requests.select(*keys, F.col(need).cast("long").alias("need")).where("need > 0")
    spans = [p.withColumn("need", F.lit(None).cast("long")) for p in _intervals(pool, asked, keys, exclude, list(exclude_on), exclude_groups)]
    # a request comes after its intervals, as one without length behind the pool's end
    end = asked.select(*keys, F.lit(pool.size).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), "need")
    rows = reduce(DataFrame.unionByName, [*spans, end])
    w = Window.partitionBy(*keys).orderBy(F.col("need").isNotNull(), "start", F.desc("length"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0)) > F.col("start")  # a row of an excluded group
    rows = (rows.withColumn("own", F.when(covered, 0).otherwise(F.col("length"))).where("own > 0 or need is not null")
            .withColumn("at", F.col("start") - F.coalesce(F.sum("own").over(before), F.lit(0)))  # for a request: what is available
            .withColumns({"lo": F.lit(0).cast("long"), "hi": F.when(F.col("need").isNull(), 1).otherwise(F.least("need", "at"))})
            .where("hi > 0"))
    drawn = _draws(rows, [*keys, "need", "own", "at"]).withColumn("n", F.when(F.col("need").isNotNull(), F.col("at")))
    drawn = with_permuted(drawn, "j", "place", "n", seed, keys).withColumn("at", F.coalesce("place", "at"))
    skipped = F.sum("own").over(Window.partitionBy(*keys).orderBy("at", F.col("need").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return (drawn.withColumn("idx", F.col("at") + skipped).where("need is not null")
            .select(*keys, (F.col("j") + 1).cast("int").alias("draw"), "idx"))


def sample_without_replacement(requests: DataFrame, pool: Pool, *, keys: Sequence[str], need: str = "need", seed: int = 42,
                               exclude: DataFrame | None = None, exclude_on: Sequence[str] = ("doc_id",),
                               exclude_groups: DataFrame | None = None) -> DataFrame:
    """Sample ``need`` pool rows per request, or all it may have (see module docstring for the definition).

    ``requests``: unique ``keys`` + ``need``.
    ``pool``: from :func:`lay_out`.
    ``exclude``: explicit ``(keys, exclude_on)`` rows to skip (J7); ``exclude_on`` names pool rows uniquely.
    ``exclude_groups``: rows ``(some of keys, group)``: pool rows of that group are skipped (e.g.
    gold titles or labels). Null groups are never excluded.
    Output: request keys, pool columns and 1-based ``draw``.
    """
    places = draw_places(requests, pool, keys=keys, need=need, seed=seed, exclude=exclude, exclude_on=exclude_on, exclude_groups=exclude_groups)
    # places come from an explode as well
    hit = places.join(F.broadcast(pool.rows), "idx") if pool.size <= _FEW else places.join(pool.rows.hint("merge"), "idx")
    return hit.select(*keys, *[c for c in pool.rows.columns if c not in keys], "draw")


def exclude_docs(rows: DataFrame, exclusions: DataFrame, keys: Sequence[str],
                 doc_id: str = "doc_id") -> DataFrame:
    """Drop rows whose ``(keys, doc_id)`` is in ``exclusions`` (left anti join)."""
    on = list(keys) + [doc_id]
    return rows.join(exclusions.select(*on).distinct(), on, "left_anti")


def exclusion_set(*parts: DataFrame) -> DataFrame:
    """Set union of exclusion rows (e.g. gold ids and already used ids)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def shuffle_contexts(contexts: DataFrame, keys: Sequence[str], tiebreak: Sequence[str],
                     seed: int = 42, position: str = "position") -> DataFrame:
    """Random prompt order within each prompt, from a keyed hash (reproducible).

    ``position`` = row_number over ``keys`` ordered by ``keyed_hash(seed, keys, tiebreak)``;
    ``tiebreak`` must make rows unique within a prompt (e.g. role and per-role order,
    so duplicates of one passage stay separate). A prompt's rows are a quota, bounded.
    """
    h = keyed_hash(F.lit(seed), *keys, *tiebreak)
    w = Window.partitionBy(*keys).orderBy(h, *[F.col(t) for t in tiebreak])
    return contexts.withColumn(position, F.row_number().over(w))
