"""Context selection: slices, variants and quotas, gold/hard-negative picks, mixing, assembly.

Everything is long format ``(variant..., qid, doc_id, rank, score, role)`` until prompt
time. Variants (ratios, k values, config tuples) are a parameter list exploded onto each
row as a literal array (a Generate: no join, no shuffle), so a whole sweep is one Spark
job rather than a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --------------------------------------------------------------------------- variants

def ratio_variants(ratios: Sequence[float], total: int,
                   min_quotas: Sequence[int] = (0,)) -> list[dict]:
    """Sweep points ``(variant_id, ratio, min_quota, n_noise, n_keep)``.

    P7: ``n_noise = int(total * ratio)`` (truncation), ``n_keep = total - n_noise``;
    ``variant_id = round(ratio * 100) * 10 + min_quota``.
    """
    out = []
    for r in ratios:
        for m in min_quotas:
            n_noise = int(total * float(r))
            out.append({"variant_id": int(round(float(r) * 100)) * 10 + int(m),
                        "ratio": float(r), "min_quota": int(m),
                        "n_noise": n_noise, "n_keep": total - n_noise})
    return out


def variant_quotas(variants: DataFrame, total: int, ratio: str = "ratio") -> DataFrame:
    """P7 on a variants DataFrame: ``n_noise = int(total * ratio)``, ``n_keep = total - n_noise``."""
    n_noise = (F.lit(total) * F.col(ratio)).cast("int")
    return (variants.withColumn("n_noise", n_noise)
            .withColumn("n_keep", F.lit(total) - F.col("n_noise")))


def _lit(v):
    if isinstance(v, bool) or v is None:
        return F.lit(v)
    if isinstance(v, int):
        return F.lit(v).cast("int")
    if isinstance(v, float):
        return F.lit(v).cast("double")
    return F.lit(v)


def variants_column(variants: Sequence[dict]) -> "F.Column":
    """The variant list as a literal ``array<struct>`` (parameter-sized, built on the driver)."""
    return F.array(*[F.struct(*[_lit(v).alias(k) for k, v in row.items()]) for row in variants])


def with_variants(df: DataFrame, variants: Sequence[dict]) -> DataFrame:
    """Repeat each row once per variant (a Generate, no join and no shuffle)."""
    return (df.withColumn("_variant", F.explode(variants_column(variants)))
            .select("*", "_variant.*").drop("_variant"))


def variants_frame(spark: SparkSession, variants: Sequence[dict]) -> DataFrame:
    """The variant list as a one-partition DataFrame (for reports and left joins)."""
    return spark.range(1).select(F.explode(variants_column(variants)).alias("v")).select("v.*")


# --------------------------------------------------------------------------- slices

def first_n_questions(questions: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` questions in file order (a top-n; planned as TakeOrderedAndProject)."""
    return questions.orderBy(order).limit(n)


def top_k_slice(ranked: DataFrame, k, rank: str = "rank") -> DataFrame:
    """Keep ranks ``<= k``; ``k`` may be an int or a column (per-variant k)."""
    kk = F.lit(k) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k)
    return ranked.where(F.col(rank) <= kk)


def rank_band(ranked: DataFrame, lo: int, hi: int, rank: str = "rank") -> DataFrame:
    """P5: zero-based positions ``lo .. hi-1``, i.e. ranks ``lo+1 .. hi``."""
    return ranked.where((F.col(rank) > lo) & (F.col(rank) <= hi))


# --------------------------------------------------------------------------- joins

def attach_passages(ranked: DataFrame, passages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ranked ids -> passage columns; ids unknown to the corpus are dropped (inner join).

    Neither side has a proven size bound, so no broadcast hint: AQE switches to a
    broadcast at runtime only if the measured side is small.
    """
    return ranked.join(passages, on=doc_id, how="inner")


def renumber(run: DataFrame, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """Positions 1, 2, ... in rank order: a stored run has gaps where unknown ids were dropped."""
    w = Window.partitionBy(qid).orderBy(rank, "doc_id")  # a question's rows: the retrieval depth
    return run.withColumn(rank, F.row_number().over(w).cast("int"))


def keep_all_questions(questions: DataFrame, asked: DataFrame, qid: str = "qid") -> DataFrame:
    """The questions that were asked, whether or not anything was retrieved for them.

    ``asked`` is the question list of the run. Given the rows of a run itself, a question
    without rows counts as not asked: store the list beside the run to keep those.
    """
    return questions.join(asked.select(qid).distinct(), on=qid, how="left_semi")


def attach_gold_answers(df: DataFrame, gold: DataFrame, qid: str = "qid",
                        answer: str = "gold_answer", order: str | None = None) -> DataFrame:
    """Left join gold answers; a missing answer becomes '' and ``has_gold`` is false.

    Of several gold rows for one question the last by ``order`` counts (without an order: the
    largest answer), so rows never multiply.
    """
    last = F.max(answer) if order is None else F.max_by(answer, order)
    g = gold.groupBy(qid).agg(last.alias("_gold"))
    out = df.join(g, on=qid, how="left")
    return (out.withColumn("has_gold", F.col("_gold").isNotNull())
            .withColumn(answer, F.coalesce(F.col("_gold").cast("string"), F.lit("")))
            .drop("_gold"))


# --------------------------------------------------------------------------- quota picks

def role_order(ranked: DataFrame, is_gold: str = "is_gold", qid: str = "qid",
               rank: str = "rank") -> DataFrame:
    """``ord``: 1-based position of a row among the gold (or the non-gold) rows of its question.

    One window per (question, gold flag); its size is the retrieval depth, never a hot key.
    """
    w = Window.partitionBy(qid, is_gold).orderBy(F.col(rank), F.col("doc_id"))
    return ranked.withColumn("ord", F.row_number().over(w))


def select_gold_and_hard(ranked: DataFrame, variants: Sequence[dict], *, n_gold: str = "n_keep",
                         n_hard: str = "n_noise", min_quota="min_quota",
                         is_gold: str = "is_gold", qid: str = "qid",
                         rank: str = "rank") -> DataFrame:
    """K4 + K5 in one pass: first ``n_gold`` gold rows and first ``n_hard`` non-gold rows.

    ``min_quota`` reproduces the ratio path, where a quota of 0 still yields one row
    (``min_quota=1``); ``0`` is the guarded path. Adds ``role`` in {'gold','hard_negative'}.
    Rows past the largest quota of any variant are dropped before the variants are
    generated, so the work is rows x variants only for rows that can be picked.
    """
    mq = F.lit(min_quota) if isinstance(min_quota, int) else F.col(min_quota)
    ordered = role_order(ranked, is_gold, qid, rank)
    def floor_of(v: dict) -> int:
        return v.get(min_quota, 0) if isinstance(min_quota, str) else min_quota

    cap = max((max(v[n_gold], v[n_hard], floor_of(v)) for v in variants), default=0)
    ordered = ordered.where(F.col("ord") <= cap)
    quota = F.greatest(F.when(F.col(is_gold), F.col(n_gold)).otherwise(F.col(n_hard)), mq)
    out = with_variants(ordered, variants).where(F.col("ord") <= quota)
    return out.withColumn("role", F.when(F.col(is_gold), F.lit("gold"))
                          .otherwise(F.lit("hard_negative")))


def select_config_mix(ranked: DataFrame, configs: Sequence[dict], *, k_gold: str = "k_gold",
                      k_hard: str = "k_hard", mix_topk: str = "mix_topk",
                      is_gold: str = "is_gold", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """X5 selection: gold[:k_gold] + non_gold[:k_hard] + ranked[:mix_topk], duplicates kept.

    A row picked both as gold/hard and as plain top-k appears twice, with roles
    'gold'/'hard_negative' and 'topk'.
    """
    ordered = role_order(ranked, is_gold, qid, rank)
    cap = max((max(c[k_gold], c[k_hard], c[mix_topk]) for c in configs), default=0)
    ordered = ordered.where((F.col("ord") <= cap) | (F.col(rank) <= cap))
    role_quota = F.when(F.col(is_gold), F.col(k_gold)).otherwise(F.col(k_hard))
    cond = (F.col("ord") <= role_quota) | (F.col(rank) <= F.col(mix_topk))
    joined = with_variants(ordered, configs).where(cond)
    roles = F.array(
        F.when(F.col("ord") <= role_quota,
               F.when(F.col(is_gold), F.lit("gold")).otherwise(F.lit("hard_negative"))),
        F.when(F.col(rank) <= F.col(mix_topk), F.lit("topk")))
    return (joined.withColumn("role", F.explode(F.filter(roles, lambda r: r.isNotNull())))
            .withColumn("ord", F.when(F.col("role") == "topk", F.col(rank))
                        .otherwise(F.col("ord"))))


def mix_contexts(*parts: DataFrame) -> DataFrame:
    """Bag union of context sets (UNION ALL by name; duplicates kept)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def context_counts(contexts: DataFrame, keys: Sequence[str], roles: Sequence[str],
                   requests: DataFrame | None = None, role: str = "role") -> DataFrame:
    """A3: achieved count per role for each request (may be below quota).

    ``requests`` (all ``keys`` combinations that must appear) keeps empty requests at 0.
    """
    aggs = [F.count_if(F.col(role) == r).cast("int").alias(f"num_{r}") for r in roles]
    counts = contexts.groupBy(*keys).agg(*aggs)
    if requests is None:
        return counts
    out = requests.select(*keys).join(counts, on=list(keys), how="left")
    for r in roles:
        out = out.withColumn(f"num_{r}", F.coalesce(F.col(f"num_{r}"), F.lit(0)))
    return out


def collect_contexts(contexts: DataFrame, keys: Sequence[str], fields: Sequence[str],
                     position: str = "position") -> DataFrame:
    """A4: contexts of one prompt as an array in ``position`` order.

    Only used on selected contexts, whose count per prompt is a quota (bounded).
    """
    packed = F.struct(F.col(position).alias("position"), *[F.col(f) for f in fields])
    agg = contexts.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("contexts"))
    return agg


def attach_contexts(records: DataFrame, collected: DataFrame, keys: Sequence[str],
                    element: T.DataType | None = None) -> DataFrame:
    """Left join collected contexts to every record; a record without contexts gets ``[]``."""
    out = records.join(collected, on=list(keys), how="left")
    empty = F.array() if element is None else F.array().cast(T.ArrayType(element))
    return out.withColumn("contexts", F.coalesce(F.col("contexts"), empty))
