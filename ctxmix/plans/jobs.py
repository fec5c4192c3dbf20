"""Composed evaluation jobs (X1-X8): whole sweeps as single Spark jobs.

Common inputs:

* ``questions``: ``(qid, question)`` (+ ``gold_answer``, ``supporting_facts`` when needed)
* ``query_vectors`` / ``passage_vectors``: ``(qid, embedding)`` / ``(doc_id, embedding)``
  (produce them with :func:`ctxmix.operators.inference.encode` or load them, S7)
* ``passages``: ``(doc_id, title, text)``
* ``run``: a stored run ``(qid, doc_id, rank, score, title, text)``; a row's position among its
  question's rows counts, not the value of ``rank``, which has gaps where unknown ids were dropped
* ``asked``: ``(qid)`` of the questions that a stored run was made for; questions without
  any row in the run are asked with no contexts. Without it the run's own questions are asked.
* ``generator``: a factory for :func:`ctxmix.operators.inference.generate`

Each job returns ``(predictions, metrics)``: scored prediction rows keyed by
``(experiment, variant, qid)`` and one metrics row per variant. Predictions are narrow; pass
``wide=True`` to get contexts and prompts attached. Variants are rows, so every
ratio / k / config of a sweep shares one retrieval and one generation pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import build_prompt
from ..operators import contexts as C
from ..operators import gold as G
from ..operators import inference as I
from ..operators import retrieval as R
from ..operators import sampling as SM
from ..operators import scoring as S
from ..operators.skew import lookup
from ..session import materialize
from ..sources import io as IO

CTX_FIELDS = ["doc_id", "title", "text", "score", "role"]
ROLES = ("gold", "hard_negative", "relevant", "random", "topk", "oracle")
EXPERIMENT_ORDER = ("oracle", "baseline", "random_negatives", "hard_negatives")


def percent(prefix: str, ratio: float) -> str:
    """``prefix_25pct``; a ratio that is no whole percent is written out, so no two share a name."""
    pct = round(ratio * 100, 9)
    return f"{prefix}_{int(pct)}pct" if pct == int(pct) else f"{prefix}_{pct:g}pct".replace(".", "p")


def _named(variants: Sequence[dict]) -> list[dict]:
    names = [v["variant"] for v in variants]
    if len(set(names)) < len(names):
        raise ValueError(f"variants share a name: {names}")
    return list(variants)


def finish(contexts: DataFrame, records: DataFrame, experiment: str,
           generator: Callable, gold: DataFrame | None, seed: int = 42,
           shuffle: bool = True, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shared tail: shuffle (R3) -> collect (A4) -> prompt (P8) -> generate
    -> gold answers (J4) -> score (F8) -> evaluate (A2).

    ``contexts``: long ``(variant, qid, doc_id, title, text, score, role, ord)``;
    ``records``: one row per ``(variant, qid, question)`` that must produce a prediction.
    Prompts are written once; answers are joined to narrow rows, by the prompt's hash.
    """
    keys = ["variant", "qid"]
    ctx = contexts.withColumn("doc_id", F.col("doc_id").cast("string"))
    if shuffle:
        ctx = SM.shuffle_contexts(ctx, keys, ["role", "ord"], seed=seed)
    else:
        ctx = ctx.withColumn("position", F.col("ord"))
    collected = C.collect_contexts(ctx, keys, CTX_FIELDS)
    rec = C.attach_contexts(records, collected, keys)
    # A3 from the prompt's own context array: no second pass over the contexts.
    for r in ROLES:
        rec = rec.withColumn(f"num_{r}", F.size(F.filter("contexts", lambda c: c["role"] == r)))
    rec = rec.withColumn("prompt", build_prompt("question", "contexts")).withColumn("prompt_hash", F.sha2("prompt", 256))
    # a prompt has its contexts' texts: they are not written beside it, unless asked for
    rec = rec.withColumn("prompt_row", F.monotonically_increasing_id())
    # dealt by the keys that its rows come by: the chosen prompts go to the model from where they lie, without a shuffle
    store = materialize(rec if wide else rec.drop("contexts", "question"), "prompts", "zstd", keys)
    narrow = store.drop("contexts", "prompt", "question", "prompt_row")
    answers = I.answer(store.select(*keys, "prompt_row", "prompt_hash", "prompt"), generator, keys=["prompt_row"], dealt=keys)
    out = lookup(narrow, answers, "prompt_hash", "size")  # a prompt may be that of very many rows
    if gold is not None:
        out = C.attach_gold_answers(out.drop("gold_answer"), gold)
    elif "gold_answer" not in out.columns:
        out = out.withColumn("gold_answer", F.lit("")).withColumn("has_gold", F.lit(False))
    scored = S.score_answers(out).withColumn("experiment", F.lit(experiment))
    variants = records.select("variant").distinct().withColumn("experiment", F.lit(experiment))
    metrics = S.evaluate(scored, ("experiment", "variant"), variants)
    if wide:
        scored = scored.join(store.select(*keys, "question", "contexts", "prompt"), keys)
    return scored, metrics


def _asked(questions: DataFrame, run: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The questions that the run was made for, with or without rows in it."""
    return C.keep_all_questions(questions, run if asked is None else asked)


def baseline_topk(questions, query_vectors, passage_vectors, passages, generator,
                  ks: Sequence[int] = (1, 3, 5), gold: DataFrame | None = None, wide: bool = False):
    """Retrieve once at max(k); each k is a variant; contexts in rank order."""
    run = materialize(R.topk_cosine(query_vectors, passage_vectors, max(ks)))
    variants = _named([{"variant": f"top{k}", "k": k} for k in ks])
    picked = C.top_k_slice(C.with_variants(C.top_k_slice(run, max(ks)), variants), "k")
    ctx = C.attach_passages(picked, passages).withColumn("role", F.lit("topk")) \
        .withColumn("ord", F.col("rank"))
    recs = C.with_variants(_asked(questions, run, query_vectors.where(F.col("embedding").isNotNull())).select("qid", "question"),
                           [{"variant": v["variant"]} for v in variants])
    return finish(ctx, recs, "baseline", generator, gold, shuffle=False, wide=wide)


def random_negatives(questions, query_vectors, passage_vectors, passages, generator, *,
                     gold_titles: DataFrame, total: int = 5,
                     ratios: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), k_retrieval: int = 100,
                     gold: DataFrame | None = None, seed: int = 42, wide: bool = False):
    """Top ``n_keep`` retrieved + ``n_noise`` random passages that are neither gold
    (substring title rule) nor already used."""
    run = materialize(R.topk_cosine(query_vectors, passage_vectors, k_retrieval))
    variants = _named([dict(v, variant=percent("random_noise", v["ratio"]))
                       for v in C.ratio_variants(ratios, total)])
    vsel = [{k: v[k] for k in ("variant", "n_keep", "n_noise")} for v in variants]
    keep_max = max(v["n_keep"] for v in vsel)
    known = C.top_k_slice(run, keep_max).join(passages.select("doc_id"), "doc_id", "left_semi")
    relevant = C.top_k_slice(C.with_variants(known, vsel), "n_keep")
    # Used as contexts and as exclusions, by id; texts are joined once, to all picks.
    relevant = materialize(relevant.select("variant", "qid", "doc_id", "score",
                                           F.col("rank").alias("ord"),
                                           F.lit("relevant").alias("role")), "relevant")
    pool = SM.lay_out(passages.select("doc_id", G.lower_title("title").alias("ltitle")), ["doc_id"], "ltitle")
    asked = materialize(_asked(questions, run, query_vectors.where(F.col("embedding").isNotNull())).select("qid", "question"), "asked")
    requests = C.with_variants(asked.select("qid"), vsel).withColumnRenamed("n_noise", "need")
    drawn = SM.sample_without_replacement(
        requests, pool, keys=["variant", "qid"], seed=seed,
        exclude=relevant.select("variant", "qid", "doc_id"), exclude_groups=G.gold_title_groups(gold_titles, passages))
    rnd = drawn.select("variant", "qid", "doc_id", F.lit(0.0).alias("score"),
                       F.col("draw").alias("ord"), F.lit("random").alias("role"))
    recs = C.with_variants(asked, [{"variant": v["variant"]} for v in vsel])
    return finish(C.attach_passages(C.mix_contexts(relevant, rnd), passages), recs, "random_negatives", generator, gold,
                  seed=seed, wide=wide)


def random_from_run(run: DataFrame, questions, generator, *, passages: DataFrame | None = None, total: int = 5,
                    ratios: Sequence[float] = (0.0, 0.5, 1.0), num_questions: int | None = None,
                    band: tuple[int, int] = (50, 100), gold: DataFrame | None = None,
                    asked: DataFrame | None = None, seed: int = 42, wide: bool = False):
    """Stored run; random contexts come from positions ``band`` of every other question
    (duplicates kept). ``num_questions`` asks the first ones only (P2), by ``seq``.

    Text is joined to the picks only: from ``passages`` if given, else from the run's own rows.
    """
    ids = materialize(C.renumber(run.select("qid", "doc_id", "score", "rank")), "positions")
    variants = _named([{"variant": percent("random_noise", v["ratio"]), "n_keep": v["n_keep"],
                        "n_noise": v["n_noise"]} for v in C.ratio_variants(ratios, total)])
    ask = _asked(questions, run, asked)
    if num_questions is not None:
        ask = C.first_n_questions(ask, num_questions, "seq")
    ask = materialize(ask.select("qid", "question"), "asked")
    keep_max = max(v["n_keep"] for v in variants)
    mine = C.top_k_slice(ids, keep_max).join(ask.select("qid"), "qid", "left_semi")
    relevant = C.top_k_slice(C.with_variants(mine, variants), "n_keep").select(
        "variant", "qid", "doc_id", "score", F.col("rank").alias("ord"), F.lit("relevant").alias("role"))
    pool = SM.lay_out(
        C.rank_band(ids, *band).select(F.col("qid").alias("owner"), F.col("rank").alias("owner_rank"), "doc_id"),
        ["owner", "owner_rank"], "owner")
    requests = C.with_variants(ask.select("qid"), variants).withColumnRenamed("n_noise", "need")
    drawn = SM.sample_without_replacement(
        requests, pool, keys=["variant", "qid"], seed=seed,
        exclude_groups=ask.select("qid", F.col("qid").alias("owner")))
    rnd = drawn.select("variant", "qid", "doc_id", F.lit(0.0).alias("score"), F.col("draw").alias("ord"), F.lit("random").alias("role"))
    picks = C.mix_contexts(relevant, rnd)
    if passages is None:  # a passage has one title and text, whichever row of the run shows it
        wanted = picks.select("doc_id").distinct()
        passages = run.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(
            F.max_by(F.struct("title", "text"), F.struct("qid", "rank")).alias("p")).select("doc_id", "p.*")
    ctx = C.attach_passages(picks, passages)
    recs = C.with_variants(ask, [{"variant": v["variant"]} for v in variants])
    return finish(ctx, recs, "random_negatives", generator, gold, seed=seed, wide=wide)


def hard_negatives(questions, query_vectors, passage_vectors, passages, generator, *,
                   gold_titles: DataFrame, total: int = 5,
                   ratios: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), k_retrieval: int = 100,
                   min_quota: int = 1, gold: DataFrame | None = None, seed: int = 42, wide: bool = False):
    """Substring-title gold on the ranked rows, first ``n_keep`` gold and first
    ``n_noise`` non-gold per ratio (``min_quota=1`` is the ratio path's rule)."""
    # Retrieval is materialized as ids; labelling needs titles only, and text is
    # attached to the few selected rows, not to the whole top-k run.
    run = materialize(R.topk_cosine(query_vectors, passage_vectors, k_retrieval), "ranked")
    titled = C.attach_passages(run, passages.select("doc_id", "title"))
    labelled = G.split_gold_by_title(titled, gold_titles, how="substring")
    variants = _named([dict(v, variant=percent("hard_neg", v["ratio"]))
                       for v in C.ratio_variants(ratios, total, (min_quota,))])
    sel = C.select_gold_and_hard(labelled, variants, min_quota=min_quota)
    ctx = sel.join(passages.select("doc_id", "text"), "doc_id").select(
        "variant", "qid", "doc_id", "title", "text", "score", "ord", "role")
    recs = C.with_variants(_asked(questions, run, query_vectors.where(F.col("embedding").isNotNull())).select("qid", "question"),
                           [{"variant": v["variant"]} for v in variants])
    return finish(ctx, recs, "hard_negatives", generator, gold, seed=seed, wide=wide)


def hard_negatives_from_run(run: DataFrame, questions, generator, *, gold_titles: DataFrame,
                            configs: Sequence[tuple[int, int, int]] = (
                                (5, 0, 0), (4, 1, 0), (3, 2, 0), (0, 5, 0), (3, 2, 5)),
                            gold: DataFrame | None = None, asked: DataFrame | None = None, seed: int = 42, wide: bool = False):
    """Exact-title gold from a stored run, configs (k_gold, k_hard, mix_topk)."""
    cfg = _named([{"variant": f"gold{g}_hard{h}" + (f"_top{m}" if m else ""), "k_gold": g,
                   "k_hard": h, "mix_topk": m} for g, h, m in configs])
    labelled = G.split_gold_by_title(C.renumber(run), gold_titles, how="exact")
    sel = C.select_config_mix(labelled, cfg)
    ctx = sel.select("variant", "qid", "doc_id", "title", "text", "score", "ord", "role")
    recs = C.with_variants(_asked(questions, run, asked).select("qid", "question"),
                           [{"variant": c["variant"]} for c in cfg])
    return finish(ctx, recs, "hard_negatives", generator, gold, seed=seed, wide=wide)


def oracle(questions: DataFrame, generator, num_samples: int | None = None, wide: bool = False):
    """Gold sentences only (upper bound). ``questions`` nested (S1 schema); ``num_samples``
    asks the first ones only (P2), by ``seq``."""
    q = questions if num_samples is None else C.first_n_questions(questions, num_samples, "seq")
    q = materialize(q)
    oc = G.oracle_contexts(q).withColumn("variant", F.lit("oracle_gold_only")) \
        .withColumn("role", F.lit("oracle")).withColumnRenamed("position", "ord")
    recs = q.select("qid", "question").withColumn("variant", F.lit("oracle_gold_only"))
    return finish(oc, recs, "oracle", generator, q.select("qid", "gold_answer"), shuffle=False, wide=wide)


def rescore_run(run: DataFrame, questions, generator, ks: Sequence[int] = (1, 3, 5),
                gold: DataFrame | None = None, asked: DataFrame | None = None, wide: bool = False):
    """Generate and score on the first k stored contexts, for each k."""
    variants = _named([{"variant": f"baseline_top{k}", "k": k} for k in ks])
    first = C.top_k_slice(C.renumber(run), max(ks))
    ctx = C.top_k_slice(C.with_variants(first, variants), "k").withColumn(
        "role", F.lit("topk")).withColumn("ord", F.col("rank"))
    recs = C.with_variants(_asked(questions, run, asked).select("qid", "question"),
                           [{"variant": v["variant"]} for v in variants])
    return finish(ctx, recs, "baseline", generator, gold, shuffle=False, wide=wide)


def evaluate_folder(spark, paths: str | Sequence[str], fmt: str = "json_array",
                    name: str = IO.STEM) -> tuple[DataFrame, DataFrame]:
    """S4 -> F8 -> A2 -> X8: score the result files at ``paths`` (files, folders or globs).

    Returns scored rows with their variant columns, and the summary: one row per run, with 0 samples for a
    run whose files hold no record. ``name`` is a pattern whose group is a file's run; by default its stem.
    """
    rows = IO.read_predictions(spark, paths, fmt, name=name)
    scored = materialize(S.score_answers(rows.withColumn("has_gold", F.col("gold_answer").isNotNull())), "scored")
    runs = IO.result_files(spark, paths, name).select(F.lit("results").alias("experiment"), F.col("run").alias("variant")).distinct()
    metrics = S.evaluate(scored.select(F.lit("results").alias("experiment"), F.col("run").alias("variant"), "exact_match", "cover_exact_match", "has_gold"),
                         ("experiment", "variant"), runs)
    return scored, summarize(metrics)


def summarize(*metrics: DataFrame) -> DataFrame:
    """All runs' metrics, EM/CEM in percent, fixed experiment order then name."""
    m = metrics[0]
    for x in metrics[1:]:
        m = m.unionByName(x, allowMissingColumns=True)
    return S.summary(m, EXPERIMENT_ORDER)
