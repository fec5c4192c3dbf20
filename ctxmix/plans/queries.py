"""Registered queries on the driver's tables: one per operator family of the blueprint.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose columns and
types match the DuckDB oracle in :mod:`ctxmix.plans.oracle_sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import vectors as V
from ..operators import contexts as C
from ..operators import gold as G
from ..operators import inference as I
from ..operators import matching as M
from ..operators import retrieval as R
from ..operators import sampling as SM
from ..operators import scoring as S
from ..operators.pruned import topk_pruned
from ..operators.skew import lookup
from ..operators.stored import Stored
from ..session import materialize, scratch_path
from ..sources import io as IO
from . import jobs as J
from . import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RATIOS = (0.0, 0.25, 0.5, 0.75, 1.0)


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def ranked_run(spark: SparkSession, sf_dir: str, k: int, **kw) -> DataFrame:
    """Exact cosine top-k of every question over the whole embeddings corpus."""
    q = tables.retrieval_questions(spark, sf_dir)
    c = tables.retrieval_corpus(spark, sf_dir)
    return R.topk_cosine(q, c, k, **kw)


def labelled_run(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Ranked rows with ``is_gold`` = same label as the question (row-level check, no pairs)."""
    ranked = ranked_run(spark, sf_dir, k)
    ql = tables.retrieval_questions(spark, sf_dir).select("qid", "q_label")
    dl = tables.retrieval_corpus(spark, sf_dir).select("doc_id", "d_label")
    return (ranked.join(ql, "qid").join(dl, "doc_id")
            .withColumn("is_gold", F.coalesce(F.col("q_label") == F.col("d_label"), F.lit(False))))


@register("topk_cosine")
def q_topk_cosine(spark, sf_dir):
    r = ranked_run(spark, sf_dir, 10)
    return r.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("topk_with_self")
def q_topk_with_self(spark, sf_dir):
    r = ranked_run(spark, sf_dir, 11, exclude_self=False, nan_score=None)
    return r.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("centroids")
def q_centroids(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    m = R.mean_pool_long(e, "label", "embedding")
    return m.select("label", F.col("dim").cast("int").alias("dim"),
                    F.round("value", 6).alias("value"))


def hard_negative_selection(spark, sf_dir):
    run = labelled_run(spark, sf_dir, 100)
    variants = C.ratio_variants(RATIOS, 5, (0, 1))
    return C.select_gold_and_hard(run, variants, n_gold="n_keep", n_hard="n_noise",
                                  min_quota="min_quota")


@register("hard_negative_sweep")
def q_hard_negative_sweep(spark, sf_dir):
    sel = hard_negative_selection(spark, sf_dir)
    return sel.select("variant_id", "ratio", "min_quota", "qid", "doc_id", "role", "rank",
                      F.round("score", 6).alias("score"))


@register("hard_negative_counts")
def q_hard_negative_counts(spark, sf_dir):
    sel = hard_negative_selection(spark, sf_dir)
    variants = [{"variant_id": v["variant_id"]} for v in C.ratio_variants(RATIOS, 5, (0, 1))]
    # Every (variant, question) record exists even with no picks.
    requests = C.with_variants(tables.retrieval_questions(spark, sf_dir).select("qid"), variants)
    out = C.context_counts(sel, ["variant_id", "qid"], ["gold", "hard_negative"], requests)
    return out.select("variant_id", "qid", "num_gold", "num_hard_negative")


# --------------------------------------------------------------------------- text and scoring


@register("normalize")
def q_normalize(spark, sf_dir):
    d = tables.documents(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", TX.normalize("text").alias("normalized"))


@register("passage_text")
def q_passage_text(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part")
    title = F.when(F.col("p_size") < 10, F.lit("")).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("doc_id"),
                    TX.passage_text(title, F.col("p_brand")).alias("passage_text"))


def conversation_predictions(spark, sf_dir):
    """Prediction rows = every conversation turn; gold answers keyed by (conv_id, turn):
    user turns -> their text plus a full stop, assistant turns -> their first word,
    system turns -> no gold answer (missing)."""
    c = tables.table(spark, sf_dir, "conversations")
    preds = c.select("conv_id", "turn", "role", F.col("text").alias("prediction"))
    gold = c.where(F.col("role") != "system").select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.concat(F.col("text"), F.lit(".")))
        .otherwise(F.substring_index(F.col("text"), " ", 1)).alias("gold_answer"))
    g = gold.withColumn("qid", F.struct("conv_id", "turn")).select("qid", "gold_answer")
    p = preds.withColumn("qid", F.struct("conv_id", "turn"))
    return C.attach_gold_answers(p, g, "qid").drop("qid")


@register("score_answers")
def q_score_answers(spark, sf_dir):
    scored = S.score_answers(conversation_predictions(spark, sf_dir))
    return scored.select("conv_id", "turn", "role", "has_gold", "exact_match",
                         "cover_exact_match")


@register("evaluate")
def q_evaluate(spark, sf_dir):
    scored = S.score_answers(conversation_predictions(spark, sf_dir)).withColumn(
        "experiment", F.lit("conversations")).withColumnRenamed("role", "variant")
    runs = C.variants_frame(spark, [{"experiment": "conversations", "variant": v}
                                    for v in ("assistant", "system", "tool", "user")])
    m = S.evaluate(scored, ("experiment", "variant"), runs)
    return m.select("experiment", "variant", "num_samples",
                    F.round("exact_match", 6).alias("exact_match"),
                    F.round("cover_exact_match", 6).alias("cover_exact_match"),
                    "n_missing_gold")


@register("duplicate_answers")
def q_duplicate_answers(spark, sf_dir):
    """EM as an equi-join: documents whose normalized texts are equal.

    Each document in a group of equal texts is paired with the group's smallest id
    (linear output; a hot group is aggregated map-side and never expanded to pairs)."""
    d = tables.documents(spark, sf_dir, "doc_id", "text")
    n = d.select("doc_id", F.sha2(TX.normalize("text"), 256).alias("h"))
    groups = materialize(n.groupBy("h").agg(F.min("doc_id").alias("dup_of"), F.count(F.lit(1)).alias("group_size"))
                         .withColumn("rows", F.col("group_size")), "groups")
    return lookup(n, groups, "h", "rows").where(F.col("group_size") > 1).select("doc_id", "dup_of", "group_size")


@register("benchmark_cover")
def q_benchmark_cover(spark, sf_dir):
    """CEM as a join: (document, benchmark item) where the normalized item occurs in the
    normalized document text."""
    d = tables.documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", TX.normalize("text").alias("doc_norm"))
    b = tables.table(spark, sf_dir, "benchmark").select(
        "item_id", TX.normalize("text").alias("item_norm"))
    return M.cover_join(d, b, "doc_norm", "item_norm", "doc_id", "item_id").select(
        "doc_id", "item_id")


# --------------------------------------------------------------------------- gold

def part_gold_titles(spark, sf_dir):
    """Gold titles derived from ``part``: the last word of each name, and each name
    followed by its lower-cased type."""
    p = tables.table(spark, sf_dir, "part")
    last_word = F.lower(F.substring_index(F.col("p_name"), " ", -1))
    full = F.lower(F.concat_ws(" ", F.col("p_name"), F.col("p_type")))
    return (p.select(last_word.alias("gold_title"))
            .unionByName(p.select(full.alias("gold_title"))).distinct())


@register("gold_substring")
def q_gold_substring(spark, sf_dir):
    gold = part_gold_titles(spark, sf_dir).withColumn("qid", F.col("gold_title"))
    passages = tables.part_passages(spark, sf_dir)
    out = G.gold_docs_by_substring(gold, passages, key="qid")
    return out.select(F.col("qid").alias("gold_title"), "doc_id")


def conversation_oracle_inputs(spark, sf_dir):
    """Context paragraphs = turns (title = role, sentences = lines); facts = one per turn
    (title = role, upper-cased for system turns; index = turn - 2)."""
    c = tables.table(spark, sf_dir, "conversations")
    ctx = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("ctx_pos"),
                   F.col("role").alias("title"), F.split(F.col("text"), "\n").alias("sentences"))
    facts = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("fact_pos"),
                     F.when(F.col("role") == "system", F.upper("role")).otherwise(F.col("role"))
                     .alias("title"),
                     (F.col("turn") - 2).cast("int").alias("sent_idx"))
    return ctx, facts


@register("oracle_contexts")
def q_oracle_contexts(spark, sf_dir):
    ctx, facts = conversation_oracle_inputs(spark, sf_dir)
    return G.oracle_contexts_long(ctx, facts).select(
        "qid", "position", "doc_id", "title", "text", "score")


# --------------------------------------------------------------------------- sampling


SEED = 42


def random_negative_contexts(spark, sf_dir):
    """X2 selection: top ``n_keep`` retrieved passages + ``n_noise`` random documents that
    are neither gold (same label) nor already used, for the five noise ratios."""
    variants = C.ratio_variants(RATIOS, 5)
    # The run feeds both the kept contexts and the exclusions: compute it once.
    ranked = materialize(ranked_run(spark, sf_dir, 100))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id")
    relevant = C.attach_passages(
        C.top_k_slice(C.with_variants(C.top_k_slice(ranked, 5), variants), "n_keep"), docs)
    relevant = materialize(relevant.select("variant_id", "qid", "doc_id", "score",
                                           F.col("rank").alias("ord"),
                                           F.lit("relevant").alias("role")), "relevant")
    labels = tables.retrieval_corpus(spark, sf_dir).select("doc_id", "d_label")
    pool = SM.lay_out(docs.join(labels, "doc_id", "left"), ["doc_id"], "d_label")
    asked = tables.retrieval_questions(spark, sf_dir).select("qid", F.col("q_label").alias("d_label"))
    requests = C.with_variants(asked.select("qid"), variants).withColumnRenamed("n_noise", "need")
    drawn = SM.sample_without_replacement(
        requests, pool, keys=["variant_id", "qid"], seed=SEED,
        exclude=relevant.select("variant_id", "qid", "doc_id"), exclude_groups=asked)
    random = drawn.select("variant_id", "qid", "doc_id", F.lit(0.0).alias("score"),
                          F.col("draw").alias("ord"), F.lit("random").alias("role"))
    return C.mix_contexts(relevant, random)


@register("random_negatives")
def q_random_negatives(spark, sf_dir):
    mixed = random_negative_contexts(spark, sf_dir)
    return mixed.select("variant_id", "qid", "doc_id", "role", "ord",
                        F.round("score", 6).alias("score"))


@register("random_from_run")
def q_random_from_run(spark, sf_dir):
    """X3 selection: from a stored top-100 run, the first ``n_keep`` contexts plus
    ``n_noise`` rows sampled from ranks 51-100 of every *other* question (duplicates
    of a passage across questions are separate pool rows)."""
    variants = C.ratio_variants((0.0, 0.5, 1.0), 5)
    run = materialize(ranked_run(spark, sf_dir, 100))
    relevant = C.top_k_slice(C.with_variants(C.top_k_slice(run, 5), variants), "n_keep").select(
        "variant_id", "qid", "doc_id", "score", F.col("rank").alias("ord"),
        F.lit("relevant").alias("role"))
    band = C.rank_band(run, 50, 100).select(F.col("qid").alias("owner"),
                                            F.col("rank").alias("owner_rank"), "doc_id")
    pool = SM.lay_out(band, ["owner", "owner_rank"], "owner")
    requests = C.with_variants(C.keep_all_questions(
        tables.retrieval_questions(spark, sf_dir).select("qid"), run), variants
    ).withColumnRenamed("n_noise", "need")
    drawn = SM.sample_without_replacement(
        requests, pool, keys=["variant_id", "qid"], seed=SEED,
        exclude_groups=requests.select("qid", F.col("qid").alias("owner")))
    random = drawn.select("variant_id", "qid", "doc_id", F.lit(0.0).alias("score"),
                          F.col("draw").alias("ord"), F.lit("random").alias("role"))
    mixed = C.mix_contexts(relevant, random)
    return mixed.select("variant_id", "qid", "doc_id", "role", "ord",
                        F.round("score", 6).alias("score"))


@register("shuffle_contexts")
def q_shuffle_contexts(spark, sf_dir):
    """R3 on the hard-negative sweep: reproducible random prompt order per (variant, question)."""
    sel = hard_negative_selection(spark, sf_dir)
    shuffled = SM.shuffle_contexts(sel, ["variant_id", "qid"], ["role", "ord"], seed=SEED)
    return shuffled.select("variant_id", "qid", "position", "doc_id", "role")


# --------------------------------------------------------------------------- composed selections

@register("first_n_questions")
def q_first_n_questions(spark, sf_dir):
    """The first 200 questions in order (the reference job's question budget)."""
    q = tables.retrieval_questions(spark, sf_dir).withColumn("seq", F.col("qid"))
    return C.first_n_questions(q, 200, "seq").select("qid")


@register("baseline_sweep")
def q_baseline_sweep(spark, sf_dir):
    """One retrieval at the largest k; each k in {1, 3, 5} is a variant row."""
    ks = [{"k": 1}, {"k": 3}, {"k": 5}]
    run = ranked_run(spark, sf_dir, 5)
    picked = C.top_k_slice(C.with_variants(run, ks), "k")
    out = C.attach_passages(picked, tables.doc_passages(spark, sf_dir).select("doc_id", "title"))
    return out.select("k", "qid", "rank", "doc_id", F.round("score", 6).alias("score"), "title")


CONFIGS = [(5, 0, 0), (4, 1, 0), (3, 2, 0), (0, 5, 0), (3, 2, 5)]


def stored_run_with_titles(spark, sf_dir, k: int = 100):
    """A stored run: top-k rows with passages from ``part`` attached (unknown ids dropped),
    ``pos`` = 1-based position in the stored list."""
    run = C.attach_passages(ranked_run(spark, sf_dir, k), tables.part_passages(spark, sf_dir))
    w = Window.partitionBy("qid").orderBy("rank")
    return run.withColumn("pos", F.row_number().over(w))


@register("hard_negative_configs")
def q_hard_negative_configs(spark, sf_dir):
    """X5 selection: exact-title gold (the question's own part name) from a stored run,
    gold[:k_gold] + non-gold[:k_hard] + run[:mix_topk], duplicates kept."""
    configs = [{"config_id": g * 100 + h * 10 + m, "k_gold": g, "k_hard": h, "mix_topk": m}
               for g, h, m in CONFIGS]
    run = stored_run_with_titles(spark, sf_dir)
    titles = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("qid"), F.array(F.lower("p_name")).alias("gold_titles"))
    labelled = G.split_gold_by_title(run, titles, how="exact")
    picked = C.select_config_mix(labelled, configs, rank="pos")
    return picked.select("config_id", "k_gold", "k_hard", "mix_topk", "qid", "doc_id", "role",
                         "ord", "title")


def turn_questions(spark, sf_dir):
    """Every conversation turn asks a question (``qid`` = conv_id-turn): its own text. Paragraphs and facts are
    the last four turns up to it, so a question's evidence is bounded however long the conversation is."""
    c = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ask = c.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("question"),
                   F.concat_ws("-", "conv_id", "turn").alias("qid"))
    near = ask.select("qid", "t", "conv_id", F.explode(F.sequence(F.col("t") - 3, F.col("t"))).alias("turn"))
    rows = near.join(c, ["conv_id", "turn"])
    ctx = rows.select("qid", F.col("turn").alias("ctx_pos"), F.col("role").alias("title"), F.split("text", "\n").alias("sentences"))
    facts = rows.select("qid", F.col("turn").alias("fact_pos"),
                        F.when(F.col("role") == "system", F.upper("role")).otherwise(F.col("role")).alias("title"),
                        (F.col("turn") - 2).cast("int").alias("sent_idx"))
    gold = ask.where(F.col("t") % 2 == 0).select("qid", F.split("question", "\n")[0].alias("gold_answer"))
    return ask.select("qid", "question"), ctx, facts, gold


@register("build_prompt")
def q_build_prompt(spark, sf_dir):
    """A4 + P8: every turn's text as question, its oracle sentences in fact order as
    contexts, rendered with the fixed prompt template."""
    questions, ctx, facts, _ = turn_questions(spark, sf_dir)
    collected = C.collect_contexts(G.oracle_contexts_long(ctx, facts), ["qid"], ["title", "text"])
    rec = C.attach_contexts(questions, collected, ["qid"])
    return rec.select("qid", TX.build_prompt("question", "contexts").alias("prompt"))


# --------------------------------------------------------------------------- inference and IO


def oracle_generation(spark, sf_dir):
    """X6 on conversations, through the nested form: oracle sentences -> prompt -> stand-in generator
    (first line of every context) -> gold = the first line of an even turn (else missing) -> scores."""
    questions, ctx, facts, gold = turn_questions(spark, sf_dir)
    order = lambda c: F.array_sort(F.collect_list(c))  # noqa: E731 - four turns at most
    nested = (questions.join(ctx.groupBy("qid").agg(order(F.struct("ctx_pos", "title", "sentences")).alias("context")), "qid", "left")
              .join(facts.groupBy("qid").agg(order(F.struct("fact_pos", "title", "sent_idx")).alias("supporting_facts")), "qid", "left")
              .join(gold, "qid", "left").withColumn("seq", F.col("qid")))
    return J.oracle(nested, I.context_lines_factory())


@register("generate_score")
def q_generate_score(spark, sf_dir):
    scored, _ = oracle_generation(spark, sf_dir)
    return scored.select("variant", "qid", "prediction", "prompt_hash", "gold_answer", "has_gold", "num_oracle",
                         "exact_match", "cover_exact_match", "error")


@register("summary")
def q_summary(spark, sf_dir):
    """Metrics of the oracle generation run and of the per-role conversation scoring,
    EM/CEM in percent, fixed experiment order."""
    _, m1 = oracle_generation(spark, sf_dir)
    scored = S.score_answers(conversation_predictions(spark, sf_dir)).withColumn(
        "experiment", F.lit("conversations")).withColumnRenamed("role", "variant")
    m2 = S.evaluate(scored)
    out = J.summarize(m1.select("experiment", "variant", "num_samples", "exact_match",
                                "cover_exact_match"),
                      m2.select("experiment", "variant", "num_samples", "exact_match",
                                "cover_exact_match"))
    return out.select("experiment_order", "experiment", "variant", "num_samples", "em_pct",
                      "cem_pct")


@register("encode_topk")
def q_encode_topk(spark, sf_dir):
    """F6 + S7 + K1 with the stand-in hashing encoder: every turn retrieves documents
    (encoder input = source[SEP]text). Vectors are stored without the text."""
    enc = I.hashing_encoder_factory(64)
    docs = tables.doc_passages(spark, sf_dir).select("doc_id", TX.passage_text("title", "text").alias("input"))
    turns = tables.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("input"))
    stored = []
    for rows, key in ((docs, "doc_id"), (turns, "qid")):
        path = scratch_path(spark, "vectors")
        IO.materialize_embeddings(I.encode(rows, enc, text="input").drop("input"), path, key)
        stored.append(IO.load_embeddings(spark, path))
    r = R.topk_cosine(stored[1], stored[0], 5, exclude_self=False)
    return r.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("encode_documents")
def q_encode_documents(spark, sf_dir):
    """F6 by content with the stand-in encoder: every document's vector, equal texts encoded once; squared norm and a
    weighted sum of each."""
    docs = tables.doc_passages(spark, sf_dir).select("doc_id", TX.passage_text("title", "text").alias("input"))
    v = I.encode_distinct(docs, Stored(I.hashing_encoder_factory(64), scratch_path(spark, "vectors")), text="input")
    total = lambda f: F.aggregate(F.transform("embedding", f), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return v.select("doc_id", total(lambda x: x.cast("double") * x).alias("norm2"), total(lambda x, i: x.cast("double") * (i + 1)).alias("weighted"))


@register("read_write_roundtrip")
def q_read_write_roundtrip(spark, sf_dir):
    """S3 round trip: store the top-10 run as Parquet in the shared folder, read back the
    top 5 (rank filter pushed into the scan)."""
    path = scratch_path(spark, "ranked")
    IO.write_ranked(ranked_run(spark, sf_dir, 10), path)
    r = IO.read_ranked(spark, path, 5)
    return r.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def first_line(c):
    return F.split(c, "\n")[0]


def _vectors(spark, sf_dir):
    return (tables.retrieval_questions(spark, sf_dir).select("qid", "embedding"),
            tables.retrieval_corpus(spark, sf_dir).select("doc_id", "embedding"))


def _part_questions(spark, sf_dir):
    """Every vector asks; its question is the name of the part with the same key, if there is one. Names compress well, so the
    size of their files says little of the rows: they are not broadcast."""
    qv = tables.retrieval_questions(spark, sf_dir).select("qid")
    part = tables.table(spark, sf_dir, "part")
    return qv.join(part.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("question")).hint("merge"),
                   "qid", "left")


def first_known_line(run, passages):
    """Gold answers for even questions: the first line of the best ranked known passage."""
    known = C.attach_passages(run, passages.select("doc_id", first_line("text").alias("line")))
    return known.where(F.col("qid") % 2 == 0).groupBy("qid").agg(F.min_by("line", "rank").alias("gold_answer"))


E2E = ["variant", "qid", "prediction", "prompt_hash", "has_gold", "exact_match", "cover_exact_match"]


@register("baseline_generate")
def q_baseline_generate(spark, sf_dir):
    """X1 end to end: top-k for k in {1, 3, 5} -> documents as passages, half of the ids unknown ->
    prompt -> stand-in generator (first line of every context) -> EM / CEM per prediction."""
    qv, pv = _vectors(spark, sf_dir)
    docs = tables.sparse_passages(spark, sf_dir)
    gold = first_known_line(ranked_run(spark, sf_dir, 5), docs)
    scored, _ = J.baseline_topk(_part_questions(spark, sf_dir), qv, pv, docs, I.context_lines_factory(), gold=gold)
    return scored.select(*E2E, "num_topk")


@register("hard_negative_generate")
def q_hard_negative_generate(spark, sf_dir):
    """X4 end to end: top-100 over embeddings -> passages from ``part`` -> substring gold
    (the last word of the question's own part name) -> ratio-path picks (min_quota=1) ->
    shuffled prompt -> stand-in generator -> gold answer = the text of the passage ranked fourth."""
    qv, pv = _vectors(spark, sf_dir)
    passages = tables.part_passages(spark, sf_dir)
    gold_titles = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("qid"), F.array(F.lower(F.substring_index("p_name", " ", -1))).alias("gold_titles"))
    gold = first_known_line(ranked_run(spark, sf_dir, 100).where("rank >= 4"), passages)
    scored, _ = J.hard_negatives(_part_questions(spark, sf_dir), qv, pv, passages, I.context_lines_factory(),
                                 gold_titles=gold_titles, gold=gold, seed=SEED)
    return scored.select(*E2E, "num_gold", "num_hard_negative")


@register("random_negative_generate")
def q_random_negative_generate(spark, sf_dir):
    """X2 end to end: top ``n_keep`` retrieved documents (half of the ids unknown) + ``n_noise`` random
    documents that are neither used nor gold (substring rule on titles; a question's gold title is
    the source of its own document) -> shuffled prompt -> stand-in generator -> EM / CEM."""
    qv, pv = _vectors(spark, sf_dir)
    docs = tables.sparse_passages(spark, sf_dir)
    gold_titles = docs.select(F.col("doc_id").alias("qid"), F.array(F.lower("title")).alias("gold_titles"))
    gold = first_known_line(ranked_run(spark, sf_dir, 100), docs)
    scored, _ = J.random_negatives(_part_questions(spark, sf_dir), qv, pv, docs, I.context_lines_factory(),
                                   gold_titles=gold_titles, gold=gold, seed=SEED)
    return scored.select(*E2E, "num_relevant", "num_random")


def _stored_run(spark, sf_dir, k, passages):
    """A run written with its question list (S3), read back, with passages; unknown ids have dropped out."""
    path = scratch_path(spark, "stored_run")
    IO.write_ranked(ranked_run(spark, sf_dir, k), path, asked=tables.retrieval_questions(spark, sf_dir))
    return C.attach_passages(IO.read_ranked(spark, path), passages), IO.read_asked(spark, path)


@register("rescore_generate")
def q_rescore_generate(spark, sf_dir):
    """X7 end to end on a stored top-6 run of which half of the ids are unknown: questions without any known passage
    are asked with an empty prompt; k counts known passages only."""
    docs = tables.sparse_passages(spark, sf_dir)
    run, asked = _stored_run(spark, sf_dir, 6, docs)
    gold = first_known_line(ranked_run(spark, sf_dir, 6), docs)
    scored, _ = J.rescore_run(run, _part_questions(spark, sf_dir), I.context_lines_factory(), gold=gold, asked=asked)
    return scored.select(*E2E, "num_topk")


@register("generate_resumed")
def q_generate_resumed(spark, sf_dir):
    """F7 from a half-filled answer store: X7 for k = 1 fills it, then X7 for all k asks only for prompts it lacks."""
    docs = tables.sparse_passages(spark, sf_dir)
    run, asked = _stored_run(spark, sf_dir, 6, docs)
    gold = first_known_line(ranked_run(spark, sf_dir, 6), docs)
    generator = Stored(I.context_lines_factory(), scratch_path(spark, "answers"))
    for ks in ((1,), (1, 3, 5)):
        scored, _ = J.rescore_run(run, _part_questions(spark, sf_dir), generator, ks=ks, gold=gold, asked=asked)
    return scored.select(*E2E, "num_topk")


@register("config_mix_generate")
def q_config_mix_generate(spark, sf_dir):
    """X5 end to end: stored top-100 run with ``part`` passages, exact-title gold (the
    question's own part name), configs (k_gold, k_hard, mix_topk) with duplicates kept,
    shuffled prompt, stand-in generator, gold answer = the text of the best ranked gold passage."""
    passages = tables.part_passages(spark, sf_dir)
    run, asked = _stored_run(spark, sf_dir, 100, passages)
    own = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.lower("p_name").alias("own"))
    gold_titles = own.select("qid", F.array("own").alias("gold_titles"))
    gold = run.join(own, "qid").where(F.lower("title") == F.col("own")).groupBy("qid").agg(
        F.min_by("text", "rank").alias("gold_answer"))
    scored, _ = J.hard_negatives_from_run(run, _part_questions(spark, sf_dir), I.context_lines_factory(),
                                          gold_titles=gold_titles, gold=gold, asked=asked, seed=SEED)
    return scored.select(*E2E, "num_gold", "num_hard_negative", "num_topk")


@register("random_run_generate")
def q_random_run_generate(spark, sf_dir):
    """X3 end to end: stored top-100 run of which half of the ids are unknown; every question asks;
    random contexts come from positions 31-60 of every other question; shuffled prompt; stand-in generator."""
    docs = tables.sparse_passages(spark, sf_dir)
    run, asked = _stored_run(spark, sf_dir, 100, docs)
    questions = _part_questions(spark, sf_dir).withColumn("seq", F.col("qid"))
    gold = first_known_line(ranked_run(spark, sf_dir, 100), docs)
    scored, _ = J.random_from_run(run, questions, I.context_lines_factory(), passages=docs, band=(30, 60),
                                  gold=gold, asked=asked, seed=SEED)
    return scored.select(*E2E, "num_relevant", "num_random")


# --------------------------------------------------------------------------- single operators


@register("gold_titles")
def q_gold_titles(spark, sf_dir):
    """P3 on the turns' facts: the distinct lower-cased titles of a question."""
    _, _, facts, _ = turn_questions(spark, sf_dir)
    nested = facts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("fact_pos", "title", "sent_idx"))).alias("supporting_facts"))
    return G.gold_titles_long(nested)


@register("variant_quotas")
def q_variant_quotas(spark, sf_dir):
    """P7 in its frame form: every label of the vectors is a variant with its own ratio."""
    e = tables.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"))
    return C.variant_quotas(e.withColumn("ratio", F.col("label") / 10.0), 7).select("label", "vectors", "n_noise", "n_keep")


@register("exclude_used")
def q_exclude_used(spark, sf_dir):
    """U2 + J7: the top-10 run without what is gold (same label) or ranked first."""
    run = labelled_run(spark, sf_dir, 10)
    used = SM.exclusion_set(run.where("is_gold").select("qid", "doc_id"), run.where("rank = 1").select("qid", "doc_id"))
    return SM.exclude_docs(run, used, ["qid"]).select("qid", "doc_id", "rank")


@register("masked_centroids")
def q_masked_centroids(spark, sf_dir):
    """A1 with a mask: mean vector by label over vectors with an odd id; a label without any gets null."""
    e = tables.table(spark, sf_dir, "embeddings").withColumn("mask", F.when(F.col("label") == 3, 0).otherwise(F.col("vec_id") % 2))
    m = R.mean_pool(e, "label", "embedding", "mask")
    return m.select("label", F.posexplode_outer(F.transform("embedding", lambda x: F.round(x, 6))).alias("dim", "value"))


@register("row_similarity")
def q_row_similarity(spark, sf_dir):
    """F4 + F5 by row: cosine and dot product of each vector with the one 7 ids on; every ninth is set to zero."""
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(x.cast("double"))).alias("v"))
    other = e.select((F.col("vec_id") - 7).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", F.round(V.cosine("v", "w"), 6).alias("cosine"), F.round(V.dot("v", "w"), 6).alias("dot"))


@register("topk_pruned")
def q_topk_pruned(spark, sf_dir):
    """K1 with pruned groups: the rows of ``topk_cosine``."""
    found = topk_pruned(tables.retrieval_questions(spark, sf_dir), tables.retrieval_corpus(spark, sf_dir), 10)
    return found.ranked.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("topk_ties")
def q_topk_ties(spark, sf_dir):
    """K1 + F5 on string ids, every vector three times (exact ties go to the larger id) and some set to zero."""
    e = tables.table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(F.signum(x)))
    e = e.select("vec_id", v.alias("embedding"))
    copies = e.select(F.explode(F.array(*[F.format_string(f"d%06d-{i}", "vec_id") for i in range(3)])).alias("doc_id"), "embedding")
    asks = e.select(F.format_string("d%06d-1", "vec_id").alias("qid"), "embedding")
    return R.topk_cosine(asks, copies, 5).select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


@register("random_negatives_scarce")
def q_random_negatives_scarce(spark, sf_dir):
    """R1 where requests cannot be filled: every label asks for as many random vectors as exist; vectors
    of labels not above its own are excluded, so the last label gets none and others all that is left."""
    e = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    pool = SM.lay_out(e.select("doc_id", F.col("label").alias("d_label")), ["doc_id"], "d_label")
    labels = e.groupBy(F.col("label").alias("qid")).agg(F.count(F.lit(1)).alias("n"))
    banned = labels.select("qid", F.explode(F.sequence(F.lit(0), F.col("qid"))).alias("d_label"))
    drawn = SM.sample_without_replacement(labels.select("qid", F.lit(pool.size).alias("need")), pool, keys=["qid"], seed=SEED,
                                          exclude_groups=banned)
    return drawn.select("qid", "doc_id")


# --------------------------------------------------------------------------- files


#: Bytes of an array that a task reads here, so that the fixtures' files are split; the readers' default is 64 MB.
SPLIT = 1 << 18


def write_arrays(rows: DataFrame, part: str, order: list[str], path: str) -> None:
    """Rows as files of one top-level array each, one for each value of ``part``, in the order of ``order`` (not written)."""
    fields = [c for c in rows.columns if c not in (part, *order)]
    listed = rows.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("r")))).alias("rs"))
    listed.select(part, F.to_json(F.transform("rs", lambda x: x["r"])).alias("value")).repartition(part).write.partitionBy(part).text(path)


@register("questions_roundtrip")
def q_questions_roundtrip(spark, sf_dir):
    """Turns in the raw question shape (facts with and without index), those of assistants as top-level arrays (500
    conversations a file), others as JSON lines, read back."""
    c = tables.table(spark, sf_dir, "conversations")
    raw = c.select(F.col("role"), "conv_id", "turn",
                   F.concat_ws("-", "conv_id", "turn").alias("_id"), F.col("text").alias("question"), F.col("role").alias("answer"),
                   F.array(F.array(F.col("role")), F.array(F.lit("T2"), F.col("turn").cast("string")), F.array(F.lit("T3"), F.lit("x"))).alias("supporting_facts"),
                   F.array(F.array(F.col("role"), F.to_json(F.split("text", "\n"))), F.array(F.lit("lonely"))).alias("context"))
    lines, arrays = scratch_path(spark, "questions"), scratch_path(spark, "question-arrays")
    raw.where("role <> 'assistant'").drop("role", "conv_id", "turn").write.json(lines)
    write_arrays(raw.where("role = 'assistant'").drop("role").withColumn("part", F.floor(F.col("conv_id") / 500)), "part", ["conv_id", "turn"], arrays)
    q = IO.read_questions(spark, lines, "json_lines").drop("seq").unionByName(IO.read_questions(spark, f"{arrays}/*", split=SPLIT).drop("seq"))
    return q.select("qid", "question", "gold_answer", F.size("supporting_facts").alias("n_facts"),
                    F.element_at("supporting_facts", 1)["title"].alias("first_title"), F.element_at("supporting_facts", 2)["sent_idx"].alias("second_index"),
                    F.element_at("supporting_facts", 3)["sent_idx"].isNull().alias("third_unknown"),
                    F.size("context").alias("n_paragraphs"), F.array_join(F.element_at("context", 1)["sentences"], "\n").alias("sentences"))


@register("passages_roundtrip")
def q_passages_roundtrip(spark, sf_dir):
    """Documents, each first under an old text; English ones as JSON lines in one sorted file a partition, others as
    top-level arrays (1,000 ids a file), read back; the last counts."""
    d = tables.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("lines"), F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.lit("old").alias("title"), F.lit("old").alias("text")),
        F.struct(F.lit(1).alias("n"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"), F.col("text").alias("text")))).alias("p"))
    rows = rows.select("lines", "doc_id", "p.*")
    lines, arrays = scratch_path(spark, "passages"), scratch_path(spark, "passage-arrays")
    (rows.where("lines").repartition("doc_id").sortWithinPartitions("doc_id", "n").select("doc_id", "title", "text").write.json(lines))
    write_arrays(rows.where("not lines").drop("lines").withColumns({"part": F.floor(F.col("doc_id") / 1000), "k": F.col("doc_id")}), "part", ["k", "n"], arrays)
    p = IO.read_passages(spark, lines, "json_lines").unionByName(IO.read_passages(spark, f"{arrays}/*", split=SPLIT))
    return p.select("doc_id", "title", F.sha2("text", 256).alias("text_sha256"))


@register("predictions_roundtrip")
def q_predictions_roundtrip(spark, sf_dir):
    """S5 + S4: turns as predictions with variant columns, written as JSON lines by run keys and read back."""
    p = conversation_predictions(spark, sf_dir).select(
        F.lit("conversations").alias("experiment"), F.col("role").alias("variant"), F.concat_ws("-", "conv_id", "turn").alias("qid"),
        F.col("prediction"), F.when(F.col("has_gold"), F.col("gold_answer")).alias("gold_answer"), (F.col("turn") / 4).alias("noise_ratio"),
        F.array(F.struct(F.col("role").alias("doc_id"), (F.col("turn") % 2 == 0).alias("is_random"))).alias("contexts"))
    path = scratch_path(spark, "predictions")
    IO.write_predictions(p, path, fmt="json_lines")
    back = IO.read_predictions(spark, path, "json_lines")
    return back.select("experiment", "variant", "qid", "prediction", "gold_answer", "noise_ratio",
                       F.col("contexts")[0]["doc_id"].alias("context_id"), F.col("contexts")[0]["is_random"].alias("is_random"))


@register("evaluate_folder")
def q_evaluate_folder(spark, sf_dir):
    """S4 -> F8 -> A2 -> X8 on result files of the three shapes and an empty one: user and system turns as bare lists,
    assistant turns as wrapped lists (500 conversations a file), and the first turn of each role as a file of one object."""
    p = conversation_predictions(spark, sf_dir)
    rec = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), "prediction", F.when(F.col("has_gold"), F.col("gold_answer")).alias("gold_answer"))
    files = p.select("role", F.floor(F.col("conv_id") / 500).alias("part"), rec.alias("r")).groupBy("role", "part").agg(F.collect_list("r").alias("rs"))
    root = scratch_path(spark, "results")
    wrapped = F.to_json(F.struct(F.create_map(F.lit("k"), F.lit("1")).alias("config"), F.col("rs").alias("results")))
    lists = files.select("role", "part", F.when(F.col("role") == "assistant", wrapped).otherwise(F.to_json("rs")).alias("value"))
    first = p.groupBy("role").agg(F.to_json(F.min_by(rec, F.struct("conv_id", "turn"))).alias("value"))
    single = first.select(F.lit("single").alias("role"), F.crc32("role").alias("part"), "value")
    empty = files.agg(F.lit("empty").alias("role"), F.lit(0).cast("long").alias("part"), F.lit("[]").alias("value"))
    # one text file for each value: a file is one top-level array or object
    lists.unionByName(single).unionByName(empty).repartition("role", "part").write.partitionBy("role", "part").text(root)
    _, m = J.evaluate_folder(spark, f"{root}/*/*", name=r"role=([^/]+)/part=[^/]+/[^/]*$")
    return m.select("variant", "num_samples", "em_pct", "cem_pct")


@register("report_roundtrip")
def q_report_roundtrip(spark, sf_dir):
    """The conversation scoring as a report of three runs with their configuration. User turns are first reported as a
    draft of empty answers, and that run alone is written again; metrics, configuration and the
    predictions, counted again, are read back."""
    scored = materialize(S.score_answers(conversation_predictions(spark, sf_dir)).withColumn("experiment", F.lit("conversations"))
                         .withColumnRenamed("role", "variant"), "scored")
    draft = S.score_answers(scored.withColumn("prediction", F.when(F.col("variant") == "user", "").otherwise(F.col("prediction"))))
    path = scratch_path(spark, "report")
    for rows, keys in ((draft, ["conv_id", "turn"]), (scored.where("variant = 'user'"), ["conv_id", "turn", "again"])):
        IO.write_report(S.evaluate(rows), rows, path, config={"metric": "em", "keys": keys})
    metrics, predictions, config = IO.read_report(spark, path)
    again = predictions.groupBy("run").agg(F.sum("exact_match").alias("hits"))
    keys = config.where("key = 'keys'").select("run", F.col("value").alias("config_keys"))
    return metrics.join(again, "run").join(keys, "run").select("variant", "num_samples", F.round("exact_match", 6).alias("exact_match"), "hits", "config_keys")
