"""X1-X8 end to end with the labelled stand-in encoder and generator."""

import pytest
from pyspark.sql import functions as F

from ctxmix.operators import inference as I
from ctxmix.plans import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    part = spark.read.parquet(f"{SF}/part.parquet")
    passages = (docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
                .join(part.select(F.col("p_partkey").cast("string").alias("doc_id"),
                                  F.col("p_name").alias("title")), "doc_id", "left")
                .fillna("", ["title"]))
    conv = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'")
    questions = conv.select(F.concat_ws("-", "conv_id", "turn").alias("qid"),
                            F.col("text").alias("question"),
                            (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))
    enc = I.hashing_encoder_factory(32)
    qv = I.encode(questions.select("qid", "question"), enc, text="question")
    pv = I.encode(passages.select("doc_id", "text"), enc, text="text")
    gold_titles = questions.select("qid", F.array(F.lit("small ring"), F.lit("bolt"))
                                   .alias("gold_titles"))
    gold = questions.select("qid", F.element_at(F.split("question", " "), 1).alias("gold_answer"))
    return dict(questions=questions, qv=qv, pv=pv, passages=passages, gold_titles=gold_titles,
                gold=gold, gen=I.context_lines_factory())


def check(preds, metrics, n_questions, n_variants):
    assert preds.count() == n_questions * n_variants
    m = metrics.collect()
    assert len(m) == n_variants
    # means of what the rows say; an exact match is always a cover match
    rows = preds.collect()
    for r in m:
        own = [x for x in rows if x["variant"] == r["variant"]]
        assert len(own) == n_questions == r["num_samples"]
        assert abs(r["exact_match"] - sum(x["exact_match"] for x in own) / len(own)) < 1e-9
        assert abs(r["cover_exact_match"] - sum(x["cover_exact_match"] for x in own) / len(own)) < 1e-9
        assert r["exact_match"] <= r["cover_exact_match"]


def test_baseline(spark, inputs):
    p, m = J.baseline_topk(inputs["questions"], inputs["qv"], inputs["pv"], inputs["passages"],
                           inputs["gen"], gold=inputs["gold"], wide=True)
    n = inputs["questions"].count()
    check(p, m, n, 3)
    answers = {}
    for r in p.collect():
        answers.setdefault(r["qid"], set()).add(r["prediction"])
    assert all(len(a) == 3 for a in answers.values())  # k = 1, 3, 5 give different predictions
    sizes = {r["variant"]: r["n"] for r in
             p.groupBy("variant").agg(F.max(F.size("contexts")).alias("n")).collect()}
    assert sizes == {"top1": 1, "top3": 3, "top5": 5}


def test_random_and_hard(spark, inputs):
    n = inputs["questions"].count()
    p, m = J.random_negatives(inputs["questions"], inputs["qv"], inputs["pv"], inputs["passages"],
                              inputs["gen"], gold_titles=inputs["gold_titles"], gold=inputs["gold"],
                              k_retrieval=20)
    check(p, m, n, 5)
    assert p.where(F.col("num_relevant") + F.col("num_random") > 5).count() == 0
    p, m = J.hard_negatives(inputs["questions"], inputs["qv"], inputs["pv"], inputs["passages"],
                            inputs["gen"], gold_titles=inputs["gold_titles"], gold=inputs["gold"],
                            k_retrieval=20)
    check(p, m, n, 5)
    assert p.where(F.col("num_gold") + F.col("num_hard_negative") > 6).count() == 0


def test_stored_run_jobs_and_summary(spark, inputs):
    from ctxmix.operators import retrieval as R
    run = R.topk_cosine(inputs["qv"], inputs["pv"], 60).join(inputs["passages"], "doc_id")
    n = inputs["questions"].count()
    p3, m3 = J.random_from_run(run, inputs["questions"], inputs["gen"], num_questions=50,
                               gold=inputs["gold"])
    check(p3, m3, min(50, n), 3)
    p5, m5 = J.hard_negatives_from_run(run, inputs["questions"], inputs["gen"],
                                       gold_titles=inputs["gold_titles"], gold=inputs["gold"])
    check(p5, m5, n, 5)
    p7, m7 = J.rescore_run(run, inputs["questions"], inputs["gen"], gold=inputs["gold"])
    check(p7, m7, n, 3)
    s = J.summarize(m3, m5, m7).collect()
    assert len(s) == 11 and s[0]["experiment"] == "baseline"


def test_generate_failures_and_dedupe(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def gen(prompts):
            calls.add(len(prompts))
            out = []
            for p in prompts:
                if p == "boom":
                    raise RuntimeError("bad prompt")
                out.append(f" {p.upper()} ")
            return out
        return gen

    df = spark.createDataFrame([("a",), ("a",), ("boom",), ("b",)], "prompt string")
    got = {(r["prompt"], r["prediction"], r["error"] is not None)
           for r in I.generate(df, factory).collect()}
    assert got == {("a", "A", False), ("boom", "", True), ("b", "B", False)}


def test_oracle_job(spark):
    q = spark.createDataFrame(
        [("q1", "Who?", "c", [("T1", ["a", "b"]), ("T1", ["c", "d"])], [("T1", 0)], 0),
         ("q2", "What?", None, [], [], 1)],
        "qid string, question string, gold_answer string, "
        "context array<struct<title:string,sentences:array<string>>>, "
        "supporting_facts array<struct<title:string,sent_idx:int>>, seq long")
    p, m = J.oracle(q, I.context_lines_factory())
    got = {r["qid"]: (r["prediction"], r["exact_match"], r["cover_exact_match"]) for r in p.collect()}
    assert got == {"q1": ("c", 1, 1), "q2": ("", 1, 1)}


def test_stored_runs_count_positions_and_keep_empty_questions(spark):
    """Ranks with gaps (unknown ids were dropped) and a question without any known passage."""
    run = spark.createDataFrame([("q1", "a", 0.9, 2, "t", "one"), ("q1", "b", 0.8, 5, "t", "two"), ("q1", "c", 0.7, 9, "u", "three")],
                                "qid string, doc_id string, score double, rank int, title string, text string")
    questions = spark.createDataFrame([("q1", "?", 0), ("q2", "??", 1)], "qid string, question string, seq long")
    asked = questions.select("qid")
    gold = spark.createDataFrame([("q1", "one"), ("q1", "x"), ("q2", "y")], "qid string, gold_answer string")
    p, m = J.rescore_run(run, questions, I.context_lines_factory(), ks=(1, 2), gold=gold, asked=asked)
    assert {(r["variant"], r["qid"]): r["prediction"] for r in p.collect()} == {
        ("baseline_top1", "q1"): "one", ("baseline_top2", "q1"): "one | two", ("baseline_top1", "q2"): "", ("baseline_top2", "q2"): ""}
    assert {r["num_samples"] for r in m.collect()} == {2}
    titles = spark.createDataFrame([("q1", ["u"])], "qid string, gold_titles array<string>")
    p, _ = J.hard_negatives_from_run(run, questions, I.context_lines_factory(), gold_titles=titles, configs=((1, 1, 0), (0, 0, 2)), asked=asked)
    got = {(r["variant"], r["qid"]): set(filter(None, r["prediction"].split(" | "))) for r in p.collect()}
    assert got == {("gold1_hard1", "q1"): {"three", "one"}, ("gold0_hard0_top2", "q1"): {"one", "two"},
                   ("gold1_hard1", "q2"): set(), ("gold0_hard0_top2", "q2"): set()}
    p, _ = J.random_from_run(run, questions, I.context_lines_factory(), total=2, ratios=(0.5,), band=(1, 3), asked=asked)
    got = {r["qid"]: (r["num_relevant"], r["num_random"]) for r in p.collect()}
    assert got == {"q1": (1, 0), "q2": (0, 1)}  # q1 may not draw its own rows


def test_variant_names_don_t_collide(spark):
    assert J.percent("x", 0.29) == "x_29pct" and J.percent("x", 0.291) == "x_29p1pct" and J.percent("x", 1.0) == "x_100pct"
    with pytest.raises(ValueError):
        J._named([{"variant": "a"}, {"variant": "a"}])


def test_answers_join_narrow_rows(spark, inputs):
    p, _ = J.baseline_topk(inputs["questions"], inputs["qv"], inputs["pv"], inputs["passages"], inputs["gen"])
    assert not {"contexts", "prompt", "question"} & set(p.columns)


def test_prompts_are_written_without_their_contexts(spark, monkeypatch):
    """The prompt table holds texts once, unless contexts are asked for."""
    written = {}
    keep = J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, name="stage", *a: written.update({name: df.columns}) or keep(df, name, *a))
    contexts = spark.createDataFrame([("v", 1, "d", "t", "first\nrest", 1.0, "topk", 1)], "variant string, qid long, doc_id string, title string, text string, score double, role string, ord int")
    records = spark.createDataFrame([("v", 1, "q"), ("v", 1, "q"), ("v", 2, "q")], "variant string, qid long, question string")
    for wide in (False, True):
        p, _ = J.finish(contexts, records, "x", I.context_lines_factory(), None, wide=wide)
        assert ("contexts" in written["prompts"]) == wide
        if not wide:  # records that come twice are answered twice
            assert sorted((r["qid"], r["prediction"]) for r in p.collect()) == [(1, "first"), (1, "first"), (2, "")]


def test_prompts_go_to_the_model_from_where_they_lie(spark, tmp_path, monkeypatch):
    """The prompt table is read by its buckets, not shuffled; rows without an id and records that come twice are answered, each distinct prompt once."""
    plans = []
    keep = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, *a))

    def model():
        def run(prompts):
            with open(f"{tmp_path}/calls", "a") as f:
                f.writelines(f"{len(p)}\n" for p in prompts)
            return [str(len(p)) for p in prompts]
        return run

    contexts = spark.createDataFrame([("v", i, "d", "t", "x" * (i % 50), 1.0, "topk", 1) for i in range(500)],
                                     "variant string, qid long, doc_id string, title string, text string, score double, role string, ord int")
    records = spark.createDataFrame([("v", i, "q") for i in [*range(500), 3, 600]] + [("v", None, "q"), ("w", 1, "longer")], "variant string, qid long, question string")
    p, _ = J.finish(contexts, records, "x", model, None)
    got = p.collect()
    assert len(got) == 504 and all(r["prediction"] for r in got)
    calls = open(f"{tmp_path}/calls").read().split()
    assert len(calls) == len(set(r["prompt_hash"] for r in got)) == 52  # 50 texts, no context, another question
    assert any("Bucketed: true" in x for x in plans)
    p, _ = J.finish(contexts, records.limit(0), "x", model, None)
    assert p.collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ctxmix_")]
