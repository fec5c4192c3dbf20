"""S1-S7 round trips and the streaming evaluator."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from ctxmix.sources import io as IO
from ctxmix.streaming import evaluate as ST


def tmpdir():
    return tempfile.mkdtemp(prefix="ctxmix-io-")


def test_read_questions(spark):
    d = tmpdir()
    data = [{"_id": "a", "question": "Q?", "answer": "X",
             "supporting_facts": [["T1", 0], ["T2", 1], ["bad"]],
             "context": [["T1", ["s0", "s1"]], ["T2", ["u0", "u1"]], ["lonely"]]},
            {"_id": "b", "question": "R?", "answer": "Y", "supporting_facts": [], "context": []}]
    with open(os.path.join(d, "dev.json"), "w") as f:
        json.dump(data, f)
    q = IO.read_questions(spark, d).orderBy("seq").collect()
    assert [r["qid"] for r in q] == ["a", "b"]
    assert [(f["title"], f["sent_idx"]) for f in q[0]["supporting_facts"]] == [("T1", 0), ("T2", 1), ("bad", None)]
    assert [p["sentences"] for p in q[0]["context"]] == [["s0", "s1"], ["u0", "u1"]]


def test_read_predictions_three_shapes(spark):
    d = tmpdir()
    rec = {"id": "q1", "question": "Q", "gold_answer": "Paris", "prediction": "Paris.",
           "contexts": [{"doc_id": "1", "title": "t", "text": "x", "score": 0.5}]}
    with open(os.path.join(d, "bare.json"), "w") as f:
        json.dump([rec, dict(rec, id="q2")], f)
    with open(os.path.join(d, "single.json"), "w") as f:
        json.dump({"id": None, "question": "Q", "gold_answer": "A", "predicted_answer": "A.",
                   "contexts_used": [{"doc_id": 0, "type": "oracle", "text": "t"}]}, f)
    with open(os.path.join(d, "wrapped.json"), "w") as f:
        json.dump({"config": {"k": 1}, "metrics": {"exact_match": 1.0}, "results": [rec]}, f)
    p = IO.read_predictions(spark, [os.path.join(d, n) for n in ("bare.json", "single.json",
                                                                 "wrapped.json")])
    runs = {r["run"]: 0 for r in p.collect()}
    got = sorted((r["run"], r["prediction"]) for r in p.collect())
    assert got == [("bare", "Paris."), ("bare", "Paris."), ("single", "A."), ("wrapped", "Paris.")]
    assert set(runs) == {"bare", "single", "wrapped"}


def test_ranked_and_embeddings_roundtrip(spark):
    d = tmpdir()
    run = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.4, 2)],
                                "qid long, doc_id long, score double, rank int")
    IO.write_ranked(run, f"{d}/ranked")
    assert IO.read_ranked(spark, f"{d}/ranked", 1).count() == 1
    emb = spark.createDataFrame([(1, [3.0, 4.0])], "doc_id long, embedding array<float>")
    IO.materialize_embeddings(emb, f"{d}/emb")
    assert IO.load_embeddings(spark, f"{d}/emb").first()["norm"] == 5.0
    nested = IO.nest_run(run)
    back = IO.unnest_run(nested.withColumnRenamed("qid", "id"))
    assert [r["rank"] for r in back.orderBy("rank").collect()] == [1, 2]


def test_write_report(spark):
    d = tmpdir()
    preds = spark.createDataFrame([("e", "v", "q", 1)], "experiment string, variant string, qid string, exact_match int")
    metrics = spark.createDataFrame([("e", "v", 1.0)], "experiment string, variant string, exact_match double")
    IO.write_report(metrics, preds, f"{d}/report")
    assert spark.read.parquet(f"{d}/report/predictions").count() == 1
    assert spark.read.parquet(f"{d}/report/metrics").count() == 1


def test_streaming_evaluator(spark):
    src, ck = tmpdir(), tmpdir()

    def drop(name, rows):
        with open(os.path.join(src, name), "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")

    drop("a.json", [{"experiment": "e", "variant": "v", "qid": "1", "gold_answer": "Paris",
                     "prediction": "Paris."},
                    {"experiment": "e", "variant": "v", "qid": "2", "gold_answer": None,
                     "prediction": "x"}])
    q = ST.start_incremental_evaluation(spark, src, ck, query_name="m_test")
    try:
        q.processAllAvailable()
        r = spark.sql("SELECT * FROM m_test").first()
        assert (r["num_samples"], r["exact_match"], r["cover_exact_match"]) == (2, 0.5, 1.0)
        drop("b.json", [{"experiment": "e", "variant": "v", "qid": "3", "gold_answer": "a",
                         "prediction": "b"}])
        q.processAllAvailable()
        r = spark.sql("SELECT * FROM m_test").first()
        assert r["num_samples"] == 3 and r["n_missing_gold"] == 1
    finally:
        q.stop()


def test_read_passages_and_json_predictions(spark):
    d = tmpdir()
    with open(os.path.join(d, "corpus.json"), "w") as f:
        json.dump([{"doc_id": 1, "title": None, "text": "a"}, {"doc_id": 1, "title": "T", "text": "b"},
                   {"doc_id": 2, "title": "U", "text": None}], f)
    p = IO.read_passages(spark, os.path.join(d, "corpus.json")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in p] == ["1", "2"] and (p[0]["title"], p[0]["text"]) == ("T", "b")  # the last counts
    assert p[1]["text"] == "" and all(r["title"] is not None for r in p)
    preds = spark.createDataFrame([("e", "v1", "q", "x"), ("e", "v2", "q", "y")],
                                  "experiment string, variant string, qid string, prediction string")
    for fmt in ("json_lines", "parquet"):
        IO.write_predictions(preds, f"{d}/preds-{fmt}", fmt=fmt)
        back = IO.read_predictions(spark, f"{d}/preds-{fmt}", fmt)
        assert sorted((r["experiment"], r["variant"], r["qid"], r["prediction"]) for r in back.collect()) == [("e", "v1", "q", "x"), ("e", "v2", "q", "y")]


def test_streaming_evaluator_restarts_without_double_counting(spark):
    src, ck = tmpdir(), tmpdir()

    def drop(name, n):
        with open(os.path.join(src, name), "w") as f:
            for i in range(n):
                f.write(json.dumps({"experiment": "e", "variant": "v", "qid": f"{name}{i}",
                                    "gold_answer": "a", "prediction": "a"}) + "\n")

    drop("a.json", 3)
    q = ST.start_incremental_evaluation(spark, src, ck, query_name="m_restart")
    q.processAllAvailable()
    q.stop()
    drop("b.json", 2)
    q = ST.start_incremental_evaluation(spark, src, ck, query_name="m_restart")
    try:
        q.processAllAvailable()
        r = spark.sql("SELECT * FROM m_restart").first()
        assert r["num_samples"] == 5 and r["exact_match"] == 1.0
    finally:
        q.stop()


def test_materialized_tables_live_under_the_configured_checkpoint_dir(spark):
    from ctxmix.session import checkpoint_root, materialize, scratch_path
    root = spark.sparkContext.getCheckpointDir()
    assert root and checkpoint_root(spark) == root
    assert scratch_path(spark, "x").startswith(root.rstrip("/") + "/tables/")
    df = materialize(spark.range(5), "probe")
    files = df.inputFiles()
    assert files and all(root.rstrip("/").split(":", 1)[-1] in f for f in files)
    assert df.count() == 5


def test_json_lines_keep_every_record_in_file_order(spark):
    import pytest
    d = tmpdir()
    for name, ids in (("b.json", range(3, 6)), ("a.json", range(3))):
        with open(os.path.join(d, name), "w") as f:
            f.writelines(json.dumps({"_id": str(i), "question": f"q{i}", "supporting_facts": [["T1"], ["T2", 0]]}) + "\n" for i in ids)
    q = IO.read_questions(spark, d, "json_lines")
    assert [r["qid"] for r in q.orderBy("seq").collect()] == list("012345")
    from ctxmix.operators.gold import gold_titles
    assert gold_titles(q).first()["gold_titles"] == ["t1", "t2"]
    with open(os.path.join(d, "corpus.jsonl"), "w") as f:
        f.writelines(json.dumps({"doc_id": i % 4, "title": f"t{i}", "text": "x"}) + "\n" for i in range(5))
    p = IO.read_passages(spark, os.path.join(d, "corpus.jsonl"), "json_lines")
    assert sorted((r["doc_id"], r["title"]) for r in p.collect()) == [("0", "t4"), ("1", "t1"), ("2", "t2"), ("3", "t3")]
    with pytest.raises(ValueError):
        IO.read_passages(spark, d, "json")


def test_evaluate_folder_has_empty_runs_and_variant_columns(spark):
    from ctxmix.plans import jobs as J
    d = tmpdir()
    rec = {"id": "q", "gold_answer": "Paris", "prediction": "Paris.", "noise_ratio": 0.25, "k_gold": 3,
           "contexts": [{"doc_id": "1", "is_random": True}]}
    for name, data in (("bare.json", [rec, dict(rec, prediction="in Paris")]), ("empty.json", []), ("single.json", rec),
                       ("wrapped.json", {"config": {"k": 1}, "metrics": {}, "results": [dict(rec, gold_answer=None)]})):
        with open(os.path.join(d, name), "w") as f:
            json.dump(data, f)
    scored, summary = J.evaluate_folder(spark, d)
    got = {r["variant"]: (r["num_samples"], r["em_pct"], r["cem_pct"]) for r in summary.collect()}
    assert got == {"bare": (2, 50.0, 100.0), "empty": (0, 0.0, 0.0), "single": (1, 100.0, 100.0), "wrapped": (1, 0.0, 100.0)}
    assert {(r["noise_ratio"], r["k_gold"], r["contexts"][0]["is_random"]) for r in scored.collect()} == {(0.25, 3, True)}


def test_report_keeps_the_configuration(spark):
    d = tmpdir()
    preds = spark.createDataFrame([("e", "v", "q", 1)], "experiment string, variant string, qid string, exact_match int")
    IO.write_report(preds.select("experiment", "variant"), preds, f"{d}/report", config={"ks": [1, 3], "seed": 42})
    _, _, config = IO.read_report(spark, f"{d}/report")
    assert {r["key"]: json.loads(r["value"]) for r in config.collect()} == {"ks": [1, 3], "seed": 42}


def test_a_run_written_again_replaces_its_own_rows_only(spark):
    path = f"{tmpdir()}/report"
    schema = "experiment string, variant string, qid string, exact_match int"

    def put(rows, runs, **config):
        IO.write_report(spark.createDataFrame(runs, "experiment string, variant string, num_samples long"), spark.createDataFrame(rows, schema), path, config=config)

    put([("e", "01", "a", 1), ("e", "01", "b", 0), ("e", "x/y=z", "a", 1), ("e", None, "n", 1)], [("e", "01", 2), ("e", "x/y=z", 1), ("e", None, 1)], k=1)
    put([("e", "01", "c", 1)], [("e", "01", 1)], k=2)
    put([], [("e", "x/y=z", 0)])  # a run that has no predictions any more
    metrics, predictions, config = IO.read_report(spark, path)
    assert sorted(((r["variant"] or "", r["num_samples"]) for r in metrics.collect())) == [("", 1), ("01", 1), ("x/y=z", 0)]
    assert sorted((r["variant"] or "", r["qid"]) for r in predictions.collect()) == [("", "n"), ("01", "c")]
    assert sorted((r["variant"] or "", r["key"], r["value"]) for r in config.collect()) == [("", "k", "1"), ("01", "k", "2")]


def test_no_local_folder_off_a_local_master():
    import pytest
    from ctxmix.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session)


def test_drop_tables(spark):
    import os as _os
    from ctxmix.session import checkpoint_root, drop_tables, materialize, spread
    df = materialize(spark.range(5), "probe")
    assert spread(df.groupBy("id").count()).rdd is not None  # a plan with shuffles stays as it is
    root = checkpoint_root(spark).split(":", 1)[-1]
    assert _os.path.isdir(f"{root}/tables") and drop_tables(spark) and not _os.path.isdir(f"{root}/tables")
