"""Answer and vector stores: what is stored is never asked again, whatever became of the job."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxmix.operators import inference as I
from ctxmix.operators.stored import Stored, read_store


def asked(folder):
    return [p for f in glob.glob(f"{folder}/*") for p in open(f).read().split("\n") if p]


def recorder(folder, answer, die_on=None):
    """A generator that writes down every prompt; ``die_on`` ends its worker process."""
    os.makedirs(folder)

    def factory():
        name = f"{folder}/{os.getpid()}-{time.time_ns()}"

        def model(prompts):
            if die_on in prompts:
                time.sleep(8)  # other tasks come to an end meanwhile
                os._exit(1)
            with open(name, "a") as f:
                f.writelines(p + "\n" for p in prompts)
            return [answer(p) for p in prompts]
        return model
    return factory


def prompts(spark, n=400):
    return spark.range(n).select("id", F.concat(F.lit("p"), F.col("id") % (n // 2)).alias("prompt"))


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    store = f"{tmp_path}/answers"
    df = prompts(spark)
    with pytest.raises(Exception):
        I.generate(df, Stored(recorder(f"{tmp_path}/first", str.upper, die_on="p77"), store, per_task=20), "prompt").collect()
    kept = [r["answer"].lower() for r in spark.read.parquet(store).collect()]
    assert 0 < len(set(kept)) == len(kept) < 200
    got = I.generate(df, Stored(recorder(f"{tmp_path}/second", str.upper), store, per_task=20), "prompt").collect()
    assert len(got) == 400 and all(r["prediction"] == r["prompt"].upper() and r["error"] is None for r in got)
    again = asked(f"{tmp_path}/second")
    assert sorted(again) == sorted({f"p{i}" for i in range(200)} - set(kept))  # each missing prompt once, no other
    I.generate(df, Stored(recorder(f"{tmp_path}/third", str.upper), store), "prompt").collect()
    assert asked(f"{tmp_path}/third") == []


def test_failed_prompts_are_asked_again(spark, tmp_path):
    store = f"{tmp_path}/answers"

    def failing(p):
        if p == "p3":
            raise ValueError("no")
        return p

    df = prompts(spark, 20)
    first = {r["prompt"]: r["error"] for r in I.generate(df, Stored(recorder(f"{tmp_path}/a", failing), store), "prompt").collect()}
    assert first["p3"] == "ValueError: no" and [p for p, e in first.items() if e] == ["p3"]
    second = I.generate(df, Stored(recorder(f"{tmp_path}/b", str.upper), store), "prompt").collect()
    assert asked(f"{tmp_path}/b") == ["p3"] and {r["prediction"] for r in second if r["prompt"] == "p3"} == {"P3"}


def test_store_takes_one_of_several_results(spark, tmp_path):
    path = f"{tmp_path}/s"
    schema = spark.createDataFrame([], "prompt_hash string, answer string, error string").schema
    assert read_store(spark, path, schema, "prompt_hash").collect() == []
    spark.createDataFrame([("a", "", "x"), ("a", "1", None), ("b", "2", None), ("b", "2", None)], schema).write.parquet(path)
    assert sorted(tuple(r) for r in read_store(spark, path, schema, "prompt_hash", "error is null").collect()) == [("a", "1", None), ("b", "2", None)]


def test_equal_texts_are_encoded_once(spark, tmp_path):
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)

    def factory():
        name = f"{calls}/{os.getpid()}-{time.time_ns()}"

        def model(texts):
            with open(name, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return np.array([[len(t), 1] for t in texts], np.float32)
        return model

    df = spark.createDataFrame([(i, None if i % 50 == 7 else "x" * (i % 13 + 1)) for i in range(3000)] + [(-1, ""), (-2, "new")], "id long, text string")
    store = Stored(factory, f"{tmp_path}/vectors")
    got = I.encode_distinct(df.where("id <> -2"), store).collect()
    assert len(got) == 3001 and all(list(r["embedding"]) == [len(r["text"] or ""), 1] for r in got)
    assert sorted(asked(calls)) == sorted("x" * n for n in range(1, 14))  # and the empty text, which leaves an empty line
    assert {r["id"]: r["embedding"][0] for r in I.encode_distinct(df, store).collect()}[-2] == 3
    assert sorted(asked(calls)) == sorted(["x" * n for n in range(1, 14)] + ["new"])
    assert I.encode_distinct(df.limit(0), Stored(factory, f"{tmp_path}/none")).collect() == []


@pytest.mark.parametrize("stored", [False, True])
def test_prompts_are_chosen_by_hash_alone(spark, tmp_path, monkeypatch, stored):
    """With row keys nothing but hashes is grouped and kept beside the prompts; each distinct prompt is asked once."""
    written = []
    keep = I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, *a: written.append(df.columns) or keep(df, *a))
    rows = keep(prompts(spark).withColumn("prompt_hash", F.sha2("prompt", 256)))
    model = recorder(f"{tmp_path}/a", str.upper)
    got = I.answer(rows, Stored(model, f"{tmp_path}/answers") if stored else model, keys=["id"]).collect()
    assert sorted(asked(f"{tmp_path}/a")) == sorted({f"p{i}" for i in range(200)})
    assert len(got) == 200 and {r["size"] for r in got} == {2} and len({r["prompt_hash"] for r in got}) == 200
    assert all("prompt" not in columns for columns in written)
