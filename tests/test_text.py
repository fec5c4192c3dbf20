"""F1-F3, P1, P8 against stated values; whole documents are checked against the DuckDB oracle."""

import pytest

from ctxmix.functions import text as TX

NORMALIZED = [
    (None, ""), ("", ""),
    ("Hello, World!", "hello world"),
    ("  foo . ", "foo "),                       # edges are stripped before marks go
    ("\u00a0nbsp\u00a0", "nbsp"),
    ("\u2019curly\u2019", "\u2019curly\u2019"),      # marks beyond ASCII stay
    ("^_`~|{}\\[]", ""),
    ("\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2"),
    ("\x1c edge \x1f", "edge"),
    ("\u3000ideo\u3000", "ideo"),
    ("Ma\u0142gorzata Braunek.", "ma\u0142gorzata braunek"),
    ("tab\tinside\n", "tab\tinside"),
]


@pytest.mark.parametrize("given,wanted", NORMALIZED)
def test_normalize(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "s string").select(TX.normalize("s")).first()[0] == wanted


@pytest.mark.parametrize("pred,gold,em,cem", [
    ("Ma\u0142gorzata Braunek.", "Ma\u0142gorzata Braunek", 1, 1),
    ("It is Paris, France", "Paris", 0, 1),
    ("anything", "", 0, 1),
    ("", "", 1, 1),
    ("", "Paris", 0, 0),
    ("  foo . ", "foo", 0, 1),
    ("x", None, 0, 1),
])
def test_em_cem(spark, pred, gold, em, cem):
    df = spark.createDataFrame([(pred, gold)], "p string, g string")
    r = df.select(TX.exact_match("p", "g").alias("em"), TX.cover_exact_match("p", "g").alias("cem")).first()
    assert (r["em"], r["cem"]) == (em, cem)


def test_passage_text(spark):
    df = spark.createDataFrame([("T", " body "), ("", " body "), (None, "b"), ("  T", "x  ")],
                               "title string, text string")
    got = [r[0] for r in df.select(TX.passage_text("title", "text")).collect()]
    assert got == ["T[SEP] body", "body", "b", "T[SEP]x"]


PROMPT = """You are a QA system. Answer questions based on the provided documents.

Question: Q?

Relevant documents:
[DOC 1] t1
x1

[DOC 2] 
x2

Answer the question as concisely as possible. Provide only the answer, no explanation needed."""


def test_build_prompt(spark):
    df = spark.createDataFrame([("Q?", [("t1", "x1"), (None, "x2")]), ("Q", [])],
                               "q string, c array<struct<title:string,text:string>>")
    full, empty = [r[0] for r in df.select(TX.build_prompt("q", "c")).collect()]
    assert full == PROMPT
    assert "Relevant documents:\n\n\nAnswer" in empty


def test_evaluate_counts_failures_missing_gold_and_empty_runs(spark):
    from ctxmix.operators import scoring as S
    rows = [("e", "v1", "Paris", "Paris", True, None), ("e", "v1", "", "Rome", True, "Timeout"),
            ("e", "v1", "x", "", False, None)]
    df = spark.createDataFrame(rows, "experiment string, variant string, prediction string, "
                                     "gold_answer string, has_gold boolean, error string")
    runs = spark.createDataFrame([("e", "v1"), ("e", "v2")], "experiment string, variant string")
    m = {r["variant"]: r for r in S.evaluate(S.score_answers(df), variants=runs).collect()}
    assert (m["v1"]["num_samples"], m["v1"]["n_failed"], m["v1"]["n_missing_gold"]) == (3, 1, 1)
    assert abs(m["v1"]["exact_match"] - 1 / 3) < 1e-12
    assert abs(m["v1"]["cover_exact_match"] - 2 / 3) < 1e-12
    assert (m["v2"]["num_samples"], m["v2"]["exact_match"], m["v2"]["cover_exact_match"]) == (0, 0.0, 0.0)
