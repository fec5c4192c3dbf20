"""J5/J6/P3/P6 hand cases; blocked substring join equals the nested-loop definition."""

from pyspark.sql import functions as F

from ctxmix.operators import gold as G
from ctxmix.operators import matching as M


def test_substring_and_exact_rules(spark):
    titles = ["War", "Polish War (Film)", "", "Peace", "WAR (film)", None]
    df = spark.createDataFrame([(t, ["war (film)"]) for t in titles],
                               "title string, g array<string>")
    got = df.select(G.is_gold_substring("title", "g").alias("s"),
                    G.is_gold_exact("title", "g").alias("e")).collect()
    assert [r["s"] for r in got] == [True, True, True, False, True, True]
    assert [r["e"] for r in got] == [False, False, False, False, True, False]


def test_contained_pairs_equal_nested_loop(spark):
    import random
    rnd = random.Random(7)
    alpha = "abcab "
    hs = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 9))) for _ in range(120)]
    ns = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 5))) for _ in range(60)]
    want = {(n, h) for n in set(ns) for h in set(hs) if n in h}
    got = M.contained_pairs(spark.createDataFrame([(n,) for n in ns], "needle string"),
                            spark.createDataFrame([(h,) for h in hs], "haystack string"))
    assert {(r["needle"], r["haystack"]) for r in got.collect()} == want


def test_gold_docs_by_substring(spark):
    gold = spark.createDataFrame([("q1", "war (film)"), ("q2", "peace")], "qid string, gold_title string")
    pas = spark.createDataFrame([("d1", "War"), ("d2", "Polish War (Film)"), ("d3", ""),
                                 ("d4", "Peace"), ("d5", "Other")], "doc_id string, title string")
    got = {(r["qid"], r["doc_id"]) for r in G.gold_docs_by_substring(gold, pas).collect()}
    assert got == {("q1", "d1"), ("q1", "d2"), ("q1", "d3"), ("q2", "d3"), ("q2", "d4")}


def test_gold_titles(spark):
    q = spark.createDataFrame([("q", [("A", 0), ("a", 1), ("B", 0)])],
                              "qid string, supporting_facts array<struct<title:string,sent_idx:int>>")
    assert sorted(G.gold_titles(q).first()["gold_titles"]) == ["a", "b"]
    assert sorted(r["gold_title"] for r in G.gold_titles_long(q).collect()) == ["a", "b"]


def test_oracle_extraction_hand_case(spark):
    q = spark.createDataFrame(
        [("q", [("T1", ["a", "b"]), ("T2", ["x"]), ("T1", ["c", "d"])],
          [("T1", 0), ("T1", 5), ("t2", 0), ("T2", -1), ("T2", 0), ("T9", 0)])],
        "qid string, context array<struct<title:string,sentences:array<string>>>, "
        "supporting_facts array<struct<title:string,sent_idx:int>>")
    got = sorted((r["position"], r["doc_id"], r["text"], r["score"])
                 for r in G.oracle_contexts(q).collect())
    assert got == [(0, "oracle_T1_0", "c", 1.0), (3, "oracle_T2_-1", "x", 1.0)]


def test_cover_join_equals_nested_loop(spark):
    import random
    rnd = random.Random(3)
    words = ["ab", "abc", "b", "", "cab", "a\nb", "é"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) for _ in range(80)] + ["", None]
    needles = ["", "a", "é", "bc", "abc", "ab ab", "b cab abc", "  ", None]
    for t in rnd.sample([t for t in texts if t], 40):  # parts of texts, cut inside words too
        i = rnd.randint(0, len(t))
        needles.append(t[i:i + rnd.randint(0, 25)])
    got = M.cover_join(spark.createDataFrame(list(enumerate(texts)), "tid int, t string"),
                       spark.createDataFrame(list(enumerate(needles)), "nid int, n string"), "t", "n", "tid", "nid")
    assert got.columns == ["tid", "t", "nid", "n"]
    want = sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t is not None and n is not None and n in t)
    assert sorted((r["tid"], r["nid"]) for r in got.collect()) == want


def test_nested_and_long_oracle_agree_on_random_rows(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for q in range(60):
        ctx = [(rnd.choice(["A", "B", "a", None]), rnd.choice([None, [], ["x"], ["x", "y", "x"]])) for _ in range(rnd.randint(0, 4))]
        rows.append((q, ctx, [(rnd.choice(["A", "B", "a", "Z", None]), rnd.choice([None, -4, -1, 0, 1, 2, 9])) for _ in range(rnd.randint(0, 6))]))
    rows += [(100, None, None), (101, [("A", ["x"])], None)]
    q = spark.createDataFrame(rows, "qid int, context array<struct<title:string,sentences:array<string>>>, "
                                    "supporting_facts array<struct<title:string,sent_idx:int>>")
    ctx = q.select("qid", F.posexplode("context").alias("ctx_pos", "c")).select("qid", "ctx_pos", "c.title", "c.sentences")
    facts = q.select("qid", F.posexplode("supporting_facts").alias("fact_pos", "f")).select("qid", "fact_pos", "f.title", "f.sent_idx")
    nested = G.oracle_contexts(q)
    assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "position", "doc_id", "title", "text", "score").collect())
    assert rows(nested) == rows(G.oracle_contexts_long(ctx, facts)) != []


def test_oracle_extraction_too_negative_index_is_dropped(spark):
    q = spark.createDataFrame(
        [("q", [("T1", ["c", "d"])], [("T1", -3), ("T1", -2), ("T1", 2)])],
        "qid string, context array<struct<title:string,sentences:array<string>>>, "
        "supporting_facts array<struct<title:string,sent_idx:int>>")
    got = [(r["doc_id"], r["text"]) for r in G.oracle_contexts(q).collect()]
    assert got == [("oracle_T1_-2", "c")]


def test_keys_grow_until_they_are_rare(spark):
    """Titles of two letters: every trigram is in every title. Keys grow, and pairs are those of plain search."""
    import random

    from pyspark.sql import functions as F

    from ctxmix.operators import matching as M
    rnd = random.Random(1)
    hay = ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(300)]
    needles = [h[i:i + n] for h in hay[:40] for i, n in ((3, 30), (10, 14), (5, 8), (0, 3), (7, 2))] + ["", "abc"]
    n = spark.createDataFrame([(x,) for x in needles], "n string").distinct()
    h = spark.createDataFrame([(x,) for x in hay], "h string").distinct()
    keys = M.rarest_keys(n, h, rare=20)
    assert [size for size, _ in keys][:3] == [3, 6, 12]
    counts = {r["n"]: r["cnt"] for _, k in keys for r in k.collect()}
    assert max(c for x, c in counts.items() if len(x) >= 12) <= 20 < min(c for x, c in counts.items() if len(x) == 3)
    got = M.contained_pairs(n.withColumnRenamed("n", "needle"), h.withColumnRenamed("h", "haystack"), rare=20).collect()
    want = {(x, t) for x in needles for t in hay if x in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len(M.rarest_keys(n, h)) == 1


def test_docs_by_substring_compare_no_matches_of_single_ids(spark):
    """with an id a row no aggregate holds the matches; ids with several rows still come once."""
    gold = spark.createDataFrame([("q1", "ring"), ("q1", "hot ring"), ("q2", "ring")], "qid string, gold_title string")
    rows = [(i, f"{'hot' if i % 2 else 'cold'} ring") for i in range(40)]
    single = G.gold_docs_by_substring(gold, spark.createDataFrame(rows, "doc_id long, title string"))
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [qid" not in plan.split("Join")[0]
    want = sorted([("q1", i) for i in range(40)] + [("q2", i) for i in range(40)])
    assert sorted(tuple(r) for r in single.collect()) == want
    again = spark.createDataFrame([*rows, *rows[:7], (3, "large ring"), (None, "ring"), (None, "big ring")], "doc_id long, title string")
    got = [tuple(r) for r in G.gold_docs_by_substring(gold, again).collect()]
    assert sorted(got, key=str) == sorted([*want, ("q1", None), ("q2", None)], key=str)
