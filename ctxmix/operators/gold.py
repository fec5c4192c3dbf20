"""Gold evidence: gold titles, gold labelling of ranked rows, substring gold sets, oracle sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .matching import either_contains_pairs
from .skew import salted_join


def lower_title(c) -> Column:
    """Lower-cased title, '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def gold_titles(questions: DataFrame, qid: str = "qid",
                facts: str = "supporting_facts") -> DataFrame:
    """``(qid, gold_titles array<string>)`` = distinct lower-cased supporting titles.

    Row-local (``transform`` over the question's own facts): no shuffle.
    """
    titles = F.transform(F.coalesce(F.col(facts), F.array()), lambda f: F.lower(f["title"]))
    titles = F.filter(titles, lambda t: t.isNotNull())
    return questions.select(qid, F.array_distinct(titles).alias("gold_titles"))


def gold_titles_long(questions: DataFrame, qid: str = "qid",
                     facts: str = "supporting_facts") -> DataFrame:
    """``(qid, gold_title)`` one row per distinct lower-cased supporting title."""
    g = gold_titles(questions, qid, facts)
    return g.select(qid, F.explode("gold_titles").alias("gold_title"))


def is_gold_exact(title, titles) -> Column:
    """J6 predicate: lower(title) is one of the question's gold titles."""
    t = F.col(titles) if isinstance(titles, str) else titles
    return F.coalesce(F.array_contains(t, lower_title(title)), F.lit(False))


def is_gold_substring(title, titles) -> Column:
    """J5 predicate on one row: lower(title) contains a gold title or is contained in one.

    An untitled passage ('') is therefore gold for every question with a fact.
    """
    t = F.col(titles) if isinstance(titles, str) else titles
    lt = lower_title(title)
    hit = F.exists(F.coalesce(t, F.array().cast("array<string>")),
                   lambda g: lt.contains(g) | g.contains(lt))
    return F.coalesce(hit, F.lit(False))


def split_gold_by_title(ranked: DataFrame, titles: DataFrame, qid: str = "qid",
                        title: str = "title", how: str = "exact") -> DataFrame:
    """Flag ranked rows ``is_gold`` against per-question gold titles (equi-join on qid).

    ``how='exact'`` is the stored-run rule, ``how='substring'`` the ratio-path rule.
    Rank order is kept; the join is on the question id only, no theta join.
    """
    out = ranked.join(titles.select(qid, "gold_titles"), on=qid, how="left")
    pred = is_gold_exact(title, "gold_titles") if how == "exact" else \
        is_gold_substring(title, "gold_titles")
    return out.withColumn("is_gold", pred)


def gold_title_matches(gold: DataFrame, passages: DataFrame, gold_title: str = "gold_title",
                       title: str = "title") -> DataFrame:
    """Distinct ``(gold_title, title)`` pairs where either lower-cased string contains the other.

    Works on distinct titles with trigram-blocked equi-joins (see ``matching``).
    """
    g = gold.select(F.lower(F.col(gold_title)).alias("gold_title")).distinct()
    p = passages.select(lower_title(title).alias("ltitle")).distinct()
    return either_contains_pairs(g, p, "gold_title", "ltitle")


def gold_docs_by_substring(gold: DataFrame, passages: DataFrame, key: str = "qid",
                           gold_title: str = "gold_title", doc_id: str = "doc_id",
                           title: str = "title") -> DataFrame:
    """``(key, doc_id)`` for every passage whose title matches one of the key's gold titles.

    ``gold`` is long ``(key, gold_title)``. Matching runs on distinct titles, then two
    equi-joins map titles back to keys and passage ids; the result is distinct. Only
    ids with several rows can come twice, so only their matches are compared with each other.
    """
    pairs = gold_title_matches(gold, passages, gold_title, title)
    g = gold.select(F.col(key), F.lower(F.col(gold_title)).alias("gold_title"))
    keyed = g.join(pairs, "gold_title").select(key, "ltitle").distinct()
    p = passages.select(F.col(doc_id), lower_title(title).alias("ltitle"))
    # dealt by id first: a map-side aggregate would hold a task's ids, of which few or none are equal
    counted = p.select(F.struct(doc_id).alias("__id")).repartition("__id").groupBy("__id").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(counted.where("n > 1").select("__id"), "repeated-ids")
    # few titles may be shared by very many passages: their rows are dealt over several tasks
    matches = lambda rows: salted_join(rows, keyed, "ltitle", doc_id).select(key, doc_id)
    if several.isEmpty():
        return matches(p)
    own = p.withColumn("__id", F.struct(doc_id))
    once = own.join(several, "__id", "left_anti").drop("__id")
    return matches(once).unionByName(matches(own.join(several, "__id", "left_semi").drop("__id").distinct()).distinct())


def gold_title_groups(titles: DataFrame, passages: DataFrame, qid: str = "qid",
                      title: str = "title") -> DataFrame:
    """``(qid, ltitle)``: the lower-cased passage titles that are gold for a question by the substring rule.

    Passages with one of these titles are the question's gold passages (J5), without
    a row for each of them.
    """
    long = titles.select(qid, F.explode("gold_titles").alias("gold_title")).where(
        F.col("gold_title").isNotNull()).select(qid, F.lower("gold_title").alias("gold_title")).distinct()
    return long.join(gold_title_matches(long, passages, "gold_title", title), "gold_title").select(qid, "ltitle").distinct()


def oracle_contexts_long(context: DataFrame, facts: DataFrame, qid: str = "qid") -> DataFrame:
    """P6 on long inputs.

    ``context``: ``(qid, ctx_pos, title, sentences array<string>)``;
    ``facts``: ``(qid, fact_pos, title, sent_idx)``.
    Titles match case-sensitively; for a repeated title the last paragraph wins; an
    index counts from the end when negative and in range, out-of-range facts are
    dropped; duplicates of ``(title, text)`` keep the first fact and its index.
    Output ``(qid, position, doc_id, title, text, score)`` with ``position`` the fact
    position of the kept fact. Aggregations and equi-joins only: no per-question
    collection, so a question with very many facts is still spread over tasks.
    """
    last = (context.where(F.col("title").isNotNull() & F.col("sentences").isNotNull())
            .groupBy(qid, "title")
            .agg(F.max_by("sentences", "ctx_pos").alias("sentences")))
    f = facts.where(F.col("title").isNotNull() & F.col("sent_idx").isNotNull())
    j = f.join(last, on=[qid, "title"], how="inner").withColumn("_n", F.size("sentences"))
    j = j.where((F.col("sent_idx") < F.col("_n")) & (F.col("sent_idx") >= -F.col("_n")))
    idx = F.when(F.col("sent_idx") >= 0, F.col("sent_idx") + 1).otherwise(F.col("sent_idx"))
    j = j.withColumn("text", F.element_at("sentences", idx))
    first = (j.groupBy(qid, "title", "text")
             .agg(F.min(F.struct("fact_pos", "sent_idx")).alias("_first")))
    return first.select(
        qid,
        F.col("_first.fact_pos").alias("position"),
        F.concat(F.lit("oracle_"), F.col("title"), F.lit("_"),
                 F.col("_first.sent_idx").cast("string")).alias("doc_id"),
        "title", "text", F.lit(1.0).alias("score"))


def oracle_contexts(questions: DataFrame, qid: str = "qid") -> DataFrame:
    """P6 on nested question records (``context`` and ``supporting_facts`` arrays).

    Row-local: a question's facts are looked up in its own paragraphs with higher-order
    functions, and nothing is shuffled. Rules and output as in :func:`oracle_contexts_long`.
    """
    context = F.filter(F.coalesce("context", F.array()), lambda c: c["title"].isNotNull() & c["sentences"].isNotNull())
    facts = F.coalesce("supporting_facts", F.array())
    rows = questions.select(F.col(qid), context.alias("_c"), facts.alias("_f"))

    def found(f: Column, i: Column) -> Column:
        same = F.filter("_c", lambda c: c["title"] == f["title"])  # the last one counts
        return F.struct(i.alias("position"), f["title"].alias("title"), f["sent_idx"].alias("idx"),
                        F.get(same, F.size(same) - 1)["sentences"].alias("s"))

    def sentence(h: Column) -> Column:
        at = F.when(h["idx"] >= 0, h["idx"]).otherwise(F.size(h["s"]) + h["idx"])
        return F.struct(h["position"], h["title"], h["idx"], F.get(h["s"], at).alias("text"))

    rows = rows.select(qid, F.transform("_f", found).alias("_h"))
    rows = rows.select(qid, F.transform(F.filter("_h", lambda h: h["s"].isNotNull() & h["idx"].isNotNull() & (
        h["idx"] < F.size(h["s"])) & (h["idx"] >= -F.size(h["s"]))), sentence).alias("_h"))
    first = F.filter("_h", lambda h, i: ~F.exists(F.slice("_h", 1, i), lambda g: (g["title"] == h["title"]) & g["text"].eqNullSafe(h["text"])))
    return rows.select(qid, F.explode(first).alias("h")).select(
        qid, F.col("h.position").alias("position"),
        F.concat(F.lit("oracle_"), F.col("h.title"), F.lit("_"), F.col("h.idx").cast("string")).alias("doc_id"),
        F.col("h.title").alias("title"), F.col("h.text").alias("text"), F.lit(1.0).alias("score"))
