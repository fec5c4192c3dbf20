"""Bounded samples, whatever ids repeat."""
from pyspark.sql import functions as F

from ctxmix.llm import language_id, toxicity
from ctxmix.llm.tables import fresh, hash_sample


def test_one_id_repeated_fifty_thousand_times(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("k"), F.lit("a").alias("by")).unionByName(spark.range(2, 400).select(F.col("id").alias("k"), F.lit("a").alias("by")))
    got = hash_sample(rows, "k", 20, "by").collect()
    assert len(got) == len({r["k"] for r in got}) == 20


def test_fits_read_one_text_of_a_repeated_id(spark, monkeypatch):
    """The sample that comes to the driver has a row for each id, and is the same whatever the partitions."""
    text = F.concat(F.lit("zz un mot "), (F.col("id") % 9).cast("string"))
    docs = (spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), text.alias("text"), F.lit("fr").alias("lang"))
            .unionByName(spark.range(100, 160).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))))
    seen = []
    to_arrow = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: seen.append(to_arrow(df)) or seen[-1])
    for parts in (1, 6):
        _, languages = language_id.fit(docs.repartition(parts))
        assert languages == ["en", "fr"] and seen[-1].num_rows <= 61
    assert seen[0].sort_by("doc_id").equals(seen[1].sort_by("doc_id"))
    labels = docs.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") == 7).cast("int"))
    for parts in (1, 6):
        toxicity.fit(docs.repartition(parts), labels)
    assert seen[2].sort_by("doc_id").equals(seen[3].sort_by("doc_id")) and seen[2].num_rows <= 61
    assert [r["text"] for r in seen[2].to_pylist() if r["doc_id"] == 7] in ([], ["zz un mot 0"])


def test_fresh(spark):
    assert fresh(spark.createDataFrame([], "__a int, ___A int, b int"), "__a") == "____a"
