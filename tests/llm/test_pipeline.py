"""The pipeline's stages against the single operators on what the stage before kept."""
import random
import string

import corpus_pipeline as P
from ctxmix.llm import packing, simhash
from ctxmix.session import materialize

from test_simhash import plain_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "simhash", "packing"]
    kept = docs
    sizes = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        before, kept = kept, materialize(stage(spark, kept, sf_dir), "stage")  # as the pipeline does
        assert kept.columns == columns and kept.exceptAll(before).isEmpty()
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] and sizes[2] > sizes[3]
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprint_table(before).collect()}
    first = plain_components(prints)
    assert {r.doc_id for r in kept.collect()} == {i for i in prints if first[i] == i}
    rows = P.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
    assert {"sequence_id", "offset"} <= set(rows[0].asDict()) and max(r.length for r in rows) <= packing.LIMIT


def test_language_stage_drops_noise_and_keeps_documents(spark, sf_dir):
    """Random letters and Base64 go (nine in ten at least; the network of this table has seen 160 documents); every
    document of the table stays."""
    rnd = random.Random(4)
    draw = lambda letters, n, k: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, k))) for _ in range(n))
    base64 = string.ascii_letters + string.digits + "+/"
    planted = [draw(string.ascii_lowercase, 200, 9) for _ in range(10)] + [draw(base64, 20, 80) for _ in range(10)] + ["12 34 ...", ""]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    noise = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    kept = P.keep_known_languages(spark, docs.unionByName(noise, allowMissingColumns=True), sf_dir)
    found = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids <= found and len(found - ids) <= 2 and not found & {-21, -22}  # the last two have no letter


def test_odd_rows(spark, docs, no_docs, sf_dir):
    for frame in (docs, no_docs):
        kept = frame
        for _, stage in P.STAGES[:-1]:
            kept = materialize(stage(spark, kept, sf_dir), "stage")
            assert kept.columns == frame.columns
        n = kept.count()
        assert P.STAGES[-1][1](spark, kept, sf_dir).select("doc_id").count() >= n


def test_near_duplicates_stay_out_of_the_driver(spark, docs, monkeypatch):
    """The stage's cells, 33 for a fingerprint, are joined by sort-merge, whatever Spark takes their size for."""
    from ctxmix.llm import simhash

    plans, keep = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or keep(links))
    assert simhash.keep_one(docs).count() < docs.count()
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
