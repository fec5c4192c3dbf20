"""Fingerprints and components against plain Python."""
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from ctxmix.llm import simhash as S
from ctxmix.llm.components import components
from ctxmix.operators.skew import lookup


def plain(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    n = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> j & 1 for s in shingles) for j in range(64)]
    return sum(1 << j for j in range(64) if 2 * n[j] > len(shingles))


def plain_components(prints):
    """prints: id -> fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints(texts, sf_dir):
    column = pa.array([t if t is None else t[:20000] for t in texts] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:40])
    assert [int(x) for x in S.fingerprints(column)] == [plain(t) for t in column.to_pylist()]


def test_chunks_give_the_same(monkeypatch, texts):
    column = pa.array(texts)
    whole = S.fingerprints(column).tolist()
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.fingerprints(column).tolist() == whole


def test_query_components(spark, sf_dir):
    from ctxmix.llm.queries import op5_simhash

    rows = op5_simhash(spark, sf_dir).collect()
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    prints = dict(zip(t["doc_id"].to_pylist(), map(int, S.fingerprints(t["text"].combine_chunks()))))
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_find_every_pair(spark, seed):
    """Fingerprints around few centres, so that all kinds of flips (in one segment or two) occur."""
    rng = np.random.default_rng(seed)
    centres = [0, (1 << 64) - 1, *(int(x) for x in rng.integers(0, 1 << 63, 4, dtype=np.uint64) * 2)]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            f = c
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                f ^= 1 << int(b)
            prints.add(f)
    prints = sorted(prints)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(prints)]
    got = S.links(spark.createDataFrame(signed, "fp long, rep long")).distinct().collect()
    want = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and (a ^ b).bit_count() <= 2}
    assert {(r.a, r.b) for r in got} == want


def test_counts(spark):
    values = [0, -1, 0x0123456789ABCDEF, -2**63]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "fp long").select(S.counts(F.col("fp")).alias("p")).collect()]
    assert got == [sum(((v & (2**64 - 1)) >> 4 * i & 15).bit_count() << 4 * i for i in range(16)) for v in values]


def test_odd_rows(docs, no_docs):
    rows = S.simhash(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[3].fingerprint == got[4].fingerprint == got[5].fingerprint == "0" * 16
    assert got[1].component_id == got[2].component_id == 1 and got[5].component_id == 3
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert S.simhash(no_docs).count() == 0


def test_keep_one(docs, no_docs):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10, 11, 12, 13] and ids.count(None) == 1
    assert S.keep_one(no_docs).count() == 0


def test_keep_one_of_repeated_and_null_ids(spark):
    """A repeated id links nothing by itself; rows without an id are copies like others."""
    a, b, c = ("the quick brown fox jumps over the lazy dog", "birds sing at dawn while we walk home by the sea", "tea and bread on a calm rainy day in autumn")
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "y"), (3, a, "y"), (1, a, "w"), (None, a, "z"), (None, c, "z"), (None, c, "z")]
    want = None
    for parts in (1, 5):
        got = sorted(map(tuple, S.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect()), key=repr)
        assert sorted(r[:2] for r in got if r[0]) == [(1, b), (1, a)] and [r for r in got if r[0] is None] == [(None, c, "z")]
        want = want or got
        assert got == want


def test_a_repeated_id_with_other_texts_does_not_link_them(spark):
    """Document 1 has two texts; document 0 is near one of them, documents 5 and 6 are near the other."""
    a, b = "the quick brown fox jumps over the lazy dog", "birds sing at dawn while we walk home by the sea"
    rows = [(1, a), (1, b), (0, a), (5, b), (6, b), (None, b)]
    got = S.simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(0, 0), (1, 0), (1, 1), (5, 1), (6, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [1]


@pytest.mark.parametrize("parts", [1, 6])
def test_components_of_linked_fingerprints(spark, monkeypatch, parts):
    """Chains of fingerprints two bits apart, with ids in any order: the smallest id of a chain, whatever its place."""
    rng = np.random.default_rng(parts)
    prints = {}
    for chain in range(12):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(6):
            prints[int(rng.integers(0, 10**6))] = f
            f ^= (1 << int(rng.integers(0, 32))) | (1 << int(rng.integers(32, 64)))
    table = spark.createDataFrame([(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in prints.items()], "doc_id long, fp long").repartition(parts)
    monkeypatch.setattr(S, "fingerprint_table", lambda *a: table)
    got = {r.doc_id: r.component_id for r in S.simhash(table).collect()}
    want = plain_components(prints)
    assert got == want and len(set(want.values())) < len(want)


def test_keep_one_with_clashing_names_and_maps(spark):
    rows = spark.createDataFrame([(1, "a b c d", 7, 8, 1), (1, "a b c d", 7, 8, 1), (2, "a b c d", 7, 8, 1), (3, "x y z", 7, 8, 1)],
                                 "doc_id long, text string, __row long, __STAY long, __id long")
    rows = rows.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "s": F.array(F.struct(F.create_map(F.lit("k"), F.lit(1))))})
    kept = S.keep_one(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id, r.m["k"], r["__row"]) for r in kept.collect()) == [(1, 1, 7), (3, 3, 7)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (20, 20), (None, 3), *((100 + i, 101 + i) for i in range(40)), *((300, i) for i in range(301, 340))]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 7: 6, 8: 6, 9: 6} | {i: 100 for i in range(101, 141)} | {i: 300 for i in range(301, 340)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_of_a_hot_key(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).cast("long").alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("size"), F.max("id").alias("v")).where("k <> 4500")
    got = {r.id: r.v for r in lookup(rows, facts, "k", "size").collect()}
    assert got == {i: 3999 if i < 4000 else None if i == 4500 else i for i in range(5000)}


def test_cells_are_not_broadcast(spark, tmp_path):
    """Spark's estimate of the cells, 33 for a fingerprint, is far too low; a broadcast of them fills the driver."""
    spark.range(5000).select(F.xxhash64("id").alias("fp"), F.xxhash64("id").alias("rep")).write.parquet(f"{tmp_path}/classes")
    plan = S.links(spark.read.parquet(f"{tmp_path}/classes"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
