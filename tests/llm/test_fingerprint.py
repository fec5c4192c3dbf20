import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ctxmix.llm import fingerprint as fp
from ctxmix.llm import queries


def plain_paragraphs(text):
    return [p for p in re.split(r"(?<=\n)|(?<=[.!?] )", text) if p]


def plain_likeness(a, b):
    a, b = Counter(plain_paragraphs(a)), Counter(plain_paragraphs(b))
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


def plain(rows):
    """(doc_id, n_chars, digest, near_edited, near_next) by the contract; rows in the operator's order."""
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), plain_likeness(text, new), plain_likeness(text, after)))
    return out


def ordered(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3]))


def test_paragraphs_are_the_text(texts):
    a = pa.array(texts, pa.large_string())
    d = fp.digests(a)
    for i, t in enumerate(texts):
        own = plain_paragraphs(t or "")
        assert "".join(own) == (t or "")
        values = d.values[d.bounds[i]:d.bounds[i + 1]].tolist()
        assert len(values) == len(own) == len(set(values))
        first = {p: v for p, v in reversed(list(zip(own, values)))}
        assert all(v == xxhash.xxh64_intdigest(p) for p, v in first.items())


@pytest.mark.parametrize("cells", [1, 2, 4, 64])
def test_peeling_recovers_the_difference_whatever_the_first_size(cells):
    rnd = np.random.default_rng(cells)
    sets = []
    for n, m, shared in ((0, 0, 0), (0, 1, 0), (3, 0, 5), (40, 60, 3), (1, 1, 1000), (500, 0, 0), (0, 0, 77)):
        s, a, b = (rnd.integers(0, 2**63, k, dtype=np.uint64) for k in (shared, n, m))
        sets.append((np.concatenate([s, a]), np.concatenate([b, s])))
    first, second = (fp.Digests(np.concatenate([s[k] for s in sets]), np.append(0, np.cumsum([len(s[k]) for s in sets]))) for k in (0, 1))
    every = np.arange(len(sets))
    found = fp.difference(first, every, second, every, cells)
    for i, (a, b) in enumerate(sets):
        own = {(int(d), int(s)) for p, d, s in zip(found.pair, found.digest, found.side) if p == i}
        assert own == {(int(x), 1) for x in set(a.tolist()) - set(b.tolist())} | {(int(x), -1) for x in set(b.tolist()) - set(a.tolist())}
        assert found.cells[i] >= cells
    assert found.cells[3] * fp.TABLES >= 100 * 0.8  # a sketch that is too small fails and is made larger
    assert found.cells[6] == cells


def test_sketches_subtract_and_are_texts(texts):
    d = fp.digests(pa.array(["a\nb\nc", "a\nb\nc", "a\nb\nd", ""], pa.large_string()))
    prints = fp.fingerprints(d)
    assert prints[0] == prints[1] != prints[2] and len(set(map(len, prints))) == 1
    every = np.arange(4)
    s = fp.sketch(*fp._chosen(d, every), 4, 4)
    assert not any(x[0].any() for x in fp.subtract(fp.Sketch(*(x[:1] for x in s)), fp.Sketch(*(x[1:2] for x in s))))


def test_versions(spark):
    rows = [(1, "one.\ntwo.\nthree.", "one.\n2.\nthree."), (2, None, ""), (3, "x\nx\n", "x\n"), (4, "", "new"), (5, "a\n" * 3000, "a\n" * 2990 + "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, old string, new string, likeness long")
    got = {r["id"]: r for r in fp.version_difference(df, keep=("id",)).collect()}
    hashed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t)).astype(np.int64))
    assert got[1]["only_old"] == [hashed("two.\n")] and got[1]["only_new"] == [hashed("2.\n")] and got[1]["likeness"] == 0.5
    assert got[2]["likeness"] == 1.0 and got[2]["only_old"] == [] and got[2]["fingerprint"] == got[2]["new_fingerprint"]
    assert len(got[3]["only_old"]) == 1 and got[3]["only_new"] == [] and got[3]["likeness"] == 0.5
    assert got[4]["likeness"] == 0.0 and got[4]["only_new"] == [hashed("new")]
    assert got[5]["likeness"] == 2990 / 3001 and len(got[5]["only_old"]) == 10
    assert fp.version_difference(df.limit(0)).collect() == []


def test_edited_neighbours(spark, docs, no_docs):
    wanted = key(plain(ordered(docs)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = fp.edited_neighbours(docs).collect()
        assert key([tuple(r)[:3] + tuple(r)[5:7] for r in got]) == wanted
    spark.conf.set("spark.sql.shuffle.partitions", old)
    same = {}
    for r in got:
        same.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(len(s) == 1 for s in same.values())
    assert fp.edited_neighbours(no_docs).collect() == []
    one = fp.edited_neighbours(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_ranges_meet(spark):
    """Ids spread over many ranges; a third of all rows share id and text."""
    rows = [(i if i % 3 else 600, f"{i % 7}a. {i % 5}b\n{i % 3}c!" if i % 3 else "same. same\nsame") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = fp.edited_neighbours(docs).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert key([tuple(r)[:3] + tuple(r)[5:7] for r in got]) == key(plain(ordered(docs)))


def test_query(spark, sf_dir):
    got = queries.op12_fingerprint(spark, sf_dir).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert key([tuple(r)[:3] + tuple(r)[5:7] for r in got]) == key(plain(rows))
    text = dict(rows)
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(text[r["doc_id"]])
    assert all(len(t) == 1 for t in by.values())
    edited = {r["edited_sha256"]: r["edited_fingerprint"] for r in got}
    own = {hashlib.sha256(text[r["doc_id"]].encode()).hexdigest(): r["fingerprint"] for r in got}
    assert all(own[k] == edited[k] for k in own.keys() & edited.keys())
