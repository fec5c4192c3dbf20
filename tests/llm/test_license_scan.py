"""Base phrases and the similarity join against plain Python on whole texts."""
import re

import pytest

from ctxmix.llm import license_scan as L
from ctxmix.llm import oracles


def plain(text, templates=L.TEMPLATES, containment=L.CONTAINMENT, block=L.BLOCK):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = {label: [i for i in range(len(w)) if w[i:i + len(p.split())] == p.split()] for p, label in L.PHRASES.items()}
    every = sorted(sum(at.values(), []))
    base = sorted(k for k in at if at[k])
    found, best = set(), 0.0
    for b in range(0, len(w), block // 2):
        own = set(w[b:b + block])
        for label, t in templates.items():
            t = set(t.split())
            named = set(L.NAMES.get(label, "").split()) <= own and ("version" not in own or set(L.VERSIONS.get(label, "").split()) <= own)
            if named and len(t & own) >= L.needed(len(t), containment):
                found.add(label)
                best = max(best, len(t & own) / len(t))
    return (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(base),
            ",".join(sorted(found | set(base))), 1.0 if base else best)


def values(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


def test_whole_table(spark):
    from ctxmix.llm.queries import op9_licenses

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: values(r) for r in op9_licenses(spark, sf).collect()}
    want = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want and any(x[5] for x in want.values())


@pytest.mark.parametrize("containment", [0.5, 0.8, 1.0])
def test_thresholds(spark, containment):
    notices = ["licensed under apache 2 0", "Released, under the MIT license!", "under the the the", "license mit the under released",
               "word " * 30 + "released under the mit license" + " word" * 100, "released " + "x " * 70 + "under the mit license",
               "all rights reserved all rights reserved cc by cc  by", "a CC-BY", "GENERAL public\nLicense", "the " * 500, "İ Kcc by"]
    frame = spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")
    got = {r.doc_id: values(r) for r in L.license_scan(frame, containment=containment).collect()}
    assert got == {i: plain(t, containment=containment) for i, t in enumerate(notices)}


def test_rows(docs, no_docs):
    rows = L.license_scan(docs).collect()
    want = sorted((repr((r.doc_id, *plain(r.text))) for r in docs.collect()))
    assert sorted(repr((r.doc_id, *values(r))) for r in rows) == want
    assert L.license_scan(no_docs).count() == 0


def test_prefix_has_the_rarest_words():
    order, rows = L.template_index({"a": 9, "b": 1, "c": 5, "d": 7, "e": 3}, {"t": "a b c d e"}, 0.8)
    assert order == ["b", "e", "c", "d", "a"] and [r[:2] for r in rows] == [("b", 0), ("e", 1)]


def test_long_templates_are_refused(docs):
    with pytest.raises(ValueError):
        L.license_scan(docs, {"t": "x " * 40})


def test_native(spark, sf_dir):
    frame = L.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def in_sql(notices):
    """The registered SQL on the same texts."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("given", pd.DataFrame({"doc_id": range(len(notices)), "text": list(notices)}))
    con.execute("create view documents as select * from given")
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    return {r[0]: tuple(r[1:]) for r in con.execute(f"select {columns} from ({oracles.op9()})").fetchall()}


def test_the_words_that_tell_licenses_apart(spark):
    """The one word that may be missing is not the license's name or another version's number."""
    notices = {"Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY NC 4.0": "cc-by,cc-by-nc", "licensed under cc by nc 4": "cc-by,cc-by-nc",
               "released under the Apache License": "", "under the MIT license": "mit", "Licensed under the Apache License, Version 1.0": "",
               "licensed under the apache license version 2": "apache-2.0",
               "This work is licensed under the GNU General Public License version 2": "gpl",
               "This work is licensed under the GNU General Public License": "gpl,gpl-3.0",
               "is licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
               "this work has been released into the public": ""}
    frame = spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")
    rows = L.license_scan(frame).collect()
    got = {r.doc_id: r.labels for r in rows}
    assert got == dict(enumerate(notices.values()))
    assert {r.doc_id: values(r) for r in rows} == {i: plain(t) for i, t in enumerate(notices)} == in_sql(notices)
    assert all(set(L.NAMES[k].split()) <= set(t.split()) for k, t in L.TEMPLATES.items()) and L.NAMES.keys() == L.TEMPLATES.keys()


def test_blocks_follow_the_longest_template(spark):
    body = " ".join(f"w{i}" for i in range(300))
    texts = ["x " * 77 + body + " y" * 50, body[:900], body.replace("w7 ", ""), "a b c", "a b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in L.license_scan(frame, {"body": body, "short": "a b c d e"}, block=None, containment=0.6).collect()}
    assert got == {0: "body", 1: "body", 2: "body", 3: "", 4: ""}
