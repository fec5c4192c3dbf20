"""Gradients against differences, held-out accuracy, pooling against single positions."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxmix.llm import language_id as L
from ctxmix.llm.tables import read


def loss(net, data, target):
    p = net.positions(data)
    return -np.log(p[np.arange(len(data))[:, None], np.arange(data.shape[1])[None, :], target[:, None]]).mean()


def test_gradients():
    net = L.Network(3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    data, target = rng.integers(97, 102, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    g = net.gradients(data, target)
    for name, grad in g.items():
        for at in zip(*np.nonzero(np.abs(grad) > np.abs(grad).max() * 0.3)):
            old = net.p[name][at]
            # states are single precision: a wide step
            net.p[name][at] = old + 1e-2
            up = loss(net, data, target)
            net.p[name][at] = old - 1e-2
            down = loss(net, data, target)
            net.p[name][at] = old
            assert (up - down) / 2e-2 == pytest.approx(grad[at], rel=0.05, abs=1e-3)


def test_pooling_by_single_words():
    net = L.Network(2, hidden=4)
    text = "Hello, the wórld the averyveryverylongwordbeyondasinglepiece 99 --"
    words = ["hello", "the", "wórld", "the", "averyveryverylongwordbeyondasinglepiece"]
    every = []
    for w in words:
        raw = w.encode()
        for i in range(0, len(raw), L.SPAN):
            every.append(net.positions(np.frombuffer(raw[i:i + L.SPAN], np.uint8)[None, :])[0])
    pooled = np.concatenate(every).mean(axis=0)
    lang, score = L.predict(pa.array([text, "", None, "12 !"]), net, ["a", "b"])
    assert lang.tolist() == ["ab"[pooled.argmax()], "und", "und", "und"]
    assert score[0] == pytest.approx(pooled.max(), rel=1e-4) and score[1:].tolist() == [0, 0, 0]


def test_held_out_accuracy(spark):
    from ctxmix.llm.queries import op1_language_id

    sf = "/root/testdata/sf0.01"
    rows = op1_language_id(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.95


def test_rows(docs, no_docs):
    net, languages = L.fit(docs)
    assert languages == sorted(languages) and set(languages) <= {"en", "fr", "de"}
    rows = L.language_id(docs, net, languages).collect()
    assert len(rows) == docs.count()
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {3, 4, 5, 6} and all(r.score == 0 for r in rows if r.doc_id in unknown)
    assert all(0 < r.score <= 1 for r in rows if r.doc_id not in unknown)
    kept = L.keep_known(docs, net, languages)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert L.fit(no_docs) == (None, []) and L.language_id(no_docs, None, []).count() == 0
    assert {r.lang_pred for r in L.language_id(docs, None, []).collect()} == {"und"}


def test_long_text_is_read_whole():
    net, languages = L.Network(2, hidden=4), ["a", "b"]
    front, back = "alpha " * 50, "zulu " * 5000
    both = L.predict(pa.array([front, front + back]), net, languages)[1]
    assert both[0] != pytest.approx(both[1], rel=1e-6)
