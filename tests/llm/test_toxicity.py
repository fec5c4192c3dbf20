"""Learner, held-out accuracy on the given tables, and odd rows."""
import numpy as np
import pyarrow as pa
import pytest

from ctxmix.llm import toxicity as X
from ctxmix.llm.tables import read

CALM = ["the sun is out", "a calm day by the sea", "we walk home", "tea and bread", "birds sing at dawn", "rain on the roof"]


def small_model():
    bad = [f"{c} you utter moron {w}" for c in CALM for w in ("now", "then", "again")]
    good = [f"{c} {w}" for c in CALM for w in ("now", "then", "again", "today")]
    return X.train(pa.array(bad + good), np.array([1] * len(bad) + [0] * len(good)), l1=0.5)


def test_learns_words_and_is_sparse():
    model = small_model()
    toxic, clean, empty, null = X.score(pa.array(["what a moron you are", "a calm walk in the rain", "", None]), model)
    assert toxic > 0.5 > clean and empty == null and 0 <= empty < 0.5
    assert len(model.keys) < 60 and (np.diff(model.keys.astype(object)) > 0).all()


def test_features_cross_no_text_border():
    rows, keys = X.features(pa.array(["a b c", "c", "", "A, b! c?"]))
    assert np.bincount(rows, minlength=4).tolist() == [6, 1, 0, 6]  # 3 words, 2 pairs, 1 skip pair
    assert set(keys[rows == 0]) == set(keys[rows == 3])


def test_one_class_only():
    assert X.score(pa.array(["x"]), X.train(pa.array(["a", "b"]), np.array([0, 0]))).tolist() == [0.0]
    assert X.score(pa.array(["x"]), X.train(pa.array(["a", "b"]), np.array([1, 1]))).tolist() == [1.0]
    assert X.score(pa.array(["x", None]), X.train(pa.array([], pa.string()), np.array([]))).tolist() == [0.0, 0.0]


def test_order_of_keys_by_brute_force():
    """Scores are the bias and the weights of the different features."""
    model, text = small_model(), "moron moron you utter moron the sun"
    _, keys = X.features(pa.array([text]))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    want = 1 / (1 + np.exp(-(model.bias + sum(weight.get(int(k), 0.0) for k in set(keys.tolist())))))
    assert X.score(pa.array([text]), model)[0] == pytest.approx(want)


def test_held_out_rows(spark):
    from ctxmix.llm.queries import op10_toxicity

    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    rows = [r for r in op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    clean = [r for r in rows if toxic[r.doc_id] == 0]
    found = [r.score for r in rows if toxic[r.doc_id] == 1]
    assert len(clean) > 50 and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert np.mean(found) > np.mean([r.score for r in clean]) + 0.3


def test_rows(docs, no_docs, spark):
    model = small_model()
    assert X.toxicity(docs, model).count() == docs.count() and X.toxicity(no_docs, model).count() == 0
    left = X.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == docs.count()
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 1, 1), (2, 0, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert X.fit(docs, labels) is not None
    assert X.score(pa.array(["x"]), X.fit(no_docs, labels.limit(0))).tolist() == [0.0]


def test_sample_has_long_texts_and_is_filled(spark, monkeypatch):
    """Texts of 20 KB are learnt from; rows without a usable text are replaced by others."""
    seen = []
    monkeypatch.setattr(X, "train", lambda texts, labels: seen.append((texts.to_pylist(), labels.tolist())))
    kinds = [None, "x" * 40000, "a calm day " * 1800]  # the last has 19,800 bytes
    frame = spark.createDataFrame([(i, kinds[i % 3]) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, i // 3 % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    X.fit(frame, labels, max_toxic=7, max_clean=9)
    texts, toxic = seen[0]
    assert texts == [kinds[2]] * 16 and sorted(toxic) == [0] * 9 + [1] * 7
