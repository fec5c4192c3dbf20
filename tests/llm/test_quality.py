"""Counts against plain Python; expectation-maximisation on votes drawn from known rates."""
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from ctxmix.llm import quality as Q


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]


def test_counts(texts, sf_dir):
    odd = ["a b c a b c a", "l1\nl1\n l1\n\n\nl1", "x\r\nx\r\n", "a a a a", "end\n", "\n\nend", "#*$%&|<> # a", "a b c\n", "a b c", " b a b a b a"]
    column = pa.array(texts + odd + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist())
    c = Q.measure(column)
    assert np.stack([c[k] for k in Q.COUNTS[:5]], axis=1).tolist() == [plain(t) for t in column.to_pylist()]


def test_posterior_finds_the_classes():
    rng = np.random.default_rng(4)
    kinds = ["noise"] * 3 + ["repetition"] * 3
    truth = rng.choice(3, 4000, p=[0.8, 0.12, 0.08])  # good, noise, repetition
    rates = np.array([[[0.1, 0.89, 0.01]] * 6, [[0.2, 0.1, 0.7]] * 3 + [[0.2, 0.79, 0.01]] * 3, [[0.2, 0.79, 0.01]] * 3 + [[0.2, 0.1, 0.7]] * 3])
    digit = np.array([[rng.choice(3, p=rates[t, r]) for r in range(6)] for t in truth])
    patterns, inverse, counts = np.unique(digit @ 3 ** np.arange(6), return_inverse=True, return_counts=True)
    good, rate, share = Q.posterior(patterns, counts.astype(float), kinds)
    assert ((good[inverse] >= 0.5) == (truth == 0)).mean() > 0.98
    assert abs(share[0] - 0.8) < 0.05 and abs(rate[1, 0, 2] - 0.7) < 0.1 and abs(rate[0, 0, 1] - 0.89) < 0.05


def test_one_bad_vote_alone_does_not_decide():
    """Unlike a filter that all rules must pass: a rule that errs often loses its weight."""
    kinds = ["noise"] * 3
    patterns = np.array([1 + 3 + 9, 2 + 3 + 9, 2 + 6 + 18])
    good, _, _ = Q.posterior(patterns, np.array([9000.0, 500.0, 500.0]), kinds)
    assert good[0] > 0.9 and good[1] > 0.5 and good[2] < 0.5


def test_labels(spark):
    from ctxmix.llm.queries import op6_quality

    sf = "/root/testdata/sf0.01"
    rows = op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F_quality()), "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    sound = [r for r in rows if r.label == 1 and not r.base_failed]
    poor = [r for r in rows if r.label == 0]
    assert np.mean([r.kept for r in sound]) > 0.95 and np.mean([r.kept for r in poor]) < 0.2


def F_quality():
    from pyspark.sql import functions as F

    return F.col("quality").alias("label")


def test_rows(docs, no_docs):
    rows = Q.quality(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (3, 4, 5, 7)) and all(0 <= r.quality <= 1 for r in rows)
    assert by_id[7].n_repeat_words == by_id[7].n_words == 54000
    assert Q.quality(no_docs).count() == 0
