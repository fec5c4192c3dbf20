"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the different hashes of its words, of neighbouring word pairs and of
pairs with one word between them. Training visits the sampled rows one by one; each
coordinate has its own learning rate, and the L1 term leaves few weights other than zero,
so the model is a short sorted array that is broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.llm.tables import fold, hash_sample
from ctxmix.session import materialize

THRESHOLD = 0.7
#: Bounds of the training sample: rows of each label, and bytes of a text in it.
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_BYTES = 4000, 6000, 32768
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»„“”‘’…–—"


class Model(NamedTuple):
    """Hashes with a weight other than zero (sorted), their weights, and the bias."""
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, word pair and skip pair, repeats included."""
    w = B.words(texts)
    tidy = pc.utf8_trim(pc.utf8_lower(w.distinct), characters=_EDGE)
    plain = np.fromiter((xxhash.xxh64_intdigest(x) if x else 0 for x in tidy.to_pylist()), np.uint64, len(tidy))
    h = plain[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(w.bounds) - 1, dtype=np.int32), np.diff(w.bounds))
    h, doc = h[h != 0], doc[h != 0]
    rows, hashes = [doc], [h]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            same = doc[:-gap] == doc[gap:]
            x = (h[:-gap] * np.uint64(salt) + h[gap:]) * np.uint64(0x165667B19E3779F9)
            rows.append(doc[:-gap][same])
            hashes.append((x ^ (x >> np.uint64(29)))[same])
    return np.concatenate(rows), np.concatenate(hashes)


def train(texts: pa.Array, labels: np.ndarray, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0,
          l2: float = 0.0, epochs: int = 6, min_rows: int = 3, seed: int = 7) -> Model:
    """FTRL-proximal over the rows in a fixed shuffled order, ``epochs`` times.

    Features in fewer than ``min_rows`` rows are left out. Rows of one class only, or none,
    give a model without weights (score 0 for no or clean rows, 1 for toxic ones only).
    """
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.inf if len(labels) and labels[0] else -np.inf)
    def distinct(at: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of 250 rows, each once, in order."""
        r, k = features(texts.slice(at, 250))
        order = np.lexsort((k, r))
        r, k = r[order], k[order]
        new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])) if len(r) else np.zeros(0, bool)
        return r[new] + at, k[new]

    # most hashes are in one row only: count by their low bits first, and keep what may be frequent
    low, many = np.uint64((1 << 24) - 1), np.zeros(1 << 24, np.uint16)
    for at in range(0, len(texts), 250):
        _, k = distinct(at)
        np.add.at(many, (k & low).astype(np.int64), 1)
    rows, keys = [], []
    for at in range(0, len(texts), 250):
        r, k = distinct(at)
        may = many[(k & low).astype(np.int64)] >= min_rows
        rows.append(r[may])
        keys.append(k[may])
    del many
    rows = np.concatenate(rows)
    keys = np.concatenate(keys)
    # names of the frequent hashes, a sixteenth of them at a time: sorting all at once takes several times their bytes
    place, found, known = np.full(len(keys), -1, np.int32), [], 0
    for part in range(16):
        own = np.flatnonzero((keys >> np.uint64(60)) == part)
        u, back, count = np.unique(keys[own], return_inverse=True, return_counts=True)
        frequent = count >= min_rows
        place[own] = np.where(frequent, known + np.cumsum(frequent) - 1, -1)[back]
        found.append(u[frequent])
        known += len(found[-1])
    del keys
    names = np.concatenate(found)
    rows, place = rows[place >= 0], place[place >= 0]
    first = np.searchsorted(rows, np.arange(len(labels) + 1))
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    bias = len(names)  # the last coordinate, without L1
    penalty = np.full(len(z), l1)
    penalty[bias] = 0.0

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= penalty[i], 0.0,
                        (np.sign(zi) * penalty[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in rng.permutation(len(labels)):
            i = np.append(place[first[d]:first[d + 1]], bias)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[d]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange(len(z)))
    kept = np.flatnonzero(w[:bias])
    return Model(names[kept], w[kept], float(w[bias]))


def score(texts: pa.Array, model: Model, bits: int = 22) -> np.ndarray:
    """Probability of label 1 for each text; an empty or null text gets the bias alone."""
    n = len(texts)
    if np.isinf(model.bias):
        return np.full(n, float(model.bias > 0))
    logit = np.full(n, model.bias)
    if len(model.keys) and n:
        seen = np.zeros(1 << bits, bool)
        low = np.uint64((1 << bits) - 1)
        seen[(model.keys & low).astype(np.int64)] = True
        rows, keys = features(texts)
        near = seen[(keys & low).astype(np.int64)]
        rows, keys = rows[near], keys[near]
        at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        hit = model.keys[at] == keys
        pairs = np.unique(rows[hit].astype(np.int64) * len(model.keys) + at[hit])
        logit = logit + np.bincount(pairs // len(model.keys), model.weights[pairs % len(model.keys)], n)
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
        max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out third.

    At most ``max_toxic`` and ``max_clean`` documents, chosen by the hash of their id among those
    that have a text of at most ``max_bytes``. A document labelled more than once counts as toxic if any label
    says so; null labels and ids are left out, and of texts with the same id all but the smallest.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = documents.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    known = materialize(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "labelled")
    chosen = hash_sample(known.where("toxic = 1"), "doc_id", max_toxic, "toxic").unionByName(
        hash_sample(known.where("toxic = 0"), "doc_id", max_clean, "toxic"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return train(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy())


def scorer(spark, model: Model):
    """A task's function from texts to scores; the model is broadcast (some thousand weights)."""
    shared = spark.sparkContext.broadcast(tuple(model))
    return lambda: (lambda texts: score(texts, Model(*shared.value)))


def toxicity(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) for every row.

    Repeated rows are scored each; null texts like empty ones; other columns are not read.
    """
    make = scorer(documents.sparkSession, model)
    scored = B.add_columns(documents, "text", ["doc_id"], [T.StructField("score", T.DoubleType())],
                           lambda: (lambda f: lambda texts: [f(texts)])(make()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    make = scorer(documents.sparkSession, model)
    return B.keep_rows(documents, "text", lambda: (lambda f: lambda texts: f(texts) < threshold)(make()))
