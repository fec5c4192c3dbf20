"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of a text and votes good, bad or abstains. Votes are packed into
one pattern number; the corpus is reduced to the count of each pattern (at most 3 to the number of
rules). Expectation-maximisation over these counts estimates how each rule votes on good
texts and on each kind of bad ones, and how many there are. A pattern's posterior is looked
up for each text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.session import materialize

MIN_WORDS, MAX_REPEAT, SYMBOLS = 50, 50, b"#*$%&|<>"
#: Counts of a text that rules look at; the first five are returned.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_distinct", "n_alpha", "n_digits", "n_marked"]

_SYMBOL, _ALPHA, _END = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS)] = True
_ALPHA[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True  # ASCII letters, first bytes of other characters
_END[list(b".!?:;\"'")] = True


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64 if len(mask) >= 2**31 else np.int32)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets]).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text."""
    raw, offsets = B.buffers(texts)
    n = len(offsets) - 1
    s, e, bounds, space = B.spans(raw, offsets)
    out = {"n_words": np.diff(bounds), "word_chars": _count(~space & ((raw & 0xC0) != 0x80), offsets),
           "n_symbols": _count(_SYMBOL[raw], offsets), "n_digits": _count((raw >= 48) & (raw <= 57), offsets)}
    doc = np.repeat(np.arange(n), out["n_words"])
    coded = B.strings(raw[~space], np.cumsum(e - s)).dictionary_encode()
    code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    out["n_distinct"] = np.bincount(np.unique(doc * many + code) // many, minlength=n)
    alpha = np.append(0, np.cumsum(_ALPHA[raw], dtype=np.int64))
    out["n_alpha"] = np.bincount(doc, (alpha[e] > alpha[s]) if len(s) else None, minlength=n).astype(np.int64)

    marks = np.append(0, np.cumsum(_SYMBOL[raw], dtype=np.int64))
    out["n_marked"] = np.bincount(doc, (marks[e] > marks[s]) if len(s) else None, minlength=n).astype(np.int64)

    # words of three-word windows that a text has twice or more
    hit = np.zeros(len(code) + 2, bool)
    if len(code) > 2:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        pair = np.unique(code[at] * many + code[at + 1], return_inverse=True)[1]
        triple = np.unique(pair * many + code[at + 2], return_inverse=True)[1]
        key = doc[at] * (int(triple.max(initial=0)) + 1) + triple
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            hit[at[twice] + k] = True
    out["n_repeat_words"] = _count(hit[:len(code)], bounds)

    # lines
    newline = raw == 10
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    edge[1:] |= newline
    start = np.flatnonzero(edge[:-1])
    stop = np.append(start[1:], len(raw)) if len(start) else start
    stop = stop - (newline[stop - 1] & (stop > start) if len(start) else 0)
    line_doc = np.searchsorted(offsets, start, side="right") - 1
    worded = np.searchsorted(s, stop) > np.searchsorted(s, start)
    lines = B.strings(raw[~newline], np.cumsum(stop - start)).dictionary_encode()
    code, many = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)[worded], max(1, len(lines.dictionary))
    owner = line_doc[worded]
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(owner * many + code) // many, minlength=n)
    final = np.searchsorted(e, stop, side="right") - 1  # the last word of a line
    out["n_ended"] = np.bincount(owner, _END[raw[e[final[worded]] - 1]] if len(owner) else None, minlength=n).astype(np.int64)
    return out


def _band(value: np.ndarray, good: tuple[float, float], bad_below: float | None = None, bad_above: float | None = None) -> np.ndarray:
    """1 inside the good band, 2 beyond a bad bound, else 0 (abstains)."""
    vote = ((value >= good[0]) & (value <= good[1])).astype(np.int64)
    if bad_below is not None:
        vote[value < bad_below] = 2
    if bad_above is not None:
        vote[value > bad_above] = 2
    return vote


#: name -> (kind of fault, votes from the counts ``c`` and the number of words ``w``, 1 at least).
RULES: dict[str, tuple[str, Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]]] = {
    "symbols": ("noise", lambda c, w: _band(c["n_symbols"] / w, (0, 0.02), None, 0.1)),
    "marked_words": ("noise", lambda c, w: _band(c["n_marked"] / w, (0, 0.02), None, 0.1)),
    "letters": ("noise", lambda c, w: _band(c["n_alpha"] / w, (0.9, 1), 0.7)),
    "repeats": ("repetition", lambda c, w: _band(c["n_repeat_words"] / w, (0, 0.2), None, 0.4)),
    "variety": ("repetition", lambda c, w: np.where(w < 50, 0, _band(c["n_distinct"] / np.minimum(w, 400), (0.3, 400), 0.15))),
    "duplicate_lines": ("repetition", lambda c, w: np.where(c["n_lines"] < 3, 0, _band(c["n_dup_lines"] / np.maximum(c["n_lines"], 1), (0, 0.1), None, 0.3))),
    "length": ("shape", lambda c, w: _band(c["n_words"], (50, 1e5), bad_below=20)),
    "word_length": ("shape", lambda c, w: _band(c["word_chars"] / w, (3, 11), 2.0, 16.0)),
    "digits": ("shape", lambda c, w: _band(c["n_digits"] / w, (0, 0.5), None, 2.0)),
    "line_ends": ("shape", lambda c, w: np.where(c["n_lines"] < 3, 0, _band(c["n_ended"] / np.maximum(c["n_lines"], 1), (0.5, 1), 0.1))),
}


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """All votes of a text as one number, a digit to the base 3 for each rule."""
    w = np.maximum(c["n_words"], 1)
    return sum(3**i * rule(c, w) for i, (_, rule) in enumerate(RULES.values()))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, the counts and the vote pattern of every row."""
    fields = [T.StructField(n, T.LongType()) for n in [*COUNTS[:5], "votes"]]

    def run(texts: pa.Array) -> list:
        c = measure(texts)
        return [*(c[n].astype(np.int64) for n in COUNTS[:5]), votes(c).astype(np.int64)]

    return B.add_columns(documents, "text", ["doc_id"], fields, lambda: run)


def posterior(patterns: np.ndarray, counts: np.ndarray, kinds: list[str] | None = None, rounds: int = 100,
              good_share: float = 0.85, anchor: float = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good for each pattern, how rules vote by class, and the classes' shares.

    Classes are good texts and one kind of bad texts for each kind of rules. The second result has the
    shares of abstaining, good and bad votes by class and rule: the accuracies. Rules vote
    independently given the class. At the start a kind's rules find half of its bad texts and
    other rules take these for good ones; ``anchor`` texts of the start stay in every estimate.
    """
    kinds = kinds or [k for k, _ in RULES.values()]
    names, n_rules = sorted(set(kinds)), len(kinds)
    digit = patterns[:, None] // 3 ** np.arange(n_rules)[None, :] % 3
    start = np.tile([0.2, 0.78, 0.02], (1 + len(names), n_rules, 1))
    for k, name in enumerate(names, 1):
        start[k, [i for i, x in enumerate(kinds) if x == name]] = [0.25, 0.25, 0.5]
    first = np.array([good_share, *[(1 - good_share) / len(names)] * len(names)])
    rate, share = start.copy(), first.copy()
    for _ in range(rounds):
        chance = np.log(share) + np.log(rate)[:, np.arange(n_rules), digit].sum(axis=2).T  # patterns x classes
        chance = np.exp(chance - chance.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        mass = counts[:, None] * chance
        cast = np.stack([mass.T @ (digit == v) for v in range(3)], axis=2)
        rate = (cast + anchor * start) / (mass.sum(axis=0) + anchor)[:, None, None]
        share = (mass.sum(axis=0) + anchor * first) / (counts.sum() + anchor)
    return chance[:, 0], rate, share


def quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, quality (posterior) and kept for every row.

    Null texts have no words and fail. Repeated rows are judged (and counted) each; other
    columns are not read. Pattern counts over all documents are the only thing collected, at most
    3 to the number of rules.
    """
    table = materialize(measured(documents), "counts")
    found = table.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    spark = documents.sparkSession
    good, _, _ = posterior(np.array([r.votes for r in found], np.int64), np.array([r.n for r in found], float))
    known = spark.createDataFrame([(r.votes, float(g)) for r, g in zip(found, good)], "votes long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (table.join(F.broadcast(known), "votes").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("votes"))
