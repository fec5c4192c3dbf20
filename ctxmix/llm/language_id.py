"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a word's UTF-8 bytes in both directions and gives every byte position a
probability for each language. It is trained in NumPy by backpropagation through time on a
bounded sample. A document's probabilities are the mean over all positions of all its
words. The state starts anew with each word, so a word's positions are labelled alike
wherever it stands: a task runs the network once on each different word of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.llm.tables import fold, hash_sample

UNKNOWN = "und"
#: Bounds of the training sample: documents and different words of a language, bytes of a text.
DOCS_PER_LANG, WORDS_PER_LANG, MAX_TRAIN_BYTES = 400, 12000, 16384
#: Positions that the network reads in one go; longer words continue in a further piece.
SPAN = 24
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers of ``hidden`` units, one for each direction, and a softmax."""

    def __init__(self, n_out: int, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_out = hidden, n_out
        self.p: dict[str, np.ndarray] = {"v": rng.normal(0, 0.2, (2 * hidden, n_out)), "c": np.zeros(n_out)}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))     # a byte's share of update, reset, candidate
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, data: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """States after each position of ``data`` (words x positions), in reading order of ``d``."""
        size, k = self.hidden, data.shape[1]
        x, u = self.p["x" + d], self.p["u" + d]
        h = np.zeros((len(data), size), np.float32)
        out = np.empty((k, len(data), size), np.float32)
        for t in range(k) if d == "f" else range(k - 1, -1, -1):
            a, s = x[data[:, t]], h @ u
            gate = _sigmoid(a[:, :2 * size] + s[:, :2 * size])
            z, r = gate[:, :size], gate[:, size:]
            cand = np.tanh(a[:, 2 * size:] + r * s[:, 2 * size:])
            new = cand + z * (h - cand)
            if tape is not None:
                tape.append((t, h, z, r, cand, s[:, 2 * size:]))
            h = out[t] = new
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities at every position: words x positions x languages."""
        both = np.concatenate([self._run(data, "f", None), self._run(data, "b", None)], axis=2)
        logit = both @ self.p["v"] + self.p["c"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        return (e / e.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, data: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Mean cross-entropy over all positions, differentiated back through time."""
        size, (n, k) = self.hidden, data.shape
        tapes: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(data, d, tapes[d]) for d in "fb"], axis=2)
        logit = states @ self.p["v"] + self.p["c"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        err = e / e.sum(axis=2, keepdims=True)
        err[:, np.arange(n), target] -= 1
        err /= n * k
        g = {"v": np.tensordot(states, err, ((0, 1), (0, 1))), "c": err.sum((0, 1))}
        back = err @ self.p["v"].T
        for j, d in enumerate("fb"):
            u, gx, gu = self.p["u" + d], np.zeros_like(self.p["x" + d]), np.zeros_like(self.p["u" + d])
            dh = np.zeros((n, size), np.float32)
            for t, h, z, r, cand, s in reversed(tapes[d]):
                dh = dh + back[t, :, j * size:(j + 1) * size]
                dcand = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (h - cand) * z * (1 - z)
                dr = dcand * s * r * (1 - r)
                da = np.concatenate([dz, dr, dcand], axis=1)
                ds = np.concatenate([dz, dr, dcand * r], axis=1)
                np.add.at(gx, data[:, t], da)
                gu += h.T @ ds
                dh = dh * z + ds @ u.T
            g["x" + d], g["u" + d] = gx, gu
        return g

    def train(self, words: list[bytes], target: np.ndarray, epochs: int = 3, batch: int = 256,
              rate: float = 0.01, seed: int = 5) -> None:
        """Adam over batches of words of one length, in a fixed shuffled order."""
        rng = np.random.default_rng(seed)
        length = np.array([len(w) for w in words])
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = [part for _ in range(epochs) for part in self._batches(length, batch, rng)]
        for i, part in enumerate(steps, 1):
            data = np.frombuffer(b"".join(words[j] for j in part), np.uint8).reshape(len(part), -1)
            step = rate * (1 - 0.9 * i / len(steps))
            for k, g in self.gradients(data, target[part]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.p[k] -= (step * (mean[k] / (1 - 0.9**i)) / (np.sqrt(square[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)

    @staticmethod
    def _batches(length: np.ndarray, batch: int, rng: np.random.Generator) -> list[np.ndarray]:
        parts = []
        for n in np.unique(length):
            own = rng.permutation(np.flatnonzero(length == n))
            parts += [own[i:i + batch] for i in range(0, len(own), batch)]
        return [parts[i] for i in rng.permutation(len(parts))]


def tidy(distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different lower-cased words without digits and marks at their ends, and for each given
    word its place there; -1 for one without a letter."""
    low = pc.utf8_trim(pc.utf8_lower(distinct), characters=_EDGE)
    coded = low.dictionary_encode()
    letters = pc.match_substring_regex(coded.dictionary, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
    place = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, np.where(letters[place], place, -1) if len(place) else place


def word_sums(words: pa.Array, net: Network, chunk: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the sum of its positions' probabilities, and their number."""
    raw, off = B.buffers(words)
    size = np.diff(off)
    total = np.zeros((len(words), net.n_out))
    pieces = -(-size // SPAN)
    word = np.repeat(np.arange(len(words)), pieces)
    begin = off[:-1][word] + SPAN * (np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(off[1:][word] - begin, SPAN)
    order = np.argsort(length, kind="stable")
    edges = np.searchsorted(length[order], np.arange(SPAN + 2))
    for n in range(1, SPAN + 1):
        for at in range(edges[n], edges[n + 1], chunk):
            own = order[at:min(at + chunk, edges[n + 1])]
            data = raw[begin[own][:, None] + np.arange(n)]
            np.add.at(total, word[own], net.positions(data).sum(axis=1))
    return total, size


def predict(texts: pa.Array, net: Network | None, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Language and its pooled probability for each text; ``und`` and 0 for null or letterless ones."""
    lang, best = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if net is None or not len(texts):
        return lang, best
    w = B.words(texts)
    distinct, place = tidy(w.distinct)
    used = np.unique(place[place >= 0])
    total, size = np.zeros((len(distinct) + 1, net.n_out)), np.zeros(len(distinct) + 1)
    total[used], size[used] = word_sums(distinct.take(pa.array(used)), net)
    codes = place[w.codes]  # -1 is the row of zeros at the end
    n = B.sums(size[codes], w.bounds)
    pooled = B.sums(total[codes], w.bounds) / np.maximum(n, 1)[:, None]
    some = n > 0
    top = pooled.argmax(axis=1)
    lang[some] = np.array(languages, object)[top[some]]
    best[some] = np.clip(pooled[np.arange(len(top)), top][some], 0, 1)
    return lang, best


def fit(documents: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_lang: int = WORDS_PER_LANG,
        max_bytes: int = MAX_TRAIN_BYTES, seed: int = 11) -> tuple[Network | None, list[str]]:
    """Train on a bounded sample: for each language at most ``docs_per_lang`` documents (by the
    hash of their id, none over ``max_bytes``) outside the held-out fifth, and of their different
    words at most ``words_per_lang``. Rows without id, text or language are left out, and of rows with the same id
    and language all but the smallest text; with no rows there is no model, and every text gets ``und``."""
    rows = (documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 5) != 0)
                            & (F.octet_length("text") <= max_bytes)))
    ids = hash_sample(rows.select("doc_id", "lang"), "doc_id", docs_per_lang, "lang").select("doc_id").distinct()
    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    languages = sorted(set(sample.column("lang").to_pylist()))
    rng, found, target = np.random.default_rng(seed), [], []
    for k, lang in enumerate(languages):
        texts = sample.filter(pc.equal(sample.column("lang"), lang)).column("text").combine_chunks()
        distinct, place = tidy(B.words(texts).distinct)
        own = sorted(distinct.take(pa.array(np.unique(place[place >= 0]))).to_pylist())
        picked = rng.permutation(len(own))[:words_per_lang]
        pieces = [b[i:i + SPAN] for j in picked for b in [own[j].encode()] for i in range(0, len(b), SPAN)]
        found += pieces
        target += [k] * len(pieces)
    if not found:
        return None, []
    net = Network(len(languages))
    net.train(found, np.array(target))
    return net, languages


def predictor(spark, net: Network | None, languages: list[str]):
    """A task's function from texts to (language, score); the network (100 kB) is broadcast."""
    shared = spark.sparkContext.broadcast((net, languages))
    return lambda: (lambda texts: predict(texts, *shared.value))


def language_id(documents: DataFrame, net: Network | None, languages: list[str]) -> DataFrame:
    """doc_id, lang_pred and score for every row; repeated rows each, other columns are not read."""
    make = predictor(documents.sparkSession, net, languages)

    def factory():
        f = make()
        return lambda texts: (lambda lang, best: [pa.array(lang, pa.string()), best])(*f(texts))

    return B.add_columns(documents, "text", ["doc_id"], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], factory)


#: Below this score a text is taken for noise. Held-out documents of sf0.01 score 0.66 to 0.99, all its documents 0.44 at
#: least; random letters, Base64 and salad of all languages' words 0.35 to 0.39. Scripts that were not learnt may score higher.
LEAST = 0.4


def keep_known(documents: DataFrame, net: Network | None, languages: list[str], least: float = LEAST) -> DataFrame:
    """The rows with a recognised language whose score is at least ``least``, with all columns."""
    make = predictor(documents.sparkSession, net, languages)

    def factory():
        f = make()
        return lambda texts: (lambda lang, best: (lang != UNKNOWN) & (best >= least))(*f(texts))

    return B.keep_rows(documents, "text", factory)
