"""Token counts with the whole-token shortcut.

Before any text is read, it is proved which strings of the vocabulary the tokenizer gives
back as exactly one token when they stand alone. A pre-token found among them counts one; only the rest goes
through the merges. A task does this once for each different word of a batch.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.llm.packing import _WIDE_SPACE, byte_letters

MAX_TOKENS = 2048
_ODD = regex.compile(r"[\x00-\x1f\x7f]|(?=[^\x00-\x7f])\p{White_Space}")


class Counter:
    """Counts by one tokenizer file: normalize, split, shortcut or merge.

    ``proved`` may be handed over, so that only one process proves.
    """

    def __init__(self, file: bytes, proved: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_str(file.decode())
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letter = {b: c for c, b in byte_letters().items()}
        self.proved = self.prove() if proved is None else proved

    def normal(self, word: str) -> str:
        return word.lower() if word.isascii() else self.library.normalizer.normalize_str(word)

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token by the merges."""
        return len(self.library.model.tokenize("".join(map(self.letter.__getitem__, piece.encode()))))

    def prove(self) -> frozenset[str]:
        """The strings behind vocabulary entries that are left alone by normalizing and splitting
        and that the merges turn into one token."""
        back, found = byte_letters(), []
        for entry in self.vocab:
            if not entry.endswith(self.suffix):
                continue
            try:
                text = bytes(back[c] for c in entry.removesuffix(self.suffix)).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a letter, or a special token's string
            if text and not _ODD.search(text) and self.normal(text) == text and self.find(text) == [text] and self.merge(text) == 1:
                found.append(text)
        return frozenset(found)

    def word(self, word: str, memo: dict[str, int]) -> int:
        """Tokens of a word without white space between."""
        if _ODD.search(word) or any(s in word for s in self.special):
            return len(self.library.encode(word, add_special_tokens=False).ids)
        n = 0
        for piece in self.find(self.normal(word)):
            if piece in self.proved:
                n += 1
            else:
                if piece not in memo:
                    memo[piece] = self.merge(piece)
                n += memo[piece]
        return n

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: words between ASCII white space are counted apart, which neither
        normalizing nor splitting joins."""
        w = B.words(texts)
        memo: dict[str, int] = {}
        each = np.fromiter((self.word(x, memo) for x in w.distinct.to_pylist()), np.int64, len(w.distinct))
        return B.sums(each[w.codes], w.bounds)


_COUNTERS: dict[int, Counter] = {}


def _counter(file: bytes, proved: frozenset[str]) -> Counter:
    key = zlib.crc32(file)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(file, proved)
    return _COUNTERS[key]


def token_counts(documents: DataFrame, file: bytes, limit: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; null texts like empty ones (0 and 0).

    The tokenizer file and the proved strings (a part of its vocabulary) are broadcast.
    Repeated rows come back each; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast((file, Counter(file).proved))

    def factory():
        counter = _counter(*shared.value)

        def run(texts: pa.Array) -> list:
            n = counter(texts)
            return [np.diff(B.buffers(texts)[1]), n, n > limit]

        return run

    return B.add_columns(documents, "text", ["doc_id"], [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())], factory)
