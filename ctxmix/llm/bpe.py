"""Byte-level BPE by corpus-level merge replay, and decoding.

The different pre-tokens of a slice of the corpus lie in one array of symbols with links to
their neighbours. An inverted index leads from a mergeable pair to its positions; pairs are
indexed by the rank they merge to. Ranks are taken in rising order, a rank's merges are
applied at all its positions at once, and only the two pairs beside each are indexed anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ctxmix.llm import batches as B
from ctxmix.llm.batches import gather
from ctxmix.llm.packing import _WIDE_SPACE, PATTERN

#: Text bytes whose pre-tokens are replayed together.
REPLAY_BYTES = 32 << 20


class Vocabulary:
    """A rank file: token bytes by id, single bytes, and every pair whose concatenation is a token."""

    def __init__(self, file: bytes, pattern: str = PATTERN):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file.splitlines() if x)}
        self.size = max(self.rank.values()) + 1
        self.token: list[bytes] = [b""] * self.size
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = sorted((self.rank[t[:k]] * self.size + self.rank[t[k:]], r) for t, r in self.rank.items()
                       for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank)
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.into = np.array([r for _, r in pairs], np.int32)
        # the library's \s is the White_Space property
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, -1 if it is no token."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.into[at], -1)

    def plain(self, piece: bytes) -> list[int]:
        """One pre-token alone: the lowest rank first, the leftmost of equals."""
        if piece in self.rank:
            return [self.rank[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((self.rank.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(self.size, 0))
            if best[0] == self.size:
                return [self.rank[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def replay(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and the bounds of each one's.

    A piece that is a token as a whole is that token. If a merge makes a pair of a lower rank
    in its piece, the order inside the piece matters beyond ranks: such pieces are redone alone.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(size)
    tok = v.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(tok)
    prev, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    if n:
        after[ends[size > 0] - 1] = -1
        prev[(ends - size)[size > 0]] = -1
    whole = np.fromiter((v.rank.get(p, -1) for p in pieces), np.int64, len(pieces))
    owner = np.repeat(np.arange(len(pieces)), size)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    odd: list[np.ndarray] = []

    def enter(at: np.ndarray) -> np.ndarray:
        """Index the pairs that start at these positions; returns their ranks."""
        ranks = v.merged(tok[at], tok[after[at]])
        some = ranks >= 0
        at, own = at[some], ranks[some]
        if len(at):
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            begin = [0, *cut.tolist()]
            for r, a, b in zip(own[begin].tolist(), begin, [*begin[1:], len(own)]):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(queue, r)
        return ranks

    live = np.flatnonzero((after >= 0) & (whole[owner] < 0))
    enter(live)
    while queue:
        rank = heapq.heappop(queue)
        found = index.pop(rank)
        p = found[0] if len(found) == 1 else np.concatenate(found)
        p = p[(tok[p] >= 0) & (after[p] >= 0)]
        if not len(p):
            continue
        p = np.unique(p[v.merged(tok[p], tok[after[p]]) == rank])  # others were changed meanwhile
        if len(p) > 1:  # where positions overlap, every other one of a run from the left
            joined = after[p[:-1]] == p[1:]
            if joined.any():
                begin = np.flatnonzero(np.append(True, ~joined))
                p = p[(np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p))))) % 2 == 0]
        if not len(p):
            continue
        gone = after[p]
        right = after[gone]
        tok[p], tok[gone], after[p] = rank, -1, right
        prev[right[right >= 0]] = p[right >= 0]
        left = prev[p]
        touched = np.unique(np.concatenate([left[left >= 0], p[right >= 0]]))
        ranks = enter(touched)
        low = (ranks >= 0) & (ranks < rank)
        if low.any():
            odd.append(np.unique(owner[touched[low]]))
    keep = tok >= 0
    count = np.bincount(owner[keep], minlength=len(pieces)) if n else np.zeros(len(pieces), np.int64)
    redo = dict.fromkeys(np.flatnonzero(whole >= 0).tolist())
    redo |= dict.fromkeys(np.concatenate(odd).tolist() if odd else [])
    if not redo:
        return tok[keep].astype(np.uint32), np.append(0, np.cumsum(count))
    flat, bounds = tok[keep], np.append(0, np.cumsum(count))
    new = {i: [int(whole[i])] if whole[i] >= 0 else v.plain(pieces[i]) for i in redo}
    out_n = count.copy()
    for i, ids in new.items():
        out_n[i] = len(ids)
    out_b = np.append(0, np.cumsum(out_n))
    out = np.empty(out_b[-1], np.uint32)
    same = np.ones(len(pieces), bool)
    same[list(new)] = False
    take = np.repeat(same, count)
    put = np.repeat(same, out_n)
    out[put] = flat[take]
    order = sorted(new)
    out[~put] = np.fromiter(chain.from_iterable(new[i] for i in order), np.uint32)
    return out, out_b


def encode(texts: pa.Array, v: Vocabulary):
    """Yields the ids of each text, in order."""
    texts = texts.fill_null("")
    odd = pc.match_substring_regex(texts, _WIDE_SPACE).to_numpy(zero_copy_only=False).astype(bool)
    find = v.pattern.findall
    whole = {int(i): [m.encode() for m in find(texts[int(i)].as_py())] for i in np.flatnonzero(odd)}
    w = B.cells(pc.if_else(pa.array(odd), "", texts) if whole else texts)
    parts = [find(x) for x in w.distinct.to_pylist()]
    number: dict[str, int] = {}
    for p in chain.from_iterable(parts):
        number.setdefault(p, len(number))
    pieces = [p.encode() for p in number]
    extra = {m: None for ms in whole.values() for m in ms}
    place = {m: len(pieces) + i for i, m in enumerate(extra)}
    ids, bounds = replay([*pieces, *extra], v)
    # ids of the pieces -> of the cells -> of the texts
    codes = np.fromiter((number[p] for p in chain.from_iterable(parts)), np.int64)
    many = np.fromiter(map(len, parts), np.int64, len(parts))
    cell_ids, ends = gather(ids, bounds, codes)
    cell_bounds = np.append(0, ends)[np.append(0, np.cumsum(many))]
    for at in range(0, len(texts), 500):
        stop = min(at + 500, len(texts))
        a, b = w.bounds[at], w.bounds[stop]
        some, ends = gather(cell_ids, cell_bounds, w.codes[a:b])
        edge = np.append(0, ends)[w.bounds[at:stop + 1] - a]
        for i in range(at, stop):
            if i in whole:
                yield gather(ids, bounds, np.array([place[m] for m in whole[i]], np.int64))[0]
            else:
                yield some[edge[i - at]:edge[i - at + 1]]


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The bytes of a row of ids."""
    return b"".join(map(v.token.__getitem__, ids.tolist()))


_KNOWN: dict[int, Vocabulary] = {}


def vocabulary(file: bytes) -> Vocabulary:
    """One vocabulary in a worker process, whatever number of tasks it runs."""
    key = zlib.crc32(file)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Vocabulary(file)
    return _KNOWN[key]


def round_trip(documents: DataFrame, file: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null texts like empty ones.

    ``file`` is a rank file (about 1 MB), broadcast to the tasks. Repeated rows come back
    each; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(file)

    def factory():
        v = vocabulary(shared.value)

        def run(texts: pa.Array) -> list:
            n, first, second = [], [], []
            for ids in encode(texts, v):
                n.append(len(ids))
                first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(decode(ids, v)).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]

        return run

    return B.add_columns(documents, "text", ["doc_id"], [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], factory, REPLAY_BYTES)


def token_ids(documents: DataFrame, file: bytes) -> DataFrame:
    """doc_id and ids (array of int) of every row, for use beyond digests."""
    shared = documents.sparkSession.sparkContext.broadcast(file)
    return B.add_columns(documents, "text", ["doc_id"], [T.StructField("ids", T.ArrayType(T.IntegerType()))],
                         lambda: lambda texts: [pa.array([i.astype(np.int32) for i in encode(texts, vocabulary(shared.value))], pa.list_(pa.int32()))])
