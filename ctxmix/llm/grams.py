"""Word n-grams of a batch of texts, interned in an open-addressed NumPy table.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. An n-gram is its words
joined by one blank. The table is keyed by the XXH64 of an n-gram's bytes; a probe that meets an equal
key compares the bytes as well, so two n-grams never share a slot. Each occurrence gets the
number of its slot; what is known of an n-gram (bucket, count) lies in arrays by slot.
"""

from __future__ import annotations

from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash

from ctxmix.llm import batches as B

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: From this length on a span is hashed (32) or compared (64) by itself.
_HASHED_ALONE, _COMPARED_ALONE = 32, 64


class Spans(NamedTuple):
    raw: np.ndarray      # normalised bytes: words of a text joined by one blank
    begin: np.ndarray    # first byte and length of each n-gram
    size: np.ndarray
    bounds: np.ndarray   # n-grams of text i: bounds[i]:bounds[i + 1]
    n_words: np.ndarray  # words of each text


class Table(NamedTuple):
    slot: np.ndarray     # slot of each occurrence
    used: np.ndarray     # the slots in use
    bucket: np.ndarray   # by slot
    count: np.ndarray    # by slot: occurrences in this batch


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lanes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` with room behind it, and the eight bytes from each place on as one number."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    return padded, np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def hash64(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of every span ``raw[begin:begin + size]``, a step of the hash for all spans at a time."""
    padded, lanes = _lanes(raw)
    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    for k in range(_HASHED_ALONE // 8):
        m = np.flatnonzero(size >= 8 * (k + 1))
        h[m] = _rotl(h[m] ^ (_rotl(lanes[begin[m] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
    rest, at = size & 7, begin + (size & ~7)
    m = np.flatnonzero(rest & 4)
    h[m] = _rotl(h[m] ^ ((lanes[at[m]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at = at + (rest & 4)
    for k in range(3):
        m = np.flatnonzero((rest & 3) > k)
        h[m] = _rotl(h[m] ^ (padded[at[m] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h = h ^ (h >> np.uint64(32))
    for i in np.flatnonzero(size >= _HASHED_ALONE):
        h[i] = xxhash.xxh64_intdigest(raw[begin[i]:begin[i] + size[i]].tobytes(), seed)
    return h


def equal(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans ``a[i]`` and ``b[i]`` hold the same bytes."""
    same = size[a] == size[b]
    _, lanes = _lanes(raw)
    for k in range(_COMPARED_ALONE // 8):
        m = np.flatnonzero(same & (size[a] > 8 * k))
        if not len(m):
            break
        unread = np.clip(8 * (k + 1) - size[a[m]], 0, 7).astype(np.uint64) * np.uint64(8)
        same[m] = ((lanes[begin[a[m]] + 8 * k] ^ lanes[begin[b[m]] + 8 * k]) << unread) == 0
    for i in np.flatnonzero(same & (size[a] > _COMPARED_ALONE)):
        same[i] = np.array_equal(raw[begin[a[i]]:begin[a[i]] + size[a[i]]], raw[begin[b[i]]:begin[b[i]] + size[b[i]]])
    return same


def spans(texts: pa.Array, shortest: int = 1, longest: int = 1) -> Spans:
    """All runs of ``shortest`` to ``longest`` consecutive words of each text (null: no words)."""
    raw, offsets = B.buffers(texts)
    raw = B.lower_ascii(raw)
    edge = np.zeros(raw.size + 1, bool)
    edge[offsets] = True
    inside = _WORD[raw]
    start, end = inside.copy(), inside.copy()
    if raw.size:
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = np.searchsorted(s, offsets)
    # each word's bytes and one blank behind it
    to = np.cumsum(e - s + 1)
    joined = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    joined[np.arange(int((e - s).sum())) + np.repeat(np.arange(len(s)), e - s)] = raw[inside]
    first, last = to - (e - s + 1), to - 1
    n_words = np.diff(words)
    begin, size, text = [], [], []
    for n in range(shortest, longest + 1):
        own = np.maximum(n_words - n + 1, 0)
        at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(words[:-1], own)
        begin.append(first[at])
        size.append(last[at + n - 1] - first[at])
        text.append(np.repeat(np.arange(len(own)), own))
    begin, size, text = (np.concatenate(x) for x in (begin, size, text))
    if longest > shortest:
        order = np.argsort(text, kind="stable")
        begin, size, text = begin[order], size[order], text[order]
    return Spans(joined, begin, size, np.searchsorted(text, np.arange(len(n_words) + 1)), n_words)


def intern(found: Spans, buckets: int) -> Table:
    """Slots of all n-grams. The table has room for twice the occurrences; a full place sends a probe to the next."""
    raw, begin, size, n = found.raw, found.begin, found.size, len(found.begin)
    mask = (1 << max(4, (2 * n).bit_length())) - 1
    owner = np.full(mask + 1, -1, np.int64)  # the occurrence whose bytes a slot stands for
    keys = hash64(raw, begin, size)
    place = (keys & np.uint64(mask)).astype(np.int64)
    slot = np.empty(n, np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = place[waiting]
        free = owner[at] < 0
        owner[at[free]] = waiting[free]  # of several that claim a slot one gets it
        holder = owner[at]
        hit = keys[holder] == keys[waiting]
        maybe = np.flatnonzero(hit)
        hit[maybe] = equal(raw, begin, size, waiting[maybe], holder[maybe])
        slot[waiting[hit]] = at[hit]
        waiting = waiting[~hit]
        place[waiting] = (place[waiting] + 1) & mask
    used = np.flatnonzero(owner >= 0)
    data, bucket = raw.tobytes(), np.zeros(mask + 1, np.int64)
    bucket[used] = [crc32(data[i:i + k]) % buckets for i, k in zip(begin[owner[used]].tolist(), size[owner[used]].tolist())]
    return Table(slot, used, bucket, np.bincount(slot, minlength=mask + 1))


def bucket_counts(texts: pa.Array, buckets: int, shortest: int = 1, longest: int = 1) -> np.ndarray:
    """Occurrences by bucket in all texts."""
    table = intern(spans(texts, shortest, longest), buckets)
    total = np.zeros(buckets, np.int64)
    np.add.at(total, table.bucket[table.used], table.count[table.used])
    return total
