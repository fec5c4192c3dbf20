"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph ends at a line break, or within a line at a full stop, question or exclamation mark and a blank;
the paragraphs of a text joined are the text. Each has a 64-bit digest (XXH64; a paragraph that was there
before is digested with how often), so a text is a set of digests. A sketch has three tables of cells;
each digest enters one cell of each table, a cell holding the number of its digests, their XOR
and the XOR of their checks. Subtracting the sketches of two versions leaves their difference: a cell
with one digest gives it away, taking it out of its other cells frees more, until nothing is left. If cells
remain, the sketch was too small, and it is made again with twice the cells.

All texts of a slice are sketched, subtracted and peeled together in NumPy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxmix.llm import batches as B
from ctxmix.session import materialize, ship_code

TABLES = 3
#: Cells of a table in the sketch that is the fingerprint, where every comparison starts.
CELLS = 4
#: Text bytes of documents compared at a time, and digests in one round of sketches.
_SLICE, _ROUND = 1 << 20, 1 << 17
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Digests(NamedTuple):
    values: np.ndarray   # paragraph digests, text by text
    bounds: np.ndarray   # those of text i: bounds[i]:bounds[i + 1]


class Sketch(NamedTuple):
    count: np.ndarray    # (texts, tables, cells) each
    keys: np.ndarray
    checks: np.ndarray


class Difference(NamedTuple):
    pair: np.ndarray     # pair of each recovered digest
    digest: np.ndarray
    side: np.ndarray     # 1: only in the first text, -1: only in the second
    cells: np.ndarray    # by pair: cells of a table when its sketches were peeled


def _mixed(x: np.ndarray, which: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[which]
    x = (x ^ (x >> np.uint64(29))) * _MIX[(which + 1) % 4]
    return x ^ (x >> np.uint64(32))


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all paragraphs, and how many lie before each text."""
    start, edge = np.zeros(raw.size + 1, bool), np.zeros(raw.size + 1, bool)
    edge[offsets] = True
    if raw.size:
        start[1:] = raw == 10
        mark = (raw == 46) | (raw == 33) | (raw == 63)
        start[2:] |= mark[:-1] & (raw[1:] == 32) & ~edge[1:-1]  # both of one text
    start |= edge
    s = np.flatnonzero(start[:raw.size])
    return s, np.searchsorted(s, offsets)


def digests(texts: pa.Array) -> Digests:
    """Paragraph digests of each text; the second of two equal paragraphs of a text has another than the first."""
    raw, offsets = B.buffers(texts)
    s, bounds = paragraphs(raw, offsets)
    data, of = raw.tobytes(), xxhash.xxh64_intdigest
    e = np.append(s[1:], raw.size) if len(s) else s
    values = np.fromiter((of(data[i:j]) for i, j in zip(s.tolist(), e.tolist())), np.uint64, len(s))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    again = np.zeros(len(values), np.int64)
    if len(values):
        new = np.append(True, (values[order][1:] != values[order][:-1]) | (text[order][1:] != text[order][:-1]))
        first = np.flatnonzero(new)
        again[order] = np.arange(len(values)) - first[np.cumsum(new) - 1]
    return Digests(np.where(again > 0, _mixed(values + again.astype(np.uint64) * _MIX[0], 1), values), bounds)


def _places(values: np.ndarray, own: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest in each table, as places in flat arrays."""
    return [(own * TABLES + t) * cells + (_mixed(values, t) & np.uint64(cells - 1)).astype(np.int64) for t in range(TABLES)]


def sketch(values: np.ndarray, own: np.ndarray, texts: int, cells: int) -> Sketch:
    """Sketches of ``texts`` texts; digest i belongs to text ``own[i]``."""
    count, keys, checks = (np.zeros(texts * TABLES * cells, d) for d in (np.int64, np.uint64, np.uint64))
    check = _mixed(values, 3)
    for at in _places(values, own, cells):
        np.add.at(count, at, 1)
        np.bitwise_xor.at(keys, at, values)
        np.bitwise_xor.at(checks, at, check)
    shape = (texts, TABLES, cells)
    return Sketch(count.reshape(shape), keys.reshape(shape), checks.reshape(shape))


def subtract(a: Sketch, b: Sketch) -> Sketch:
    return Sketch(a.count - b.count, a.keys ^ b.keys, a.checks ^ b.checks)


def peel(left: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, side) of all digests that come out, and whether a text's cells are empty in the end."""
    texts, _, cells = left.count.shape
    count, keys, checks = (x.reshape(-1).copy() for x in left)
    found = []
    look = np.flatnonzero(count)
    while True:
        pure = look[(np.abs(count[look]) == 1) & (checks[look] == _mixed(keys[look], 3))]
        if not len(pure):
            break
        own, key, side = pure // (TABLES * cells), keys[pure], count[pure]
        order = np.lexsort((key, own))
        own, key, side = own[order], key[order], side[order]
        one = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))  # it may lie alone in several cells
        own, key, side = own[one], key[one], side[one]
        found.append((own, key, side))
        check, touched = _mixed(key, 3), _places(key, own, cells)
        for at in touched:
            np.subtract.at(count, at, side)
            np.bitwise_xor.at(keys, at, key)
            np.bitwise_xor.at(checks, at, check)
        look = np.unique(np.concatenate(touched))
    empty = ~((count != 0) | (keys != 0) | (checks != 0)).reshape(texts, -1).any(axis=1)
    out = [np.concatenate(x) if found else np.zeros(0, d) for x, d in zip(zip(*found) if found else [()] * 3, (np.int64, np.uint64, np.int64))]
    return *out, empty


def _chosen(d: Digests, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the given texts, and for each its place among them."""
    values, _ = B.gather(d.values, d.bounds, texts)
    return values, np.repeat(np.arange(len(texts)), np.diff(d.bounds)[texts])


def difference(a: Digests, first: np.ndarray, b: Digests, second: np.ndarray, cells: int = CELLS) -> Difference:
    """The digests by which text ``first[i]`` of ``a`` and ``second[i]`` of ``b`` differ, for all i, by peeling.

    Pairs whose cells do not empty go again with twice the cells, until all are done: two different digests
    part sooner or later, and a sketch with room for both texts peels but by rare bad luck.
    """
    parts, used = [], np.zeros(len(first), np.int64)
    todo = np.arange(len(first))
    while len(todo):
        failed = []
        weight = np.cumsum(np.diff(a.bounds)[first[todo]] + np.diff(b.bounds)[second[todo]] + TABLES * cells)
        for group in np.split(todo, np.searchsorted(weight, np.arange(_ROUND, int(weight[-1]) + 1, _ROUND))):
            if not len(group):
                continue
            left = subtract(sketch(*_chosen(a, first[group]), len(group), cells), sketch(*_chosen(b, second[group]), len(group), cells))
            own, key, side, empty = peel(left)
            good = empty[own]
            parts.append((group[own[good]], key[good], side[good]))
            used[group[empty]] = cells
            failed.append(group[~empty])
        todo, cells = np.concatenate(failed), cells * 2
    out = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return Difference(*out, used)


def likeness(a: Digests, first: np.ndarray, b: Digests, second: np.ndarray, found: Difference) -> np.ndarray:
    """Shared paragraphs over all, from what each text has alone; 1 for two empty texts."""
    n, m = np.diff(a.bounds)[first], np.diff(b.bounds)[second]
    alone = np.bincount(found.pair[found.side > 0], minlength=len(first))
    other = np.bincount(found.pair[found.side < 0], minlength=len(first))
    return np.where(m + alone > 0, (n - alone) / np.maximum(m + alone, 1), np.where(other + n > 0, 0.0, 1.0))


def written(s: Sketch) -> list[str]:
    """Each sketch as text: per cell a count of four, the XOR of eight and a check of four bytes, in base64."""
    n = s.count.shape[0]
    cells = np.concatenate([x.astype(d).reshape(n, -1, 1).view(np.uint8).reshape(n, -1, w) for x, d, w in (
        (s.count, "<u4", 4), (s.keys, "<u8", 8), (s.checks & np.uint64(0xFFFFFFFF), "<u4", 4))], axis=2)
    return [base64.b64encode(row.tobytes()).decode() for row in cells.reshape(n, -1)]


def fingerprints(d: Digests, cells: int = CELLS) -> list[str]:
    """The fingerprint of each text."""
    texts = np.arange(len(d.bounds) - 1)
    return written(sketch(*_chosen(d, texts), len(texts), cells))


VERSIONS = "fingerprint string, new_fingerprint string, likeness double, only_old array<long>, only_new array<long>, cells long"


def version_difference(versions: DataFrame, old: str = "old", new: str = "new", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row its ``keep`` columns, the fingerprints of both versions, their likeness, the paragraph
    digests (as signed longs, sorted) that only one of them has, and the cells a table needed. Nulls are empty texts."""
    ship_code(versions.sparkSession)
    schema = ", ".join([*(f"`{c}` {versions.schema[c].dataType.simpleString()}" for c in keep), VERSIONS])
    names = [*keep, *(f.split()[0] for f in VERSIONS.split(", "))]
    rows = versions.select(*[versions[c] for c in keep], F.coalesce(versions[old], F.lit("")).alias("__old"), F.coalesce(versions[new], F.lit("")).alias("__new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "__old", _SLICE):
                a, b = (digests(part.column(part.schema.get_field_index(c))) for c in ("__old", "__new"))
                every = np.arange(part.num_rows)
                found = difference(a, every, b, every)
                alone = []
                for side in (1, -1):
                    m = np.flatnonzero(found.side == side)
                    value = found.digest[m].view(np.int64)
                    order = np.lexsort((value, found.pair[m]))
                    ends = np.searchsorted(found.pair[m][order], np.arange(part.num_rows + 1)).astype(np.int32)
                    alone.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(value[order])))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(fingerprints(a)), pa.array(fingerprints(b)),
                     pa.array(likeness(a, every, b, every, found)), *alone, pa.array(found.cells)], names=names)

    return rows.mapInArrow(run, schema)


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_EDITED = EDITED.replace(",", "").split()[::2]


def edited(text: str, following: str) -> str:
    """``text`` with its last ``floor(n / 2)`` characters replaced by the first as many of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compared(ids: list, texts: list[str], nexts: list[str]) -> list[pa.Array]:
    """The columns of :data:`EDITED`; the text after ``texts[i]`` is ``nexts[i]``."""
    changed = [edited(t, n) for t, n in zip(texts, nexts)]
    kinds = pa.large_string()
    own, new = digests(pa.array(texts, kinds)), digests(pa.array(changed, kinds))
    # the following texts are mostly texts of this slice too
    after = digests(pa.array(nexts[-1:], kinds)) if nexts[:-1] == texts[1:] else None
    every = np.arange(len(texts))
    if after is not None:
        other = Digests(np.concatenate([own.values, after.values]), np.append(own.bounds, own.bounds[-1] + after.bounds[1:]))
        second = every + 1
    else:
        other, second = digests(pa.array(nexts, kinds)), every
    near = [likeness(own, every, d, s, difference(own, every, d, s)) for d, s in ((new, every), (other, second))]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(fingerprints(own)), pa.array(fingerprints(new)),
            *(pa.array(n) for n in near)]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_SLICE`` characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def edited_neighbours(documents: DataFrame) -> DataFrame:
    """For every row its fingerprint, that of the text edited with the next document, and both likenesses.

    The next document is that of the next larger doc_id, after the last comes the first; a table's only row
    follows itself. Null ids come first, rows that share an id go by the hash of their text. Null texts
    are empty; two empty texts are alike (1). Extra columns are not read. An empty table gives none.

    Texts are shuffled once, by ranges of doc_id, and streamed in order. Where two ranges meet, the first text of
    a range and the last one of the range before are written aside and joined on the range's number.
    """
    ship_code(documents.sparkSession)
    spark = documents.sparkSession
    rows = (documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
            .withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}))
    ranged = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in _EDITED[2:5]), ("near_edited", pa.float64()),
                        ("near_next", pa.float64()), ("seat", pa.string()), ("part", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held_id, held = None, None  # the last row, whose next one is yet to come

        def edge(seat: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "seat": seat, "part": part, "text": text}], schema=fields)

        for batch in batches:
            for piece in B.slices(batch, "text", 8 * _SLICE):
                ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                if held is None:
                    yield edge("first", ids[0], texts[0])
                else:
                    ids, texts = [held_id, *ids], [held, *texts]
                for a, b in _blocks(texts[:-1]):
                    done = _compared(ids[a:b], texts[a:b], texts[a + 1:b + 1])
                    yield pa.RecordBatch.from_arrays([*done, *(pa.nulls(b - a, t) for t in (pa.string(), pa.int32(), pa.string()))], schema=fields)
                held_id, held = ids[-1], texts[-1]
        if held is not None:
            yield edge("last", held_id, held)

    streamed = materialize(ranged.mapInArrow(run, EDITED + ", seat string, part int, text string"), "edited")
    edges = streamed.where("seat is not null")
    parts = sorted(r["part"] for r in edges.where("seat = 'first'").select("part").collect())  # one number per range
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    lasts = edges.where("seat = 'last'").select("doc_id", "part", "text").join(F.broadcast(order), "part")
    firsts = edges.where("seat = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(_compared([ids], [text], [following]), names=_EDITED)

    closed = lasts.join(firsts, "following").select("doc_id", "text", "next_text").mapInArrow(close, EDITED)
    return streamed.where("seat is null").select(*_EDITED).unionByName(closed)
