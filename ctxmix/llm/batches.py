"""Arrow batches of texts as flat NumPy buffers: word spans, distinct words, bounded slices.

Nothing here knows about Spark's data: each helper works on one Arrow batch inside a task.
Null texts count as empty everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ctxmix.session import ship_code

#: Text bytes a task works on at a time (one longer text is a slice of its own).
SLICE_BYTES = 8 << 20

#: ASCII white space: blank and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*b"0123456789", *range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_ALNUM[33:127]


class Words(NamedTuple):
    codes: np.ndarray      # one entry per word: its place in `distinct`
    bounds: np.ndarray     # words of text i: codes[bounds[i]:bounds[i + 1]]
    distinct: pa.Array     # the different words


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and their offsets (first 0, last the number of bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay (UTF-8 parts of other letters are above 127)."""
    out = raw.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def strings(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Back-to-back strings in ``raw`` with the given ends as an Arrow array, without a copy."""
    off = np.zeros(len(ends) + 1, np.int64)
    off[1:] = ends
    if len(raw) < 2**31:
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw))
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(off), pa.py_buffer(raw))


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, words per text as bounds, and the space mask."""
    n = raw.size
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = ~space, ~space
    if n:
        start[1:] &= space[:-1] | edge[1:n]
        end[:-1] &= space[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets), space


def words(texts: pa.Array) -> Words:
    """Words between ASCII white space, as codes into the different words of this batch."""
    raw, offsets = buffers(texts)
    s, e, bounds, space = spans(raw, offsets)
    coded = strings(raw[~space], np.cumsum(e - s)).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), bounds, coded.dictionary)


def cells(texts: pa.Array) -> Words:
    """Like :func:`words`, but each word carries the white space before it, so that the cells
    of a text joined are the text. White space at a text's end is a cell of its own, and
    so is what follows an ASCII letter or digit from an ASCII mark on. The split patterns of
    the byte-level vocabularies end a match at each of these places."""
    raw, offsets = buffers(texts)
    n = raw.size
    space = _SPACE[raw]
    start = np.zeros(n + 1, bool)
    if n:
        start[1:n] = (space[1:] & ~space[:-1]) | (_MARK[raw[1:]] & _ALNUM[raw[:-1]])
    start[offsets] = True
    s = np.flatnonzero(start[:n])
    coded = strings(raw, np.append(s[1:], n) if len(s) else s).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(s, offsets), coded.dictionary)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (rows) per text; 0 for a text without any."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[bounds[c]:bounds[c + 1]] for each code c, in a row, and where each one ends."""
    n = np.diff(bounds)[codes]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1][codes] - (ends - n), n)], ends


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds at most ``limit`` text bytes, or one text."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at, rows = 0, batch.num_rows
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(end, rows) - at)
        at = min(end, rows)


def add_columns(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField],
                factory: Callable[[], Callable[[pa.Array], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns plus ``fields``, which ``factory()`` (called once a task) computes from texts."""
    ship_code(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    names, source = schema.names, df.select(*[df[c].alias(c) for c in dict.fromkeys([*keep, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch in batches:
            make = make or factory()
            for part in slices(batch, text, limit):
                made = make(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), *(x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in made)],
                    names=names)

    return source.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, factory: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, whose text gets True."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch in batches:
            make = make or factory()
            for part in slices(batch, text):
                mask = make(part.column(part.schema.get_field_index(text)))
                yield part.filter(pa.array(np.asarray(mask, bool)))

    return df.mapInArrow(run, df.schema)
