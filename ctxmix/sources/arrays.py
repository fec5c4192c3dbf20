"""Top-level JSON arrays read by many tasks.

A file that is one array has no line to split at, and whether a byte lies in a string is not to be seen from
where it stands. So files are cut into byte ranges and read twice. The first pass reduces each range to
what it does to a reader's state: whether its quotes come out odd, and by how much brackets change the depth if it
begins outside a string and if it begins inside one. Running sums over a file's ranges turn these into the state
in which each range begins. The second pass starts each range from its state, finds the commas and brackets between the
array's elements, and emits the elements whose border lies in the range, reading on to the end of the last.

A file that holds one object instead is one element. Files are UTF-8 and found by Spark's own file listing; tasks
open them through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, parallelism, ship_code

#: Bytes of a range, and bytes looked at together.
SPLIT, _BLOCK = 64 << 20, 1 << 20
_QUOTE, _ESCAPE, _COMMA = 34, 92, 44
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[*b"[{"]], _DEPTH[[*b"]}"]] = 1, -1
_BLANK = b" \t\n\r"


class Scanner:
    """State of a reader between blocks: whether it is in a string, at which depth, and whether the next byte is escaped."""

    def __init__(self, in_string: bool = False, depth: int = 0, escaped: bool = False) -> None:
        self.in_string, self.depth, self.escaped = in_string, depth, escaped

    def feed(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of brackets and commas outside strings, the depth after each, and brackets inside strings (as
        changes of depth, for the other case)."""
        at = np.arange(len(block))
        run = at - np.maximum.accumulate(np.where(block != _ESCAPE, at, -1 - self.escaped))  # escapes that end here
        odd = np.append(self.escaped, run[:-1] % 2 == 1) if len(block) else np.zeros(0, bool)
        quotes = (block == _QUOTE) & ~odd
        inside = (np.cumsum(quotes) + self.in_string) % 2 == 1
        marks = np.flatnonzero((_DEPTH[block] != 0) | (block == _COMMA))
        outside = marks[~inside[marks]]
        depth = self.depth + np.cumsum(_DEPTH[block[outside]])
        if len(block):
            self.in_string, self.escaped = bool(inside[-1]), bool(run[-1] % 2)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        return outside, depth, _DEPTH[block[marks[inside[marks]]]]


def _opened(path: str):
    """A random-access file of any file system that pyarrow knows."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if path.startswith(("s3a:", "s3n:")):
        path = "s3" + path[3:]
    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _blocks(file, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(start, end, _BLOCK):
        yield at, np.frombuffer(file.read_at(min(_BLOCK, end - at), at), np.uint8)


def _escaped(file, start: int) -> bool:
    """Whether the byte at ``start`` is escaped: an odd number of escapes ends before it."""
    n, at = 0, start
    while at > 0:
        size = min(4096, at)
        tail = file.read_at(size, at - size)
        run = size - len(tail.rstrip(b"\\"))
        n, at = n + run, at - size
        if run < size:
            break
    return n % 2 == 1


def summary(file, start: int, end: int) -> tuple[int, int, int, bool]:
    """(quotes odd, change of depth if the range begins outside a string, if inside, whether the file is no array)."""
    scanner = Scanner(escaped=_escaped(file, start))
    out = inside = 0
    for _, block in _blocks(file, start, end):
        before = scanner.depth
        _, _, hidden = scanner.feed(block)
        out, inside = out + scanner.depth - before, inside + int(hidden.sum())
    lone = start == 0 and file.read_at(_BLOCK, 0).removeprefix(b"\xef\xbb\xbf").lstrip(_BLANK)[:1] != b"["
    return int(scanner.in_string), out, inside, lone


def elements(file, start: int, end: int, size: int, in_string: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the elements that follow a border in ``start .. end``."""
    scanner = Scanner(in_string, depth, _escaped(file, start))
    open_at, held = None, []   # offset after the last border, bytes since
    for at, block in _blocks(file, start, size):
        marks, after, _ = scanner.feed(block)
        kind = block[marks]
        step = _DEPTH[kind]
        border = ((step == 0) & (after == 1)) | ((step > 0) & (after == 1)) | ((step < 0) & (after == 0))
        data, begin = block.tobytes(), 0
        for place, closes in zip(marks[border].tolist(), (step[border] < 0).tolist()):
            if open_at is not None:
                value = b"".join([*held, data[begin:place]]).strip(_BLANK)
                if value:
                    yield open_at, value
            if at + place >= end or closes:
                open_at, held = None, []
                if at + place >= end:
                    return
                continue
            open_at, held, begin = at + place + 1, [], place + 1
        if open_at is not None:
            held.append(data[begin:])
        elif at + len(block) >= end:
            return
    if open_at is not None:  # the file ends within the array
        value = b"".join(held).strip(_BLANK)
        if value:
            yield open_at, value


def array_elements(spark: SparkSession, path: str | Sequence[str], split: int = SPLIT) -> DataFrame:
    """(file, at, value): every element of the top-level arrays at ``path`` (files, folders or globs) as JSON text, with its
    file and the byte where it begins. ``split`` is the size of a range; empty arrays give no rows."""
    ship_code(spark)
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "length")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(parallelism(spark), -(-total // split))
    cut = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))
    ranges = (files.where("length > 0").select("path", "length", F.explode(cut).alias("start"))
              .withColumn("end", F.least(F.col("start") + split, F.col("length"))).repartition(tasks))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                with _opened(r["path"]) as f:
                    r["odd"], r["outside"], r["inside"], r["lone"] = summary(f, r["start"], r["end"])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("odd", pa.int32()),
                    ("outside", pa.int64()), ("inside", pa.int64()), ("lone", pa.bool_())]))

    seen = materialize(ranges.mapInArrow(summarise, "path string, length long, start long, end long, odd int, outside long, inside long, lone boolean"), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = (seen.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
              .withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
              .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
              .withColumn("lone", F.max("lone").over(Window.partitionBy("path"))).drop("odd", "outside", "inside", "change"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())]))
            rows.clear()
            size = 0
            return out

        for given in batches:
            for r in given.to_pylist():
                with _opened(r["path"]) as f:
                    if r["lone"]:  # one object: all of it, by the task of the first range
                        found = [(0, f.read_at(r["length"], 0))] if r["start"] == 0 else []
                    else:
                        found = elements(f, r["start"], r["end"], r["length"], r["in_string"], r["depth"])
                    for at, value in found:
                        rows.append({"file": r["path"], "at": at, "value": value.decode("utf-8", "replace")})
                        size += len(value)
                        if size >= _BLOCK * 4:
                            yield batch()
        if rows:
            yield batch()

    return states.repartition(tasks).mapInArrow(read, "file string, at long, value string")
