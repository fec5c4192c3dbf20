"""Chat formatting by columnar byte assembly, and reading the format back.

A turn is a header for its role, the escaped text and a footer. For a batch of turns the
lengths of all segments, their cumulative offsets and the scatter indices are computed in NumPy; headers
and texts are copied into one preallocated buffer, which is the Arrow column of the result.

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    other      [ROLE name] text [/ROLE]

Where a text has a control string, a backslash goes before it, and before all backslashes that
precede it; taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxmix.llm import batches as B
from ctxmix.session import ship_code

CONTROL = r"\[/?INST\]|</?s>|<</?SYS>>|\[ROLE |\[/ROLE\]"
FORMS = {"user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n"), "system": ("<<SYS>> ", " <</SYS>>\n")}
#: Roles whose text is under the loss mask, and text bytes after which a long conversation goes on in a new part.
LEARNT, PART_BYTES = ("assistant",), 4 << 20
PARTS = "conv_id long, part int, n_turns int, formatted string, loss_starts array<int>, loss_ends array<int>"
_ESCAPED = re.compile(r"(\\*)(" + CONTROL + ")")
#: What a reader looks for: a whole header of another role, as a text may end in "[ROLE" with the footer's blank behind it.
_MARK = re.compile(r"(\\*)(" + CONTROL.replace(r"\[ROLE ", r"\[ROLE [0-9A-Za-z%]*\] ") + ")")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"(\\*)(" + CONTROL + ")", r"\\\1\2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def form(role: str | None) -> tuple[str, str]:
    """Header and footer of a role. Other names are written in a safe alphabet; null is a lone %."""
    if role in FORMS:
        return FORMS[role]
    name = "%" if role is None else "".join(chr(b) if chr(b).isalnum() and b < 128 else f"%{b:02x}" for b in role.encode())
    return f"[ROLE {name}] ", " [/ROLE]\n"


def assemble(roles: pa.Array, texts: pa.Array, parts: np.ndarray) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """Format turns in order; ``parts`` has the first turn of each part and the number of turns.

    Returns the formatted parts and, by part, starts and ends of the loss mask in code points.
    """
    coded = roles.dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    fixed = [s.encode() for r in names for s in form(r)]
    fixed_bounds = np.append(0, np.cumsum([len(s) for s in fixed]))
    pool = np.frombuffer(b"".join(fixed), np.uint8)
    head, foot = fixed_bounds[2 * code + 1] - fixed_bounds[2 * code], fixed_bounds[2 * code + 2] - fixed_bounds[2 * code + 1]
    raw, off = B.buffers(escape(texts.fill_null("")))
    size = np.diff(off)
    end = np.cumsum(head + size + foot)
    begin = end - (head + size + foot)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for which, n, at in ((2 * code, head, begin), (2 * code + 1, foot, begin + head + size)):
        value, stop = B.gather(pool, fixed_bounds, which)
        out[np.arange(len(value)) + np.repeat(at - (stop - n), n)] = value
    out[np.arange(len(raw)) + np.repeat(begin + head - off[:-1], size)] = raw
    points = np.append(0, np.cumsum((out & 0xC0) != 0x80))
    learnt = np.array([r in LEARNT for r in names], bool)[code]
    starts, ends = [], []
    for a, b in zip(parts[:-1], parts[1:]):
        own = np.flatnonzero(learnt[a:b]) + a
        zero = points[begin[a]]
        starts.append((points[begin[own] + head[own]] - zero).astype(np.int32))
        ends.append((points[begin[own] + head[own] + size[own]] - zero).astype(np.int32))
    return B.strings(out, end[parts[1:] - 1]), starts, ends


def format_turns(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each part of a conversation; short ones, the usual case, have one part.

    Turns go by turn, role and text (ties in a defined order, nulls first; repeated rows stay). Null texts
    are empty; rows without a conv_id form a conversation of their own. Rows of a partition come
    sorted by conversation and part. A conversation of any length is streamed in parts.
    """
    ship_code(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last, last_part = object(), 0  # the conversation and part written last

        def write(t: pa.Table) -> pa.RecordBatch:
            nonlocal last, last_part
            ids, texts = t.column("conv_id").combine_chunks(), t.column("text").combine_chunks()
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            new = np.append(True, (key[1:] != key[:-1]) | (null[1:] != null[:-1]))
            size = np.diff(B.buffers(texts)[1])
            first = np.flatnonzero(new)
            conv = np.cumsum(new) - 1
            before = np.cumsum(size) - size
            part = (before - before[first][conv]) // part_bytes
            if ids[0].as_py() == last:
                part[conv == 0] += last_part + 1
            cut = np.append(np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1]))), len(part))
            formatted, starts, ends = assemble(t.column("role").combine_chunks(), texts, cut)
            last, last_part = ids[len(ids) - 1].as_py(), int(part[-1])
            at = pa.array(cut[:-1])
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [ids.take(at), pa.array(part[cut[:-1]].astype(np.int32)), pa.array(np.diff(cut).astype(np.int32)),
                 formatted.cast(pa.string()), pa.array(starts, ints), pa.array(ends, ints)],
                names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_ends"])

        for batch in batches:
            for piece in B.slices(batch, "text"):
                t = pa.Table.from_batches([piece])
                held = t if held is None else pa.concat_tables([held, t])
                ids = held.column("conv_id")
                same = pc.equal(ids, ids[-1]) if ids[-1].is_valid else ids.is_null()
                n = held.num_rows - pc.sum(same.fill_null(False) if hasattr(same, "fill_null") else same).as_py()
                if held.slice(n).column("text").nbytes > part_bytes:
                    n = held.num_rows  # the open conversation is long: go on with a new part
                if n:
                    yield write(held.slice(0, n))
                    held = held.slice(n) if n < held.num_rows else None
        if held is not None:
            yield write(held)

    return rows.mapInArrow(run, PARTS)


def read_turns(formatted: str) -> Iterator[tuple[str | None, str]]:
    """(role, text) of each turn of a formatted part."""
    marks = [m for m in _MARK.finditer(formatted) if not m[1]]
    known = {h.strip(): (r, len(h)) for r, (h, _) in FORMS.items()}
    for a, b in zip(marks[::2], marks[1::2]):
        if a[2] in known:
            role, skip = known[a[2]]
            begin = a.start() + skip
        else:
            name = a[2][6:-2]
            role = None if name == "%" else bytes(int(x[1:], 16) if x[0] == "%" else ord(x) for x in re.findall("%..|.", name)).decode()
            begin = a.end()
        yield role, unescape(formatted[begin:b.start() - 1])


def digests(parts: DataFrame) -> DataFrame:
    """What is read back from the parts, which come sorted within partitions, by conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ship_code(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id: object = run  # no conversation yet
        state: list = []

        def close(rows: list) -> None:
            rows.append((open_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.replace(",", "").split(" ")[::2])

        for batch in batches:
            rows: list = []
            for r in batch.to_pylist():
                if open_id is run or r["conv_id"] != open_id:
                    if open_id is not run:
                        close(rows)
                    open_id, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["formatted"]
                for role, turn in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role or ''}\n{turn}\n".encode())
                for a, b in zip(r["loss_starts"], r["loss_ends"]):
                    learnt = unescape(text[a:b])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            if rows:
                yield batch_of(rows)
        if open_id is not run:
            rows = []
            close(rows)
            yield batch_of(rows)

    return parts.mapInArrow(run, schema)
