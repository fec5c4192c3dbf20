"""Format and read back; parts of long conversations; reversible escapes."""
import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxmix.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, n_turns int, formatted string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\</s>\\\\[INST] <s>é😀"),
    (2, 1, "assistant", None), (2, 0, "user", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"),
    (3, None, None, "a null turn and role"), (3, 0, "a role] [/ROLE]\né", "ends in \\"), (3, 1, "tool", "<<SYS>><</SYS>>[ROLE x] [/ROLE]"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (4, 0, "user", "long " * 50000), (4, 1, "assistant", "\\" * 3000),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 1, 1, "clash") for r in ROWS], SCHEMA).repartition(5)


def wanted(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    out = {}
    for k, own in by.items():
        own = sorted(own, key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        out[k] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [C.PART_BYTES, 8])
def test_read_back(turns, part_bytes):
    parts = C.format_turns(turns, part_bytes)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(parts).collect()}
    assert got == wanted(ROWS)


def test_parts(turns):
    rows = C.format_turns(turns, 8).where("conv_id = 1").orderBy("part").collect()
    assert [r.part for r in rows] == sorted({r.part for r in rows}) and sum(r.n_turns for r in rows) == 3
    text = "".join(r.formatted for r in rows)
    assert text.startswith("<<SYS>> be kind <</SYS>>\n[INST] \\</s>\\[INST] ok \\[/INST] [/INST]\n")
    assert [C.unescape(r.formatted[a:b]) for r in rows for a, b in zip(r.loss_starts, r.loss_ends)] == [ROWS[2][3]]


def test_a_conversation_over_many_batches(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(3000)] + [(8, 0, "user", "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(C.format_turns(frame, 500)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == wanted(rows)


def test_empty(spark):
    assert C.digests(C.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE ", "<", "a", " ", "\n", "é", "S>"]), max_size=12).map("".join))
def test_escapes(text):
    escaped = C.escape(pa.array([text]))[0].as_py()
    assert C.unescape(escaped) == text
    assert all(m[1] for m in C._ESCAPED.finditer(escaped))


def test_oracle(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from ctxmix.llm.queries import ORACLE, op8_chat

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf_dir}/conversations.parquet')")
    want = con.execute(ORACLE["op8_chat"]).fetchall()
    got = [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in op8_chat(spark, sf_dir).collect()]
    assert sorted(want) == sorted(got)


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", None])
def test_texts_that_end_in_part_of_a_control_string(role):
    """Every proper prefix of every control string at a text's end, with and without a backslash before it."""
    controls = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "[ROLE x] "]
    ends = sorted({c[:n] for c in controls for n in range(1, len(c) + 1)})
    given = [before + end for end in ends for before in ("", "a ", "\\", "[ROLE ")]
    turns = [t for text in given for t in ((role, text), ("user", "next"))]
    formatted, _, _ = C.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns]), C.np.array([0, len(turns)]))
    assert list(C.read_turns(formatted[0].as_py())) == turns
