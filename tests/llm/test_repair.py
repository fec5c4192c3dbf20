import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ctxmix.llm import queries, repair

SOUND = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NAMES = {"u": "user", "a": "assistant"}


def plain_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The contract as dynamic programming on whole audits: by last initial written, the least (cost, audit, lines)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    live = {"": (0, "", ())}

    def grow(live):
        out = dict(live)
        for _ in range(4):
            for last, (c, e, lines) in list(out.items()):
                for i in after[last].replace("s", ""):
                    new = (c + 3, e + "I", (*lines, NAMES[i] + ":"))
                    if i not in out or new < out[i]:
                        out[i] = new
        return out

    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        new = {}
        for last, (c, e, lines) in grow(live).items():
            options = [(last, (c + 4, e + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for i in after[last]:
                    if role[:1] == i:
                        options.append((i, (c + more, e + "K", (*lines, f"{role}:{text}"))))
                    if i != "s":
                        options.append((i, (c + more + 3, e + "R", (*lines, f"{NAMES[i]}:{text}"))))
            for last_, found in options:
                if last_ not in new or found < new[last_]:
                    new[last_] = found
        live = new
    return min(v for k, v in grow(live).items() if k in ("", "a"))


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults = plain_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = plain_repair(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    fill = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        z = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        role, text = fill(role), fill(text)
        text = "" if z == 1 else re.sub("[.!?]", "", text) if z == 2 else text
        role = "user" if z == 4 else role
        kept.extend([(turn, role, text)] * (0 if z == 0 else 2 if z == 3 else 1))
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def parse(rows):
    now = repair._Conversation(repair.Parser())
    for (turn, role, text), fault in zip(rows, plain_faults(rows)):
        now.add(turn, role, text, ["", "blank", "duplicate", "truncated"].index(fault))
    return now.result()


def test_cheapest_of_all_edits():
    """Every edit sequence of up to three turns with up to two insertions at each place."""
    gaps = ["", "I", "II"]
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c."), ("tool", "d."), ("user", "cut"), ("user", ""), ("", "e.")]
    for n in range(4):
        for chosen in itertools.product(kinds, repeat=n):
            rows = [(i, r, t) for i, (r, t) in enumerate(chosen)]
            faults = plain_faults(rows)
            best = None
            for ops in itertools.product("KRD", repeat=n):
                if any(f in ("blank", "duplicate") and o != "D" for f, o in zip(faults, ops)):
                    continue
                for places in itertools.product(gaps, repeat=n + 1):
                    audit = "".join(p + o for p, o in zip(places, ops)) + places[-1]
                    cost = 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D") + 3 * sum(f == "truncated" and o != "D" for f, o in zip(faults, ops))
                    if best is not None and (cost, audit) >= best:
                        continue
                    # the role that an inserted or rewritten turn gets is the one that is due
                    line, at = "", iter(rows)
                    for letter in audit:
                        row = next(at) if letter != "I" else None
                        if letter == "K":
                            line += row[1][:1] or "-"
                        elif letter != "D":
                            line += "a" if line.endswith("u") else "u"
                    if SOUND.match(line):
                        best = (cost, audit)
            assert parse(rows)[5:7] == best, rows


def test_long_conversations_against_whole_audits():
    import random
    rnd = random.Random(5)
    for n in (10, 60, 300):
        for _ in range(40):
            rows = [(i, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rnd.choice(["x.", "y!", "", "cut", f"{i}.", f"{i}?"])) for i in range(n)]
            assert parse(rows) == plain(rows)


def test_few_sets_of_stacks():
    import random
    rnd, parser = random.Random(6), repair.Parser()
    at = parser.start
    for _ in range(20_000):
        at = parser.steps[parser.step(at, rnd.choice("suax"), rnd.randrange(4))][0]
    assert len(parser.sets) < 500


GIVEN = [
    (1, 0, "system", "Be kind.", 1), (1, 1, "user", "Hi?", 1), (1, 2, "assistant", "Yes.", 1),
    (2, 0, "user", None, 1), (2, None, None, "no turn.", 1), (2, 7, "user", "cut", 1), (2, 7, "assistant", "tie.", 1),
    (3, None, None, None, None), (4, 0, "assistant", "starts wrong.", 1), (4, 3, "assistant", "starts wrong.", 1),
    (None, 0, "user", "who?", 1), (None, 1, "assistant", "nobody.", 1), (None, 1, "assistant", "nobody.", 1),
    (5, 0, "user", "long " * 50_000 + ".", 1), (5, 1, "assistant", "日本語 é\x1c", 1), (6, 0, "", "x.", 1), (6, 1, "ünder", " \t\n\x0b\x0c\r", 1),
    *((i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.", 1) for i in range(10, 40) for t in range(6)),
]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(GIVEN, "conv_id long, turn long, role string, text string, fault int").repartition(5)


def test_damaged_and_repaired(spark, given):
    wanted = [(c, *plain(rows)) for c, rows in plain_damage([g[:4] for g in GIVEN]).items()]
    got = repair.repair(repair.damage(given))
    assert got.columns == COLUMNS and key(got.collect()) == key(wanted)
    assert any(rows == [] for rows in plain_damage([(i, 0, "user", "x.") for i in range(100)]).values())
    alone = spark.createDataFrame([(i, 0, "user", "x.") for i in range(100)], "conv_id long, turn long, role string, text string")
    assert key(repair.repair(repair.damage(alone)).collect()) == key((c, *plain(r)) for c, r in plain_damage([tuple(r) for r in alone.collect()]).items())


def test_repaired_turns_have_the_digest(given):
    rows = repair.turns(given)
    summary = repair.repair(rows)
    made = {}
    for r in repair.repaired_turns(rows, summary).collect():
        made.setdefault(r["conv_id"], []).append(r)
    for s in summary.collect():
        lines = sorted(made.get(s["conv_id"], []), key=lambda r: r["place"])
        assert [r["place"] for r in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() == s["repaired_sha256"]
        assert SOUND.match("".join(r["role"][0] for r in lines))
        assert "".join(r["edit"] for r in lines) == s["audit"].replace("D", "")


def test_empty_table_and_one_long_conversation(spark, given):
    assert repair.repair(repair.damage(given.limit(0))).collect() == []
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t % 700}.") for t in range(30_000)]
    long = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    assert [tuple(r) for r in repair.repair(repair.turns(long)).collect()] == [(1, *plain([r[1:] for r in rows]))]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert key(queries.op13_repair(spark, sf_dir).collect()) == key((c, *plain(r)) for c, r in plain_damage(rows).items())
