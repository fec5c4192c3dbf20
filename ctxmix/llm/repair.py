"""Repair of conversation structure by generalised LR parsing with weighted edits.

A sound conversation has the role initials ``(s?(ua)+)?``: an optional system turn, then pairs of a user
and an assistant turn, or nothing. The LR automaton of that grammar reads a conversation's turns
while edits compete: keep a turn, give it the role that is due, delete it, insert an empty
one. The live stacks form a graph-structured stack: after each turn those with equal tops merge, and the
least (cost, audit) survives. (Stacks with equal tops differ here only in whether a
system turn lies at their bottom, which no later turn can tell, so the survivor stands for both.)

Stacks are compared without their audits: two stacks have read the same turns, so of two
audits of equal cost none is the beginning of the other, and their order is that of the stacks they
came from, then of the letters of the last turn. Costs count from the cheapest stack, and a stack more than
``_SLACK`` above it can never win, so there are few different sets of live stacks; each turn is
a step in a table of such sets that fills as sets are met.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxmix.session import ship_code

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the cheapest stack can do instead of what any other does, at most: delete a system turn, insert a pair.
_SLACK = DELETE + 2 * INSERT

# LR automaton of C -> nothing | P | s P; P -> u a | P u a. Reductions follow a shift at once.
_SHIFT = {0: {"s": 1, "u": 3}, 1: {"u": 3}, 2: {"u": 5}, 3: {"a": 6}, 4: {"u": 5}, 5: {"a": 7}}
_REDUCE = {6: 2, 7: 3}       # symbols of the production that ends here, all to a P
_GOTO = {0: 2, 1: 4}         # where a P leads
_ACCEPT = {0, 2, 4}
_ROLES = {"u": "user", "a": "assistant"}

#: Why a turn is faulty: it has no text, it was there before, or its text ends without a mark.
SOUND, BLANK, DUPLICATE, CUT = range(4)
_SPACE = "' \t\n\x0b\x0c\r'"


class Move(NamedTuple):
    parent: int   # place of the stack it came from
    edits: str    # letters for this turn, insertions before it first
    roles: str    # initials of the inserted turns and of the turn itself (none if it is deleted)


def _shifted(stack: tuple[int, ...], initial: str) -> tuple[int, ...] | None:
    to = _SHIFT.get(stack[-1], {}).get(initial)
    if to is None:
        return None
    stack = (*stack, to)
    if to in _REDUCE:
        stack = stack[:-_REDUCE[to]]
        stack = (*stack, _GOTO[stack[-1]]) if stack[-1] in _GOTO else stack
    return stack


def _due(stack: tuple[int, ...]) -> str:
    """The role that may be inserted or given here."""
    return next(i for i in _SHIFT[stack[-1]] if i in _ROLES)


class Parser:
    """Live stacks of conversations, as numbered sets; a step leads from a set and a kind of turn to the next set."""

    def __init__(self) -> None:
        self.sets: list[tuple] = []              # ((stack, cost above the cheapest), ...) by audit
        self.steps: list[tuple] = []             # (set, cost added, one Move for each stack of the set)
        self._number: dict[tuple, int] = {}
        self._step: dict[tuple, int] = {}
        self.start = self._named((((0,), 0),))

    def _named(self, live: tuple) -> int:
        if live not in self._number:
            self._number[live] = len(self.sets)
            self.sets.append(live)
        return self._number[live]

    def _inserted(self, live: tuple) -> list[tuple]:
        """Stacks with up to two insertions: (cost, parent, letters, roles, stack)."""
        out = []
        for parent, (stack, cost) in enumerate(live):
            letters = roles = ""
            for _ in range(3):
                out.append((cost, parent, letters, roles, stack))
                due = _due(stack)
                stack, cost, letters, roles = _shifted(stack, due), cost + INSERT, letters + "I", roles + due
        return out

    def step(self, at: int, initial: str, fault: int) -> int:
        """Number of the step that a turn takes from set ``at``."""
        kind = (at, initial if initial in ("s", "u", "a") else "", fault)
        if kind in self._step:
            return self._step[kind]
        found = []
        for cost, parent, letters, roles, stack in self._inserted(self.sets[at]):
            found.append((cost + DELETE, parent, letters + "D", roles, stack))
            if fault in (BLANK, DUPLICATE):
                continue
            more = cost + (TRUNCATED if fault == CUT else 0)
            kept = _shifted(stack, initial)
            if kept:
                found.append((more, parent, letters + "K", roles + initial, kept))
            due = _due(stack)
            found.append((more + REROLE, parent, letters + "R", roles + due, _shifted(stack, due)))
        best: dict[int, tuple] = {}
        for f in found:  # equal stack tops merge
            top = f[4][-1]
            if top not in best or f[:3] < best[top][:3]:
                best[top] = f
        least = min(f[0] for f in best.values())
        live = sorted((f for f in best.values() if f[0] <= least + _SLACK), key=lambda f: f[1:3])
        self._step[kind] = len(self.steps)
        self.steps.append((self._named(tuple((f[4], f[0] - least) for f in live)), least, [Move(f[1], f[2], f[3]) for f in live]))
        return self._step[kind]

    def end(self, at: int) -> tuple[int, Move]:
        """Cost above the cheapest stack, and the last insertions, of the best sound conversation."""
        cost, parent, letters, roles, _ = min(f for f in self._inserted(self.sets[at]) if f[4][-1] in _ACCEPT)
        return cost, Move(parent, letters, roles)

    def audit(self, taken: array, last: Move) -> str:
        """Letters of all edits, from the steps taken and the move at the end."""
        letters, place = [last.edits], last.parent
        for s in reversed(taken):
            move = self.steps[s][2][place]
            letters.append(move.edits)
            place = move.parent
        return "".join(reversed(letters))


def _written(digest, lines: bool, role: str, text: str) -> None:
    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())


class _Conversation:
    """One conversation as its turns come: counts, live stacks, and a digest of what each has made of it."""

    def __init__(self, parser: Parser) -> None:
        self.parser, self.at, self.cost, self.taken = parser, parser.start, 0, array("L")
        self.digests = [(hashlib.sha256(), False)]  # and whether anything is written yet
        self.faults = [0, 0, 0, 0]
        self.turns = self.illegal = 0
        self.low = self.high = self.before = None

    def _follow(self, move: Move, role: str, text: str) -> tuple:
        digest, lines = self.digests[move.parent]
        digest = digest.copy()
        own = "" if move.edits[-1:] in ("D", "I", "") else move.edits[-1]
        for k, r in enumerate(move.roles):
            itself = own and k == len(move.roles) - 1
            _written(digest, lines, role if itself and own == "K" else _ROLES[r], text if itself else "")
            lines = True
        return digest, lines

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.faults[fault] += 1
        if turn is not None and turn != self.high:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        s = self.parser.step(self.at, initial, fault)
        self.taken.append(s)
        self.at, more, moves = self.parser.steps[s]
        self.cost += more
        self.digests = [self._follow(m, role, text) for m in moves]

    def result(self) -> tuple:
        more, last = self.parser.end(self.at)
        digest, _ = self._follow(last, "", "")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[1:], self.illegal, self.cost + more, self.parser.audit(self.taken, last), digest.hexdigest())


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
_ORDER = ("conv_id", "turn", "role", "text", "nth")


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text alone, nulls in role and text as one space, ``gone`` false."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _filled("role").alias("role"),
                                _filled("text").alias("text"), F.lit(False).alias("gone"))


def damage(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of ``conv_id:turn`` (a null: one space) modulo 20; dropped ones stay as ``gone``."""
    z = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    given = turns(conversations).withColumn("z", z)
    text = F.when(F.col("z") == 1, "").when(F.col("z") == 2, F.translate("text", ".!?", "")).when(F.col("z") > 0, F.col("text")).otherwise("")
    return (given.withColumn("copy", F.explode(F.when(F.col("z") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("z") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("z") == 0).alias("gone")))


def faults(given: DataFrame) -> DataFrame:
    """Adds ``nth`` (which of its equals a turn is) and ``fault``. Equals are found by a window on the digest of a
    turn, not in the task that reads its conversation."""
    from pyspark.sql import Window
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("turn")
    end = F.expr(f"trim(TRAILING {_SPACE} FROM text)")
    fault = (F.when(end == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND))
    return given.withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list]:
    """Rows of a task one by one, as lists of values, whatever the batches."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def repair(given: DataFrame) -> DataFrame:
    """A row for each conv_id of ``given`` (from :func:`turns` or :func:`damage`), rows ``gone`` left out of all counts.

    ``gaps``, turns by first fault, ``illegal`` neighbours, and the cheapest edits: ``cost``, ``audit`` (their initials
    in order, of equal costs the ASCII-least) and the SHA-256 of the repaired ``role:text`` lines. Turns go by turn
    (nulls first), ties by role and text; repeated rows stay. Rows without a conv_id form a conversation
    of their own. A conversation without rows has zeros, an empty audit and the digest of nothing.
    An empty table gives none. Other columns are not read.

    Conversations are shuffled to tasks and read there turn by turn: a task holds a few digests and two to eight bytes
    a turn, however long a conversation or its texts are. One conversation is one task's work, as a digest is sequential.
    """
    ship_code(given.sparkSession)
    columns = ["conv_id", "turn", "role", "text", "gone", "fault"]
    rows = faults(given).repartition("conv_id").sortWithinPartitions(*_ORDER).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, done, open_id, now = Parser(), [], None, None

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=RESULT.replace(",", "").split()[::2])
            done.clear()
            return out

        for conv, turn, role, text, gone, fault in _stream(batches, columns):
            if now is None or conv != open_id:
                if now is not None:
                    done.append((open_id, *now.result()))
                open_id, now = conv, _Conversation(parser)
                if len(done) >= 1000:
                    yield batch()
            if not gone:
                now.add(turn, role, text, fault)
        if now is not None:
            done.append((open_id, *now.result()))
            yield batch()

    return rows.mapInArrow(run, RESULT)


def repaired_turns(given: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text and the edit that made the turn (K, R or I).

    ``repaired`` is :func:`repair` of ``given``. An audit travels once, ahead of its conversation's turns.
    """
    ship_code(given.sparkSession)
    columns = ["conv_id", "audit", "role", "text"]
    whole = (faults(given).where("not gone").withColumn("audit", F.lit(None).cast("string"))
             .unionByName(repaired.select("conv_id", "audit"), allowMissingColumns=True))
    rows = (whole.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:]).select(*columns))
    schema = "conv_id long, place long, role string, text string, edit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, made, stack, place = "", 0, [], (0,), 0
        conv = None

        def write(role: str, text: str, edit: str) -> None:
            nonlocal stack, place
            made.append((conv, place, role, text, edit))
            stack, place = _shifted(stack, role[0]), place + 1

        def insertions() -> None:
            nonlocal at
            while audit[at:at + 1] == "I":
                write(_ROLES[_due(stack)], "", "I")
                at += 1

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["conv_id", "place", "role", "text", "edit"])
            made.clear()
            return out

        for own, edits, role, text in _stream(batches, columns):
            if edits is not None:  # a new conversation
                conv, audit, at, stack, place = own, edits, 0, (0,), 0
                insertions()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                write(role if edit == "K" else _ROLES[_due(stack)], text, edit)
            insertions()
            if len(made) >= 1000:
                yield batch()
        if made:
            yield batch()

    return rows.mapInArrow(run, schema)
