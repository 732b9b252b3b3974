"""Conversation structure repair (operator 13).

Role initials of a sound conversation follow `(s?(ua)+)?`: nothing, or a system turn or none and then pairs of user and
assistant turns.  Repair keeps a row (0), gives it the role user or assistant (3), deletes it (4; blank and repeated
rows must go) or inserts an empty turn (3); a truncated row that stays adds 3.

Method: cost layers over bitsets, in the manner of Wu and Manber.  Layer c holds for each turn the set of the grammar's
four states, as bits, from which the rest can be made sound for at most c.  It follows from the layers below (an edit of
cost d looks d layers down) and, for kept rows, from itself.  The first layer that holds the start state at the first
turn gives the cost; the trace then takes, turn by turn, the least letter of D, I, K, R whose bit is set in the layer
that the letter's cost leaves, which gives the least audit.  Layers are built for SEGMENT turns at a time, from the end
on; the four least costs at a segment's edge seed the layers before it, so the work is linear in the turns.

A conversation stays together (its hash is of all its text in order), but is never held: the task reads a sorted stream
in which a conversation comes twice, first a byte a row, then its texts, which go into the hash one by one.  What a task
holds is a byte and an edit a row, as the audit it returns does.

Defined results: null roles and texts are one space; rows of one turn stand by role, then text, null turns first; a role
of another initial (an empty one too) must be changed or deleted; rows without a conversation are one conversation; an
empty table gives an empty table; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitrine.llm.common import ship

START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3  # costs: another role, deletion, insertion, a truncated row that stays
SEGMENT = 64
INITIALS = "sua"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)  # faults; a row is the number 4 * (place of its initial, or 3) + fault
DROPPED = 16
#: To the state after a turn, by its initial.
TURN_TO = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
#: From the states before a turn, by its initial.
TURN_FROM = {"s": START, "u": START | AFTER_S | AFTER_A, "a": AFTER_U}
#: By initial: for each set of states after the turn, the states before it.
BEFORE = [[TURN_FROM[i] if after & TURN_TO[i] else 0 for after in range(16)] for i in INITIALS] + [[0] * 16]
#: The same where the turn may be a user's or an assistant's.
EITHER = [BEFORE[1][after] | BEFORE[2][after] for after in range(16)]
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
SPACES = r"\x20\x09-\x0D"


def next_turn(state: int) -> int:
    """The state after an inserted or changed turn: the grammar leaves one choice."""
    return AFTER_A if state == AFTER_U else AFTER_U


def layers(rows: bytes, right: dict[int, int], enough: int) -> list[list[int]]:
    """Cost layers of a segment, until the one whose first turn holds all states of `enough`.

    right: what each state costs at the segment's right edge.
    """
    n, out = len(rows), []
    nothing = [0] * (n + 1)
    kinds = [(BEFORE[r >> 2], r & 3) for r in rows]
    while not out or out[-1][0] & enough != enough:
        c = len(out)
        down3, down4, down6 = (out[c - d] if c >= d else nothing for d in (3, 4, 6))
        layer = [0] * (n + 1)
        layer[n] = after = sum(s for s, cost in right.items() if cost <= c)
        for k in range(n - 1, -1, -1):
            keep, fault = kinds[k]
            states = EITHER[down3[k]] | down4[k + 1]
            if fault == FINE:
                states |= keep[after] | EITHER[down3[k + 1]]
            elif fault == TRUNCATED:
                states |= keep[down3[k + 1]] | EITHER[down6[k + 1]]
            layer[k] = after = states
        out.append(layer)
    return out


ALL = START | AFTER_S | AFTER_U | AFTER_A


def edges(rows: bytes) -> tuple[list[dict[int, int]], int]:
    """(what each state costs at each segment's edges, less the least of them; the whole cost from the start)."""
    edge = {START: 0, AFTER_S: INSERT * 2, AFTER_U: INSERT, AFTER_A: 0}
    found, base = [edge], 0
    for at in reversed(range(0, len(rows), SEGMENT)):
        part = layers(rows[at : at + SEGMENT], edge, ALL)
        edge = {s: next(c for c, layer in enumerate(part) if layer[0] & s) for s in edge}
        least = min(edge.values())
        edge, base = {s: c - least for s, c in edge.items()}, base + least
        found.append(edge)
    return found[::-1], base + edge[START]


def solve(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's rows."""
    edge, cost = edges(rows)
    audit: list[str] = []
    state = START
    for number, at in enumerate(range(0, len(rows) or 1, SEGMENT)):
        part, right = rows[at : at + SEGMENT], edge[min(number + 1, len(edge) - 1)]
        built = layers(part, right, state)
        left, k, last = len(built) - 1, 0, at + SEGMENT >= len(rows)
        has = lambda c, k, s: c >= 0 and built[c][k] & s  # noqa: E731, B023
        while k < len(part) or last and left:
            if k < len(part) and has(left - DELETE, k + 1, state):
                edit, k, left = "D", k + 1, left - DELETE
            elif has(left - INSERT, k, next_turn(state)):
                edit, left, state = "I", left - INSERT, next_turn(state)
            else:
                initial, fault = part[k] >> 2, part[k] & 3
                more = CUT_OFF if fault == TRUNCATED else 0
                to = TURN_TO[INITIALS[initial]] if initial < 3 and state & TURN_FROM[INITIALS[initial]] else 0
                if to and has(left - more, k + 1, to):
                    edit, k, left, state = "K", k + 1, left - more, to
                else:
                    edit, k, left, state = "R", k + 1, left - more - REROLE, next_turn(state)
            audit.append(edit)
    return cost, "".join(audit)


_solve_short = lru_cache(1 << 16)(solve)


class _Conversation:
    """One conversation of the stream: its rows' numbers and turns first, then its texts."""

    def __init__(self, conv) -> None:
        self.conv, self.rows = conv, bytearray()
        self.first = self.last = None
        self.turns = 0
        self.dead = [0, 0, 0, 0]
        self.illegal = 0
        self.state, self.at, self.solved = START, 0, False
        self.hash, self.lines = hashlib.sha256(), 0

    def number(self, row: int, turn: int | None) -> None:
        if row == DROPPED:
            return
        if turn is not None:
            self.first = turn if self.turns == 0 else self.first
            self.turns += turn != self.last or self.turns == 0
            self.last = turn
        if self.rows:
            pair = (self.rows[-1] >> 2, row >> 2)
            self.illegal += pair not in ((0, 1), (1, 2), (2, 1))
        self.rows.append(row)
        self.dead[row & 3] += 1

    def solve(self) -> None:
        rows = bytes(self.rows)
        self.cost, self.audit = (_solve_short if len(rows) <= SEGMENT else solve)(rows)
        self.solved = True

    def line(self, role: str, text: str, edit: str) -> tuple:
        self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode("utf-8", "replace"))
        self.lines += 1
        return self.conv, self.lines, role, text, edit

    def inserted(self) -> Iterator[tuple]:
        """The inserted turns before the next row, or at the end."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, next_turn(self.state)
            yield self.line(ROLE[self.state], "", "I")

    def text(self, role: str, text: str | None) -> Iterator[tuple]:
        if not self.solved:
            self.solve()
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = TURN_TO[role[0]]
            yield self.line(role, text, edit)
        elif edit == "R":
            self.state = next_turn(self.state)
            yield self.line(ROLE[self.state], text, edit)

    def end(self) -> Iterator[tuple]:
        if not self.solved:
            self.solve()
        yield from self.inserted()

    def report(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.dead[BLANK], self.dead[DUPLICATE], self.dead[TRUNCATED], self.illegal, self.cost, self.audit, self.hash.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "place long, role string, text string, edit string"
BATCH, BATCH_CHARS = 2048, 8_000_000


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[tuple]:
    """The reports of all conversations of a sorted stream, or their repaired lines."""
    now = None
    for batch in batches:
        for conv, again, row, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    made = list(now.end())
                    yield from made if lines else [now.report()]
                now = _Conversation(conv)
            if not again:
                now.number(row, turn)
            else:
                made = list(now.text(role, text))
                if lines:
                    yield from made
    if now is not None:
        made = list(now.end())
        yield from made if lines else [now.report()]


def numbered(rows: DataFrame) -> DataFrame:
    """The sorted stream: (conv, again, row, turn, role, text), each row once by number and once with its text.

    rows: conv, turn, role, text, dropped.  One shuffle: both windows and the order are within conversations.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), "dropped").repartition("conv")
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text", "dropped"))
    rows = rows.withColumn("place", place)
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text", "dropped").orderBy("place")) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACES}]"), F.lit(BLANK))
        .when(seen, F.lit(DUPLICATE))
        .when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), F.lit(TRUNCATED))
        .otherwise(F.lit(FINE))
    )
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, F.lit(k)) for k, c in enumerate(INITIALS)), F.lit(3))
    number = F.when(F.col("dropped"), F.lit(DROPPED)).otherwise(initial * 4 + fault)
    rows = rows.withColumn("fault", fault).withColumn("row", number)
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(False).alias("again"), "row", "turn", none.alias("role"), none.alias("text"))
    then = F.struct(F.lit(True).alias("again"), "row", F.lit(None).cast("long").alias("turn"), "role", F.when(F.col("fault") < BLANK, F.col("text")).alias("text"))
    both = rows.select("conv", "place", F.explode(F.when(F.col("dropped"), F.array(first)).otherwise(F.array(first, then))).alias("x"))
    return both.select("conv", "place", "x.*").sortWithinPartitions("conv", "again", "place").drop("place")


def repair(
    convs: DataFrame, lines: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped: Column | None = None
) -> DataFrame:
    """One row per conversation: id and REPORT; or, with lines, one row per repaired turn: id and LINES.

    gaps: turn numbers missing between the first and the last; blank, duplicate, truncated: rows by their first fault;
    illegal: neighbours whose initials are not su, ua or au; cost, audit: the cheapest edits, the least of them by
    their initials (Keep, Rerole, Delete, Insert); repaired_sha256: of the repaired `role:text` lines.
    dropped: rows that are gone, of which no more than the conversation's id counts.
    """
    ship(convs.sparkSession)
    rows = convs.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"),
        F.col(f"`{text_col}`").alias("text"), (F.lit(False) if dropped is None else dropped).alias("dropped"),
    )
    kind = dict(rows.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            fields = [x.split() for x in (LINES if lines else REPORT).split(", ")]
            schema = pa.schema([(conv_col, first.schema.field(0).type), *((n, pa.int64() if t == "long" else pa.string()) for n, t in fields)])

            def every():
                yield first
                yield from batches

            yield from _batched(_stream(every(), lines), schema)

    return numbered(rows).mapInArrow(run, f"`{conv_col}` {kind}, {LINES if lines else REPORT}")


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _dropped: rows damaged by the checksum of their key, as faults to be found.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(fate == 4, F.lit("user")).otherwise(one("role"))
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("_dropped"), fate.alias("_fate"))
    return rows.withColumn("_copy", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_fate", "_copy")
