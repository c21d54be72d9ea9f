"""Conversation structure repair: the cheapest edits that make the turns alternate, found by A* on the edit lattice.

A node is a turn and what the repaired roles end with: nothing, a system turn, a user's, or an assistant's. Keep, Rerole
and Delete go on by one turn; Insert stays. Blank and repeated turns must be deleted, truncated ones that stay cost
extra. The heuristic is the sum, over the turns that are left, of the deletions that must be and the charges for truncation
that cannot be avoided (deleting costs more); it never falls by more than an edit costs, so that a node is settled when it
first leaves the queue. The queue's key is (cost + heuristic, audit), the audit being the edits' initials: of equally cheap
repairs the one of least audit comes first. An audit tells the repair, as only one role fits each state.

Turns are dealt by conversation and sorted; repeats are found by a window in the same exchange. Each task streams its rows.
A conversation is searched in segments of `SEGMENT` turns: for each state that may come before one, the best way to each
state behind it. States are dropped once another one, with the edits that put it in their place, is cheaper than them; what
the ways that are left have in common is settled, hashed or written, and forgotten. So a conversation of any length takes the
memory of a segment or two; its hash is one stream by its nature.

Defined cases: a null role or text is one space; turns come by order column (nulls first), then role and text; a null
conversation id is a conversation of its own; repeated rows are repeated turns; extra columns are not read; an empty
table gives none; a conversation without turns (all marked absent) has zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .spark import small_batches

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT = 256
SOUND, LOST, CUT = range(3)  # a turn that may stay, one that must go, one that is charged for
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: By state, the one that a user's or an assistant's turn leads to, whichever fits.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INITIAL = {USER: "u", ASSISTANT: "a"}
#: [x][y]: at most so much more does it cost to go on from x as one would from y.
_INSTEAD = {
    NOTHING: {NOTHING: 0, SYSTEM: 0, USER: INSERT, ASSISTANT: 2 * INSERT},
    SYSTEM: {NOTHING: 2 * INSERT, SYSTEM: 0, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {NOTHING: INSERT + DELETE, SYSTEM: INSERT, USER: 0, ASSISTANT: INSERT},
    ASSISTANT: {NOTHING: DELETE, SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
}
_MOST_INSTEAD = max(x for row in _INSTEAD.values() for x in row.values())
_WHITE = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}

Ways = dict[int, tuple[int, str]]


def after(state: int, initial: str) -> int | None:
    """The state that a kept turn leads to."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    return _NEXT[state] if initial == _INITIAL[_NEXT[state]] else None


def search(turns: list[tuple[str, int]], entry: int = NOTHING, last: bool = True) -> Ways:
    """The cheapest cost, and of equal ones the least audit, from a state through all turns (initial of the role, kind) to each
    state behind them; if they are the last ones, only to the better one of the states that a conversation may end with."""
    n = len(turns)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0, DELETE, TRUNCATED)[turns[i][1]]
    queue, settled, found, most = [(ahead[0], "", 0, entry)], set(), {}, None
    while queue:
        guess, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        if most is not None and guess > most:
            break
        settled.add((i, state))
        cost = guess - ahead[i]
        heapq.heappush(queue, (guess + INSERT, audit + "I", i, _NEXT[state]))
        if i == n:
            if last and state in (NOTHING, ASSISTANT):
                return {state: (cost, audit)}
            found[state] = cost, audit
            if not last and most is None:
                most = cost + _MOST_INSTEAD  # what costs more is never gone on from
            continue
        initial, kind = turns[i]
        rest = ahead[i + 1]
        heapq.heappush(queue, (cost + DELETE + rest, audit + "D", i + 1, state))
        if kind != LOST:
            charge = cost + (TRUNCATED if kind == CUT else 0) + rest
            heapq.heappush(queue, (charge + REROLE, audit + "R", i + 1, _NEXT[state]))
            if (kept := after(state, initial)) is not None:
                heapq.heappush(queue, (charge, audit + "K", i + 1, kept))
    return found


class Repair:
    """One conversation, turn by turn; write(turn, edit, role, text) gets its edits in order, deleted turns with their own role
    and text, inserted ones without a turn."""

    def __init__(self, write: Callable[[object, str, str, str], None]):
        self.write, self.held, self.fresh = write, deque(), []
        self.ways: Ways = {NOTHING: (0, "")}  # by state, cost so far and the audit since what is settled
        self.state, self.audit = NOTHING, []

    def add(self, turn: object, role: str, text: str, kind: int) -> None:
        self.held.append((turn, role, text))
        self.fresh.append((role[:1], kind))
        if len(self.fresh) == SEGMENT:
            self._go_on(last=False)
            common = commonprefix([audit for _, audit in self.ways.values()])
            self._settle(common)
            self.ways = {s: (cost, audit[len(common) :]) for s, (cost, audit) in self.ways.items()}

    def _go_on(self, last: bool) -> None:
        ways: Ways = {}
        for entry, (cost, audit) in self.ways.items():
            for state, (more, edits) in search(self.fresh, entry, last).items():
                ways[state] = min(ways.get(state, (cost + more, audit + edits)), (cost + more, audit + edits))
        if not last:
            ways = {y: way for y, way in ways.items() if all(way[0] <= cost + _INSTEAD[x][y] for x, (cost, _) in ways.items())}
        self.ways, self.fresh = ways, []

    def _settle(self, edits: str) -> None:
        for edit in edits:
            if edit == "I":
                self.state = _NEXT[self.state]
                self.write(None, edit, _ROLES[self.state], "")
                continue
            turn, role, text = self.held.popleft()
            if edit == "R":
                self.state = _NEXT[self.state]
                role = _ROLES[self.state]
            elif edit == "K":
                self.state = after(self.state, role[:1])
            self.write(turn, edit, role, text)
        self.audit.append(edits)

    def end(self) -> tuple[int, str]:
        """The cost and the audit."""
        self._go_on(last=True)
        cost, edits = min(self.ways.values())
        self._settle(edits)
        return cost, "".join(self.audit)


class _Report:
    """What the report says of a conversation, whose turns come in order."""

    def __init__(self):
        self.counts, self.illegal, self.before = [0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.distinct, self.hash, self.any = 0, hashlib.sha256(), False
        self.repair = Repair(self._written)

    def _written(self, turn: object, edit: str, role: str, text: str) -> None:
        if edit != "D":
            self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
            self.any = True

    def add(self, turn: int | None, role: str, text: str, kind: int, fault: int | None) -> None:
        if fault is not None:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.distinct += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.repair.add(turn, role, text, kind)

    def row(self) -> tuple:
        cost, audit = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.counts, self.illegal, cost, audit, self.hash.hexdigest()


def _judged(text: str, again: bool) -> tuple[int, int | None]:
    """The kind of a turn, and its first fault: 0 blank, 1 repeated, 2 truncated."""
    said = text.rstrip(_WHITE)
    if not said:
        return LOST, 0
    if again:
        return LOST, 1
    return (SOUND, None) if said[-1] in ".!?" else (CUT, 2)


def _sorted_turns(turns: DataFrame, id_col: str, order_col: str, role_col: str, text_col: str, absent: str | None) -> DataFrame:
    """(id, turn, role, text, absent, again), a conversation's rows in one task and in order."""
    gone = F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)
    said = lambda c: F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = turns.select(F.col(id_col).alias("id"), F.col(order_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), gone.alias("absent"))
    placed = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    again = F.row_number().over(Window.partitionBy("id", "role", "text").orderBy("turn")) > 1
    return placed.withColumn("again", again).sortWithinPartitions("id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable[[object], object]) -> Iterator[object]:
    """For each conversation start(id), given its turns, once it is over; also None for each batch that ends."""
    current, none = None, object()
    known = none
    for batch in batches:
        for key, turn, role, text, absent, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if known is none or key != known:
                if current is not None:
                    yield current
                known, current = key, start(key)
            if not absent:
                current.add(turn, role, text, *_judged(text, again))
        yield None
    if current is not None:
        yield current


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(turns: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: str | None = None) -> DataFrame:
    """A row per conversation: its id, gaps in its order, turns by first fault (blank, duplicate, truncated), illegal successions,
    the repair's cost and audit, and the SHA-256 of the repaired turns (role:text, newline-joined). Rows whose column
    `absent` is true are no turns, but their conversations are reported."""
    schema = StructType([StructField(id_col, turns.schema[id_col].dataType), *StructType.fromDDL(_REPORT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=kinds)

        rows, kinds = [], None

        def start(key: object) -> _Report:
            made = _Report()
            made.key = key
            return made

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in source:
                kinds = kinds or pa.schema([(id_col, batch.schema.field(0).type), *((c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in schema.names[1:])])
                yield batch

        for done in _conversations(typed(batches), start):
            if done is not None:
                rows.append((done.key, *done.row()))
            elif rows:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return _sorted_turns(turns, id_col, order_col, role_col, text_col, absent).mapInArrow(run, schema)


def repaired(turns: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edited turns: (id, place from 0, turn as before or null if inserted, edit K/R/D/I, role, text). Without its D rows a
    conversation is repaired."""
    schema = StructType([StructField(id_col, turns.schema[id_col].dataType), *StructType.fromDDL("place long, turn long, edit string, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        class Edits:
            def __init__(self, key: object):
                self.key, self.place, self.repair = key, 0, Repair(self._written)

            def _written(self, turn: object, edit: str, role: str, text: str) -> None:
                out.append((self.key, self.place, turn, edit, role, text))
                self.place += 1

            def add(self, turn: object, role: str, text: str, kind: int, fault: int | None) -> None:
                self.repair.add(turn, role, text, kind)

        kinds = None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in source:
                kinds = kinds or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield batch

        for done in _conversations(typed(batches), Edits):
            if done is not None:
                done.repair.end()
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return _sorted_turns(turns, id_col, order_col, role_col, text_col, None).mapInArrow(run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with turns dropped (then absent is true), emptied, cut short, repeated and given
    to the user, by the CRC-32 of their place."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(place) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1)))
    return turns.select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), (hit == 0).alias("absent"), times.alias("copy")).drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damaged(turns), absent="absent")
