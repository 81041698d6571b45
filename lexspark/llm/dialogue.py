"""Repair of a conversation's structure: the cheapest edits that make its roles alternate.

A conversation's turns are kept, given another role or deleted, and empty turns are inserted, so that the initials of
its roles read ``(s?(ua)+)?``.  The search runs over the turns that stay (kept or reroled): between two of them all
turns are deleted, and the pair of their roles tells what must be inserted.  The least cost up to a retained turn,
less the deletions up to there, is a running minimum for each role, so each turn costs a constant number of steps.
Two audits (the edits' initials in order) up to one turn never begin with each other, as both end in that turn's
letter; so their order is settled turn by turn, and a rank for each role is enough to break ties by ASCII order.

Cases: a null role or text is one space; a null turn comes first and counts in no gap; a null conv_id is a
conversation of its own; turns of one number are taken by role, then text; rows that repeat are repeats; a role
without an initial of s, u or a can be reroled or deleted only; a conversation without rows left has zeros, an empty
audit and no repaired turns; a very long conversation streams through its task, which holds four bytes for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import memory_returned

SPACE = " \t\n\x0b\x0c\r"
#: What a turn's fault is called, by number; a turn that is gone has only left its conversation's name.
FAULTS = ("", "blank", "duplicate", "truncated", "gone")
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing retained yet, or the role of the turn retained last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What must follow each state, if not a system's turn at the start.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Turns inserted between a state and the next retained role, and after the last one.
BETWEEN = {(a, b): int(NEXT[a] != b) for a in NEXT for b in (USER, ASSISTANT)} | {(START, SYSTEM): 0}
AT_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = {"su", "ua", "au"}
LETTERS = ["D", "K", "R", "IK", "IR"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, copy: turns dropped, emptied, cut, repeated or reroled by crc32(conv_id:turn) mod 20."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), F.explode(copies).alias("copy"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns of rows that are taken as they are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def _place() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("copy").asc()]


def judged(turns: DataFrame) -> DataFrame:
    """The turns with ``fault`` (a place in FAULTS), dealt by conversation: the first fault that a turn has."""
    bare = F.rtrim("text", F.lit(SPACE))
    # dealing by conv_id serves this window and the order of turns alike: one shuffle
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    fault = F.when(F.col("gone"), 4).when(bare == "", 1).when(F.col("seen") > 1, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return turns.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault).drop("seen", "gone")


class Search:
    """The search over one conversation's turns, in order: costs, ranks of audits, and how each state was reached."""

    def __init__(self):
        #: Least cost of each state less ``deleted``, the price of deleting every turn so far: deleting one changes none of them.
        self.least, self.deleted = {START: 0}, 0
        self.rank, self.steps = {START: 0}, bytearray()
        self.count, self.illegal, self.distinct = [0] * 4, 0, 0
        self.before = self.low = self.high = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        self.count[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        best: dict[int, tuple[int, int, str, int]] = {}

        def offer(state, cost, last, letters):
            found = (cost, self.rank[last], LETTERS[letters], last)
            if state not in best or found < best[state]:
                best[state] = found

        for last, least in self.least.items():
            offer(last, least, last, 0)
            if fault in (1, 2):
                continue
            for state in (SYSTEM, USER, ASSISTANT):
                keep = STATE.get(initial) == state
                if (last, state) in BETWEEN and (keep or state != SYSTEM):
                    some = BETWEEN[last, state]
                    offer(state, least - DELETE + INSERT * some + (0 if keep else RETAG) + (CUT if fault == 3 else 0), last, (1 if keep else 2) + 2 * some)
        order = sorted((v[1:3], k) for k, v in best.items())
        self.least, self.rank = {k: v[0] for k, v in best.items()}, {k: i for i, (_, k) in enumerate(order)}
        self.deleted += DELETE
        row = bytearray(4)
        for k, v in best.items():
            row[k] = v[3] << 4 | LETTERS.index(v[2])
        self.steps += row

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        cost, _, state = min((c + self.deleted + INSERT * AT_END[k], self.rank[k], k) for k, c in self.least.items())
        audit = ["I" * AT_END[state]]
        for at in range(len(self.steps) - 4, -1, -4):
            step = self.steps[at + state]
            audit.append(LETTERS[step & 15])
            state = step >> 4
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.count[1:], self.illegal, cost, "".join(reversed(audit))


PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PLAN_ARROW = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def planned(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (:func:`judged`): counts of faults, cost and audit of its cheapest repair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, search, done = None, None, []

        def flushed():
            out = pa.RecordBatch.from_pylist([dict(zip(PLAN_ARROW.names, r)) for r in done], schema=PLAN_ARROW)
            done.clear()
            return out

        for batch in batches:
            for c, turn, role, fault in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "fault")]):
                if search is None or c != conv:
                    if search is not None:
                        done.append((conv, *search.result()))
                    conv, search = c, Search()
                if fault != 4:
                    search.add(turn, role, fault)
            if done:
                yield flushed()
        if search is not None:
            done.append((conv, *search.result()))
            yield flushed()
        memory_returned()

    ordered = turns.sortWithinPartitions("conv_id", *_place())
    return ordered.select("conv_id", "turn", "role", "fault").mapInArrow(run, PLAN)


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, turn, role, text of the turns of every repaired conversation; D rows are left out.

    A conversation's rows stand together in one partition and in their order.  Its plan comes before its turns, so
    that the edits are applied as the turns stream by.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = plans.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("copy"), F.lit(0).alias("fault"), "audit")
    rows = turns.where("fault < 4").select("conv_id", "turn", "role", "text", "copy", "fault", none("string").alias("audit")).unionByName(heads)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_place())
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        audit, at, state, place = "", 0, START, 0
        for batch in batches:
            out = []

            def inserted(conv):
                nonlocal at, state, place
                state = NEXT[state]
                out.append((conv, place, "I", None, ROLE[state], ""))
                at, place = at + 1, place + 1

            for conv, turn, role, text, plan in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "audit")]):
                if plan is not None:
                    audit, at, state, place = plan, 0, START, 0
                    continue
                while audit[at] == "I":
                    inserted(conv)
                if audit[at] != "D":
                    state = STATE[role[:1]] if audit[at] == "K" else NEXT[state]
                    out.append((conv, place, audit[at], turn, role if audit[at] == "K" else ROLE[state], text))
                    place += 1
                at += 1
                if len(audit) - at <= 2 and not audit[at:].strip("I"):  # after the last turn
                    while at < len(audit):
                        inserted(conv)
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
        memory_returned()

    return ordered.select("conv_id", "turn", "role", "text", "audit").mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of ``role:text`` joined by line feeds, of what :func:`repaired` returns, as it streams by."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, sha = None, None
        for batch in batches:
            out = []
            for c, place, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text")]):
                if place == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                sha.update((("\n" if place else "") + role + ":" + text).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t.type) for i, t in enumerate(schema)], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], schema=schema)

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def audited(turns: DataFrame) -> DataFrame:
    """The plan of each conversation and the digest of what it makes of it; ``turns`` as :func:`damaged` or :func:`undamaged` give them."""
    found = judged(turns)
    plans = planned(found)
    made = digests(repaired(found, plans)).withColumnRenamed("conv_id", "of")
    joined = plans.join(made, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
