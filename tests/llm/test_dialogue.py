"""Operator 13: the search against all edit sequences, and the query against a plain version over a whole table."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from lexspark.llm import dialogue
from lexspark.llm.queries import op13_dialogue_repair
from lexspark.llm.work import table

SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append(1 if not bare.lstrip(SPACE) else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Cost, audit and repaired turns by trying every sequence of edits with at most two inserts in a gap."""
    found, best = faults(rows), None
    options = []
    gap = [list(g) for n in range(3) for g in itertools.product([("I", "user", ""), ("I", "assistant", "")], repeat=n)]
    for (_, role, text), f in zip(rows, found):
        options.append([[("D", None, None)]] if f in (1, 2) else [[("D", None, None)], [("K", role, text)], [("R", "user", text)], [("R", "assistant", text)]])
    for picked in itertools.product(gap, *[x for o in options for x in (o, gap)]):
        edits = [e for part in picked for e in part]
        kept = [(r, t) for e, r, t in edits if e != "D"]
        if not GOOD.fullmatch("".join(r[:1] or "-" for r, _ in kept)):
            continue
        cost, at = 0, 0
        for e, _, _ in edits:
            cost += {"K": 0, "R": 2, "D": 3, "I": 2}[e]
            if e != "I":
                cost += e != "D" and found[at] == 3
                at += 1
        key = (cost, "".join(e for e, _, _ in edits))
        if best is None or key < best[0]:
            best = (key, kept)
    return best


def table_path(rows):
    """The same by a plain table over rows and states with whole audits, for longer conversations."""
    found = faults(rows)
    at = {"": (0, "", ())}
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    for (_, role, text), f in zip(rows, found):
        new = {}
        for last, (cost, audit, kept) in at.items():
            offers = [(last, (cost + 3, audit + "D", kept))]
            if f not in (1, 2):
                for more in range(3):
                    state, turns = last, kept
                    for _ in range(more):
                        state = following[state]
                        turns += ((full[state], ""),)
                    paid = cost + 2 * more + (f == 3)
                    if role[:1] == following[state] or (role[:1] == "s" and state == ""):
                        offers.append((role[:1], (paid, audit + "I" * more + "K", turns + ((role, text),))))
                    offers.append((following[state], (paid + 2, audit + "I" * more + "R", turns + ((full[following[state]], text),))))
            for state, offer in offers:
                if state not in new or offer[:2] < new[state][:2]:
                    new[state] = offer
        at = new
    ends = []
    for last, (cost, audit, kept) in at.items():
        more = {"": 0, "s": 2, "u": 1, "a": 0}[last]
        ends.append((cost + 2 * more, audit + "I" * more, kept + tuple([("user", ""), ("assistant", "")][2 - more :])))
    cost, audit, kept = min(ends, key=lambda x: x[:2])
    return (cost, audit), list(kept)


def whole(rows, solve):
    turns = [t for t, _, _ in rows if t is not None]
    found = faults(rows)
    (cost, audit), kept = solve(rows) if rows else ((0, ""), [])
    roles = [r[:1] for _, r, _ in rows]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, found.count(1), found.count(2), found.count(3), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, sha)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_search_against_all_edits(spark):
    draw = random.Random(5)
    data = {}
    for conv in range(60):
        rows = [(draw.choice([None, 0, 1, 2, 5, 9]), draw.choice(["user", "assistant", "system", " ", "tool", ""]), draw.choice(["A.", "B!", "cut", "", " \n", "so?  "])) for _ in range(draw.choice([0, 1, 2, 3, 3]))]
        data[conv] = order(rows)
    frame = spark.createDataFrame([(c, *r, 1) for c, rows in data.items() for r in rows], "conv_id long, turn long, role string, text string, copy int")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogue.audited(dialogue.undamaged(frame)).collect()}
    assert got == {c: whole(rows, exhaustive) for c, rows in data.items() if rows}
    assert all(whole(rows, exhaustive) == whole(rows, table_path) for rows in data.values())


def damage(rows):
    """Plain version of the contract's damage: conversation -> rows in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held.extend([(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    return {c: order(rows) for c, rows in out.items()}


def test_query_against_plain(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op13_dialogue_repair(spark, sf).collect()}
        assert got == {c: whole(rows, table_path) for c, rows in damage(rows).items()}


def test_nulls_ties_repeats_and_long(spark):
    long = "x" * 300_000 + "."
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, 1, "user", long), (7, 1, "user", long), (7, 1, "assistant", None), (8, None, "user", "a"), (8, None, "user", "b?"), (9, 0, None, "Well."), (9, 0, "user", "")]
    rows += [(10, i, ["user", "assistant", "user"][i % 3], f"Number {i}{'.' if i % 5 else ''}") for i in range(3000)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, gone string, fault string")
    found = dialogue.audited(dialogue.damaged(frame))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == {c: whole(rows, table_path) for c, rows in damage(rows).items()}
    assert dialogue.audited(dialogue.damaged(frame.limit(0))).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Yes."), (1, 1, "assistant", "No."), (1, 2, "user", "cut"), (2, 0, "user", "")]
    turns = dialogue.judged(dialogue.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    plans = dialogue.planned(turns)
    made = [tuple(r) for r in dialogue.repaired(turns, plans).orderBy("conv_id", "place").collect()]
    assert made == [(1, 0, "R", 0, "user", "Yes."), (1, 1, "K", 1, "assistant", "No.")] and {r.conv_id: r.audit for r in plans.collect()} == {1: "RKD", 2: "D"}
    assert plans.where(F.col("conv_id") == 1).first().cost == 5
