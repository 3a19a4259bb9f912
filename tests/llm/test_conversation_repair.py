import hashlib
import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veripaper.llm import conversation_repair as R

TURNS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("ktf")), max_size=7)


def least_repair(rows):
    """(cost, audit) by trying every edit in every state; rows are (initial, k: good, t: truncated, f: must go)."""

    @lru_cache(None)
    def go(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            initial, kind = rows[i]
            ways.append((2, "D", i + 1, state, 0))
            if kind != "f":
                more = 5 * (kind == "t")
                user = state != "u"
                if initial == ("u" if user else "a") or (initial == "s" and state == ""):
                    ways.append((more, "K", i + 1, initial, 0))
                if initial != ("u" if user else "a"):
                    ways.append((1 + more, "R", i + 1, "u" if user else "a", 0))
        if inserted < 3:
            ways.append((5, "I", i, "a" if state == "u" else "u", inserted + 1))
        out = []
        for way in ways:
            if len(way) == 2:
                out.append(way)
            else:
                cost, audit = go(*way[2:])
                out.append((cost + way[0], way[1] + audit))
        return min(out, default=(float("inf"), ""))

    return go(0, "", 0)


def coded(rows):
    live, forced = [], [0]
    for initial, kind in rows:
        if kind == "f":
            forced[-1] += 1
        else:
            live.append((initial, kind == "t"))
            forced.append(0)
    return tuple(live), tuple(forced)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_least_audit(rows):
    assert R.whole_repair(*coded(rows)) == least_repair(tuple(rows))


@settings(max_examples=200, deadline=None)
@given(TURNS, st.lists(st.integers(0, 7), max_size=3))
def test_blocks_put_together(rows, cuts):
    cuts = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    blocks = []
    for a, b in zip(cuts, cuts[1:]):
        ways = [dict(zip(("before", "behind", "cost", "audit"), w)) for w in R.block_repairs(*coded(rows[a:b]))]
        blocks.append({"conv_id": 1, "rows": 0, "ways": ways})
    found = next(R._join_blocks(iter(blocks)))
    assert (found["cost"], found["audit"]) == least_repair(tuple(rows))


def repaired_by_hand(rows):
    """rows: (turn, role, text) of one conversation."""
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        kinds.append("f" if not solid or (role, text) in seen else "t" if solid[-1] not in ".!?" else "k")
        seen.add((role, text))
    cost, audit = least_repair(tuple((r[1][:1] or "?", k) for r, k in zip(rows, kinds)))
    out, i, last = [], 0, ""
    for edit in audit:
        if edit in "IR":
            last = "a" if last == "u" else "u"
            out.append(f"{R.ROLES[last]}:{'' if edit == 'I' else rows[i][2]}")
        elif edit == "K":
            last = rows[i][1][:1]
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        i += edit != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    blank = sum(not r[2].strip(" \t\n\v\f\r") for r in rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, kinds.count("f") - blank, kinds.count("t"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


ROLES = ["user", "assistant", "system", "tool", "", None]
TEXTS = ["Yes.", "No!", "cut off", "", None, " \n", "Why? \t", "é", "two\nlines."]


def check(spark, rows, partitions=None):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "1 as n", "'x' as audit", "2 as block", "'y' as key")
    if partitions:
        frame = frame.repartition(partitions)
    by_hand = {}
    for conv, *row in rows:
        by_hand.setdefault(conv, []).append(tuple(row))
    found = {r[0]: tuple(r[1:]) for r in R.repair_conversations(frame).collect()}
    assert set(found) == set(by_hand)
    for conv, mine in by_hand.items():
        assert found[conv] == repaired_by_hand(mine), conv
    return frame, found


def test_odd_conversations(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(260)
    ]
    check(spark, rows, 5)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(ROLES[:3]), f"{rng.choice(TEXTS)}{t % 50}.") for c, n in ((1, 3), (2, 300), (3, 4)) for t in range(n)]
    rows += [(2, 7, "user", "again.")] * 90 + [(2, t, "user", "the same.") for t in range(0, 300, 3)]
    frame, found = check(spark, rows)
    turns = R.repair_conversations(frame, as_turns=True).orderBy("position").collect()
    for conv, row in found.items():
        lines = [f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row[-1]


def test_long_text_and_empty_table(spark):
    check(spark, [(1, 0, "user", "a" * 6_000_000 + "."), (1, 1, "assistant", "b" * 5_000_000), (1, 2, "user", "c.")])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair_conversations(empty).count() == 0


def test_dropped_rows_keep_their_conversation(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a.", 0), (2, 0, "user", "b.", 2)], "conv_id long, turn long, role string, text string, times long")
    rows = {r["conv_id"]: r for r in R.repair_conversations(frame, times="times").collect()}
    assert rows[1]["audit"] == "" and rows[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[2]["audit"] == "DD" and rows[2]["duplicate"] == 1 and rows[2]["cost"] == 4


@pytest.mark.parametrize("conv, turn", [(None, None), (3, 7), (12, 0)])
def test_damage(spark, conv, turn):
    import zlib

    frame = spark.createDataFrame([(conv, turn, None, "Oh. Ah!")], "conv_id long, turn long, role string, text string")
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    row = R.damaged(frame).withColumn("text", F.col("text")).collect()[0]
    assert row["times"] == {0: 0, 3: 2}.get(kind, 1) and row["role"] == ("user" if kind == 4 else " ")
    assert row["text"] == {0: "", 1: "", 2: "Oh Ah"}.get(kind, "Oh. Ah!")
