"""Repair of the structure of conversations by aligning their turns to an alternating grammar.

The turns of a conversation are aligned to every feasible length of the string ``(s?(ua)+)?`` of role
initials by Wagner-Fischer tables, cut to the band that Ukkonen's bound leaves below the cheapest cost
found so far; equal costs are told apart by their backtraced audits. Turns are sorted across the cluster
by (conversation, turn); a task repairs the conversations that lie inside its range. A conversation that
is cut by a range or has more than ``BLOCK`` turns is aligned block by block, from every state of the
grammar in which a block may begin; the blocks' results are then put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veripaper.functions.scale import salted_join

from .shared import written

#: Costs of the edits; an undeleted truncated turn costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns and bytes of text that a task holds of one conversation.
BLOCK, BLOCK_BYTES = 64, 1 << 22
#: White space that makes a text blank, and ends of sentences.
SPACE, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}

#: States of the grammar: nothing written, only a system turn, a user turn last, an assistant turn last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
Found = tuple[int, str]


def _target(first: str, length: int) -> str:
    """The grammar's string of ``length`` initials that begins with ``first``."""
    return {"u": "ua" * length, "a": "au" * length, "s": "s" + "ua" * length}[first][:length]


def aligned(live: tuple, forced: tuple, target: str, most: float) -> Found | None:
    """Cost and least audit of turning the turns into ``target``, None where that costs more than ``most``.

    ``live`` has (initial, truncated) of the turns that may stay; ``forced[i]`` turns that must go stand
    before the i-th of them. Cost counts only what happens to live turns.
    """
    n, m = len(live), len(target)

    def least(shift: int) -> int:
        return INSERT * max(0, shift) + DELETE * max(0, -shift)

    band = [d for d in range(-n, m + 1) if least(d) + least(m - n - d) <= most]
    if not band:
        return None
    low, high, never = band[0], band[-1], float("inf")
    ways = [[(never, "")] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = (0, "") if (i, j) == (n, m) else (never, "")
            if i < n:
                best = min(best, (ways[i + 1][j][0] + DELETE, "D"))
            if j < m and target[j] != "s":
                best = min(best, (ways[i][j + 1][0] + INSERT, "I"))
            if i < n and j < m:
                initial, truncated = live[i]
                after = ways[i + 1][j + 1][0] + TRUNCATED * truncated
                if initial == target[j]:
                    best = min(best, (after, "K"))
                elif target[j] != "s":
                    best = min(best, (after + REROLE, "R"))
            ways[i][j] = best
    if ways[0][0][0] > most or ways[0][0][0] == never:
        return None
    audit, i, j = ["D" * forced[0]], 0, 0
    while (i, j) != (n, m):
        edit = ways[i][j][1]
        audit.append(edit)
        j += edit != "D"
        if edit != "I":
            i += 1
            audit.append("D" * forced[i])
    return ways[0][0][0], "".join(audit)


def cheapest(live: tuple, forced: tuple, first: str, least: int, only: bool = False) -> Found | None:
    """The cheapest alignment, of equal ones that of the least audit, over lengths ``least, least + 2, ...``.

    Lengths near the number of turns come first; their cost narrows the bands of the others.
    """
    if first == "s" and all(initial != "s" for initial, _ in live):
        return None
    n, best, most = len(live), None, float("inf")
    lengths = [least] if only else range(least, max(n, least) + 1, 2)
    longer = () if only else count(lengths[-1] + 2, 2)
    for some in (reversed(lengths), longer):
        for length in some:
            if INSERT * (length - n) > most or DELETE * (n - length) > most:
                break
            found = aligned(live, forced, _target(first, length), most)
            if found is not None and (best is None or found < best):
                best, most = found, found[0]
    return best


@lru_cache(maxsize=1 << 15)
def whole_repair(live: tuple, forced: tuple) -> Found:
    """The cheapest repair of a whole conversation."""
    nothing = (DELETE * len(live), "D" * (len(live) + sum(forced)))
    found = [nothing, cheapest(live, forced, "u", 2), cheapest(live, forced, "s", 3)]
    cost, audit = min(f for f in found if f is not None)
    return cost + DELETE * sum(forced), audit


@lru_cache(maxsize=1 << 12)
def block_repairs(live: tuple, forced: tuple) -> list[tuple[int, int, int, str]]:
    """(state before, state behind, cost, audit) of the cheapest way through a block for each pair of states."""
    gone = DELETE * sum(forced)
    nothing = (DELETE * len(live), "D" * (len(live) + sum(forced)))
    ways: dict[tuple[int, int], Found] = {(state, state): nothing for state in range(4)}
    user, both = (cheapest(live, forced, "u", k) for k in (1, 2))
    answer, turned = (cheapest(live, forced, "a", k) for k in (1, 2))
    begun, asked, answered = (cheapest(live, forced, "s", k, k == 1) for k in (1, 2, 3))
    found = [(s, b, f) for s in (EMPTY, SYSTEM, ASSISTANT) for b, f in ((USER, user), (ASSISTANT, both))]
    found += [(USER, ASSISTANT, answer), (USER, USER, turned)]
    found += [(EMPTY, SYSTEM, begun), (EMPTY, USER, asked), (EMPTY, ASSISTANT, answered)]
    for before, behind, way in found:
        if way is not None:
            ways[before, behind] = min(way, ways.get((before, behind), way))
    return [(before, behind, cost + gone, audit) for (before, behind), (cost, audit) in ways.items()]


class Turns:
    """What a run of turns of one conversation is made of; ``add`` takes them in order."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.least = self.greatest = None
        self.live: list[tuple[str, bool]] = []
        self.forced = [0]

    def add(self, turn: int | None, role: str, text: str, times: int, seen: bool) -> None:
        """``times`` equal rows, of which the first is no duplicate unless ``seen``."""
        if times == 0:
            return
        initial = role[:1] or "?"
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.illegal += times - 1
        self.last = initial
        self.rows += times
        if turn is not None and turn != self.greatest:
            self.distinct += 1
            self.greatest = turn
            self.least = turn if self.least is None else self.least
        solid = text.rstrip(SPACE)
        if not solid:
            self.blank += times
            self.forced[-1] += times
        elif seen:
            self.duplicate += times
            self.forced[-1] += times
        else:
            cut = solid[-1] not in ENDS
            self.truncated += cut
            self.duplicate += times - 1
            self.live.append((initial, cut))
            self.forced.append(times - 1)

    def follow(self, other: dict) -> None:
        """Take in the numbers of the next run."""
        if other["rows"] == 0:
            return
        if self.last is None:
            self.first = other["first"]
        else:
            self.illegal += self.last + other["first"] not in LEGAL
        self.last = other["last"]
        self.distinct += other["distinct"] - (self.greatest is not None and self.greatest == other["least"])
        self.greatest = self.greatest if other["greatest"] is None else other["greatest"]
        self.least = other["least"] if self.least is None else self.least
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + other[name])

    def numbers(self) -> dict:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.distinct
        return {"gaps": gaps, **{k: getattr(self, k) for k in ("blank", "duplicate", "truncated", "illegal")}}


class Repair:
    """Applies an audit to the turns of a conversation, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, ""

    def _next(self) -> str:
        return "a" if self.last == "u" else "u"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.last = self._next()
            yield "I", ROLES[self.last], ""

    def turn(self, role: str, text: str, times: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of all that is written up to this turn and for it."""
        if times == 0:
            return
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += times
        if edit == "K":
            self.last = role[:1]
            yield edit, role, text
        elif edit == "R":
            self.last = self._next()
            yield edit, ROLES[self.last], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


class Hash:
    """SHA-256 of ``role:text`` lines joined by newlines, fed one by one."""

    def __init__(self) -> None:
        self.state, self.lines = hashlib.sha256(), 0

    def add(self, written_turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in written_turns:
            self.state.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
            self.lines += 1


ROW = "conv_id long, turn long, role string, text string, times long"
AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
RESULT = f"conv_id long, {AUDIT}, repaired_sha256 string"
TURN = "conv_id long, position long, edit string, role string, text string"
OPEN = "block long, pos int, turn long, role string, text string, times long"
BLOCKS = (
    "conv_id long, block long, rows long, blank long, duplicate long, truncated long, illegal long, distinct long, "
    "first string, last string, least long, greatest long, ways array<struct<before: int, behind: int, cost: int, audit: string>>"
)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4096 rows, or about ``BLOCK_BYTES`` of their texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + len(row.get("audit") or "")
        if len(held) >= 4096 or size > BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mapped(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` on the rows of each partition, one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batched(work(_rows(batches)), types), schema)


def _written_turns(conv_id: int | None, position: int, edits: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
    for position, (edit, role, text) in enumerate(edits, position):
        yield {"conv_id": conv_id, "position": position, "edit": edit, "role": role, "text": text}


def _repaired(conv_id: int | None, held: list[dict], as_turns: bool) -> Iterator[dict]:
    """A whole conversation that the task holds."""
    turns, seen = Turns(), set()
    for row in held:
        key = (row["role"], row["text"])
        turns.add(row["turn"], row["role"], row["text"], row["times"], key in seen)
        if row["times"]:
            seen.add(key)
    cost, audit = whole_repair(tuple(turns.live), tuple(turns.forced))
    repair = Repair(audit)
    edits = (e for part in (*(repair.turn(r["role"], r["text"], r["times"]) for r in held), repair.rest()) for e in part)
    if as_turns:
        yield from _written_turns(conv_id, 0, edits)
        return
    lines = Hash()
    lines.add(edits)
    yield {"conv_id": conv_id, **turns.numbers(), "cost": cost, "audit": audit, "repaired_sha256": lines.state.hexdigest()}


def _first_pass(as_turns: bool) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Repairs the conversations inside a range; those at its ends, and long ones, leave it as rows of blocks."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        task = TaskContext.get().partitionId() << 32
        blocks, n_seen, held, size, cut, current = 0, 0, [], 0, False, None

        def left() -> Iterator[dict]:
            for pos, row in enumerate(held):
                yield row | {"block": task + blocks, "pos": pos}

        for row in rows:
            if n_seen and row["conv_id"] != current:
                if cut:
                    yield from left()
                    blocks += 1
                else:
                    yield from _repaired(current, held, as_turns)
                held, size, cut = [], 0, False
            elif not n_seen:
                cut = True  # the range before may end with it
            elif len(held) == BLOCK or size > BLOCK_BYTES:
                yield from left()
                blocks, held, size, cut = blocks + 1, [], 0, True
            n_seen += 1
            current = row["conv_id"]
            held.append(row)
            size += len(row["text"])
        yield from left()

    return work


def _align_blocks(rows: Iterator[dict]) -> Iterator[dict]:
    """The numbers of each block and the ways through it; rows come sorted by (block, pos)."""
    current, turns = None, Turns()

    def done() -> Iterator[dict]:
        ways = block_repairs(tuple(turns.live), tuple(turns.forced))
        names = ("rows", "blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "least", "greatest")
        yield {k: current[k] for k in ("conv_id", "block")} | {k: getattr(turns, k) for k in names} | {
            "ways": [dict(zip(("before", "behind", "cost", "audit"), w, strict=True)) for w in ways]
        }

    for row in rows:
        if current is not None and row["block"] != current["block"]:
            yield from done()
            turns = Turns()
        current = row
        turns.add(row["turn"], row["role"], row["text"], row["times"], row["seen"])
    if current is not None:
        yield from done()


def _join_blocks(blocks: Iterator[dict]) -> Iterator[dict]:
    """Each conversation's audit from its blocks, which come in order."""
    current, turns, best = None, Turns(), {EMPTY: (0, "")}

    def done() -> dict:
        cost, audit = min(best[s] for s in (EMPTY, ASSISTANT) if s in best)
        return {"conv_id": current["conv_id"], **turns.numbers(), "cost": cost, "audit": audit}

    for block in blocks:
        if current is not None and block["conv_id"] != current["conv_id"]:
            yield done()
            turns, best = Turns(), {EMPTY: (0, "")}
        current = block
        turns.follow(block)
        ends: dict[int, Found] = {}
        for way in block["ways"]:
            if way["before"] in best:
                cost, audit = best[way["before"]]
                cost += way["cost"]
                known = ends.get(way["behind"])
                if known is None or cost <= known[0]:
                    found = (cost, audit + way["audit"])
                    ends[way["behind"]] = found if known is None else min(known, found)
        best = ends
    if current is not None:
        yield done()


def _apply_audits(as_turns: bool) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Each conversation's audit, which comes first, on its turns, which are read once and not kept."""

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        result, repair, lines, at = None, None, None, 0

        def take(edits: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
            nonlocal at
            if as_turns:
                for row in _written_turns(result["conv_id"], at, edits):
                    at += 1
                    yield row
            else:
                lines.add(edits)

        def done() -> Iterator[dict]:
            yield from take(repair.rest())
            if not as_turns:
                yield result | {"repaired_sha256": lines.state.hexdigest()}

        for row in rows:
            if row["audit"] is not None:
                if result is not None:
                    yield from done()
                result = {k: row[k] for k in ("conv_id", *_names(AUDIT))}
                repair, lines, at = Repair(row["audit"]), Hash(), 0
            else:
                yield from take(repair.turn(row["role"], row["text"], row["times"]))
        if result is not None:
            yield from done()

    return work


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def _open_repairs(rows: DataFrame, as_turns: bool) -> DataFrame:
    """Conversations of several blocks. Only numbers and audits of blocks meet by conversation, then their turns as a stream."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    rows = rows.select("conv_id", *_names(OPEN), key, _digest(F.col("role"), F.col("text")).alias("digest"))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = (
        rows.where("times > 0").groupBy("key", "digest").agg(F.min(at).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    marked = salted_join(rows, firsts, ["key", "digest"], [F.col("block"), F.col("pos")]).withColumn(
        "seen", F.coalesce(at != F.col("earliest"), F.lit(False))
    )
    blocks = marked.select("conv_id", "block", "pos", "turn", "role", "text", "times", "seen").repartition("block")
    blocks = _mapped(blocks.sortWithinPartitions("block", "pos"), _align_blocks, BLOCKS)
    audits = _mapped(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block"), _join_blocks, f"conv_id long, {AUDIT}")
    first = audits.withColumns({"block": F.lit(-1).cast("long"), "pos": F.lit(0)})
    stream = first.unionByName(rows.drop("key", "digest", "turn"), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    return _mapped(stream, _apply_audits(as_turns), TURN if as_turns else RESULT)


def repair_conversations(turns: DataFrame, as_turns: bool = False, times: str | None = None) -> DataFrame:
    """One row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    With ``as_turns`` the repaired turns instead: ``conv_id, position, edit, role, text``. ``turns`` has
    ``conv_id, turn, role, text``; other columns are ignored, but for ``times``, which names a column with
    how often a row counts (0: it only names its conversation, which may be left without turns and then
    has zeros and an empty audit).

    Turns are taken by turn, nulls first; rows of one turn come in the order of the SHA-256 of role and
    text. Null roles and texts are one space. Null identifiers are one conversation. A role without a
    letter is never legal as it is. Repeated rows are counted together first. An empty table gives no
    rows. Of texts, however long, a task holds one block of ``BLOCK`` turns or ``BLOCK_BYTES`` bytes and
    one turn more; a conversation of any length passes through in blocks, only its audit is held as a
    whole, and its hash or repaired turns are made in one pass over its turns.
    """
    space = F.lit(" ")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.col(times) if times else F.lit(1)).cast("long").alias("times"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "digest"]
    ranged = rows.withColumn("digest", _digest(F.col("role"), F.col("text"))).repartitionByRange(*order)
    result = TURN if as_turns else RESULT
    columns = dict(c.split(" ") for c in f"{result}, {OPEN}".split(", "))
    passed = written(
        _mapped(
            ranged.sortWithinPartitions(*order).drop("digest"), _first_pass(as_turns), ", ".join(f"{k} {v}" for k, v in columns.items())
        )
    )
    inside = passed.where("block is null").select(*_names(result))
    return inside.unionByName(_open_repairs(passed.where("block is not null"), as_turns))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with planted faults: ``conv_id, turn, role, text, times``.

    By crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 a row is dropped (0), emptied (1), loses its
    ends of sentences (2), is repeated (3) or gets the role user (4). Dropped rows stay with ``times`` 0.
    """
    space = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
