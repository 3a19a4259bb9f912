"""Line deduplication by a segment-partition edit join.

A line within edit distance k of another one contains at least one of the other's k + 1 segments unchanged
and nearly in place. Every distinct line is indexed under its segments; longer (or equally long) lines probe
with the substrings that could be such a segment, which the two lengths narrow down to a few. A sketch of the
index, merged by Spark, spares most probes their shuffle. Lines that meet are compared inside their task, many
pairs at once, and only each line's number of links and its least partner leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scale import Columns, map_groups
from .repeats import BYTES, PACKED, Spans, cells_for, merged_cells, packed_batch, span_hashes
from .shared import BASES, U64, mix, small_batches, word_spans, written

#: Edits (bytes inserted, deleted or replaced) between lines that count as the same, and the least bytes of
#: such lines; shorter ones only have exact copies.
EDITS, SHORTEST = 2, 20


def lines_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number in the text, start and end (without outer white space) of every line that is not blank."""
    begin, end, first = word_spans(data, starts)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, begin) + np.repeat(np.arange(len(starts) - 1), np.diff(first))
    _, opens = np.unique(line, return_index=True)
    closes = np.append(opens[1:], len(begin)) - 1 if len(opens) else opens
    text = np.searchsorted(first, opens, side="right") - 1
    number = np.searchsorted(breaks, begin[opens]) - np.searchsorted(breaks, starts[text])
    return text, number, begin[opens], end[closes]


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of lines of this length; the last ones take the rest."""
    parts = edits + 1
    small = length // parts
    long_ones = length - small * parts
    return i * small + np.maximum(0, i - (parts - long_ones)), small + (i >= parts - long_ones)


def _keys(units: Spans, start: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return mix(units.hashes(start, start + size) ^ mix((length * 64 + i).astype(np.uint64)))


def index_keys(units: Spans, begin: np.ndarray, end: np.ndarray, edits: int) -> list[np.ndarray]:
    """One key for each segment of every line."""
    length = end - begin
    out = []
    for i in range(edits + 1):
        start, size = segment(length, i, edits)
        out.append(_keys(units, begin + start, size, length, i))
    return out


def probe_keys(units: Spans, begin: np.ndarray, end: np.ndarray, edits: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """``line, key, segment, own`` for every substring that may be a segment of a line at most ``edits`` bytes shorter.

    Segment i has at most i edits to its left and ``edits - i`` to its right, so it starts at most that far
    from its place seen from either end. ``own`` marks the line's own segments.
    """
    for less in range(edits + 1):
        lines = np.flatnonzero(end - begin - less >= shortest)
        length = (end - begin)[lines] - less
        for i in range(edits + 1):
            place, size = segment(length, i, edits)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                start = place + shift
                fits = (start >= 0) & (start + size <= length + less)
                own = less == 0 and shift == 0
                yield lines[fits], _keys(units, begin[lines[fits]] + start[fits], size[fits], length[fits], i), i, own


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit vectors that hold only the band along the diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) > len(b):
        a, b = b, a
    front = 0
    while front < len(a) and a[front] == b[front]:
        front += 1
    a, b = a[front:], b[front:]
    back = 0
    while back < len(a) and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[: len(a) - back], b[: len(b) - back]
    if not a:
        return len(b) <= edits
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    # Bit t of a band vector is row (column - edits + t); rows above the first have no vertical step down.
    width = 2 * edits + 1
    full = (1 << width) - 1
    up, down = 0, 0
    for t in range(width):
        if 1 - edits + t >= 1:
            up |= 1 << t
    distance = min(edits, len(a))  # at the band's lowest row of column 0
    for column in range(1, len(b) + 1):
        low = column - edits  # row of bit 0, counted from 1
        match = places.get(b[column - 1], 0)
        match = (match >> low - 1 if low >= 1 else match << 1 - low) & full
        diagonal = (((match & up) + up) ^ up | match | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        row = column + edits
        if row <= len(a):
            distance += not diagonal >> width - 1 & 1
        else:
            t = len(a) - low
            distance += (right_up >> t & 1) - (right_down >> t & 1)
        shifted = diagonal >> 1
        up = (right_down | ~(shifted | right_up)) & full
        down = shifted & right_up
    return distance <= edits


def _units(data: np.ndarray) -> np.ndarray:
    return data.astype(np.uint64) + U64(1)


def _line_rows(docs: DataFrame) -> DataFrame:
    """``doc, line, one, two`` of every line that is not blank: its place and its content as 128 bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            text, number, begin, end = lines_of(data, starts)
            units = _units(data)
            hashes = [span_hashes(units, begin, end, base).view(np.int64) for base in (BASES[0], BASES[2])]
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(number.astype(np.int32)), *map(pa.array, hashes)], names=["doc", "line", "one", "two"]
            )

    return docs.mapInArrow(work, "doc long, line int, one long, two long")


def _place_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) * U64(BASES[0]) ^ mix(line.astype(np.uint64)))


def _places(rows: DataFrame):
    """The places ``doc, line`` as bits that tasks can look up (with a few false hits)."""
    cells = cells_for(rows.count())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield packed_batch(_place_key(batch.column("doc").to_numpy(), batch.column("line").to_numpy()), cells)

    return rows.sparkSession.sparkContext.broadcast(
        merged_cells(rows.select("doc", "line").mapInArrow(sketch, PACKED), cells, 1)
    )


def near_pairs(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, edits: int) -> np.ndarray:
    """Whether the strings of ``data`` at ``a`` and ``b`` are within ``edits``, for many pairs at once.

    Pairs of like length are laid side by side. On every diagonal of the edit matrix the farthest place that some
    edits reach is moved on to the next difference; what differs in a few places only is known at once.
    """
    out = np.zeros(len(a), dtype=bool)
    size = np.maximum(a_size, b_size)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # Sizes ascend, so the last pair taken is the widest.
        fits = (size[order[at:]] + 1) * np.arange(1, len(order) - at + 1) <= CELLS
        some = order[at : at + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))]
        at += len(some)
        if size[some[0]] > LONG:
            for i in some.tolist():
                x, y = data[a[i] : a[i] + a_size[i]].tobytes(), data[b[i] : b[i] + b_size[i]].tobytes()
                out[i] = within(x, y, edits)
            continue
        out[some] = _near_rows(data, a[some], a_size[some], b[some], b_size[some], edits)
    return out


#: Bytes of lines that are compared side by side at once, and the size from which lines are compared one by one.
CELLS, LONG = 1 << 21, 1 << 16


def _near_rows(data: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, edits: int) -> np.ndarray:
    last = len(data) - 1
    width = int(max(a_size.max(), b_size.max())) + 1
    cols = np.arange(width)

    def laid(start: np.ndarray, size: np.ndarray, columns: np.ndarray, outside: int) -> np.ndarray:
        values = data[np.clip(start[:, None] + columns, 0, last)].astype(np.uint16) + np.uint16(2)
        values[(columns < 0) | (columns >= size[:, None])] = outside
        return values

    x, y = laid(a, a_size, cols, 0), laid(b, b_size, cols, 1)
    # Behind the shorter end all places differ; those are as many edits, and one column more is behind both ends.
    common = np.minimum(a_size, b_size)
    differ = (x != y).sum(axis=1) - (width - common)
    near = (differ + np.abs(a_size - b_size) <= edits) & (np.abs(a_size - b_size) <= edits)
    rest = np.flatnonzero(~near & (np.abs(a_size - b_size) <= edits))
    if not len(rest):
        return near
    x, a_size, b_size = x[rest], a_size[rest], b_size[rest]
    y = laid(b[rest], b_size, np.arange(-edits, width + edits), 1)
    steps = range(-edits, edits + 1)  # place in b less place in a
    other = {d: x != y[:, edits + d : edits + d + width] for d in steps}
    far = {d: np.full(len(rest), -edits - 2) for d in steps}
    for used in range(edits + 1):
        before, far = far, {}
        for d in steps:
            reach = before[d] + (used > 0)
            if used == 0:
                reach = np.zeros(len(rest), np.int64) if d == 0 else reach
            if used and d > -edits:
                reach = np.maximum(reach, before[d - 1])
            if used and d < edits:
                reach = np.maximum(reach, before[d + 1] + 1)
            reach = np.minimum(reach, np.minimum(a_size, b_size - d))
            if abs(d) <= used:
                reach = np.where(reach >= 0, (other[d] & (cols >= reach[:, None])).argmax(axis=1), reach)
            far[d] = reach
    end = b_size - a_size
    near[rest] = np.choose(end + edits, [far[d] for d in steps]) >= a_size
    return near


#: Rows of a key that are compared in one block, and the bytes of a line that count as one row.
BLOCK_ROWS, ROW_BYTES = 512, 8192
INDEX, PROBE = 1, 2
#: Pairs, and bytes of lines of several cells, that a task looks at together.
PAIRS, CELL_BYTES = 1 << 17, 1 << 23


def _cell_links(edits: int, columns: Columns, starts: np.ndarray) -> tuple[np.ndarray, Columns]:
    """Links of the lines of each cell (two blocks of a key), with the least place linked; for ``map_groups``.

    A pair counts in the cell of the first segment by which it meets, and there once.
    """
    content = columns["content"]
    size = np.fromiter(map(len, content), np.int64, len(content))
    if size.sum() > CELL_BYTES and len(starts) > 1:
        half = len(starts) // 2
        first, second = (
            _cell_links(edits, {c: x[span] for c, x in columns.items()}, at)
            for span, at in ((slice(starts[half]), starts[:half]), (slice(starts[half], None), starts[half:] - starts[half]))
        )
        return np.concatenate([first[0], second[0]]), {c: np.concatenate([x, second[1][c]]) for c, x in first[1].items()}
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(content), np.uint8)
    units = Spans(_units(data), BASES[3])
    doc, line, role, part, block = (columns[c] for c in ("doc", "line", "role", "number", "block"))
    n = len(doc)
    ends = np.append(starts[1:], n)
    # Rows of a cell are in the order of blocks, so a row of a lower block meets those of the upper one, and one
    # of a cell of one block all rows behind it.
    group = np.repeat(np.arange(len(starts)), ends - starts)
    lower = block < columns["upper"]
    switch = (starts + np.bincount(group[lower], minlength=len(starts)))[group]
    low = np.where(columns["single"], np.arange(n) + 1, np.where(lower, switch, ends[group]))
    partners = ends[group] - low
    links = np.zeros(n, np.int64)
    # Places as ranks of the batch: the least is a number.
    rank = np.empty(n, np.int64)
    order = np.lexsort((line, doc))
    rank[order] = np.arange(n)
    least = np.full(n, n)
    total = np.cumsum(partners)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, side="right")))
        u = np.repeat(np.arange(row, stop), partners[row:stop])
        v = np.arange(len(u)) - np.repeat(np.cumsum(partners[row:stop]) - partners[row:stop], partners[row:stop]) + low[u]
        row = stop
        swap = (size[u] < size[v]) | ((size[u] == size[v]) & (rank[u] < rank[v]))
        p, q = np.where(swap, v, u), np.where(swap, u, v)
        less = size[p] - size[q]
        kept = (role[p] & PROBE > 0) & (role[q] & INDEX > 0) & (less <= edits)
        p, q, less = p[kept], q[kept], less[kept]
        met = np.zeros(len(p), dtype=bool)
        for i in range(edits):
            place, length = segment(size[q], i, edits)
            own = units.hashes(begin[q] + place, begin[q] + place + length)
            for shift in range(-i, i + 1):
                fits = (i < part[p]) & (shift >= less - (edits - i)) & (shift <= np.minimum(i, less + edits - i)) & (place + shift >= 0)
                some = np.flatnonzero(fits & (place + shift + length <= size[p]) & ~met)
                start = begin[p[some]] + place[some] + shift
                met[some] |= units.hashes(start, start + length[some]) == own[some]
        p, q = p[~met], q[~met]
        near = near_pairs(data, begin[p], size[p], begin[q], size[q], edits)
        p, q = p[near], q[near]
        links += np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
        np.minimum.at(least, p, rank[q])
        np.minimum.at(least, q, rank[p])
    linked = np.flatnonzero(links)
    partner = order[least[linked]]
    counts = np.bincount(group[linked], minlength=len(starts))
    return counts, {
        "doc": doc[linked], "line": line[linked], "links": links[linked], "least_doc": doc[partner], "least_line": line[partner],
    }


def _near(docs: DataFrame, firsts: DataFrame, edits: int, shortest: int) -> DataFrame:
    """``doc, line, links, least`` of first lines that are within ``edits`` of other first lines.

    Pairs are never rows: the lines of a key travel with their bytes, in blocks where they are many, and are
    compared and counted where they meet.
    """
    wanted = _places(firsts)
    cells = cells_for(firsts.count() * (edits + 1))

    def chosen(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray):
        text, number, begin, end = lines_of(data, starts)
        doc = batch.column("doc").to_numpy(zero_copy_only=False)[text]
        kept = np.flatnonzero((end - begin >= shortest) & wanted.value.hold(_place_key(doc, number)))
        return doc[kept], number[kept].astype(np.int32), begin[kept], end[kept], Spans(_units(data), BASES[3])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            _, _, begin, end, units = chosen(batch, data, starts)
            held += index_keys(units, begin, end, edits)
            if sum(map(len, held)) > 1 << 22:
                yield packed_batch(np.concatenate(held), cells)
                held = []
        if sum(map(len, held)):
            yield packed_batch(np.concatenate(held), cells)

    sketches = written(docs.mapInArrow(sketch, PACKED))
    context = docs.sparkSession.sparkContext
    any_line = context.broadcast(merged_cells(sketches, cells, 1))
    two_lines = context.broadcast(merged_cells(sketches, cells, 2))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            doc, number, begin, end, units = chosen(batch, data, starts)
            parts = [(np.arange(len(doc)), key, i, INDEX) for i, key in enumerate(index_keys(units, begin, end, edits))]
            for lines, key, i, own in probe_keys(units, begin, end, edits, shortest):
                hit = (two_lines if own else any_line).value.hold(key)
                parts.append((lines[hit], key[hit], i, PROBE))
            lines = np.concatenate([p[0] for p in parts])
            part, role = (np.concatenate([np.full(len(p[0]), p[k], np.int8) for p in parts]) for k in (2, 3))
            keys = np.concatenate([p[1] for p in parts]).view(np.int64)
            size = (end - begin)[lines].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (doc[lines], number[lines], keys, part, role, size)],
                names=["doc", "line", "key", "part", "role", "size"],
            )

    keyed = written(docs.mapInArrow(rows, "doc long, line int, key long, part byte, role byte, size int"))
    probes = keyed.where(F.col("role") == PROBE)
    index = keyed.where(F.col("role") == INDEX).join(probes.select("key").distinct(), "key", "left_semi")
    members = written(
        probes.unionByName(index).groupBy("key", "part", "doc", "line").agg(F.bit_or("role").alias("role"), F.first("size").alias("size"))
    )
    weight = F.col("n") * F.greatest(F.lit(1.0), F.col("most") / ROW_BYTES)
    blocks = F.least(F.col("n"), F.ceil(weight / BLOCK_ROWS)).cast("int")
    shared = members.groupBy("key", "part").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("roles"), F.max("size").alias("most")
    ).where((F.col("n") > 1) & (F.col("roles") == INDEX | PROBE)).select("key", "part", blocks.alias("blocks"))
    live = written(members.join(shared, ["key", "part"]))
    needed = _places(live.select("doc", "line").distinct())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            text, number, begin, end = lines_of(data, starts)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[text]
            kept = np.flatnonzero(needed.value.hold(_place_key(doc, number)))
            raw = data.tobytes()
            content = [raw[a:b] for a, b in zip(begin[kept].tolist(), end[kept].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[kept]), pa.array(number[kept].astype(np.int32)), pa.array(content, pa.binary())],
                names=["doc", "line", "content"],
            )

    found = docs.mapInArrow(texts, "doc long, line int, content binary").dropDuplicates(["doc", "line"])
    block = F.pmod(F.xxhash64("doc", "line"), F.col("blocks")).cast("int")
    dealt = live.join(found, ["doc", "line"]).withColumn("block", block).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    placed = dealt.select(
        "key", "part", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("upper"),
        (F.col("block") == F.col("with")).alias("single"), F.col("part").alias("number"), "block", "doc", "line", "role", "content",
    ).withColumn("high", F.col("upper"))
    counted = map_groups(
        placed, ["key", "part", "low", "high"], ["block", "doc", "line"], partial(_cell_links, edits),
        "doc long, line int, links long, least_doc long, least_line int",
    )
    return counted.groupBy("doc", "line").agg(
        F.sum("links").alias("links"), F.min(F.struct(F.col("least_doc").alias("doc"), F.col("least_line").alias("line"))).alias("least")
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, shortest: int = SHORTEST
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_lines, n_copies, n_removed, n_links, kept_text``.

    Lines end at a line feed and are compared without outer ASCII white space; blank ones always stay and
    are not counted. A line goes when an earlier line (smaller identifier, or same document further up) is
    its copy, or within ``edits`` edits where both have at least ``shortest`` bytes of UTF-8; lines are
    judged on the input. ``n_copies`` are the lines with an earlier exact copy, ``n_links`` the links of
    the document's other lines to different lines. A null text has no lines; a row without identifier
    loses nothing and makes nothing go; repeated rows are one document and get the same answer each. Other
    columns are ignored. An empty table gives no rows; very long texts and lines are read whole.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    known = slim.where("doc is not null")
    lines = written(_line_rows(known))
    place = F.struct("doc", "line")
    classes = written(lines.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    near = _near(known, classes.select("first.*"), edits, shortest)
    several = lines.join(classes.where("n > 1"), ["one", "two"])
    copies = several.where(place != F.col("first")).select(lines.columns).distinct().select(
        "doc", "line", F.lit(True).alias("copy"), F.lit(True).alias("gone"), F.lit(0).cast("long").alias("links")
    )
    linked = near.select(
        "doc", "line", F.lit(False).alias("copy"), (F.col("least") < place).alias("gone"), "links",
    )
    marks = copies.unionByName(linked).groupBy("doc").agg(
        F.sum(F.col("copy").cast("long")).alias("n_copies"),
        F.sum("links").alias("n_links"),
        F.collect_list(F.when(F.col("gone"), F.col("line"))).alias("gone"),
    )
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(
        marks, "doc", "left"
    ).select("doc_id", "text", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "gone")
    schema = T.StructType(
        [joined.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_copies", T.LongType()),
         T.StructField("n_removed", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("kept_text", T.StringType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            raw = data.tobytes()
            text, _, _, _ = lines_of(data, starts)
            kept, removed = [], []
            for i, gone in enumerate(batch.column("gone").to_pylist()):
                own = raw[starts[i] : starts[i + 1]]
                if gone:
                    out = set(gone)
                    own = b"\n".join([x for n, x in enumerate(own.split(b"\n")) if n not in out])
                kept.append(own.decode())
                removed.append(len(gone or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.bincount(text, minlength=batch.num_rows).astype(np.int64)),
                 batch.column("n_copies"), pa.array(removed, pa.int64()), batch.column("n_links"), pa.array(kept, pa.string())],
                names=schema.fieldNames(),
            )

    return joined.mapInArrow(work, schema)
