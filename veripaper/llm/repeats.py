"""Windows of neighbouring units (words or bytes) that occur more than once, found exactly.

Every window is named by its anchor, the unit run (gram) with the smallest hash inside it; neighbouring
windows that share one anchor form a run. Equal windows have equal anchors at the same place, so:

1. anchors are counted in a count-min sketch, merged from partition sketches by Spark;
2. runs whose anchor may be repeated are grouped by their whole content: later members are repeated;
3. only where one anchor has several contents, the first run of each is looked at more closely: longer
   strings around its anchor, one for each quarter of its windows, are counted in a second sketch;
4. quarters whose string may occur again are grouped by their whole content, as runs were;
5. only where one string has several contents, the windows of each first quarter are counted in a third sketch;
6. windows that may occur again are grouped one by one.

No window is lost: the sketches never count too little, and steps 2, 4 and 6 compare 128-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASES, U64, mix, powers, run_hashes, small_batches, word_hashes, word_spans, written

#: Cells in a row of the sketch: four for each expected anchor, between these bounds (2**28 cells are 32 MB
#: of bits when broadcast). With more anchors than that the estimates rise and more runs are grouped.
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 28
CELLS_PER_ANCHOR = 4
#: Rows of the sketch, and cells in a block of a row, the unit in which partition sketches are merged.
ROWS, BLOCK = 2, 1 << 20
#: Bytes of text whose windows are worked out at once: their arrays, eight times as large, stay in a core's cache.
BYTES = 1 << 18


@dataclass(frozen=True)
class Units:
    """What windows are made of. ``read`` gives two hashes of every unit and where each text's units begin."""

    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int


def word_units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin, end, first = word_spans(data, starts)
    return word_hashes(data, begin, end, BASES[0]), word_hashes(data, begin, end, BASES[1]), first


def byte_units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = data.astype(np.uint64) + U64(1)
    return units, units, starts


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` neighbours, by doubling."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if size < n else values


class Spans:
    """Hashes of spans of items, from sums that are worked out once."""

    def __init__(self, items: np.ndarray, base: int):
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * powers(base, len(items)), out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), len(items) + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the items from ``start`` to before ``end``, for many spans."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def span_hashes(items: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return Spans(items, base).hashes(start, end)


@dataclass
class Runs:
    """Runs of windows of one batch: text number, first window, windows, place in the batch of the first
    window and of the anchor, anchor; ``hashes`` are those of the units."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]

    @cached_property
    def spans(self) -> tuple[Spans, Spans]:
        return Spans(self.hashes[0], BASES[3]), Spans(self.hashes[1], BASES[1])

    def contents(self, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of what each span of units holds."""
        one, two = (spans.hashes(begin, begin + length) for spans in self.spans)
        return one, two


def runs_of(units: Units, data: np.ndarray, starts: np.ndarray) -> Runs:
    """All runs of the texts in ``data``; windows never cross from one text into the next."""
    one, two, first = units.read(data, starts)
    n_windows = np.maximum(0, np.diff(first) - units.window + 1)
    some = np.flatnonzero(n_windows)
    if not len(some):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none, none.astype(np.uint64), (one, two))
    grams = run_hashes(one, units.gram, BASES[2])
    placed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(placed, units.window - units.gram + 1)
    # Windows that begin in one text and end in another are no windows.
    inside = np.zeros(len(least) + 1, np.int8)
    inside[first[some]] += 1
    inside[first[some] + n_windows[some]] -= 1
    opens = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=opens[1:])
    opens[first[some]] = True
    opens &= np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    begin = np.flatnonzero(opens)
    text = np.searchsorted(first, begin, side="right") - 1
    size = np.minimum(np.append(begin[1:], len(least)), first[text] + n_windows[text]) - begin
    at = (least[begin] & U64(0xFFFFFFFF)).astype(np.int64)
    return Runs(text, begin - first[text], size, begin, at, grams[at], (one, two))


class Cells:
    """Bits of the cells that a key falls into, one in each row of the sketch."""

    def __init__(self, cells: int, bits: list[np.ndarray]):
        self.cells, self.bits = cells, bits

    @staticmethod
    def of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
        return (mix(keys ^ U64(BASES[row])) >> U64(64 - cells.bit_length() + 1)).astype(np.int64)

    def hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for row, bits in enumerate(self.bits):
            cell = self.of(keys, row, self.cells)
            found &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return found


def packed_cells(keys: np.ndarray, cells: int) -> dict[str, list]:
    """A partition's sketch: for each row and block the cells counted once, and those counted more often."""
    out: dict[str, list] = {"row": [], "block": [], "once": [], "more": []}
    for row in range(ROWS):
        cell, count = np.unique(Cells.of(keys, row, cells), return_counts=True)
        edges = np.searchsorted(cell, np.arange(0, cells + BLOCK, BLOCK))
        for block in np.flatnonzero(np.diff(edges)):
            inside = cell[edges[block] : edges[block + 1]] - block * BLOCK
            single = count[edges[block] : edges[block + 1]] == 1
            out["row"].append(row)
            out["block"].append(int(block))
            for name, chosen in (("once", inside[single]), ("more", inside[~single])):
                steps = np.diff(chosen, prepend=0).astype(np.uint32)
                out[name].append(zlib.compress(steps.tobytes(), 1))
    return out


def _unpacked(value: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(value), dtype=np.uint32), dtype=np.int64)


PACKED = "row int, block int, once binary, more binary"
PACKED_ARROW = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def packed_batch(keys: np.ndarray, cells: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(packed_cells(keys, cells), schema=PACKED_ARROW)


def merged_cells(sketches: DataFrame, cells: int, least: int) -> Cells:
    """Cells with a count of ``least`` (1 or 2) or more, over all partition sketches.

    Blocks are merged by Spark, one block in memory at a time; the driver gets ``ROWS * cells`` bits,
    at most ``ROWS * MAX_CELLS``.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, np.zeros(BLOCK, np.uint8)

        def done():
            bits = np.packbits(counts >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"row": [key[0]], "block": [key[1]], "bits": [bits]}, schema=MERGED)

        for batch in batches:
            for row, block, once, more in zip(*[batch.column(c).to_pylist() for c in ("row", "block", "once", "more")]):
                if key != (row, block):
                    if key is not None:
                        yield done()
                    key = (row, block)
                    counts[:] = 0
                inside = _unpacked(once)
                counts[inside] = np.minimum(2, counts[inside] + 1)
                counts[_unpacked(more)] = 2
        if key is not None:
            yield done()

    placed = sketches.repartition("row", "block").sortWithinPartitions("row", "block")
    rows = placed.mapInArrow(merge, "row int, block int, bits binary").collect()
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(ROWS)]
    for r in rows:
        bits[r["row"]][r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return Cells(cells, bits)


MERGED = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])


def cells_for(n: float) -> int:
    """A power of two, about ``CELLS_PER_ANCHOR`` for each of ``n`` keys, within the bounds."""
    wanted = max(1, int(n * CELLS_PER_ANCHOR))
    return min(MAX_CELLS, max(MIN_CELLS, 1 << (wanted - 1).bit_length()))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sketch(docs: DataFrame, units: Units, cells: int, own_repeats: bool) -> DataFrame:
    """Partition sketches of the anchors; without ``own_repeats`` a text counts for each anchor once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, data, starts in small_batches(batches, "text", size=BYTES):
            runs = runs_of(units, data, starts)
            anchor = runs.anchor
            if not own_repeats:
                order = np.lexsort((anchor, runs.text))
                text, anchor = runs.text[order], anchor[order]
                new = np.ones(len(anchor), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                anchor = anchor[new]
            held.append(anchor)
            n += len(anchor)
            if n > 4 * BLOCK:
                yield packed_batch(np.concatenate(held), cells)
                held, n = [], 0
        if n:
            yield packed_batch(np.concatenate(held), cells)

    return docs.select("text").mapInArrow(work, PACKED)


def _run_rows(docs: DataFrame, units: Units, shared: Broadcast) -> DataFrame:
    """Runs whose anchor may occur again: ``doc, start, size, anchor, content, check``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            runs = runs_of(units, data, starts)
            kept = np.flatnonzero(shared.value.hold(runs.anchor))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[runs.text[kept]]
            columns = [doc, runs.start[kept].astype(np.int32), runs.size[kept].astype(np.int32)]
            contents = runs.contents(runs.begin[kept], runs.size[kept] + units.window - 1)
            columns += [_signed(x) for x in (runs.anchor[kept], *contents)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=RUN_COLUMNS
            )

    return docs.mapInArrow(work, RUN_SCHEMA)


RUN_COLUMNS = ["doc", "start", "size", "anchor", "content", "check"]
RUN_SCHEMA = "doc long, start int, size int, anchor long, content long, check long"


def place_key(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64) * U64(BASES[0]) ^ mix(start.astype(np.uint64)))


#: Parts of a run's windows, by how far left of the anchor they start, that are told apart in step 3.
PARTS = 4


def _parts(units: Units) -> list[tuple[int, int]]:
    """First and last distance from the anchor of each part's windows."""
    slack = units.window - units.gram
    step = -(-(slack + 1) // PARTS)
    return [(low, min(slack, low + step - 1)) for low in range(0, slack + 1, step)]


def part_keys(units: Units, runs: Runs, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part the chosen runs that have windows in it, and the hash of what all these windows hold."""
    at, begin, size = runs.at[chosen], runs.begin[chosen], runs.size[chosen]
    spans = runs.spans[0]
    slack = units.window - units.gram
    for j, (low, high) in enumerate(_parts(units)):
        has = np.flatnonzero((at - begin >= low) & (at - begin - size + 1 <= high))
        keys = spans.hashes(at[has] - low, at[has] + units.gram + slack - high)
        yield has, mix(keys ^ U64(j + 1))


def _wanted_runs(batch: pa.RecordBatch, runs: Runs, anchors: Broadcast, wanted: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    docs = batch.column("doc").to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(wanted.value.hold(place_key(docs[runs.text], runs.start)))
    return docs, kept[anchors.value.hold(runs.anchor[kept])]


def _part_sketch(docs: DataFrame, units: Units, anchors: Broadcast, wanted: Broadcast, cells: int) -> DataFrame:
    """Partition sketches of the longer strings around the anchors of the wanted runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            runs = runs_of(units, data, starts)
            _, kept = _wanted_runs(batch, runs, anchors, wanted)
            if len(kept):
                held += [keys for _, keys in part_keys(units, runs, kept)]
            if sum(map(len, held)) > 4 * BLOCK:
                yield packed_batch(np.concatenate(held), cells)
                held = []
        if sum(map(len, held)):
            yield packed_batch(np.concatenate(held), cells)

    return docs.mapInArrow(work, PACKED)


@dataclass
class Quarters:
    """Quarters of the wanted runs whose string may occur again; ``begin`` is a place of the batch, ``start`` of the text."""

    run: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _quarters(units: Units, runs: Runs, kept: np.ndarray, shared: Cells) -> Quarters:
    found = []
    for (low, high), (has, keys) in zip(_parts(units), part_keys(units, runs, kept)):
        hit = shared.hold(keys)
        run = kept[has[hit]]
        begin = np.maximum(runs.begin[run], runs.at[run] - high)
        end = np.minimum(runs.begin[run] + runs.size[run] - 1, runs.at[run] - low)
        found.append((run, keys[hit], begin, end - begin + 1))
    run, key, begin, size = (np.concatenate(x) for x in zip(*found))
    return Quarters(run, key, begin, runs.start[run] + begin - runs.begin[run], size)


def _quarter_rows(docs: DataFrame, units: Units, anchors: Broadcast, wanted: Broadcast, shared: Broadcast) -> DataFrame:
    """Quarters as rows of the form of runs; the anchor is their string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            runs = runs_of(units, data, starts)
            docs_of, kept = _wanted_runs(batch, runs, anchors, wanted)
            if len(kept):
                part = _quarters(units, runs, kept, shared.value)
                contents = runs.contents(part.begin, part.size + units.window - 1)
                columns = [docs_of[runs.text[part.run]], part.start.astype(np.int32), part.size.astype(np.int32)]
                columns += [_signed(x) for x in (part.key, *contents)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=RUN_COLUMNS)

    return docs.mapInArrow(work, RUN_SCHEMA)


@dataclass(frozen=True)
class Open:
    """What tasks look up to find the windows of open quarters (and of a few others)."""

    units: Units
    anchors: Broadcast
    wanted: Broadcast
    shared: Broadcast
    quarters: Broadcast

    def windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Runs, np.ndarray, np.ndarray, np.ndarray]]:
        """For each batch its documents and runs, and of every window its run, place in the batch and length."""
        for batch, data, starts in small_batches(batches, "text", size=BYTES):
            runs = runs_of(self.units, data, starts)
            docs, kept = _wanted_runs(batch, runs, self.anchors, self.wanted)
            if not len(kept):
                continue
            part = _quarters(self.units, runs, kept, self.shared.value)
            hit = np.flatnonzero(self.quarters.value.hold(place_key(docs[runs.text[part.run]], part.start)))
            run, size = np.repeat(part.run[hit], part.size[hit]), part.size[hit]
            begin = np.repeat(part.begin[hit], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield docs, runs, run, begin, np.full(len(begin), self.units.window)


def _window_sketch(docs: DataFrame, found: Open, cells: int) -> DataFrame:
    """Partition sketches of the windows of open quarters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for _, runs, _, begin, length in found.windows(batches):
            held.append(runs.spans[0].hashes(begin, begin + length))
            if sum(map(len, held)) > 4 * BLOCK:
                yield packed_batch(np.concatenate(held), cells)
                held = []
        if sum(map(len, held)):
            yield packed_batch(np.concatenate(held), cells)

    return docs.mapInArrow(work, PACKED)


def _window_rows(docs: DataFrame, found: Open, again: Broadcast) -> DataFrame:
    """Windows of the open quarters that may occur again: ``doc, start, one, two``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_of, runs, run, begin, length in found.windows(batches):
            one = runs.spans[0].hashes(begin, begin + length)
            hit = np.flatnonzero(again.value.hold(one))
            run, begin = run[hit], begin[hit]
            two = runs.spans[1].hashes(begin, begin + length[hit])
            start = runs.start[run] + begin - runs.begin[run]
            columns = [docs_of[runs.text[run]], start.astype(np.int32), _signed(one[hit]), _signed(two)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "start", "one", "two"])

    return docs.mapInArrow(work, "doc long, start int, one long, two long")


def _settled(runs: DataFrame, own_repeats: bool) -> DataFrame:
    """``doc, start, size, later, open``: runs whose content occurs before, and first ones of several contents."""
    # Runs of equal content have equal anchors, so the anchor is no part of the key.
    place, key = F.struct("doc", "start"), ["content", "check"]
    classes = runs.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.min("anchor").alias("anchor"))
    kinds = classes.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("open"))
    ranked = classes.join(kinds, "anchor").where("n > 1 or open").select(*key, "first", "open")
    later = place != F.col("first") if own_repeats else F.col("doc") != F.col("first.doc")
    joined = runs.join(ranked, key).select("doc", "start", "size", later.alias("later"), "open")
    return written(joined.where("later or open"))


def _open_cells(settled: DataFrame) -> Broadcast:
    """Which runs are open, as bits that tasks can look up (with a few false hits)."""
    rows = settled.where("not later and open").select("doc", "start")
    cells = cells_for(rows.count())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "start"))
                yield packed_batch(place_key(doc, start), cells)

    return settled.sparkSession.sparkContext.broadcast(merged_cells(rows.mapInArrow(sketch, PACKED), cells, 1))


def repeated_windows(docs: DataFrame, units: Units, own_repeats: bool) -> DataFrame:
    """Windows of ``docs (doc long, text)`` that occur before: ``doc, start, size``, runs of window starts.

    Before means in a document with a smaller ``doc``; with ``own_repeats`` also at an earlier place of the
    same document. ``doc`` must not be null. Rows that repeat a ``doc`` and its text count as one document.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = 2 / (units.window - units.gram + 2) / (6 if units.read is word_units else 1)
    cells = cells_for(n_bytes * share)
    anchors = spark.sparkContext.broadcast(merged_cells(_sketch(docs, units, cells, own_repeats), cells, 2))
    runs = _settled(written(_run_rows(docs, units, anchors)), own_repeats)
    wanted = _open_cells(runs)
    part_cells = cells_for(PARTS * runs.where("not later and open").count())
    shared = spark.sparkContext.broadcast(
        merged_cells(_part_sketch(docs, units, anchors, wanted, part_cells), part_cells, 2)
    )
    quarters = _settled(written(_quarter_rows(docs, units, anchors, wanted, shared)), own_repeats)
    found = Open(units, anchors, wanted, shared, _open_cells(quarters))
    window_cells = cells_for(quarters.where("not later and open").agg(F.sum("size")).first()[0] or 0)
    again = spark.sparkContext.broadcast(merged_cells(_window_sketch(docs, found, window_cells), window_cells, 2))
    windows = written(_window_rows(docs, found, again))
    place = F.struct("doc", "start")
    first = F.col("first") if own_repeats else F.col("first.doc")
    own = place if own_repeats else F.col("doc")
    groups = windows.groupBy("one", "two").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")
    ).where("n > 1" if own_repeats else "last > first.doc").select("one", "two", "first")
    single = windows.join(groups, ["one", "two"]).where(own != first).select("doc", "start", F.lit(1).alias("size"))
    covered = runs.unionByName(quarters).where("later").select("doc", "start", "size")
    return covered.unionByName(single)


def spans_by_doc(repeated: DataFrame) -> DataFrame:
    """``doc, starts, sizes``: the repeated windows of each document, at most as many as it has units."""
    together = F.collect_list(F.struct("start", "size")).alias("found")
    return repeated.groupBy("doc").agg(together).select(
        "doc", F.col("found.start").alias("starts"), F.col("found.size").alias("sizes")
    )


def covered_units(starts: np.ndarray, sizes: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window that starts in one of the runs."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.minimum(starts, n), 1)
    np.add.at(change, np.minimum(starts + sizes + window - 1, n), -1)
    return np.cumsum(change[:-1]) > 0
