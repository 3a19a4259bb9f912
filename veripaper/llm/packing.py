"""Packing of tokenized documents into sequences of a fixed length.

A document gives its full windows, which are sequences by themselves, and one shorter piece. How pieces
share sequences is planned on the histogram of their lengths alone, which has as many entries as a window
has tokens, whatever the number of documents: combinations of at most ``DEPTH`` lengths that fill a window
are enumerated on a coarse grid, non-negative least squares finds how often each should be used, and the
rounded plan is filled with exact lengths; what remains is packed greedily. Spark then numbers the pieces
of each length and looks their places up in the plan.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept_for, small_batches, written

#: Tokens of a sequence, of a cell of the coarse grid, and lengths that a combination has at most.
WINDOW, GRID, DEPTH = 2048, 16, 3
#: The id behind every document.
END_ID = 1
#: Words whose ids a Python worker remembers, and pieces that are numbered in one group.
REMEMBERED, NUMBERED = 600_000, 50_000
#: Marks that stand behind letters.
MARKS = string.punctuation


class WordIds:
    """Ids of white-space separated words; equal to encoding the whole text, as no token spans white space.

    New words are encoded many in one call. A word of letters, or of marks, ends with the only token that
    ends a word; marks behind letters end a word of their own, as the vocabulary splits letters from marks.
    All other words are encoded one by one.
    """

    ENDS = "</w>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.ENDS)]] = True
        self.known: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _together(self, words: list[str], ends: int) -> list[bytes]:
        """Ids of words that have ``ends`` tokens which end a word each."""
        ids = self._encoded([" ".join(words)])[0]
        stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
        if len(stops) != ends * len(words) or stops[-1] != len(ids):
            return self._encoded(words)
        stops = stops[ends - 1 :: ends]
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def _learn(self, new: list[bytes]) -> None:
        words = b" ".join(new).decode().split(" ")
        heads = [w.rstrip(MARKS) for w in words]
        kinds = [(1 + (h != w)) * h.isalpha() if h else 1 for w, h in zip(words, heads)]
        for kind in (1, 2, 0):
            chosen = [i for i, k in enumerate(kinds) if k == kind]
            if chosen:
                some = [words[i] for i in chosen]
                self.known.update(zip([new[i] for i in chosen], self._together(some, kind) if kind else self._encoded(some)))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        split = [text.split() for text in texts]
        if len(self.known) > REMEMBERED:
            # Words of these texts stay, the frequent ones among them.
            self.known = {word: self.known[word] for words in split for word in words if word in self.known}
        known = self.known
        found = [list(map(known.get, words)) for words in split]
        missing = [[i for i, ids in enumerate(row) if ids is None] if None in row else () for row in found]
        new = {words[i] for words, places in zip(split, missing) for i in places}
        if new:
            self._learn(list(new))
        for row, words, places in zip(found, split, missing):
            for i in places:
                row[i] = known[words[i]]
        return [b"".join(row) for row in found]


def tokenized_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): every document cut at full windows."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = (
        T.StructType([slim.schema["doc_id"]]).add("start", "long").add("length", "long").add("ids_crc32", "long")
        .add("doc_tokens", "long")
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    end = np.array([END_ID], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = kept_for("packing")
        if path not in encoders:
            encoders[path] = WordIds(path)
        encode = encoders[path]
        for batch, data, starts in small_batches(batches, "text", "packing"):
            raw = data.tobytes()
            rows, out = [], []
            for row, ids in enumerate(encode([raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())])):
                ids += end
                for begin in range(0, len(ids), 4 * WINDOW):
                    piece = ids[begin : begin + 4 * WINDOW]
                    rows.append(row)
                    out.append((begin // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
            columns = [batch.column("doc_id").take(pa.array(rows))]
            columns += [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x[4], "<u4").astype(np.int64) for x in out], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
        # The worker goes on to other tasks; most words are rare and would only take its memory.
        encode.known.clear()

    return slim.mapInArrow(work, schema)


@dataclass(frozen=True)
class Pattern:
    """A sequence of pieces of these lengths, made this often."""

    lengths: tuple[int, ...]
    times: int


def shallow_combinations(cells: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of one to ``depth`` cell counts that sum to ``cells``."""

    def fill(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if depth > 1:
            for size in range(min(most, left - 1), 0, -1):
                for rest in fill(left - size, size, depth - 1):
                    yield (size, *rest)

    return [c for c in fill(cells, cells, depth) if len(c) > 1]


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimizes ``|a x - b|``, by an active set of columns."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        gradient = np.where(active, -np.inf, target - gram @ x)
        at = int(np.argmax(gradient))
        if gradient[at] <= tolerance:
            break
        active[at] = True
        while True:
            chosen = np.flatnonzero(active)
            solved = np.linalg.lstsq(gram[np.ix_(chosen, chosen)], target[chosen], rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[chosen] = solved
                break
            low = chosen[solved <= 0]
            below = solved[solved <= 0]
            step = np.min(x[low] / np.maximum(x[low] - below, 1e-300))
            x[chosen] += step * (solved - x[chosen])
            gone = chosen[x[chosen] <= 1e-12]
            if len(gone) == 0:
                gone = low[:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def packing_plan(counts: dict[int, int], window: int = WINDOW, grid: int = GRID, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that use every piece of the histogram ``counts`` (length to number) exactly once."""
    left = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[Pattern] = []

    def largest(at_most: int, taken: Counter) -> int:
        """The greatest length up to ``at_most`` of which pieces are left beyond those taken; 0 for none."""
        for length in np.flatnonzero(left[: at_most + 1])[::-1].tolist():
            if left[length] > taken[length]:
                return length
        return 0

    def use(lengths: list[int], most: int) -> int:
        times = min([most, *(int(left[length]) // n for length, n in Counter(lengths).items())])
        for length in lengths:
            left[length] -= times
        plan.append(Pattern(tuple(lengths), times))
        return times

    if left[:window].any():
        combinations = shallow_combinations(window // grid, depth)
        matrix = np.zeros((window // grid, len(combinations)))
        for column, cells in enumerate(combinations):
            np.add.at(matrix[:, column], np.array(cells) - 1, 1)
        cell = (np.arange(1, window) - 1) // grid
        wanted = np.bincount(cell, weights=left[1:window], minlength=window // grid)
        repeats = np.floor(non_negative_least_squares(matrix, wanted) + 1e-6).astype(int)
        for cells, times in sorted(zip(combinations, repeats.tolist()), reverse=True):
            while times > 0:
                taken, room = Counter(), window
                for k, size in enumerate(cells):
                    last = k == len(cells) - 1
                    length = largest(room if last else min(room, size * grid), taken)
                    if length == 0 or not last and length <= (size - 1) * grid:
                        break
                    taken[length] += 1
                    room -= length
                if sum(taken.values()) < len(cells) or room > grid:
                    break
                times -= use(list(taken.elements()), times)
    while left.any():
        taken, room, chosen = Counter(), window, []
        while room and (length := largest(room, taken)):
            taken[length] += 1
            room -= length
            chosen.append(length)
        use(chosen, int(left.sum()))
    return plan


def _slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """``length, from, to, sequence, offset``: pieces of a length numbered in this range go to these sequences."""
    used: Counter = Counter()
    slots, sequence = [], 0
    for pattern in plan:
        offset = 0
        for length in pattern.lengths:
            slots.append((length, used[length], used[length] + pattern.times, sequence, offset))
            used[length] += pattern.times
            offset += length
        sequence += pattern.times
    return slots


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    ``path`` is the vocabulary of the ``tokenizers`` library, at the same place on every machine. A document
    is its ids and ``END_ID``; a null or empty text is only the latter. Repeated rows and rows without
    identifier are documents like all others. ``offset`` is gapless from 0 in each sequence; only the order
    of sequences is arbitrary. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(tokenized_pieces(docs, path, id_col, text_col, with_ids))
    short = pieces.where(F.col("length") < WINDOW)
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(packing_plan(counts)), "_length long, _from long, _to long, _sequence long, offset long"
    )
    salts = max(1, -(-sum(counts.values()) // NUMBERED))
    salted = short.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("length").orderBy("_salt")
    before = sizes.select(
        "length", "_salt", (F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before")
    )
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    numbered = salted.withColumn("_nth", F.row_number().over(own) - 1).join(before, ["length", "_salt"])
    number = F.col("_before") + F.col("_nth")
    # At most three slots for each combination and length of a window: bounded, whatever the input.
    placed = numbered.join(
        F.broadcast(slots), (F.col("length") == F.col("_length")) & (number >= F.col("_from")) & (number < F.col("_to"))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] * with_ids
    shared = placed.select(*columns, (2 * (F.col("_sequence") + number - F.col("_from"))).alias("sequence_id"), "offset", *ids)
    whole = pieces.where(F.col("length") == WINDOW).select(
        *columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *ids
    )
    return shared.unionByName(whole)
