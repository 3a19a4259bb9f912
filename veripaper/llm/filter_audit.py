"""How filters interact: survivors of every subset of them, counted by truth-table words.

A document fails some of the five filters. Its survival word has one bit for each of the 32 subsets of
the filters, set where the document passes them all. Positional popcounts of the words, by carry-save
adders over whole arrays, give the survivors of every subset for each part and label, and all figures of
all filter orders are differences of those counts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: A longer text is split into words in blocks of about so many bytes.
BLOCK = 1 << 22
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))
SPACE = b" \t\n\v\f\r"


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks that end between words; a word longer than a block stays whole."""
    at = 0
    while len(text) - at > BLOCK:
        end = at + BLOCK
        while end < len(text) and text[end] not in SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def failures(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    n_words, distinct = 0, set()
    for block in _blocks(text):
        words = block.split()  # of bytes: at ASCII white space only
        n_words += len(words)
        distinct.update(words)
    points = len(text.translate(None, CONTINUED))
    upper = len(text) - len(text.translate(None, UPPER))
    failed = (
        n_words < LEAST_WORDS,
        100 * len(distinct) < LEAST_DISTINCT * n_words,
        100 * upper > MOST_UPPER * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents, failed = [], []
        for value in batch.column("text").cast(pa.large_binary()):
            text = value.as_py() or b""
            contents.append(hashlib.sha256(text).digest())
            failed.append(failures(text))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("part"),
                pa.array(contents, pa.binary()),
                pa.array(failed, pa.int32()),
            ],
            names=["doc_id", "part", "content", "failed"],
        )


#: The survival word of each set of failed filters: bit s is set if no filter of subset s fails.
SURVIVAL = np.array([sum(1 << s for s in range(ALL + 1) if not s & failed) for failed in range(ALL + 1)], dtype=np.uint32)


def positional_popcount(planes: dict[int, np.ndarray]) -> np.ndarray:
    """How often each of 32 bits is set; ``planes[k]`` holds the words that count ``2 ** k`` times.

    Full adders turn three words of a weight into a sum word of that weight and a carry word of the
    next, until two words are left at each weight; only those are read bit by bit.
    """
    waiting = defaultdict(list, {k: [np.asarray(w, np.uint32)] for k, w in planes.items()})
    total, weight = np.zeros(32, np.int64), 0
    while waiting:
        words = np.concatenate(waiting.pop(weight, [np.zeros(0, np.uint32)]))
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            either = a ^ b
            waiting[weight + 1].append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * n :]])
        for word in words:
            total += ((int(word) >> np.arange(32)) & 1) << weight
        weight += 1
    return total


def _planes(words: np.ndarray, times: np.ndarray) -> dict[int, np.ndarray]:
    """The words by the binary digits of how often each counts."""
    return {k: words[(times >> k) & 1 == 1] for k in range(int(times.max(initial=0)).bit_length())}


COUNTS = StructType([StructField(f"n{s}", LongType()) for s in range(ALL + 1)])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset in a batch, one row for each of its parts and labels."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes = batch.column("part").dictionary_encode()
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
        group = codes.indices.to_numpy() * 4 + good * 2 + toxic
        words = SURVIVAL[batch.column("failed").to_numpy()]
        times = batch.column("times").to_numpy()
        keys = np.unique(group)
        counts = [positional_popcount(_planes(words[group == k], times[group == k])) for k in keys]
        yield pa.RecordBatch.from_arrays(
            [
                codes.dictionary.take(pa.array(keys // 4)),
                pa.array(keys // 2 % 2 == 1),
                pa.array(keys % 2 == 1),
                *[pa.array([c[s] for c in counts], pa.int64()) for s in range(ALL + 1)],
            ],
            names=["part", "good", "toxic", *COUNTS.names],
        )


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, n0 .. n31``: documents of each part and label that survive each subset of the filters.

    Bit i of a subset is filter i of ``FILTERS``. ``docs`` has ``doc_id, text, lang``, ``labels`` has
    ``doc_id, quality, toxic``; other columns are ignored. A null text is empty, a null language the
    part ''. Every row is a document; rows with one identifier and one text are not copies of each
    other, a null identifier comes after all others. A document is good or toxic if any of its label
    rows says so. Without documents there are no rows.

    Equal texts are found by their SHA-256; rows are counted together by (identifier, text) and then
    by (text, part, label) before they meet, so that one text or one identifier may fill the table.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    facts = rows.mapInArrow(_facts, "doc_id long, part string, content binary, failed int")
    counted = facts.groupBy("doc_id", "content", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    marks = (
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy("doc_id")
        .agg(F.max(F.coalesce("quality", F.lit(0)) == 1).alias("good"), F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    )
    no = F.lit(False)
    labelled = counted.join(marks, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "content", "part", "failed", "n",
        F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"),
    )
    least = F.min(F.struct("id", "n"))
    groups = labelled.groupBy("content", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"))
    first = groups.groupBy("content").agg(F.min("least.id").alias("first"))
    at_first = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    copied = 1 << FILTERS.index("E")
    kinds = F.array(
        F.struct(F.col("failed"), at_first.alias("times")),
        F.struct(F.col("failed").bitwiseOR(F.lit(copied)).alias("failed"), (F.col("n") - at_first).alias("times")),
    )
    kinds = groups.join(first, "content").select("part", "good", "toxic", F.inline(kinds)).where("times > 0")
    schema = "part string, good boolean, toxic boolean, " + ", ".join(f"{n} long" for n in COUNTS.names)
    parts = kinds.mapInArrow(_survivors, schema)
    return parts.groupBy("part", "good", "toxic").agg(*[F.sum(n).alias(n) for n in COUNTS.names])


#: (order, step, filter, subset before the step) of every order and step.
STEPS = [
    ("".join(order), i + 1, f, sum(1 << FILTERS.index(g) for g in order[:i]))
    for order in permutations(FILTERS)
    for i, f in enumerate(order)
]
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def audit_of(every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """All rows of a part, from the survivors of each subset among all, good and toxic documents."""
    removed = [int(every[before] - every[before | 1 << FILTERS.index(f)]) for _, _, f, before in STEPS]
    shapley = defaultdict(int)
    for (_, _, f, _), n in zip(STEPS, removed, strict=True):
        shapley[f] += n
    rows = []
    for (order, step, f, before), gone in zip(STEPS, removed, strict=True):
        bit = 1 << FILTERS.index(f)
        after = before | bit
        failing = int(every[0] - every[bit])
        rows.append(
            (
                order, step, int(every[after]), gone, failing - gone, int(every[ALL ^ bit] - every[ALL]),
                int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[f],
            )
        )
    return rows


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in AUDIT.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            found = audit_of(*(np.array(row[k]) for k in ("every", "of_good", "of_toxic")))
            columns = [[row["part"]] * len(found), *map(list, zip(*found, strict=True))]
            types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row for each part, order of the filters and step, zeros included; see ``survivors`` for nulls,
    repeated rows and the tables' columns. Very long texts are read whole, in blocks of words; an empty
    text has no words, so it fails A only (and E, if another is empty). No documents give no rows.
    """
    sums = [
        F.array(*[F.sum(F.when(condition, F.col(n)).otherwise(F.lit(0))) for n in COUNTS.names]).alias(name)
        for name, condition in (("every", F.lit(True)), ("of_good", F.col("good")), ("of_toxic", F.col("toxic")))
    ]
    return survivors(docs, labels).groupBy("part").agg(*sums).mapInArrow(_audits, AUDIT)
