"""Quality of texts by naive Bayes support vectors.

A text is the set of its n-grams: words and pairs of words, short byte strings, and runs of word shapes.
Each n-gram is scaled by the logarithm of the ratio of its frequencies in good and bad documents, counted
over all labelled documents; a linear hinge-loss model of the scaled indicators is fitted on a bounded
sample of them by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BASES, U64, mix, word_hashes, word_spans

#: N-grams are told apart by so many bits of their hash.
BITS = 18
SIZE = 1 << BITS
#: A longer text is read in pieces of so many bytes, which overlap by ``SHARED``.
PIECE, SHARED = 1 << 20, 256
#: The sample for the fit, for each label: rows at most, and characters at most.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 8_000_000
#: Smoothing of the counts, penalty of the hinge loss, passes of the descent, share of the fitted weights against their mean.
SMOOTHING, PENALTY, PASSES, SHARE = 1.0, 4.0, 20, 0.75
#: One point of margin multiplies the odds of a good text by ``exp(STEEPNESS)``.
STEEPNESS = 3.0

#: What a byte adds to the shape of its word.
_SHAPES = np.zeros(256, np.uint8)
_SHAPES[0x80:] = 1
for _bit, _characters in enumerate(
    ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "#$%&*+/<=>@[\\]^_`{|}~"]
):
    _SHAPES[list(_characters.encode())] |= 1 << _bit
_REPEATED = 1 << 7
#: Marks of the n-grams of the text in hand.
_SEEN = np.zeros(SIZE, bool)


#: An odd multiplier for each kind of n-gram; the high bits of the product are its hash.
_KINDS = mix(np.arange(1, 16, dtype=np.uint64)) | U64(1)


def _hashed(values: np.ndarray, kind: int) -> np.ndarray:
    return (values * _KINDS[kind] >> U64(64 - BITS)).astype(np.int64)


def _runs(items: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Each run of ``n`` small numbers as one."""
    runs = np.zeros(max(0, len(items) - n + 1), np.uint64)
    for i in range(n):
        runs = (runs << U64(bits)) | items[i : len(items) - n + 1 + i].astype(np.uint64)
    return runs


def _piece(data: np.ndarray) -> list[np.ndarray]:
    found, runs = [], data.astype(np.uint64)
    for n in (2, 3, 4):
        runs = (runs[:-1] << U64(8)) | data[n - 1 :]
        found.append(_hashed(runs, n))
    begin, end, _ = word_spans(data, np.array([0, len(data)]))
    if len(begin):
        words = word_hashes(data, begin, end, BASES[0])
        found.append(_hashed(words, 5))
        found.append(_hashed(words[:-1] * U64(BASES[1]) + words[1:], 6))
        shapes = np.bitwise_or.reduceat(_SHAPES[data], begin)
        shapes[1:] |= np.where(words[1:] == words[:-1], _REPEATED, 0).astype(np.uint8)
        found += [_hashed(_runs(shapes, n, 8), 6 + n) for n in (1, 2, 3)]
    return found


def ngrams(text: bytes) -> np.ndarray:
    """Numbers below ``SIZE`` of the n-grams of the text, each once, in order."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(data) - SHARED), PIECE - SHARED):
        for found in _piece(data[at : at + PIECE]):
            _SEEN[found] = True
    places = np.flatnonzero(_SEEN)
    _SEEN[places] = False
    return places.astype(np.int32)


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-count ratio of every n-gram; ``good`` and ``bad`` count the documents of a label that have it."""
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, costs: np.ndarray, size: int) -> np.ndarray:
    """Weights of the linear model with the least hinge loss ``costs * max(0, 1 - signs * (w x))`` plus half the square of ``w``.

    ``rows`` has the places and values of each sparse vector of length ``size``. One dual variable after
    the other moves to its best value between 0 and its cost, in an order that is drawn anew each pass.
    """
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    squares = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(12)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            if squares[i] == 0:
                continue
            slope = signs[i] * float(weights[at] @ values) - 1
            best = min(max(alpha[i] - slope / squares[i], 0.0), costs[i])
            step = best - alpha[i]
            if step:
                weights[at] += step * signs[i] * values
                alpha[i] = best
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


@dataclass(frozen=True)
class Model:
    """``weights`` already hold the ratios; a text's margin is their sum over its n-grams by its length, plus ``bias``."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        at = ngrams(text)
        length = float(self.squares[at].sum()) ** 0.5
        margin = self.bias + (float(self.weights[at].sum()) / length if length else 0.0)
        return 1 / (1 + float(np.exp(-STEEPNESS * np.clip(margin, -50, 50))))


def fitted(ratios: np.ndarray, sample: list[tuple[np.ndarray, bool]]) -> Model:
    """The model of a sample of (n-grams, good). Both labels weigh the same, whatever their numbers."""
    n_good = sum(good for _, good in sample)
    n_bad = len(sample) - n_good
    rows = []
    for at, _ in sample:
        values = ratios[at]
        length = float(values @ values) ** 0.5
        rows.append((np.append(at, SIZE), np.append(values / length if length else values, 1.0)))
    signs = np.array([1.0 if good else -1.0 for _, good in sample])
    costs = np.array([PENALTY * len(sample) / (2 * (n_good if good else n_bad)) for _, good in sample])
    weights = dual_coordinate_descent(rows, signs, costs, SIZE + 1)
    used = weights[:SIZE]
    mean = float(np.abs(used).sum()) / max(1, int((used != 0).sum()))
    mixed = SHARE * used + (1 - SHARE) * mean * np.sign(used)
    return Model(mixed * ratios, ratios**2, float(weights[SIZE]))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many good and bad documents of the task have each n-gram."""
    counts = np.zeros((2, SIZE), np.int64)
    for batch in batches:
        for text, good in zip(_texts(batch), batch.column("good").to_pylist(), strict=True):
            counts[int(good)][ngrams(text)] += 1
    found = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(found), 1 << 14):
        part = found[at : at + (1 << 14)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(counts[1][part]), pa.array(counts[0][part])], names=["ngram", "good", "bad"]
        )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(_texts(batch)):
            found = pa.ListArray.from_arrays(pa.array([0, len(at := ngrams(text))], pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("doc_id", "good")), found], names=["doc_id", "good", "ngrams"])


def sampled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, good, text`` of the first ``SAMPLE_ROWS`` identifiers of each label by hash, as far as ``SAMPLE_CHARS`` reaches.

    An identifier with several texts counts with the longest and gives the least of them.
    """
    lengths = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("length"))
    rows = lengths.join(marks, "doc_id")
    for parts in (["good", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))], ["good"]):
        order = Window.partitionBy(*parts).orderBy(F.xxhash64("doc_id"), "doc_id")
        rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_ROWS)
    reached = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = rows.withColumn("reached", reached).where((F.col("reached") <= SAMPLE_CHARS) | (F.col("nth") == 1))
    # At most 2 * SAMPLE_ROWS rows.
    found = docs.join(F.broadcast(chosen.select("doc_id", "good")), "doc_id")
    return found.groupBy("doc_id", "good").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """The model of the labels of the documents that ``learn`` admits; see ``quality_scores`` for the tables.

    Counts come from all of those documents, the fit from ``sampled`` ones. The sample is fitted in one
    task. With one label alone its constant is returned, without labels a model that is undecided.
    """
    docs = docs.where(learn).where("doc_id is not null").select("doc_id", "text")
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    # Both sides are shuffled at every size, so that small and large tables run alike.
    counts = docs.join(marks.hint("merge"), "doc_id").select("text", "good").mapInArrow(_counted, "ngram int, good long, bad long")
    table = counts.groupBy("ngram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    good, bad = np.zeros(SIZE), np.zeros(SIZE)
    at = table.column("ngram").to_numpy()
    good[at], bad[at] = table.column("good").to_numpy(), table.column("bad").to_numpy()
    ratios = log_ratios(good, bad)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            found = batch.column("ngrams")
            for i, (doc, label) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("good").to_pylist(), strict=True)):
                rows.append((doc, label, found[i].values.to_numpy(zero_copy_only=False)))
        rows.sort(key=lambda r: r[0])
        if len({r[1] for r in rows}) == 2:
            model = fitted(ratios, [(ngrams_of, label) for _, label, ngrams_of in rows])
        else:
            model = Model(np.zeros(SIZE), np.ones(SIZE), 1e9 * (2 * rows[0][1] - 1) if rows else 0.0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.squares)] + [pa.array([model.bias])],
            names=["weights", "squares", "bias"],
        )

    described = sampled(docs, marks).mapInArrow(_described, "doc_id long, good boolean, ngrams array<int>")
    row = described.repartition(1).mapInArrow(fit, "weights binary, squares binary, bias double").collect()[0]
    return Model(np.frombuffer(row["weights"]), np.frombuffer(row["squares"]), row["bias"])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row for each row of ``docs``, learned from rows that are not held out.

    ``docs`` has ``doc_id, text``, ``labels`` has ``doc_id, quality`` (0 or 1; other values are no label,
    and of several the highest counts); other columns are ignored and nothing but the text enters a score.
    ``held_out`` is a condition on ``doc_id``. A null text is empty; empty texts have no n-gram and get the
    model's constant. Rows without an identifier teach nothing. Repeated rows are counted as often as they
    stand and scored alike. Very long texts are read whole, in overlapping pieces. No documents give no rows.
    """
    model = quality_model(docs, labels, ~held_out)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(text) for text in _texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    found = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
