"""Language identification by cross-parsing against a suffix automaton for each language.

A text is parsed from left to right into the longest phrases that occur somewhere in the labelled
sample of a language. The sample that needs the fewest phrases, each weighted by the bits that point
into the sample, explains the text best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept_for, small_batches, with_texts

#: The labelled sample: documents for each language, letters taken from each of them, and from how many places.
SAMPLE_DOCS, SAMPLE_LETTERS, SAMPLE_PLACES = 200, 400, 4
#: A phrase ends after this many letters at the latest; segments are parsed side by side.
SEGMENT = 512
#: Letters of a language that have a column in its table; steps by rarer ones are searched in a sorted list.
ALPHABET = 255
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case letters; every run of other characters is one 0 (none at the start)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    return np.where(letter, points, 0)[kept]


class Automaton:
    """Suffix automaton of a sample as a table: row = state, column = letter code, -1 = no such substring.

    The last column stands for all letters without an own one: ``rare`` has their steps, sorted by state and code.
    """

    def __init__(self, sample: np.ndarray):
        points, counts = np.unique(sample, return_counts=True)
        points = points[np.argsort(-counts, kind="stable")]
        self.size = len(points)
        self.codes = np.full(0x110000, self.size, dtype=np.int32)
        self.codes[points] = np.arange(self.size)
        self.bits = np.log2(max(2, len(sample)))
        steps, link, length, last = [{}], [-1], [0], 0
        for code in self.codes[sample].tolist():
            last = _extended(steps, link, length, last, code)
        self.columns = min(self.size, ALPHABET)
        self.table = np.full((len(steps), self.columns + 1), -1, dtype=np.int32)
        self.root = np.zeros(self.size + 1, dtype=np.int32)
        rare = []
        for state, out in enumerate(steps):
            for code, to in out.items():
                if state == 0:
                    self.root[code] = to
                if code < self.columns:
                    self.table[state, code] = to
                else:
                    rare.append((state * (self.size + 1) + code, to))
        self.rare = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2)

    def _rare_steps(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        keys = state.astype(np.int64) * (self.size + 1) + code
        at = np.minimum(np.searchsorted(self.rare[:, 0], keys), len(self.rare) - 1)
        return np.where(self.rare[at, 0] == keys, self.rare[at, 1], -1)

    def phrases(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of every text; ``starts`` has where each text begins in ``points`` (one more)."""
        codes = self.codes[points]
        n_texts = len(starts) - 1
        length = np.diff(starts)
        pieces = -(-length // SEGMENT)
        owner = np.repeat(np.arange(n_texts), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[:-1][owner] + nth * SEGMENT
        size = np.minimum(SEGMENT, length[owner] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        width, root = self.columns + 1, self.root
        flat = self.table.ravel()
        state = np.zeros(len(begin), dtype=np.int32)
        found = np.zeros(len(begin), dtype=np.int32)
        active = np.searchsorted(-size, -np.arange(1, SEGMENT + 1), side="right")
        for step in range(int(size[0]) if len(size) else 0):
            n = active[step]
            code, old = codes[begin[:n] + step], state[:n]
            to = flat[old * width + np.minimum(code, self.columns)]
            if len(self.rare) and len(rare := np.flatnonzero((code >= self.columns) & (code < self.size))):
                to[rare] = self._rare_steps(old[rare], code[rare])
            stuck = to < 0
            found[:n] += stuck & (old > 0)
            state[:n] = np.where(stuck, root[code], to)
        found += state > 0
        total = np.bincount(owner[order], weights=found, minlength=n_texts)
        unknown = np.concatenate([[0], np.cumsum(root[codes] == 0)])
        return total + (unknown[starts[1:]] - unknown[starts[:-1]])


def _extended(steps: list[dict], link: list[int], length: list[int], last: int, code: int) -> int:
    """The state of the sample with ``code`` behind it; states are shared with what was read before."""
    known = steps[last].get(code)
    if known is not None and length[known] == length[last] + 1:
        return known
    if known is None:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and code not in steps[state]:
            steps[state][code] = new
            state = link[state]
        if state < 0:
            return new
        known = steps[state][code]
        if length[known] == length[state] + 1:
            link[new] = known
            return new
    else:
        new, state = -1, last
    copy = len(steps)
    steps.append(dict(steps[known]))
    link.append(link[known])
    length.append(length[state] + 1)
    while state >= 0 and steps[state].get(code) == known:
        steps[state][code] = copy
        state = link[state]
    link[known] = copy
    if new < 0:
        return copy
    link[new] = copy
    return new


def remainder(id_column: Column) -> Column:
    """crc32 of the identifier as text, modulo 4; null for a null identifier."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4))


def _letters_at_places(text: Column, id_column: Column) -> Column:
    """``SAMPLE_LETTERS`` letters of ``text``: one stretch at a place chosen by hash in each of its equal parts.

    A text with no more letters is taken whole. Runs of other characters are one space.
    """
    size = SAMPLE_LETTERS // SAMPLE_PLACES

    def stretch(letters: Column, nth: int) -> Column:
        part = F.floor(F.char_length(letters) / F.lit(SAMPLE_PLACES)).cast("int")
        place = F.pmod(F.xxhash64(id_column, F.lit(2 + nth)), (part - F.lit(size - 1)).cast("long")).cast("int")
        return F.substring(letters, part * nth + place + 1, F.lit(size))

    def chosen(letters: Column) -> Column:
        places = F.concat_ws(" ", *[stretch(letters, i) for i in range(SAMPLE_PLACES)])
        return F.when(F.char_length(letters) <= SAMPLE_LETTERS, letters).otherwise(places)

    return F.get(F.transform(F.array(F.trim(F.regexp_replace(text, r"\P{L}+", " "))), chosen), F.lit(0))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Text of each language for its automaton: ``SAMPLE_DOCS`` documents, ``SAMPLE_LETTERS`` of each,
    from places all over the text, so that a common header is not what is learnt.

    Documents are chosen by a hash of the identifier, those with remainder 2 are held out. What comes to
    the driver is bounded by these two numbers for each language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (remainder(F.col("id")) != 2)
    )
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // (4 * SAMPLE_DOCS)))])
    thinned = known.where(F.pmod(F.xxhash64("id"), shares[F.col("lang")]) == 0)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(1)), "id"))
    chosen = thinned.select("lang", "id", _letters_at_places(F.col("text"), F.col("id")).alias("text"))
    rows = chosen.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_DOCS).select("lang", "nth", "text").collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["nth"])):
        letters = letters_of(row["text"])
        samples.setdefault(row["lang"], []).append("".join(chr(c) if c else " " for c in letters.tolist()))
    return {lang: " ".join(texts) for lang, texts in samples.items()}


def _automata(samples: tuple[tuple[str, str], ...]) -> list[Automaton]:
    """Built once in each Python worker from the broadcast samples."""
    automata = kept_for("language_id")
    if samples not in automata:
        automata.clear()
        automata[samples] = [Automaton(letters_of(text)) for _, text in samples]
    return automata[samples]


def identified(texts: list[str | None], samples: tuple[tuple[str, str], ...]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text: the score is the share of the second best's phrases in both."""
    points = [letters_of(text or "") for text in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points], dtype=np.int64)]).astype(np.int64)
    empty = np.diff(starts) == 0
    if not samples or empty.all():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    together = np.concatenate(points)
    cost = np.stack([a.phrases(together, starts) * a.bits for a in _automata(samples)])
    best = cost.argmin(axis=0)
    ranked = np.sort(cost, axis=0)
    second = ranked[1] if len(ranked) > 1 else np.full(len(texts), np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(np.isinf(second), 1.0, second / (ranked[0] + second))
    names = [lang for lang, _ in samples]
    return [UNKNOWN if e else names[b] for e, b in zip(empty, best)], np.where(empty, 0.0, score)


def language_id(
    docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    ``samples`` are the texts of ``labelled_samples``. A text that is null or without a letter, and any
    text where there are no samples, is ``und`` with score 0. Among languages of equal cost the first by
    name wins. Repeated rows are predicted each; other columns are ignored, with ``carry`` they come along
    as the struct ``row``; a null identifier is not held out. An empty table gives no rows; a very long text is
    read whole, as one batch.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(sorted(samples.items())))
    # Carried rows bring their text along; it goes to the workers once.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col(f"`{text_col}`").alias("_text")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"),
        row,
    )
    schema = T.StructType([f for f in slim.schema if f.name != "_text"]).add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = with_texts(batches, text_col, "_text") if carry else batches
        for batch, _, _ in small_batches(batches, "_text", "language_id"):
            langs, score = identified(batch.column("_text").to_pylist(), shared.value)
            kept = [c for c in batch.schema.names if c != "_text"]
            columns = [batch.column(c) for c in kept] + [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return slim.mapInArrow(predict, schema)
