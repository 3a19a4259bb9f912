"""Substring deduplication over words, with a count-min prefilter (see ``repeats``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import Units, covered_units, repeated_windows, spans_by_doc, word_units
from .shared import small_batches, with_texts, word_spans

#: Words of a window, and words of the grams among which its anchor is chosen.
WINDOW, GRAM = 50, 25


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, carry: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes when a window of ``window`` words that covers it also
    starts in a document with a smaller identifier; windows are judged on the input. ``kept_text`` has the
    other words joined by one space. A null text has no words; a null identifier comes with no order, so
    such a row neither loses words nor makes others lose any; repeated rows are one document and lose the
    same words. Other columns are ignored; with ``carry`` they come along as the struct ``row``. An empty table
    gives no rows; a very long text is read whole, as one batch. Windows are equal by two 64-bit hashes.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    units = Units(word_units, window, gram)
    spans = spans_by_doc(repeated_windows(slim.where("doc is not null"), units, own_repeats=False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col(text_col).alias("text")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("doc"), row)
    joined = whole.join(spans, "doc", "left").drop("doc")
    kept = [f for f in joined.schema if f.name in ("doc_id", "row")]
    schema = T.StructType(list(kept)).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = with_texts(batches, text_col, "text") if carry else batches
        for batch, data, starts in small_batches(batches, "text"):
            begin, end, first = word_spans(data, starts)
            raw = data.tobytes()
            n_words, n_removed, texts = np.diff(first), [], []
            for i, (found, sizes) in enumerate(zip(batch.column("starts"), batch.column("sizes"))):
                a, b = begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
                if found.is_valid:
                    gone = covered_units(np.array(found.as_py()), np.array(sizes.as_py()), window, len(a))
                    n_removed.append(int(gone.sum()))
                    a, b = a[~gone], b[~gone]
                else:
                    n_removed.append(0)
                texts.append(b" ".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist())]).decode())
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(work, schema)
