"""Deduplication of repeated byte strings: the grouping of operator 3 (``repeats``) over bytes.

This is no suffix array and no prefix doubling: nothing is sorted by (rank, rank at an offset) and no ranks
are assigned anew. Anchors, about one in 35 bytes, are selected by their own content, so equal strings have
equal anchors. Their 32-byte grams are counted in a count-min sketch; runs that may be repeated are grouped by
the 128-bit hash of their content, then quarters of runs, last the exact 100 bytes of single
windows. What is known to be unique or repeated leaves between these steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import Units, byte_units, covered_units, repeated_windows, spans_by_doc
from .shared import small_batches

#: Bytes of a string that must repeat, and of the grams that are counted first.
THRESHOLD, FIRST_RANK = 100, 32


def suffix_array_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, carry: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, spans, kept_bytes``.

    Texts are UTF-8 bytes, null is empty. A byte goes when a string of ``threshold`` bytes that covers it
    also starts earlier: in a document with a smaller identifier, or in the same one further left;
    strings are judged on the input and never cross documents. ``spans`` are the maximal removed runs
    (start and end byte). A row without identifier loses nothing and makes nothing go; repeated rows are
    one document and lose the same bytes. Other columns are ignored; with ``carry`` they come along as
    the struct ``row``. An empty table gives no rows; a very long text is read whole, as one batch. Strings
    are equal by two 64-bit hashes.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    units = Units(byte_units, threshold, min(FIRST_RANK, threshold))
    spans = spans_by_doc(repeated_windows(slim.where("doc is not null"), units, own_repeats=True))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *row)
    joined = whole.join(spans, "doc", "left").drop("doc")
    kept = [f for f in joined.schema if f.name in ("doc_id", "row")]
    span = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = T.StructType(list(kept)).add("n_bytes", "long").add("n_removed", "long").add("spans", span).add("kept_bytes", "binary")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text"):
            n_removed, removed, texts = [], [], []
            for i, (found, sizes) in enumerate(zip(batch.column("starts"), batch.column("sizes"))):
                own = data[starts[i] : starts[i + 1]]
                if not found.is_valid:
                    n_removed.append(0)
                    removed.append([])
                    texts.append(own.tobytes())
                    continue
                gone = covered_units(np.array(found.as_py()), np.array(sizes.as_py()), threshold, len(own))
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                n_removed.append(int(gone.sum()))
                removed.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                texts.append(own[~gone].tobytes())
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(np.diff(starts), pa.int64()), pa.array(n_removed, pa.int64())]
            columns += [pa.array(removed, span_type), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(work, schema)
