"""Helpers of this subpackage: shared folders, written stages, batches of bytes and word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task hashes at once; a longer document is a batch of its own.
BATCH_BYTES = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder; Spark removes the files once they are unreachable."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each text starts (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What a Python worker keeps from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept_for(operator: str) -> dict:
    """What the worker keeps for tasks of ``operator``; what it kept for other operators goes, as one worker serves all."""
    for other, kept in _KEPT.items():
        if other != operator:
            kept.clear()
    return _KEPT.setdefault(operator, {})


def small_batches(
    batches: Iterator[pa.RecordBatch], text: str, operator: str = "", size: int | None = None
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text (``BATCH_BYTES``), with their bytes and text starts.

    The worker goes on with what it keeps for ``operator`` only.
    """
    kept_for(operator)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, starts = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(starts, starts[row] + (size or BATCH_BYTES))))
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
            row = end
    # A worker that waits for its next task holds nothing back.
    pa.default_memory_pool().release_unused()


def with_texts(batches: Iterator[pa.RecordBatch], text: str, name: str) -> Iterator[pa.RecordBatch]:
    """Batches of carried rows (a struct ``row``) with the rows' own ``text`` as column ``name``, not copied."""
    for batch in batches:
        yield batch.append_column(name, batch.column("row").field(text))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


#: Powers that a worker keeps, for batches of the usual size.
_POWERS: dict[int, np.ndarray] = {}
_KEPT_POWERS = BATCH_BYTES + 64


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    if n <= _KEPT_POWERS and base in _POWERS:
        return _POWERS[base][:n]
    out = np.full(max(n, _KEPT_POWERS), U64(base), dtype=np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    _POWERS[base] = out[:_KEPT_POWERS].copy() if n > _KEPT_POWERS else out
    return out[:n]


#: ASCII white space, the only separator of words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text (one more)."""
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of every word: a polynomial of its bytes, scrambled."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    length = end - begin
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    values = (data[np.repeat(begin, length) + at].astype(np.uint64) + U64(1)) * powers(base, int(length.max()))[at]
    return mix(np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64))


def run_hashes(items: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring items (``len(items) - n + 1`` of them)."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    prefix = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * powers(base, len(items)), out=prefix[1:])
    runs = prefix[n:] - prefix[:-n]
    return mix(runs * powers(inverse, len(runs)))


#: Odd multipliers of the hashes, fixed so that all tasks agree.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
