"""Helpers that keep wide jobs safe on a cluster: lineage cuts and salted joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in that folder, which takes far less of the disk than rows of :func:`cut_lineage`."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(
    big: DataFrame,
    unique: DataFrame,
    keys: list[str],
    spread: list[Column],
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Join in which one key may hold a large share of ``big``.

    ``unique`` has one row per key. Rows of ``big`` spread over ``salts`` sub-keys by the hash of
    ``spread`` (a stable row identity, so that a lost task recomputes the same rows) and each row
    of ``unique`` is repeated once per sub-key.
    """
    salt = "_salt"
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = unique.withColumn(
        salt, F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    )
    return salted.join(repeated, [*keys, salt], how).drop(salt)


Columns = dict[str, np.ndarray]


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a group of equal keys, nulls included, begins in sorted rows."""
    first = np.zeros(rows.num_rows, dtype=bool)
    first[:1] = True
    for key in keys:
        column = rows.column(key).combine_chunks()
        a, b = column.slice(0, max(rows.num_rows - 1, 0)), column.slice(1)
        changed = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        first[1:] |= changed.to_numpy(zero_copy_only=False)
    return np.flatnonzero(first)


def map_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    work: Callable[[Columns, np.ndarray], tuple[np.ndarray, Columns]],
    schema: str,
) -> DataFrame:
    """``work`` on the columns of many groups of ``keys`` at once, rows sorted by ``order``, nulls last.

    ``work`` gets the columns that are not keys and where each group begins, and gives the number of rows of
    each group and columns that are not keys; the keys are put in front as Arrow values, so that they keep
    their type and value, nulls included. Groups that are whole in a batch are worked on together, so that
    small groups cost no call each; a group that goes on is kept until its end.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def worked(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        starts = _starts(rows, keys)
        counts, out = work({n: rows.column(n).to_numpy() for n in rows.column_names if n not in keys}, starts)
        columns = {k: rows.column(k).take(pa.array(np.repeat(starts, counts))) for k in keys}
        columns |= {c: pa.array(v, types.field(c).type) for c, v in out.items()}
        return pa.Table.from_arrays([columns[f.name].cast(f.type) for f in types], schema=types).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_starts(pa.Table.from_batches([batch]), keys)[-1])
            if open_rows:
                seam = [open_rows[-1].slice(open_rows[-1].num_rows - 1), batch.slice(0, 1)]
                if not last and len(_starts(pa.Table.from_batches(seam), keys)) == 1:
                    open_rows.append(batch)
                    continue
            if open_rows or last:
                yield from worked([*open_rows, batch.slice(0, last)])
            open_rows = [batch.slice(last)]
        if open_rows:
            yield from worked(open_rows)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order])
    return ordered.mapInArrow(run, schema)
