"""Exact top-k search by inner product over a vector-approximation file.

The file has one byte for each component: the number of the cell of a grid that spans what the component
takes on in all vectors. A scan of the cells bounds every inner product from both sides; vectors whose
upper bound is below the k-th best lower bound are out. The others are read exactly, the most promising
first, until the k-th result is certain.

Queries and vectors meet block by block: a block of vectors goes to each block of queries, and no task
holds more than one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Cells of a component, vectors of a block, queries of a block, blocks that share a copy of the queries.
CELLS, VECTORS, QUERIES, SHARED = 256, 2048, 1024, 4


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v``: ``floor(scale * x)`` of all components; without rows that take no part."""
    v = F.col("raw")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw"))
    valid = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    return valid.select("id", F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")).distinct()


def _blocks(rows: DataFrame, name: str, size: int, n: int) -> DataFrame:
    """Rows ``dim, <name>, ids, values`` of about ``size`` vectors, dealt by a hash of the identifier."""
    count = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("id"), F.lit(count)).alias(name)
    grouped = rows.select(F.size("v").alias("dim"), block, "id", "v").groupBy("dim", name).agg(
        F.collect_list(F.struct("id", "v")).alias("rows")
    )
    return grouped.select("dim", name, F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("values"))


def _grid(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension of vectors the least value and the cell width of every component."""
    spans = (
        rows.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "x"))
        .groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    )
    grid: dict[int, list] = {}
    for r in sorted(spans, key=lambda r: (r["dim"], r["at"])):
        grid.setdefault(r["dim"], []).append((float(r["low"]), max(1.0, (r["high"] - r["low"] + 1) / CELLS)))
    return {dim: (np.array([x[0] for x in cells]), np.array([x[1] for x in cells])) for dim, cells in grid.items()}


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle of the possible inner products for every query and cell row, and how far off each query may be.

    A value lies within half a width of the middle of its cell; the last terms cover rounding.
    """
    middle = queries @ (low + (cells + 0.5) * width).T
    reach = np.abs(queries) @ (width / 2)
    return middle, reach + 1 + 1e-9 * (np.abs(queries) @ (np.abs(low) + CELLS * width))


def top_k_search(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other vectors of every row that ``is_query``.

    ``is_query`` is a condition on ``id``. The score is the integer inner product of ``floor(scale * x)``; ties
    go to the smaller identifier, fewer than ``k`` others give fewer rows. Vectors that are null or empty, or
    hold a null or a value that is not finite, and rows without identifier take no part; only vectors of one
    dimension are compared; repeated rows count once. Products must fit in 53 bits.
    An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, id_col, vector_col, scale))
    n = rows.count()
    grid = spark.sparkContext.broadcast(_grid(rows))
    # Of equal vectors only the first k + 1 can be among any query's k best.
    copies = Window.partitionBy("v").orderBy("id")
    stored = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).select("id", "v")
    queries = rows.where(is_query)
    n_query_blocks = max(1, -(-queries.count() // QUERIES))
    salts = max(1, -(-n // (VECTORS * SHARED)))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = []
            for dim, values in zip(batch.column("dim").to_pylist(), batch.column("values")):
                low, width = grid.value[dim]
                exact = np.asarray(values.values).reshape(-1, dim)
                coded.append(np.minimum(CELLS - 1, (exact - low) // width).astype(np.uint8).tobytes())
            columns = [batch.column(c) for c in ("dim", "block", "ids")] + [pa.array(coded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "block", "ids", "cells"])

    file = _blocks(stored, "block", VECTORS, n).mapInArrow(to_cells, "dim int, block long, ids array<long>, cells binary")
    dealt = file.select(
        "*", F.pmod("block", F.lit(salts)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("part")
    )
    asked = _blocks(queries, "part", QUERIES, n_query_blocks * QUERIES).select(
        "dim", F.col("part").cast("int").alias("part"), F.col("ids").alias("query_ids"), F.col("values").alias("query_values"),
        F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                low, width = grid.value[dim]
                asked_ids = np.asarray(batch.column("query_ids")[i].values)
                wanted = np.asarray(batch.column("query_values")[i].values).reshape(-1, dim).astype(np.float64)
                ids = np.asarray(batch.column("ids")[i].values)
                cells = np.frombuffer(batch.column("cells")[i].as_buffer(), np.uint8).reshape(-1, dim)
                middle, reach = bounds(wanted, cells, low, width)
                middle[asked_ids[:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:
                    kth = np.partition(middle, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    kth = np.full(len(middle), -np.inf)
                q, v = np.nonzero((middle + 2 * reach[:, None] >= kth[:, None]) & np.isfinite(middle))
                columns = [asked_ids[q], ids[v], middle[q, v] - reach[q], middle[q, v] + reach[q]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "least", "most"])

    joined = dealt.join(asked, ["dim", "part", "salt"]).select("dim", "query_ids", "query_values", "ids", "cells")
    found = written(joined.mapInArrow(scan, "query_id long, vec_id long, least double, most double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("least"))
    kth = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).groupBy("query_id").agg(
        F.min("least").alias("floor"), F.count(F.lit(1)).alias("n")
    )
    open_pairs = found.join(kth, "query_id").where((F.col("n") < k) | (F.col("most") >= F.col("floor"))).select("query_id", "vec_id", "most")
    exact = open_pairs.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(
        queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id"
    ).select("query_id", "most", "vec_id", "q", "v")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores in the order of the upper bounds; a query is done when the k-th score exceeds the next bound."""
        query, scores, done = None, [], False
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for i, (q, most, vec) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("query_id", "most", "vec_id")])):
                if q != query:
                    query, scores, done = q, [], False
                if done:
                    continue
                if len(scores) == k and min(scores) > most:
                    done = True
                    continue
                score = int(np.dot(np.asarray(batch.column("q")[i].values), np.asarray(batch.column("v")[i].values)))
                out.append((q, vec, score))
                scores = sorted([*scores, score], reverse=True)[:k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"]
            )

    ordered = exact.repartition("query_id").sortWithinPartitions("query_id", F.desc("most"), "vec_id")
    scored = ordered.mapInArrow(read, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
