"""Stored tables and their changes, as new tables: parquet has no in-place update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import latest_per_key


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """A table from files, or over ``jdbc`` with the usual options."""
    reader = spark.read.format(format).options(**options)
    return reader.load() if format == "jdbc" else reader.load(path)


def write_table(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "append", partition_by: list[str] | None = None
) -> None:
    writer = df.write.format(format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def upsert_hashes(store: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by ``file_path``; the newest ``created_at`` wins, then the new row."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(rows, ["file_path"], ["created_at", "_new"]).drop("_new")


def merge_refs(refs: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert on (paper_id, ord): an existing row keeps its id, and its verification if none is new."""
    values = [c for c in updates.columns if c not in ("paper_id", "ord", "ref_id", "verification")]
    marked = updates.withColumn("_update", F.lit(True)).alias("u")
    joined = refs.alias("r").join(marked, ["paper_id", "ord"], "full")
    taken = F.coalesce("u._update", F.lit(False))
    return joined.select(
        "paper_id",
        "ord",
        F.coalesce("r.ref_id", "u.ref_id").alias("ref_id"),
        *[F.when(taken, F.col(f"u.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in values],
        F.coalesce("u.verification", "r.verification").alias("verification"),
    )


def replace_diagrams(diagrams: DataFrame, new: DataFrame) -> DataFrame:
    """All diagrams of the papers in ``new`` give way to its rows."""
    touched = new.select("paper_id").distinct()
    return diagrams.join(touched, "paper_id", "left_anti").select(*diagrams.columns).unionByName(new)


def delete_papers(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the papers in ``ids``: papers and what hangs on them."""
    gone = ids.select("paper_id").distinct()
    return {name: df.join(gone, "paper_id", "left_anti") for name, df in tables.items()}


def patch_papers(papers: DataFrame, patch: DataFrame, fields: list[str]) -> DataFrame:
    """Changes only fields whose ``has_<field>`` flag is set: a present null differs from an absent field."""
    changes = patch.select(
        "paper_id", *[F.col(f"has_{f}") for f in fields], *[F.col(f).alias(f"new_{f}") for f in fields]
    )
    joined = papers.join(changes, "paper_id", "left")
    patched = {
        f: F.when(F.coalesce(f"has_{f}", F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields
    }
    return joined.withColumns(patched).select(*papers.columns)
