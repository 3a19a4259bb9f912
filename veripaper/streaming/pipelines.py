"""Streams that feed batch operators: validation, ingestion, alerts, daily counts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.alerts import build_alert_payloads
from ..operators.verdicts import validate_metadata
from ..sources.catalogues import normalize_catalogue


def read_folder(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _once(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read back, so that a micro-batch is worked out once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def validate_new_papers(
    papers: DataFrame, out: str, checkpoint: str, as_of: date, every: str | None = None
) -> StreamingQuery:
    """Metadata check of pending papers as they arrive, appended to ``out`` per batch.

    A batch writes to its own folder, so that a repeated batch replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        checked = validate_metadata(df.where("status = 'PENDING'"), as_of)
        checked.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(papers, batch, checkpoint, every)


def ingest_catalogue(
    spark: SparkSession,
    landed: str,
    source: str,
    out: str,
    checkpoint: str,
    import_batch: Callable[[DataFrame], DataFrame] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Landed catalogue records as papers; records without a title are set aside as errors."""
    raw = spark.readStream.text(landed)

    def batch(df: DataFrame, number: int) -> None:
        papers = _once(normalize_catalogue(df, source), f"{out}/read/batch={number}")
        good = papers.where(F.coalesce("title", F.lit("")) != "")
        kept = good if import_batch is None else import_batch(good)
        kept.write.mode("overwrite").parquet(f"{out}/papers/batch={number}")
        bad = papers.where(F.coalesce("title", F.lit("")) == "").select(F.col("metadata").alias("value"))
        bad.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return _start(raw, batch, checkpoint, every)


def alert_fanout(
    alerts: DataFrame,
    out: str,
    checkpoint: str,
    channels: list[str],
    deliver: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Alerts written to a table and, per enabled channel, as payloads; a failed delivery blocks nothing
    and is a row of ``failures``."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")
        stored = df.sparkSession.read.schema(df.schema).parquet(f"{out}/alerts/batch={number}")
        payloads = _once(build_alert_payloads(stored, channels), f"{out}/payloads/batch={number}")
        failures = []
        if deliver is not None:
            try:
                deliver(payloads, number)
            except Exception as error:  # noqa: BLE001
                failures.append((number, str(error)))
        log = df.sparkSession.createDataFrame(failures, "batch_number bigint, error string")
        log.write.mode("overwrite").parquet(f"{out}/failures/batch={number}")

    return _start(alerts, batch, checkpoint, every)


def daily_events(papers: DataFrame, refs: DataFrame, diagrams: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """What happened to the tables as ``(at, kind)``: papers created, validated or rejected, references invalid, diagrams suspicious.

    Reads papers ``created_at, validated_at, updated_at, status``, refs ``updated_at, status`` and diagrams
    ``updated_at, is_suspicious``. Each may be a table or a stream; each stream of events has its own
    watermark, ``lateness`` behind its latest one, and a day ends when the slowest has passed it.
    """
    c = F.col
    kinds = [
        (papers, "created_at", F.lit(True), "created"),
        (papers, "validated_at", c("status") == "VALIDATED", "validated"),
        (papers, "updated_at", c("status") == "REJECTED", "rejected"),
        (refs, "updated_at", c("status") == "INVALID", "invalid_refs"),
        (diagrams, "updated_at", c("is_suspicious"), "suspicious_diagrams"),
    ]
    events = []
    for table, at, condition, kind in kinds:
        rows = table.where(condition & c(at).isNotNull()).select(c(at).cast("timestamp").alias("at"), F.lit(kind).alias("kind"))
        events.append(rows.withWatermark("at", lateness) if table.isStreaming else rows)
    return reduce(DataFrame.unionByName, events)


def daily_counts(events: DataFrame) -> DataFrame:
    """Events of ``daily_events`` per day: ``day, created, validated, rejected, invalid_refs, suspicious_diagrams``.

    Works on a table and on a stream; a stream drops rows behind its watermark.
    """
    kinds = ["created", "validated", "rejected", "invalid_refs", "suspicious_diagrams"]
    counts: list[Column] = [F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds]
    return (
        events.groupBy(F.window("at", "1 day").alias("day"))
        .agg(*counts)
        .select(F.col("day.start").alias("day"), *kinds)
    )
