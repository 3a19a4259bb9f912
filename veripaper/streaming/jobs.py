"""Status of background jobs, folded from their event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_status(events: DataFrame) -> DataFrame:
    """Current state per job; the same fold works on a stream in update mode.

    A ``waiting`` event creates a job or starts it over; events of jobs without one are dropped.
    The last non-null progress after that counts, ``processed_on`` is the last activation,
    ``finished_on`` the last completion or failure. Only per-job maxima are kept, so that a busy
    job is folded before any exchange.
    """
    at = F.struct("ts", "seq")

    def last(condition: Column, *extra: str) -> Column:
        return F.max(F.when(condition, F.struct("ts", "seq", *extra)))

    folded = events.groupBy("job_id").agg(
        F.max(F.when(F.col("state") == "waiting", at)).alias("created"),
        last(F.col("state").isNotNull(), "state").alias("latest"),
        last(F.col("progress").isNotNull() & (F.col("state") != "waiting"), "progress").alias("progressed"),
        last(F.col("state") == "active").alias("activated"),
        last(F.col("state").isin("completed", "failed")).alias("ended"),
    )

    def since(column: str) -> Column:
        after = F.struct(F.col(f"{column}.ts").alias("ts"), F.col(f"{column}.seq").alias("seq")) > F.col("created")
        return F.coalesce(after, F.lit(False))

    return folded.where("created is not null").select(
        "job_id",
        F.col("latest.state").alias("state"),
        F.when(since("progressed"), F.col("progressed.progress")).otherwise(0.0).alias("progress"),
        F.col("created.ts").alias("created_on"),
        F.when(since("activated"), F.col("activated.ts")).alias("processed_on"),
        F.when(since("ended"), F.col("ended.ts")).alias("finished_on"),
    )


def purge_jobs(jobs: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Jobs without those that ended more than ``hours`` ago."""
    old = F.col("state").isin("completed", "failed") & (
        F.col("finished_on") < F.lit(as_of) - F.make_dt_interval(hours=F.lit(hours))
    )
    return jobs.where(~F.coalesce(old, F.lit(False)))
