"""Queries on quotas, job states and daily counts, as batches and as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import shared_folder
from ..streaming import jobs as J
from ..streaming import pipelines as L
from ..streaming import quotas as Q
from . import bindings as B
from . import sql_text as S
from .oracle_views import with_views
from .papers import AS_OF as TODAY
from .registry import query


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's table and checkpoint, in the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table as a stream of its file, or of the part files of its folder."""
    reader = spark.readStream.schema(B.table(spark, folder, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """The stream run over all data that is there, its rows read back from a table."""
    folder = work_folder(spark)
    schema = stream.schema
    done = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/table")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    done.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/table")


WINDOWS = (
    "rec_windows",
    """select client_key, min(ts) as start from requests_v group by client_key
       union all
       select w.client_key, min(r.ts) from rec_windows w join requests_v r on r.client_key = w.client_key
         and r.ts > w.start + interval {hours} hour group by w.client_key, w.start""",
)


def label_ctes(limit: int, hours: int) -> list[tuple[str, str]]:
    return [
        (WINDOWS[0], WINDOWS[1].format(hours=hours)),
        (
            "placed",
            """select r.req_id, r.client_key, r.ts, max(w.start) as start from requests_v r join rec_windows w
               on w.client_key = r.client_key and w.start <= r.ts group by 1, 2, 3""",
        ),
        (
            "labels",
            f"""select req_id, client_key, ts, nth <= {limit} as allowed, greatest({limit} - nth, 0) as remaining,
                 start + interval {hours} hour as reset_at from (
               select *, row_number() over (partition by client_key, start order by ts, req_id) as nth from placed)""",
        ),
    ]


@query(
    "t1_quota_labels",
    with_views(["requests_v"], "select req_id, allowed, remaining, reset_at from labels", *label_ctes(3, 168)),
)
def quota_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = Q.quota_labels(B.requests_v(spark, folder), limit=3, window_seconds=168 * 3600, block_windows=2)
    return labels.select("req_id", "allowed", F.col("remaining").cast("bigint").alias("remaining"), "reset_at")


@query(
    "t1_quota_labels_hourly",
    with_views(["requests_v"], "select req_id, allowed, remaining, reset_at from labels", *label_ctes(10, 1)),
)
def quota_labels_hourly(spark: SparkSession, folder: str) -> DataFrame:
    labels = Q.quota_labels(B.requests_v(spark, folder))
    return labels.select("req_id", "allowed", F.col("remaining").cast("bigint").alias("remaining"), "reset_at")


@query(
    "t1_x3_quota_stream",
    with_views(["requests_v"], "select req_id, allowed, remaining from labels", *label_ctes(3, 168)),
)
def quota_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = read_stream(spark, folder, "events")
    requests = events.selectExpr("event_id as req_id", "user_id as client_key", "ts")
    labelled = run_to_table(Q.quota_stream(requests, limit=3, window_seconds=168 * 3600), spark)
    return labelled.select("req_id", "allowed", F.col("remaining").cast("bigint").alias("remaining"))


AS_OF = datetime(2024, 1, 16, 12, 0, 0)


@query(
    "t2_quota_snapshot",
    with_views(
        ["requests_v"],
        """select client_key, case when timestamp '2024-01-16 12:00:00' > reset_at then 0 else used end as used,
             3 - case when timestamp '2024-01-16 12:00:00' > reset_at then 0 else used end as remaining
           from (select client_key, reset_at, count(*) filter (allowed) as used from labels where ts <= timestamp '2024-01-16 12:00:00'
             group by client_key, reset_at) qualify row_number() over (partition by client_key order by reset_at desc) = 1""",
        *label_ctes(3, 168),
    ),
)
def quota_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    labels = Q.quota_labels(B.requests_v(spark, folder), limit=3, window_seconds=168 * 3600, block_windows=2)
    return Q.quota_snapshot(labels, AS_OF, limit=3)


@query(
    "t3_live_quotas",
    with_views(
        ["requests_v"],
        """select distinct client_key, reset_at from labels where ts <= timestamp '2024-01-16 12:00:00'
           and reset_at >= timestamp '2024-01-16 12:00:00'""",
        *label_ctes(3, 168),
    ),
)
def live_quotas(spark: SparkSession, folder: str) -> DataFrame:
    labels = Q.quota_labels(B.requests_v(spark, folder), limit=3, window_seconds=168 * 3600, block_windows=2)
    windows = labels.where(F.col("ts") <= F.lit(AS_OF)).select("client_key", "reset_at").distinct()
    return Q.live_quotas(windows, AS_OF)


JOBS = [
    ("created", "select job_id, max({'ts': ts, 'seq': seq}) as c from job_events_v where state = 'waiting' group by job_id"),
    (
        "since",
        """select e.*, c.c.ts as created_on from job_events_v e join created c on c.job_id = e.job_id
           and {'ts': e.ts, 'seq': e.seq} >= c.c""",
    ),
    (
        "jobs",
        """select job_id, arg_max(state, {'ts': ts, 'seq': seq}) as state,
             coalesce(arg_max(progress, {'ts': ts, 'seq': seq}) filter (progress is not null and state <> 'waiting'), 0.0) as progress,
             min(created_on) as created_on, max(ts) filter (state = 'active') as processed_on,
             max(ts) filter (state in ('completed', 'failed')) as finished_on
           from since group by job_id""",
    ),
]


@query("t4_job_status", with_views(["job_events_v"], "select * from jobs", *JOBS))
def job_status(spark: SparkSession, folder: str) -> DataFrame:
    return J.job_status(B.job_events_v(spark, folder))


@query(
    "t5_purge_jobs",
    with_views(
        ["job_events_v"],
        """select job_id, state from jobs where not coalesce(state in ('completed', 'failed')
           and finished_on < timestamp '2024-01-30 00:00:00' - interval 24 hour, false)""",
        *JOBS,
    ),
)
def purge_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return J.purge_jobs(J.job_status(B.job_events_v(spark, folder)), datetime(2024, 1, 30)).select("job_id", "state")


DAILY_SQL = """
    with e as (
        select o_orderdate as moment, 'created' as kind from orders
        union all select o_orderdate + (o_orderkey % 50) * interval '1 hour', 'validated' from orders where o_orderstatus = 'F'
        union all select o_orderdate + interval '30 hours', 'rejected' from orders where o_orderstatus = 'O'
        union all select l_shipdate, 'invalid_refs' from lineitem where l_returnflag = 'R'
        union all select ts, 'suspicious_diagrams' from events where event_type = 'purchase')
    select date_trunc('day', moment)::timestamp as day, count(*) filter (kind = 'created') as created,
           count(*) filter (kind = 'validated') as validated, count(*) filter (kind = 'rejected') as rejected,
           count(*) filter (kind = 'invalid_refs') as invalid_refs, count(*) filter (kind = 'suspicious_diagrams') as suspicious_diagrams
    from e group by 1
"""


def daily_tables(read: Callable[[str], DataFrame]) -> DataFrame:
    """Orders as papers, line items as references and events as diagrams, each with the times of its changes."""
    papers = read("orders").selectExpr(
        "o_orderdate as created_at",
        "o_orderdate + make_dt_interval(0, cast(o_orderkey % 50 as int)) as validated_at",
        "o_orderdate + interval 30 hours as updated_at",
        "case o_orderstatus when 'F' then 'VALIDATED' when 'O' then 'REJECTED' else 'PENDING' end as status",
    )
    refs = read("lineitem").selectExpr("l_shipdate as updated_at", "if(l_returnflag = 'R', 'INVALID', 'VALID') as status")
    diagrams = read("events").selectExpr("ts as updated_at", "event_type = 'purchase' as is_suspicious")
    return L.daily_events(papers, refs, diagrams)


ALERT_COLUMNS = [
    "event_id as alert_id",
    "case event_type when 'signup' then 'PAPER_VALIDATED' when 'view' then 'PAPER_REJECTED' when 'click' then 'INVALID_REFERENCE' "
    "when 'purchase' then 'SUSPICIOUS_DIAGRAM' else 'VALIDATION_ERROR' end as type",
    "case event_id % 4 when 0 then 'INFO' when 1 then 'WARNING' when 2 then 'ERROR' else 'CRITICAL' end as severity",
    "concat('Alert ', event_id) as title",
    "props as message",
    "ts as created_at",
]


@query("t8_daily_counts", DAILY_SQL)
def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = L.daily_counts(daily_tables(lambda name: B.table(spark, folder, name)))
    return counts.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "t6_validate_new_papers",
    with_views(
        ["papers_v"],
        f"""select paper_id, len(errors) = 0 as is_valid, array_to_string(errors, '; ') as errors from (
              select paper_id, list_filter([
                case when title is null or {S.strip('title')} = '' then 'Title is required' end,
                case when paper_id % 3 = 0 then 'At least one author is required' end,
                case when 2000 + paper_id % 30 > {TODAY.year + 1} then concat('Invalid publication year: ', 2000 + paper_id % 30) end],
                lambda e: e is not null) as errors
              from papers_v where paper_id % 4 = 0)""",
    ),
)
def validate_new_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents streamed as papers through the metadata check."""
    papers = read_stream(spark, folder, "documents").selectExpr(
        "doc_id as paper_id", f"{B.TITLE} as title", "cast(null as string) as doi", "cast(2000 + doc_id % 30 as int) as year",
        "source as venue", "if(doc_id % 4 = 0, 'PENDING', 'VALIDATED') as status", "cast(doc_id % 3 as int) as n_authors",
    )
    work = work_folder(spark)
    L.validate_new_papers(papers, f"{work}/out", f"{work}/checkpoint", TODAY).awaitTermination()
    checked = spark.read.parquet(f"{work}/out")
    return checked.select("paper_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query("t8_daily_counts_stream", DAILY_SQL)
def daily_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of three streams of changes, all days after each micro-batch; the last state is read back."""
    work = work_folder(spark)

    def keep(days: DataFrame, number: int) -> None:
        days.write.mode("overwrite").parquet(f"{work}/days")

    counts = L.daily_counts(daily_tables(lambda name: read_stream(spark, folder, name)))
    schema = counts.schema
    query = counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{work}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{work}/days").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "t9_alert_fanout",
    with_views(
        ["alerts_v"],
        "select channel, type, count(*) as n from alerts_v cross join (select unnest(['slack', 'email']) as channel) group by all",
    ),
)
def alert_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts that a stream has stored, for each channel whose payloads it wrote, by type."""
    alerts = read_stream(spark, folder, "events").selectExpr(*ALERT_COLUMNS)
    work = work_folder(spark)
    L.alert_fanout(alerts, f"{work}/out", f"{work}/checkpoint", ["slack", "email"]).awaitTermination()
    payloads = spark.read.parquet(f"{work}/out/payloads").select("channel", "alert_id")
    stored = spark.read.parquet(f"{work}/out/alerts").select("alert_id", "type")
    return payloads.join(stored, "alert_id").groupBy("channel", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t10_ingest_catalogue",
    with_views(["papers_v"], "select title, count(*) as n from papers_v where coalesce(title, '') <> '' group by title"),
)
def ingest_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Papers landed as records of a catalogue and read by a stream, counted by title."""
    record = "to_json(named_struct('id', concat('W', paper_id), 'title', title, 'doi', doi, 'publication_year', year)) as value"
    work = work_folder(spark)
    B.papers_v(spark, folder).selectExpr(record).write.text(f"{work}/landed")
    L.ingest_catalogue(spark, f"{work}/landed", "openalex", f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out/papers").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
