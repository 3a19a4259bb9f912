"""Streams give what their batch forms give; quotas against a plain walk."""

import json
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from veripaper.plans.streams import read_stream, run_to_table
from veripaper.streaming import jobs as J
from veripaper.streaming import pipelines as L
from veripaper.streaming import quotas as Q


def walk(rows, limit, seconds):
    state, out = {}, {}
    for req, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        reset, used = state.get(key, (datetime.min, 0))
        if ts > reset:
            reset, used = ts + timedelta(seconds=seconds), 0
        out[req] = (used < limit, reset)
        state[key] = (reset, used + 1)
    return out


def requests(spark, n=900):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    # Key 1 holds most rows, some at the very same moment or exactly at a reset.
    rows = [(i, 1 if rng.random() < 0.7 else rng.randint(2, 5), start + timedelta(minutes=rng.randint(0, 6000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "req_id long, client_key long, ts timestamp_ntz")


def test_quota_batch(spark):
    rows, df = requests(spark)
    for limit, seconds, block in ((3, 3600, 24), (2, 600, 1), (5, 7200, 2)):
        got = {r.req_id: (r.allowed, r.reset_at) for r in Q.quota_labels(df, limit, seconds, block).collect()}
        assert got == walk(rows, limit, seconds)


def test_quota_keys_keep_their_value(spark):
    start = datetime(2024, 1, 1)
    keys = [None, 2**53, 2**53 + 1, None]
    rows = [(i, keys[i % 4], start + timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "req_id long, client_key long, ts timestamp_ntz")
    got = {r.req_id: (r.client_key, r.allowed) for r in Q.quota_labels(df, 3, 3600, 2).collect()}
    want = walk(rows, 3, 3600)
    assert got == {req: (key, want[req][0]) for req, key, _ in rows}


def test_quota_stream(spark, tmp_path):
    rows, df = requests(spark, 300)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = L.read_folder(spark, str(tmp_path / "in"), df.schema)
    got = {r.req_id: r.allowed for r in run_to_table(Q.quota_stream(stream, 3, 3600), spark).collect()}
    assert got == {k: v[0] for k, v in walk(rows, 3, 3600).items()}


def test_job_status_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    log = [("a", "waiting", None), ("a", "active", 5.0), ("b", "active", 1.0), ("a", "completed", None), ("c", "waiting", None),
           ("c", "failed", 7.0), ("c", "waiting", None)]
    rows = [(job, i, start + timedelta(hours=i), state, p) for i, (job, state, p) in enumerate(log)]
    df = spark.createDataFrame(rows, "job_id string, seq long, ts timestamp_ntz, state string, progress double")
    batch = {r.job_id: r for r in J.job_status(df).collect()}
    assert set(batch) == {"a", "c"}
    assert (batch["a"].state, batch["a"].progress, batch["a"].finished_on) == ("completed", 5.0, start + timedelta(hours=3))
    assert (batch["c"].state, batch["c"].progress, batch["c"].finished_on) == ("waiting", 0.0, None)
    kept = J.purge_jobs(J.job_status(df), start + timedelta(hours=28))
    assert [r.job_id for r in kept.collect()] == ["c"]
    df.write.parquet(str(tmp_path / "in"))
    stream = J.job_status(L.read_folder(spark, str(tmp_path / "in"), df.schema))
    done = stream.writeStream.format("memory").queryName("jobs").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination()
    assert {tuple(r) for r in spark.table("jobs").collect()} == {tuple(r) for r in batch.values()}


def test_daily_counts_stream(spark, tmp_path):
    days = [datetime(2024, 1, d, 5) for d in (1, 2, 3)]
    papers = [(t, t if i else None, t + timedelta(days=1), s) for t in days for i, s in enumerate(("VALIDATED", "VALIDATED", "REJECTED"))]
    tables = {
        "papers": (papers, "created_at timestamp_ntz, validated_at timestamp_ntz, updated_at timestamp_ntz, status string"),
        "refs": ([(days[0], "INVALID"), (days[0], "VALID")], "updated_at timestamp_ntz, status string"),
        "diagrams": ([(days[2], True), (days[2], False)], "updated_at timestamp_ntz, is_suspicious boolean"),
    }
    frames = {name: spark.createDataFrame(*table) for name, table in tables.items()}
    batch = {(r.day.day, *tuple(r)[1:]) for r in L.daily_counts(L.daily_events(*frames.values())).collect()}
    assert batch == {(1, 3, 1, 0, 1, 0), (2, 3, 1, 1, 0, 0), (3, 3, 1, 1, 0, 1), (4, 0, 0, 1, 0, 0)}
    for name, df in frames.items():
        df.repartition(1).write.parquet(str(tmp_path / name))
    streams = [L.read_folder(spark, str(tmp_path / name), df.schema) for name, df in frames.items()]
    counts = L.daily_counts(L.daily_events(*streams))
    done = counts.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination()
    assert {(r.day.day, *tuple(r)[1:]) for r in spark.table("days").collect()} == batch


def test_fanout_and_ingest(spark, tmp_path):
    alerts = spark.sql(
        "select id as alert_id, 'PAPER_REJECTED' as type, 'INFO' as severity, 'T' as title, 'M' as message,"
        " timestamp_ntz '2024-01-01 00:00:00' as created_at from range(3)"
    )
    alerts.write.parquet(str(tmp_path / "alerts"))
    stream = L.read_folder(spark, str(tmp_path / "alerts"), alerts.schema)

    def failing(payloads, number):
        raise RuntimeError("channel down")

    out = str(tmp_path / "out")
    L.alert_fanout(stream, out, str(tmp_path / "cp1"), ["slack", "email"], failing).awaitTermination()
    assert spark.read.parquet(f"{out}/alerts").count() == 3
    assert spark.read.parquet(f"{out}/payloads").count() == 6
    assert [r.error for r in spark.read.parquet(f"{out}/failures").collect()] == ["channel down"]

    (tmp_path / "landed").mkdir()
    records = [{"id": "1", "title": "A"}, {"id": "2"}]
    (tmp_path / "landed" / "a.json").write_text("\n".join(map(json.dumps, records)))
    L.ingest_catalogue(spark, str(tmp_path / "landed"), "openalex", out, str(tmp_path / "cp2")).awaitTermination()
    assert [r.title for r in spark.read.parquet(f"{out}/papers").collect()] == ["A"]
    assert spark.read.parquet(f"{out}/errors").count() == 1


def test_validate_new_papers(spark, tmp_path):
    papers = spark.createDataFrame(
        [(1, "A good long title", None, 2020, "V", "PENDING", 1), (2, "", None, 2020, "V", "PENDING", 1), (3, "x", None, 2020, "V", "VALIDATED", 1)],
        "paper_id long, title string, doi string, year int, venue string, status string, n_authors int",
    )
    papers.write.parquet(str(tmp_path / "in"))
    stream = L.read_folder(spark, str(tmp_path / "in"), papers.schema)
    L.validate_new_papers(stream, str(tmp_path / "out"), str(tmp_path / "cp"), date(2024, 1, 1)).awaitTermination()
    rows = {r.paper_id: r.is_valid for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1: True, 2: False}


def test_read_stream_of_part_files(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "parts.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "single.parquet")
    for name, n in (("parts", 100), ("single", 7)):
        got = run_to_table(read_stream(spark, str(tmp_path), name), spark)
        assert sorted(r.id for r in got.collect()) == list(range(n))
