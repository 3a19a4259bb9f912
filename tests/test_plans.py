"""Plans are what they should be at scale."""

import pytest
from pyspark.sql import functions as F

from veripaper.functions.scale import salted_join
from veripaper.operators import diagrams as D
from veripaper.operators import duplicates as U
from veripaper.plans import all_queries
from veripaper.plans import bindings as B

QUERIES = all_queries()
# One-row sides only: counts of whole tables, and statistics put side by side.
ONE_ROW_SIDES = {"a11_daily_summary"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_text_rules(spark, folder):
    for name in QUERIES:
        if name.startswith(("f", "j", "p", "a", "o", "u", "w")) and not name.startswith("flagship"):
            text = plan(QUERIES[name](spark, folder))
            assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


@pytest.mark.parametrize(
    "name", ["j5_duplicate_by_title", "j16_suspicious_diagrams", "j17_find_similar_hashes", "j18_hashes_within",
             "j13_citation_number_check", "j14_author_mention_check", "j4_duplicate_by_doi", "a1_duplicate_files",
             "j7_title_candidates", "j8_best_match", "a4_reference_summary", "p6_upload_pipeline", "a14_ssim"],
)
def test_joins_are_equi_joins(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text
    # Sides of one row (the number of papers) are the only ones without a key.
    assert text.count("BroadcastNestedLoopJoin") <= text.count("n_papers"), name


def test_columns_are_pruned_and_filters_pushed(spark, folder):
    alerts = plan(QUERIES["p3_search_alerts"](spark, folder))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in alerts
    groups = plan(B.table(spark, folder, "documents").where("source = 'src1'").select("doc_id"))
    assert "EqualTo(source,src1)" in groups and "text" not in groups.split("ReadSchema")[1]


def test_salted_join(spark):
    big = spark.range(1000).selectExpr("id", "if(id < 600, 0, id % 50) as k")
    small = spark.range(40).selectExpr("id as k", "id * 2 as v")
    got = {(r.id, r.v) for r in salted_join(big, small, ["k"], [big.id], "left").collect()}
    want = {(r.id, r.v) for r in big.join(small, "k", "left").collect()}
    assert got == want and len(got) == 1000


def test_papers_without_references_stay(spark, folder, tmp_path):
    # Of six papers those with id % 6 = 1 cite the ids 2 to 5, which are gaps.
    ids = [0, 1, 12, 13, 18, 19]
    for name, key in (("documents", "doc_id"), ("events", "event_id")):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.col(key).isin(ids)).write.parquet(f"{tmp_path}/{name}.parquet")
    statuses = {r.paper_id: r.status for r in B.papers_v(spark, str(tmp_path)).collect()}
    got = {r.paper_id: r for r in QUERIES["p6_upload_pipeline"](spark, str(tmp_path)).collect()}
    assert sorted(statuses) == sorted(got) == ids
    for i in ids:
        assert (got[i].overall_status is None) == (got[i].reason is None) == (i % 6 == 1)
        if i % 6 == 1:
            assert got[i].status == statuses[i]


@pytest.mark.parametrize("name, most", [("j7_title_candidates", 4), ("a4_reference_summary", 6), ("p6_upload_pipeline", 8)])
def test_shared_parts_are_written_once(spark, folder, name, most):
    assert plan(QUERIES[name](spark, folder)).count("FileScan parquet") <= most


def test_rows_with_many_keys_are_not_broadcast(spark):
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        rows = spark.range(9).selectExpr("id as paper_id", "md5(string(id)) as hash", "concat('on the number ', id) as title")
        long = rows.selectExpr("concat(hash, hash) as hash")
        sixteen = rows.selectExpr("substring(hash, 1, 16) as hash")
        for found in (
            U.similar_title_edges(rows),
            D.near_hash_pairs(sixteen, sixteen, 16, 9),
            D.similar_hash_pairs(long, long, 0.8, 64),
        ):
            text = plan(found)
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
