"""Catalogue records, search responses, reports, files, verification details."""

import json
import re

import pytest

from veripaper.operators.alerts import build_alert_payloads
from pyspark.sql import functions as F

from veripaper.plans import all_queries
from veripaper.sources import catalogues as C


def values(spark, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "value string")


def test_openalex(spark):
    full = {
        "id": "W1", "title": "", "display_name": "Shown name", "doi": "https://doi.org/10.1/x", "publication_year": 2020,
        "authorships": [{"author": {"display_name": "Ann Lee", "orcid": "o1"}, "institutions": [{"display_name": "Inst"}]},
                        {"author": {"display_name": "Bo Ek"}}],
        "primary_location": {"source": {"display_name": "Journal"}, "pdf_url": "p", "landing_page_url": "l"},
        "concepts": [{"display_name": "c1"}, {"display_name": "c2"}], "biblio": {"volume": "3", "first_page": "5", "last_page": "9"},
    }
    rows = C.normalize_openalex(values(spark, full, {"id": "W2", "title": "T", "biblio": {"first_page": "7"}})).collect()
    first, second = rows
    assert (first.title, first.pages, first.venue, first.citation_count) == ("Shown name", "5-9", "Journal", 0)
    assert first.topics == ["c1", "c2"]
    assert [tuple(a) for a in first.authors] == [("Ann Lee", "o1", "Inst"), ("Bo Ek", None, None)]
    assert (second.pages, second.topics, second.authors) == ("7", [], [])


def test_crossref(spark):
    full = {
        "DOI": "10.1/a", "title": ["One", "Two"], "published": {"date-parts": [[2019, 3]]}, "container-title": ["J"],
        "link": [{"URL": "h", "content-type": "text/html"}, {"URL": "p", "content-type": "application/pdf"}],
        "author": [{"given": "Ann", "family": "Lee"}, {"family": "Ek", "ORCID": "x", "affiliation": [{"name": "U"}]}],
        "is-referenced-by-count": 4, "subject": ["s"],
    }
    first, second = C.normalize_crossref(values(spark, full, {"DOI": "10.1/b"})).collect()
    assert (first.title, first.year, first.pdf_url, first.citation_count, first.source_id) == ("One", 2019, "p", 4, "10.1/a")
    assert [tuple(a) for a in first.authors] == [("Ann Lee", None, None), ("Ek", "x", "U")]
    assert (second.title, second.year, second.authors, second.topics) == ("", None, [], [])


def test_semantic_and_union(spark):
    rows = C.normalize_semantic(
        values(spark, {"paperId": "p", "title": "T", "venue": "", "journal": {"name": "J"}, "externalIds": {"DOI": "d"},
                       "authors": [{"authorId": "1", "name": "Ann"}]})
    )
    row = rows.collect()[0]
    assert (row.venue, row.doi, row.authors[0].orcid) == ("J", "d", None)
    united = C.union_sources(rows, C.normalize_openalex(values(spark, {"id": "W", "title": "X"})))
    assert {r.source for r in united.collect()} == {"semantic", "openalex"}


def test_load_catalogue(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "W", "title": "X"}) + "\n")
    assert C.load_catalogue(spark, str(tmp_path), "openalex").collect()[0].title == "X"
    with pytest.raises(ValueError):
        C.load_catalogue(spark, str(tmp_path), "other")


def test_search_hits(spark):
    responses = [
        {"organic": [{"link": "u1", "title": "t", "snippet": "s"}], "items": [{"link": "no"}]},
        {"items": [{"link": "u2"}]},
        {"RelatedTopics": [{"Text": "no url"}, {"FirstURL": "u3", "Text": "words"}]},
        {"organic": [], "items": [{"link": "shadowed"}]},
        {"error": "x"},
    ]
    raw = spark.createDataFrame([(1, i, json.dumps(r)) for i, r in enumerate(responses)], "image_id long, call int, response string")
    rows = {(r.call, r.pos, r.url, r.title, r.snippet) for r in C.read_search_hits(raw).collect()}
    assert rows == {(0, 0, "u1", "t", "s"), (1, 0, "u2", "", ""), (2, 0, "u3", "words", "words")}


def test_reports(spark, tmp_path):
    body = {"jobId": "j", "pdfPath": "p", "totalDiagrams": 2, "summary": {"total": 2, "riskLevel": "low"}}
    rows = C.read_report(values(spark, {"result": body}, {"plagiarismReport": body}, body)).collect()
    assert [(r.jobId, r.summary.riskLevel) for r in rows] == [("j", "low")] * 3
    scored = spark.range(2500).selectExpr(
        "if(id < 2400, 'big', concat('j', id)) as job_id", "id as image_id", "concat('d', id) as diagram", "id / 7 as best_match_pct",
        "'original' as decision", "id / 3 as confidence", "array('a', concat('b', id)) as indicators",
    )
    totals = scored.groupBy("job_id").agg(F.count(F.lit(1)).alias("total")).selectExpr(
        "*", "total as original", "0L as partially_plagiarized", "0L as heavily_plagiarized", "0.5D as average_confidence", "'low' as risk_level"
    )
    out = str(tmp_path / "out")
    C.write_report(scored, totals, out, buckets=4)
    reports = C.read_report(spark.read.text(out).select("value")).collect()
    big = [r for r in reports if r.jobId == "big"]
    assert len(big) == 3 and all(r.parts == 3 and r.totalDiagrams == 2400 and len(r.diagrams) < 1500 for r in big)
    back = C.report_diagrams(C.read_report(spark.read.text(out).select("value")))
    columns = ["job_id", "diagram", "confidence", "indicators"]
    assert sorted(back.select(*columns).collect()) == sorted(scored.select(*columns).collect())
    folders = {r.jobId: {f.parent for f in (tmp_path / "out").glob("bucket=*/*.json") if f'"{r.jobId}"' in f.read_text()} for r in big}
    assert len(folders["big"]) == 1


def test_intake_files(spark, tmp_path):
    (tmp_path / "My_paper (1).pdf").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    (tmp_path / "big.pdf").write_bytes(b"x" * 50)
    rows = {r.filename: r for r in C.intake_files(spark, str(tmp_path), limit=20).collect()}
    paper = rows["My_paper (1).pdf"]
    assert (paper.accepted, paper.stored_name, paper.title) == (True, "My_paper__1_.pdf", "My paper (1)")
    assert rows["notes.txt"].reason.startswith("Only PDF") and rows["big.pdf"].reason.startswith("File size")


def test_reference_details(spark):
    cases = [
        {"source": "crossref_search", "matchScore": 0.7, "data": {
            "title": ["A title"], "author": [{"given": "A", "family": "B"}, {"name": "C"}], "DOI": "d",
            "published": {"date-parts": [[2001]]}, "container-title": ["V"]}},
        {"source": "crossref", "data": {"title": "Plain", "author": {"given": "X", "family": "Y"}, "year": "1999", "journal": "W"}},
        {"source": "openalex", "data": {"display_name": "Shown", "publication_year": 2010, "authorships": [{"author": {"display_name": "Z"}}]}},
        {"source": "other", "data": {"a": 1}, "contentCheck": {"valid": True}},
        {"aiExtraction": {"title": "t"}},
    ]
    refs = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "ref_id long, verification string")
    rows = {r.ref_id: r for r in C.reference_details(refs).collect()}
    assert (rows[0].api_title, rows[0].api_authors, rows[0].api_year, rows[0].api_venue, rows[0].match_score) == (
        "A title", ["A B", "C"], 2001, "V", 0.7)
    assert (rows[1].api_title, rows[1].api_authors, rows[1].api_year, rows[1].api_venue) == ("Plain", ["X Y"], 1999, "W")
    assert (rows[2].source, rows[2].api_title, rows[2].api_authors, rows[2].api_year) == ("openalex", "Shown", ["Z"], 2010)
    assert (rows[3].source, rows[3].content_check) == ("other", '{"valid":true}')
    assert (rows[4].source, rows[4].ai_extraction) == (None, '{"title":"t"}')


def test_alert_payloads(spark):
    alerts = spark.sql(
        "select 1L as alert_id, 'PAPER_REJECTED' as type, 'ERROR' as severity, 'T' as title, 'M' as message,"
        " timestamp '2024-01-01 00:00:01.5' as created_at"
    )
    rows = {r.channel: json.loads(r.payload) for r in build_alert_payloads(alerts, ["slack", "discord", "email"]).collect()}
    slack = rows["slack"]["attachments"][0]
    assert (rows["slack"]["text"], slack["color"], slack["ts"], slack["fields"][2]["short"]) == ("T", "#ff0000", 1704067201, False)
    embed = rows["discord"]["embeds"][0]
    assert (embed["color"], embed["timestamp"]) == (0xFF0000, "2024-01-01T00:00:01.500Z")
    assert rows["email"]["content"][0]["value"] == "M\n\nType: PAPER_REJECTED\nSeverity: ERROR"


def test_report_parts_of_small_and_large_jobs(spark, monkeypatch):
    """Summaries meet whole parts: diagrams are grouped by job and part alone."""
    monkeypatch.setattr(C, "REPORT_PART", 3)
    rows = [(job, i, f"d{i}", 1.0 * i, "original", 0.0, ["x"]) for job, n in ((1, 2), (2, 20), (None, 2)) for i in range(n)]
    scored = spark.createDataFrame(
        rows, "job_id long, image_id long, diagram string, best_match_pct double, decision string, confidence double, indicators array<string>"
    )
    summary = spark.createDataFrame(
        [(1, 2), (2, 20), (3, 0)], "job_id long, total long"
    ).selectExpr("*", "0L as original", "0L as partially_plagiarized", "0L as heavily_plagiarized", "0d as average_confidence", "'low' as risk_level")
    parts = C.report_parts(scored, summary)
    found = {}
    for r in parts.collect():
        assert (r.summary.total, r.totalDiagrams) == ((2, 2) if r.jobId == "1" else (20, 20))
        assert r.parts == (1 if r.jobId == "1" else 7) and 0 <= r.part < r.parts
        index = [d["index"] for d in r.diagrams]
        assert index == sorted(index)
        found.setdefault(r.jobId, []).extend(index)
    assert {job: sorted(index) for job, index in found.items()} == {"1": [0, 1], "2": list(range(20))}
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[job_id#\d+L?, part#\d+\]", plan)


def test_report_under_escaped_key(spark):
    body = json.dumps({"jobId": "7"})
    raw = spark.createDataFrame([('{"\\u0072esult": ' + body + "}",), ('{"result": ' + body + "}",), (body,)], "value string")
    assert [r.jobId for r in C.read_report(raw).collect()] == ["7"] * 3


def test_reports_on_disk_are_small(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr("veripaper.functions.scale.shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr("veripaper.plans.diagrams.shared_folder", lambda _: str(tmp_path))
    found = all_queries()["s12_report_round_trip"](spark, folder)
    reports = list(tmp_path.glob("reports-*/bucket=*/part-*"))
    assert reports and all(f.name.endswith(".json.gz") for f in reports)
    assert list(tmp_path.glob("rows-*/*.parquet"))
    assert found.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()
