"""Queries on listings, dashboards, alerts and table changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..operators import alerts as A
from ..operators import duplicates as D
from ..operators import listing as L
from ..operators import verdicts as V
from ..sources import tables as T
from . import bindings as B
from . import citations as CQ
from . import papers as PQ
from . import references as RQ
from . import sql_text as S
from .oracle_views import with_views
from .registry import query


@query(
    "p2_search_papers",
    with_views(
        ["papers_v"],
        """select paper_id, title from papers_v where status = 'VALIDATED' and contains(lower(venue), 'rc1')
           and (contains(lower(title), 'the') or contains(lower(abstract), 'the'))""",
    ),
)
def search_papers(spark: SparkSession, folder: str) -> DataFrame:
    found = L.search_papers(B.papers_v(spark, folder), status="VALIDATED", venue="RC1", search="THE")
    return found.select("paper_id", "title")


@query(
    "p3_search_alerts",
    with_views(
        ["alerts_v"],
        """select alert_id, paper_id from alerts_v where type = 'INVALID_REFERENCE' and severity = 'WARNING' and not is_read""",
    ),
)
def search_alerts(spark: SparkSession, folder: str) -> DataFrame:
    found = L.search_alerts(
        B.alerts_v(spark, folder), type="INVALID_REFERENCE", severity="WARNING", is_read=False
    )
    return found.select("alert_id", "paper_id")


@query(
    "p4_pending_papers",
    with_views(["papers_v"], "select paper_id, title from papers_v where status = 'PENDING' order by paper_id limit 10"),
)
def pending_papers(spark: SparkSession, folder: str) -> DataFrame:
    return L.pending_papers(B.papers_v(spark, folder)).select("paper_id", "title")


@query(
    "j22_papers_to_rescan",
    with_views(
        ["papers_v", "diagrams_v"],
        """select paper_id, status from papers_v where status in ('VALIDATED', 'NEEDS_REVIEW')
           and paper_id in (select paper_id from diagrams_v) order by paper_id limit 20""",
    ),
)
def papers_to_rescan(spark: SparkSession, folder: str) -> DataFrame:
    return L.papers_to_rescan(B.papers_v(spark, folder), B.diagrams_v(spark, folder)).select("paper_id", "status")


@query(
    "t7_rescan_diagrams",
    with_views(
        ["papers_v", "diagrams_v"],
        """select a.diagram_id, a.paper_id, b.diagram_id as matched_diagram_id from diagrams_v a
           join diagrams_v b on a.paper_id <> b.paper_id
           where a.paper_id in (select paper_id from papers_v where status in ('VALIDATED', 'NEEDS_REVIEW')
              and paper_id in (select paper_id from diagrams_v))
           and 1 - list_sum(list_transform(range(1, 17), lambda i: case when a.hash[i] <> b.hash[i] then 1 else 0 end)) / 64.0 > 0.85
           qualify row_number() over (partition by a.diagram_id order by b.diagram_id) = 1""",
    ),
)
def rescan_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.diagrams import suspicious_diagrams

    diagrams = B.diagrams_v(spark, folder)
    due = L.papers_to_rescan(B.papers_v(spark, folder), diagrams, n=None).select("paper_id")
    return suspicious_diagrams(diagrams).join(due, "paper_id", "left_semi").select(
        "diagram_id", "paper_id", "matched_diagram_id"
    )


@query(
    "o1_page",
    with_views(
        ["alerts_v"],
        "select alert_id, created_at from alerts_v order by created_at desc, alert_id offset 100 limit 50",
    ),
)
def page(spark: SparkSession, folder: str) -> DataFrame:
    return L.page(B.alerts_v(spark, folder), "alert_id", number=3, limit=50).select("alert_id", "created_at")


@query(
    "a3_page_info",
    "select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as total_pages from documents",
)
def page_info(spark: SparkSession, folder: str) -> DataFrame:
    return L.page_info(B.table(spark, folder, "documents"), 20)


@query(
    "j1_papers_with_authors",
    with_views(
        ["papers_v", "authors_v"],
        """select p.paper_id, p.title, a."order", a.name from papers_v p left join authors_v a on a.paper_id = p.paper_id""",
    ),
)
def papers_with_authors(spark: SparkSession, folder: str) -> DataFrame:
    joined = L.papers_with_authors(B.papers_v(spark, folder), B.authors_v(spark, folder))
    return joined.select("paper_id", "title", "order", "name")


@query(
    "j2_alerts_with_paper",
    with_views(
        ["alerts_v", "papers_v"],
        """select a.alert_id, a.paper_id, p.title as paper_title, p.doi as paper_doi from alerts_v a
           left join papers_v p on p.paper_id = a.paper_id""",
    ),
)
def alerts_with_paper(spark: SparkSession, folder: str) -> DataFrame:
    joined = L.alerts_with_paper(B.alerts_v(spark, folder), B.papers_v(spark, folder))
    return joined.select("alert_id", "paper_id", "paper_title", "paper_doi")


@query(
    "a2_child_counts",
    with_views(
        ["papers_v", "refs_v", "diagrams_v", "alerts_v"],
        """select p.paper_id, (select count(*) from refs_v r where r.paper_id = p.paper_id) as n_refs,
             (select count(*) from diagrams_v d where d.paper_id = p.paper_id) as n_diagrams,
             (select count(*) from alerts_v a where a.paper_id = p.paper_id) as n_alerts from papers_v p""",
    ),
)
def child_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = L.child_counts(
        B.papers_v(spark, folder).select("paper_id"),
        refs=B.refs_v(spark, folder).select("paper_id"),
        diagrams=B.diagrams_v(spark, folder).select("paper_id"),
        alerts=B.alerts_v(spark, folder).select("paper_id"),
    )
    return counted


REPORTS = (
    "reports",
    """select row_number() over (order by paper_id) as report_id, paper_id, similar_paper_id as compared_paper_id,
         'title' as similarity_type, similarity as similarity_score from dups""",
)


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    return A.similarity_reports(D.duplicates_within(B.papers_v(spark, folder)))


@query(
    "p25_similarity_reports",
    with_views(
        ["papers_v"],
        "select paper_id, compared_paper_id, similarity_type, similarity_score from reports",
        *PQ.DUPLICATE_CTES,
        REPORTS,
    ),
)
def similarity_reports(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).drop("levenshtein_distance")


@query(
    "o7_similarity_desc",
    with_views(
        ["papers_v"],
        """select paper_id, paper_id as report_id, similarity_score from reports
           order by paper_id, similarity_score desc, report_id""",
        *PQ.DUPLICATE_CTES,
        REPORTS,
    ),
)
def similarity_desc(spark: SparkSession, folder: str) -> DataFrame:
    reports = _reports(spark, folder).withColumn("report_id", F.col("paper_id"))
    return L.similarity_desc(reports).select("paper_id", "report_id", "similarity_score")


@query(
    "j3_paper_details",
    with_views(
        ["papers_v", "authors_v", "refs_v", "diagrams_v"],
        """select * from (
             select paper_id, 'authors' as part, cast("order" as double) as sort_key, name as value from authors_v
             union all select paper_id, 'refs', cast(ord as double), raw_text from refs_v
             union all select paper_id, 'diagrams', cast("order" as double), concat(cast(diagram_id as varchar), '|', hash) from diagrams_v
             union all select paper_id, 'similarities', -similarity_score, cast(compared_paper_id as varchar) from reports)
           where paper_id in (select paper_id from papers_v)""",
        *PQ.DUPLICATE_CTES,
        REPORTS,
    ),
)
def paper_details(spark: SparkSession, folder: str) -> DataFrame:
    return L.paper_details(
        B.papers_v(spark, folder),
        authors=(B.authors_v(spark, folder), F.col("order"), ["name"]),
        refs=(B.refs_v(spark, folder), F.col("ord"), ["raw_text"]),
        diagrams=(B.diagrams_v(spark, folder), F.col("order"), ["diagram_id", "hash"]),
        similarities=(_reports(spark, folder), -F.col("similarity_score"), ["compared_paper_id"]),
    )


METADATA = """case paper_id % 6 when 0 then '{"validationAnalysis":{"overallStatus":"VALID"}}'
  when 1 then '{"validationAnalysis":{"overallStatus":"INVALID"}}' when 2 then '{"validationAnalysis":{"overallStatus":"PENDING"}}'
  when 3 then '{}' end"""
CLASSIFIED_SQL = (
    "classified",
    f"""select *, coalesce(overall = 'VALID', false) or status = 'VALIDATED' as is_valid,
          coalesce(overall = 'INVALID', false) or (analysed and not coalesce(overall = 'VALID', false) and status <> 'VALIDATED') as is_invalid
        from (select *, json_extract_string(metadata, '$.validationAnalysis.overallStatus') as overall,
                json_extract(metadata, '$.validationAnalysis') is not null as analysed
              from (select *, {METADATA} as metadata from papers_v))""",
)


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return L.classify_papers(B.papers_v(spark, folder).withColumn("metadata", F.expr(METADATA)))


@query(
    "p14_classify_papers",
    with_views(["papers_v"], "select paper_id, is_valid, is_invalid from classified", CLASSIFIED_SQL),
)
def classify_papers(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select("paper_id", "is_valid", "is_invalid")


@query(
    "a9_status_dashboard",
    with_views(
        ["papers_v"],
        """select count(*) as total, count(*) filter (status = 'VALIDATED') as validated, count(*) filter (status = 'PENDING') as pending,
             count(*) filter (status = 'NEEDS_REVIEW') as needs_review, count(*) filter (status = 'REJECTED') as rejected,
             count(*) filter (is_valid) as valid, count(*) filter (is_invalid) as invalid from classified""",
        CLASSIFIED_SQL,
    ),
)
def status_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    return L.status_dashboard(_classified(spark, folder))


@query(
    "o6_recent_valid",
    with_views(
        ["papers_v"],
        """select class, pos, paper_id from (
             select class, paper_id, row_number() over (partition by class order by created_at desc, paper_id) as pos from (
               select 'valid' as class, paper_id, created_at from classified where is_valid
               union all select 'invalid', paper_id, created_at from classified where is_invalid)) where pos <= 10""",
        CLASSIFIED_SQL,
    ),
)
def recent_valid(spark: SparkSession, folder: str) -> DataFrame:
    return L.recent_by_class(_classified(spark, folder)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "p15_compare_extractions",
    with_views(
        ["refs_v", "catalogue_v"],
        f"""select paper_id, ord, lower(coalesce(trim(title), '')) = lower(coalesce(trim(cat_title), '')) as title_match,
             case when coalesce(title, '') = '' then 'N/A' else {S.strip('title')} end as title_shown,
             case when coalesce(trim(cat_title), '') = '' then 'N/A' else {S.strip('cat_title')} end as cat_title_shown,
             coalesce(year, '') = coalesce(cast(cat_year as varchar), '') as year_match,
             coalesce(year, 'N/A') as year_shown, coalesce(cast(cat_year as varchar), 'N/A') as cat_year_shown,
             lower(coalesce(authors, '')) = lower(coalesce(array_to_string(cat_authors, ', '), '')) as authors_match,
             coalesce(authors, 'N/A') as authors_shown,
             coalesce(nullif(array_to_string(cat_authors, ', '), ''), 'N/A') as cat_authors_shown
        from (select p.paper_id, p.ord, p.title, p.year, p.authors, k.title as cat_title, k.year as cat_year, k.authors as cat_authors
              from parsed p join refs_v r on r.paper_id = p.paper_id and r.ord = p.ord join catalogue_v k on k.cat_id = r.cited_id)""",
        RQ.PARSED,
    ),
)
def compare_extractions(spark: SparkSession, folder: str) -> DataFrame:
    refs = RQ.parsed_refs(spark, folder).join(
        B.refs_v(spark, folder).select("paper_id", "ord", "cited_id"), ["paper_id", "ord"]
    )
    cat = B.catalogue_v(spark, folder).select(
        F.col("cat_id").alias("cited_id"), F.col("title").alias("cat_title"),
        F.col("year").alias("cat_year"), F.col("authors").alias("cat_authors"),
    )
    compared = L.compare_extractions(refs.join(cat, "cited_id"), ["title", "year", "authors"])
    shown = [f"{p}{f}_shown" for f in ("title", "year", "authors") for p in ("", "cat_")]
    return compared.select("paper_id", "ord", "title_match", "year_match", "authors_match", *shown)


SEARCHED = """select image_id, image_id % 7 <> 0 as searched, image_id % 3 = 0 as is_copied,
  case when image_id % 3 = 0 then image_id % 5 + 1 else 0 end as n_matches,
  case when image_id % 3 = 0 then image_id % 5 + 1 else 0 end as n_pages from images_v"""


@query(
    "a10_web_match_analytics",
    with_views(
        ["images_v"],
        """select count(*) filter (is_copied) as copied,
             cast(floor(count(*) filter (is_copied) / count(*)::double * 100 + 0.5) as bigint) as copied_pct,
             count(*) filter (not is_copied and searched) as originals, sum(n_matches)::bigint as total_matches,
             sum(n_pages)::bigint as matching_pages from searched""",
        ("searched", SEARCHED),
    ),
)
def web_match_analytics(spark: SparkSession, folder: str) -> DataFrame:
    images = B.images_v(spark, folder).selectExpr(
        "image_id", "image_id % 7 <> 0 as searched", "image_id % 3 = 0 as is_copied",
        "case when image_id % 3 = 0 then image_id % 5 + 1 else 0 end as n_matches",
        "case when image_id % 3 = 0 then image_id % 5 + 1 else 0 end as n_pages",
    )
    return L.web_match_analytics(images)


@query(
    "p17_web_status",
    with_views(
        ["images_v"],
        """select i.image_id, coalesce(r.n, 0) > 0 and i.image_id % 10 <> 3 as found,
             case when i.image_id % 10 = 3 then 0 else coalesce(r.n, 0) end::bigint as n_matches,
             case when i.image_id % 10 <> 3 then concat('guess ', cast(i.image_id as varchar)) end as best_guess,
             case when i.image_id % 10 = 3 then 'Search failed' end as error,
             coalesce(r.n, 0) > 0 and i.image_id % 10 <> 3 as is_copied
           from images_v i left join (select page_id % 90 as image_id, count(*) as n from pages group by 1) r on r.image_id = i.image_id""",
    ),
)
def web_status(spark: SparkSession, folder: str) -> DataFrame:
    images = B.images_v(spark, folder).select("image_id")
    results = B.table(spark, folder, "pages").selectExpr("page_id % 90 as image_id", "url")
    searches = images.selectExpr(
        "image_id", "concat('guess ', image_id) as best_guess",
        "case when image_id % 10 = 3 then 'Search failed' end as error",
    )
    return L.web_status(images, results, searches).withColumn("n_matches", F.col("n_matches").cast("bigint"))


AS_OF = datetime(2024, 1, 16, 12, 0, 0)


@query(
    "a11_daily_summary",
    with_views(
        ["papers_v", "alerts_v"],
        """select *, concat('Daily Summary (Last 24 hours):', chr(10), '- New Papers: ', cast(new_papers as varchar), chr(10), '- Validated: ',
               cast(validated_papers as varchar), chr(10), '- Rejected: ', cast(rejected_papers as varchar), chr(10), '- Invalid References: ',
               cast(invalid_refs as varchar), chr(10), '- Suspicious Diagrams: ', cast(suspicious_diagrams as varchar)) as message
           from (select count(*) filter (created_at >= timestamp '2024-01-15 12:00:00') as new_papers,
             count(*) filter (created_at >= timestamp '2024-01-15 12:00:00' and status = 'VALIDATED') as validated_papers,
             count(*) filter (created_at >= timestamp '2024-01-15 12:00:00' and status = 'REJECTED') as rejected_papers from papers_v),
           (select count(*) filter (created_at >= timestamp '2024-01-15 12:00:00' and type = 'INVALID_REFERENCE') as invalid_refs,
             count(*) filter (created_at >= timestamp '2024-01-15 12:00:00' and type = 'SUSPICIOUS_DIAGRAM') as suspicious_diagrams from alerts_v)""",
    ),
)
def daily_summary(spark: SparkSession, folder: str) -> DataFrame:
    papers = B.papers_v(spark, folder).withColumns({"validated_at": F.col("created_at"), "updated_at": F.col("created_at")})
    alerts = B.alerts_v(spark, folder).withColumn("updated_at", F.col("created_at"))
    refs = alerts.select(F.when(F.col("type") == "INVALID_REFERENCE", "INVALID").alias("status"), "updated_at")
    diagrams = alerts.select((F.col("type") == "SUSPICIOUS_DIAGRAM").alias("is_suspicious"), "updated_at")
    return L.daily_summary(papers, refs, diagrams, AS_OF)


@query(
    "a13_batch_summary",
    with_views(
        ["refs_v", "papers_v"],
        """select count(*) as total, count(*) filter (d.similar_paper_id is null) as imported,
             count(*) filter (d.similar_paper_id is not null) as skipped
           from papers_v p left join dups d on d.paper_id = p.paper_id""",
        *PQ.DUPLICATE_CTES,
    ),
)
def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    papers = B.papers_v(spark, folder)
    results = papers.select("paper_id").join(D.duplicates_within(papers), "paper_id", "left")
    return L.import_summary(results.withColumn("imported", F.col("similar_paper_id").isNull()))


@query(
    "w3_figure_order",
    with_views(
        ["images_v"],
        "select image_id, paper_id, row_number() over (partition by paper_id order by page, image_id) as figure from images_v",
    ),
)
def figure_order(spark: SparkSession, folder: str) -> DataFrame:
    return L.figure_order(B.images_v(spark, folder)).select("image_id", "paper_id", "figure")


@query(
    "w5_latest_per_key",
    with_views(
        ["job_events_v"],
        "select job_id, seq, state from job_events_v qualify row_number() over (partition by job_id order by ts desc, seq desc) = 1",
    ),
)
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    events = B.job_events_v(spark, folder)
    return L.latest_per_key(events, ["job_id"], ["ts", "seq"]).select("job_id", "seq", "state")


@query(
    "u3_distinct_paths",
    with_views(["images_v"], "select distinct concat('out/', hash, '.png') as path from images_v"),
)
def distinct_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = B.images_v(spark, folder).select(F.concat(F.lit("out/"), "hash", F.lit(".png")).alias("path"))
    return L.distinct_paths(paths)


@query("u5_dedup_ci", "select lang, min_by(word, pos) as word from (select lang, trim(split_part(split_part(text, chr(10), 1), '.', 1)) as word, doc_id as pos from documents) group by lang, lower(word)")
def dedup_ci(spark: SparkSession, folder: str) -> DataFrame:
    words = B.table(spark, folder, "documents").selectExpr("lang", f"{B.TITLE} as word", "doc_id as pos")
    return L.dedup_ci(words, ["lang"], "word", "pos").select("lang", "word")


@query(
    "p23_jobs_matching",
    with_views(["job_events_v"], "select job_id, seq from job_events_v where contains(job_id, '12')"),
)
def jobs_matching(spark: SparkSession, folder: str) -> DataFrame:
    return L.jobs_matching(B.job_events_v(spark, folder), "12").select("job_id", "seq")


@query(
    "f42_format_date",
    with_views(
        ["alerts_v"],
        """select alert_id, strftime(created_at, '%b %-d, %Y') as day, strftime(created_at, '%b %-d, %Y, %I:%M %p') as moment from alerts_v""",
    ),
)
def format_date(spark: SparkSession, folder: str) -> DataFrame:
    return B.alerts_v(spark, folder).select(
        "alert_id", H.format_date(F.col("created_at")).alias("day"), H.format_date_time(F.col("created_at")).alias("moment")
    )


# --- decisions and alerts ---------------------------------------------------------------------
NOTES_SQL = """case when not coalesce(checked, false) then []
  when not found then ['No matching paper found in OpenAlex database']
  when match_score < 0.7 then list_concat([concat('OpenAlex validation failed (match score: ', printf('%.2f', match_score), ')')], differences)
  when not (title_match and year_match and author_match) then list_filter([
    case when not title_match then 'Title mismatch with OpenAlex' end, case when not year_match then 'Year mismatch with OpenAlex' end,
    case when not author_match then 'Author mismatch with OpenAlex' end], lambda n: n is not null)
  else list_transform(range(n_unnamed), lambda i: 'OpenAlex paper has no author information') end"""
DECISION_CTES = [
    ("validated", PQ.VALIDATED_SQL),
    *PQ.DUPLICATE_CTES,
    ("names_of", """select paper_id, list(lower(name) order by "order") as names from authors_v group by paper_id"""),
    *[c for c in RQ.CATALOGUE_MATCH_CTES if c[0] != "names_of"],
    (
        "joined",
        f"""select v.paper_id, v.title, v.errors, v.warnings, v.is_valid, d.similarity, d.similarity is not null as is_duplicate,
             b.score is not null or v.title <> '' as checked, coalesce(b.is_found, false) as found,
             case when b.is_found then b.score else 0.0 end as match_score, coalesce(b.title_match, false) as title_match,
             coalesce(b.year = b.cat_year, false) as year_match, coalesce(b.author_match, false) as author_match,
             coalesce(b.n_unnamed, 0) as n_unnamed, list_filter([
               case when b.is_found and b.year is not null and b.cat_year is null
                 then concat('Year mismatch: PDF has ', cast(b.year as varchar), ', OpenAlex has unknown') end,
               case when b.is_found and len(b.names) > 0 and len(b.cat_names) > 0 and not b.author_match
                 then 'Author mismatch: PDF authors don''t match OpenAlex authors' end,
               case when b.is_found and not b.title_match
                 then concat('Title mismatch: "', b.title, '" vs "', b.cat_title, '"') end], lambda n: n is not null) as differences,
             coalesce(regexp_matches(t.text, '(?i)abstract'), false) as has_abstract,
             coalesce(regexp_matches(t.text, '(?i)conclusion|concluding'), false) as has_conclusion
           from validated v left join dups d on d.paper_id = v.paper_id left join best b on b.paper_id = v.paper_id
           left join texts_v t on t.paper_id = v.paper_id""",
    ),
    (
        "decided",
        f"""select *, array_to_string(notes, '; ') as validation_notes from (
           select *, case when not is_valid then 'REJECTED' when is_duplicate and similarity > 0.9 then 'REJECTED'
               when not (len(warnings) > 0 or is_duplicate) and complete then 'VALIDATED' else 'NEEDS_REVIEW' end as status,
             case when not is_valid then errors
               when is_duplicate and similarity > 0.9 then [concat('Duplicate detected (similarity: ', {S.score_text('similarity')}, ')')]
               when len(warnings) > 0 or is_duplicate then list_concat(cat_notes, warnings)
               when complete then cat_notes
               else list_concat(cat_notes, list_filter([case when not has_abstract then 'Abstract not found in PDF' end,
                 case when not has_conclusion then 'Conclusion section not found in PDF' end], lambda n: n is not null)) end as notes
           from (select *, {NOTES_SQL} as cat_notes, has_abstract and has_conclusion and (not checked or
               (found and match_score >= 0.7 and title_match and year_match and author_match)) as complete from joined))""",
    ),
]


def decided_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata check, duplicate check, catalogue match and sections, then the decision."""
    papers = B.papers_v(spark, folder).drop("abstract")
    checked = V.validate_metadata(papers, PQ.AS_OF)
    dups = D.duplicates_within(papers).select("paper_id", "similarity", F.lit(True).alias("is_duplicate"))
    match = RQ.matched_papers(spark, folder).drop("cat_id").withColumn("checked", F.lit(True))
    sections = B.texts_v(spark, folder).select(
        "paper_id",
        F.rlike("text", F.lit("(?i)abstract")).alias("has_abstract"),
        F.rlike("text", F.lit("(?i)conclusion|concluding")).alias("has_conclusion"),
    )
    joined = (
        checked.join(dups, "paper_id", "left").join(match, "paper_id", "left").join(sections, "paper_id", "left")
        .withColumn("service_down", F.lit(False)).drop("status")
        .withColumn("checked", F.coalesce("checked", F.lit(False)) & (F.col("title") != ""))
    )
    return V.decide_paper_status(joined)


@query(
    "p5_decide_paper_status",
    with_views(
        ["papers_v", "catalogue_v", "authors_v", "texts_v"],
        "select paper_id, status, validation_notes, status = 'NEEDS_REVIEW' as needs_review from decided",
        *DECISION_CTES,
    ),
)
def decide_paper_status(spark: SparkSession, folder: str) -> DataFrame:
    return decided_papers(spark, folder).select("paper_id", "status", "validation_notes", "needs_review")


@query(
    "p20_status_alerts",
    with_views(
        ["papers_v", "catalogue_v", "authors_v", "texts_v"],
        """select paper_id, 'PAPER_VALIDATED' as type, 'INFO' as severity, concat('Paper Validated: ', title) as title,
             concat('Paper "', title, '" has been validated successfully.') as message from decided where status = 'VALIDATED'
           union all select paper_id, 'PAPER_REJECTED', 'WARNING', concat('Paper Rejected: ', title),
             concat('Paper "', title, '" was rejected. Reasons: ', validation_notes) from decided where status = 'REJECTED'""",
        *DECISION_CTES,
    ),
)
def status_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return A.status_alerts(decided_papers(spark, folder))


@query(
    "p20_invalid_reference_alerts",
    with_views(
        ["refs_v", "papers_v", "catalogue_v"],
        f"""select 'INVALID_REFERENCE' as type, 'WARNING' as severity, concat('Invalid Reference in Paper: ', w.title) as title,
             concat('Reference #', cast(ord as varchar), ' could not be verified: ', raw_text) as message,
             paper_id, ord
           from (select * from (select c.paper_id, c.ord, p.raw_text, {S.title_similarity('p.title', 'k.title', 'lk', 'rk')} as score, c.rank
              from candidates c join parsed p on p.paper_id = c.paper_id and p.ord = c.ord join catalogue_v k on k.cat_id = c.cat_id
              cross join lateral (select {S.title_key('p.title')} as lk, {S.title_key('k.title')} as rk))
             qualify row_number() over (partition by paper_id, ord order by score desc, rank) = 1) b
           join papers_v w using (paper_id) where score > 0.5 and score <= 0.7""",
        *RQ.candidates_ctes(3),
    ),
)
def invalid_reference_alerts(spark: SparkSession, folder: str) -> DataFrame:
    status = RQ.best_title_match(spark, folder).select("paper_id", "ord", "status")
    titles = B.papers_v(spark, folder).select("paper_id", F.col("title").alias("paper_title"))
    refs = B.refs_v(spark, folder).join(status, ["paper_id", "ord"]).join(titles, "paper_id")
    return A.invalid_reference_alerts(refs)


@query(
    "p19_suspicion_alerts",
    with_views(
        ["diagrams_v", "papers_v"],
        """select 'SUSPICIOUS_DIAGRAM' as type, 'WARNING' as severity, concat('Suspicious Diagram Detected in Paper: ', p.title) as title,
             concat('Diagram #', cast(d."order" as varchar), ' on page ', cast(d.diagram_id % 7 as varchar), ' may be copied from another source. ',
               case when d.diagram_id % 4 > 0 then concat('Found ', cast(d.diagram_id % 4 as varchar), ' similar image(s) on the web using Bing Visual Search.')
                 else printf('Appears similar to an existing diagram in the database (similarity: %.1f%%).', (0.86 + d.diagram_id % 10 / 100.0::double) * 100) end) as message,
             d.paper_id, d.diagram_id
           from diagrams_v d join papers_v p on p.paper_id = d.paper_id where d.diagram_id % 3 = 0""",
    ),
)
def suspicion_alerts(spark: SparkSession, folder: str) -> DataFrame:
    titles = B.papers_v(spark, folder).select("paper_id", F.col("title").alias("paper_title"))
    diagrams = B.diagrams_v(spark, folder).join(titles, "paper_id").selectExpr(
        "*", "diagram_id % 7 as page", "diagram_id % 3 = 0 as is_suspicious", "diagram_id % 4 as n_web",
        "0.86D + diagram_id % 10 / 100.0D as similarity_score", "diagram_id + 1 as matched_diagram_id",
    )
    return A.suspicion_alerts(diagrams)


@query(
    "p21_checked_alerts",
    with_views(
        ["alerts_v"],
        """select alert_id, case when alert_id % 5 = 0 then 'INFO' else severity end as severity from alerts_v
           where alert_id % 9 <> 0 and coalesce(message, '') <> ''""",
    ),
)
def checked_alerts(spark: SparkSession, folder: str) -> DataFrame:
    raw = B.alerts_v(spark, folder).withColumns(
        {
            "severity": F.expr("case when alert_id % 5 = 0 then null else severity end"),
            "title": F.expr("case when alert_id % 9 = 0 then '' else title end"),
        }
    )
    return A.checked_alerts(raw)[0].select("alert_id", "severity")


@query(
    "p24_mark_alerts",
    with_views(
        ["alerts_v"],
        """select a.alert_id, coalesce(u.flag, a.is_read) as is_read from alerts_v a left join (
             select o_orderkey * 3 as alert_id, arg_max(o_orderstatus = 'F', o_orderkey) as flag from orders
             where o_orderstatus <> 'P' group by 1) u on u.alert_id = a.alert_id""",
    ),
)
def mark_alerts(spark: SparkSession, folder: str) -> DataFrame:
    updates = B.table(spark, folder, "orders").selectExpr(
        "o_orderkey * 3 as alert_id", "o_orderkey as seq",
        "case o_orderstatus when 'F' then 'true' when 'P' then 'maybe' else 'false' end as is_read",
    )
    return A.mark_alerts(B.alerts_v(spark, folder), updates)[0].select("alert_id", "is_read")


UPLOADS_SQL = """select paper_id, paper_id % 8 = 0 as is_duplicate, 0.81 + paper_id % 4 / 20.0::double as similarity,
  paper_id % 5 = 0 as extraction_failed, paper_id % 2 = 0 as checked, paper_id % 3 <> 0 as found,
  0.5 + paper_id % 5 / 10.0::double as match_score, case when paper_id % 7 = 0 then ['a', 'b'] else [] end as differences,
  case when paper_id % 6 = 0 then 'VALID' else 'INVALID' end as overall_status from papers_v"""


@query(
    "p6_decide_upload_status",
    with_views(
        ["papers_v"],
        f"""select paper_id, refused, needs_review, nullif(review_reason, '') as review_reason, initial_status,
             case when overall_status = 'VALID' then 'VALIDATED' else initial_status end as final_status
           from (select *, case when needs_review then 'NEEDS_REVIEW' else 'PENDING' end as initial_status,
               {S.notes('first', '''case when not_found then case when first is null then 'No matching paper found in OpenAlex database'
                   else 'No matching paper found in OpenAlex' end
                 when weak then concat('OpenAlex validation issues: ', array_to_string(differences, ', ')) end''')} as review_reason
             from (select *, is_duplicate and similarity > 0.9 as refused, checked and not found as not_found,
                 checked and found and match_score < 0.7 as weak,
                 is_duplicate or extraction_failed or (checked and not found) or (checked and found and match_score < 0.7) as needs_review,
                 case when is_duplicate then concat('Possible duplicate (similarity: ', {S.score_text('similarity')}, ')')
                   when extraction_failed then 'PDF metadata extraction failed. Please process manually or start the PDF service.' end as first
               from uploads))""",
        ("uploads", UPLOADS_SQL),
    ),
)
def decide_upload_status(spark: SparkSession, folder: str) -> DataFrame:
    uploads = B.papers_v(spark, folder).selectExpr(
        "paper_id", "paper_id % 8 = 0 as is_duplicate", "0.81D + paper_id % 4 / 20.0D as similarity",
        "paper_id % 5 = 0 as extraction_failed", "paper_id % 2 = 0 as checked", "paper_id % 3 <> 0 as found",
        "0.5D + paper_id % 5 / 10.0D as match_score",
        "case when paper_id % 7 = 0 then array('a', 'b') else array() end as differences",
        "case when paper_id % 6 = 0 then 'VALID' else 'INVALID' end as overall_status",
    )
    return V.decide_upload_status(uploads).select(
        "paper_id", "refused", "needs_review", "review_reason", "initial_status", "final_status"
    )


@query(
    "p6_upload_pipeline",
    with_views(
        ["refs_v", "catalogue_v", "texts_v", "papers_v"],
        """select p.paper_id, v.overall_status, v.reason, case when v.overall_status = 'VALID' then 'VALIDATED' else p.status end as status
           from papers_v p left join verdicts v on v.paper_id = p.paper_id""",
        *CQ.VERDICT_CTES,
    ),
)
def upload_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Parse, verify and look up all references of all papers at once, then judge the papers.

    A paper without references has no verdict and keeps its status.
    """
    judged = CQ.verdicts(spark, folder)
    papers = B.papers_v(spark, folder).select("paper_id", "status")
    final = F.when(F.col("overall_status") == "VALID", "VALIDATED").otherwise(F.col("status"))
    return papers.join(judged, "paper_id", "left").select("paper_id", "overall_status", "reason", final.alias("status"))


# --- table changes ------------------------------------------------------------------------------
@query(
    "s5_read_table",
    "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus",
)
def read_table(spark: SparkSession, folder: str) -> DataFrame:
    orders = T.read_table(spark, f"{folder}/orders.parquet")
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "s6_upsert_hashes",
    """with rows as (
         select concat('f/', cast(user_id % 300 as varchar)) as file_path, md5(cast(event_id as varchar)) as phash, ts as created_at, 0 as n
         from events where event_type <> 'view'
         union all select concat('f/', cast(user_id % 400 as varchar)), md5(cast(event_id as varchar)), ts, 1 from events where event_type = 'view')
       select file_path, phash from rows qualify row_number() over (partition by file_path order by created_at desc, n desc) = 1""",
)
def upsert_hashes(spark: SparkSession, folder: str) -> DataFrame:
    events = B.table(spark, folder, "events")
    store = events.where("event_type <> 'view'").selectExpr(
        "concat('f/', user_id % 300) as file_path", "md5(cast(event_id as string)) as phash", "ts as created_at"
    )
    new = events.where("event_type = 'view'").selectExpr(
        "concat('f/', user_id % 400) as file_path", "md5(cast(event_id as string)) as phash", "ts as created_at"
    )
    return T.upsert_hashes(store, new).select("file_path", "phash")


@query(
    "s7_merge_refs",
    with_views(
        ["refs_v"],
        """select coalesce(o.paper_id, n.paper_id) as paper_id, coalesce(o.ord, n.ord) as ord, coalesce(o.ref_id, n.ref_id) as ref_id,
             case when n.paper_id is not null then n.status else o.status end as status,
             coalesce(n.verification, o.verification) as verification
           from (select paper_id, ord, paper_id * 10 + ord as ref_id, 'PENDING' as status, '{"old":1}' as verification from refs_v where ord <= 3) o
           full join (select paper_id, ord, -paper_id as ref_id, 'VALID' as status,
               case when cited_id % 2 = 0 then '{"new":1}' end as verification from refs_v where ord >= 2) n
             on n.paper_id = o.paper_id and n.ord = o.ord""",
    ),
)
def merge_refs(spark: SparkSession, folder: str) -> DataFrame:
    refs = B.refs_v(spark, folder)
    old = refs.where("ord <= 3").selectExpr(
        "paper_id", "ord", "paper_id * 10 + ord as ref_id", "'PENDING' as status", """'{"old":1}' as verification"""
    )
    new = refs.where("ord >= 2").selectExpr(
        "paper_id", "ord", "-paper_id as ref_id", "'VALID' as status",
        """case when cited_id % 2 = 0 then '{"new":1}' end as verification""",
    )
    return T.merge_refs(old, new)


@query(
    "s8_replace_diagrams",
    with_views(
        ["diagrams_v"],
        """select diagram_id, paper_id, hash from diagrams_v where paper_id not in (select l_linenumber from lineitem)
           union all select l_orderkey * 1000 + l_partkey, l_linenumber, md5(cast(l_suppkey as varchar)) from lineitem""",
    ),
)
def replace_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    new = B.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 1000 + l_partkey as diagram_id", "cast(l_linenumber as bigint) as paper_id",
        "md5(cast(l_suppkey as string)) as hash",
    )
    old = B.diagrams_v(spark, folder).select("diagram_id", "paper_id", "hash")
    return T.replace_diagrams(old, new)


@query(
    "s9_delete_papers",
    with_views(
        ["papers_v", "refs_v", "alerts_v"],
        """select 'papers' as tab, count(*) as n, sum(paper_id)::bigint as keys from papers_v where paper_id not in (select doc_id from labels where toxic = 1)
           union all select 'refs', count(*), sum(paper_id)::bigint from refs_v where paper_id not in (select doc_id from labels where toxic = 1)
           union all select 'alerts', count(*), sum(paper_id)::bigint from alerts_v where paper_id not in (select doc_id from labels where toxic = 1)""",
    ),
)
def delete_papers(spark: SparkSession, folder: str) -> DataFrame:
    ids = B.table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("paper_id"))
    left = T.delete_papers(
        ids, papers=B.papers_v(spark, folder), refs=B.refs_v(spark, folder), alerts=B.alerts_v(spark, folder)
    )
    counts = [
        df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"), F.sum("paper_id").alias("keys"))
        for name, df in left.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "s10_patch_papers",
    with_views(
        ["papers_v"],
        """select p.paper_id, case when l.doc_id is not null then case when l.quality = 1 then 'Patched' end else p.title end as title,
             case when l.toxic = 1 then 2020 else p.year end as year
           from papers_v p left join labels l on l.doc_id = p.paper_id""",
    ),
)
def patch_papers(spark: SparkSession, folder: str) -> DataFrame:
    patch = B.table(spark, folder, "labels").selectExpr(
        "doc_id as paper_id", "true as has_title", "case when quality = 1 then 'Patched' end as title",
        "toxic = 1 as has_year", "2020 as year",
    )
    return T.patch_papers(B.papers_v(spark, folder), patch, ["title", "year"]).select("paper_id", "title", "year")


@query(
    "j12_link_authors",
    with_views(
        ["authors_v"],
        """select a.paper_id, k.author_id, a.name, a.orcid, a."order", a."order" = 0 as is_corresponding
           from (select *, case when paper_id % 3 = 2 and "order" = 0 then concat('0000-', cast(paper_id % 10 as varchar)) end as orcid from authors_v) a
           left join stored k on k.name = a.name and (a.orcid is null or k.orcid = a.orcid)
           qualify row_number() over (partition by a.paper_id, a."order" order by k.author_id) = 1""",
        (
            "stored",
            """select c_custkey as author_id, case c_custkey % 3 when 0 then 'John Smith' when 1 then 'Bo Jones' else concat('Jan Author', cast(c_custkey % 60 as varchar)) end as name,
                 case when c_custkey % 2 = 0 then concat('0000-', cast(c_custkey % 7 as varchar)) end as orcid from customer""",
        ),
    ),
)
def link_authors(spark: SparkSession, folder: str) -> DataFrame:
    stored = B.table(spark, folder, "customer").selectExpr(
        "c_custkey as author_id",
        "case c_custkey % 3 when 0 then 'John Smith' when 1 then 'Bo Jones' else concat('Jan Author', c_custkey % 60) end as name",
        "case when c_custkey % 2 = 0 then concat('0000-', c_custkey % 7) end as orcid",
    )
    incoming = (
        B.authors_v(spark, folder)
        .withColumn("orcid", F.expr("case when paper_id % 3 = 2 and `order` = 0 then concat('0000-', paper_id % 10) end"))
        .groupBy("paper_id")
        .agg(F.array_sort(F.collect_list(F.struct("order", "name", "orcid"))).alias("a"))
        .select("paper_id", F.transform("a", lambda s: F.struct(s["name"].alias("name"), s["orcid"].alias("orcid"))).alias("authors"))
    )
    return L.link_authors(incoming, stored)[0]
