"""Listings, lookups, counts and dashboards over the stored tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip


def _has(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def search_papers(
    papers: DataFrame, status: str | None = None, year: int | None = None, venue: str | None = None, search: str | None = None
) -> DataFrame:
    """Papers by status, year, part of the venue, and part of title or abstract, blind to case."""
    if status:
        papers = papers.where(F.col("status") == status)
    if year:
        papers = papers.where(F.col("year") == year)
    if venue:
        papers = papers.where(_has("venue", venue))
    if search:
        papers = papers.where(_has("title", search) | _has("abstract", search))
    return papers


def search_alerts(
    alerts: DataFrame,
    type: str | None = None,
    severity: str | None = None,
    is_read: bool | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Alerts by equality on each given field."""
    wanted = {"type": type, "severity": severity, "is_read": is_read, "user_id": user_id}
    for column, value in wanted.items():
        if value is not None:
            alerts = alerts.where(F.col(column) == value)
    return alerts


def pending_papers(papers: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pending papers with the smallest ids."""
    return papers.where("status = 'PENDING'").orderBy("paper_id").limit(n)


def papers_to_rescan(papers: DataFrame, diagrams: DataFrame, n: int | None = 20) -> DataFrame:
    """Up to ``n`` (None: all) accepted or reviewed papers that have diagrams, smallest ids first."""
    ready = papers.where(F.col("status").isin("VALIDATED", "NEEDS_REVIEW"))
    due = ready.join(diagrams.select("paper_id"), "paper_id", "left_semi")
    return due if n is None else due.orderBy("paper_id").limit(n)


def page(df: DataFrame, key: str, number: int = 1, limit: int = 20) -> DataFrame:
    """One page, newest first; equal times by key."""
    return df.orderBy(F.desc("created_at"), key).offset((number - 1) * limit).limit(limit)


def page_info(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages")
    )


def papers_with_authors(papers: DataFrame, paper_authors: DataFrame) -> DataFrame:
    """One row per paper and author in author order; papers without authors once, with nulls."""
    return papers.join(paper_authors.select("paper_id", "order", "name"), "paper_id", "left")


def alerts_with_paper(alerts: DataFrame, papers: DataFrame) -> DataFrame:
    """Alerts with title and DOI of their paper; alerts without a paper stay."""
    named = papers.select("paper_id", F.col("title").alias("paper_title"), F.col("doi").alias("paper_doi"))
    return alerts.join(named, "paper_id", "left")


def child_counts(papers: DataFrame, **children: DataFrame) -> DataFrame:
    """Papers with ``n_<name>`` per child table, 0 where there are none.

    Each child is counted before it is joined, so that children do not multiply each other.
    """
    for name, child in children.items():
        counts = child.groupBy("paper_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        papers = papers.join(counts, "paper_id", "left").withColumn(
            f"n_{name}", F.coalesce(f"n_{name}", F.lit(0))
        )
    return papers


def paper_details(papers: DataFrame, **children: tuple[DataFrame, Column, list[str]]) -> DataFrame:
    """Long form of a paper's page: ``(paper_id, part, sort_key, value)``.

    ``children`` gives per part the table, its ascending order within the paper and the columns
    shown. Parts are stacked, not joined, so that they never multiply each other and no paper is
    gathered into one row.
    """
    parts = [
        child.select(
            "paper_id",
            F.lit(part).alias("part"),
            order.cast("double").alias("sort_key"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in shown]).alias("value"),
        )
        for part, (child, order, shown) in children.items()
    ]
    return reduce(DataFrame.unionByName, parts).join(papers.select("paper_id"), "paper_id", "left_semi")


def similarity_desc(reports: DataFrame) -> DataFrame:
    """Reports by paper, the most similar first."""
    return reports.orderBy("paper_id", F.desc("similarity_score"), "report_id")


def classify_papers(papers: DataFrame) -> DataFrame:
    """``is_valid`` and ``is_invalid`` from the stored analysis and the status; both can hold."""
    overall = F.get_json_object("metadata", "$.validationAnalysis.overallStatus")
    analysed = F.get_json_object("metadata", "$.validationAnalysis").isNotNull()
    accepted = F.coalesce(F.col("status") == "VALIDATED", F.lit(False))
    valid = F.coalesce(overall == "VALID", F.lit(False)) | accepted
    invalid = F.coalesce(overall == "INVALID", F.lit(False)) | (
        analysed & ~F.coalesce(overall == "VALID", F.lit(False)) & ~accepted
    )
    return papers.withColumns({"is_valid": valid, "is_invalid": invalid})


def recent_by_class(classified: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` valid and first ``k`` invalid papers, newest first."""
    flags = F.array_compact(
        F.array(F.when(F.col("is_valid"), F.lit("valid")), F.when(F.col("is_invalid"), F.lit("invalid")))
    )
    labelled = classified.select("paper_id", "created_at", F.explode(flags).alias("class"))
    newest = W.partitionBy("class").orderBy(F.desc("created_at"), "paper_id")
    return (
        labelled.withColumn("pos", F.row_number().over(newest)).where(F.col("pos") <= k).select("class", "pos", "paper_id")
    )


def status_dashboard(classified: DataFrame) -> DataFrame:
    """Papers in all, per status, valid and invalid: one row from one pass."""
    return classified.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("status") == status).alias(status.lower())
            for status in ("VALIDATED", "PENDING", "NEEDS_REVIEW", "REJECTED")
        ],
        F.count_if("is_valid").alias("valid"),
        F.count_if("is_invalid").alias("invalid"),
    )


def compare_extractions(refs: DataFrame, fields: list[str]) -> DataFrame:
    """Per field ``f``: is ``f`` equal to ``cat_f``, trimmed and blind to case; blanks read N/A.

    Array fields are compared as their names joined by a comma.
    """
    kinds = dict(refs.dtypes)

    def text(name: str) -> Column:
        value = F.array_join(name, ", ") if kinds[name].startswith("array") else strip(F.col(name).cast("string"))
        return F.coalesce(value, F.lit(""))

    added: dict[str, Column] = {}
    for field in fields:
        ours, theirs = text(field), text(f"cat_{field}")
        added[f"{field}_match"] = F.lower(ours) == F.lower(theirs)
        added[f"{field}_shown"] = F.when(ours == "", "N/A").otherwise(ours)
        added[f"cat_{field}_shown"] = F.when(theirs == "", "N/A").otherwise(theirs)
    return refs.withColumns(added)


def web_status(images: DataFrame, results: DataFrame, searches: DataFrame) -> DataFrame:
    """Outcome of the web search per image.

    ``results`` are found pages ``(image_id, url)``, ``searches`` the search runs ``(image_id,
    best_guess, error)``. Failed searches are not found and carry their error.
    """
    pages = results.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pages"))
    joined = images.join(searches, "image_id", "left").join(pages, "image_id", "left")
    failed = F.col("error").isNotNull()
    count = F.when(failed, F.lit(0)).otherwise(F.coalesce("n_pages", F.lit(0)))
    return joined.withColumn("n_matches", count).select(
        *images.columns,
        (F.col("n_matches") > 0).alias("found"),
        "n_matches",
        F.when(~failed, F.col("best_guess")).alias("best_guess"),
        "error",
        (F.col("n_matches") > 0).alias("is_copied"),
    )


def web_match_analytics(images: DataFrame) -> DataFrame:
    """Copied images with their share, originals, and the matches found, as one row.

    Reads ``searched, is_copied, n_matches, n_pages``.
    """
    copied = F.count_if("is_copied")
    return images.agg(
        copied.alias("copied"),
        F.coalesce(F.floor(try_share(copied, F.count(F.lit(1))) * 100 + 0.5), F.lit(0)).cast("bigint").alias("copied_pct"),
        F.count_if(~F.col("is_copied") & F.col("searched")).alias("originals"),
        F.sum("n_matches").alias("total_matches"),
        F.sum("n_pages").alias("matching_pages"),
    )


def try_share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def daily_summary(papers: DataFrame, refs: DataFrame, diagrams: DataFrame, as_of: datetime) -> DataFrame:
    """Counts of the last 24 hours before ``as_of`` and the message that reports them.

    Reads papers ``created_at, validated_at, updated_at, status``, refs and diagrams ``updated_at``.
    """
    since = F.lit(as_of) - F.expr("interval 1 day")
    recent = lambda column: F.col(column) >= since
    of_papers = papers.agg(
        F.count_if(recent("created_at")).alias("new_papers"),
        F.count_if((F.col("status") == "VALIDATED") & recent("validated_at")).alias("validated_papers"),
        F.count_if((F.col("status") == "REJECTED") & recent("updated_at")).alias("rejected_papers"),
    )
    of_refs = refs.agg(F.count_if((F.col("status") == "INVALID") & recent("updated_at")).alias("invalid_refs"))
    of_diagrams = diagrams.agg(F.count_if(F.col("is_suspicious") & recent("updated_at")).alias("suspicious_diagrams"))
    # Three one-row aggregates side by side.
    row = of_papers.crossJoin(of_refs).crossJoin(of_diagrams)
    return row.withColumn("message", summary_message())


def summary_message() -> Column:
    # fixed values: wording of the report
    lines = [
        ("- New Papers: ", "new_papers"),
        ("- Validated: ", "validated_papers"),
        ("- Rejected: ", "rejected_papers"),
        ("- Invalid References: ", "invalid_refs"),
        ("- Suspicious Diagrams: ", "suspicious_diagrams"),
    ]
    return F.concat_ws(
        "\n", F.lit("Daily Summary (Last 24 hours):"), *[F.concat(F.lit(text), F.col(c)) for text, c in lines]
    )


def import_summary(results: DataFrame) -> DataFrame:
    """Imported, skipped and all rows of an import."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("imported").alias("imported"),
        F.count_if(~F.col("imported")).alias("skipped"),
    )


def upload_summary(results: DataFrame) -> DataFrame:
    """Successes and failures of an upload batch."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def upload_errors(results: DataFrame) -> DataFrame:
    """Failed files with their errors, one per row."""
    return results.where("error is not null").select("filename", "error")


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Row that comes first in ``order`` per key, pre-aggregated before the exchange."""
    others = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*others), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"first.{c}") for c in others])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Row that comes last in ``order`` per key: last write wins."""
    others = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*others), F.struct(*order)).alias("last")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"last.{c}") for c in others])


def dedup_ci(df: DataFrame, keys: list[str], column: str, pos: str) -> DataFrame:
    """One spelling per key of texts that differ in case only: the first by ``pos``."""
    lowered = df.withColumn("_lower", F.lower(F.col(column)))
    return first_per_key(lowered, [*keys, "_lower"], [pos]).drop("_lower").select(*df.columns)


def distinct_paths(paths: DataFrame) -> DataFrame:
    return paths.dropDuplicates(["path"])


def figure_order(images: DataFrame) -> DataFrame:
    """Running figure number of every paper over its pages and images.

    Numbers run within a page and start after the figures of the pages before it, so that a task
    never holds more than a page.
    """
    before = F.coalesce(
        F.sum("n").over(W.partitionBy("paper_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    starts = (
        images.groupBy("paper_id", "page")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("paper_id", "page", before.alias("before"))
    )
    on_page = F.row_number().over(W.partitionBy("paper_id", "page").orderBy("image_id"))
    return (
        images.withColumn("on_page", on_page)
        .join(starts, ["paper_id", "page"])
        .withColumn("figure", F.col("before") + F.col("on_page"))
        .drop("before", "on_page")
    )


def link_authors(incoming: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find-or-create of authors for incoming papers ``(paper_id, authors array<struct<name,orcid>>)``.

    Returns the links ``(paper_id, author_id, name, orcid, order, is_corresponding)`` and the
    authors to insert. A name with an orcid needs both to agree; without one the name suffices.
    New authors have a null id in the links and are unique by (name, orcid).
    """
    listed = incoming.select("paper_id", F.posexplode("authors").alias("order", "a")).select(
        "paper_id",
        F.col("order"),
        (F.col("order") == 0).alias("is_corresponding"),
        F.col("a.name").alias("name"),
        F.nullif(F.col("a.orcid"), F.lit("")).alias("orcid"),
    )
    by_orcid = authors.where("orcid is not null").groupBy("name", "orcid").agg(F.min("author_id").alias("with_orcid"))
    by_name = authors.groupBy("name").agg(F.min("author_id").alias("with_name"))
    linked = listed.join(by_orcid, ["name", "orcid"], "left").join(by_name, "name", "left")
    links = linked.select(
        "paper_id",
        F.when(F.col("orcid").isNotNull(), F.col("with_orcid")).otherwise(F.col("with_name")).alias("author_id"),
        "name",
        "orcid",
        "order",
        "is_corresponding",
    )
    new = links.where("author_id is null").select("name", "orcid").distinct()
    # A nameless-orcid mention finds an author inserted with one for the same name.
    with_orcid = new.where("orcid is not null").select("name").distinct()
    plain = new.where("orcid is null").join(with_orcid, "name", "left_anti").select("name", "orcid")
    return links, new.where("orcid is not null").unionByName(plain)


def jobs_matching(jobs: DataFrame, pattern: str) -> DataFrame:
    return jobs.where(F.contains(F.col("job_id"), F.lit(pattern)))
