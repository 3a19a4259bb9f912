"""Decisions: metadata checks, paper and upload status, diagram scores, percentages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DOI_FORMAT
from ..functions.text import blank, joined_notes, score_text, strip


def _note(condition: Column, text: str | Column) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text)


def validate_metadata(papers: DataFrame, as_of: date) -> DataFrame:
    """Adds ``errors``, ``warnings`` (arrays) and ``is_valid``; needs ``n_authors``."""
    title, year, doi = F.col("title"), F.col("year"), F.col("doi")
    no_title = title.isNull() | (strip(title) == "")
    no_year = F.coalesce(year, F.lit(0)) == 0
    wrong_year = ~no_year & ((year < 1900) | (year > as_of.year + 1))
    errors = F.array_compact(
        F.array(
            _note(no_title, "Title is required"),
            _note(F.coalesce("n_authors", F.lit(0)) == 0, "At least one author is required"),
            _note(wrong_year, F.concat(F.lit("Invalid publication year: "), year)),
            _note(~blank(doi) & ~F.rlike(doi, F.lit(DOI_FORMAT)), "DOI format appears invalid"),
        )
    )
    warnings = F.array_compact(
        F.array(
            _note(~no_title & (F.length(title) < 10), "Title seems too short"),
            _note(no_year, "Publication year is missing"),
            _note(blank(F.col("venue")), "Venue (journal/conference) is missing"),
            _note(blank(doi), "DOI is missing - this helps with verification"),
        )
    )
    return papers.withColumns({"errors": errors, "warnings": warnings}).withColumn(
        "is_valid", F.size("errors") == 0
    )


def decide_paper_status(papers: DataFrame) -> DataFrame:
    """Status, review flag, notes and reason of every checked paper.

    Reads ``source, n_authors, service_down, is_valid, errors, warnings, is_duplicate,
    similarity, has_abstract, has_conclusion`` and of the catalogue match ``checked, found,
    match_score, title_match, year_match, author_match, differences, match_warnings``.
    """
    c = F.col
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    empty = F.array().cast("array<string>")
    duplicate = flag("is_duplicate")
    similar = score_text(c("similarity"))
    waiting = (c("source") == "upload") & flag("service_down") & (F.coalesce("n_authors", F.lit(0)) == 0)
    copied = duplicate & (c("similarity") > 0.9)
    full_match = (c("match_score") >= 0.7) & flag("title_match") & flag("year_match") & flag("author_match")

    mismatches = F.array_compact(
        F.array(
            _note(~flag("title_match"), "Title mismatch with OpenAlex"),
            _note(~flag("year_match"), "Year mismatch with OpenAlex"),
            _note(~flag("author_match"), "Author mismatch with OpenAlex"),
        )
    )
    low = F.concat(
        F.lit("OpenAlex validation failed (match score: "), F.format_string("%.2f", c("match_score")), F.lit(")")
    )
    catalogue_notes = (
        F.when(~flag("checked"), empty)
        .when(~flag("found"), F.array(F.lit("No matching paper found in OpenAlex database")))
        .when(c("match_score") < 0.7, F.concat(F.array(low), F.coalesce(c("differences"), empty)))
        .when(~full_match, mismatches)
        .otherwise(F.coalesce(c("match_warnings"), empty))
    )
    concerned = (F.size("warnings") > 0) | duplicate
    complete = (
        flag("has_abstract")
        & flag("has_conclusion")
        & ~flag("service_down")
        & (~flag("checked") | (flag("found") & full_match))
    )
    missing_sections = F.when(
        flag("service_down"), F.array(F.lit("PDF processing service unavailable"))
    ).otherwise(
        F.array_compact(
            F.array(
                _note(~flag("has_abstract"), "Abstract not found in PDF"),
                _note(~flag("has_conclusion"), "Conclusion section not found in PDF"),
            )
        )
    )
    status = (
        F.when(waiting, "NEEDS_REVIEW")
        .when(~c("is_valid") | copied, "REJECTED")
        .when(~concerned & complete, "VALIDATED")
        .otherwise("NEEDS_REVIEW")
    )
    notes = (
        F.when(waiting, F.array(F.lit("PDF service unavailable - metadata extraction pending")))
        .when(~c("is_valid"), c("errors"))
        .when(copied, F.array(F.concat(F.lit("Duplicate detected (similarity: "), similar, F.lit(")"))))
        .when(concerned, F.concat(catalogue_notes, c("warnings")))
        .when(complete, catalogue_notes)
        .otherwise(F.concat(catalogue_notes, missing_sections))
    )
    reason = F.when(
        waiting,
        F.lit("PDF processing service unavailable. Please start the Python service or add metadata manually."),
    ).when(
        c("is_valid") & ~copied & duplicate,
        F.concat(F.lit("Possible duplicate (similarity: "), similar, F.lit(")")),
    )
    return (
        papers.withColumns({"status": status, "_notes": notes})
        .withColumn("needs_review", F.col("status") == "NEEDS_REVIEW")
        .withColumn("validation_notes", F.array_join("_notes", "; "))
        .withColumn("review_reason", F.coalesce(reason, F.col("validation_notes")))
        .drop("_notes")
    )


def decide_upload_status(uploads: DataFrame) -> DataFrame:
    """First and final status of an uploaded paper and the reason for a review.

    Reads ``is_duplicate, similarity, extraction_failed, checked, found, match_score,
    differences, overall_status``.
    """
    c = F.col
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    copied = flag("is_duplicate") & (c("similarity") > 0.9)
    first = F.when(
        flag("is_duplicate"),
        F.concat(F.lit("Possible duplicate (similarity: "), score_text(c("similarity")), F.lit(")")),
    ).when(
        flag("extraction_failed"),
        F.lit("PDF metadata extraction failed. Please process manually or start the PDF service."),
    )
    not_found = flag("checked") & ~flag("found")
    weak = flag("checked") & flag("found") & (c("match_score") < 0.7)
    second = F.when(
        not_found,
        F.when(first.isNull(), "No matching paper found in OpenAlex database").otherwise(
            "No matching paper found in OpenAlex"
        ),
    ).when(weak, F.concat(F.lit("OpenAlex validation issues: "), F.array_join("differences", ", ")))
    review = flag("is_duplicate") | flag("extraction_failed") | not_found | weak
    initial = F.when(review, "NEEDS_REVIEW").otherwise("PENDING")
    return uploads.select(
        "*",
        copied.alias("refused"),
        review.alias("needs_review"),
        F.nullif(joined_notes(first, second), F.lit("")).alias("review_reason"),
        initial.alias("initial_status"),
        F.when(c("overall_status") == "VALID", "VALIDATED").otherwise(initial).alias("final_status"),
    )


def score_diagram(evidence: DataFrame) -> DataFrame:
    """Confidence, indicators and decision per diagram.

    Reads ``hash_sim, ssim, best_match_pct, web_found``.
    """
    c = F.col
    strong_hash, high_ssim = c("hash_sim") > 0.9, c("ssim") > 0.75
    local, web = c("best_match_pct") / 100.0 > 0.35, c("web_found")
    points = [(strong_hash, 0.3), (high_ssim, 0.4), (local, 0.2), (web, 0.3)]
    confidence = sum((F.when(hit, F.lit(p)).otherwise(F.lit(0.0)) for hit, p in points), F.lit(0.0))
    indicators = F.array_compact(
        F.array(
            _note(strong_hash, "Strong hash match detected"),
            _note(high_ssim, F.format_string("High SSIM similarity: %.2f", c("ssim"))),
            _note(local, F.format_string("ORB match percentage: %.2f%%", c("best_match_pct"))),
            _note(web, "Visually similar images found on Google"),
        )
    )
    decision = (
        F.when(F.col("confidence") >= 0.7, "heavily plagiarized")
        .when(F.col("confidence") >= 0.4, "partially plagiarized")
        .otherwise("original")
    )
    return evidence.withColumns({"confidence": confidence, "indicators": indicators}).withColumn(
        "decision", decision
    )


def plagiarism_summary(scored: DataFrame) -> DataFrame:
    """Counts per decision, mean confidence and risk level per job."""
    heavy = F.count_if(F.col("decision") == "heavily plagiarized")
    partial = F.count_if(F.col("decision") == "partially plagiarized")
    totals = scored.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("decision") == "original").alias("original"),
        partial.alias("partially_plagiarized"),
        heavy.alias("heavily_plagiarized"),
        F.avg("confidence").alias("average_confidence"),
    )
    high = (F.col("heavily_plagiarized") > 0) | (F.col("partially_plagiarized") > F.col("total") * 0.5)
    return totals.withColumn(
        "risk_level",
        F.when(high, "high").when(F.col("partially_plagiarized") > 0, "medium").otherwise("low"),
    )


def is_likely_copied(pairs: DataFrame) -> DataFrame:
    """Whether an image pair looks copied, feature matches named first."""
    orb, ssim = F.col("orb_score") > 0.35, F.col("ssim") > 0.65
    return pairs.select(
        "*",
        (orb | ssim).alias("likely_copied"),
        F.when(orb, "ORB matches > 35%").when(ssim, "SSIM > 0.65").otherwise("Below thresholds").alias("reason"),
    )


def web_suspicion(matches: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Per diagram: is it on the web, with score ``min(n/10, 1)``.

    ``matches`` has one row per web match. With ``local`` (diagram_id, is_suspicious,
    similarity_score) the larger of both scores counts.
    """
    found = (
        matches.groupBy("diagram_id")
        .agg(F.count(F.lit(1)).alias("n_matches"))
        .withColumn("web_score", F.least(F.col("n_matches") / 10.0, F.lit(1.0)))
    )
    if local is None:
        return found.select(
            "diagram_id", "n_matches", F.col("web_score").alias("similarity_score"), F.lit(True).alias("is_suspicious")
        )
    return local.join(found, "diagram_id", "left").select(
        "diagram_id",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.greatest("similarity_score", "web_score").alias("similarity_score"),
        (F.coalesce("is_suspicious", F.lit(False)) | F.col("web_score").isNotNull()).alias("is_suspicious"),
    )


def reference_summary(refs: DataFrame) -> DataFrame:
    """Valid, invalid, missing and all references per paper with the valid share in percent."""
    return refs.groupBy("paper_id").agg(
        F.count_if(F.col("status") == "VALID").alias("valid"),
        F.count_if(F.col("status") == "INVALID").alias("invalid"),
        F.count_if(F.col("status") == "MISSING").alias("missing"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if(F.col("status") == "VALID") / F.count(F.lit(1)) * 100).alias("valid_pct"),
    )


def content_summary(checks: DataFrame) -> DataFrame:
    """Share of references cited in the text, in percent per paper."""
    return checks.groupBy("paper_id").agg(
        F.count_if("cited").alias("cited"),
        F.count(F.lit(1)).alias("total_refs"),
        (F.count_if("cited") / F.count(F.lit(1)) * 100).alias("cited_pct"),
    )


def overall_verdict(summary: DataFrame, minimum: float = 75.0) -> DataFrame:
    """VALID when both percentages reach the bound, with the reason in words.

    Reads ``valid_pct`` and ``cited_pct``.
    """
    refs, cited = F.col("valid_pct"), F.col("cited_pct")
    good = (refs >= minimum) & (cited >= minimum)
    bound = f"{minimum:g}%%"
    reason = F.when(
        good,
        F.format_string(
            f"Both reference validation (%.1f%%) and content check (%.1f%%) meet the {bound} threshold.", refs, cited
        ),
    ).otherwise(
        joined_notes(
            _note(refs < minimum, F.format_string(f"Reference validation is %.1f%% (below {bound} threshold)", refs)),
            _note(cited < minimum, F.format_string(f"Content check is %.1f%% (below {bound} threshold)", cited)),
        )
    )
    return summary.select(
        "*", F.when(good, "VALID").otherwise("INVALID").alias("overall_status"), reason.alias("reason")
    )
