"""Are references and figures mentioned in the body text?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import FIGURE_CALLOUT
from ..functions.text import blank, strip

TITLE_CASE = r"(?U)^\P{L}*(?:\p{Lu}\p{Ll}*(?:\P{L}+|$))+$"


def citation_numbers(texts: DataFrame) -> DataFrame:
    """Distinct ``(paper_id, number, exact)`` of bracketed citations; numbers stay text.

    ``[1-5]`` cites 1 and 5. ``exact`` tells numbers that stand alone in brackets.
    """
    groups = F.regexp_extract_all("text", F.lit(r"\[([^\]]*)\]"), F.lit(1))
    tokens = F.flatten(F.transform(groups, lambda g: F.split(g, r"[,\s-]")))
    numbers = F.filter(
        F.transform(tokens, lambda t: F.regexp_replace(t, r"^.*\[", "")), lambda t: F.rlike(t, F.lit(r"^\d+$"))
    )
    alone = F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))
    listed = texts.select(
        "paper_id", F.array_distinct(numbers).alias("numbers"), F.array_distinct(alone).alias("alone")
    )
    return listed.select("paper_id", F.explode("numbers").alias("number"), "alone").select(
        "paper_id", "number", F.array_contains("alone", F.col("number")).alias("exact")
    )


def _possible_names(authors: Column) -> Column:
    clean = F.regexp_replace(authors, r"(?i)\s+et\s+al\.?", "")
    first = strip(F.get(F.split(clean, ","), F.lit(0)))
    parts = F.split(first, r"[\s,]+")
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 2) & F.rlike(p, F.lit(TITLE_CASE))))


def capitalized_words(texts: DataFrame, minimum: int = 2) -> DataFrame:
    """``(paper_id, word, n)`` of words with a capital that occur at least ``minimum`` times."""
    words = F.filter(
        F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.rlike(w, F.lit(r"\p{Lu}"))
    )
    return (
        texts.select("paper_id", F.explode(words).alias("word"))
        .groupBy("paper_id", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= minimum)
    )


def citation_number_check(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """References with ``cited_by_number``: their number stands in a bracket of their paper's text."""
    cited = citation_numbers(texts).select(
        "paper_id", F.col("number").alias("number"), F.lit(True).alias("_hit"), "exact"
    )
    numbered = refs.withColumn("number", F.col("ord").cast("string"))
    return (
        numbered.join(cited, ["paper_id", "number"], "left")
        .withColumn("cited_by_number", F.coalesce("_hit", F.lit(False)))
        .withColumn("exact", F.coalesce("exact", F.lit(False)))
        .drop("_hit", "number")
    )


def author_mention_check(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(paper_id, ord, author_name)``: first author-like name that the text has at least twice.

    Plain names meet the word counts of their text; names with hyphens and the like are counted
    in the text itself.
    """
    authors = F.coalesce(F.nullif("authors", F.lit("")), F.col("raw_text"))
    names = refs.select(
        "paper_id", "ord", F.posexplode(_possible_names(authors)).alias("pos", "name")
    )
    plain = F.rlike("name", F.lit(r"(?U)^\w+$"))
    words = capitalized_words(texts).withColumnRenamed("word", "name")
    counted = names.where(plain).join(words, ["paper_id", "name"], "left_semi")
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.col("name"), F.lit(r"\E\b"))
    spelled = (
        names.where(~plain)
        .join(texts, "paper_id")
        .where(F.regexp_count("text", quoted) >= 2)
        .select(*counted.columns)
    )
    return (
        counted.unionByName(spelled)
        .groupBy("paper_id", "ord")
        .agg(F.min_by("name", "pos").alias("author_name"))
    )


def content_checks(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(paper_id, ord, cited, reason)``: by number first, then by author name."""
    numbered = citation_number_check(refs, texts).select("paper_id", "ord", "cited_by_number", "exact")
    named = author_mention_check(refs, texts)
    known = texts.select("paper_id", (~blank(F.col("text"))).alias("has_text"))
    joined = numbered.join(named, ["paper_id", "ord"], "left").join(known, "paper_id", "left")
    has_text = F.coalesce("has_text", F.lit(False))
    number = F.col("ord").cast("string")
    reason = (
        F.when(~has_text, F.lit("No text content available"))
        .when(F.col("exact"), F.concat(F.lit("Found citation ["), number, F.lit("]")))
        .when(F.col("cited_by_number"), F.concat(F.lit("Found citation number "), number, F.lit(" in text")))
        .when(
            F.col("author_name").isNotNull(),
            F.concat(F.lit("Found author name '"), F.col("author_name"), F.lit("' in text")),
        )
        .otherwise(F.lit("Citation number or author name not found in text"))
    )
    cited = F.col("cited_by_number") | F.col("author_name").isNotNull()
    return joined.select("paper_id", "ord", cited.alias("cited"), reason.alias("reason"))


def figure_callouts(texts: DataFrame) -> DataFrame:
    """Mentions per figure number; a figure counts as cited with two."""
    found = texts.select(
        "paper_id", F.explode(F.regexp_extract_all("text", F.lit(FIGURE_CALLOUT), F.lit(1))).alias("digits")
    )
    counts = (
        found.select("paper_id", F.col("digits").try_cast("bigint").alias("figure"))
        .groupBy("paper_id", "figure")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    valid = F.col("mentions") >= 2
    return counts.select(
        "*",
        valid.alias("valid"),
        F.when(valid, F.format_string("Found %d times", "mentions"))
        .otherwise(F.format_string("Found only %d time(s)", "mentions"))
        .alias("reason"),
    )


def merge_content_checks(refs: DataFrame, checks: DataFrame) -> DataFrame:
    """References with their check attached as ``content_check`` (null when there is none)."""
    attached = checks.select("paper_id", "ord", F.struct(F.col("cited").alias("valid"), "reason").alias("content_check"))
    return refs.join(attached, ["paper_id", "ord"], "left")
