"""Parsing of raw reference strings: two rule sets, both as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import blank, let, matched, squeeze, strip


def _parts(value: Column, confidence: Column, name: str) -> Column:
    return F.struct(value.alias(name), confidence.alias("confidence"))


def _cascade(name: str, steps: list[tuple[Column, str]]) -> Column:
    """First non-null step with its confidence; nothing found counts as low.

    Later steps are worked out only where the earlier ones fail, each of them once.
    """

    def found(value: Column, label: str) -> Column:
        one = F.array(_parts(value, F.lit(label), name))
        return F.get(F.filter(one, lambda s: s[name].isNotNull()), F.lit(0))

    nothing = F.struct(F.lit(None).alias(name), F.lit("low").alias("confidence"))
    return F.coalesce(*[found(value, label) for value, label in steps], nothing)


def _long_enough(text: Column, pattern: str, minimum: int = 15) -> Column:
    return let(
        matched(text, pattern), lambda found: F.when(F.length(found) >= minimum, strip(found))
    )


def _without_leading_names(title: Column) -> Column:
    title = F.regexp_replace(strip(title), P.LEADING_NAMES, "")
    return strip(F.regexp_replace(title, P.LEADING_ET_AL, ""))


def extract_title(raw: Column) -> Column:
    """``struct(title, confidence)`` by the first rule set."""
    phrases = F.filter(
        F.transform(F.split(F.regexp_replace(raw, P.REFERENCE_NUMBER, ""), r"[.,;]"), strip),
        lambda p: F.length(p) > 15,
    )
    return _cascade(
        "title",
        [
            (_without_leading_names(matched(raw, P.TITLE_DOUBLE_QUOTED)), "high"),
            (_without_leading_names(matched(raw, P.TITLE_SINGLE_QUOTED)), "high"),
            (_long_enough(raw, P.TITLE_BEFORE_YEAR), "medium"),
            (_long_enough(raw, P.TITLE_BETWEEN_COMMAS), "medium"),
            (strip(matched(raw, P.TITLE_AFTER_ET_AL)), "medium"),
            (strip(matched(raw, P.TITLE_ITALICS)), "medium"),
            (_long_enough(raw, P.TITLE_BETWEEN_PERIODS), "low"),
            (F.get(phrases, F.lit(0)), "low"),
            (F.when(~blank(raw), strip(raw)), "low"),
        ],
    )


def extract_authors(raw: Column) -> Column:
    """``struct(authors, confidence)`` by the first rule set."""
    text = F.regexp_replace(raw, P.REFERENCE_NUMBER, "")
    return _cascade(
        "authors",
        [
            (strip(matched(text, P.AUTHORS_STANDARD)), "high"),
            (strip(matched(text, P.AUTHORS_FULL_NAMES)), "high"),
            (strip(matched(text, P.AUTHORS_LAST_FIRST)), "high"),
            (strip(matched(text, P.AUTHORS_WITH_AND)), "high"),
            (strip(matched(text, P.AUTHORS_BEFORE_TITLE)), "medium"),
            (strip(matched(text, P.AUTHORS_FALLBACK)), "low"),
        ],
    )


def extract_year(raw: Column) -> Column:
    """``struct(year, confidence)`` by the first rule set; the year stays text."""
    return _cascade(
        "year",
        [
            (matched(raw, P.YEAR_IN_PARENS), "high"),
            (matched(raw, P.YEAR_AFTER_COMMA), "medium"),
            (matched(raw, P.YEAR_WITH_PERIOD), "medium"),
            (matched(raw, P.YEAR_ANYWHERE), "low"),
        ],
    )


def extract_doi(raw: Column) -> Column:
    return F.coalesce(
        matched(raw, P.DOI_WITH_PREFIX), matched(raw, P.DOI_URL), matched(raw, P.DOI_BARE)
    )


def extract_venue(raw: Column) -> Column:
    return strip(
        F.coalesce(
            matched(raw, P.VENUE_PROCEEDINGS),
            matched(raw, P.VENUE_JOURNAL),
            matched(raw, P.VENUE_AFTER_IN),
        )
    )


def bulk_extract_venue(raw: Column) -> Column:
    """Venue by the second rule set: longer proceedings names, blind to case, squeezed."""
    return squeeze(
        strip(
            F.coalesce(
                matched(raw, P.BULK_VENUE_PROCEEDINGS),
                matched(raw, P.VENUE_JOURNAL),
                matched(raw, P.BULK_VENUE_AFTER_IN),
            )
        )
    )


def reference_confidence(*confidences: Column) -> Column:
    """The lowest of several confidences."""
    ordinal = F.least(
        *[F.when(c == "high", 2).when(c == "medium", 1).otherwise(0) for c in confidences]
    )
    return F.when(ordinal == 2, "high").when(ordinal == 1, "medium").otherwise("low")


def parse_references(refs: DataFrame) -> DataFrame:
    """All fields of the first rule set and their overall confidence, from ``raw_text``."""
    raw = F.col("raw_text")
    parsed = refs.select(
        "*",
        extract_title(raw).alias("_title"),
        extract_authors(raw).alias("_authors"),
        extract_year(raw).alias("_year"),
    )
    return parsed.select(
        *refs.columns,
        F.col("_title.title").alias("title"),
        F.col("_authors.authors").alias("authors"),
        F.col("_year.year").alias("year"),
        extract_doi(raw).alias("doi"),
        extract_venue(raw).alias("venue"),
        reference_confidence(
            F.col("_title.confidence"), F.col("_authors.confidence"), F.col("_year.confidence")
        ).alias("confidence"),
    )


def title_or_fallback(title: Column, raw: Column) -> Column:
    """Stored title, else the extracted one, else the raw text."""
    return F.coalesce(
        F.nullif(title, F.lit("")),
        F.nullif(extract_title(raw)["title"], F.lit("")),
        raw,
        F.lit(""),
    )


def quote_aware_squeeze(text: Column) -> Column:
    """Whitespace runs become a blank outside quotes; inside, only line breaks become blanks.

    Double quotes and apostrophes both open and close a quote.
    """
    pieces = F.split(text, "[\"']")
    marks = F.regexp_extract_all(text, F.lit("[\"']"), F.lit(0))
    parts = F.arrays_zip(pieces.alias("piece"), marks.alias("mark"))
    rebuilt = F.transform(
        parts,
        lambda part, i: F.concat(
            F.when(i % 2 == 0, squeeze(part["piece"])).otherwise(
                F.replace(part["piece"], F.lit("\n"), F.lit(" "))
            ),
            F.coalesce(part["mark"], F.lit("")),
        ),
    )
    return F.array_join(rebuilt, "")


def _clean_bulk_title(title: Column) -> Column:
    for pattern in (P.BULK_NAME_PREFIX, P.BULK_NAMES_PREFIX):
        title = F.regexp_replace(title, pattern, "")
    return strip(F.regexp_replace(squeeze(title), r"[,;:]+\s*$", ""))


def _valid_bulk_title(title: Column) -> Column:
    letters = F.length(F.regexp_replace(title, r"[^a-zA-Z]", ""))
    return (
        (F.length(title) >= 10)
        & ~F.rlike(title, F.lit(P.BULK_ONLY_NAME))
        & ~F.rlike(title, F.lit(P.BULK_ONLY_DIGITS))
        & (letters >= 5)
    )


def bulk_extract_title(raw: Column) -> Column:
    """``struct(title, confidence)`` by the second rule set: the first valid candidate."""
    return let(quote_aware_squeeze(raw), _first_valid_title)


def _first_valid_title(text: Column) -> Column:
    phrases = F.filter(
        F.transform(F.split(text, r"[.,;]"), strip),
        lambda p: (F.length(p) > 20)
        & F.rlike(p, F.lit(r"^\p{Lu}"))
        & ~F.rlike(p, F.lit(P.BULK_STARTS_WITH_NAME)),
    )
    longest = F.aggregate(
        phrases,
        F.lit(None).cast("string"),
        lambda best, p: F.when(best.isNull() | (F.length(p) > F.length(best)), p).otherwise(best),
    )
    steps = [
        (matched(text, P.BULK_TITLE_QUOTED), "high"),
        (matched(text, P.BULK_TITLE_BEFORE_YEAR), "medium"),
        (matched(text, P.BULK_TITLE_AFTER_COMMA), "medium"),
        (longest, "low"),
    ]
    candidates = F.array(
        *[_parts(_clean_bulk_title(strip(value)), F.lit(label), "title") for value, label in steps]
    )
    valid = F.filter(candidates, lambda c: F.coalesce(_valid_bulk_title(c["title"]), F.lit(False)))
    nothing = _parts(F.lit(None).cast("string"), F.lit("low"), "title")
    return F.coalesce(F.get(valid, F.lit(0)), nothing)


def bulk_extract_authors(raw: Column) -> Column:
    text = F.regexp_replace(raw, P.REFERENCE_NUMBER, "")
    return _cascade(
        "authors",
        [
            (strip(matched(text, P.BULK_AUTHORS_MULTIPLE)), "high"),
            (strip(matched(text, P.BULK_AUTHORS_INITIALS)), "high"),
            (strip(matched(text, P.BULK_AUTHORS_FULL)), "medium"),
            (strip(matched(text, P.BULK_AUTHORS_LAST_FIRST)), "medium"),
            (strip(matched(text, P.AUTHORS_FALLBACK)), "low"),
        ],
    )


def bulk_extract_year(raw: Column) -> Column:
    """``struct(year, confidence)``; a match outside the accepted range falls through."""
    first, last = P.BULK_YEAR_RANGE

    def accepted(pattern: str) -> Column:
        year = matched(raw, pattern).cast("int")
        return F.when(year.between(first, last), year)

    return _cascade(
        "year",
        [
            (accepted(P.YEAR_IN_PARENS), "high"),
            (accepted(P.YEAR_AFTER_COMMA), "medium"),
            (accepted(P.YEAR_ANYWHERE), "low"),
        ],
    )


def bulk_parse_references(refs: DataFrame) -> DataFrame:
    """Fields of the second rule set, from ``raw_text``."""
    raw = F.col("raw_text")
    parsed = refs.select(
        "*",
        bulk_extract_title(raw).alias("_title"),
        bulk_extract_authors(raw).alias("_authors"),
        bulk_extract_year(raw).alias("_year"),
    )
    return parsed.select(
        *refs.columns,
        F.col("_title.title").alias("title"),
        F.col("_title.confidence").alias("title_confidence"),
        F.col("_authors.authors").alias("authors"),
        F.col("_authors.confidence").alias("authors_confidence"),
        F.col("_year.year").alias("year"),
        F.col("_year.confidence").alias("year_confidence"),
        extract_doi(raw).alias("doi"),
        bulk_extract_venue(raw).alias("venue"),
    )
