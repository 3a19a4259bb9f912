"""Bulk extraction from document texts and pages, one job over all papers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..functions.text import blank, let, matched, squeeze, strip


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def references_page(page_text: DataFrame) -> DataFrame:
    """``(paper_id, references_page)``: first page from the second on that opens with a reference
    heading, -1 where there is none."""
    lines = F.split(F.lower("text"), "\n")

    def headed(keyword: str) -> Column:
        return F.exists(
            lines,
            lambda line: F.contains(line, F.lit(keyword))
            & ((F.length(strip(line)) < 100) | F.rlike(line, F.lit(r"\d"))),
        )

    hit = (F.col("page") >= 2) & _any([headed(k) for k in P.REFERENCE_HEADINGS])
    return page_text.groupBy("paper_id").agg(
        F.coalesce(F.min(F.when(hit, F.col("page"))), F.lit(-1)).alias("references_page")
    )


def references_section(text: Column) -> Column:
    """Text behind the first reference heading, else the whole text."""
    return F.coalesce(*[matched(text, f"(?is){pattern}") for pattern in P.SECTION_HEADINGS], text)


def references_pages(page_text: DataFrame) -> DataFrame:
    """Pages ``(paper_id, page, text)`` that hold the reference list.

    A page with a heading starts a run, which goes on as long as the pages behind it look like
    references. Of a paper without any heading all pages count.
    """
    by_page = W.partitionBy("paper_id").orderBy("page")
    heading = F.rlike("text", F.lit(P.HEADING_ON_PAGE))
    flagged = page_text.select("paper_id", "page", "text", heading.alias("heading")).withColumn(
        "breaks", (F.col("heading") | ~F.rlike("text", F.lit(P.REFERENCE_LIKE_OR_ET_AL))).cast("int")
    )
    runs = flagged.withColumn("run", F.sum("breaks").over(by_page))
    belongs = F.first("heading").over(W.partitionBy("paper_id", "run").orderBy("page")) & (F.col("run") > 0)
    headed = F.max("heading").over(W.partitionBy("paper_id"))
    return (
        runs.withColumn("belongs", belongs)
        .withColumn("headed", headed)
        .where("belongs or not headed")
        .select("paper_id", "page", "text")
    )


def split_references(sections: DataFrame) -> DataFrame:
    """Numbered references ``(paper_id, ord, raw_text)`` of a reference section.

    A body ends at the next number in brackets or at the end of the section, over any number of
    lines, and needs more than 15 characters. Sections without any are read as ``Author (year) rest``.
    """

    def groups(pattern: str, *numbers: int) -> list[Column]:
        return [F.regexp_extract_all("section", F.lit(pattern), F.lit(n)) for n in numbers]

    numbers, bodies = groups(P.NUMBERED_REFERENCE, 1, 2)
    authors, years, rests = groups(P.DATED_REFERENCE, 1, 2, 3)
    by_number = F.filter(
        F.zip_with(
            numbers, bodies, lambda n, b: F.struct(n.try_cast("int").alias("ord"), strip(b).alias("raw_text"))
        ),
        lambda r: F.length(r["raw_text"]) > 15,
    )
    listed = F.transform(
        F.arrays_zip(authors.alias("a"), years.alias("y"), rests.alias("r")),
        lambda x, i: F.struct(
            (i + 1).alias("ord"),
            F.concat(x["a"], F.lit(" ("), x["y"], F.lit(") "), strip(x["r"])).alias("raw_text"),
        ),
    )
    found = sections.select("paper_id", by_number.alias("by_number"), "section").select(
        "paper_id", F.when(F.size("by_number") > 0, F.col("by_number")).otherwise(listed).alias("refs")
    )
    return found.select("paper_id", F.inline("refs"))


def split_multi_paper(refs: DataFrame) -> DataFrame:
    """References that list several papers of one author, one row each: adds ``sub_order``.

    Needs two quoted titles, and two volumes or two years; the author is put before every paper
    but the first. Other references stay as they are with sub-order 0.
    """
    text = F.col("raw_text")
    several = (F.regexp_count(text, F.lit(P.LISTED_TITLE)) >= 2) & (
        (F.regexp_count(text, F.lit(r"(?i)(?U)\bvol\.")) >= 2)
        | (F.regexp_count(text, F.lit(r"(?U)\b(19|20)\d{2}\b")) >= 2)
    )
    entries = F.regexp_extract_all(text, F.lit(P.LISTED_PAPER), F.lit(0))

    def starts(found: Column) -> Column:
        first = F.struct(F.lit(1).alias("from_"), F.array().cast("array<int>").alias("at"))

        def locate(state: Column, piece: Column) -> Column:
            at = F.call_function("locate", piece, text, state["from_"])
            return F.struct((at + F.length(piece)).alias("from_"), F.concat(state["at"], F.array(at)).alias("at"))

        return F.aggregate(found, first, locate, lambda s: s["at"])

    def pieces(at: Column) -> Column:
        def piece(begin: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(at, i + 1), F.length(text) + 1)
            body = strip(F.substring(text, begin, stop - begin))
            body = F.when(i < F.size(at) - 1, F.regexp_replace(body, r"\.$", "")).otherwise(body)
            prefix = matched(text, P.LISTED_AUTHOR)
            return F.when((i > 0) & prefix.isNotNull(), F.concat(prefix, F.lit(", "), body)).otherwise(body)

        return F.transform(at, piece)

    parts = F.when(several & (F.size(entries) >= 2), let(let(entries, starts), pieces)).otherwise(F.array(text))
    others = [c for c in refs.columns if c != "raw_text"]
    return refs.select(*others, F.posexplode(parts).alias("sub_order", "raw_text"))


def split_order(parts: DataFrame) -> DataFrame:
    """Order of split references as (ord, sub_order) in place of a fractional number."""
    return parts.withColumn("position", F.struct("ord", "sub_order"))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def first_page_title(text: Column) -> Column:
    """Title lines of a first page, joined: from the first title-like line to authors or affiliation."""
    starts_like_name = lambda line: F.rlike(line, F.lit(P.FIRST_PAGE_STARTS_LIKE_NAME))

    def title_like(line: Column) -> Column:
        return (
            (F.length(line) > 15)
            & ~F.rlike(line, F.lit(P.FIRST_PAGE_NAME))
            & ~F.rlike(line, F.lit(P.FIRST_PAGE_NAME_INITIAL))
            & ~F.rlike(line, F.lit(P.FIRST_PAGE_DATE))
        )

    def ends_title(line: Column) -> Column:
        affiliation = _any([F.contains(line, F.lit(mark)) for mark in P.FIRST_PAGE_AFFILIATIONS])
        goes_on = (F.length(line) > 10) & ~F.rlike(line, F.lit("(?i)@|http|doi"))
        # A title-like line ends the title by affiliation, another one if it does not go on.
        return F.when(starts_like_name(line), F.lit(True)).when(affiliation, ~goes_on | title_like(line)).otherwise(
            ~goes_on & ~title_like(line)
        )

    def position(lines: Column, wanted: Callable[[Column], Column]) -> Column:
        """Number of the first wanted line, else 0; lines behind it are not looked at."""
        return F.aggregate(
            lines, F.lit(0), lambda n, line: F.when(n > 0, n).otherwise(F.when(wanted(line), 1 - n).otherwise(n - 1)),
            lambda n: F.greatest(n, F.lit(0)),
        )

    def joined(kept: Column, first: Column) -> Column:
        def upto(rest: Column) -> Column:
            stop = position(F.slice(rest, F.lit(2), F.size(rest)), ends_title)
            lines = let(stop, lambda n: F.slice(rest, F.lit(1), F.when(n > 0, n).otherwise(F.size(rest))))
            return F.array_join(lines, " ")

        return let(F.when(first > 0, F.slice(kept, first, F.size(kept))), upto)

    def skipped(line: Column) -> Column:
        def hit(pattern: str, needs: list[str]) -> Column:
            found = F.rlike(line, F.lit(pattern))
            return _any([F.contains(F.lower(line), F.lit(n)) for n in needs]) & found if needs else found

        return _any([hit(p, n) for p, n in zip(P.FIRST_PAGE_SKIP, P.FIRST_PAGE_SKIP_NEEDS, strict=True)])

    # Each value is worked out once per row: lambdas share nothing by themselves.
    title = let(
        F.filter(_lines(text), lambda line: ~skipped(line)),
        lambda kept: let(position(kept, title_like), lambda first: joined(kept, first)),
    )
    clean = F.regexp_replace(squeeze(strip(title)), r"[.,;:]+\s*$", "")
    return let(clean, lambda c: F.when(F.length(c) > 10, c)).alias("title")


def first_page_authors(text: Column) -> Column:
    """Lines that are names, up to the first line with an address or an institute."""

    def names(lines: Column) -> Column:
        stop = F.array_position(
            F.transform(lines, lambda line: F.contains(line, F.lit("@")) | F.contains(line, F.lit("Engineering"))),
            True,
        ).cast("int")
        upto = F.when(stop == 0, lines).otherwise(F.slice(lines, F.lit(1), stop))
        name = P.FIRST_PAGE_AUTHOR.removeprefix("^").removesuffix("$")
        likely = F.filter(upto, lambda line: F.rlike(line, F.lit(rf"(?U)^\s*{name}\s*$")))
        return F.filter(
            F.transform(likely, strip), lambda line: F.rlike(line, F.lit("(?U)" + P.FIRST_PAGE_AUTHOR))
        )

    return let(F.split(text, "\n"), names)


def first_page_year(text: Column) -> Column:
    return F.coalesce(matched(text, P.MONTH_DATE), matched(text, P.RECENT_YEAR)).try_cast("int")


def second_page_title(text: Column) -> Column:
    """Longest line of a second page that starts with a capital, the first of equals."""

    def longest(lines: Column) -> Column:
        return F.aggregate(
            F.filter(F.transform(lines, strip), lambda line: F.rlike(line, F.lit("^[A-Z]"))),
            F.lit(None).cast("string"),
            lambda best, line: F.when(best.isNull() | (F.length(line) > F.length(best)), line).otherwise(best),
        )

    clean = F.trim(squeeze(longest(F.split(text, "\n"))))
    clean = F.regexp_replace(clean, P.TITLE_LABEL, "")
    clean = F.regexp_replace(clean, r"[.!?]+$", "")
    return F.nullif(clean, F.lit(""))


def extract_abstract(text: Column) -> Column:
    """Text between the abstract heading and the next section."""
    return strip(matched(text, P.ABSTRACT_SECTION))


def section_flags(texts: DataFrame) -> DataFrame:
    return texts.select(
        "paper_id",
        F.rlike("text", F.lit("(?i)abstract")).alias("has_abstract"),
        F.rlike("text", F.lit("(?i)conclusion|concluding")).alias("has_conclusion"),
    )


def fallback_authors_year(metadata: DataFrame) -> DataFrame:
    """Authors and year from file metadata.

    Reads ``authors array<string>, author, year, creation_date, mod_date``: the list, else the
    author field split at commas and semicolons; the year, else the first four digits of the
    creation date, or of the modification date where there is no creation date.
    """
    split = F.filter(F.transform(F.split("author", "[,;]"), strip), lambda a: a != "")
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(
        F.coalesce(split, F.array().cast("array<string>"))
    )
    dated = F.when(~blank(F.col("creation_date")), F.col("creation_date")).otherwise(F.col("mod_date"))
    year = F.coalesce(F.nullif("year", F.lit(0)), matched(dated, r"(\d{4})").try_cast("int"))
    return metadata.withColumns({"authors": authors, "year": year})


RESPONSE_SCHEMA = (
    "struct<references: array<struct<title: string, authors: string, year: string, conference: string,"
    " journal: string, type: string>>>"
)


def parse_llm_responses(raw: DataFrame) -> DataFrame:
    """References out of stored model responses ``(paper_id, response)``.

    Code fences are taken off; a response that is not JSON gives no rows.
    """
    text = F.regexp_replace(strip(F.col("response")), r"^```json|^```", "")
    text = strip(F.regexp_replace(text, r"```$", ""))
    parsed = raw.select("paper_id", F.from_json(text, RESPONSE_SCHEMA).alias("r")).select(
        "paper_id", F.posexplode("r.references").alias("pos", "ref")
    )
    ref = F.col("ref")
    names = F.filter(F.transform(F.split(ref["authors"], ","), strip), lambda a: a != "")
    year = F.when(F.rlike(F.trim(ref["year"]), F.lit(r"^[+-]?\d+(\.\d+)?$")), ref["year"].try_cast("double").try_cast("int"))
    return parsed.select(
        "paper_id",
        (F.col("pos") + 1).alias("ord"),
        F.concat(
            F.coalesce(ref["authors"], F.lit("")), F.lit(" ("), F.coalesce(ref["year"], F.lit("")), F.lit(") "),
            F.coalesce(ref["title"], F.lit("")),
        ).alias("raw_text"),
        ref["title"].alias("title"),
        F.nullif(F.array_join(names, ", "), F.lit("")).alias("authors"),
        year.alias("year"),
        F.coalesce(F.nullif(ref["conference"], F.lit("")), ref["journal"]).alias("venue"),
        F.coalesce(ref["type"], F.lit("other")).alias("type"),
        names.alias("author_list"),
    )


def choose_references(by_model: DataFrame, by_pattern: DataFrame) -> DataFrame:
    """Model rows of every paper that has any, pattern rows of all other papers."""
    modelled = by_model.select("paper_id").distinct()
    return by_model.unionByName(by_pattern.join(modelled, "paper_id", "left_anti"), allowMissingColumns=True)
