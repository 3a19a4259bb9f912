"""Records of three bibliographic catalogues, stored search responses, reports and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import salted_join

# fixed values: the parts of the catalogues' records that are read
OPENALEX_SCHEMA = """struct<id: string, title: string, display_name: string, abstract: string, doi: string,
  publication_year: int, cited_by_count: int,
  authorships: array<struct<author: struct<display_name: string, orcid: string>, institutions: array<struct<display_name: string>>>>,
  primary_location: struct<source: struct<display_name: string>, pdf_url: string, landing_page_url: string>,
  concepts: array<struct<display_name: string>>,
  biblio: struct<volume: string, issue: string, first_page: string, last_page: string>>"""
CROSSREF_SCHEMA = """struct<DOI: string, title: array<string>, abstract: string, URL: string, volume: string, page: string,
  published: struct<`date-parts`: array<array<int>>>, `container-title`: array<string>, `is-referenced-by-count`: int,
  subject: array<string>, link: array<struct<URL: string, `content-type`: string>>,
  author: array<struct<given: string, family: string, ORCID: string, affiliation: array<struct<name: string>>>>>"""
SEMANTIC_SCHEMA = """struct<paperId: string, title: string, abstract: string, url: string, year: int, venue: string,
  journal: struct<name: string>, externalIds: struct<DOI: string>, openAccessPdf: struct<url: string>,
  citationCount: int, fieldsOfStudy: array<string>, authors: array<struct<authorId: string, name: string>>>"""


def _filled(*options: Column) -> Column:
    """First option that is neither null nor blank."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _list(values: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(values, F.array().cast(kind))


AUTHORS = "array<struct<name: string, orcid: string, affiliation: string>>"


def _author(name: Column, orcid: Column | None = None, affiliation: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        name.alias("name"),
        (nothing if orcid is None else orcid).alias("orcid"),
        (nothing if affiliation is None else affiliation).alias("affiliation"),
    )


def normalize_openalex(raw: DataFrame) -> DataFrame:
    """Papers from OpenAlex works, one JSON text per row in ``value``."""
    w = F.from_json("value", OPENALEX_SCHEMA)
    r = raw.select("value", w.alias("w"))
    c = F.col
    first, last = c("w.biblio.first_page"), c("w.biblio.last_page")
    both = (F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "")
    return r.select(
        _filled(c("w.title"), c("w.display_name")).alias("title"),
        c("w.abstract").alias("abstract"),
        c("w.doi").alias("doi"),
        c("w.primary_location.landing_page_url").alias("url"),
        c("w.primary_location.pdf_url").alias("pdf_url"),
        c("w.publication_year").alias("year"),
        c("w.primary_location.source.display_name").alias("venue"),
        c("w.biblio.volume").alias("volume"),
        F.when(both, F.concat(first, F.lit("-"), last)).otherwise(first).alias("pages"),
        F.coalesce(c("w.cited_by_count"), F.lit(0)).alias("citation_count"),
        _list(F.transform("w.concepts", lambda x: x["display_name"])).alias("topics"),
        F.lit("openalex").alias("source"),
        c("w.id").alias("source_id"),
        c("value").alias("metadata"),
        _list(
            F.transform(
                "w.authorships",
                lambda a: _author(
                    a["author"]["display_name"], a["author"]["orcid"], _first(a["institutions"])["display_name"]
                ),
            ),
            AUTHORS,
        ).alias("authors"),
    )


def normalize_crossref(raw: DataFrame) -> DataFrame:
    """Papers from CrossRef works, one JSON text per row in ``value``."""
    r = raw.select("value", F.from_json("value", CROSSREF_SCHEMA).alias("w"))
    c = F.col
    pdf = _first(F.filter("w.link", lambda x: x["content-type"] == "application/pdf"))
    return r.select(
        F.coalesce(_first(c("w.title")), F.lit("")).alias("title"),
        c("w.abstract").alias("abstract"),
        c("w.DOI").alias("doi"),
        c("w.URL").alias("url"),
        pdf["URL"].alias("pdf_url"),
        _first(_first(c("w.published.date-parts"))).alias("year"),
        _first(c("w.container-title")).alias("venue"),
        c("w.volume").alias("volume"),
        c("w.page").alias("pages"),
        F.coalesce(c("w.is-referenced-by-count"), F.lit(0)).alias("citation_count"),
        _list(c("w.subject")).alias("topics"),
        F.lit("crossref").alias("source"),
        c("w.DOI").alias("source_id"),
        c("value").alias("metadata"),
        _list(
            F.transform(
                "w.author",
                lambda a: _author(
                    F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit("")))),
                    a["ORCID"],
                    _first(a["affiliation"])["name"],
                ),
            ),
            AUTHORS,
        ).alias("authors"),
    )


def normalize_semantic(raw: DataFrame) -> DataFrame:
    """Papers from Semantic Scholar records, one JSON text per row in ``value``."""
    r = raw.select("value", F.from_json("value", SEMANTIC_SCHEMA).alias("w"))
    c = F.col
    return r.select(
        c("w.title").alias("title"),
        c("w.abstract").alias("abstract"),
        c("w.externalIds.DOI").alias("doi"),
        c("w.url").alias("url"),
        c("w.openAccessPdf.url").alias("pdf_url"),
        c("w.year").alias("year"),
        _filled(c("w.venue"), c("w.journal.name")).alias("venue"),
        F.coalesce(c("w.citationCount"), F.lit(0)).alias("citation_count"),
        _list(c("w.fieldsOfStudy")).alias("topics"),
        F.lit("semantic").alias("source"),
        c("w.paperId").alias("source_id"),
        c("value").alias("metadata"),
        _list(F.transform("w.authors", lambda a: _author(a["name"])), AUTHORS).alias("authors"),
    )


NORMALIZERS = {"openalex": normalize_openalex, "crossref": normalize_crossref, "semantic": normalize_semantic}


def normalize_catalogue(raw: DataFrame, source: str) -> DataFrame:
    if source not in NORMALIZERS:
        raise ValueError(f"Invalid source: {source}")
    return NORMALIZERS[source](raw)


def load_catalogue(spark: SparkSession, paths: str | list[str], source: str) -> DataFrame:
    """Landed records of one catalogue (JSON lines) as papers."""
    return normalize_catalogue(spark.read.text(paths), source)


def union_sources(*catalogues: DataFrame) -> DataFrame:
    """Several catalogues in one schema; fields a catalogue lacks are null."""
    united = catalogues[0]
    for more in catalogues[1:]:
        united = united.unionByName(more, allowMissingColumns=True)
    return united


HITS_SCHEMA = """struct<organic: array<struct<link: string, title: string, snippet: string>>,
  items: array<struct<link: string, title: string, snippet: string>>,
  RelatedTopics: array<struct<FirstURL: string, Text: string>>>"""


def read_search_hits(raw: DataFrame) -> DataFrame:
    """Hits ``(image_id, call, pos, url, title, snippet)`` of stored responses ``(image_id, call, response)``.

    Three response shapes; the first one a response has counts.
    """

    def hit(url: Column, title: Column, snippet: Column) -> Column:
        return F.struct(
            F.coalesce(url, F.lit("")).alias("url"),
            F.coalesce(title, F.lit("")).alias("title"),
            F.coalesce(snippet, F.lit("")).alias("snippet"),
        )

    def listed(name: str) -> Column:
        return F.transform(f"r.{name}", lambda x: hit(x["link"], x["title"], x["snippet"]))

    topics = F.transform(
        F.filter("r.RelatedTopics", lambda x: x["FirstURL"].isNotNull()), lambda x: hit(x["FirstURL"], x["Text"], x["Text"])
    )
    parsed = raw.select("image_id", "call", F.from_json("response", HITS_SCHEMA).alias("r"))
    hits = parsed.select(
        "image_id", "call", F.posexplode(F.coalesce(listed("organic"), listed("items"), topics)).alias("pos", "hit")
    )
    return hits.select("image_id", "call", "pos", "hit.*")


#: Diagrams in one object of a report; a report of more has several parts.
REPORT_PART = 1000

# fixed values: names in reports
REPORT_SCHEMA = """struct<jobId: string, pdfPath: string, totalDiagrams: int,
  diagrams: array<struct<diagram: string, index: bigint,
    localSimilarity: struct<bestMatch: struct<score: double>>, decision: string, confidence: double,
    indicators: array<string>>>,
  summary: struct<total: int, original: int, partiallyPlagiarized: int, heavilyPlagiarized: int,
    averageConfidence: double, riskLevel: string>, part: int, parts: int>"""
SUMMARY_NAMES = {
    "total": "total",
    "original": "original",
    "partiallyPlagiarized": "partially_plagiarized",
    "heavilyPlagiarized": "heavily_plagiarized",
    "averageConfidence": "average_confidence",
    "riskLevel": "risk_level",
}


def report_parts(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """Reports as nested rows ``jobId, totalDiagrams, diagrams, summary, part, parts``.

    Reads scored ``job_id, image_id, diagram, best_match_pct, decision, confidence, indicators`` and a
    summary row per job. A job's diagrams are dealt by hash into parts of about ``REPORT_PART``, in order of the
    identifier in each, so that no object grows with the job; every part carries the summary.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(REPORT_PART))).cast("int")
    of_job = summary.select(
        "job_id", "total", F.struct(*[F.col(c).alias(n) for n, c in SUMMARY_NAMES.items()]).alias("summary"), parts.alias("parts")
    )
    diagram = F.struct(
        "diagram",
        F.col("image_id").cast("bigint").alias("index"),
        F.struct(F.struct(F.col("best_match_pct").alias("score")).alias("bestMatch")).alias("localSimilarity"),
        "decision",
        "confidence",
        "indicators",
    )
    # Only jobs of several parts (one in REPORT_PART rows at most) meet single diagrams; summaries meet whole parts.
    several = of_job.where("parts > 1").select("job_id", "parts")
    dealt = salted_join(scored, several, ["job_id"], [F.col("image_id")]).withColumn(
        "part", F.pmod(F.xxhash64("image_id"), F.coalesce("parts", F.lit(1))).cast("int")
    )
    grouped = dealt.groupBy("job_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("image_id"), diagram.alias("diagram")))).alias("found")
    )
    return grouped.join(of_job, "job_id").select(
        F.col("job_id").cast("string").alias("jobId"),
        F.col("total").cast("int").alias("totalDiagrams"),
        F.transform("found", lambda f: f["diagram"]).alias("diagrams"),
        "summary",
        "part",
        "parts",
    )


def write_report(
    scored: DataFrame, summary: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite", compression: str = "none"
) -> None:
    """Nested reports as JSON lines in ``buckets`` folders by job; a job's parts lie in one folder."""
    bucket = F.pmod(F.xxhash64("jobId"), F.lit(buckets)).cast("int")
    nested = report_parts(scored, summary).withColumn("bucket", bucket)
    nested.write.mode(mode).partitionBy("bucket").json(path, compression=compression)


def read_report(raw: DataFrame) -> DataFrame:
    """Reports out of job results ``value``: under ``result``, else ``plagiarismReport``, else the root."""

    def under(key: str) -> Column:
        # A value is parsed for the key only where it can hold it, plainly or in escaped letters.
        held = F.contains("value", F.lit(key)) | F.contains("value", F.lit("\\u"))
        return F.when(held, F.get_json_object("value", f"$.{key}"))

    body = F.coalesce(under("result"), under("plagiarismReport"), F.col("value"))
    return raw.select(F.from_json(body, REPORT_SCHEMA).alias("report")).select("report.*")


def report_diagrams(reports: DataFrame) -> DataFrame:
    """One row for each diagram of the reports, with its job and the job's summary."""
    return reports.select(F.col("jobId").alias("job_id"), "totalDiagrams", "summary", F.inline("diagrams"))


def intake_files(spark: SparkSession, path: str, limit: int = 50 * 1024 * 1024) -> DataFrame:
    """Files offered for upload with their stored name, title, and reason if refused; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return check_files(files.withColumn("filename", F.regexp_extract("path", "([^/]+)$", 1)), limit)


def check_files(files: DataFrame, limit: int = 50 * 1024 * 1024) -> DataFrame:
    name = F.col("filename")
    reason = F.when(~F.endswith(name, F.lit(".pdf")), F.concat(F.lit("Only PDF files are allowed. File: "), name)).when(
        F.col("length") > limit, F.concat(F.lit("File size exceeds 50MB limit. File: "), name)
    )
    title = F.trim(F.replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("_"), F.lit(" ")))
    return files.select(
        "*",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
        F.regexp_replace(name, "[^a-zA-Z0-9.-]", "_").alias("stored_name"),
        title.alias("title"),
    )


def reference_details(refs: DataFrame) -> DataFrame:
    """Stored verification of references, flattened: source, title, authors, DOI, year, venue, scores.

    Reads ``verification`` (JSON) and keeps the other columns.
    """

    def at(path: str) -> Column:
        return F.get_json_object("verification", path)

    def text_or_first(path: str) -> Column:
        whole = at(path)
        return F.when(F.json_array_length(whole).isNotNull(), F.coalesce(at(f"{path}[0]"), F.lit(""))).otherwise(whole)

    source, has_data = at("$.source"), at("$.data").isNotNull()
    crossref = has_data & source.isin("crossref", "crossref_search")
    openalex = has_data & source.isin("openalex", "openalex_search")
    person = "struct<given: string, family: string, name: string>"
    people = at("$.data.author")
    listed = F.when(F.json_array_length(people).isNotNull(), F.from_json(people, f"array<{person}>")).otherwise(
        F.array(F.from_json(people, person))
    )
    full_name = lambda a: F.coalesce(
        F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"], F.lit("")
    )
    of_crossref = F.when(people.isNotNull(), F.transform(listed, full_name))
    works = F.from_json(at("$.data.authorships"), "array<struct<author: struct<display_name: string>>>")
    of_openalex = F.transform(works, lambda a: a["author"]["display_name"])
    year = F.coalesce(at("$.data.published['date-parts'][0][0]"), at("$.data.year"), at("$.data.published.date_parts[0][0]"))
    venue = F.coalesce(_filled(text_or_first("$.data['container-title']"), at("$.data.journal")), F.lit(""))
    return refs.select(
        *[c for c in refs.columns if c != "verification"],
        F.when(crossref, "crossref").when(openalex, "openalex").when(has_data & source.isNotNull(), source).alias("source"),
        F.when(crossref, F.coalesce(text_or_first("$.data.title"), F.lit("")))
        .when(openalex, _filled(at("$.data.title"), at("$.data.display_name"))).alias("api_title"),
        F.when(crossref, _list(of_crossref)).when(openalex, _list(of_openalex)).alias("api_authors"),
        F.when(crossref, F.coalesce(_filled(at("$.data.DOI"), at("$.data.doi")), F.lit("")))
        .when(openalex, at("$.data.doi")).alias("api_doi"),
        F.when(crossref, year).when(openalex, at("$.data.publication_year")).try_cast("int").alias("api_year"),
        F.when(crossref, venue)
        .when(openalex, _filled(at("$.data.primary_location.source.display_name"), at("$.data.venue"))).alias("api_venue"),
        F.coalesce(at("$.matchScore").try_cast("double"), F.lit(0.0)).alias("match_score"),
        at("$.titleSimilarity").try_cast("double").alias("title_similarity"),
        at("$.contentCheck").alias("content_check"),
        at("$.aiExtraction").alias("ai_extraction"),
    )

