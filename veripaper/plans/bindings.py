"""Operator inputs derived from the test tables, whole tables and whole texts.

The tables hold invented prose without citations, years or DOIs, so these are attached by key
arithmetic. A document's title is its first sentence. Every view has a twin in ``oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import phash


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TITLE = "trim(split_part(split_part(text, '\\n', 1), '.', 1))"


def papers_v(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id as paper_id",
        f"{TITLE} as title",
        "text as abstract",
        """case when doc_id % 5 = 0 then null
                when doc_id % 11 = 0 then concat('bad/', doc_id)
                else concat('10.1234/d.', doc_id) end as doi""",
        """cast(case when doc_id % 13 = 0 then null when doc_id % 17 = 0 then 1890
                else 1990 + doc_id % 36 end as int) as year""",
        "case when doc_id % 7 = 0 then null else source end as venue",
        """case doc_id % 4 when 0 then 'PENDING' when 1 then 'VALIDATED'
                when 2 then 'REJECTED' else 'NEEDS_REVIEW' end as status""",
        "cast(doc_id % 3 as int) as n_authors",
        "source",
    )
    times = table(spark, folder, "events").selectExpr("event_id as paper_id", "ts as created_at")
    return documents.join(times, "paper_id")


def authors_v(spark: SparkSession, folder: str) -> DataFrame:
    """Author rows ``(paper_id, order, name)``: as many as ``n_authors`` says."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id as paper_id",
        "explode(sequence(0, 2)) as position",
    ).where("position < paper_id % 3").selectExpr(
        "paper_id",
        "cast(position as int) as `order`",
        """case (paper_id + position) % 4 when 0 then 'John Smith' when 1 then 'Anna Miller'
             when 2 then concat('Jan Author', paper_id % 100) else 'Bo Jones' end as name""",
        "position = 0 as is_corresponding",
    )


def catalogue_v(spark: SparkSession, folder: str) -> DataFrame:
    return papers_v(spark, folder).selectExpr(
        "paper_id as cat_id",
        """case paper_id % 4 when 1 then concat(title, ' revised') when 2 then replace(title, ' the ', ' a ')
             else title end as title""",
        "doi",
        "cast(case when paper_id % 6 = 1 then year + 1 else year end as int) as year",
        """case paper_id % 5 when 0 then array() when 1 then array('a smith', 'b jones')
             when 2 then array('john miller') when 3 then array('jo smith', 'x miller')
             else array('q unknown') end as authors""",
    )


def refs_v(spark: SparkSession, folder: str) -> DataFrame:
    """Four references per paper, in three citation styles."""
    papers = papers_v(spark, folder).select("paper_id", "title", "venue", "year")
    total = papers.agg(F.count(F.lit(1)).alias("n_papers"))
    cited = papers.selectExpr("paper_id as cited_id", "title as c_title", "venue as c_venue", "year as c_year")
    numbered = (
        papers.select("paper_id", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("ord"))
        .crossJoin(F.broadcast(total))
        .withColumn("cited_id", F.expr("(paper_id * 7 + ord) % n_papers"))
        .drop("n_papers")
    )
    return numbered.join(cited, "cited_id").selectExpr(
        "paper_id",
        "ord",
        "cited_id",
        """case (paper_id + ord) % 3
             when 0 then concat('A. Smith, B. Jones, "', c_title, '," in Proc. Intl Conf ', coalesce(c_venue, 'Unknown'),
                  ', vol. ', ord, ', ', coalesce(c_year, 2001), '. doi:10.1234/d.', cited_id)
             when 1 then concat('Smith, J. (', coalesce(c_year, 2002), ') ', c_title, '. Journal of Tests')
             else concat('[', ord, '] John Miller et al., ', c_title, ', IEEE Transactions on Testing, vol. ', ord,
                  ', Selected Papers Issue ', coalesce(c_year, 2003)) end as raw_text""",
    )


def texts_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id as paper_id",
        """concat('Abstract: ', text, ' Introduction. See [', doc_id % 4 + 1, ', ', doc_id % 7 + 1,
             '] and [2-4]. Fig. ', doc_id % 3 + 1, ' and Figure ', doc_id % 3 + 1,
             case when doc_id % 5 = 0 then '. Smith wrote so, and Smith again.' else '.' end,
             case when doc_id % 2 = 0 then ' And fig 9. Conclusion.' else '' end) as text""",
    )


def images_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "source as job_id",
        "doc_id as image_id",
        "doc_id % 50 as paper_id",
        "concat('img_', doc_id, '.png') as filename",
        "cast(doc_id % 12 as int) as page",
        "case when doc_id % 19 = 0 then '' else md5(text) end as hash",
    )


def evidence_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as job_id",
        "l_linenumber as image_id",
        "0.8 + l_discount * 2 as hash_sim",
        "l_tax * 10 as ssim",
        "l_quantity as best_match_pct",
        "l_returnflag = 'R' as web_found",
    )


def requests_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("event_id as req_id", "user_id as client_key", "ts")


def job_events_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "cast(user_id as string) as job_id",
        "event_id as seq",
        "ts",
        """case event_type when 'signup' then 'waiting' when 'view' then 'active' when 'click' then 'active'
             when 'purchase' then 'completed' else 'failed' end as state""",
        "case when event_id % 3 = 0 then null else value end as progress",
    )


def alerts_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id as alert_id",
        "event_id % 200 as paper_id",
        "user_id",
        """case event_type when 'signup' then 'PAPER_VALIDATED' when 'view' then 'PAPER_REJECTED'
             when 'click' then 'INVALID_REFERENCE' when 'purchase' then 'SUSPICIOUS_DIAGRAM'
             else 'VALIDATION_ERROR' end as type""",
        """case event_id % 4 when 0 then 'INFO' when 1 then 'WARNING' when 2 then 'ERROR'
             else 'CRITICAL' end as severity""",
        "concat('Alert ', event_id) as title",
        "props as message",
        "value > 10 as is_read",
        "ts as created_at",
    )


def diagrams_v(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("diagram_id"),
        F.col("label").cast("bigint").alias("paper_id"),
        (F.col("vec_id") % 9 + 1).cast("int").alias("order"),
        phash(F.col("embedding")).alias("hash"),
    )


def hits_v(spark: SparkSession, folder: str) -> DataFrame:
    """Stored search hits: page address, page title, tag-free text, per query image."""
    return table(spark, folder, "pages").selectExpr(
        "page_id % 20 as image_id",
        "cast(page_id div 20 as int) as call",
        "0 as pos",
        "case when page_id % 6 = 0 then 'https://arxiv.org/abs/shared' else url end as url",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) as title",
        "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[ \\\\t\\\\r\\\\n]+', ' ')) as snippet",
    )


def ocr_text_v(spark: SparkSession, folder: str) -> DataFrame:
    """One text per query image: every conversation turn, whole."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn as image_id", "text as ocr_text"
    )


def page_text_v(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of five lines; every third document has a reference heading on its last page."""
    lines = table(spark, folder, "documents").selectExpr(
        "doc_id as paper_id", "posexplode(split(text, '\\n')) as (line_no, line)",
        "size(split(text, '\\n')) as n_lines",
    )
    paged = lines.selectExpr(
        "paper_id",
        "cast(line_no div 5 + 1 as int) as page",
        "cast((n_lines - 1) div 5 + 1 as int) as n_pages",
        "line_no",
        "line",
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    pages = paged.groupBy("paper_id", "page", "n_pages").agg(text.alias("text"))
    return pages.selectExpr(
        "paper_id",
        "page",
        """case when page = n_pages and page > 1 and paper_id % 3 = 0
             then concat('References\\n[1] ', text) else text end as text""",
    )
