"""Queries on citations in body texts and on the verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import citations as C
from ..operators import matching as M
from ..operators import verdicts as V
from ..sources import tables as T
from . import bindings as B
from . import references as RQ
from . import sql_text as S
from .oracle_views import with_views
from .registry import query

NUMBERS_SQL = r"""select distinct paper_id, regexp_replace(token, '^.*\[', '') as number from (
    select paper_id, unnest(regexp_split_to_array(grp, '[,\s-]')) as token from (
      select paper_id, unnest(regexp_extract_all(text, '\[([^\]]*)\]', 1)) as grp from texts_v))"""
ALONE_SQL = r"select distinct paper_id, unnest(regexp_extract_all(text, '\[(\d+)\]', 1)) as number from texts_v"
WORDS_SQL = r"""select paper_id, word, count(*) as n from (
    select paper_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as word from texts_v)
  group by paper_id, word having count(*) >= 2"""
NAMES_SQL = r"""select paper_id, ord, pos, names[pos] as name from (
    select paper_id, ord, names, unnest(range(1, len(names) + 1)) as pos from (
      select paper_id, ord, list_filter(regexp_split_to_array(trim(string_split(
          regexp_replace(coalesce(authors, raw_text), '(?i)\s+et\s+al\.?', '', 'g'), ',')[1]), '[\s,]+'),
        lambda p: length(p) > 2 and regexp_matches(p, '^\P{L}*(?:\p{Lu}\p{Ll}*(?:\P{L}+|$))+$')) as names
      from parsed))"""
MENTIONS_SQL = """select n.paper_id, n.ord, arg_min(n.name, n.pos) as author_name from names n
  join words w on w.paper_id = n.paper_id and w.word = n.name group by n.paper_id, n.ord"""
CHECK_CTES = [
    RQ.PARSED,
    ("numbers", NUMBERS_SQL),
    ("alone", ALONE_SQL),
    ("words", WORDS_SQL),
    ("names", NAMES_SQL),
    ("mentions", MENTIONS_SQL),
    (
        "checks",
        """select r.paper_id, r.ord, n.number is not null or m.author_name is not null as cited,
             case when a.number is not null then concat('Found citation [', cast(r.ord as varchar), ']')
               when n.number is not null then concat('Found citation number ', cast(r.ord as varchar), ' in text')
               when m.author_name is not null then concat('Found author name ''', m.author_name, ''' in text')
               else 'Citation number or author name not found in text' end as reason
           from parsed r left join numbers n on n.paper_id = r.paper_id and n.number = cast(r.ord as varchar)
           left join alone a on a.paper_id = r.paper_id and a.number = cast(r.ord as varchar)
           left join mentions m on m.paper_id = r.paper_id and m.ord = r.ord""",
    ),
]


def _checks(spark: SparkSession, folder: str) -> DataFrame:
    return C.content_checks(cut_lineage(RQ.parsed_refs(spark, folder)), B.texts_v(spark, folder))


@query(
    "j13_citation_number_check",
    with_views(
        ["refs_v", "texts_v"],
        """select r.paper_id, r.ord, n.number is not null as cited_by_number, a.number is not null as exact
        from refs_v r left join numbers n on n.paper_id = r.paper_id and n.number = cast(r.ord as varchar)
        left join alone a on a.paper_id = r.paper_id and a.number = cast(r.ord as varchar)""",
        ("numbers", NUMBERS_SQL),
        ("alone", ALONE_SQL),
    ),
)
def citation_number_check(spark: SparkSession, folder: str) -> DataFrame:
    refs = B.refs_v(spark, folder).select("paper_id", "ord")
    return C.citation_number_check(refs, B.texts_v(spark, folder))


@query(
    "j14_author_mention_check",
    with_views(
        ["refs_v", "texts_v"],
        "select paper_id, ord, author_name from mentions",
        *CHECK_CTES[:1], *CHECK_CTES[3:6],
    ),
)
def author_mention_check(spark: SparkSession, folder: str) -> DataFrame:
    return C.author_mention_check(RQ.parsed_refs(spark, folder), B.texts_v(spark, folder))


@query(
    "j21_merge_content_checks",
    with_views(
        ["refs_v", "texts_v"],
        "select r.paper_id, r.ord, c.cited, c.reason from refs_v r left join checks c on c.paper_id = r.paper_id and c.ord = r.ord",
        *CHECK_CTES,
    ),
)
def merge_content_checks(spark: SparkSession, folder: str) -> DataFrame:
    merged = C.merge_content_checks(B.refs_v(spark, folder).select("paper_id", "ord"), _checks(spark, folder))
    return merged.select(
        "paper_id", "ord", F.col("content_check.valid").alias("cited"), F.col("content_check.reason").alias("reason")
    )


@query(
    "a7_figure_callouts",
    with_views(
        ["texts_v"],
        r"""select paper_id, figure, mentions, mentions >= 2 as valid,
             case when mentions >= 2 then concat('Found ', cast(mentions as varchar), ' times')
               else concat('Found only ', cast(mentions as varchar), ' time(s)') end as reason
        from (select paper_id, try_cast(d as bigint) as figure, count(*) as mentions from (
            select paper_id, unnest(regexp_extract_all(text, '(?i)\b(?:fig\.?|figure)\s*(\d+)', 1)) as d from texts_v)
          group by 1, 2)""",
    ),
)
def figure_callouts(spark: SparkSession, folder: str) -> DataFrame:
    return C.figure_callouts(B.texts_v(spark, folder))


CITED_SQL = (
    "cited_summary",
    """select paper_id, count(*) filter (cited) as cited, count(*) as total_refs,
       count(*) filter (cited) / count(*)::double * 100 as cited_pct from checks group by paper_id""",
)


@query(
    "a5_content_summary",
    with_views(["refs_v", "texts_v"], "select * from cited_summary", *CHECK_CTES, CITED_SQL),
)
def content_summary(spark: SparkSession, folder: str) -> DataFrame:
    return V.content_summary(_checks(spark, folder))


VERDICT_SQL = (
    "verdicts",
    f"""select paper_id, valid_pct, cited_pct,
         case when valid_pct >= 75 and cited_pct >= 75 then 'VALID' else 'INVALID' end as overall_status,
         case when valid_pct >= 75 and cited_pct >= 75 then printf(
             'Both reference validation (%.1f%%) and content check (%.1f%%) meet the 75%% threshold.', valid_pct, cited_pct)
           else {S.notes(
             "case when valid_pct < 75 then printf('Reference validation is %.1f%% (below 75%% threshold)', valid_pct) end",
             "case when cited_pct < 75 then printf('Content check is %.1f%% (below 75%% threshold)', cited_pct) end")}
         end as reason
       from ref_summary r join cited_summary c using (paper_id)""",
)
VERDICT_CTES = [*RQ.VERIFIED_CTES, *CHECK_CTES[1:], CITED_SQL, VERDICT_SQL]


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    parsed, catalogue = (cut_lineage(t(spark, folder)) for t in (RQ.parsed_refs, B.catalogue_v))
    summary = V.reference_summary(RQ.verified_refs(parsed, catalogue)).select("paper_id", "valid_pct")
    cited = V.content_summary(C.content_checks(parsed, B.texts_v(spark, folder))).select("paper_id", "cited_pct")
    return V.overall_verdict(summary.join(cited, "paper_id"))


@query(
    "a6_overall_verdict",
    with_views(["refs_v", "catalogue_v", "texts_v"], "select * from verdicts", *VERDICT_CTES),
)
def overall_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(spark, folder)


FALLBACK_SQL = (
    "by_author",
    r"""select a.paper_id, a.ord, min(c.cat_id) as cat_id
        from (select paper_id, ord, try_cast(year as int) as year, lower(trim(regexp_split_to_array(authors, '(?i)[,;]|et\s+al')[1])) as fa
              from parsed where doi is null and (paper_id, ord) not in (select (paper_id, ord) from candidates)) a
        join (select cat_id, year, unnest(authors) as name from catalogue_v) c on lower(trim(c.name)) = a.fa
          and (a.year is null or c.year is null or abs(a.year - c.year) <= 1)
        where length(a.fa) > 3 group by a.paper_id, a.ord""",
)


@query(
    "j6_j21_verify_references",
    with_views(
        ["refs_v", "catalogue_v", "texts_v"],
        """select r.paper_id, r.ord, r.paper_id * 10 + r.ord as ref_id, v.status,
             case when k.cat_id is not null then concat('doi:', k.cat_id) when b.cat_id is not null then concat('title:', b.cat_id)
               when f.cat_id is not null then concat('author:', f.cat_id) end as verification, c.cited, c.reason
           from parsed r join verified v on v.paper_id = r.paper_id and v.ord = r.ord
             left join (select doi, min(cat_id) as cat_id from catalogue_v where doi <> '' group by doi) k on k.doi = r.doi and r.doi <> ''
             left join best b on b.paper_id = r.paper_id and b.ord = r.ord
             left join by_author f on f.paper_id = r.paper_id and f.ord = r.ord
             left join checks c on c.paper_id = r.paper_id and c.ord = r.ord""",
        *RQ.VERIFIED_CTES,
        FALLBACK_SQL,
        *CHECK_CTES[1:],
    ),
)
def verify_references(spark: SparkSession, folder: str) -> DataFrame:
    """All references verified and written back: by DOI, else by title, else by their first author; then looked up in the text."""
    parsed, catalogue = (cut_lineage(t(spark, folder)) for t in (RQ.parsed_refs, B.catalogue_v))
    undated, asked = RQ.undated_refs(parsed)
    candidates = cut_lineage(M.title_candidates(asked, catalogue, RQ.KEYS, k=5))
    unheard = undated.join(candidates.select(*RQ.KEYS).distinct(), RQ.KEYS, "left_anti")
    found = [
        ("doi", M.verify_by_doi(parsed, catalogue)),
        ("title", M.best_match(undated, candidates, catalogue, RQ.KEYS)),
        ("author", M.author_fallback(unheard, catalogue, RQ.KEYS)),
    ]
    by = [
        df.select(*RQ.KEYS, "status", F.concat(F.lit(f"{name}:"), F.col("cat_id").cast("string")).alias("verification"))
        for name, df in found
    ]
    updates = parsed.select(*RQ.KEYS).join(by[0].unionByName(by[1]).unionByName(by[2]), RQ.KEYS, "left").select(
        *RQ.KEYS, F.lit(None).cast("bigint").alias("ref_id"), F.coalesce("status", F.lit("MISSING")).alias("status"), "verification"
    )
    stored = parsed.selectExpr(
        *RQ.KEYS, "paper_id * 10 + ord as ref_id", "'PENDING' as status", "cast(null as string) as verification"
    )
    merged = T.merge_refs(stored, updates)
    checked = C.merge_content_checks(merged, C.content_checks(parsed, B.texts_v(spark, folder)))
    return checked.select(
        "paper_id", "ord", "ref_id", "status", "verification",
        F.col("content_check.valid").alias("cited"), F.col("content_check.reason").alias("reason"),
    )
