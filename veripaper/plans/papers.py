"""Queries on paper metadata, duplicates and paper decisions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import DOI_FORMAT
from ..operators import duplicates as D
from ..operators import matching as M
from ..operators import verdicts as V
from . import bindings as B
from . import sql_text as S
from .oracle_views import with_views
from .registry import query

AS_OF = date(2024, 6, 1)

VALIDATED_SQL = rf"""select *, len(errors) = 0 as is_valid from (
  select p.*,
    list_filter([
      case when title is null or {S.strip('title')} = '' then 'Title is required' end,
      case when n_authors = 0 then 'At least one author is required' end,
      case when coalesce(year, 0) <> 0 and (year < 1900 or year > {AS_OF.year + 1})
        then concat('Invalid publication year: ', cast(year as varchar)) end,
      case when coalesce(doi, '') <> '' and not regexp_matches(doi, {S.re2(DOI_FORMAT)})
        then 'DOI format appears invalid' end], lambda n: n is not null) as errors,
    list_filter([
      case when {S.strip('title')} <> '' and length(title) < 10 then 'Title seems too short' end,
      case when coalesce(year, 0) = 0 then 'Publication year is missing' end,
      case when coalesce(venue, '') = '' then 'Venue (journal/conference) is missing' end,
      case when coalesce(doi, '') = '' then 'DOI is missing - this helps with verification' end],
      lambda n: n is not null) as warnings
  from papers_v p)"""


@query(
    "p1_validate_metadata",
    with_views(
        ["papers_v"],
        """select paper_id, array_to_string(errors, '; ') as errors, array_to_string(warnings, '; ') as warnings,
           is_valid from validated""",
        ("validated", VALIDATED_SQL),
    ),
)
def validate_metadata(spark: SparkSession, folder: str) -> DataFrame:
    checked = V.validate_metadata(B.papers_v(spark, folder), AS_OF)
    return checked.select(
        "paper_id",
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
        "is_valid",
    )


# Every distinct trigram set with its earliest paper, then all pairs of sets.
TITLE_SETS_SQL = f"""select grams, min(paper_id) as first_id
  from (select paper_id, {S.trigrams('title')} as grams from papers_v) where len(grams) > 0 group by grams"""
# created_at grows with the paper id, so that the smaller id is the earlier paper.
SET_PAIRS_SQL = f"""select l.grams as grams, r.first_id as similar_paper_id, {S.jaccard('l.grams', 'r.grams')} as similarity
  from sets l join sets r on r.first_id < l.first_id
    and len(l.grams) >= 0.7 * len(r.grams) and len(r.grams) >= 0.7 * len(l.grams)
  where {S.jaccard('l.grams', 'r.grams')} > 0.7"""
BEST_SET_SQL = """select * from set_pairs qualify row_number() over (
    partition by grams order by similarity desc, similar_paper_id) = 1"""
BY_TITLE_SQL = f"""select k.paper_id,
    case when k.paper_id <> s.first_id then s.first_id else b.similar_paper_id end as similar_paper_id,
    case when k.paper_id <> s.first_id then 1.0 else b.similarity end as similarity
  from (select paper_id, {S.trigrams('title')} as grams from papers_v) k
  join sets s on s.grams = k.grams left join best_set b on b.grams = k.grams
  where k.paper_id <> s.first_id or b.similar_paper_id is not null"""
DUPLICATE_CTES = [
    ("sets", TITLE_SETS_SQL),
    ("set_pairs", SET_PAIRS_SQL),
    ("best_set", BEST_SET_SQL),
    ("by_title", BY_TITLE_SQL),
    (
        "by_doi",
        """select p.paper_id, min(o.paper_id) as similar_paper_id, 1.0 as similarity
           from papers_v p join papers_v o on o.doi = p.doi and o.paper_id < p.paper_id
           where p.doi <> '' group by p.paper_id""",
    ),
    (
        "dups",
        """select * from by_doi union all
           select * from by_title where similarity > 0.8 and paper_id not in (select paper_id from by_doi)""",
    ),
]


@query(
    "j5_duplicate_by_title",
    with_views(
        ["papers_v"],
        "select paper_id, similar_paper_id, similarity, similarity > 0.8 as is_duplicate from by_title",
        *DUPLICATE_CTES[:4],
    ),
)
def duplicate_by_title(spark: SparkSession, folder: str) -> DataFrame:
    return D.duplicate_titles_within(B.papers_v(spark, folder))


@query(
    "j5_new_against_stored",
    with_views(
        ["papers_v", "catalogue_v"],
        f"""select paper_id, similar_paper_id, similarity, similarity > 0.8 as is_duplicate from (
          select n.paper_id, s.first_id as similar_paper_id, {S.jaccard('n.grams', 's.grams')} as similarity
          from (select 1000000000 + cat_id as paper_id, {S.trigrams('title')} as grams from catalogue_v) n
          join sets s on len(n.grams) >= 0.7 * len(s.grams) and len(s.grams) >= 0.7 * len(n.grams)
          where {S.jaccard('n.grams', 's.grams')} > 0.7
          qualify row_number() over (partition by n.paper_id order by similarity desc, similar_paper_id) = 1)""",
        DUPLICATE_CTES[0],
    ),
)
def new_against_stored(spark: SparkSession, folder: str) -> DataFrame:
    new = B.catalogue_v(spark, folder).selectExpr("1000000000 + cat_id as paper_id", "title")
    return D.duplicate_by_title(new, B.papers_v(spark, folder))


@query(
    "j4_duplicate_by_doi",
    with_views(
        ["papers_v", "refs_v"],
        r"""select n.paper_id, min(p.paper_id) as similar_paper_id, 1.0 as similarity, true as is_duplicate
          from (select 1000000000 + paper_id * 10 + ord as paper_id,
                  nullif(regexp_extract(raw_text, 'doi:(10\.\d+/\S+)', 1), '') as doi from refs_v) n
          join papers_v p on p.doi = n.doi group by n.paper_id""",
    ),
)
def duplicate_by_doi(spark: SparkSession, folder: str) -> DataFrame:
    new = B.refs_v(spark, folder).select(
        (F.lit(1000000000) + F.col("paper_id") * 10 + F.col("ord")).alias("paper_id"),
        F.nullif(F.regexp_extract("raw_text", r"doi:(10\.\d+/\S+)", 1), F.lit("")).alias("doi"),
    )
    return D.duplicate_by_doi(new, B.papers_v(spark, folder))


def rejected_duplicates_plan(spark: SparkSession, folder: str) -> DataFrame:
    papers = B.papers_v(spark, folder)
    checked = V.validate_metadata(papers, AS_OF)
    dups = D.duplicates_within(papers).drop("is_duplicate").withColumn("is_duplicate", F.lit(True))
    joined = checked.join(dups, "paper_id", "left").withColumns(
        {
            "service_down": F.lit(False),
            "checked": F.lit(False),
            "found": F.lit(False),
            "match_score": F.lit(0.0),
            "title_match": F.lit(False),
            "year_match": F.lit(False),
            "author_match": F.lit(False),
            "differences": F.array().cast("array<string>"),
            "match_warnings": F.array().cast("array<string>"),
            "has_abstract": F.lit(True),
            "has_conclusion": F.lit(True),
        }
    )
    decided = V.decide_paper_status(joined)
    return decided.where(
        (F.col("status") == "REJECTED") & F.col("is_valid") & F.col("is_duplicate")
    ).select("paper_id", "similar_paper_id", "similarity", "status", "validation_notes")


@query(
    "flagship_rejected_duplicates",
    with_views(
        ["papers_v"],
        f"""select v.paper_id, d.similar_paper_id, d.similarity, 'REJECTED' as status,
           concat('Duplicate detected (similarity: ', {S.score_text('d.similarity')}, ')') as validation_notes
        from validated v join dups d on d.paper_id = v.paper_id where v.is_valid and d.similarity > 0.9""",
        ("validated", VALIDATED_SQL),
        *DUPLICATE_CTES,
    ),
)
def rejected_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return rejected_duplicates_plan(spark, folder)


IMPORT_CTES = [
    ("keyed", f"select paper_id, paper_id % 2 = 0 as is_stored, created_at, doi, {S.trigrams('title')} as grams from papers_v"),
    ("numbered", "select row_number() over (order by created_at, paper_id) as step, * from keyed where not is_stored"),
    (
        "near",
        f"""select l.paper_id as paper_id, r.paper_id as earlier, r.is_stored, r.created_at, coalesce(l.doi <> '' and l.doi = r.doi, false) as same_doi,
             {S.jaccard('l.grams', 'r.grams')} as score
           from numbered l join keyed r on (r.is_stored or (r.created_at, r.paper_id) < (l.created_at, l.paper_id))
             and ((l.doi <> '' and l.doi = r.doi) or (len(l.grams) > 0 and len(r.grams) > 0
               and len(l.grams) >= 0.8 * len(r.grams) and len(r.grams) >= 0.8 * len(l.grams)
               and {S.jaccard('l.grams', 'r.grams')} > 0.8))""",
    ),
    ("near_lists", "select paper_id, list(earlier) as earlier from near group by paper_id"),
    (
        "rec_walk",
        """select cast(0 as bigint) as step, (select coalesce(list(paper_id), []) from keyed where is_stored) as kept union all
           select n.step, case when list_has_any(w.kept, coalesce(e.earlier, [])) then w.kept
             else list_append(w.kept, n.paper_id) end
           from rec_walk w join numbered n on n.step = w.step + 1 left join near_lists e on e.paper_id = n.paper_id""",
    ),
]


def _imported(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the papers imported in order of time where the other half is stored."""
    papers = B.papers_v(spark, folder)
    return D.import_papers(papers.where("paper_id % 2 = 0"), papers.where("paper_id % 2 = 1"))


@query(
    "s15_import_papers",
    with_views(
        ["papers_v"],
        """select i.paper_id, list_contains(f.kept, i.paper_id) as imported,
             case when not list_contains(f.kept, i.paper_id) then 'Duplicate detected' end as reason
           from numbered i cross join (select kept from rec_walk order by step desc limit 1) f""",
        *IMPORT_CTES,
    ),
)
def import_papers(spark: SparkSession, folder: str) -> DataFrame:
    return _imported(spark, folder).select("paper_id", "imported", "reason")


@query(
    "s15_stored_duplicates",
    with_views(
        ["papers_v"],
        """select paper_id, earlier as similar_paper_id from near where is_stored
           qualify row_number() over (partition by paper_id order by same_doi desc, case when same_doi then 0 else -score end, created_at, earlier) = 1""",
        *IMPORT_CTES[:3],
    ),
)
def stored_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming papers that repeat a stored one, and which."""
    return _imported(spark, folder).where("similar_paper_id % 2 = 0").select("paper_id", "similar_paper_id")


@query(
    "x2_greedy_dedup",
    with_views(
        ["papers_v"],
        """select p.first_id as paper_id, list_contains(f.kept, p.first_id) as kept
           from sets p cross join (select kept from rec_walk order by step desc limit 1) f""",
        DUPLICATE_CTES[0],
        (
            "numbered",
            "select row_number() over (order by first_id) as step, first_id as paper_id, grams from sets",
        ),
        (
            "near",
            f"""select l.paper_id as paper_id, list(r.paper_id) as earlier from numbered l join numbered r on r.step < l.step
                  and len(l.grams) >= 0.6 * len(r.grams) and len(r.grams) >= 0.6 * len(l.grams)
                  and {S.jaccard('l.grams', 'r.grams')} > 0.6 group by l.paper_id""",
        ),
        (
            "rec_walk",
            """select cast(0 as bigint) as step, cast([] as bigint[]) as kept union all
               select n.step, case when list_has_any(w.kept, coalesce(e.earlier, [])) then w.kept
                 else list_append(w.kept, n.paper_id) end
               from rec_walk w join numbered n on n.step = w.step + 1 left join near e on e.paper_id = n.paper_id""",
        ),
    ),
)
def greedy_dedup(spark: SparkSession, folder: str) -> DataFrame:
    sets = D.title_sets(B.papers_v(spark, folder))
    nodes = sets.select(F.col("first.paper_id").alias("paper_id"))
    return D.greedy_dedup(nodes, D.similar_set_edges(sets, 0.6))
