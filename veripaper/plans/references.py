"""Queries on reference strings, their verification, and text similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import references as R
from ..functions import text as X
from ..functions.scale import cut_lineage
from ..operators import matching as M
from ..operators import verdicts as V
from . import bindings as B
from . import sql_text as S
from .oracle_views import with_views
from .registry import query

KEYS = ["paper_id", "ord"]


# --- parsing ---------------------------------------------------------------------------------
def _cascade_sql(steps: list[tuple[str, str]], name: str, default: str = "low") -> str:
    whens = " ".join(f"when {v} is not null then '{label}'" for v, label in steps)
    values = ", ".join(v for v, _ in steps)
    return f"coalesce({values}) as {name}, case {whens} else '{default}' end as {name}_confidence"


def _names_off(found: str) -> str:
    once = f"regexp_replace({S.strip(found)}, {S.re2(P.LEADING_NAMES)}, '')"
    return S.strip(f"regexp_replace({once}, {S.re2(P.LEADING_ET_AL)}, '')")


def _long(pattern: str) -> str:
    found = S.matched("raw_text", pattern)
    return f"case when length({found}) >= 15 then {S.strip(found)} end"


PHRASES = (
    f"list_filter(list_transform(regexp_split_to_array(regexp_replace(raw_text, {S.re2(P.REFERENCE_NUMBER)}, ''), "
    f"'[.,;]'), lambda p: {S.strip('p')}), lambda p: length(p) > 15)[1]"
)
TITLE_SQL = _cascade_sql(
    [
        (_names_off(S.matched("raw_text", P.TITLE_DOUBLE_QUOTED)), "high"),
        (_names_off(S.matched("raw_text", P.TITLE_SINGLE_QUOTED)), "high"),
        (_long(P.TITLE_BEFORE_YEAR), "medium"),
        (_long(P.TITLE_BETWEEN_COMMAS), "medium"),
        (S.strip(S.matched("raw_text", P.TITLE_AFTER_ET_AL)), "medium"),
        (S.strip(S.matched("raw_text", P.TITLE_ITALICS)), "medium"),
        (_long(P.TITLE_BETWEEN_PERIODS), "low"),
        (PHRASES, "low"),
        (S.strip("raw_text"), "low"),
    ],
    "title",
)
UNNUMBERED = f"regexp_replace(raw_text, {S.re2(P.REFERENCE_NUMBER)}, '')"
AUTHORS_SQL = _cascade_sql(
    [
        (S.strip(S.matched(UNNUMBERED, p)), label)
        for p, label in [
            (P.AUTHORS_STANDARD, "high"),
            (P.AUTHORS_FULL_NAMES, "high"),
            (P.AUTHORS_LAST_FIRST, "high"),
            (P.AUTHORS_WITH_AND, "high"),
            (P.AUTHORS_BEFORE_TITLE, "medium"),
            (P.AUTHORS_FALLBACK, "low"),
        ]
    ],
    "authors",
)
YEAR_SQL = _cascade_sql(
    [
        (S.matched("raw_text", p), label)
        for p, label in [
            (P.YEAR_IN_PARENS, "high"),
            (P.YEAR_AFTER_COMMA, "medium"),
            (P.YEAR_WITH_PERIOD, "medium"),
            (P.YEAR_ANYWHERE, "low"),
        ]
    ],
    "year",
)
DOI_SQL = "coalesce(" + ", ".join(
    S.matched("raw_text", p) for p in (P.DOI_WITH_PREFIX, P.DOI_URL, P.DOI_BARE)
) + ")"
VENUE_SQL = S.strip(
    "coalesce("
    + ", ".join(S.matched("raw_text", p) for p in (P.VENUE_PROCEEDINGS, P.VENUE_JOURNAL, P.VENUE_AFTER_IN))
    + ")"
)
PARSED_SQL = f"""select paper_id, ord, raw_text, title, authors, year, doi, venue,
    case when title_confidence = 'low' or authors_confidence = 'low' or year_confidence = 'low' then 'low'
      when title_confidence = 'medium' or authors_confidence = 'medium' or year_confidence = 'medium' then 'medium'
      else 'high' end as confidence, title_confidence, authors_confidence, year_confidence
  from (select paper_id, ord, raw_text, {TITLE_SQL}, {AUTHORS_SQL}, {YEAR_SQL}, {DOI_SQL} as doi,
          {VENUE_SQL} as venue from refs_v)"""
PARSED = ("parsed", PARSED_SQL)


def parsed_refs(spark: SparkSession, folder: str) -> DataFrame:
    # The rules are regular expressions over each text; references of few input files are dealt over all cores.
    refs = B.refs_v(spark, folder).select("paper_id", "ord", "raw_text").hint("rebalance")
    refs = R.parse_references(refs)
    return refs.withColumn("year", F.col("year").try_cast("int"))


def _rule(name: str, columns: str, make) -> None:
    """A single extraction rule as its own query over all reference strings."""

    @query(name, with_views(["refs_v"], f"select paper_id, ord, {columns} from parsed", PARSED))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return make(B.refs_v(spark, folder))


_rule(
    "f12_extract_title",
    "title, title_confidence as confidence",
    lambda r: r.select("paper_id", "ord", R.extract_title(F.col("raw_text")).alias("t")).select("paper_id", "ord", "t.*"),
)
_rule(
    "f13_extract_authors",
    "authors, authors_confidence as confidence",
    lambda r: r.select("paper_id", "ord", R.extract_authors(F.col("raw_text")).alias("t")).select("paper_id", "ord", "t.*"),
)
_rule(
    "f14_extract_year",
    "year, year_confidence as confidence",
    lambda r: r.select("paper_id", "ord", R.extract_year(F.col("raw_text")).alias("t")).select("paper_id", "ord", "t.*"),
)
_rule("f15_extract_doi", "doi", lambda r: r.select("paper_id", "ord", R.extract_doi(F.col("raw_text")).alias("doi")))
_rule("f16_extract_venue", "venue", lambda r: r.select("paper_id", "ord", R.extract_venue(F.col("raw_text")).alias("venue")))
_rule(
    "f17_parse_references",
    "title, authors, year, doi, venue, confidence",
    lambda r: R.parse_references(r).select("paper_id", "ord", "title", "authors", "year", "doi", "venue", "confidence"),
)
_rule(
    "a15_reference_confidence",
    "confidence",
    lambda r: R.parse_references(r).select("paper_id", "ord", "confidence"),
)
_rule(
    "f38_title_or_fallback",
    "case when ord % 2 = 0 then 'Stored title' else title end as title",
    lambda r: r.select(
        "paper_id",
        "ord",
        R.title_or_fallback(F.when(F.col("ord") % 2 == 0, F.lit("Stored title")), F.col("raw_text")).alias("title"),
    ),
)

# The second rule set on the oracle side: squeezing outside quotes first.
QUOTE_PIECES = "regexp_split_to_array(raw_text, '[\"'']')"
SQUEEZED_SQL = rf"""select paper_id, ord, raw_text, list_aggregate(list_transform(range(1, len({QUOTE_PIECES}) + 1),
    lambda i: concat(case when i % 2 = 1 then regexp_replace({QUOTE_PIECES}[i], '\s+', ' ', 'g')
        else replace({QUOTE_PIECES}[i], chr(10), ' ') end,
      coalesce(regexp_extract_all(raw_text, '["'']')[i], ''))), 'string_agg', '') as body from refs_v"""
_LONGEST = f"""list_reverse_sort(list_transform(list_filter(list_transform(regexp_split_to_array(body, '[.,;]'),
    lambda p: {S.strip('p')}), lambda p: length(p) > 20 and regexp_matches(p, '^\\p{{Lu}}')
      and not regexp_matches(p, {S.re2(P.BULK_STARTS_WITH_NAME)})), lambda p: {{'n': length(p), 'p': p}}))[1].p"""


def _clean_sql(t: str) -> str:
    cleaned = (
        rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, {S.re2(P.BULK_NAME_PREFIX)}, ''), "
        rf"{S.re2(P.BULK_NAMES_PREFIX)}, ''), '\s+', ' ', 'g'), '[,;:]+\s*$', '')"
    )
    return S.strip(cleaned)


BULK_TITLES_SQL = f"""select paper_id, ord, list_filter([
    {{'t': {_clean_sql(S.strip(S.matched('body', P.BULK_TITLE_QUOTED)))}, 'c': 'high'}},
    {{'t': {_clean_sql(S.strip(S.matched('body', P.BULK_TITLE_BEFORE_YEAR)))}, 'c': 'medium'}},
    {{'t': {_clean_sql(S.strip(S.matched('body', P.BULK_TITLE_AFTER_COMMA)))}, 'c': 'medium'}},
    {{'t': {_clean_sql(_LONGEST)}, 'c': 'low'}}],
    lambda x: coalesce(length(x.t) >= 10 and not regexp_matches(x.t, {S.re2(P.BULK_ONLY_NAME)})
      and not regexp_matches(x.t, {S.re2(P.BULK_ONLY_DIGITS)})
      and length(regexp_replace(x.t, '[^a-zA-Z]', '', 'g')) >= 5, false))[1] as best
  from squeezed"""


@query(
    "f18_bulk_extract_title",
    with_views(
        ["refs_v"],
        "select paper_id, ord, best.t as title, coalesce(best.c, 'low') as confidence from bulk_titles",
        ("squeezed", SQUEEZED_SQL),
        ("bulk_titles", BULK_TITLES_SQL),
    ),
)
def bulk_extract_title(spark: SparkSession, folder: str) -> DataFrame:
    titled = B.refs_v(spark, folder).select(
        "paper_id", "ord", R.bulk_extract_title(F.col("raw_text")).alias("t")
    )
    return titled.select("paper_id", "ord", "t.*")


def _range_year(pattern: str) -> str:
    found = f"try_cast({S.matched('raw_text', pattern)} as int)"
    return f"case when {found} between 1900 and 2030 then {found} end"


@query(
    "f19_bulk_authors_year",
    with_views(
        ["refs_v"],
        "select paper_id, ord, "
        + _cascade_sql(
            [
                (S.strip(S.matched(UNNUMBERED, p)), label)
                for p, label in [
                    (P.BULK_AUTHORS_MULTIPLE, "high"),
                    (P.BULK_AUTHORS_INITIALS, "high"),
                    (P.BULK_AUTHORS_FULL, "medium"),
                    (P.BULK_AUTHORS_LAST_FIRST, "medium"),
                    (P.AUTHORS_FALLBACK, "low"),
                ]
            ],
            "authors",
        )
        + ", "
        + _cascade_sql(
            [
                (_range_year(P.YEAR_IN_PARENS), "high"),
                (_range_year(P.YEAR_AFTER_COMMA), "medium"),
                (_range_year(P.YEAR_ANYWHERE), "low"),
            ],
            "year",
        )
        + ", "
        + rf"""regexp_replace({S.strip('coalesce(' + ', '.join(S.matched('raw_text', p) for p in
            (P.BULK_VENUE_PROCEEDINGS, P.VENUE_JOURNAL, P.BULK_VENUE_AFTER_IN)) + ')')}, '\s+', ' ', 'g') as venue"""
        + " from refs_v",
    ),
)
def bulk_authors_year(spark: SparkSession, folder: str) -> DataFrame:
    return R.bulk_parse_references(B.refs_v(spark, folder)).select(
        "paper_id", "ord", "authors", "authors_confidence", "year", "year_confidence", "venue"
    )


# --- similarity functions --------------------------------------------------------------------
def _cited_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference's cited catalogue title beside the citing paper's own title."""
    refs = B.refs_v(spark, folder).select("paper_id", "ord", "cited_id")
    cat = B.catalogue_v(spark, folder)
    own = cat.select(F.col("cat_id").alias("paper_id"), F.col("title").alias("a"))
    cited = cat.select(F.col("cat_id").alias("cited_id"), F.col("title").alias("b"))
    return refs.join(own, "paper_id").join(cited, "cited_id").select("paper_id", "ord", "a", "b")


PAIRS = (
    "pairs",
    """select r.paper_id, r.ord, a.title as a, b.title as b from refs_v r
       join catalogue_v a on a.cat_id = r.paper_id join catalogue_v b on b.cat_id = r.cited_id""",
)


@query(
    "f1_f2_edit_similarity",
    with_views(
        ["refs_v", "catalogue_v"],
        f"""select paper_id, ord, cast(levenshtein(a, b) as bigint) as distance,
           case when greatest(length(a), length(b)) = 0 then 1.0
             else 1 - levenshtein(a, b) / greatest(length(a), length(b))::double end as similarity
        from (select paper_id, ord, {S.normalize('a')} as a, {S.normalize('b')} as b from pairs)""",
        PAIRS,
    ),
)
def edit_similarity(spark: SparkSession, folder: str) -> DataFrame:
    a, b = X.normalize_string(F.col("a")), X.normalize_string(F.col("b"))
    pairs = _cited_pairs(spark, folder).select("paper_id", "ord", a.alias("a"), b.alias("b"))
    return pairs.select(
        "paper_id",
        "ord",
        X.levenshtein_distance(F.col("a"), F.col("b")).cast("bigint").alias("distance"),
        X.edit_similarity(F.col("a"), F.col("b")).alias("similarity"),
    )


@query(
    "f3_normalize_string",
    with_views([], f"select doc_id as paper_id, md5({S.normalize('text')}) as normalized from documents")
    .replace("with \n", ""),
)
def normalize_string(spark: SparkSession, folder: str) -> DataFrame:
    documents = B.table(spark, folder, "documents")
    return documents.select(
        F.col("doc_id").alias("paper_id"), F.md5(X.normalize_string(F.col("text"))).alias("normalized")
    )


@query(
    "f4_title_similarity",
    with_views(
        ["refs_v", "catalogue_v"],
        f"""select paper_id, ord, {S.title_similarity('a', 'b', 'l', 'r')} as similarity
        from (select *, {S.title_key('a')} as l, {S.title_key('b')} as r from pairs)""",
        PAIRS,
    ),
)
def title_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _cited_pairs(spark, folder).select(
        "paper_id", "ord", X.title_similarity(F.col("a"), F.col("b")).alias("similarity")
    )


@query(
    "f5_f8_trigram_similarity",
    with_views(
        ["refs_v", "catalogue_v"],
        f"""select paper_id, ord, cast(len(ga) as bigint) as n_trigrams, case when len(ga) + len(gb) = 0 then 0.0 else {S.jaccard('ga', 'gb')} end as similarity
        from (select paper_id, ord, {S.trigrams('a')} as ga, {S.trigrams('b')} as gb from pairs)""",
        PAIRS,
    ),
)
def trigram_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _cited_pairs(spark, folder).select(
        "paper_id",
        "ord",
        F.size(X.trigrams(F.col("a"))).cast("bigint").alias("n_trigrams"),
        X.trigram_similarity(F.col("a"), F.col("b")).alias("similarity"),
    )


def _plain_sql(text: str, low: bool) -> str:
    out = f"replace(translate({text}, '‘’“”–—', '''''\"\"--'), '…', '...')"
    return f"translate({out}, '‚„', '''\"')" if low else out


def _quotes_off(text: str) -> str:
    return rf"""regexp_replace(regexp_replace({text}, '^["'']+', ''), '["'']+$', '')"""


def _end_off(text: str) -> str:
    return rf"regexp_replace({text}, '[,.;:]+$', '')"


SEARCH_SQL = rf"trim(regexp_replace({_quotes_off(_end_off(_plain_sql('t', True)))}, '\s+', ' ', 'g'))"
QUERY_SQL = rf"trim(regexp_replace({_quotes_off(_end_off(_plain_sql('q', False)))}, '\s+', ' ', 'g'))"


@query(
    "f6_f7_clean_titles",
    with_views(
        ["refs_v"],
        f"""select paper_id, ord, coalesce({SEARCH_SQL}, '') as search_text, {QUERY_SQL} as query_text,
             {S.strip(_end_off(_plain_sql('t', False)))} as upload_text
        from (select paper_id, ord, concat('“', raw_text, '”…') as t,
                case when ord % 2 = 0 then raw_text else concat('‘', raw_text, '’,;') end as q
              from refs_v)""",
    ),
)
def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    refs = B.refs_v(spark, folder)
    curly = F.concat(F.lit("“"), F.col("raw_text"), F.lit("”…"))
    title = F.when(F.col("ord") % 2 == 1, F.concat(F.lit("‘"), F.col("raw_text"), F.lit("’,;")))
    return refs.select(
        "paper_id",
        "ord",
        X.clean_title_for_search(curly).alias("search_text"),
        X.clean_query(title, F.col("raw_text")).alias("query_text"),
        X.clean_upload_query(curly).alias("upload_text"),
    )


# --- verification ----------------------------------------------------------------------------
@query(
    "j6_verify_by_doi",
    with_views(
        ["refs_v", "catalogue_v"],
        """select r.paper_id, r.ord, r.doi, k.cat_id, case when k.cat_id is null then 'MISSING' else 'VALID' end as status
        from parsed r left join (select doi, min(cat_id) as cat_id from catalogue_v where doi <> '' group by doi) k
          on k.doi = r.doi where r.doi <> ''""",
        PARSED,
    ),
)
def verify_by_doi(spark: SparkSession, folder: str) -> DataFrame:
    refs = parsed_refs(spark, folder)
    return M.verify_by_doi(refs, B.catalogue_v(spark, folder)).select("paper_id", "ord", "doi", "cat_id", "status")


WORDS_SQL = lambda text: f"list_sort(list_distinct(list_filter(string_split({S.normalize(text)}, ' '), lambda w: w <> '')))"
UNDATED_SQL = rf"trim(regexp_replace({_quotes_off(_end_off(_plain_sql('title', False)))}, '\s+', ' ', 'g'))"


def candidates_ctes(k: int) -> list[tuple[str, str]]:
    return [
        PARSED,
        ("asked", f"select paper_id, ord, {WORDS_SQL(UNDATED_SQL)} as words from parsed where doi is null"),
        ("stored", f"select cat_id, {WORDS_SQL('title')} as words from catalogue_v"),
        (
            "cat_words",
            "select distinct words, unnest(words) as word from stored",
        ),
        ("ask_words", "select distinct words, unnest(words) as word from asked"),
        (
            "set_hits",
            """select a.words as q, c.words as c, count(*) as overlap from ask_words a join cat_words c on c.word = a.word
               group by a.words, c.words""",
        ),
        (
            "set_top",
            f"""select h.q, s.cat_id, cast(h.overlap as bigint) as overlap,
                 row_number() over (partition by h.q order by h.overlap desc, s.cat_id) as rank
               from set_hits h join stored s on s.words = h.c
               qualify row_number() over (partition by h.q order by h.overlap desc, s.cat_id) <= {k}""",
        ),
        (
            "candidates",
            "select a.paper_id, a.ord, t.cat_id, t.overlap, cast(t.rank as bigint) as rank from asked a join set_top t on t.q = a.words",
        ),
    ]


def undated_refs(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References without a DOI and their search text."""
    refs = parsed.where("doi is null")
    asked = refs.select("paper_id", "ord", X.clean_query(F.col("title"), F.col("raw_text")).alias("query"))
    return refs, asked


@query(
    "j7_title_candidates",
    with_views(["refs_v", "catalogue_v"], "select paper_id, ord, cat_id, overlap, rank from candidates", *candidates_ctes(5)),
)
def title_candidates(spark: SparkSession, folder: str) -> DataFrame:
    _, asked = undated_refs(parsed_refs(spark, folder))
    found = M.title_candidates(asked, B.catalogue_v(spark, folder), KEYS, k=5)
    return found.select(
        "paper_id", "ord", "cat_id", F.col("overlap").cast("bigint").alias("overlap"), F.col("rank").cast("bigint").alias("rank")
    )


PARTS = lambda text: rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda p: length(p) > 1)"
FIRST_AUTHOR_SQL = r"coalesce(nullif(trim(regexp_split_to_array(la, '[,;]|et\s+al')[1]), ''), la)"
MATCH_CTES = [
    (
        "scored",
        f"""select *, case when tsim > 0.6 then 0.4 when tsim > 0.3 then 0.2 else 0.0 end
              + case when year = cat_year and year <> 0 then 0.3 else 0.0 end
              + case when coalesce(la, '') <> '' and len(names) > 0 and (
                  len(list_filter(names, lambda n: contains(fa, string_split(n, ' ')[1]) or contains(n, coalesce(fp[1], ''))
                    or len(list_filter(fp, lambda p: len(list_filter({PARTS('n')}, lambda m: contains(m, p) or contains(p, m))) > 0)) > 0)) > 0
                  or len(list_filter(names, lambda n: contains(la, string_split(n, ' ')[1])
                    or list_contains(fp, string_split(n, ' ')[1]))) > 0)
                then 0.3 else 0.0 end as score
          from (select *, {PARTS('fa')} as fp from (
            select *, {FIRST_AUTHOR_SQL} as fa, {S.title_similarity('title', 'cat_title', 'l', 'r')} as tsim from (
              select c.*, p.title, try_cast(p.year as int) as year, lower(p.authors) as la, k.title as cat_title,
                k.year as cat_year, k.authors as names, {S.title_key('p.title')} as l, {S.title_key('k.title')} as r
              from candidates c join parsed p on p.paper_id = c.paper_id and p.ord = c.ord
              join catalogue_v k on k.cat_id = c.cat_id)))""",
    ),
    (
        "best",
        """select *, case when score > 0.4 or (score > 0.3 and tsim > 0.6) then 'VALID' else 'MISSING' end as status
           from scored qualify row_number() over (partition by paper_id, ord order by score desc, rank) = 1""",
    ),
]


@query(
    "j8_best_match",
    with_views(
        ["refs_v", "catalogue_v"],
        "select paper_id, ord, cat_id, cast(tsim as double) as title_sim, cast(score as double) as score, status from best",
        *candidates_ctes(5),
        *MATCH_CTES,
    ),
)
def best_match(spark: SparkSession, folder: str) -> DataFrame:
    refs, asked = undated_refs(cut_lineage(parsed_refs(spark, folder)))
    catalogue = cut_lineage(B.catalogue_v(spark, folder))
    return M.best_match(refs, M.title_candidates(asked, catalogue, KEYS, k=5), catalogue, KEYS)


@query(
    "w1_best_per_ref",
    with_views(
        ["refs_v", "catalogue_v"],
        """select paper_id, ord, cat_id, overlap from candidates
           qualify row_number() over (partition by paper_id, ord order by overlap desc, rank) = 1""",
        *candidates_ctes(5),
    ),
)
def best_per_ref(spark: SparkSession, folder: str) -> DataFrame:
    _, asked = undated_refs(parsed_refs(spark, folder))
    found = M.title_candidates(asked, B.catalogue_v(spark, folder), KEYS, k=5)
    found = found.withColumn("overlap", F.col("overlap").cast("bigint"))
    return M.best_per_ref(found, KEYS, ["cat_id"], score="overlap")


@query(
    "j10_best_title_match",
    with_views(
        ["refs_v", "catalogue_v"],
        f"""select paper_id, ord, cat_id, score,
             case when score > 0.7 then 'VALID' when score > 0.5 then 'INVALID' else 'MISSING' end as status
           from (select *, {S.title_similarity('title', 'cat_title', 'l', 'r')} as score from (
              select c.*, p.title, k.title as cat_title, {S.title_key('p.title')} as l, {S.title_key('k.title')} as r
              from candidates c join parsed p on p.paper_id = c.paper_id and p.ord = c.ord
              join catalogue_v k on k.cat_id = c.cat_id))
           qualify row_number() over (partition by paper_id, ord order by score desc, rank) = 1""",
        *candidates_ctes(3),
    ),
)
def best_title_match(spark: SparkSession, folder: str) -> DataFrame:
    refs, asked = undated_refs(cut_lineage(parsed_refs(spark, folder)))
    catalogue = cut_lineage(B.catalogue_v(spark, folder))
    return M.best_title_match(refs, M.title_candidates(asked, catalogue, KEYS, k=3), catalogue, KEYS)


@query(
    "j11_author_fallback",
    with_views(
        ["refs_v", "catalogue_v"],
        rf"""select paper_id, ord, cat_id, {S.title_similarity('title', 'cat_title', 'l', 'r')} as title_sim, 'MISSING' as status
           from (select f.paper_id, f.ord, f.cat_id, f.title, k.title as cat_title, {S.title_key('f.title')} as l,
               {S.title_key('k.title')} as r
             from (select a.paper_id, a.ord, a.title, min(c.cat_id) as cat_id
               from (select paper_id, ord, title, try_cast(year as int) as year,
                       lower(trim(regexp_split_to_array(authors, '(?i)[,;]|et\s+al')[1])) as fa from parsed) a
               join (select cat_id, year, unnest(authors) as name from catalogue_v) c on lower(trim(c.name)) = a.fa
                 and (a.year is null or c.year is null or abs(a.year - c.year) <= 1)
               where length(a.fa) > 3 group by a.paper_id, a.ord, a.title) f
             join catalogue_v k on k.cat_id = f.cat_id)""",
        PARSED,
    ),
)
def author_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return M.author_fallback(parsed_refs(spark, folder), B.catalogue_v(spark, folder), KEYS)


VERIFIED_CTES = [
    *candidates_ctes(5),
    *MATCH_CTES,
    (
        "verified",
        """select r.paper_id, r.ord, case when k.doi is null then 'MISSING' else 'VALID' end as status
             from parsed r left join (select distinct doi from catalogue_v where doi <> '') k on k.doi = r.doi where r.doi <> ''
           union all
           select r.paper_id, r.ord, coalesce(b.status, 'MISSING') from parsed r
             left join best b on b.paper_id = r.paper_id and b.ord = r.ord where r.doi is null""",
    ),
    (
        "ref_summary",
        """select paper_id, count(*) filter (status = 'VALID') as valid, count(*) filter (status = 'INVALID') as invalid,
             count(*) filter (status = 'MISSING') as missing, count(*) as total,
             count(*) filter (status = 'VALID') / count(*)::double * 100 as valid_pct
           from verified group by paper_id""",
    ),
]


def verified_refs(parsed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every reference with its status: by DOI where it has one, else by title. Both tables are read several times."""
    by_doi = M.verify_by_doi(parsed, catalogue).select("paper_id", "ord", "status")
    undated, asked = undated_refs(parsed)
    matched = M.best_match(undated, M.title_candidates(asked, catalogue, KEYS, k=5), catalogue, KEYS)
    by_title = (
        undated.select("paper_id", "ord")
        .join(matched.select("paper_id", "ord", "status"), KEYS, "left")
        .fillna("MISSING", ["status"])
    )
    return by_doi.unionByName(by_title)


@query(
    "a4_reference_summary",
    with_views(["refs_v", "catalogue_v"], "select * from ref_summary", *VERIFIED_CTES),
)
def reference_summary(spark: SparkSession, folder: str) -> DataFrame:
    parsed, catalogue = (cut_lineage(t(spark, folder)) for t in (parsed_refs, B.catalogue_v))
    return V.reference_summary(verified_refs(parsed, catalogue))


# --- papers against the catalogue ---------------------------------------------------------------
PAPER_CANDIDATES = [
    ("asked", f"select paper_id, {WORDS_SQL('title')} as words from papers_v"),
    *[c for c in candidates_ctes(5) if c[0] in ("stored", "cat_words", "ask_words", "set_hits", "set_top")],
]
CATALOGUE_MATCH_CTES = [
    *PAPER_CANDIDATES,
    ("names_of", """select paper_id, list(lower(name) order by "order") as names from authors_v group by paper_id"""),
    (
        "pairs",
        f"""select a.paper_id, t.cat_id, t.rank, p.title, p.year, coalesce(n.names, []) as names, k.title as cat_title,
             k.year as cat_year, k.authors as cat_names,
             1 - levenshtein(np, nk) / nullif(greatest(length(np), length(nk)), 0)::double > 0.8 as title_match,
             len(coalesce(n.names, [])) > 0 and len(k.authors) > 0 and len(list_filter(n.names, lambda x: len(list_filter(k.authors,
               lambda y: 1 - levenshtein(x, y) / greatest(length(x), length(y))::double > 0.7)) > 0)) > 0 as author_match
           from asked a join set_top t on t.q = a.words join papers_v p on p.paper_id = a.paper_id
           join catalogue_v k on k.cat_id = t.cat_id left join names_of n on n.paper_id = a.paper_id
           cross join lateral (select {S.normalize('p.title')} as np, {S.normalize('k.title')} as nk)""",
    ),
    (
        "scored",
        """select *, greatest(0.0::double, least(1.0::double, case when title_match then 0.4::double else 0.0 end
             + case when year = cat_year then 0.3 when year <> cat_year then -0.2
                 when year is not null or cat_year is not null then -0.05 else 0.0 end
             + case when len(names) = 0 or len(cat_names) = 0 then 0.0 when author_match then 0.3 else -0.15 end)) as score
           from pairs""",
    ),
    (
        "best",
        """select *, score > 0.5 as is_found,
             count(*) filter (len(names) > 0 and len(cat_names) = 0) over (partition by paper_id) as n_unnamed from scored
           qualify row_number() over (partition by paper_id order by score desc, rank) = 1""",
    ),
]
MATCH_COLUMNS_SQL = """p.paper_id, case when b.is_found then b.cat_id end as cat_id, coalesce(b.is_found, false) as found,
   case when b.is_found then round(b.score, 6) else 0.0 end as match_score,
   coalesce(b.is_found and b.title_match, false) as title_match,
   coalesce(b.is_found and b.year = b.cat_year, false) as year_match,
   coalesce(b.is_found and b.author_match, false) as author_match"""


def matched_papers(spark: SparkSession, folder: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("order", "name"))), lambda s: s["name"])
    authors = B.authors_v(spark, folder).groupBy("paper_id").agg(names.alias("authors"))
    papers = cut_lineage(
        B.papers_v(spark, folder)
        .select("paper_id", "title", "year")
        .join(authors, "paper_id", "left")
        .withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    )
    asked = papers.select("paper_id", X.clean_title_for_search(F.col("title")).alias("query"))
    catalogue = cut_lineage(B.catalogue_v(spark, folder))
    found = M.title_candidates(asked, catalogue, ["paper_id"], k=5)
    return M.catalogue_match(papers, found, catalogue)


@query(
    "j9_catalogue_match",
    with_views(
        ["papers_v", "catalogue_v", "authors_v"],
        f"select {MATCH_COLUMNS_SQL} from papers_v p left join best b on b.paper_id = p.paper_id",
        *CATALOGUE_MATCH_CTES,
    ),
)
def catalogue_match(spark: SparkSession, folder: str) -> DataFrame:
    return matched_papers(spark, folder).select(
        "paper_id", "cat_id", "found", F.round("match_score", 6).alias("match_score"),
        "title_match", "year_match", "author_match",
    )


DIFFERENCES_SQL = S.notes(
    """case when b.is_found and b.year is not null and b.cat_year is null
         then concat('Year mismatch: PDF has ', cast(b.year as varchar), ', OpenAlex has unknown') end""",
    """case when b.is_found and len(b.names) > 0 and len(b.cat_names) > 0 and not b.author_match
         then 'Author mismatch: PDF authors don''t match OpenAlex authors' end""",
    """case when b.is_found and not b.title_match
         then concat('Title mismatch: "', b.title, '" vs "', b.cat_title, '"') end""",
)


UNNAMED_SQL = "list_transform(range(coalesce(b.n_unnamed, 0)), lambda i: 'OpenAlex paper has no author information')"
WARNINGS_SQL = f"""array_to_string(list_concat({UNNAMED_SQL}, list_filter([
  case when b.paper_id is null then 'No matching papers found in OpenAlex' end,
  case when b.is_found and len(b.names) > 0 and len(b.cat_names) = 0
    then 'Could not compare authors - OpenAlex has no author information' end,
  case when not b.is_found then printf('Best match score (%.2f) is below threshold (0.5)', b.score) end], lambda n: n is not null)), '; ')"""


@query(
    "p18_match_notes",
    with_views(
        ["papers_v", "catalogue_v", "authors_v"],
        f"""select p.paper_id, coalesce({DIFFERENCES_SQL}, '') as differences, {WARNINGS_SQL} as match_warnings
        from papers_v p left join best b on b.paper_id = p.paper_id""",
        *CATALOGUE_MATCH_CTES,
    ),
)
def match_notes(spark: SparkSession, folder: str) -> DataFrame:
    return matched_papers(spark, folder).select(
        "paper_id", *[F.array_join(c, "; ").alias(c) for c in ("differences", "match_warnings")]
    )
