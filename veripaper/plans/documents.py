"""Queries on document texts, pages, keywords and search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import references as R
from ..functions import text as X
from ..operators import documents as D
from ..operators import keywords as K
from . import bindings as B
from . import sql_text as S
from .oracle_views import with_views
from .registry import query

HEADED_SQL = " or ".join(
    f"""len(list_filter(lines,
      lambda l: contains(l, '{k}') and (length({S.strip('l')}) < 100 or regexp_matches(l, '\\d')))) > 0"""
    for k in P.REFERENCE_HEADINGS
)


@query(
    "f21_references_page",
    with_views(
        ["page_text_v"],
        f"""select paper_id, coalesce(min(case when page >= 2 and ({HEADED_SQL}) then page end), -1) as references_page
        from (select paper_id, page, string_split(lower(text), chr(10)) as lines from page_text_v) group by paper_id""",
    ),
)
def references_page(spark: SparkSession, folder: str) -> DataFrame:
    return D.references_page(B.page_text_v(spark, folder))


@query(
    "f22_references_section",
    with_views(
        ["texts_v"],
        rf"""select paper_id, md5(section) as digest, length(section) as n_chars from (select paper_id, coalesce(
             {', '.join(S.matched('body', '(?is)' + p) for p in P.SECTION_HEADINGS)},
             body) as section
           from (select paper_id, case when paper_id % 3 = 0 then concat(text, chr(10), 'References ', chr(10), text) else text end as body from texts_v))""",
    ),
)
def references_section(spark: SparkSession, folder: str) -> DataFrame:
    bodies = B.texts_v(spark, folder).selectExpr(
        "paper_id", "case when paper_id % 3 = 0 then concat(text, '\\n', 'References ', '\\n', text) else text end as body"
    )
    sections = bodies.select("paper_id", D.references_section(F.col("body")).alias("section"))
    return sections.select(
        "paper_id", F.md5("section").alias("digest"), F.length("section").cast("bigint").alias("n_chars")
    )


@query(
    "f23_references_pages",
    with_views(
        ["page_text_v"],
        rf"""select paper_id, page, md5(text) as digest from (
               select *, first_value(heading) over (partition by paper_id, run order by page) and run > 0 as belongs,
                      bool_or(heading) over (partition by paper_id) as headed
               from (select *, sum((heading or not loosely)::int) over (partition by paper_id order by page) as run
                     from (select *, regexp_matches(text, {S.re2(P.HEADING_ON_PAGE)}) as heading,
                                  regexp_matches(text, {S.re2(P.REFERENCE_LIKE_OR_ET_AL)}) as loosely from page_text_v)))
             where belongs or not headed""",
    ),
)
def references_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = D.references_pages(B.page_text_v(spark, folder))
    return pages.select("paper_id", "page", F.md5("text").alias("digest"))


BODY = r"regexp_replace(raw_text, '^\[\d+\]\s*', '')"


@query(
    "f24_split_references",
    with_views(["refs_v"], f"select paper_id, ord, replace({S.strip(BODY)}, ', ', ',' || chr(10)) as raw_text from refs_v"),
)
def split_references(spark: SparkSession, folder: str) -> DataFrame:
    """Each paper's four references as one section text, each wrapped after its commas."""
    body = F.regexp_replace("raw_text", P.REFERENCE_NUMBER, "")
    line = F.concat(F.lit("["), F.col("ord"), F.lit("] "), F.replace(body, F.lit(", "), F.lit(",\n")))
    sections = B.refs_v(spark, folder).groupBy("paper_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda s: s["line"]), "\n"
        ).alias("section")
    )
    return D.split_references(sections)


@query(
    "f25_w4_split_multi_paper",
    with_views(
        ["refs_v"],
        """select paper_id, ord, sub_order, case sub_order when 0 then concat('"', t, '", Journal One, vol. 3, pp. 5, 2009')
             else concat('A. Smith et al., "', t, ' again", Journal Two, vol. 4, pp. 6, 2010.') end as raw_text
           from (select paper_id, ord, concat('Study number ', cast(cited_id as varchar)) as t from refs_v)
           cross join (select 0 as sub_order union all select 1)""",
    ),
)
def split_multi_paper(spark: SparkSession, folder: str) -> DataFrame:
    refs = B.refs_v(spark, folder).selectExpr(
        "paper_id", "ord",
        """concat('A. Smith et al., "Study number ', cited_id, '", Journal One, vol. 3, pp. 5, 2009. "Study number ', cited_id,
             ' again", Journal Two, vol. 4, pp. 6, 2010.') as raw_text""",
    )
    return D.split_multi_paper(refs).select("paper_id", "ord", "sub_order", "raw_text")


QUOTED_PIECES = "regexp_split_to_array(text, '[\"'']')"


@query(
    "f20_quote_aware_squeeze",
    rf"""select doc_id, md5(coalesce(list_aggregate(list_transform(range(1, len({QUOTED_PIECES}) + 1),
        lambda i: concat(case when i % 2 = 1 then regexp_replace({QUOTED_PIECES}[i], '[\s\x0B]+', ' ', 'g')
            else replace({QUOTED_PIECES}[i], chr(10), ' ') end,
          coalesce(regexp_extract_all(text, '["'']')[i], ''))), 'string_agg', ''), '')) as digest from documents""",
)
def quote_aware_squeeze(spark: SparkSession, folder: str) -> DataFrame:
    documents = B.table(spark, folder, "documents")
    return documents.select("doc_id", F.md5(R.quote_aware_squeeze(F.col("text"))).alias("digest"))


LINES_SQL = rf"list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.strip('l')}), lambda l: l <> '')"
SKIPPED_SQL = " or ".join(f"regexp_matches(l, {S.re2(p)})" for p in P.FIRST_PAGE_SKIP)
STARTS_LIKE_NAME_SQL = f"regexp_matches(l, {S.re2(P.FIRST_PAGE_STARTS_LIKE_NAME)})"
TITLE_LIKE_SQL = "length(l) > 15 and " + " and ".join(
    f"not regexp_matches(l, {S.re2(p)})" for p in (P.FIRST_PAGE_NAME, P.FIRST_PAGE_NAME_INITIAL, P.FIRST_PAGE_DATE)
)
AFFILIATION_SQL = " or ".join(f"contains(l, '{mark}')" for mark in P.FIRST_PAGE_AFFILIATIONS)
TITLE_LINES = [
    ("line", f"select doc_id, unnest(range(1, len({LINES_SQL}) + 1)) as n, unnest({LINES_SQL}) as l from documents"),
    ("kept_line", f"""select doc_id, row_number() over (partition by doc_id order by n) as n, l, ({TITLE_LIKE_SQL}) as title_like,
          case when {TITLE_LIKE_SQL} then {STARTS_LIKE_NAME_SQL} or {AFFILIATION_SQL}
               else {STARTS_LIKE_NAME_SQL} or not (length(l) > 10 and not regexp_matches(l, '(?i)@|http|doi')) end as ends
        from line where not ({SKIPPED_SQL})"""),
    ("opened", "select doc_id, min(n) as a from kept_line where title_like group by doc_id"),
    ("closed", "select o.doc_id, a, min(n) as b from opened o left join kept_line k on k.doc_id = o.doc_id and k.n > a and k.ends group by all"),
    ("titled", rf"""select doc_id, regexp_replace(regexp_replace({S.strip("string_agg(l, ' ' order by n)")}, '\s+', ' ', 'g'), '[.,;:]+\s*$', '') as title
        from closed join kept_line using (doc_id) where n >= a and (b is null or n < b) group by doc_id"""),
    ("raw_line", "select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, unnest(string_split(text, chr(10))) as l from documents"),
    ("stopped", "select doc_id, min(n) as b from raw_line where contains(l, '@') or contains(l, 'Engineering') group by doc_id"),
    ("named", rf"""select doc_id, string_agg({S.strip('l')}, '; ' order by n) as authors from raw_line left join stopped using (doc_id)
        where n <= coalesce(b, n) and regexp_matches({S.strip('l')}, {S.re2(P.FIRST_PAGE_AUTHOR)}) group by doc_id"""),
    ("second", rf"""select doc_id, max_by(s, (length(s), -n)) as best from (
          select paper_id as doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n,
                 unnest(list_transform(string_split(text, chr(10)), lambda l: {S.strip('l')})) as s from page_text_v where page = 2)
        where regexp_matches(s, '^[A-Z]') group by doc_id"""),
]


@query(
    "f26_f27_f29_first_pages",
    with_views(
        ["page_text_v"],
        rf"""select doc_id, case when length(title) > 10 then title end as title, coalesce(authors, '') as authors,
               nullif(regexp_replace(regexp_replace(trim(regexp_replace(best, '\s+', ' ', 'g')), {S.re2(P.TITLE_LABEL)}, ''), '[.!?]+$', ''), '') as second_title
             from documents left join titled using (doc_id) left join named using (doc_id) left join second using (doc_id)""",
        *TITLE_LINES,
    ),
)
def first_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and authors read off whole document texts, second titles off the second pages."""
    text = F.col("text")
    second = B.page_text_v(spark, folder).where("page = 2").select(
        F.col("paper_id").alias("doc_id"), D.second_page_title(text).alias("second_title")
    )
    return (
        B.table(spark, folder, "documents")
        .select("doc_id", "text")
        .repartition("doc_id", "text")  # else a file of one row group is one task
        .select(
            "doc_id",
            D.first_page_title(text).alias("title"),
            F.array_join(D.first_page_authors(text), "; ").alias("authors"),
        )
        .join(second, "doc_id", "left")
    )


@query(
    "f28_first_page_year",
    with_views(
        ["refs_v"],
        rf"""select paper_id, ord, try_cast(coalesce({S.matched('raw_text', P.MONTH_DATE)}, {S.matched('raw_text', P.RECENT_YEAR)}) as int) as year
        from (select paper_id, ord, case when ord = 1 then concat(raw_text, ' Published Mar 3, 2019') else raw_text end as raw_text from refs_v)""",
    ),
)
def first_page_year(spark: SparkSession, folder: str) -> DataFrame:
    refs = B.refs_v(spark, folder).selectExpr(
        "paper_id", "ord", "case when ord = 1 then concat(raw_text, ' Published Mar 3, 2019') else raw_text end as raw_text"
    )
    return refs.select("paper_id", "ord", D.first_page_year(F.col("raw_text")).alias("year"))


@query(
    "f30_extract_abstract",
    with_views(
        ["texts_v"],
        rf"select paper_id, {S.strip(S.matched('text', P.ABSTRACT_SECTION))} as abstract from texts_v",
    ),
)
def extract_abstract(spark: SparkSession, folder: str) -> DataFrame:
    return B.texts_v(spark, folder).select("paper_id", D.extract_abstract(F.col("text")).alias("abstract"))


@query(
    "f31_section_flags",
    with_views(
        ["texts_v"],
        """select paper_id, regexp_matches(text, '(?i)abstract') as has_abstract,
           regexp_matches(text, '(?i)conclusion|concluding') as has_conclusion from texts_v""",
    ),
)
def section_flags(spark: SparkSession, folder: str) -> DataFrame:
    return D.section_flags(B.texts_v(spark, folder))


@query(
    "f32_fallback_authors_year",
    with_views(
        ["papers_v"],
        r"""select paper_id, case when paper_id % 3 = 0 then 'Ann Lee' else array_to_string(list_filter(list_transform(
             regexp_split_to_array(author, '[,;]'), lambda a: trim(a)), lambda a: a <> ''), '|') end as authors,
           coalesce(nullif(case when paper_id % 4 = 0 then year end, 0), try_cast(nullif(regexp_extract(
             case when paper_id % 2 = 0 then concat('D:', strftime(created_at, '%Y%m%d')) else 'D:20190203' end, '(\d{4})', 1), '') as int)) as year
           from (select *, concat(source, ' Smith; B ', cast(paper_id as varchar), ' ,, C') as author from papers_v)""",
    ),
)
def fallback_authors_year(spark: SparkSession, folder: str) -> DataFrame:
    metadata = B.papers_v(spark, folder).selectExpr(
        "paper_id",
        "case when paper_id % 3 = 0 then array('Ann Lee') else array() end as authors",
        "concat(source, ' Smith; B ', paper_id, ' ,, C') as author",
        "case when paper_id % 4 = 0 then year end as year",
        "case when paper_id % 2 = 0 then concat('D:', date_format(created_at, 'yyyyMMdd')) end as creation_date",
        "'D:20190203' as mod_date",
    )
    return D.fallback_authors_year(metadata).select("paper_id", F.array_join("authors", "|").alias("authors"), "year")


# --- keywords and hits ------------------------------------------------------------------------
# Boundaries know ASCII only here: letters and digits beyond it are masked as word characters of no pattern.
FOUND_SQL = "list_concat(" + ", ".join(
    f"regexp_extract_all({'ocr_text' if p.startswith(chr(34)) or '×' in p else 'masked'}, {S.re2(p)}, 1)" for p in P.KEYWORD_PATTERNS
) + ")"
FOUND_WORDS = [
    ("masked_text", "select *, array_to_string(list_transform(regexp_extract_all(ocr_text, '(?s).'), "
     r"lambda c: case when regexp_matches(c, '[^\x00-\x7F]') and regexp_matches(c, '[\p{L}\p{N}]') then '_' else c end), '') as masked from ocr_text_v"),
    ("found_words", f"select image_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from (select image_id, {FOUND_SQL} as w from masked_text)"),
    ("kept_words", f"""select image_id, pos, {S.strip('word')} as k from found_words where length(word) >= 2 and {S.strip('word')} <> ''
        and lower(word) not in ({', '.join(repr(w) for w in P.STOP_WORDS)})"""),
    ("spelled_words", r"""select image_id, case when (regexp_matches(k, '\p{Lu}') and not regexp_matches(k, '\p{Ll}'))
          or (regexp_matches(k, '^\p{Lu}') and length(k) > 2) then k else lower(k) end as keyword from kept_words
        qualify row_number() over (partition by image_id, lower(k) order by pos) = 1"""),
    ("ranked_words", """select image_id, row_number() over (partition by image_id order by length(keyword) desc, lower(keyword))::int as rank, keyword
        from spelled_words"""),
]


@query("f33_extract_keywords", with_views(["ocr_text_v"], "select image_id, rank, keyword from ranked_words", *FOUND_WORDS))
def extract_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return K.extract_keywords(B.ocr_text_v(spark, folder))


ARCHITECTURE_SQL = "list_filter(w, lambda x: " + " or ".join(f"contains(lower(x), '{t}')" for t in P.ARCHITECTURE_TERMS) + ")"
MADE_QUERIES = [
    *FOUND_WORDS,
    ("word_lists", f"""select *, {ARCHITECTURE_SQL} as arch from (select t.image_id, t.ocr_text, coalesce(l.w, []) as w from ocr_text_v t
        left join (select image_id, list(keyword order by rank) as w from ranked_words group by image_id) l using (image_id))"""),
    ("made_lists", f"""select image_id, case when len(w) = 0 then list_filter([nullif({S.strip('ocr_text')}, '')], lambda x: x is not null) else
        list_concat(
          flatten(list_transform(w, lambda x: [x || ' diagram', x || ' architecture'])),
          list_filter(flatten(list_transform(range(1, len(w) + 1), lambda i: [w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 2]])), lambda x: x is not null),
          flatten(list_transform(arch, lambda x: [x || ' architecture', x || ' diagram', x || ' neural network'])),
          regexp_extract_all(ocr_text, {S.re2(P.QUERY_PHRASES[0])}, 1),
          list_transform(regexp_extract_all(ocr_text, {S.re2(P.QUERY_PHRASES[1])}, 1), lambda q: regexp_replace(q, '^(\\w+)\\s+', '\\1 ')),
          flatten(list_transform(list_filter(w, lambda x: contains(lower(x), 'x') or contains(x, '×')),
            lambda s: list_transform(arch, lambda a: a || ' ' || s)))) end as q from word_lists"""),
    ("made_queries", f"""select image_id, pos, {S.strip('query')} as query from (
        select image_id, unnest(range(0, len(q)))::int as pos, unnest(q) as query from made_lists)"""),
]


@query(
    "f34_build_queries",
    with_views(
        ["ocr_text_v"],
        """select image_id, pos, query from made_queries where length(query) >= 3
           qualify row_number() over (partition by image_id, lower(query) order by pos) = 1""",
        *MADE_QUERIES,
    ),
)
def build_queries(spark: SparkSession, folder: str) -> DataFrame:
    texts = B.ocr_text_v(spark, folder)
    return K.build_queries(texts, K.extract_keywords(texts))


WORDS_SQL = f"list_distinct(list_filter(string_split({S.normalize('title')}, ' '), lambda w: w <> ''))"
KEYWORDS = (
    "keywords",
    f"""select paper_id as image_id, keyword, row_number() over (partition by paper_id order by length(keyword) desc, keyword) as rank
        from (select paper_id, unnest({WORDS_SQL}) as keyword from papers_v)
        """,
)


def title_keywords(spark: SparkSession, folder: str) -> DataFrame:
    words = B.papers_v(spark, folder).select(
        F.col("paper_id").alias("image_id"), F.explode(X.title_words(F.col("title"))).alias("keyword")
    )
    return K.ranked_keywords(words)


@query("o2_top_keywords", with_views(["papers_v"], "select image_id, rank, keyword from keywords where rank <= 30", KEYWORDS))
def top_keywords(spark: SparkSession, folder: str) -> DataFrame:
    top = K.top_keywords(title_keywords(spark, folder).select("image_id", "keyword"))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "o4_top_queries",
    "select conv_id as image_id, turn as pos, text as query from conversations qualify row_number() over (partition by conv_id order by turn) <= 5",
)
def top_queries(spark: SparkSession, folder: str) -> DataFrame:
    turns = B.table(spark, folder, "conversations").selectExpr("conv_id as image_id", "turn as pos", "text as query")
    return K.top_queries(turns)


@query(
    "w2_first_seen_url",
    with_views(
        ["hits_v"],
        "select image_id, url, call from hits_v where url <> '' qualify row_number() over (partition by image_id, url order by call, pos) = 1",
    ),
)
def first_seen_url(spark: SparkSession, folder: str) -> DataFrame:
    return K.first_seen_url(B.hits_v(spark, folder)).select("image_id", "url", "call")


HIT_SQL = """contains(lower(url), 'github.com') or contains(lower(url), '.pdf') or contains(lower(url), 'arxiv.org')
  or contains(lower(url), 'research') or contains(lower(url), 'dataset') or contains(lower(coalesce(title, '')), 'diagram')
  or contains(lower(coalesce(title, '')), 'architecture')"""


@query("p10_filter_hits", with_views(["hits_v"], f"select image_id, call, url from hits_v where {HIT_SQL}"))
def filter_hits(spark: SparkSession, folder: str) -> DataFrame:
    return K.filter_hits(B.hits_v(spark, folder)).select("image_id", "call", "url")


SCORED_HITS = (
    "scored",
    rf"""select *, len(matched) / greatest(len(words), 1)::double * 0.6::double
           + len(list_intersect(ocr, regexp_split_to_array(combined, '\s+'))) / greatest(len(ocr), 1)::double * 0.4::double as raw
         from (select h.page_id, h.url, k.words, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda w: w <> '')) as ocr,
             h.combined, list_filter(k.words, lambda w: contains(h.combined, w)) as matched
           from (select page_id, url, concat(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), ' ',
               lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')))) as combined from pages) h
           join (select image_id, list(keyword order by rank) as words from keywords group by image_id) k on k.image_id = h.page_id
           join documents d on d.doc_id = h.page_id)""",
)


def _page_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored page as a hit for the document of the same number."""
    return B.table(spark, folder, "pages").selectExpr(
        "page_id as image_id", "0 as call", "0 as pos", "url",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) as title",
        "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '), '[ \\\\t\\\\r\\\\n]+', ' ')) as snippet",
    )


def _scored_hits(spark: SparkSession, folder: str) -> DataFrame:
    texts = B.table(spark, folder, "documents").selectExpr("doc_id as image_id", "text as ocr_text")
    return K.score_hits(_page_hits(spark, folder), title_keywords(spark, folder), texts)


@query(
    "f35_score_hits",
    with_views(
        ["papers_v"],
        """select page_id as image_id, url, round(raw, 6) > 0.3 as kept, case when len(matched) > 0
             then concat('Keywords matched: ', array_to_string(matched, ', ')) else 'Contextual match' end as reason
           from scored where raw > 0.3""",
        KEYWORDS,
        SCORED_HITS,
    ),
)
def score_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_hits(spark, folder).select("image_id", "url", F.lit(True).alias("kept"), "reason")


@query(
    "o3_top_hits",
    with_views(
        ["papers_v"],
        """select page_id % 20 as image_id, round_even(raw, 2) as confidence, url from scored where raw > 0.3
           qualify row_number() over (partition by page_id % 20 order by round_even(raw, 2) desc, page_id, url) <= 10""",
        KEYWORDS,
        SCORED_HITS,
    ),
)
def top_hits(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored_hits(spark, folder).withColumn("call", F.col("image_id")).withColumn("image_id", F.col("image_id") % 20)
    return K.top_hits(scored).select("image_id", "confidence", "url")


@query(
    "u4_shared_words",
    rf"""select doc_id, case when len(a) = 0 then 0.0 else len(list_intersect(a, regexp_split_to_array(lower(h), '\s+'))) / len(a)::double end as share
       from (select d.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda w: w <> '')) as a, p.html as h
             from documents d join pages p on p.page_id = d.doc_id)""",
)
def shared_words(spark: SparkSession, folder: str) -> DataFrame:
    documents = B.table(spark, folder, "documents").select("doc_id", "text")
    pages = B.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return documents.join(pages, "doc_id").select("doc_id", X.shared_words(F.col("text"), F.col("html")).alias("share"))


PAGES_SQL = (
    "linked",
    """select page_id, replace(replace(html, 'href="/', case page_id % 3 when 0 then 'href="https://www.google.com/' else 'href="https://site.example.org/' end),
         '<article>', concat('<img src="', url, '/a.png"><img alt="x" src="/b.png"><article>')) as html from pages""",
)


def linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages with their links made absolute and two images put in."""
    return B.table(spark, folder, "pages").selectExpr(
        "page_id",
        """replace(replace(html, 'href="/', case page_id % 3 when 0 then 'href="https://www.google.com/' else 'href="https://site.example.org/' end),
         '<article>', concat('<img src="', url, '/a.png"><img alt="x" src="/b.png"><article>')) as html""",
    )


@query(
    "p13_outbound_links",
    with_views(
        ["papers_v"],
        r"""select page_id, cast(i - 1 as int) as pos, kept[i].u as url, kept[i].t as title from (
             select page_id, kept, unnest(range(1, len(kept) + 1)) as i from (
               select page_id, list_filter(list_transform(range(1, len(us) + 1), lambda i: {'u': us[i],
                   't': regexp_replace(regexp_replace(ts[i], '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')}),
                 lambda x: not regexp_matches(regexp_extract(x.u, '^[a-z]+://([^/?#]*)', 1), 'google\.com|gstatic\.com|ggpht\.com')
                   and length(x.t) > 3) as kept
               from (select page_id, regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*http[^"]*)"[^>]*>(.*?)</a>', 1) as us,
                 regexp_extract_all(html, '(?s)<a [^>]*href="([^"]*http[^"]*)"[^>]*>(.*?)</a>', 2) as ts from linked)))""",
        PAGES_SQL,
    ),
)
def outbound_links(spark: SparkSession, folder: str) -> DataFrame:
    return K.outbound_links(linked_pages(spark, folder))


@query(
    "p28_similar_images",
    with_views(
        ["papers_v"],
        """select page_id, len(urls)::bigint as n_images, len(urls) > 0 as found, array_to_string(urls, ' ') as urls from (
             select page_id, list_filter(regexp_extract_all(html, '<img [^>]*src="([^"]*)"', 1), lambda u: starts_with(u, 'http')) as urls
             from linked)""",
        PAGES_SQL,
    ),
)
def similar_images(spark: SparkSession, folder: str) -> DataFrame:
    return K.similar_images(linked_pages(spark, folder)).select(
        "page_id", F.col("n_images").cast("bigint").alias("n_images"), "found", F.array_join("urls", " ").alias("urls")
    )


@query(
    "f37_choose_references",
    with_views(
        ["refs_v"],
        """select paper_id, ord, case when paper_id % 3 = 0 then concat('by model: ', raw_text) else raw_text end as raw_text from refs_v
           where paper_id % 3 <> 0 or ord % 2 = 0""",
    ),
)
def choose_references(spark: SparkSession, folder: str) -> DataFrame:
    """Every third paper has model rows, for half of its references."""
    refs = B.refs_v(spark, folder).select("paper_id", "ord", "raw_text")
    by_model = refs.where("paper_id % 3 = 0 and ord % 2 = 0").withColumn("raw_text", F.concat(F.lit("by model: "), F.col("raw_text")))
    return D.choose_references(by_model, refs)
