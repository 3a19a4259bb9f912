"""Queries on catalogue records, stored responses and page boxes derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..operators import alerts as A
from ..operators import diagrams as G
from ..operators import documents as D
from ..operators import regions as R
from ..sources import catalogues as C
from . import bindings as B
from .oracle_views import with_views
from .registry import query


def _catalogue_records(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every paper as a record of each catalogue."""
    p = B.papers_v(spark, folder)
    openalex = """to_json(named_struct('id', concat('W', paper_id), 'title', if(paper_id % 4 = 0, null, title), 'display_name', concat('Shown ', paper_id),
        'doi', doi, 'publication_year', year, 'biblio', named_struct('first_page', paper_id, 'last_page', if(paper_id % 2 = 0, paper_id + 9, null)),
        'authorships', array(named_struct('author', named_struct('display_name', concat('Author ', paper_id % 10))))))"""
    crossref = """to_json(named_struct('DOI', doi, 'title', array(title), 'published', named_struct('date-parts', array(array(year))),
        'container-title', array(venue), 'author', array(named_struct('given', if(paper_id % 3 = 0, null, 'Ann'), 'family', concat('Lee', paper_id % 10)))))"""
    semantic = """to_json(named_struct('paperId', concat('S', paper_id), 'title', title, 'year', year, 'venue', if(paper_id % 2 = 0, '', venue),
        'journal', named_struct('name', 'Fallback'), 'externalIds', named_struct('DOI', doi), 'authors', array(named_struct('name', 'Bo Ek'))))"""
    texts = {"openalex": openalex, "crossref": crossref, "semantic": semantic}
    return {name: p.selectExpr(f"{text} as value") for name, text in texts.items()}


@query(
    "s1_s2_s3_u1_union_sources",
    with_views(
        ["papers_v"],
        """select 'openalex' as source, concat('W', cast(paper_id as varchar)) as source_id,
             case when paper_id % 4 = 0 or title = '' then concat('Shown ', cast(paper_id as varchar)) else title end as title, doi, year,
             cast(null as varchar) as venue, case when paper_id % 2 = 0 then concat(cast(paper_id as varchar), '-', cast(paper_id + 9 as varchar)) else cast(paper_id as varchar) end as pages,
             concat('Author ', cast(paper_id % 10 as varchar)) as authors from papers_v
           union all select 'crossref', doi, title, doi, year, venue, null,
             case when paper_id % 3 = 0 then '' else 'Ann ' end || concat('Lee', cast(paper_id % 10 as varchar)) from papers_v
           union all select 'semantic', concat('S', cast(paper_id as varchar)), title, doi, year,
             case when paper_id % 2 = 0 or venue is null then 'Fallback' else venue end, null, 'Bo Ek' from papers_v""",
    ),
)
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    records = _catalogue_records(spark, folder)
    united = C.union_sources(*[C.normalize_catalogue(raw, name) for name, raw in records.items()])
    names = F.array_join(F.transform("authors", lambda a: a["name"]), ", ")
    return united.select("source", "source_id", "title", "doi", "year", "venue", "pages", names.alias("authors"))


@query(
    "s11_read_search_hits",
    """select page_id as image_id, k.pos, case k.pos when 0 then url else concat(url, '/2') end as url,
         case when page_id % 3 = 2 then concat('Topic ', cast(page_id as varchar)) else concat('Title ', cast(page_id as varchar)) end as title,
         case page_id % 3 when 0 then concat('Snippet ', cast(page_id as varchar)) when 1 then '' else concat('Topic ', cast(page_id as varchar)) end as snippet
       from pages cross join (select 0 as pos union all select 1) k""",
)
def read_search_hits(spark: SparkSession, folder: str) -> DataFrame:
    raw = B.table(spark, folder, "pages").selectExpr(
        "page_id as image_id", "0 as call",
        """case page_id % 3
             when 0 then to_json(named_struct('organic', transform(array('', '/2'), s -> named_struct('link', concat(url, s), 'title', concat('Title ', page_id), 'snippet', concat('Snippet ', page_id)))))
             when 1 then to_json(named_struct('items', transform(array('', '/2'), s -> named_struct('link', concat(url, s), 'title', concat('Title ', page_id)))))
             else to_json(named_struct('RelatedTopics', transform(array('', '/2'), s -> named_struct('FirstURL', concat(url, s), 'Text', concat('Topic ', page_id))))) end as response""",
    )
    return C.read_search_hits(raw).select("image_id", "pos", "url", "title", "snippet")


@query(
    "s13_build_alert_payloads",
    with_views(
        ["alerts_v"],
        """select a.alert_id, c.channel, case c.channel when 'slack' then case severity when 'INFO' then '#36a64f' when 'WARNING' then '#ff9900'
               when 'ERROR' then '#ff0000' else '#8b0000' end
             else case severity when 'INFO' then '3581519' when 'WARNING' then '16750848' when 'ERROR' then '16711680' else '9109504' end end as colour,
             case when c.channel = 'slack' then cast(cast(floor(epoch(created_at)) as bigint) as varchar) end as moment
           from alerts_v a cross join (select 'slack' as channel union all select 'discord') c""",
    ),
)
def build_alert_payloads(spark: SparkSession, folder: str) -> DataFrame:
    sent = A.build_alert_payloads(B.alerts_v(spark, folder), ["slack", "discord"])
    colour = F.coalesce(
        F.get_json_object("payload", "$.attachments[0].color"), F.get_json_object("payload", "$.embeds[0].color")
    )
    return sent.select(
        "alert_id", "channel", colour.alias("colour"), F.get_json_object("payload", "$.attachments[0].ts").alias("moment")
    )


@query(
    "s14_check_files",
    r"""select doc_id, not (doc_id % 4 = 0 or n_chars * 100000 > 52428800) as accepted,
         regexp_replace(concat(lang, ' My_', cast(doc_id as varchar), case when doc_id % 4 = 0 then '.txt' else '.pdf' end), '[^a-zA-Z0-9.-]', '_', 'g') as stored_name,
         concat(lang, ' My ', cast(doc_id as varchar), case when doc_id % 4 = 0 then '.txt' else '' end) as title from documents""",
)
def check_files(spark: SparkSession, folder: str) -> DataFrame:
    files = B.table(spark, folder, "documents").selectExpr(
        "doc_id", "n_chars * 100000 as length", "concat(lang, ' My_', doc_id, if(doc_id % 4 = 0, '.txt', '.pdf')) as filename"
    )
    return C.check_files(files).select("doc_id", "accepted", "stored_name", "title")


@query(
    "p16_reference_details",
    with_views(
        ["refs_v", "catalogue_v"],
        """select r.paper_id, r.ord, case r.ord when 1 then 'crossref' when 2 then 'crossref' when 3 then 'openalex' else 'other' end as source,
             case when r.ord <= 3 then coalesce(k.title, '') end as api_title, case when r.ord <= 3 then k.year end as api_year,
             r.ord / 10.0::double as match_score
           from refs_v r join catalogue_v k on k.cat_id = r.cited_id where k.title <> ''""",
    ),
)
def reference_details(spark: SparkSession, folder: str) -> DataFrame:
    cat = B.catalogue_v(spark, folder).selectExpr("cat_id as cited_id", "title", "year").where("title <> ''")
    refs = B.refs_v(spark, folder).select("paper_id", "ord", "cited_id").join(cat, "cited_id").selectExpr(
        "paper_id", "ord",
        """case ord when 1 then to_json(named_struct('source', 'crossref_search', 'matchScore', 0.1D, 'data', named_struct('title', array(title), 'published', named_struct('date-parts', array(array(year))))))
             when 2 then to_json(named_struct('source', 'crossref', 'matchScore', 0.2D, 'data', named_struct('title', title, 'year', year)))
             when 3 then to_json(named_struct('source', 'openalex', 'matchScore', 0.3D, 'data', named_struct('display_name', title, 'publication_year', year)))
             else to_json(named_struct('source', 'other', 'matchScore', 0.4D, 'data', named_struct('x', 1))) end as verification""",
    )
    return C.reference_details(refs).select("paper_id", "ord", "source", "api_title", "api_year", "match_score")


@query(
    "f36_parse_llm_responses",
    with_views(
        ["refs_v"],
        """select paper_id, ord, concat('Study ', cast(cited_id as varchar)) as title, case when cited_id % 3 = 0 then null else 1990 + cited_id % 30 end as year,
             case when cited_id % 2 = 0 then 'Conf' else 'Jour' end as venue, 'A B, C D' as authors from refs_v""",
    ),
)
def parse_llm_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Four references per stored response, some behind code fences."""
    one = F.expr(
        """named_struct('ord', ord, 'r', named_struct('title', concat('Study ', cited_id), 'authors', 'A B ,C D', 'year',
             if(cited_id % 3 = 0, 'n.d.', cast(1990 + cited_id % 30 as string)), 'conference', if(cited_id % 2 = 0, 'Conf', null), 'journal', 'Jour'))"""
    )
    raw = B.refs_v(spark, folder).groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("refs")).selectExpr(
        "paper_id", "to_json(named_struct('references', transform(refs, x -> x.r))) as body"
    ).selectExpr("paper_id", "if(paper_id % 2 = 0, concat('```json\\n', body, '\\n```'), body) as response")
    return D.parse_llm_responses(raw).select("paper_id", "ord", "title", "year", "venue", "authors")


REGIONS_SQL = (
    "regions",
    """select l_orderkey as doc_id, cast(l_linenumber as int) as page, l_partkey as region_id, l_quantity * 10 as x0, l_discount * 3000 as y0,
         l_quantity * 10 + 60 + l_suppkey % 400 as x1, l_discount * 3000 + 60 + l_partkey % 300 as y1,
         case l_returnflag when 'A' then 'png' when 'N' then 'JPG' else 'gif' end as ext, 800.0::double as page_w, 1000.0::double as page_h from lineitem""",
)


def page_regions(spark: SparkSession, folder: str) -> DataFrame:
    return B.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as doc_id", "cast(l_linenumber as int) as page", "l_partkey as region_id", "l_quantity * 10 as x0",
        "l_discount * 3000 as y0", "l_quantity * 10 + 60 + l_suppkey % 400 as x1", "l_discount * 3000 + 60 + l_partkey % 300 as y1",
        "case l_returnflag when 'A' then 'png' when 'N' then 'JPG' else 'gif' end as ext", "800.0D as page_w", "1000.0D as page_h",
    )


LARGE = """((x1 - x0) * (y1 - y0) > page_w * page_h * 0.6 or x1 - x0 > page_w * 0.75 or y1 - y0 > page_h * 0.75
  or (x0 < page_w * 0.05 and y0 < page_h * 0.05 and x1 > page_w * 0.95 and y1 > page_h * 0.95))"""
LOGO = """((trunc(x1 - x0) = 260 and trunc(y1 - y0) = 128) or (trunc(x1 - x0) = 128 and trunc(y1 - y0) = 260))"""


@query(
    "p7_filter_embedded_images",
    with_views(
        ["papers_v"],
        f"""select r.doc_id, r.page, r.region_id, count(*) as n from regions r where lower(ext) in ('jpg', 'jpeg', 'png') and not {LARGE}
           and x1 - x0 >= 100 and y1 - y0 >= 100 and not {LOGO} and page >= 2
           and (doc_id % 3 <> 0 or page < 5) group by 1, 2, 3""",
        REGIONS_SQL,
    ),
)
def filter_embedded_images(spark: SparkSession, folder: str) -> DataFrame:
    regions = page_regions(spark, folder)
    references = regions.select("doc_id").distinct().selectExpr("doc_id", "if(doc_id % 3 = 0, 5, -1) as references_page")
    kept = R.filter_embedded_images(regions, references)
    return kept.groupBy("doc_id", "page", "region_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j15_p9_drawing_regions",
    with_views(
        ["papers_v"],
        f"""select r.doc_id, r.page, r.region_id, r.n_text from (
             select d.*, (select count(*) from boxes b where b.doc_id = d.doc_id and b.page = d.page
               and d.x0 < b.x1 and b.x0 < d.x1 and d.y0 < b.y1 and b.y0 < d.y1) as n_text from drawn d) r
           where not {LARGE} and n_text <= 2 and x1 - x0 >= 150 and y1 - y0 >= 150""",
        REGIONS_SQL,
        ("boxes", "select doc_id, page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from regions group by doc_id, page, region_id % 5"),
        ("drawn", "select doc_id, page, region_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, 800.0::double as page_w, 1000.0::double as page_h from regions group by doc_id, page, region_id"),
    ),
)
def drawing_regions(spark: SparkSession, folder: str) -> DataFrame:
    regions = page_regions(spark, folder)
    corners = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    blocks = regions.groupBy("doc_id", "page", F.expr("region_id % 5")).agg(*corners)
    drawn = regions.groupBy("doc_id", "page", "region_id").agg(*corners).selectExpr("*", "800.0D as page_w", "1000.0D as page_h")
    return R.filter_drawing_regions(drawn, blocks, most_text=2).select("doc_id", "page", "region_id", "n_text")


NEAR_SQL = """sqrt(greatest(0, greatest(x0 - b.x1, b.x0 - x1)) ** 2 + greatest(0, greatest(y0 - b.y1, b.y0 - y1)) ** 2) < 50"""
TAKEN_SQL = f"list_filter(free, lambda b: {NEAR_SQL})"


@query(
    "x1_merge_regions",
    with_views(
        ["papers_v"],
        """select doc_id, page, i::bigint as region_id, done[i + 1].x0 as x0, done[i + 1].y0 as y0, done[i + 1].x1 as x1, done[i + 1].y1 as y1
           from (select *, unnest(range(len(done))) as i from rec_grown where x0 is null and len(free) = 0)""",
        REGIONS_SQL,
        (
            "free_boxes",
            """select doc_id, page, list({'x0': x0::double, 'y0': y0::double, 'x1': x1::double, 'y1': y1::double} order by region_id, x0, y0, x1, y1) as free
               from regions group by doc_id, page""",
        ),
        # One box grows at a time: it is taken from the front, takes in its neighbours, and is done when it has none.
        (
            "rec_grown",
            f"""select doc_id, page, free, null::double as x0, null::double as y0, null::double as x1, null::double as y1,
                 []::struct(x0 double, y0 double, x1 double, y1 double)[] as done from free_boxes
               union all
               select doc_id, page, case when x0 is null then free[2:] else list_filter(free, lambda b: not ({NEAR_SQL})) end,
                 {", ".join(
                     f"case when x0 is null then free[1].{c} when len({TAKEN_SQL}) > 0 then "
                     f"{'least' if c[1] == '0' else 'greatest'}({c}, list_{'min' if c[1] == '0' else 'max'}("
                     f"list_transform({TAKEN_SQL}, lambda b: b.{c}))) end" for c in ("x0", "y0", "x1", "y1"))},
                 case when x0 is not null and len({TAKEN_SQL}) = 0
                   then list_append(done, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) else done end
               from rec_grown where x0 is not null or len(free) > 0""",
        ),
    ),
)
def merge_regions(spark: SparkSession, folder: str) -> DataFrame:
    return R.merge_regions(page_regions(spark, folder))


SIZED_SQL = "lower(ext) in ('jpg', 'jpeg', 'png')"


@query(
    "p8_filter_images_simple",
    with_views(
        ["papers_v"],
        f"""select doc_id, page, region_id, count(*) as n from regions where {SIZED_SQL} and x1 - x0 >= 50 and y1 - y0 >= 50 and not {LOGO}
           group by all""",
        REGIONS_SQL,
    ),
)
def filter_images_simple(spark: SparkSession, folder: str) -> DataFrame:
    images = page_regions(spark, folder).withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})
    return R.filter_embedded_images_simple(images).groupBy("doc_id", "page", "region_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p27_image_boxes",
    with_views(
        ["papers_v"],
        f"""select doc_id, page, region_id, count(*) as n from regions where {SIZED_SQL} and x1 - x0 >= 100 and y1 - y0 >= 100 and not {LOGO}
           group by all""",
        REGIONS_SQL,
    ),
)
def image_boxes(spark: SparkSession, folder: str) -> DataFrame:
    boxes = R.image_boxes(page_regions(spark, folder))
    return boxes.groupBy("doc_id", "page", "region_id").agg(F.count(F.lit(1)).alias("n"))


CLIPPED_SQL = """select doc_id, page, region_id, round(a, 6) as x0, round(b, 6) as y0, round(greatest(a, least(x1, page_w)), 6) as x1,
    round(greatest(b, least(y1, page_h)), 6) as y1
  from (select *, greatest(0.0, least(x0, page_w)) as a, greatest(0.0, least(y0, page_h)) as b from regions)
  where greatest(a, least(x1, page_w)) - a >= 100 and greatest(b, least(y1, page_h)) - b >= 100"""


def _rounded(boxes: DataFrame) -> DataFrame:
    return boxes.select("doc_id", "page", "region_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("p26_clip_regions", with_views(["papers_v"], CLIPPED_SQL, REGIONS_SQL))
def clip_regions(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(R.clip_regions(page_regions(spark, folder)))


@query(
    "u2_union_regions",
    with_views(["papers_v"], "select page, 'image' as kind, count(*) as n from regions group by page union all select page, 'drawing', count(*) from regions where page > 1 group by page", REGIONS_SQL),
)
def union_regions(spark: SparkSession, folder: str) -> DataFrame:
    regions = page_regions(spark, folder)
    images = regions.withColumn("kind", F.lit("image"))
    drawings = regions.where("page > 1").drop("ext").withColumn("kind", F.lit("drawing"))
    return R.union_regions(images, drawings).groupBy("page", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a16_drawing_boxes",
    with_views(
        ["papers_v"],
        """select doc_id, page, region_id as drawing_id, round(min(x0), 6) as x0, round(min(y0), 6) as y0, round(max(x0), 6) as x1, round(max(y0), 6) as y1
           from (select doc_id, page, region_id % 2 as region_id, x0, y0 from regions union all select doc_id, page, region_id % 2, x1, y1 from regions)
           group by all having max(x0) - min(x0) >= 50 and max(y0) - min(y0) >= 50""",
        REGIONS_SQL,
    ),
)
def drawing_boxes(spark: SparkSession, folder: str) -> DataFrame:
    corners = "inline(array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y1)))"
    points = page_regions(spark, folder).selectExpr("doc_id", "page", "region_id % 2 as drawing_id", corners)
    boxes = G.drawing_boxes(points)
    return boxes.select("doc_id", "page", "drawing_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "f39_search_urls_format_hash",
    """select page_id, concat('https://www.google.com/searchbyimage?image_url=', url_encode(url)) as google,
         concat('https://www.bing.com/images/search?view=detailv2&iss=sbi&form=SBIVSP&sbisrc=UrlPaste&q=imgurl:', url_encode(url)) as bing,
         case when page_id % 7 = 0 then '' when page_id % 2 = 0 then left(md5(url), 8) else concat(left(md5(url), 16), '...') end as shown
       from pages""",
)
def search_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = B.table(spark, folder, "pages").selectExpr(
        "page_id", "url", "case when page_id % 7 = 0 then null when page_id % 2 = 0 then left(md5(url), 8) else md5(url) end as hash"
    )
    return pages.select("page_id", H.search_urls(F.col("url")).alias("u"), H.format_hash(F.col("hash")).alias("shown")).select(
        "page_id", "u.google", "u.bing", "shown"
    )


@query(
    "f40_client_key",
    """select event_id, case when event_id % 4 = 0 then concat('10.0.0.', user_id % 256) when event_id % 4 = 1 then concat('10.1.0.', user_id % 256)
         when event_id % 4 = 2 then concat('10.2.0.', user_id % 256) else 'local' end as client_key from events""",
)
def client_key(spark: SparkSession, folder: str) -> DataFrame:
    headers = """map('x-forwarded-for', if(event_id % 4 = 0, concat(' 10.0.0.', user_id % 256, ' , 1.1.1.1'), ''),
        'x-real-ip', if(event_id % 4 = 1, concat('10.1.0.', user_id % 256, ' '), null),
        'cf-connecting-ip', if(event_id % 4 in (0, 1, 2), concat('10.2.0.', user_id % 256), ''))"""
    events = B.table(spark, folder, "events").selectExpr("event_id", f"{headers} as headers")
    return events.select("event_id", H.client_key(F.col("headers")).alias("client_key"))


@query(
    "f41_rect_distance",
    with_views(
        ["papers_v"],
        """select a.doc_id, a.page, round(max(sqrt(greatest(0.0, a.x0 - b.x1, b.x0 - a.x1) ** 2 + greatest(0.0, a.y0 - b.y1, b.y0 - a.y1) ** 2)), 6) as widest
           from regions a join regions b on a.doc_id = b.doc_id and a.page < b.page group by a.doc_id, a.page""",
        REGIONS_SQL,
    ),
)
def rect_distance(spark: SparkSession, folder: str) -> DataFrame:
    """How far the farthest box of a later page is from a box of the page, in page coordinates."""
    a, b = page_regions(spark, folder).alias("a"), page_regions(spark, folder).alias("b")
    both = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") < F.col("b.page")))
    gap = H.rect_distance(*[{c: F.col(f"{side}.{c}") for c in ("x0", "y0", "x1", "y1")} for side in "ab"])
    return both.groupBy("a.doc_id", "a.page").agg(F.round(F.max(gap), 6).alias("widest"))


@query(
    "s4_load_catalogue",
    with_views(["papers_v"], "select title, year, count(*) as n from papers_v group by all"),
)
def load_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Papers written as records of a catalogue and loaded again."""
    from ..functions.scale import shared_folder

    record = "to_json(named_struct('paperId', concat('S', paper_id), 'title', title, 'year', year)) as value"
    landed = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    B.papers_v(spark, folder).selectExpr(record).write.text(landed)
    return C.load_catalogue(spark, landed, "semantic").groupBy("title", "year").agg(F.count(F.lit(1)).alias("n"))
