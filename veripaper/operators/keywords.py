"""Keywords of recognized texts, search queries from them, and scoring of search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as P
from ..functions.text import contains_any, let, strip
from .listing import dedup_ci, first_per_key


def _found(text: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) for pattern in P.KEYWORD_PATTERNS])


def _spelling(word: Column) -> Column:
    """Acronyms and capitalized words keep their case, all others are lowered."""
    upper = F.rlike(word, F.lit(r"\p{Lu}")) & ~F.rlike(word, F.lit(r"\p{Ll}"))
    capital = F.rlike(word, F.lit(r"^\p{Lu}")) & (F.length(word) > 2)
    return F.when(upper | capital, word).otherwise(F.lower(word))


def extract_keywords(texts: DataFrame) -> DataFrame:
    """``(image_id, rank, keyword)``: all distinct keywords of every text, the longest first.

    Words, numbers, versions, quotes and names in the order of their patterns; the first spelling
    of a keyword wins. One-letter words and stop words are left out.
    """
    raw = texts.select("image_id", F.posexplode(_found(F.col("ocr_text"))).alias("pos", "word"))
    words = raw.where(
        (F.length("word") >= 2) & ~F.lower("word").isin(P.STOP_WORDS) & (strip(F.col("word")) != "")
    ).select("image_id", "pos", strip(F.col("word")).alias("keyword"))
    distinct = dedup_ci(words, ["image_id"], "keyword", "pos").select(
        "image_id", _spelling(F.col("keyword")).alias("keyword")
    )
    return ranked_keywords(distinct)


def ranked_keywords(keywords: DataFrame) -> DataFrame:
    """Keywords per image from the longest on, equal lengths in order of their lower-cased text."""
    order = W.partitionBy("image_id").orderBy(F.desc(F.length("keyword")), F.lower("keyword"))
    return keywords.select("image_id", F.row_number().over(order).alias("rank"), "keyword")


def top_keywords(keywords: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` longest keywords per image."""
    return ranked_keywords(keywords).where(F.col("rank") <= k)


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """Ranked keywords as one array per image, which its text bounds."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    return keywords.groupBy("image_id").agg(F.transform(ranked, lambda s: s["keyword"]).alias("keywords"))


def build_queries(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``(image_id, pos, query)``: all search queries of a text, in order of strategy.

    Each keyword with two endings, each with the next two keywords, terms of architectures with three
    endings, named blocks, sizes with such terms; the whole text where there is no keyword.
    """
    rows = texts.join(keyword_lists(keywords), "image_id", "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>"))
    )
    words, text = F.col("keywords"), F.col("ocr_text")

    def ended(terms: Column, *endings: str) -> Column:
        return F.flatten(F.transform(terms, lambda w: F.array(*[F.concat(w, F.lit(e)) for e in endings])))

    pairs = F.flatten(
        F.transform(
            words,
            lambda w, i: F.array_compact(
                F.array(*[F.concat(w, F.lit(" "), F.get(words, i + step)) for step in (1, 2)])
            ),
        )
    )
    architecture = F.filter(words, lambda w: contains_any(w, P.ARCHITECTURE_TERMS))
    named = F.regexp_extract_all(text, F.lit(P.QUERY_PHRASES[0]), F.lit(1))
    naming = F.transform(
        F.regexp_extract_all(text, F.lit(P.QUERY_PHRASES[1]), F.lit(1)),
        lambda q: F.regexp_replace(q, r"^(\w+)\s+", "$1 "),
    )
    sizes = F.filter(words, lambda w: F.contains(F.lower(w), F.lit("x")) | F.contains(w, F.lit("×")))
    sized = F.flatten(
        F.transform(sizes, lambda s: F.transform(architecture, lambda a: F.concat(a, F.lit(" "), s)))
    )
    made = F.concat(
        ended(words, " diagram", " architecture"), pairs,
        ended(architecture, " architecture", " diagram", " neural network"), named, naming, sized,
    )
    whole = F.array_compact(F.array(F.nullif(strip(text), F.lit(""))))
    queries = F.when(F.size(words) == 0, whole).otherwise(made)
    listed = rows.select("image_id", F.posexplode(queries).alias("pos", "query")).select(
        "image_id", "pos", strip(F.col("query")).alias("query")
    )
    return dedup_ci(listed.where(F.length("query") >= 3), ["image_id"], "query", "pos")


def top_queries(queries: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` queries per image in the order they were made."""
    order = W.partitionBy("image_id").orderBy("pos")
    return queries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def first_seen_url(hits: DataFrame) -> DataFrame:
    """First occurrence of every address per search, by call and position; blank ones are left out."""
    return first_per_key(hits.where("url <> ''"), ["image_id", "url"], ["call", "pos"])


def filter_hits(hits: DataFrame) -> DataFrame:
    """Hits that point to papers, code or data, or whose title promises a diagram."""
    return hits.where(
        contains_any(F.col("url"), P.HIT_URL_MARKS) | contains_any(F.coalesce("title", F.lit("")), P.HIT_TITLE_MARKS)
    )


def score_hits(hits: DataFrame, keywords: DataFrame, texts: DataFrame, above: float = 0.3) -> DataFrame:
    """Confidence and reason per hit: 0.6 share of keywords found + 0.4 share of text words found."""
    ocr_words = F.array_distinct(F.filter(F.split(F.lower("ocr_text"), r"\s+"), lambda w: w != ""))
    known = keyword_lists(keywords).join(texts.select("image_id", ocr_words.alias("ocr_words")), "image_id")
    combined = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("snippet", F.lit(""))))
    rows = hits.join(known, "image_id").withColumn("combined", combined)
    # Bound as one value: a filter on it may move into the join, where inner lambdas must not
    # reach for columns of the other side.
    matched = let(
        F.struct("keywords", "combined"),
        lambda s: F.filter(s["keywords"], lambda w: F.contains(s["combined"], F.lower(w))),
    )
    found = rows.withColumn("matched", matched)
    keyword_share = F.size("matched") / F.greatest(F.size("keywords"), F.lit(1))
    common = F.size(F.array_intersect("ocr_words", F.split("combined", r"\s+")))
    word_share = common / F.greatest(F.size("ocr_words"), F.lit(1))
    scored = found.withColumn("confidence", keyword_share * 0.6 + word_share * 0.4).where(F.col("confidence") > above)
    reason = F.when(
        F.size("matched") > 0, F.concat(F.lit("Keywords matched: "), F.array_join("matched", ", "))
    ).otherwise("Contextual match")
    return scored.select(*hits.columns, F.bround("confidence", 2).alias("confidence"), reason.alias("reason"))


def top_hits(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most confident hits per image; equal ones in search order."""
    order = W.partitionBy("image_id").orderBy(F.desc("confidence"), "call", "pos", "url")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def outbound_links(
    pages: DataFrame, own_hosts: list[str] | None = None, min_text: int = 4, whole_url: bool = False
) -> DataFrame:
    """``(page_id, pos, url, title)``: links of stored result pages that leave the engine and have a text.

    With ``whole_url`` an engine's name anywhere in the address counts, not only in its host.
    """
    hosts = P.OWN_ENGINE_HOSTS if own_hosts is None else own_hosts
    link = r'(?s)<a [^>]*href="([^"]*http[^"]*)"[^>]*>(.*?)</a>'
    urls = F.regexp_extract_all("html", F.lit(link), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(link), F.lit(2))
    pairs = F.zip_with(
        urls,
        texts,
        lambda u, t: F.struct(u.alias("url"), strip(F.regexp_replace(t, "<[^>]*>", "")).alias("title")),
    )

    def leaves(link: Column) -> Column:
        host = link["url"] if whole_url else F.regexp_extract(link["url"], r"^[a-z]+://([^/?#]*)", 1)
        own = [F.contains(host, F.lit(h)) for h in hosts]
        outside = ~own[0]
        for other in own[1:]:
            outside = outside & ~other
        return outside & (F.length(link["title"]) >= min_text)

    found = pages.select("page_id", F.posexplode(F.filter(pairs, leaves)).alias("pos", "link"))
    return found.select("page_id", "pos", "link.url", "link.title")


def similar_images(pages: DataFrame, own_host: str | None = None) -> DataFrame:
    """``(page_id, n_images, found, urls)``: image addresses among the images of a page."""
    sources = F.regexp_extract_all("html", F.lit(r'<img [^>]*src="([^"]*)"'), F.lit(1))
    usable = F.filter(
        sources,
        lambda u: F.startswith(u, F.lit("http")) & (F.lit(True) if own_host is None else ~F.contains(u, F.lit(own_host))),
    )
    return pages.select("page_id", usable.alias("urls")).select(
        "page_id", F.size("urls").alias("n_images"), (F.size("urls") > 0).alias("found"), "urls"
    )
