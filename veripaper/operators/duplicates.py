"""Duplicate papers: exact DOI, exact trigram-similarity join, keep-first deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..functions.text import blank, trigrams
from .similar_sets import similar_sets

CANDIDATE_SIMILARITY = 0.7
DUPLICATE_SIMILARITY = 0.8


def _age(table: str | None = None) -> Column:
    """Order of originality: earlier first, then smaller id."""
    prefix = f"{table}." if table else ""
    return F.struct(
        F.col(f"{prefix}created_at").alias("created_at"), F.col(f"{prefix}paper_id").alias("paper_id")
    )


def _with_age(papers: DataFrame) -> DataFrame:
    if "created_at" in papers.columns:
        return papers
    return papers.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))


def _keyed_titles(papers: DataFrame, *others: str) -> DataFrame:
    """Papers with the 3-grams of their title put together and the key of this set, both null where there are none.

    Written once: finding the 3-grams takes longer than reading them.
    """
    grams = F.nullif(F.array_join(trigrams(F.col("title")), ""), F.lit(""))
    rows = _with_age(papers).select("paper_id", _age().alias("age"), *others, grams.alias("grams"))
    return cut_lineage(rows.withColumn("set", F.unhex(F.md5("grams"))))


def _distinct_sets(keyed: DataFrame) -> DataFrame:
    """One row per distinct set: its key, its earliest paper and its 3-grams.

    Exact copies of a title, however many, are one row from here on.
    """
    rows = keyed.where("set is not null").groupBy("set").agg(F.min("age").alias("first"), F.first("grams").alias("grams"))
    return cut_lineage(rows)


def title_sets(papers: DataFrame) -> DataFrame:
    """One row per distinct set of 3-grams of a title, as ``set, first, grams``."""
    return _distinct_sets(_keyed_titles(papers))


def _best_set(pairs: DataFrame) -> DataFrame:
    """Per left set the best score, among equals the earliest paper."""
    best = pairs.groupBy("l_set").agg(F.min(F.struct((-F.col("score")).alias("minus_score"), "r_first")).alias("best"))
    return best.select(
        F.col("l_set").alias("set"),
        F.col("best.r_first.paper_id").alias("similar_paper_id"),
        (-F.col("best.minus_score")).alias("similarity"),
    )


def duplicate_by_title(
    new: DataFrame,
    papers: DataFrame,
    candidate: float = CANDIDATE_SIMILARITY,
    duplicate: float = DUPLICATE_SIMILARITY,
) -> DataFrame:
    """Most similar stored title of every new paper that has one above ``candidate``.

    The ids of the new papers are not among the stored ones; for papers that are stored
    themselves use :func:`duplicate_titles_within`.
    """
    return _most_similar(_keyed_titles(new), papers, candidate, duplicate)


def _most_similar(keyed: DataFrame, papers: DataFrame, candidate: float, duplicate: float) -> DataFrame:
    stored = _distinct_sets(_keyed_titles(papers))
    best = _best_set(similar_sets(_distinct_sets(keyed), stored, candidate, "best"))
    return (
        keyed.select("paper_id", "set")
        .join(best, "set")
        .withColumn("is_duplicate", F.col("similarity") > duplicate)
        .select("paper_id", "similar_paper_id", "similarity", "is_duplicate")
    )


def duplicate_titles_within(
    papers: DataFrame,
    candidate: float = CANDIDATE_SIMILARITY,
    duplicate: float = DUPLICATE_SIMILARITY,
) -> DataFrame:
    """Most similar earlier title of every stored paper that has one above ``candidate``.

    Earlier means smaller (created_at, paper_id). A paper whose trigram set occurred before is a
    copy of its first holder, so that only first holders take part in the similarity join.
    """
    keyed = _keyed_titles(papers)
    sets = _distinct_sets(keyed)
    best = _best_set(similar_sets(sets, sets, candidate, "best"))
    matched = keyed.select("paper_id", "set").join(sets.select("set", "first").join(best, "set", "left"), "set")
    copy = F.col("paper_id") != F.col("first.paper_id")
    return (
        matched.select(
            "paper_id",
            F.when(copy, F.col("first.paper_id")).otherwise(F.col("similar_paper_id")).alias("similar_paper_id"),
            F.when(copy, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
        )
        .where(F.col("similar_paper_id").isNotNull())
        .withColumn("is_duplicate", F.col("similarity") > duplicate)
    )


def duplicate_by_doi(new: DataFrame, papers: DataFrame, earlier_only: bool = False) -> DataFrame:
    """Earliest stored paper with the same DOI, score 1. Never the paper itself."""
    new = _with_age(new)
    stored = (
        _with_age(papers)
        .where(~blank(F.col("doi")))
        .groupBy("doi")
        .agg(F.min(_age()).alias("first"))
    )
    joined = new.join(stored, "doi").where(F.col("first.paper_id") != F.col("paper_id"))
    if earlier_only:
        joined = joined.where(F.col("first") < _age())
    return joined.select(
        "paper_id",
        F.col("first.paper_id").alias("similar_paper_id"),
        F.lit(1.0).alias("similarity"),
        F.lit(True).alias("is_duplicate"),
    )


def duplicates_within(papers: DataFrame) -> DataFrame:
    """Per paper the earlier paper it repeats: by DOI, else by title above the duplicate bound."""
    by_doi = duplicate_by_doi(papers, papers, earlier_only=True)
    by_title = duplicate_titles_within(papers).where("is_duplicate")
    return by_doi.unionByName(by_title.join(by_doi, "paper_id", "left_anti"))


def similar_title_edges(papers: DataFrame, threshold: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """Edges (paper_id, earlier_id, similarity) between the first holders of similar titles."""
    return similar_set_edges(title_sets(papers), threshold)


def similar_set_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """The same between the rows of :func:`title_sets`."""
    pairs = similar_sets(sets, sets, threshold, "earlier")
    # Pairs may be far more than sets, which Spark's estimates do not see: joined by sorting, never broadcast.
    for side, name in (("l_set", "paper_id"), ("r_set", "earlier_id")):
        holders = sets.select(F.col("set").alias(side), F.col("first.paper_id").alias(name))
        pairs = pairs.join(holders.hint("merge"), side)
    return pairs.select("paper_id", "earlier_id", F.col("score").alias("similarity"))


def greedy_dedup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep-first deduplication: ``(paper_id, kept)``.

    A node is dropped when an earlier kept node is its neighbour. ``edges`` point from a node
    (``paper_id``) to an earlier one (``earlier_id``). Each round decides every node whose earlier
    neighbours are all decided, and drops every node with a kept earlier neighbour; a round is cut
    off by a checkpoint. Nodes without edges never take part.
    """
    spark = nodes.sparkSession
    open_edges = cut_lineage(edges.select("paper_id", "earlier_id").distinct())
    decided_parts: list[DataFrame] = []
    heads = open_edges.select(F.col("earlier_id").alias("paper_id")).distinct()
    # Neighbours that are earlier than all of theirs are kept at once.
    fresh_kept = cut_lineage(
        heads.join(open_edges.select("paper_id").distinct(), "paper_id", "left_anti")
    )
    decided_parts.append(fresh_kept.withColumn("kept", F.lit(True)))
    while not open_edges.isEmpty():
        dropped = cut_lineage(
            open_edges.join(fresh_kept.withColumnRenamed("paper_id", "earlier_id"), "earlier_id", "left_semi")
            .select("paper_id")
            .distinct()
        )
        decided_parts.append(dropped.withColumn("kept", F.lit(False)))
        remaining = open_edges.join(dropped, "paper_id", "left_anti")
        left_to_decide = remaining.select("paper_id").distinct()
        remaining = remaining.join(
            dropped.withColumnRenamed("paper_id", "earlier_id"), "earlier_id", "left_anti"
        )
        remaining = cut_lineage(remaining.select("paper_id", "earlier_id"))
        fresh_kept = cut_lineage(
            left_to_decide.join(remaining.select("paper_id").distinct(), "paper_id", "left_anti")
        )
        decided_parts.append(fresh_kept.withColumn("kept", F.lit(True)))
        open_edges = remaining
    decided = spark.createDataFrame([], decided_parts[0].schema)
    for part in decided_parts:
        decided = decided.unionByName(part)
    return nodes.select("paper_id").join(decided, "paper_id", "left").select(
        "paper_id", F.coalesce("kept", F.lit(True)).alias("kept")
    )


def _keep_first(rows: DataFrame, set_edges: DataFrame) -> DataFrame:
    """Rows that a sequential pass keeps: no earlier kept row shares the DOI or a similar title.

    ``rows`` are (age, set, doi), one per (set, doi); ``set_edges`` are similar sets in both
    directions, worked out once by the caller. A round keeps every row that is the earliest left of its DOI, its set and all
    similar sets, and drops what those repeat; only minima per group are exchanged, never pairs
    of rows.
    """
    left = cut_lineage(rows)
    edges = set_edges
    kept_parts = []
    while not left.isEmpty():
        of_set = left.where("set is not null").groupBy("set").agg(F.min("age").alias("set_first"))
        of_doi = left.where("doi is not null").groupBy("doi").agg(F.min("age").alias("doi_first"))
        around = (
            edges.join(of_set.withColumnRenamed("set", "other"), "other")
            .groupBy("set")
            .agg(F.min("set_first").alias("around_first"))
        )
        kept = cut_lineage(
            left.join(of_set, "set", "left")
            .join(of_doi, "doi", "left")
            .join(around, "set", "left")
            .where(
                (F.col("set_first").isNull() | (F.col("age") == F.col("set_first")))
                & (F.col("doi_first").isNull() | (F.col("age") == F.col("doi_first")))
                & (F.col("around_first").isNull() | (F.col("age") < F.col("around_first")))
            )
            .select("age", "set", "doi")
        )
        kept_parts.append(kept)
        kept_sets = kept.where("set is not null").select("set").distinct()
        near_kept = edges.join(kept_sets.withColumnRenamed("set", "other"), "other", "left_semi")
        covered_sets = kept_sets.union(near_kept.select("set")).distinct()
        left = cut_lineage(
            left.join(kept.select("age"), "age", "left_anti")
            .join(covered_sets, "set", "left_anti")
            .join(kept.where("doi is not null").select("doi"), "doi", "left_anti")
            .select("age", "set", "doi")
        )
    if not kept_parts:
        return left
    return reduce(DataFrame.union, kept_parts)


def import_papers(papers: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sequential import: each incoming row against the stored rows and the rows kept before it.

    Returns ``paper_id, imported, reason, similar_paper_id``; rows come in order of
    (created_at, paper_id).
    """
    keyed = _keyed_titles(incoming.withColumn("doi", F.nullif(F.col("doi"), F.lit(""))), "doi")
    stored = duplicate_by_doi(incoming, papers)
    # Only titles above the duplicate bound count here, so nothing less alike is looked for.
    by_title = _most_similar(keyed, papers, DUPLICATE_SIMILARITY, DUPLICATE_SIMILARITY)
    stored = cut_lineage(
        stored.unionByName(by_title.join(stored, "paper_id", "left_anti")).select("paper_id", "similar_paper_id")
    )
    new = keyed.join(stored, "paper_id", "left_anti")
    rows = new.groupBy("set", "doi").agg(F.min("age").alias("age")).select("age", "set", "doi")
    sets = _distinct_sets(new)
    set_edges = similar_sets(sets, sets, DUPLICATE_SIMILARITY, "both").select(
        F.col("l_set").alias("set"), F.col("r_set").alias("other"), "score"
    )
    set_edges = cut_lineage(set_edges)
    kept = cut_lineage(_keep_first(rows, set_edges.select("set", "other")))

    dropped = new.join(kept.select("age"), "age", "left_anti")
    kept_by_doi = kept.where("doi is not null").select("doi", F.col("age").alias("by_doi"))
    kept_sets = kept.where("set is not null").select("set", F.col("age").alias("kept_age"))
    reach = kept_sets.select("set", "kept_age", F.lit(1.0).alias("score")).union(
        set_edges.join(kept_sets.withColumnRenamed("set", "other"), "other").select("set", "kept_age", "score")
    )
    by_set = (
        dropped.join(reach, "set")
        .where("kept_age < age")
        .groupBy("paper_id")
        .agg(F.min(F.struct((-F.col("score")).alias("minus_score"), "kept_age")).alias("best"))
        .select("paper_id", F.col("best.kept_age").alias("by_set"))
    )
    earlier_doi = F.when(F.col("by_doi") < F.col("age"), F.col("by_doi"))
    within = (
        dropped.join(kept_by_doi, "doi", "left")
        .join(by_set, "paper_id", "left")
        .select("paper_id", F.coalesce(earlier_doi, F.col("by_set"))["paper_id"].alias("similar_paper_id"))
    )
    skipped = stored.unionByName(within)
    return (
        incoming.select("paper_id")
        .join(skipped, "paper_id", "left")
        .select(
            "paper_id",
            F.col("similar_paper_id").isNull().alias("imported"),
            F.when(F.col("similar_paper_id").isNotNull(), F.lit("Duplicate detected")).alias("reason"),
            "similar_paper_id",
        )
    )
