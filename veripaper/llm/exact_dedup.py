"""Exact deduplication by a content sort, in DataFrame functions only.

Sampled splitters cut the order of (content, spread) into ranges, where the spread is a hash of the
identifier: a content that fills many rows is itself cut into several ranges. Spark's external sort
puts equal contents of a range side by side; comparing each with its neighbour in full marks where a
new content starts. Only contents that a splitter may have cut are put together across ranges, one
row for each range and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Characters deleted before texts are compared.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Splitters hold this many characters of content; rows with the same ones are dealt by the spread.
SPLITTER_CHARS = 64
#: Rows a range should hold, ranges at most, and sampled rows for each range.
RANGE_ROWS, MAX_RANGES, SAMPLED = 4096, 1 << 14, 8
LAST = (1 << 63) - 1


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _splitters(rows: DataFrame) -> list[tuple[str, int]]:
    """At most ``MAX_RANGES - 1`` splitters from a sample of at most ``MAX_RANGES * SAMPLED`` rows, about.

    The sample is chosen by a hash of the spread, so that a repeated task samples the same rows.
    """
    n_rows = rows.count()
    n_ranges = min(MAX_RANGES, -(-n_rows // RANGE_ROWS))
    if n_ranges <= 1:
        return []
    wanted = n_ranges * SAMPLED
    share = max(1, n_rows // wanted)
    sampled = (
        rows.where(F.pmod(F.xxhash64("_spread", F.lit(7)), F.lit(share)) == 0)
        .select(F.substring(normalized(F.col("_text")), 1, SPLITTER_CHARS).alias("head"), "_spread")
        .limit(4 * wanted)
        .collect()
    )
    sample = sorted((row["head"].encode(), row["_spread"]) for row in sampled)
    step = max(1, len(sample) // n_ranges)
    return [(head.decode(), spread) for head, spread in sample[step::step]]


def _range_of(splitters: list[tuple[str, int]]) -> Column:
    """How many splitters stand at or before (first characters of the content, spread): a binary search."""
    if not splitters:
        return F.lit(0)
    key = F.struct(F.col("_head").alias("h"), F.col("_spread").alias("s"))
    bounds = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(s).alias("s")) for h, s in splitters])
    steps = [F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at),
    )


def _head(text: Column) -> Column:
    """The first characters of the content; most texts need not be read to their end for them."""
    start = normalized(F.substring(text, 1, 4 * SPLITTER_CHARS))
    enough = (F.char_length(start) >= SPLITTER_CHARS) | (F.char_length(text) <= 4 * SPLITTER_CHARS)
    return F.substring(F.when(F.coalesce(enough, F.lit(True)), start).otherwise(normalized(text)), 1, SPLITTER_CHARS)


def _decisions(local: DataFrame, carried: list[str]) -> DataFrame:
    own = {"doc_id": "_id", "keep_id": "_best", "group_size": "_size", "kept": "_new"}
    return local.select(*[F.col(c).alias(n) for n, c in own.items()], *carried)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without ASCII white space; of equal ones the row with the
    most code points, then the smallest identifier stays. A null text is empty (all empty texts are
    equal), a null identifier comes after all others, and of rows that agree in everything exactly
    one stays. Other columns are ignored, whatever their names; with ``carry`` they come along as the
    struct ``row``. An empty table gives no rows. Texts are compared whole, however long.

    Each row is shuffled once, as it was read; what is derived from its text is derived behind that.
    """
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.struct(text.alias("_text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), row.alias("row")).withColumn(
        "_spread", F.xxhash64(F.coalesce("_id", F.lit(LAST)))
    )
    text = F.col("row")[text_col if carry else "_text"]
    splitters = _splitters(rows.withColumn("_text", text))
    edges = sorted({head for head, _ in splitters})
    ranged = rows.withColumn("_head", _head(text)).withColumn("_range", _range_of(splitters))
    ranged = ranged.withColumn("_cut", F.col("_head").isin(edges) if edges else F.lit(False)).drop("_head", "_spread")
    content = ranged.repartition("_range").select(
        "_id", "row", "_range", "_cut", F.coalesce(F.char_length(text), F.lit(0)).alias("_length"), normalized(text).alias("_content")
    )
    order = Window.partitionBy("_range").orderBy("_content", F.desc("_length"), F.asc_nulls_last("_id"))
    before = F.lag("_content").over(order)
    sorted_rows = content.withColumn("_new", before.isNull() | (before != F.col("_content")))
    grouped = sorted_rows.select(
        "_id",
        "_length",
        "_range",
        "_cut",
        "_new",
        F.when(F.col("_new") & F.col("_cut"), F.col("_content")).alias("_whole"),
        F.sha2(F.col("_content"), 256).alias("text_sha256"),
        F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_group"),
        *["row"] * carry,
    )
    same = Window.partitionBy("_range", "_group")
    local = grouped.withColumn("_size", F.count(F.lit(1)).over(same)).withColumn(
        "_best", F.max(F.when(F.col("_new"), F.struct("_id"))).over(same)["_id"]
    )
    carried = ["text_sha256", *["row"] * carry]
    if not edges:
        return _decisions(local, carried)
    # Each range's decisions, written once; only contents that a splitter may have cut are looked at again.
    local = written(local)
    heads = local.where(F.col("_cut") & F.col("_new")).select("_whole", "_range", "_group", "_size", "_length", "_id")
    best = F.max_by(
        F.struct("_id", "_range"),
        F.struct("_length", -F.coalesce("_id", F.lit(LAST)), -F.col("_range")),
    )
    joined_up = (
        heads.groupBy("_whole")
        .agg(F.sum("_size").alias("_all"), best.alias("_winner"), F.collect_set(F.struct("_range", "_group")).alias("_parts"))
        .where(F.size("_parts") > 1)
        .select("_all", "_winner", F.explode("_parts").alias("_part"))
        .select("_all", "_winner", F.col("_part._range").alias("_r"), F.col("_part._group").alias("_g"))
    )
    done = local.where(~F.col("_cut"))
    parts = local.where("_cut").join(joined_up, (F.col("_range") == F.col("_r")) & (F.col("_group") == F.col("_g")), "left")
    elsewhere = F.col("_r").isNotNull()
    stitched = parts.select(
        F.col("_id").alias("doc_id"),
        F.when(elsewhere, F.col("_winner._id")).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        F.when(elsewhere, F.col("_new") & (F.col("_range") == F.col("_winner._range"))).otherwise(F.col("_new")).alias("kept"),
        *carried,
    )
    return _decisions(done, carried).unionByName(stitched)
