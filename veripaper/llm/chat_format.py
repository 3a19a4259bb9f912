"""Conversations from messages that quote each other, in DataFrame functions only.

Quoted lines start with one ``>`` for each level. Neighbouring lines of a level are a passage; passages and
their single lines are normalised, hashed and joined to the messages of the same conversation that first
wrote them. A message replies to the one that most of what it quotes comes from. Messages lose their
quotations and are put into reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, written

#: The marks in front of a quoted line, and a quoted line as a whole.
MARKS = "^(?:[ \\t]*>)+"
QUOTED_LINE = "(?<![^\\n])[ \\t]*>[^\\n]*\\n?"
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Turns that are searched together for the latest earlier one.
TURNS = 1000


def normalized(text: Column) -> Column:
    """Lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(text, BLANKS, " ")))


def _lines(messages: DataFrame) -> DataFrame:
    """``conv, turn, line, level, body`` of every line."""
    lines = messages.select("conv", "turn", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    marks = F.regexp_extract("raw", MARKS, 0)
    return lines.select(
        "conv", "turn", "line",
        F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
        normalized(F.regexp_replace("raw", MARKS, "")).alias("body"),
    )


def _units(lines: DataFrame) -> DataFrame:
    """``conv, turn, level, hash, size``: each passage (up to a blank line or another level) and each line, once."""
    order = Window.partitionBy("conv", "turn").orderBy("line")
    starts = (F.col("body") == "") | (F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level"))
    runs = lines.withColumn("_start", starts.cast("int")).withColumn("run", F.sum("_start").over(order)).where("body <> ''")
    passages = runs.groupBy("conv", "turn", "level", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), " ").alias("body")
    )
    both = passages.select("conv", "turn", "level", "body").unionByName(runs.select("conv", "turn", "level", "body"))
    return both.select(
        "conv", "turn", "level", F.sha2("body", 256).alias("hash"), F.length("body").cast("long").alias("size")
    ).distinct()


def _origins(units: DataFrame) -> DataFrame:
    """``conv, turn, level, size, origin`` for each quoted unit that an earlier turn of the conversation wrote.

    The origin is the latest such turn. Turns are searched in blocks, and blocks by what their last
    origin is, so that a line which fills a conversation does not meet in one task.
    """
    marked = units.select(
        "*",
        F.floor(F.col("turn") / TURNS).alias("block"),
        F.when(F.col("level") == 0, F.col("turn")).alias("wrote"),
    )
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("conv", "hash", "block").agg(F.max("wrote").alias("last"))
    across = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv", "hash", "block", F.max("last").over(across).alias("earlier"))
    near = marked.withColumn("near", F.max("wrote").over(inside)).where("level > 0")
    found = near.join(before, ["conv", "hash", "block"]).withColumn("origin", F.coalesce("near", "earlier"))
    return found.where("origin is not null").select("conv", "turn", "level", "size", "origin")


def _threads(replies: DataFrame) -> DataFrame:
    """``conv, turn, root, depth`` of every reply, each round following twice as many steps."""
    paths = cut(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = paths.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        if paths.join(up, ["conv", "root"], "left_semi").isEmpty():
            return paths
        paths = cut(
            paths.join(up, ["conv", "root"], "left").select(
                "conv", "turn", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )


def format_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``messages``: ``conv_id, turn, role, reply_to, thread, depth, n_quotes, n_linked, message``.

    ``reply_to`` is the turn that wrote most of what a message quotes (characters of passages and lines at
    the lowest level that has any origin; of equals the later turn), null where nothing it quotes is known.
    ``thread`` is the turn at the head of its replies and ``depth`` how many replies lead there; ordered by
    (thread, turn) a conversation has every message behind the one it replies to. ``n_quotes`` and
    ``n_linked`` count the quoted passages and lines, and those with an origin. ``message`` is the text
    without quoted lines and outer white space.

    A null text is empty; a row without conversation or turn replies to nothing; rows that repeat a
    conversation and turn are one message and get the same links each. Other columns are ignored. An
    empty table gives no rows; texts are taken whole, however long.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    placed = rows.where("conv is not null and turn is not null").select("conv", "turn", "text")
    quoting = placed.where(F.col("text").rlike(QUOTED_LINE)).select("conv").distinct()
    units = written(_units(_lines(placed.join(quoting, "conv", "left_semi").distinct())))
    origins = written(_origins(units))
    by_origin = origins.groupBy("conv", "turn", "level", "origin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    replies = by_origin.groupBy("conv", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), F.col("size"), F.col("origin"))).alias("reply_to"), F.sum("n").alias("n_linked")
    )
    replies = cut(replies)
    quotes = units.where("level > 0").groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quotes"))
    known = quotes.join(replies, ["conv", "turn"], "left").join(_threads(replies), ["conv", "turn"], "left")
    outer = f"^{BLANKS}|{BLANKS}$"
    return rows.join(known, ["conv", "turn"], "left").select(
        F.col("conv").alias("conv_id"), "turn", "role", "reply_to", F.coalesce("root", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.regexp_replace(F.regexp_replace("text", QUOTED_LINE, ""), outer, "").alias("message"),
    )


def with_quotations(messages: DataFrame) -> DataFrame:
    """``messages`` as mail clients would send them: every turn quotes the one before, every third also the one before that."""
    plain = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def earlier(by: int, name: str) -> DataFrame:
        return plain.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("text").alias(name))

    def quoted(column: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(column, "\n", "\n" + mark), F.lit("\n"))

    both = plain.join(earlier(1, "one"), ["conv_id", "turn"], "left").join(earlier(2, "two"), ["conv_id", "turn"], "left")
    nested = F.when(F.col("turn") % 3 == 2, quoted("two", "> > "))
    text = F.concat(F.coalesce(nested, F.lit("")), F.coalesce(quoted("one", "> "), F.lit("")), F.col("text"))
    return both.select("conv_id", "turn", "role", text.alias("text"))
