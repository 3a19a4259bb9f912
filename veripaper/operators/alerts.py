"""Alerts: raised from decisions, checked, marked, and shaped for channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SEVERITY_COLOURS


def _alert(type_: Column | str, severity: str, title: Column, message: Column, *keys: str) -> list[Column]:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return [kind.alias("type"), F.lit(severity).alias("severity"), title.alias("title"), message.alias("message"),
            *[F.col(k) for k in keys]]


def status_alerts(papers: DataFrame) -> DataFrame:
    """An INFO alert per validated paper, a WARNING with the reasons per rejected one."""
    title = F.col("title")
    done = papers.where("status = 'VALIDATED'").select(
        *_alert(
            "PAPER_VALIDATED", "INFO", F.concat(F.lit("Paper Validated: "), title),
            F.concat(F.lit('Paper "'), title, F.lit('" has been validated successfully.')), "paper_id",
        )
    )
    refused = papers.where("status = 'REJECTED'").select(
        *_alert(
            "PAPER_REJECTED", "WARNING", F.concat(F.lit("Paper Rejected: "), title),
            F.concat(F.lit('Paper "'), title, F.lit('" was rejected. Reasons: '), F.col("validation_notes")), "paper_id",
        )
    )
    return done.unionByName(refused)


def invalid_reference_alerts(refs: DataFrame) -> DataFrame:
    """A WARNING per INVALID reference with its text; reads ``paper_title``."""
    return refs.where("status = 'INVALID'").select(
        *_alert(
            "INVALID_REFERENCE", "WARNING", F.concat(F.lit("Invalid Reference in Paper: "), F.col("paper_title")),
            F.concat(F.lit("Reference #"), F.col("ord"), F.lit(" could not be verified: "),
                     F.col("raw_text")),
            "paper_id", "ord",
        )
    )


def suspicion_alerts(diagrams: DataFrame) -> DataFrame:
    """A WARNING per suspicious diagram; web sources are named before the local match.

    Reads ``diagram_id, paper_id, paper_title, order, page, is_suspicious, n_web, similarity_score,
    matched_diagram_id``.
    """
    reason = (
        F.when(
            F.col("n_web") > 0,
            F.concat(F.lit("Found "), F.col("n_web"), F.lit(" similar image(s) on the web using Bing Visual Search.")),
        )
        .when(
            F.col("matched_diagram_id").isNotNull(),
            F.format_string(
                "Appears similar to an existing diagram in the database (similarity: %.1f%%).",
                F.col("similarity_score") * 100,
            ),
        )
        .otherwise("")
    )
    message = F.concat(
        F.lit("Diagram #"), F.col("order"), F.lit(" on page "), F.col("page"),
        F.lit(" may be copied from another source. "), reason,
    )
    return diagrams.where("is_suspicious").select(
        *_alert(
            "SUSPICIOUS_DIAGRAM", "WARNING",
            F.concat(F.lit("Suspicious Diagram Detected in Paper: "), F.col("paper_title")), message,
            "paper_id", "diagram_id",
        )
    )


def checked_alerts(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete alerts, INFO where no severity is given, and the rejected rest with its reason."""
    missing = F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("type", "title", "message")])
    )
    checked = alerts.withColumn("_missing", missing)
    good = checked.where(F.size("_missing") == 0).withColumn(
        "severity", F.coalesce(F.nullif("severity", F.lit("")), F.lit("INFO"))
    )
    bad = checked.where(F.size("_missing") > 0).withColumn(
        "reason", F.concat(F.lit("Missing required fields: "), F.array_join("_missing", ", "))
    )
    return good.drop("_missing"), bad.drop("_missing")


def mark_alerts(alerts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts with ``is_read`` set by ``updates (alert_id, is_read string, seq)``, and refused updates.

    The last update of an alert wins. Unknown alerts and flags other than true/false are refused.
    """
    flag = F.when(F.col("is_read").isin("true", "false"), F.col("is_read") == "true")
    known = alerts.select("alert_id").distinct()
    usable = updates.select("alert_id", "seq", flag.alias("new_read")).where("new_read is not null")
    last = usable.groupBy("alert_id").agg(F.max_by("new_read", "seq").alias("new_read"))
    marked = alerts.join(last, "alert_id", "left").withColumn(
        "is_read", F.coalesce("new_read", "is_read")
    ).drop("new_read")
    unknown = updates.join(known, "alert_id", "left_anti").withColumn("reason", F.lit("Alert not found"))
    wrong = updates.join(known, "alert_id", "left_semi").where(flag.isNull()).withColumn(
        "reason", F.lit("isRead must be a boolean")
    )
    return marked.select(*alerts.columns), unknown.unionByName(wrong)


def similarity_reports(duplicates: DataFrame) -> DataFrame:
    """A ``title`` report without edit distance per duplicate that names its original."""
    return duplicates.where("is_duplicate and similar_paper_id is not null").select(
        "paper_id",
        F.col("similar_paper_id").alias("compared_paper_id"),
        F.lit("title").alias("similarity_type"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity_score"),
        F.lit(None).cast("int").alias("levenshtein_distance"),
    )


def _slack(colour: Column) -> Column:
    def field(title: str, column: str, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), F.col(column).alias("value"), F.lit(short).alias("short"))

    attachment = F.struct(
        colour.alias("color"),
        F.array(field("Type", "type", True), field("Severity", "severity", True), field("Message", "message", False)).alias("fields"),
        F.unix_seconds(F.col("created_at").cast("timestamp")).alias("ts"),
    )
    return F.to_json(F.struct(F.col("title").alias("text"), F.array(attachment).alias("attachments")))


def _discord(colour: Column) -> Column:
    def field(name: str, column: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.col(column).alias("value"), F.lit(True).alias("inline"))

    number = F.conv(F.substring(colour, 2, 6), 16, 10).cast("int")
    embed = F.struct(
        F.col("title").alias("title"),
        F.col("message").alias("description"),
        number.alias("color"),
        F.array(field("Type", "type"), field("Severity", "severity")).alias("fields"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def _email() -> Column:
    text = F.concat(
        F.col("message"), F.lit("\n\nType: "), F.col("type"), F.lit("\nSeverity: "), F.col("severity")
    )
    content = F.struct(F.lit("text/plain").alias("type"), text.alias("value"))
    return F.to_json(F.struct(F.col("title").alias("subject"), F.array(content).alias("content")))


def build_alert_payloads(alerts: DataFrame, channels: list[str]) -> DataFrame:
    """``(alert_id, channel, payload)``: one JSON payload per alert and enabled channel."""
    colours = F.create_map(*[F.lit(x) for pair in SEVERITY_COLOURS.items() for x in pair])
    colour = F.coalesce(F.try_element_at(colours, F.col("severity")), F.lit(SEVERITY_COLOURS["INFO"]))
    payload = (
        F.when(F.col("channel") == "slack", _slack(colour))
        .when(F.col("channel") == "discord", _discord(colour))
        .when(F.col("channel") == "email", _email())
    )
    sent = alerts.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return sent.select("alert_id", "channel", payload.alias("payload"))
