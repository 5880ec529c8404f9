"""The live feed: one record per event, with totals so far and its enriched alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions import scoring
from gatelens.functions.scoring import event_class, score_band
from gatelens.functions.text import feed_time, fixed_width, short_time, spaced, visible_ip
from gatelens.functions.timeparts import ts_text
from gatelens.plans.enrichment import recommendations, severity_attributes
from gatelens.plans.stream_rules import alerts_array, any_alert, events_with_alerts, with_feed_totals

ROLES = ("admin", "analyst")


def event_classes(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    listed = events_with_alerts(events, policy)
    n_alerts = F.size("alerts")
    return listed.select(
        "event_id",
        "user_id",
        "score",
        n_alerts.cast("long").alias("n_alerts"),
        event_class(n_alerts, F.col("score")).alias("event_class"),
        score_band(F.col("score"), policy).alias("score_band"),
    )


def role_view(events: DataFrame, policy: Policy = DEFAULT_POLICY, roles=ROLES) -> DataFrame:
    """What each role sees of an event's address."""
    listed = events_with_alerts(events, policy)
    return listed.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles]))).select(
        "event_id",
        "role",
        "user_id",
        "score",
        visible_ip(F.col("role"), F.size("alerts") > 0, "ip_address").alias("ip"),
    )


def feed_lines(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Fixed-width line per event, and the short form of its time and country."""
    listed = events_with_alerts(events, policy)
    score_text = F.col("score").cast("string")
    line = F.concat(
        F.lit("["),
        feed_time("ts"),
        F.lit("] "),
        F.col("user_id"),
        F.lit("  "),
        fixed_width("country", 10),
        F.lit("  "),
        fixed_width("resource", 12),
        F.lit("  "),
        F.rpad("status", 8, " "),
        F.lit("  score:"),
        F.lpad(score_text, 3, " "),
    )
    return listed.select(
        "event_id",
        line.alias("line"),
        short_time("ts").alias("short_time"),
        F.substring("country", 1, 8).alias("short_country"),
        F.array_join(F.transform("alerts", lambda a: spaced(a["alert_type"])), "; ").alias("alert_names"),
        event_class(F.size("alerts"), F.col("score")).alias("event_class"),
    )


RECORD = ["total_events", "total_alerts", "rate", "user_id", "country", "resource", "status", "timestamp", "score", "ip"]


def feed_records(totalled: DataFrame, role: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """``(event_id, record)`` from detected events with totals: each alert is enriched in the event's own array."""
    rows = totalled.withColumn("timestamp", ts_text("ts")).withColumn(
        "ip", visible_ip(F.lit(role), any_alert(), "ip_address")
    )
    rows = rows.withColumn("severity", scoring.severity("score", policy))
    rows = rows.withColumn("band", severity_attributes(F.col("severity"), policy))

    def enriched(alert: Column) -> Column:
        return F.struct(
            alert["alert_type"].alias("alert_type"),
            F.col("severity"),
            F.col("band.emoji"),
            F.col("user_id"),
            F.col("country"),
            F.col("resource"),
            F.col("score"),
            F.col("timestamp"),
            alert["detail"].alias("detail"),
            F.col("band.response_time"),
            recommendations(alert["alert_type"], F.col("severity"), policy).alias("recommendations"),
        )

    listed = F.transform(alerts_array(policy), enriched).alias("alerts")
    return rows.select("event_id", F.to_json(F.struct(*RECORD, listed), {"ignoreNullFields": "false"}).alias("record"))


def feed_json(detected: DataFrame, role: str = "admin", policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The feed of a whole table of detected events."""
    return feed_records(with_feed_totals(detected), role, policy)
