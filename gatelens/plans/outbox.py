"""Notifications: the first high-risk alert of each user and rule, rendered as a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.predicates import is_high_risk
from gatelens.functions.text import html_escape, spaced
from gatelens.plans.enrichment import INPUT, enrich


def first_high_risk(alerts: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The earliest alert at or above the high-risk score per user and rule."""
    rest = [c for c in INPUT if c not in ("ts", "user_id", "alert_type")]
    return (
        alerts.filter(is_high_risk(policy, "score"))
        .groupBy("user_id", "alert_type")
        .agg(F.min(F.struct("ts", "event_id", *rest)).alias("a"))
        .select("user_id", "alert_type", "a.*")
    )


def subject() -> Column:
    return F.concat("severity", F.lit(" "), "emoji", F.lit(" "), "user_id", F.lit(": "), spaced("alert_type"))


def _fields() -> list[tuple[str, Column]]:
    return [
        ("What", F.col("detail")),
        ("Deadline", F.col("response_time")),
        ("Who", F.col("user_id")),
        ("When", F.col("timestamp")),
        ("Touched", F.concat(F.col("resource"), F.lit(" from "), F.col("country"))),
        ("Score", F.col("score").cast("string")),
    ]


def body_text() -> Column:
    lines = [F.concat(F.lit(f"{label}: "), value) for label, value in _fields()]
    numbered = F.transform(
        "recommendations", lambda text, i: F.concat((i + 1).cast("string"), F.lit(") "), text)
    )
    return F.concat_ws("\n", subject(), *lines, F.lit("Next:"), F.array_join(numbered, "\n"))


def body_html() -> Column:
    heading = F.concat(F.lit('<h1 style="color:'), F.col("colour"), F.lit('">'), html_escape(subject()), F.lit("</h1>"))
    rows = [F.concat(F.lit(f"<tr><td>{label}</td><td>"), html_escape(value), F.lit("</td></tr>")) for label, value in _fields()]
    items = F.array_join(
        F.transform("recommendations", lambda text: F.concat(F.lit("<li>"), html_escape(text), F.lit("</li>"))), ""
    )
    return F.concat(
        F.lit("<html><body>"), heading, F.lit("<table>"), *rows, F.lit("</table><ol>"), items, F.lit("</ol></body></html>")
    )


def render(first_alerts: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Outbox rows from alerts that already are one per user and rule."""
    return enrich(first_alerts, policy, keep=("event_id",)).select(
        "event_id",
        "user_id",
        "alert_type",
        "severity",
        "score",
        "timestamp",
        subject().alias("subject"),
        body_text().alias("body_text"),
        body_html().alias("body_html"),
    )


def notification_outbox(alerts: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return render(first_high_risk(alerts, policy), policy)
