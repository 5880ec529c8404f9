"""The alert record: what every batch rule reports about the set of events behind an alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.schema import ALERT


def record_aggregates() -> list[Column]:
    """Aggregates over an event set; "first" is by ``(ts, event_id)``."""
    return [
        F.min(F.struct("ts", "event_id", "country", "resource")).alias("first"),
        F.max("ts").alias("last_event"),
        F.max("risk_score").alias("max_risk_score"),
        F.count("*").alias("event_count"),
    ]


def folded_records() -> list[Column]:
    """The same over rows that already are such records."""
    return [
        F.min("first").alias("first"),
        F.max("last_event").alias("last_event"),
        F.max("max_risk_score").alias("max_risk_score"),
        F.sum("event_count").alias("event_count"),
    ]


def to_alert(records: DataFrame, alert_type: str, detail: Column) -> DataFrame:
    """ALERT rows from aggregated records."""
    return records.select(
        F.lit(alert_type).alias("alert_type"),
        "user_id",
        detail.alias("detail"),
        F.col("first.ts").alias("first_event"),
        "last_event",
        F.col("first.country").alias("country"),
        F.col("first.resource").alias("resource"),
        "max_risk_score",
        "event_count",
    ).select(*ALERT.fieldNames())
