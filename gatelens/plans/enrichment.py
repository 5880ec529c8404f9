"""Alerts with severity, response time and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens import config
from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions import scoring
from gatelens.functions.timeparts import ts_text

# Columns an alert needs before it can be enriched.
INPUT = ["alert_type", "user_id", "country", "resource", "score", "ts", "detail"]


BAND = ("severity", "min_score", "max_score", "emoji", "response_time", "colour")


def _literal_map(entries) -> Column:
    return F.create_map(*[part for key, value in entries for part in (F.lit(key), value)])


def severity_attributes(severity: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """A struct with the attributes of a severity's band, looked up in a literal map of the policy's bands."""
    attributes = [
        (band[0], F.struct(*[F.lit(value).alias(name) for name, value in zip(BAND, band)])) for band in policy.severity_bands
    ]
    return F.element_at(_literal_map(attributes), severity)


def recommendations(alert_type: Column, severity: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """The steps for a rule and severity; a severity without an entry gets the rule's low-severity list, an unknown rule the default."""
    listed = lambda items: F.array(*[F.lit(text) for text in items])
    entries = [
        (f"{rule} {level}", listed(items)) for rule, by_severity in policy.recommendations.items() for level, items in by_severity.items()
    ]
    default = listed([policy.default_recommendation])
    if not entries:
        return default
    found = lambda level: F.try_element_at(_literal_map(entries), F.concat_ws(" ", alert_type, level))
    return F.coalesce(found(severity), found(F.lit(config.LOW)), default)


def enrich(alerts: DataFrame, policy: Policy = DEFAULT_POLICY, keep: tuple[str, ...] = ()) -> DataFrame:
    """ENRICHED_ALERT rows; ``keep`` names further columns to carry along. Works on batch and streaming input, without a join."""
    graded = alerts.withColumn("severity", scoring.severity("score", policy))
    attributed = graded.withColumn("band", severity_attributes(F.col("severity"), policy))
    return attributed.select(
        *keep,
        "alert_type",
        "severity",
        "band.emoji",
        "user_id",
        "country",
        "resource",
        "score",
        ts_text("ts").alias("timestamp"),
        "detail",
        "band.response_time",
        recommendations(F.col("alert_type"), F.col("severity"), policy).alias("recommendations"),
        "band.colour",
        "band.min_score",
        "band.max_score",
    )


def enrich_batch(alerts: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Rows of the batch alert table, graded by their highest risk score and dated by their first event."""
    renamed = alerts.withColumnRenamed("max_risk_score", "score").withColumnRenamed("first_event", "ts")
    return enrich(renamed.select(*INPUT), policy)
