"""Descriptive queries over events and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.numbers import percent, ratio
from gatelens.functions.predicates import from_suspicious_country, is_failed, is_high_risk, night_hour, on_sensitive_resource
from gatelens.functions.scoring import RISK_LEVELS, risk_level
from gatelens.functions.timeparts import day_of, hour_of, month_name, weekday_name
from gatelens.operators.frequency import frequency, mean_by, top


def time_features(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        hour_of("ts").alias("hour"),
        weekday_name("ts").alias("weekday"),
        month_name("ts").alias("month"),
        day_of("ts").alias("day"),
    )


def events_by_user(events: DataFrame) -> DataFrame:
    return top(frequency(events, "user_id"), "user_id")


def top_active_users(events: DataFrame, k: int = 10) -> DataFrame:
    return top(frequency(events, "user_id"), "user_id", k)


def failed_by_user(events: DataFrame) -> DataFrame:
    return top(frequency(events.filter(is_failed()), "user_id"), "user_id")


def top_failed_users(events: DataFrame, k: int = 10) -> DataFrame:
    return top(frequency(events.filter(is_failed()), "user_id"), "user_id", k)


def share_of(events: DataFrame, key: str) -> DataFrame:
    """Frequency of ``key`` with its share of all rows, of which those without a key are a part; one pass over the log."""
    counts = events.groupBy(key).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    shares = counts.filter(F.col(key).isNotNull()).select(key, "n", percent(F.col("n"), F.col("total"), 1).alias("pct"))
    return top(shares, key)


def events_by_country(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return top(frequency(events, "country"), "country").withColumn("suspicious", from_suspicious_country(policy))


def events_by_resource(events: DataFrame) -> DataFrame:
    return top(frequency(events, "resource"), "resource")


def top_resources(events: DataFrame, k: int = 10) -> DataFrame:
    return top(frequency(events, "resource"), "resource", k)


def sensitive_by_country(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return top(frequency(events.filter(on_sensitive_resource(policy)), "country"), "country")


def events_by_hour(events: DataFrame, policy: Policy = DEFAULT_POLICY, per_block: int = 20) -> DataFrame:
    """Events per hour of day with a text bar, the night flag and the mean over the hours that occur."""
    by_hour = events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    mean = by_hour.agg(ratio(F.sum("n"), F.count("*"), 2).alias("mean_n"))
    return by_hour.select(
        "hour",
        "n",
        night_hour(F.col("hour"), policy).alias("off_hours"),
        F.repeat(F.lit("█"), F.call_function("div", F.col("n"), F.lit(per_block)).cast("int")).alias("bar"),
        mean.scalar().alias("mean_n"),
    ).orderBy("hour")


def risk_by_country(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    means = mean_by(events, "country", "risk_score", "mean_risk").withColumn("suspicious", from_suspicious_country(policy))
    return means.orderBy(F.desc("mean_risk"), "country")


def risk_by_scenario(events: DataFrame) -> DataFrame:
    return mean_by(events, "scenario", "risk_score", "mean_risk").orderBy("scenario")


def risk_stats(events: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the risk score, one decimal.

    Scores are first counted per value (at most 101 rows), so the exact percentiles cost nothing at any scale.
    """
    per_score = events.groupBy("risk_score").agg(F.count("*").alias("n")).filter(F.col("risk_score").isNotNull())
    score, n = F.col("risk_score"), F.col("n")
    total, weighted = F.sum(n), F.sum(score * n)
    squares = F.sum(score * score * n)
    # Sample variance from exact integer sums.
    spread = (total * squares - weighted * weighted).cast("double") / (total * (total - 1)).cast("double")
    return per_score.agg(
        total.alias("n"),
        ratio(weighted, total, 1).alias("mean"),
        F.round(F.sqrt(spread), 1).alias("std"),
        F.min(score).alias("min"),
        *[
            F.round(F.percentile(score, F.lit(q), n), 1).alias(name)
            for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
        ],
        F.max(score).alias("max"),
    )


def null_counts(events: DataFrame) -> DataFrame:
    """Nulls per column, counted in one pass."""
    counts = events.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in events.columns])
    return counts.unpivot([], events.columns, "column_name", "nulls")


def dataset_profile(events: DataFrame) -> DataFrame:
    dtypes = ", ".join(f"{name} {dtype}" for name, dtype in events.dtypes)
    return events.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(events.columns)).alias("n_columns"),
        F.lit(dtypes).alias("column_types"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def risk_levels(events: DataFrame) -> DataFrame:
    """Rows and share per risk level; levels without rows are kept with zero."""
    levels = [F.count_if(risk_level("risk_score") == level).alias(level) for level in RISK_LEVELS]
    counts = events.agg(F.count("*").alias("total"), *levels)
    return counts.unpivot("total", list(RISK_LEVELS), "level", "n").select(
        "level", "n", percent(F.col("n"), F.col("total")).alias("pct")
    )


def high_risk_events(events: DataFrame, policy: Policy = DEFAULT_POLICY, k: int = 15) -> DataFrame:
    return (
        events.filter(is_high_risk(policy))
        .orderBy(F.desc("risk_score"), "ts", "event_id")
        .limit(k)
        .select("ts", "user_id", "country", "resource", "status", "risk_score", "scenario")
    )


def events_preview(events: DataFrame, k: int = 3) -> DataFrame:
    return events.orderBy("event_id").limit(k)


# Alert table queries.


def alerts_by_type(alerts: DataFrame) -> DataFrame:
    return top(frequency(alerts, "alert_type"), "alert_type")


def alerts_by_user(alerts: DataFrame) -> DataFrame:
    return top(frequency(alerts, "user_id"), "user_id")


def top_alerted_users(alerts: DataFrame, k: int = 10) -> DataFrame:
    """Users with most alerts, each with the ratio to the largest count."""
    largest = top(frequency(alerts, "user_id"), "user_id", k)
    return largest.withColumn("ratio", ratio(F.col("n"), F.max("n").over(Window.partitionBy()), 3))


def alerts_timeline(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(day_of("first_event").alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def max_risk_by_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.max("max_risk_score").alias("max_risk")).orderBy("alert_type")


def alert_type_options(alerts: DataFrame) -> DataFrame:
    return alerts.select("alert_type").distinct()


def alerts_filtered(alerts: DataFrame, types=None) -> DataFrame:
    """Alerts of the chosen types, newest first; all types by default."""
    chosen = alerts if types is None else alerts.filter(F.col("alert_type").isin(*types))
    return chosen.orderBy(F.desc("first_event"), "alert_type", "user_id", "country")


def latest_alerts(alerts: DataFrame, types=None, k: int = 5) -> DataFrame:
    return (
        alerts_filtered(alerts, types)
        .limit(k)
        .select("alert_type", "user_id", "country", "resource", "max_risk_score", "event_count", "detail")
    )


def alert_kpis(alerts: DataFrame, events: DataFrame, approximate: bool = False) -> DataFrame:
    """Alerts, alert types, alerted users and log events."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    n_events = events.agg(F.count("*").alias("n"))
    return alerts.agg(
        F.count("*").alias("n_alerts"),
        F.count_distinct("alert_type").alias("n_types"),
        distinct("user_id").alias("n_users"),
    ).withColumn("n_events", n_events.scalar())


def recent(rows: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` rows, as the feed keeps them."""
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)
