"""The registered queries: every operator over the access events derived from a test-table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.config import BRUTE_FORCE, COMPROMISED_ACCOUNT, DEFAULT_POLICY, OFF_HOURS, SUSPICIOUS_COUNTRY
from gatelens.functions import predicates as p
from gatelens.functions import scoring
from gatelens.functions.text import mask_ip
from gatelens.operators.lookups import materialised, on_watchlist
from gatelens.operators.bursts import burst_windows, failure_moments
from gatelens.operators.slices import with_previous_failure
from gatelens.plans import analytics, batch_rules, enrichment, feed, outbox, profiles, stream_rules, user_sketches
from gatelens.session import run_dir
from gatelens.sinks import tables
from gatelens.sources.access_log import TEXT_OPTIONS, parse_events, read_access_log, read_alerts, read_raw_log
from gatelens.sources.adapter import access_events
from gatelens.streaming import epochs, replay

REGISTRY = {}


def query(function):
    """Register a query that takes ``(spark, sf_dir)``."""
    REGISTRY[function.__name__] = function
    return function


def over_events(name, plan):
    """Register a plan that takes the access events."""
    REGISTRY[name] = lambda spark, sf_dir: plan(access_events(spark, sf_dir))


def over_alerts(name, plan):
    """Register a plan that takes the batch alerts."""
    REGISTRY[name] = lambda spark, sf_dir: plan(batch_rules.all_alerts(access_events(spark, sf_dir)))


def recommendations_as_text(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("recommendations", F.array_join("recommendations", " | "))


# Sources and sinks ------------------------------------------------------------------------------------------------

over_events("access_events", lambda ev: ev)


@query
def alerts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "alerts")
    tables.write_alerts(batch_rules.all_alerts(access_events(spark, sf_dir)), path)
    return read_alerts(spark, path)


@query
def export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "export")
    tables.export_log(access_events(spark, sf_dir), path)
    return read_raw_log(spark, path)


@query
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "export")
    tables.export_log(access_events(spark, sf_dir), path)
    return parse_events(read_raw_log(spark, path)).select("event_id", "ts_text", "ts", "user_id", "risk_score", "parse_ok")


@query
def alert_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "alert-export")
    tables.write_alert_export(stream_rules.stream_alerts(access_events(spark, sf_dir)), "admin", path)
    return spark.read.schema(tables.EXPORTED).options(**TEXT_OPTIONS).csv(path)


@query
def plain_log_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as other systems write it: CSV, its own column order, ``timestamp`` for the time, and no ids."""
    path = run_dir(spark, "plain-log")
    log = tables.normalised_log(access_events(spark, sf_dir)).withColumnRenamed("ts", "timestamp")
    log.select("user_id", "timestamp", "country", "ip_address", "status", "action", "resource", "scenario", "risk_score").write.options(**TEXT_OPTIONS).csv(path)
    events = read_access_log(spark, path, "csv", {"timestamp": "ts"})
    return events.groupBy("user_id").agg(
        F.count("*").alias("events"),
        F.count_distinct("event_id").alias("ids"),
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
        F.count_if(F.col("status") == "failed").alias("failures"),
    )


over_events("notification_outbox", lambda ev: outbox.notification_outbox(stream_rules.stream_alerts(ev)))

# Projections and filters ------------------------------------------------------------------------------------------

over_events("time_features", analytics.time_features)
over_events("failed_events", lambda ev: ev.filter(p.is_failed()))
over_events("suspicious_sensitive_events", lambda ev: ev.filter(p.from_suspicious_country() & p.on_sensitive_resource()))
over_events("off_hours_sensitive_events", lambda ev: ev.filter(p.at_night() & p.on_sensitive_resource()))
over_events("high_risk_events", analytics.high_risk_events)
over_alerts("alerts_filtered", lambda al: analytics.alerts_filtered(al, [BRUTE_FORCE, OFF_HOURS]))

# Scores and scalar functions --------------------------------------------------------------------------------------


@query
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateless score with the attempt count the test adapter assigns."""
    ev = access_events(spark, sf_dir)
    attempts = F.when(F.col("scenario") == "brute_force", F.col("event_id") % 12).otherwise(0)
    return ev.select("event_id", attempts.alias("attempts"), scoring.risk_score(attempts).alias("score"))


over_events(
    "contextual_risk",
    lambda ev: stream_rules.contextual_risk(ev).select("event_id", "user_id", "trailing_failures", "score"),
)
over_alerts(
    "alert_severity",
    lambda al: al.select("alert_type", "user_id", "first_event", "max_risk_score", scoring.severity("max_risk_score").alias("severity")),
)
over_alerts("alert_enriched", lambda al: recommendations_as_text(enrichment.enrich_batch(al)))
over_alerts(
    "alert_recommendations",
    lambda al: enrichment.enrich_batch(al)
    .select("alert_type", "severity", "user_id", "timestamp", F.posexplode("recommendations").alias("position", "recommendation"))
    .withColumn("position", F.col("position") + 1),
)
over_events("risk_levels", analytics.risk_levels)
over_events("event_class", feed.event_classes)
over_events("masked_ips", lambda ev: ev.select("event_id", "ip_address", mask_ip("ip_address").alias("masked_ip")))
over_events("role_view", feed.role_view)
over_events("feed_lines", feed.feed_lines)
over_events(
    "failure_gaps",
    lambda ev: with_previous_failure(ev).select("event_id", "user_id", "ts", "previous_ts", "gap_seconds"),
)
over_events(
    "new_sensitive_resources",
    lambda ev: batch_rules.new_sensitive_resources(ev).select(
        "user_id",
        F.col("used").alias("resource"),
        F.col("first.ts").alias("first_event"),
        "last_event",
        "event_count",
    ),
)

# Joins ------------------------------------------------------------------------------------------------------------


@query
def watchlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    watchlist = spark.createDataFrame([(c,) for c in DEFAULT_POLICY.suspicious_countries], "country string")
    return on_watchlist(access_events(spark, sf_dir), watchlist, "country")


over_events(
    "alert_evidence",
    lambda ev: batch_rules.alert_evidence(ev).select("user_id", "burst_start", "event_id", "ts", "country", "resource", "risk_score"),
)

# Aggregates -------------------------------------------------------------------------------------------------------

over_events("events_by_user", analytics.events_by_user)
over_events("top_active_users", analytics.top_active_users)
over_events("failed_by_user", analytics.failed_by_user)
over_events("top_failed_users", analytics.top_failed_users)
over_events("scenario_share", lambda ev: analytics.share_of(ev, "scenario"))
over_events("status_share", lambda ev: analytics.share_of(ev, "status"))
over_events("events_by_country", analytics.events_by_country)
over_events("events_by_resource", analytics.events_by_resource)
over_events("top_resources", analytics.top_resources)
over_events("sensitive_by_country", analytics.sensitive_by_country)
over_events("events_by_hour", analytics.events_by_hour)
over_events("risk_by_country", analytics.risk_by_country)
over_events("risk_by_scenario", analytics.risk_by_scenario)
over_events("risk_stats", analytics.risk_stats)
over_events("null_counts", analytics.null_counts)
over_events("dataset_profile", analytics.dataset_profile)
over_events("events_preview", analytics.events_preview)
over_alerts("alerts_by_type", analytics.alerts_by_type)
over_alerts("alerts_by_user", analytics.alerts_by_user)
over_alerts("top_alerted_users", analytics.top_alerted_users)
over_alerts("alerts_timeline", analytics.alerts_timeline)
over_alerts("max_risk_by_type", analytics.max_risk_by_type)
over_alerts("alert_type_options", analytics.alert_type_options)
over_alerts("latest_alerts", analytics.latest_alerts)
over_events("alert_kpis", lambda ev: analytics.alert_kpis(batch_rules.all_alerts(ev), ev))

# Distinct users from stored daily sketches -------------------------------------------------------------------------


def over_sketches(name, read):
    """Register what can be read from the log's daily sketches, which are stored first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events, path = access_events(spark, sf_dir), run_dir(spark, "sketches")
        tables.write_user_sketches(user_sketches.daily_sketches(events, batch_rules.all_alerts(events)), path)
        return read(tables.read_user_sketches(spark, path))

    REGISTRY[name] = run


over_sketches("users_by_day", lambda days: user_sketches.trailing_users(days, 1))
over_sketches("users_by_week", user_sketches.trailing_users)
over_sketches("returning_users", user_sketches.returning_users)

# Batch rules ------------------------------------------------------------------------------------------------------

over_events("rule_brute_force", batch_rules.brute_force)
over_events("rule_suspicious_country", batch_rules.suspicious_country)
over_events("rule_off_hours", batch_rules.off_hours)
over_events("rule_compromised_account", batch_rules.compromised_account)
over_events("rule_slow_brute_force", batch_rules.slow_brute_force)
over_events("all_alerts", batch_rules.all_alerts)
over_events("all_alerts_with_slow", lambda ev: batch_rules.all_alerts(ev, include_slow=True))
over_events("detection_rate", lambda ev: batch_rules.detection_rate(ev, batch_rules.all_alerts(ev)))

# Windows ----------------------------------------------------------------------------------------------------------

over_events(
    "failure_windows",
    lambda ev: burst_windows(failure_moments(ev)).select(
        "user_id", "ts", "failures", "window_failures", "window_last", "window_max_risk"
    ),
)
over_events("trailing_failures", lambda ev: stream_rules.contextual_risk(ev).select("event_id", "user_id", "ts", "trailing_failures"))
over_events(
    "history_split",
    lambda ev: batch_rules.history_halves(ev.select("event_id", "ts", "user_id")).select(
        "event_id", "user_id", "ordinal", "user_events", "in_baseline"
    ),
)
over_events("user_event_ordinal", profiles.event_ordinals)
over_events("user_profile", profiles.user_profile)
over_events("baseline_resources", profiles.baseline_resources)
over_events("running_kpis", lambda ev: stream_rules.running_kpis(materialised(stream_rules.alert_counts(stream_rules.detect(ev)))))

# Stream rules in window form --------------------------------------------------------------------------------------

STREAM_ALERT = ["event_id", "ts", "user_id", "alert_type", "country", "resource", "score", "detail"]


def stream_rule(name, rule):
    over_events(name, lambda ev: stream_rules.stream_alerts(ev, rules=(rule,)).select(*STREAM_ALERT))


stream_rule("stream_rule_brute_force", BRUTE_FORCE)
stream_rule("stream_rule_suspicious_country", SUSPICIOUS_COUNTRY)
stream_rule("stream_rule_off_hours", OFF_HOURS)
stream_rule("stream_rule_compromised_account", COMPROMISED_ACCOUNT)

over_events(
    "stream_event_alerts",
    lambda ev: stream_rules.events_with_alerts(ev).select(
        "event_id",
        "user_id",
        "score",
        F.size("alerts").cast("long").alias("n_alerts"),
        F.array_join(F.transform("alerts", lambda a: F.concat(a["alert_type"], F.lit(": "), a["detail"])), "; ").alias("alerts"),
    ),
)
over_events(
    "stream_enriched_alerts",
    lambda ev: recommendations_as_text(enrichment.enrich(stream_rules.stream_alerts(ev), keep=("event_id",))),
)
over_events("burst_evidence", stream_rules.stream_evidence)
over_events("stream_summary", lambda ev: stream_rules.stream_summary(stream_rules.detect(ev)))
over_events(
    "recent_alerts",
    lambda ev: stream_rules.stream_alerts(ev)
    .orderBy(F.desc("ts"), F.desc("event_id"), F.desc("rule_order"))
    .limit(50)
    .select(*STREAM_ALERT),
)
over_events(
    "recent_events",
    lambda ev: analytics.recent(ev.select("event_id", "ts", "user_id", "country", "resource", "status"), 100),
)

# Streaming jobs, run to completion over the table -----------------------------------------------------------------


@query
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_stream_events(spark, replay.adapted_stream(sf_dir))


@query
def stream_user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.user_state(spark, replay.run_detection(spark, replay.adapted_stream(sf_dir)))


@query
def stream_alerts_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = replay.run_detection(spark, replay.adapted_stream(sf_dir))
    return stream_rules.fired_alerts(replay.scored_table(spark, run)).select(*STREAM_ALERT)


@query
def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_feed(spark, replay.adapted_stream(sf_dir))


@query
def stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_outbox(spark, replay.run_detection(spark, replay.adapted_stream(sf_dir)))


@query
def stream_hourly_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_hourly_kpis(spark, replay.run_detection(spark, replay.adapted_stream(sf_dir)))


@query
def stream_slow_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_slow_brute_force(spark, replay.adapted_stream(sf_dir))


@query
def stream_epoch_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = epochs.run_epochs(spark, replay.adapted_stream(sf_dir))
    return stream_rules.fired_alerts(epochs.scored(spark, folder)).select(*STREAM_ALERT)


@query
def stream_alert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.run_alert_keys(spark, replay.run_detection(spark, replay.adapted_stream(sf_dir)))


def over_epochs(name, read):
    """Register what a run by epochs over the table has kept up."""
    REGISTRY[name] = lambda spark, sf_dir: read(spark, epochs.run_epochs(spark, replay.adapted_stream(sf_dir)))


over_epochs("stream_newest_alerts", lambda spark, folder: epochs.newest_alerts(spark, folder).select(*STREAM_ALERT))
over_epochs("stream_newest_events", epochs.newest_events)
over_epochs("stream_totals", epochs.totals)
over_epochs("stream_report", epochs.report)


@query
def stream_alert_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = replay.adapted_stream(sf_dir)
    return replay.run_evidence(spark, replay.run_detection(spark, stream), stream)


def halves(spark: SparkSession, sf_dir: str):
    """The log's first half by time as a table, and both halves as streams. Rows without a time are in the second half."""
    events, stream = access_events(spark, sf_dir), replay.adapted_stream(sf_dir)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    early = F.lit(False) if first is None else F.coalesce(F.col("ts") < F.lit(first + (last - first) / 2), F.lit(False))
    return events.filter(early), lambda s: stream(s).filter(early), lambda s: stream(s).filter(~early)


@query
def stream_resumed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the first half of the log's time, and a second run that goes on from the first one's state."""
    _, first, second = halves(spark, sf_dir)
    one = epochs.run_epochs(spark, first)
    two = epochs.run_epochs(spark, second, start=epochs.handed_over(spark, one))
    scored = epochs.scored(spark, one).unionByName(epochs.scored(spark, two))
    return stream_rules.fired_alerts(scored).select(*STREAM_ALERT)


@query
def stream_report_after_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing report of a stream over the second half that goes on from the first half, taken as a table."""
    history, _, second = halves(spark, sf_dir)
    return epochs.report(spark, epochs.run_epochs(spark, second, start=epochs.from_history(history)))
