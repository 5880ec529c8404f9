"""The stream rules in window form: the alerts that event-by-event processing gives, from one pass over a table.

:func:`detect` gives every event its history features, its score and one flag per rule that fires on it. The streaming
job produces rows of the same form, so everything after :func:`detect` serves both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens import config
from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions import scoring
from gatelens.functions.numbers import percent_text
from gatelens.functions.predicates import at_night, from_suspicious_country, is_failed, on_sensitive_resource
from gatelens.functions.text import two_digits
from gatelens.functions.timeparts import day_of, seconds, slice_start
from gatelens.operators.running import with_running_totals
from gatelens.operators.slices import SLICE, in_slice_order, slice_history, with_recent_failures

CONTEXT = ["event_id", "ts", "user_id", "ip_address", "country", "status", "resource"]
FLAGS = {rule: rule.lower() for rule in config.STREAM_RULE_ORDER}


def contextual_score(policy: Policy = DEFAULT_POLICY) -> Column:
    """The risk score with the user's recent failures as the attempt count."""
    return scoring.risk_score(F.col("trailing_failures"), policy)


def contextual_risk(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Events with ``trailing_failures`` and ``score``; the stored score is not used."""
    return with_recent_failures(events.select(*CONTEXT), policy).drop("slice", "rank_in_slice").withColumn(
        "score", contextual_score(policy)
    )


@dataclass(frozen=True)
class Before:
    """What has been settled before the events that :func:`detect` is given: ``tail``, the events of the last ``tail_seconds``;
    ``counts``, each user's ``events``; ``keys``, each ``user_id``, ``rule`` and ``key`` that has been used."""

    tail: DataFrame
    counts: DataFrame
    keys: DataFrame


def tail_seconds(policy: Policy = DEFAULT_POLICY) -> int:
    """How far back the brute-force rule looks: to the start of the clock minute, and from there over a burst."""
    return policy.burst_seconds + 60


def first_per_key(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Per user, ``rule`` and ``key`` the ``first`` sensitive access, by a partial aggregate over the sensitive accesses alone.

    Keys are the country, the day and the resource, so a user's list for a slice is bounded by the watch lists.
    """
    keyed = events.filter(on_sensitive_resource(policy)).select(
        "user_id",
        F.struct("ts", "event_id").alias("at"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        from_suspicious_country(policy),
                        F.struct(F.lit(config.SUSPICIOUS_COUNTRY).alias("rule"), F.col("country").alias("key")),
                    ),
                    F.when(
                        at_night(policy),
                        F.struct(F.lit(config.OFF_HOURS).alias("rule"), day_of("ts").cast("string").alias("key")),
                    ),
                    F.struct(F.lit(config.COMPROMISED_ACCOUNT).alias("rule"), F.col("resource").alias("key")),
                )
            )
        ).alias("k"),
    )
    return keyed.groupBy("user_id", "k").agg(F.min("at").alias("first")).select("user_id", "k.rule", "k.key", "first")


def first_uses(events: DataFrame, policy: Policy = DEFAULT_POLICY, used: DataFrame | None = None) -> DataFrame:
    """Per user and slice, the sensitive accesses that are a user's first for some rule key not in ``used``."""
    firsts = first_per_key(events, policy)
    if used is not None:
        firsts = firsts.join(used, ["user_id", "rule", "key"], "left_anti")
    return (
        firsts.withColumn("slice", slice_start("first.ts", policy.slice_seconds))
        .groupBy(*SLICE)
        .agg(F.collect_list(F.struct("rule", "first.event_id")).alias("firsts"))
    )


def detect(events: DataFrame, policy: Policy = DEFAULT_POLICY, before: Before | None = None) -> DataFrame:
    """Every event with ``trailing_failures``, ``ordinal``, ``score`` and one flag per rule that fires on it.

    The events are shuffled once, on ``(user_id, slice)``. A brute-force alert fires on the first event of a clock
    minute with too many recent failures, which lies within a slice; for the other rules the first event per key comes
    with the slice from :func:`first_uses`. With ``before``, the events go on from it; all of them are later than its tail.
    """
    over = F.col("trailing_failures") > policy.stream_burst_over
    minute = F.col("ts") - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), "ts"))
    earlier = in_slice_order().rowsBetween(Window.unboundedPreceding, -1)
    last_over = F.max(F.when(over, F.col("ts"))).over(earlier)
    rows = events.select(*CONTEXT)
    if before is not None:
        rows = rows.withColumn("settled", F.lit(False)).unionByName(before.tail.select(*CONTEXT, F.lit(True).alias("settled")))
    recent = (
        with_recent_failures(rows, policy)
        .withColumn("last_over", last_over)
        .withColumn(FLAGS[config.BRUTE_FORCE], over & (F.col("last_over").isNull() | (F.col("last_over") < minute)))
    )
    slices = slice_history(events, policy)
    if before is not None:
        own = F.sum((~F.col("settled")).cast("long")).over(in_slice_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        recent = recent.withColumn("rank_in_slice", own).filter(~F.col("settled"))
        known = F.coalesce(F.col("settled_events"), F.lit(0))
        counts = before.counts.select("user_id", F.col("events").alias("settled_events"))
        slices = slices.join(counts, "user_id", "left").withColumn("events_before", F.col("events_before") + known)
    slices = slices.join(first_uses(events, policy, before and before.keys), SLICE, "left")
    placed = recent.join(slices, SLICE).withColumn("ordinal", F.col("rank_in_slice") + F.col("events_before"))

    def is_first(rule):
        listed = F.exists("firsts", lambda f: (f["rule"] == rule) & (f["event_id"] == F.col("event_id")))
        return F.coalesce(listed, F.lit(False))

    return placed.select(
        *CONTEXT,
        "trailing_failures",
        "ordinal",
        FLAGS[config.BRUTE_FORCE],
        is_first(config.SUSPICIOUS_COUNTRY).alias(FLAGS[config.SUSPICIOUS_COUNTRY]),
        is_first(config.OFF_HOURS).alias(FLAGS[config.OFF_HOURS]),
        (is_first(config.COMPROMISED_ACCOUNT) & (F.col("ordinal") > policy.baseline_events)).alias(
            FLAGS[config.COMPROMISED_ACCOUNT]
        ),
        contextual_score(policy).alias("score"),
    )


def alert_candidates(detected: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """``user_id``, ``alert_type`` and ``key`` for each event that meets a rule's condition, whether or not its key has fired
    before. A key is the minute, country, day or resource for which a rule fires once. Use of a new resource is the event's flag."""
    sensitive = on_sensitive_resource(policy)
    met = [
        (config.BRUTE_FORCE, F.col("trailing_failures") > policy.stream_burst_over, F.date_format("ts", "yyyy-MM-dd HH:mm")),
        (config.SUSPICIOUS_COUNTRY, from_suspicious_country(policy) & sensitive, F.col("country")),
        (config.OFF_HOURS, at_night(policy) & sensitive, day_of("ts").cast("string")),
        (config.COMPROMISED_ACCOUNT, F.col(FLAGS[config.COMPROMISED_ACCOUNT]), F.col("resource")),
    ]
    held = [F.when(holds, F.struct(F.lit(rule).alias("alert_type"), key.alias("key"))) for rule, holds, key in met]
    return detected.withColumn("met", F.explode(F.array_compact(F.array(*held)))).select("*", "met.*").drop("met")


def alert_details(policy: Policy = DEFAULT_POLICY) -> dict[str, Column]:
    """The text of each rule's alert on a detected event."""
    reached = F.concat(F.lit("Access to "), F.col("resource"))
    return {
        config.BRUTE_FORCE: F.concat(
            F.col("trailing_failures").cast("string"), F.lit(f" failures within {policy.burst_seconds} seconds")
        ),
        config.SUSPICIOUS_COUNTRY: F.concat(reached, F.lit(" from "), F.col("country")),
        config.OFF_HOURS: F.concat(reached, F.lit(" at "), two_digits(F.hour("ts")), F.lit(":00")),
        config.COMPROMISED_ACCOUNT: F.concat(
            F.lit("First access to "), F.col("resource"), F.lit(" after "), F.col("ordinal").cast("string"), F.lit(" events")
        ),
    }


def alerts_array(policy: Policy = DEFAULT_POLICY, rules=config.STREAM_RULE_ORDER) -> Column:
    """The alerts of a detected event in rule order; empty if no rule fires."""
    details = alert_details(policy)
    fired = [
        F.when(
            F.col(FLAGS[rule]),
            F.struct(
                F.lit(config.STREAM_RULE_ORDER.index(rule) + 1).alias("rule_order"),
                F.lit(rule).alias("alert_type"),
                details[rule].alias("detail"),
            ),
        )
        for rule in rules
    ]
    return F.array_compact(F.array(*fired))


def any_alert() -> Column:
    return F.greatest(*[F.col(flag) for flag in FLAGS.values()])


def n_alerts() -> Column:
    return sum((F.col(flag).cast("long") for flag in FLAGS.values()), start=F.lit(0).cast("long"))


def fired_alerts(detected: DataFrame, policy: Policy = DEFAULT_POLICY, rules=config.STREAM_RULE_ORDER) -> DataFrame:
    """One row per alert of detected events, from a table or a stream."""
    return (
        detected.withColumn("alert", F.explode(alerts_array(policy, rules)))
        .select("*", "alert.*")
        .drop("alert", *FLAGS.values())
    )


def stream_alerts(events: DataFrame, policy: Policy = DEFAULT_POLICY, rules=config.STREAM_RULE_ORDER) -> DataFrame:
    """One row per alert, each with the event it fired on and its contextual score."""
    return fired_alerts(detect(events, policy), policy, rules)


def burst_evidence(alerts: DataFrame, failures: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The failures that each brute-force alert has counted, from tables or streams.

    ``alerts`` holds ``user_id``, ``alert_id`` and ``fired_at``, ``failures`` the log's columns. An alert looks into the cell of
    ``burst_seconds`` that it lies in and the one before, so the join is on user and cell, and a user with many failures is
    spread over many keys.
    """
    reach = seconds(policy.burst_seconds)
    own = slice_start("fired_at", policy.burst_seconds)
    placed = alerts.withColumn("cell", F.explode(F.array(own, own - reach))).withColumnRenamed("user_id", "alerted")
    counted = (F.col("ts") < F.col("fired_at")) | ((F.col("ts") == F.col("fired_at")) & (F.col("event_id") <= F.col("alert_id")))
    rows = failures.withColumn("own_cell", slice_start("ts", policy.burst_seconds))
    near = (F.col("alerted") == F.col("user_id")) & (F.col("cell") == F.col("own_cell")) & (F.col("ts") >= F.col("fired_at") - reach)
    return rows.join(placed, near & counted).drop("cell", "own_cell", "alerted")


EVIDENCE = ["user_id", "alert_id", "fired_at", "event_id", "ts", "ip_address", "country", "resource"]


def stream_evidence(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The failures behind each brute-force alert of the stream rules, in window form."""
    fired = detect(events, policy).filter(FLAGS[config.BRUTE_FORCE])
    alerts = fired.select("user_id", F.col("event_id").alias("alert_id"), F.col("ts").alias("fired_at"))
    return burst_evidence(alerts, events.filter(is_failed()), policy).select(*EVIDENCE)


def events_with_alerts(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Every event with its score and its, possibly empty, array of alerts."""
    return detect(events, policy).withColumn("alerts", alerts_array(policy)).drop(*FLAGS.values())


def with_feed_totals(detected: DataFrame) -> DataFrame:
    """Adds ``total_events``, ``total_alerts`` and ``rate`` as they stand after each event."""
    counted = detected.withColumn("one", F.lit(1)).withColumn("event_alerts", n_alerts())
    totals = with_running_totals(counted, {"total_events": "one", "total_alerts": "event_alerts"})
    return totals.withColumn("rate", percent_text(F.col("total_alerts"), F.col("total_events"))).drop("one", "event_alerts")


def alert_counts(detected: DataFrame) -> DataFrame:
    """Detected events as far as :func:`running_kpis` needs them."""
    return detected.select("event_id", "ts", "user_id", n_alerts().alias("event_alerts"))


def running_kpis(counts: DataFrame) -> DataFrame:
    """Totals, alert rate and number of alerted users after each event of :func:`alert_counts`."""
    counted = counts.withColumn("one", F.lit(1))
    first_alert = counted.filter("event_alerts > 0").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    # A user's first alert adds a row of its own at the event's position, instead of a join back to the events.
    arrivals = first_alert.select(
        "first.event_id", "first.ts", "user_id", F.lit(0).alias("one"), F.lit(0).alias("event_alerts"), F.lit(1).alias("arrived")
    )
    totals = with_running_totals(
        counted.withColumn("arrived", F.lit(0)).unionByName(arrivals),
        {"total_events": "one", "total_alerts": "event_alerts", "alerted_users": "arrived"},
    )
    return totals.filter("one = 1").select(
        "event_id",
        "ts",
        "user_id",
        "total_events",
        "total_alerts",
        "alerted_users",
        percent_text(F.col("total_alerts"), F.col("total_events")).alias("rate"),
    )


def stream_summary(detected: DataFrame, policy: Policy = DEFAULT_POLICY, top_users: int = 5) -> DataFrame:
    """Closing report: totals with the alert rate, alerts per type, and the users with most alerts.

    One pass counts events and alerts per user; each section is then a sum over that table.
    """
    counts = [F.count_if(flag).alias(flag) for flag in FLAGS.values()]
    return summary_of(detected.groupBy("user_id").agg(F.count("*").alias("events"), *counts), top_users)


def summary_of(per_user: DataFrame, top_users: int = 5) -> DataFrame:
    """The report from ``events`` and the alerts of each rule per user."""
    per_user = per_user.withColumn("alerts", sum((F.col(flag) for flag in FLAGS.values()), start=F.lit(0)))
    totals = per_user.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
        *[F.sum(flag).alias(flag) for flag in FLAGS.values()],
    )

    def line(section, name, n, rate=""):
        rate = rate if isinstance(rate, Column) else F.lit(rate)
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), n.alias("n"), rate.alias("rate"))

    lines = [
        line("total", "events", F.col("events")),
        line("total", "alerts", F.col("alerts"), percent_text(F.col("alerts"), F.col("events"))),
        *[line("type", rule, F.col(flag)) for rule, flag in FLAGS.items()],
    ]
    overall = totals.select(F.explode(F.array(*lines)).alias("l")).select("l.*").filter("section = 'total' OR n > 0")
    users = per_user.filter("alerts > 0").orderBy(F.desc("alerts"), "user_id").limit(top_users)
    return overall.unionByName(
        users.select(F.lit("user").alias("section"), F.col("user_id").alias("name"), F.col("alerts").alias("n"), F.lit("").alias("rate"))
    )
