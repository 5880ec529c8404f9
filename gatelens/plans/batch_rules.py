"""The batch detection rules over the full event history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens import config
from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.numbers import percent
from gatelens.functions.predicates import at_night, from_suspicious_country, is_failed, night_hour, on_sensitive_resource
from gatelens.functions.text import two_digits
from gatelens.functions.timeparts import day_of, elapsed_seconds
from gatelens.operators.alert_record import folded_records, record_aggregates, to_alert
from gatelens.operators.bursts import burst_windows, failure_moments, pick_bursts, within_bursts
from gatelens.operators.slices import SLICE, with_history, with_ordinal, with_slice


def brute_force_bursts(events: DataFrame, policy: Policy = DEFAULT_POLICY, failures: DataFrame | None = None) -> DataFrame:
    """The chosen windows with more than ``batch_burst_over`` failures, each with its alert record."""
    failures = failure_moments(events) if failures is None else failures
    anchors = burst_windows(failures, policy).filter(F.col("window_failures") > policy.batch_burst_over)
    record = anchors.select(
        "user_id",
        "ts",
        F.col("first.country").alias("country"),
        F.col("first.resource").alias("resource"),
        "window_last",
        "window_max_risk",
        "window_failures",
    )
    return pick_bursts(record, policy)


def brute_force(events: DataFrame, policy: Policy = DEFAULT_POLICY, failures: DataFrame | None = None) -> DataFrame:
    records = brute_force_bursts(events, policy, failures).select(
        "user_id",
        F.struct("ts", "country", "resource").alias("first"),
        F.col("window_last").alias("last_event"),
        F.col("window_max_risk").alias("max_risk_score"),
        F.col("window_failures").alias("event_count"),
    )
    duration = F.bround(elapsed_seconds(F.col("first.ts"), F.col("last_event")), 0).cast("long")
    detail = F.concat(
        F.col("event_count").cast("string"), F.lit(" failures, the last one "), duration.cast("string"), F.lit(" s after the first")
    )
    return to_alert(records, config.BRUTE_FORCE, detail)


def suspicious_country(events: DataFrame, policy: Policy = DEFAULT_POLICY, uses: DataFrame | None = None) -> DataFrame:
    """One alert per user and watched country from which a sensitive resource was reached.

    ``uses`` (:func:`sensitive_uses`) saves a scan where several rules run; without it the filters reach the file.
    """
    if uses is None:
        hits = events.filter(from_suspicious_country(policy) & on_sensitive_resource(policy))
        # The second grouping sees one row per sensitive resource.
        uses = hits.groupBy("user_id", F.col("country").alias("from_country"), F.col("resource").alias("used")).agg(
            *record_aggregates()
        )
    records = uses.filter(from_suspicious_country(policy, "from_country")).groupBy("user_id", "from_country").agg(
        *folded_records(),
        F.sort_array(F.collect_list(F.struct("first.ts", "first.event_id", "used"))).alias("seen"),
    )
    detail = F.concat(
        F.col("from_country"),
        F.lit(": "),
        F.col("event_count").cast("string"),
        F.lit(" sensitive events on "),
        F.array_join(F.array_distinct(F.transform("seen", lambda s: s["used"])), ", "),
    )
    return to_alert(records, config.SUSPICIOUS_COUNTRY, detail)


def off_hours(events: DataFrame, policy: Policy = DEFAULT_POLICY, uses: DataFrame | None = None) -> DataFrame:
    """One alert per user over the whole period for sensitive accesses at night."""
    if uses is None:
        hits = events.filter(at_night(policy) & on_sensitive_resource(policy))
        uses = hits.groupBy("user_id", F.hour("ts").alias("at_hour")).agg(*record_aggregates())
    records = (
        uses.filter(night_hour(F.col("at_hour"), policy))
        .groupBy("user_id")
        .agg(*folded_records(), F.min("at_hour").alias("from_hour"), F.max("at_hour").alias("to_hour"))
    )
    detail = F.concat(
        F.col("event_count").cast("string"),
        F.lit(" sensitive events by night, hours "),
        two_digits(F.col("from_hour")),
        F.lit(" to "),
        two_digits(F.col("to_hour")),
    )
    return to_alert(records, config.OFF_HOURS, detail)


def history_halves(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Events with ``in_baseline``: true for the first half (rounded down) of the user's history."""
    return with_ordinal(events, policy).withColumn(
        "in_baseline", F.col("ordinal") <= F.floor(F.col("user_events") / 2)
    )


_USE = ["user_id", "used", "first", "last_event", "max_risk_score", "event_count"]


def sensitive_uses(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per user, slice, country, sensitive resource and hour with its record and the slice's place in the
    user's history (``slice_events``, ``events_before``, ``user_events``), from one pass over the log.

    The log is folded to a row per user, slice and use before it moves; other accesses are counted in the same pass.
    """
    sensitive = on_sensitive_resource(policy)
    folded = (
        with_slice(events.select("user_id", "ts", "event_id", "country", "resource", "risk_score"), policy)
        .filter(F.col("user_id").isNotNull() & F.col("slice").isNotNull())
        .withColumn("used", F.when(sensitive, F.col("resource")))
        .withColumn("from_country", F.when(sensitive, F.col("country")))
        .withColumn("at_hour", F.when(sensitive, F.hour("ts")))
        .groupBy(*SLICE, "used", "from_country", "at_hour")
        .agg(*record_aggregates())
    )
    record = F.struct("used", "from_country", "at_hour", "first", "last_event", "max_risk_score", "event_count")
    per_slice = folded.groupBy(*SLICE).agg(
        F.sum("event_count").alias("slice_events"), F.collect_list(F.when(F.col("used").isNotNull(), record)).alias("uses")
    )
    return with_history(per_slice).select(*SLICE, "slice_events", "events_before", "user_events", F.explode("uses").alias("use")).select(
        *SLICE, "slice_events", "events_before", "user_events", "use.*"
    )


def new_sensitive_resources(events: DataFrame, policy: Policy = DEFAULT_POLICY, uses: DataFrame | None = None) -> DataFrame:
    """Sensitive resources a user reached in the second half of the history and never in the first.

    A resource is new if the user's first access to it comes after the first half. Its position in the history is known
    to within one time slice from the slice counts, which settles nearly all cases without ordering any events. Only
    where the middle of the history lies in the slice of the first access are that slice's events counted one by one.
    """
    uses = sensitive_uses(events, policy) if uses is None else uses
    place = F.struct("first", "slice", "slice_events", "events_before", "user_events")
    firsts = uses.groupBy("user_id", "used").agg(
        F.min(place).alias("place"),
        F.max("last_event").alias("last_event"),
        F.max("max_risk_score").alias("max_risk_score"),
        F.sum("event_count").alias("event_count"),
    )
    # ``early_events``: how many of the slice's events belong to the first half, if positive.
    early = F.floor(F.col("place.user_events") / 2) - F.col("place.events_before")
    placed = firsts.select(
        "user_id", "used", "place.first", "last_event", "max_risk_score", "event_count",
        "place.slice", "place.slice_events", early.alias("early_events"),
    )
    open_cases = placed.filter(F.col("early_events") < F.col("slice_events"))
    decided = open_cases.filter(F.col("early_events") <= 0)
    undecided = open_cases.filter(F.col("early_events") > 0)

    moments = with_slice(events.select("user_id", "ts", "event_id"), policy).withColumnRenamed("event_id", "id")
    late = (
        undecided.join(moments, SLICE)
        .filter(F.struct("ts", F.col("id").alias("event_id")) <= F.struct("first.ts", "first.event_id"))
        .groupBy(*_USE, "early_events")
        .agg(F.count("*").alias("rank_in_slice"))
        .filter(F.col("rank_in_slice") > F.col("early_events"))
    )
    return decided.select(*_USE).unionByName(late.select(*_USE))


def compromised_account(events: DataFrame, policy: Policy = DEFAULT_POLICY, uses: DataFrame | None = None) -> DataFrame:
    records = (
        new_sensitive_resources(events, policy, uses)
        .groupBy("user_id")
        .agg(
            F.min("first").alias("first"),
            F.max("last_event").alias("last_event"),
            F.max("max_risk_score").alias("max_risk_score"),
            F.sum("event_count").alias("event_count"),
            F.sort_array(F.collect_list("used")).alias("resources"),
        )
        .filter(F.col("event_count") > policy.new_resource_over)
    )
    detail = F.concat(
        F.col("event_count").cast("string"),
        F.lit(" late events on resources new to the user: "),
        F.array_join("resources", ", "),
    )
    return to_alert(records, config.COMPROMISED_ACCOUNT, detail)


def slow_brute_force(events: DataFrame, policy: Policy = DEFAULT_POLICY, failures: DataFrame | None = None) -> DataFrame:
    failures = failure_moments(events) if failures is None else failures
    records = (
        failures.groupBy("user_id", day_of("ts").alias("day"))
        .agg(
            F.min(F.struct("ts", "first.event_id", "first.country", "first.resource")).alias("first"),
            F.max("ts").alias("last_event"),
            F.max("max_risk").alias("max_risk_score"),
            F.sum("failures").alias("event_count"),
        )
        .filter(F.col("event_count") > policy.daily_failures_over)
    )
    detail = F.concat(
        F.col("event_count").cast("string"),
        F.lit(" failures spread over "),
        F.col("day").cast("string"),
    )
    return to_alert(records, config.SLOW_BRUTE_FORCE, detail)


def all_alerts(events: DataFrame, policy: Policy = DEFAULT_POLICY, include_slow: bool = False) -> DataFrame:
    """The alert table. The slow brute-force rule is reported apart unless asked for.

    The three rules on sensitive accesses share one pass over the log, both brute-force rules share the failures.
    """
    uses = sensitive_uses(events, policy)
    failures = failure_moments(events)
    rules = [
        brute_force(events, policy, failures),
        *[rule(events, policy, uses) for rule in (suspicious_country, off_hours, compromised_account)],
    ]
    if include_slow:
        rules.append(slow_brute_force(events, policy, failures))
    return reduce(DataFrame.unionByName, rules)


def alert_evidence(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The failed events behind each brute-force alert."""
    bursts = brute_force_bursts(events, policy).select("user_id", F.col("ts").alias("burst_start"))
    return within_bursts(events.filter(is_failed()), bursts, policy)


def detection_rate(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts as a percentage of events."""
    counted = events.select(F.lit(1).alias("is_event"), F.lit(0).alias("is_alert")).unionByName(
        alerts.select(F.lit(0).alias("is_event"), F.lit(1).alias("is_alert"))
    )
    totals = counted.agg(F.sum("is_alert").alias("total_alerts"), F.sum("is_event").alias("total_events"))
    return totals.withColumn("alert_rate", percent(F.col("total_alerts"), F.col("total_events"), 2))
