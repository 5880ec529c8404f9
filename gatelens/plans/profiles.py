"""What is known about a user at each event, and the baseline of a user's first events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.operators.slices import SLICE, with_ordinal, with_slice


def _changes(events: DataFrame, value: Column, name: str, policy: Policy) -> DataFrame:
    """Per user and slice, the moments at which the set of values seen grows, each with the set's text from then on.

    A user's list is as long as the value's domain (hours of a day, countries), not as the history.
    """
    firsts = events.groupBy("user_id", value.alias("value")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    known = firsts.filter(F.col("value").isNotNull())
    listed = known.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "value"))).alias("l"))
    grown = listed.select("user_id", "l", F.posexplode("l").alias("i", "new"))
    so_far = F.array_sort(F.transform(F.slice("l", F.lit(1), F.col("i") + 1), lambda s: s["value"]))
    steps = grown.select(
        "user_id",
        F.col("new.first.ts").alias("ts"),
        F.struct("new.first", F.array_join(so_far.cast("array<string>"), ",").alias("text")).alias("step"),
    )
    return with_slice(steps, policy).groupBy(*SLICE).agg(F.sort_array(F.collect_list("step")).alias(name))


def user_profile(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Per event: first and latest event time so far, and the countries and hours seen so far.

    What is known about a user is attached to the user's time slices: the state at the slice's start and the few changes
    within it. Events meet it there, so a very active user's events stay spread over many tasks.
    """
    columns = with_slice(events.select("event_id", "ts", "user_id", "country"), policy)
    by_user = Window.partitionBy("user_id")
    before = by_user.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)

    def changes(value, name):
        return _changes(columns, value, name, policy)

    def at_start(name):
        return F.last(F.element_at(name, -1)["text"], ignorenulls=True).over(before).alias(f"{name}_before")

    slices = (
        columns.groupBy(*SLICE)
        .agg(F.min("ts").alias("slice_first"))
        .join(changes(F.col("country"), "countries"), SLICE, "left")
        .join(changes(F.hour("ts"), "hours"), SLICE, "left")
        .select(
            *SLICE,
            F.min("slice_first").over(by_user).alias("first_event"),
            "countries",
            at_start("countries"),
            "hours",
            at_start("hours"),
        )
    )
    here = F.struct("ts", "event_id")

    def seen(name):
        passed = F.filter(name, lambda step: step["first"] <= here)
        latest = F.when(F.col(name).isNotNull(), F.try_element_at(passed, F.lit(-1))["text"])
        return F.coalesce(latest, f"{name}_before", F.lit("")).alias(f"{name}_seen")

    return columns.join(slices, SLICE).select(
        "event_id", "user_id", "first_event", F.col("ts").alias("last_event"), seen("countries"), seen("hours")
    )


def baseline_resources(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Resources in each user's first ``baseline_events`` events.

    The rank limit is applied on both sides of the shuffle, so a task sends at most that many rows per user.
    """
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    early = events.select("user_id", "resource", "ts", "event_id").withColumn("ordinal", position)
    return (
        early.filter(F.col("ordinal") <= policy.baseline_events)
        .groupBy("user_id", "resource")
        .agg(F.min("ordinal").cast("long").alias("first_ordinal"), F.count("*").alias("uses"))
    )


def event_ordinals(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return with_ordinal(events.select("event_id", "ts", "user_id"), policy).select("event_id", "user_id", "ordinal", "user_events")
