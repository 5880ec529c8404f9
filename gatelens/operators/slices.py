"""Per-user ordering work, split by time so that one very active user never lands in one task.

The rules need, for every event, its position in the user's history and the user's failures around it. A plain
``Window.partitionBy("user_id")`` puts a user's whole history into one task. Here the window key is
``(user_id, slice)``, a slice being a fixed stretch of the time axis:

* counts over a time range need nothing but the neighbouring slice's edge, so failures close to an edge are copied
  across it ("halo" rows);
* running totals need one number per slice from all slices before it. These numbers come from a partial aggregate
  with one row per user and active slice, and are joined back on ``(user_id, slice)``, the partitioning that the window
  already has.

Ordering is always ``(ts, event_id)``, which is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.predicates import is_failed
from gatelens.functions.timeparts import elapsed_seconds, seconds, slice_start

SLICE = ["user_id", "slice"]


def in_slice_order():
    return Window.partitionBy(*SLICE).orderBy("ts", "event_id")


def with_slice(df: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return df.withColumn("slice", slice_start("ts", policy.slice_seconds))


def with_history(per_slice: DataFrame) -> DataFrame:
    """Adds ``events_before`` the slice and ``user_events`` in all to rows per user and slice with ``slice_events``."""
    by_user = Window.partitionBy("user_id")
    before = by_user.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.withColumns(
        {
            "events_before": F.coalesce(F.sum("slice_events").over(before), F.lit(0)),
            "user_events": F.sum("slice_events").over(by_user),
        }
    )


def slice_history(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """One row per user and active slice: ``slice_events``, ``events_before`` the slice and ``user_events`` in all."""
    counts = with_slice(events.select("user_id", "ts"), policy).groupBy(*SLICE).agg(F.count("*").alias("slice_events"))
    return with_history(counts)


def with_ordinal(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``ordinal`` (1-based position in the user's history), ``user_events`` (its length) and ``slice``."""
    ranked = with_slice(events, policy).withColumn("rank_in_slice", F.row_number().over(in_slice_order()))
    return (
        ranked.join(slice_history(events, policy), SLICE)
        .withColumn("ordinal", F.col("rank_in_slice") + F.col("events_before"))
        .drop("rank_in_slice", "events_before", "slice_events")
    )


def with_recent_failures(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``trailing_failures``: the user's failures up to this event, not older than ``burst_seconds``.

    "Up to" is by ``(ts, event_id)``: of several events at one instant, later ids do not count for earlier ones. The
    count is failures so far minus failures that are already too old; both are running sums, so the cost per event does
    not depend on how many failures the range holds. Also adds ``slice`` and ``rank_in_slice``.
    """
    edge = F.col("home") + seconds(policy.slice_seconds)
    reaches_next = is_failed() & (F.col("ts") >= edge - seconds(policy.burst_seconds))
    copied = (
        events.withColumn("home", slice_start("ts", policy.slice_seconds))
        .withColumn("slice", F.explode(F.when(reaches_next, F.array("home", edge)).otherwise(F.array("home"))))
        .withColumn("own", F.col("slice") == F.col("home"))
        .withColumn("failure", F.when(is_failed(), 1).otherwise(0))
    )
    so_far = in_slice_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    too_old = F.expr(
        "sum(failure) OVER (PARTITION BY user_id, slice ORDER BY ts"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '{policy.burst_seconds}.000001' SECOND PRECEDING)"
    )
    return (
        copied.withColumn("rank_in_slice", F.sum(F.col("own").cast("long")).over(so_far))
        .withColumn("failures_so_far", F.sum("failure").over(so_far))
        .withColumn("failures_too_old", F.coalesce(too_old, F.lit(0)))
        .filter("own")
        .withColumn("trailing_failures", F.col("failures_so_far") - F.col("failures_too_old"))
        .drop("home", "own", "failure", "failures_so_far", "failures_too_old")
    )


def with_previous_failure(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Failures with ``previous_ts``, the user's failure before, and ``gap_seconds`` since then."""
    failures = with_slice(events.filter(is_failed()), policy)
    last = failures.groupBy(*SLICE).agg(F.max("ts").alias("slice_last"))
    carried = last.select(
        *SLICE, F.lag("slice_last").over(Window.partitionBy("user_id").orderBy("slice")).alias("carried_ts")
    )
    return (
        failures.withColumn("lag_ts", F.lag("ts").over(in_slice_order()))
        .join(carried, SLICE)
        .withColumn("previous_ts", F.coalesce("lag_ts", "carried_ts"))
        .withColumn("gap_seconds", elapsed_seconds(F.col("previous_ts"), F.col("ts")).cast("double"))
        .drop("lag_ts", "carried_ts", "slice")
    )
