"""Bursts: counting failures ahead of each failure, and the greedy choice of non-overlapping burst windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.predicates import is_failed
from gatelens.functions.timeparts import elapsed_seconds, seconds, slice_start
from gatelens.operators import walks


def failure_moments(events: DataFrame) -> DataFrame:
    """Failures folded to one row per user and instant, with what an alert needs to know about them."""
    return (
        # Later joins would add the null checks to some branches only, and these could not share this scan.
        events.filter(is_failed() & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .groupBy("user_id", "ts")
        .agg(
            F.count("*").alias("failures"),
            F.max("risk_score").alias("max_risk"),
            F.min(F.struct("event_id", "country", "resource")).alias("first"),
        )
    )


def burst_windows(moments: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds what lies in the closed range from each moment to ``burst_seconds`` later.

    ``window_failures``, ``window_last`` (time of the last failure) and ``window_max_risk``. The axis is cut into cells
    as long as the range, so a range covers the rest of its own cell and the beginning of the next one. Each moment is
    therefore copied into the cell before its own, and every value is a running aggregate inside a cell: sums as a
    difference of two running sums, the maximum as the larger of a maximum from the cell's end and one from the next
    cell's start. No frame is scanned twice, however dense the failures are.
    """
    reach = policy.burst_seconds
    copied = (
        moments.withColumn("home", slice_start("ts", reach))
        .withColumn("cell", F.explode(F.array("home", F.col("home") - seconds(reach))))
        .withColumn("own", F.col("cell") == F.col("home"))
        .withColumn("own_risk", F.when(F.col("own"), F.col("max_risk")))
        .withColumn("next_risk", F.when(~F.col("own"), F.col("max_risk")))
    )
    up_to = "OVER (PARTITION BY user_id, cell ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND"
    until_end = f"{up_to} INTERVAL '{reach}' SECOND FOLLOWING)"
    before_start = f"{up_to} INTERVAL '0.000001' SECOND PRECEDING)"
    from_cell_end = Window.partitionBy("user_id", "cell").orderBy(F.desc("ts"))
    return (
        copied.withColumn("failures_until_end", F.expr(f"sum(failures) {until_end}"))
        .withColumn("failures_before", F.coalesce(F.expr(f"sum(failures) {before_start}"), F.lit(0)))
        .withColumn("window_last", F.expr(f"max(ts) {until_end}"))
        .withColumn("next_max", F.expr(f"max(next_risk) {until_end}"))
        .withColumn("own_max", F.max("own_risk").over(from_cell_end))
        .filter("own")
        .withColumn("window_failures", F.col("failures_until_end") - F.col("failures_before"))
        .withColumn("window_max_risk", F.greatest("own_max", "next_max"))
        .drop("home", "cell", "own", "own_risk", "next_risk", "failures_until_end", "failures_before", "own_max", "next_max")
    )


#: Stretches whose functions are composed, each of several of the one before. A user's months are the last level.
DAY, MONTH = 86_400, 32 * 86_400
_CAME = "user_id string, slice timestamp_ntz, came_with long"
_STEPS = "user_id string, slice timestamp_ntz, starts array<long>, lasts array<long>, rest long"


def pick_bursts(anchors: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The anchors taken by a greedy walk; ``anchors`` has distinct ``(user_id, ts)`` and any further columns.

    Walking through a user's anchors in time order, an anchor is taken when it lies more than ``burst_seconds`` after
    the last one taken. The anchors are cut into time slices, and a slice is walked on its own if none of the user's
    anchors lies within ``burst_seconds`` before its first one: the walk starts afresh there. Only where bursts run on from
    slice to slice does the walk depend on where it comes from. Each of these slices is turned into a function (see ``walks``),
    functions are composed per day and month, and what comes in is handed down again: to months, days and slices. Each
    step is linear in the anchors; no row or group holds more than a slice's anchors or a month's functions, whose size
    is that of ``burst_seconds`` of anchors.
    """
    reach = policy.burst_seconds * 1_000_000
    slice_seconds = policy.slice_seconds
    placed = anchors.withColumn("slice", slice_start("ts", slice_seconds)).filter(F.col("slice").isNotNull())
    by_user = Window.partitionBy("user_id").orderBy("slice")
    within = F.lit(policy.burst_seconds)
    # All columns, here and for the functions below: then every branch has the same plan up to here and is computed once.
    whole = F.struct("ts", *[c for c in anchors.columns if c not in ("user_id", "ts")])
    spans = placed.groupBy("user_id", "slice").agg(F.min(whole).alias("first"), F.max("ts").alias("last_ts"))
    spans = spans.withColumn("first_ts", F.col("first.ts")).select(
        "user_id",
        "slice",
        F.coalesce(elapsed_seconds(F.lag("last_ts").over(by_user), F.col("first_ts")) <= within, F.lit(False)).alias("runs_in"),
        F.coalesce(elapsed_seconds(F.col("last_ts"), F.lead("first_ts").over(by_user)) <= within, F.lit(False)).alias("runs_on"),
    )
    joined = spans.filter("runs_in OR runs_on").select("user_id", "slice")

    def function(rows: pd.DataFrame) -> pd.DataFrame:
        starts, lasts, rest = walks.of_slice(np.sort(walks.micros(rows["ts"])), int(walks.micros(rows["slice"][:1])[0]), reach)
        return pd.DataFrame({"user_id": rows["user_id"][:1], "slice": rows["slice"][:1], "starts": [starts], "lasts": [lasts], "rest": pd.array([rest], "Int64")})

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        made = reduce(lambda a, b: walks.composed(a, b, reach), map(walks.steps_of, rows.itertuples()))
        return pd.DataFrame({"user_id": rows["user_id"][:1], "slice": rows["into"][:1], "starts": [made[0]], "lasts": [made[1]], "rest": pd.array([made[2]], "Int64")})

    def hand_down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        came = rows["came_with"].iloc[0]
        came, seen = None if pd.isna(came) else int(came), []
        for row in rows.itertuples():
            seen.append(came)
            came = walks.left_with(walks.steps_of(row), came, reach)
        return pd.DataFrame({"user_id": rows["user_id"], "slice": rows["slice"], "came_with": pd.array(seen, "Int64")})

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        came = rows["came_with"].iloc[0]
        return rows.iloc[walks.taken(walks.micros(rows["ts"]), None if pd.isna(came) else int(came), reach)]

    slices = placed.join(joined, ["user_id", "slice"]).groupBy("user_id", "slice").applyInPandas(function, _STEPS)
    into = lambda functions, width: functions.withColumn("into", slice_start("slice", width))
    by_day = into(slices, DAY)
    by_month = into(by_day.groupBy("user_id", "into").applyInPandas(compose, _STEPS), MONTH)
    months = by_month.groupBy("user_id", "into").applyInPandas(compose, _STEPS)
    came = months.withColumn("came_with", F.lit(None).cast("long")).groupBy("user_id").applyInPandas(hand_down, _CAME)
    for parts in (by_month, by_day):
        parents = came.select("user_id", F.col("slice").alias("into"), "came_with")
        came = parts.join(parents, ["user_id", "into"]).groupBy("user_id", "into").applyInPandas(hand_down, _CAME)
    walked = placed.join(came, ["user_id", "slice"], "left")
    return walked.groupBy("user_id", "slice").applyInPandas(take, walked.schema).select(*anchors.columns)


def within_bursts(rows: DataFrame, bursts: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Rows (``user_id``, ``ts``, ...) that lie in one of ``bursts`` (``user_id``, ``burst_start``).

    A burst covers at most two cells of ``burst_seconds``, so the range condition becomes an equality on the cell.
    """
    reach = seconds(policy.burst_seconds)
    placed = bursts.withColumn("first_cell", slice_start("burst_start", policy.burst_seconds)).select(
        "user_id", "burst_start", F.explode(F.array("first_cell", F.col("first_cell") + reach)).alias("cell")
    )
    return (
        rows.withColumn("cell", slice_start("ts", policy.burst_seconds))
        .join(placed, ["user_id", "cell"])
        .filter((F.col("ts") >= F.col("burst_start")) & (F.col("ts") <= F.col("burst_start") + reach))
        .drop("cell")
    )
