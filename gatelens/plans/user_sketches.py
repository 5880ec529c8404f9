"""Distinct users per day range from stored daily sketches, without going over the log again.

A day's users are folded to one theta sketch per kind: ``EVENT`` for all users with an event, ``ALERT`` for all with an alert, and
one per alert type. Sketches of days unite and intersect, which counts of days don't. A sketch holds at most ``2 ** LOG_ENTRIES``
hashes, so a day costs as much however many users it has, and the shuffle carries sketches, not users. Up to that many users a
count is exact; beyond, a union's relative standard error is ``1 / sqrt(2 ** LOG_ENTRIES - 1)``, 0.8 % here. An intersection's error
is that share of the union, so small overlaps of large days are less sure.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.timeparts import day_of

LOG_ENTRIES = 14
EVENT, ALERT = "EVENT", "ALERT"


def daily_sketches(events: DataFrame, alerts: DataFrame, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """``day``, ``kind`` and ``users`` (a sketch) of a log and its alerts. Rows without user or time count nowhere.

    Partial sketches are made where the rows are, so a day that holds a third of all rows is one sketch per task.
    """
    seen = events.select(day_of("ts").alias("day"), F.lit(EVENT).alias("kind"), "user_id")
    kinds = F.explode(F.array(F.lit(ALERT), F.col("alert_type"))).alias("kind")
    alerted = alerts.select(day_of("first_event").alias("day"), kinds, "user_id")
    known = seen.unionByName(alerted).filter(F.col("day").isNotNull() & F.col("user_id").isNotNull())
    return known.groupBy("day", "kind").agg(F.theta_sketch_agg("user_id", log_entries).alias("users"))


def _count(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch).alias("users")


def users_between(sketches: DataFrame, first: date, last: date, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """``kind`` and the distinct ``users`` from ``first`` to ``last``, both included; only these days' sketches are read."""
    days = sketches.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return days.groupBy("kind").agg(_count(F.theta_union_agg("users", log_entries)))


def trailing_users(sketches: DataFrame, days: int = 7, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """``day``, ``kind`` and the distinct ``users`` of the ``days`` days that end with it, for each day that has a sketch of the kind."""
    into = sketches.withColumn("into", F.explode(F.sequence("day", F.date_add("day", days - 1))))
    united = into.groupBy(F.col("into").alias("day"), "kind").agg(
        _count(F.theta_union_agg("users", log_entries)), F.max(F.col("day") == F.col("into")).alias("own")
    )
    return united.filter("own").drop("own")


def returning_users(sketches: DataFrame, after: int = 1) -> DataFrame:
    """``day``, ``kind`` and the ``users`` that also appear ``after`` days before; days without such a day are left out."""
    earlier = sketches.select(F.date_add("day", after).alias("day"), "kind", F.col("users").alias("before"))
    return sketches.join(earlier, ["day", "kind"]).select("day", "kind", _count(F.theta_intersection("users", "before")))
