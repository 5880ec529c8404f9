"""Running totals over the whole stream in ``(ts, event_id)`` order, without sorting it in one place.

Rows are totalled per second; seconds are summed up within their day and days among themselves (one row per day, the
only step without a partition key). The running total inside a second is a window over that second's rows only, so the
largest group is what arrives within one second, however much data there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelens.functions.timeparts import day_of, slice_start


def with_running_totals(rows: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Adds one running sum per entry of ``measures`` (new column -> summed column)."""
    placed = rows.withColumn("_second", slice_start("ts", 1)).withColumn("_day", day_of("ts"))
    # Stated here, the condition the joins imply is the same in every branch, so branches share their shuffles.
    placed = placed.filter(F.col("_second").isNotNull() & F.col("_day").isNotNull())
    sums = [F.sum(source).alias(name) for name, source in measures.items()]
    per_second = placed.groupBy("_day", "_second").agg(*sums)
    per_day = per_second.groupBy("_day").agg(*[F.sum(name).alias(name) for name in measures])

    earlier = (Window.unboundedPreceding, -1)
    seconds_before = Window.partitionBy("_day").orderBy("_second").rowsBetween(*earlier)
    days_before = Window.orderBy("_day").rowsBetween(*earlier)
    day_offsets = per_day.select(
        "_day", *[F.coalesce(F.sum(name).over(days_before), F.lit(0)).alias(f"_day_{name}") for name in measures]
    )
    offsets = per_second.join(day_offsets, "_day").select(
        "_second",
        *[
            (F.coalesce(F.sum(name).over(seconds_before), F.lit(0)) + F.col(f"_day_{name}")).alias(f"_before_{name}")
            for name in measures
        ],
    )
    # Rows at one position, such as an event and a marker for it, are summed together.
    in_second = Window.partitionBy("_second").orderBy("ts", "event_id")
    summed = placed.select("*", *[F.sum(source).over(in_second).alias(f"_in_{name}") for name, source in measures.items()])
    return summed.join(offsets, "_second").select(
        *rows.columns, *[(F.col(f"_before_{name}") + F.col(f"_in_{name}")).alias(name) for name in measures]
    )
