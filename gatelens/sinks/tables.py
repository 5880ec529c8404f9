"""Writing alert tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gatelens.functions.timeparts import ts_text
from gatelens.sources.access_log import TEXT_OPTIONS


def write_alerts(alerts: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write the alert table and return the number of alerts; without alerts no data file is written.

    The rules run once: the rows are counted while they are written. Parquet is partitioned by alert type.
    """
    written = Observation()
    counted = alerts.observe(written, F.count(F.lit(1)).alias("n"))
    if fmt == "csv":
        counted.write.mode("errorifexists").options(**TEXT_OPTIONS).csv(path)
    else:
        counted.write.mode("errorifexists").partitionBy("alert_type").format(fmt).save(path)
    return written.get["n"]


def normalised_log(events: DataFrame) -> DataFrame:
    """The log with its time as ``yyyy-MM-dd HH:mm:ss`` text, in time order across and within files."""
    return (
        events.repartitionByRange("ts", "event_id")
        .sortWithinPartitions("ts", "event_id")
        .withColumn("ts", ts_text("ts"))
    )


def export_log(events: DataFrame, path: str) -> None:
    normalised_log(events).write.mode("errorifexists").options(**TEXT_OPTIONS).csv(path)


def alert_export(alerts: DataFrame, role: str) -> DataFrame:
    """The five exported columns; only admins may export."""
    if role != "admin":
        raise PermissionError("alert export needs the admin role")
    return alerts.select("alert_type", "user_id", "country", F.col("score"), "detail")


EXPORTED = "alert_type string, user_id string, country string, score int, detail string"


def write_alert_export(alerts: DataFrame, role: str, path: str) -> None:
    """The export as CSV files with a header, every value quoted."""
    alert_export(alerts, role).write.mode("errorifexists").options(**TEXT_OPTIONS, quoteAll="true").csv(path)


SKETCHES = "day date, kind string, users binary"


def write_user_sketches(sketches: DataFrame, path: str) -> None:
    """Daily sketches by day. The days written replace those of before, other days stay: a day can be added or made anew."""
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def read_user_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(path)
