"""Scans of the access log and of stored alert tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.schema import ACCESS_EVENT, ALERT, validate_schema


# How text formats write a log.
TEXT_OPTIONS = {"header": "true", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}


def _options(fmt: str) -> dict[str, str]:
    return TEXT_OPTIONS if fmt in ("csv", "json") else {}


TEXT_FORMATS = ("csv", "json")


def _as_text(spark: SparkSession, path: str, fmt: str, columns: dict[str, str]) -> DataFrame:
    """A text log with every column still text, by the names in its header or records."""
    if fmt == "csv":
        raw = spark.read.options(**TEXT_OPTIONS).csv(path)
    else:
        back = {new: old for old, new in columns.items()}
        names = [back.get(f.name, f.name) for f in ACCESS_EVENT.fields]
        raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).options(**TEXT_OPTIONS).json(path)
    return raw.withColumnsRenamed(columns)


def _numbered(log: DataFrame) -> DataFrame:
    """Adds an ``event_id`` that depends on the row's content alone; equal rows are told apart by their number."""
    digest = F.xxhash64(*[F.col(c) for c in sorted(log.columns)])
    keyed = log.withColumn("digest", digest)
    copy = F.row_number().over(Window.partitionBy("digest").orderBy(*sorted(log.columns)))
    return keyed.withColumn("event_id", F.xxhash64("digest", copy)).drop("digest")


def _checked_columns(log: DataFrame) -> None:
    missing = [f.name for f in ACCESS_EVENT.fields if f.name not in log.columns and f.name != "event_id"]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def load_access_log(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Access events, and the rows set aside: without user, time or id, or with text that can't be read.

    ``columns`` maps a log's names to those of ``ACCESS_EVENT``, ``{"timestamp": "ts"}`` for example. Types and names
    are those that the files have: a missing column or another type is an error, CSV goes by its header, further columns are
    left out. A log without ``event_id`` gets one; in Parquet from file and row, in other formats from the row's content.
    """
    columns = columns or {}
    if fmt in TEXT_FORMATS:
        raw = _as_text(spark, path, fmt, columns)
        _checked_columns(raw)
        raw = raw.select(*[f.name for f in ACCESS_EVENT.fields if f.name in raw.columns])
        # JSON has a column for each field asked for; one that no record fills isn't there.
        without_id = "event_id" not in raw.columns or fmt == "json" and raw.filter("event_id IS NOT NULL").isEmpty()
        parsed = parse_events(_numbered(raw.drop("event_id")) if without_id else raw)
        return accepted(parsed), quarantined(parsed)
    log = spark.read.format(fmt).load(path)
    if "event_id" not in map(lambda c: columns.get(c, c), log.columns):
        if fmt == "parquet":
            place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
            log = log.withColumn("event_id", place).withColumnsRenamed(columns)
        else:
            log = _numbered(log.withColumnsRenamed(columns))
    else:
        log = log.withColumnsRenamed(columns)
    log = validate_schema(log, ACCESS_EVENT).select(*ACCESS_EVENT.fieldNames())
    whole = F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("user_id").isNotNull()
    return log.filter(whole), log.filter(~whole)


def read_access_log(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: dict[str, str] | None = None
) -> DataFrame:
    """The access events of a log; :func:`load_access_log` also gives the rows set aside."""
    return load_access_log(spark, path, fmt, columns)[0]


def stream_access_log(spark: SparkSession, folder: str, max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """New files of a log folder as a stream. Arrival order does not matter to the jobs, only the watermark does."""
    reader = spark.readStream.schema(ACCESS_EVENT).format(fmt).options(**_options(fmt))
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def read_alerts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    stored = spark.read.schema(ALERT).format(fmt).options(**_options(fmt)).load(path)
    return stored.select(*ALERT.fieldNames())


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV access log with every column still text, for :func:`parse_events`."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in ACCESS_EVENT.fields])
    return spark.read.schema(text).options(**TEXT_OPTIONS).csv(path)


def parse_events(raw: DataFrame) -> DataFrame:
    """Type a text log. ``parse_ok`` is false on rows without a user or whose id, timestamp or score cannot be read."""
    typed = raw.select(
        *[
            F.col(f.name).try_cast(f.dataType).alias(f.name)
            if not isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in ACCESS_EVENT.fields
        ],
        F.col("ts").alias("ts_text"),
    )
    needed = [F.col(c).isNotNull() for c in ("event_id", "ts", "user_id", "risk_score")]
    return typed.withColumn("parse_ok", reduce(Column.__and__, needed))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("parse_ok").select(*ACCESS_EVENT.fieldNames())


def quarantined(parsed: DataFrame) -> DataFrame:
    """Rows to set aside for inspection, with the text that could not be read."""
    return parsed.filter("not parse_ok").drop("parse_ok")
