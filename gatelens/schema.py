"""Table schemas and the schema check applied to every input table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ``event_id`` (unique), ``ts`` and ``user_id`` are never null; ``sources.access_log.parse_events`` sets other rows aside.
ACCESS_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("scenario", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("first_event", T.TimestampNTZType()),
        T.StructField("last_event", T.TimestampNTZType()),
        T.StructField("country", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("max_risk_score", T.IntegerType()),
        T.StructField("event_count", T.LongType()),
    ]
)

# The raw event table the test adapter reads.
RAW_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df`` if it has every expected column with the expected type, else raise ``ValueError``."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in actual]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wrong = [
        f"{f.name} is {actual[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in expected.fields
        if actual[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"wrong column types: {'; '.join(wrong)}")
    return df
