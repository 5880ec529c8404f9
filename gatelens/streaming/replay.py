"""Running the streaming jobs over a finite table, as a replay or a backfill does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.plans.stream_rules import fired_alerts
from gatelens.schema import ALERT, RAW_EVENT
from gatelens.session import run_dir
from gatelens.sources.access_log import stream_access_log
from gatelens.sources.adapter import adapt
from gatelens.streaming import jobs


OpenStream = Callable[[SparkSession], DataFrame]


#: Files that a replay admits to a micro-batch.
MAX_FILES = 16


class LateEvents(RuntimeError):
    """A finite replay has left out rows that came after the watermark had passed them."""


def adapted_stream(folder: str, max_files: int = MAX_FILES) -> OpenStream:
    """The ``events`` test table of a folder as a stream of access events."""

    def open_stream(session: SparkSession) -> DataFrame:
        reader = session.readStream.schema(RAW_EVENT).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", max_files)
        return adapt(reader.parquet(folder))

    return open_stream


def log_stream(folder: str, max_files: int | None = MAX_FILES) -> OpenStream:
    """A folder of access-log files as a stream; ``max_files`` bounds a micro-batch."""
    return lambda session: stream_access_log(session, folder, max_files)


def _closing_row(session: SparkSession, schema: T.StructType) -> DataFrame:
    """A row far in the future. It is a failure, since a job's failure filter is applied before the watermark sees it."""
    values = {"ts": F.expr(f"TIMESTAMP_NTZ '{jobs.END_OF_REPLAY}'"), "status": F.lit("failed")}
    return session.range(1).select(
        *[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    )


def finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_to_end(
    session: SparkSession, events: DataFrame, start: Callable[[DataFrame], object], run: str, allow_late: bool = False
) -> int:
    """Run a job over all of a finite stream, then once more with a far-future row; returns the count of late rows.

    The watermark never passes a finite stream's last events by itself. The closing row, which must not come before
    any real row, moves it on; the second run continues from the first one's checkpoint. Rows that are further out of
    order than the job's delay are left out; unless ``allow_late``, that raises :class:`LateEvents`.
    """
    folder = f"{run}/closing"
    closing = _closing_row(session, events.schema)
    closing.limit(0).write.parquet(folder)
    both = events.unionByName(session.readStream.schema(events.schema).parquet(folder))
    watch = jobs.LateRows.watch(session)
    try:
        query = start(both)
        finish(query)
        watch.of(query)
        closing.write.mode("append").parquet(folder)
        query = start(both)
        finish(query)
        late = watch.of(query)
    finally:
        session.streams.removeListener(watch)
    if late and not allow_late:
        raise LateEvents(f"{late} rows came after the watermark had passed them; use a longer delay")
    return late


def run_detection(
    spark: SparkSession,
    open_stream: OpenStream,
    policy: Policy = DEFAULT_POLICY,
    delay: str = "10 minutes",
    allow_late: bool = False,
) -> str:
    """Run the detection job to its end; returns the run's folder, with the result below ``scored``."""
    session = jobs.job_session(spark)
    run = run_dir(spark, "detection")

    def start(events):
        return jobs.to_files(jobs.detect(events, policy, delay), f"{run}/scored", f"{run}/scored-checkpoint")

    run_to_end(session, open_stream(session), start, run, allow_late)
    return run


def late_events(log: DataFrame, scored: DataFrame) -> DataFrame:
    """The side table of a finished replay: the log's events that it has left out."""
    return log.join(scored.select("event_id"), "event_id", "left_anti")


def scored_table(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.parquet(f"{run}/scored")


def user_state(spark: SparkSession, run: str) -> DataFrame:
    """The users' state as the detection job left it, read from its checkpoint."""
    session = jobs.job_session(spark)
    state = session.read.format("statestore").option("stateVarName", "profile").load(f"{run}/scored-checkpoint")
    at = lambda name: F.timestamp_micros(f"user_map_value.{name}").cast("timestamp_ntz").alias(name.replace("_at", "_event"))
    joined = lambda name: F.array_join(f"user_map_value.{name}", ",").alias(name)
    return state.select(
        F.col("user_map_key.user_id").alias("user_id"),
        "user_map_value.events",
        at("first_at"),
        at("last_at"),
        joined("countries"),
        F.array_join(F.col("user_map_value.hours").cast("array<string>"), ",").alias("hours"),
        joined("baseline"),
        joined("recent"),
    )


def run_stream_events(spark: SparkSession, open_stream: OpenStream) -> DataFrame:
    """Pass events through the stream source and the file sink unchanged."""
    session = jobs.job_session(spark)
    run = run_dir(spark, "events")
    finish(jobs.to_files(open_stream(session), f"{run}/events", f"{run}/checkpoint"))
    return spark.read.parquet(f"{run}/events")


def run_slow_brute_force(spark: SparkSession, open_stream: OpenStream, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    session = jobs.job_session(spark)
    run = run_dir(spark, "slow")

    def start(events):
        return jobs.to_files(jobs.slow_brute_force(events, policy), f"{run}/alerts", f"{run}/checkpoint")

    run_to_end(session, open_stream(session), start, run)
    return spark.read.schema(ALERT).parquet(f"{run}/alerts")


def run_feed(
    spark: SparkSession, open_stream: OpenStream, role: str = "admin", policy: Policy = DEFAULT_POLICY, delay: str = "10 minutes"
) -> DataFrame:
    """Feed records of a finite stream."""
    session = jobs.job_session(spark)
    folder = run_dir(spark, "feed")

    def start(events):
        return jobs.write_feed(events, folder, f"{folder}/checkpoint", role, policy, delay)

    run_to_end(session, open_stream(session), start, folder)
    return jobs.stored(spark, f"{folder}/records", "event_id long, record string").drop("run", "epoch")


def run_outbox(spark: SparkSession, run: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Notifications of a detection run."""
    session = jobs.job_session(spark)
    schema = scored_table(session, run).schema
    scored = session.readStream.schema(schema).parquet(f"{run}/scored")
    folder = run_dir(spark, "outbox")
    finish(jobs.write_outbox(fired_alerts(scored, policy), f"{folder}/outbox", f"{folder}/checkpoint", policy))
    return jobs.stored(spark, f"{folder}/outbox", jobs.OUTBOX).drop("run", "epoch")


def run_alert_keys(spark: SparkSession, run: str, policy: Policy = DEFAULT_POLICY, span: str = "3650 days") -> DataFrame:
    """Distinct alerts of a detection run; with so long a span each key is kept to the end."""
    session = jobs.job_session(spark)
    schema = scored_table(session, run).schema
    scored = session.readStream.schema(schema).option("maxFilesPerTrigger", MAX_FILES).parquet(f"{run}/scored")
    folder = run_dir(spark, "keys")
    finish(jobs.to_files(jobs.alert_keys(scored, policy, span), f"{folder}/keys", f"{folder}/checkpoint"))
    return spark.read.schema("user_id string, alert_type string, key string").parquet(f"{folder}/keys")


def run_evidence(
    spark: SparkSession, run: str, open_stream: OpenStream, policy: Policy = DEFAULT_POLICY, delay: str = "10 minutes", max_files: int | None = None
) -> DataFrame:
    """The failures behind the brute-force alerts of a detection run; ``max_files`` of the run's files are admitted at a time.

    The join gives a match as soon as both sides have come, so no closing row is needed. Rows later than ``delay`` raise
    :class:`LateEvents`.
    """
    session = jobs.job_session(spark)
    reader = session.readStream.schema(scored_table(session, run).schema)
    scored = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(f"{run}/scored")
    folder = run_dir(spark, "evidence")
    watch = jobs.LateRows.watch(session)
    try:
        found = jobs.alert_evidence(scored, open_stream(session), policy, delay)
        query = jobs.to_files(found, f"{folder}/evidence", f"{folder}/checkpoint")
        finish(query)
        late = watch.of(query)
    finally:
        session.streams.removeListener(watch)
    if late:
        raise LateEvents(f"{late} rows came after the watermark had passed them; use a longer delay")
    return spark.read.schema(found.schema).parquet(f"{folder}/evidence")


def run_hourly_kpis(spark: SparkSession, run: str) -> DataFrame:
    """Running totals per hour of a detection run."""
    session = jobs.job_session(spark)
    schema = scored_table(session, run).schema
    scored = session.readStream.schema(schema).parquet(f"{run}/scored")
    folder = run_dir(spark, "hours")

    def start(rows):
        return jobs.to_files(jobs.hourly_kpis(rows), f"{folder}/hours", f"{folder}/checkpoint")

    run_to_end(session, scored, start, folder)
    return jobs.cumulative(spark.read.parquet(f"{folder}/hours"))
