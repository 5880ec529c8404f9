"""Streaming jobs: detection, feed, notifications and the daily slow-attack window.

Each job is its own query with its own checkpoint. A new checkpoint folder starts a new run: it has empty state and a key
of its own, under which it writes, so earlier runs' output stays. The outbox doesn't notify again what an earlier run has.
The size of a micro-batch is set by the source's admission options (``maxFilesPerTrigger`` and the like).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from datetime import timedelta
from threading import Event

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gatelens import config
from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.predicates import is_failed, is_high_risk
from gatelens.functions.numbers import percent_text
from gatelens.operators.alert_record import record_aggregates, to_alert
from gatelens.operators.running import with_running_totals
from gatelens.plans.feed import feed_records
from gatelens.plans.enrichment import INPUT
from gatelens.plans.outbox import render
from gatelens.plans.stream_rules import CONTEXT, EVIDENCE, FLAGS, alert_candidates, burst_evidence, contextual_score, n_alerts
from gatelens.session import ROCKSDB_PROVIDER
from gatelens.streaming.processor import OUTPUT, DetectionProcessor, FirstAlertProcessor

# Event time of the row that ends a finite replay; it lies after any real event and is never reported.
END_OF_REPLAY = "9999-01-01 00:00:00"

#: Users are dealt to so many lanes, the keys of the detection's state. The number is fixed for the life of a checkpoint.
LANES = 512
#: Stands for a null ``event_id`` where ids must be numbers: such an event comes last among those of its time.
NO_ID = (1 << 63) - 1


def job_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for streaming jobs, so the caller's settings stay as they are.

    Event time has to be a zoned timestamp for a watermark; with the zone fixed to UTC the zone-less times of the log
    keep their digits. The number of state partitions is fixed for the life of a checkpoint; if not given, it is the
    session's shuffle setting.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    return session


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    """Events with a zoned ``event_time`` under a watermark, without the row that ends a replay."""
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    # The condition is on the watermarked column, so it stays above the watermark, which must see the closing row.
    return timed.filter(F.col("event_time") < F.to_timestamp(F.lit(END_OF_REPLAY)))


def detect(events: DataFrame, policy: Policy = DEFAULT_POLICY, delay: str = "10 minutes", idle_ttl: timedelta | None = None) -> DataFrame:
    """Stream of scored events with one flag per rule that fires.

    ``idle_ttl``: how long after the last event a user's state is kept, in event time; without it, for ever. A user who comes
    back later counts as new: the ordinal starts at 1, and countries and resources fire again.
    """
    rows = with_event_time(events.select(*CONTEXT), delay).withColumns(
        {
            "at": F.unix_micros("event_time"),
            "event_id": F.coalesce("event_id", F.lit(NO_ID)),
            "lane": F.pmod(F.xxhash64("user_id"), F.lit(LANES)),
        }
    )
    # The operator leaves out late rows by the watermarked column, which must come with them.
    seen = rows.drop("ts").groupBy("lane").transformWithStateInPandas(
        statefulProcessor=DetectionProcessor(policy, idle_ttl and int(idle_ttl.total_seconds() * 1000)),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="EventTime",
    )
    return (
        seen.withColumn("event_id", F.nullif("event_id", F.lit(NO_ID)))
        .withColumn("ts", F.timestamp_micros("at").cast("timestamp_ntz"))
        .withColumn("score", contextual_score(policy))
        .drop("at")
    )


def alert_keys(scored: DataFrame, policy: Policy = DEFAULT_POLICY, span: str = "1 day") -> DataFrame:
    """Stream of distinct alerts, ``user_id``, ``alert_type`` and ``key``, by Spark's own deduplication: no Python, and state that goes by itself.

    Of a key's events any one may be the first to arrive, so only what they share is given. A key is kept for ``span`` after its first
    event, and rows may be late by as much: a day covers the rules whose key is a minute or a day; a country that
    comes up again after a longer time is an alert again.
    """
    keys = ["user_id", "alert_type", "key"]
    return with_event_time(alert_candidates(scored, policy), span).dropDuplicatesWithinWatermark(keys).select(*keys)


def alert_evidence(scored: DataFrame, events: DataFrame, policy: Policy = DEFAULT_POLICY, delay: str = "10 minutes") -> DataFrame:
    """Stream of the failures behind each brute-force alert: an interval join of a detection run's stream with that of the log.

    Both sides have a watermark and a match lies within ``burst_seconds``, so a failure's state goes once the slower side's watermark
    has passed it by that much, and an alert's once it has passed the alert.
    """
    fired = with_event_time(scored, delay).filter(FLAGS[config.BRUTE_FORCE])
    alerts = fired.select("user_id", F.col("event_id").alias("alert_id"), F.col("ts").alias("fired_at"), F.col("event_time").alias("alert_time"))
    failures = with_event_time(events.select(*CONTEXT), delay).filter(is_failed())
    # The range once more on the watermarked columns, from which Spark finds how long state is needed.
    reach = F.col("alert_time") - F.expr(f"INTERVAL '{policy.burst_seconds}' SECOND")
    near = (F.col("event_time") >= reach) & (F.col("event_time") <= F.col("alert_time"))
    return burst_evidence(alerts, failures, policy).filter(near).select(*EVIDENCE)


def slow_brute_force(events: DataFrame, policy: Policy = DEFAULT_POLICY, delay: str = "10 minutes") -> DataFrame:
    """The slow brute-force rule as a tumbling day window that reports once the day is closed."""
    failures = with_event_time(events, delay).filter(is_failed())
    records = (
        failures.groupBy(F.window("event_time", "1 day"), "user_id")
        .agg(*record_aggregates())
        .filter(F.col("event_count") > policy.daily_failures_over)
        .withColumn("day", F.to_date("window.start"))
    )
    detail = F.concat(
        F.col("event_count").cast("string"),
        F.lit(" failures spread over "),
        F.col("day").cast("string"),
    )
    return to_alert(records, config.SLOW_BRUTE_FORCE, detail)


def hourly_kpis(scored: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events and alerts per closed hour; :func:`cumulative` turns the stored hours into running totals."""
    return (
        with_event_time(scored, delay)
        .groupBy(F.window("event_time", "1 hour").alias("hour"))
        .agg(F.count("*").alias("events"), F.sum(n_alerts()).alias("alerts"))
        .select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "events", "alerts")
    )


def cumulative(hours: DataFrame) -> DataFrame:
    """Running totals and alert rate over stored hours; one row per hour, so a single ordered pass is enough."""
    so_far = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    total_events, total_alerts = F.sum("events").over(so_far), F.sum("alerts").over(so_far)
    return hours.select(
        "hour",
        "events",
        "alerts",
        total_events.alias("total_events"),
        total_alerts.alias("total_alerts"),
        percent_text(total_alerts, total_events).alias("rate"),
    )


class LateRows(StreamingQueryListener):
    """Counts, over all batches of a session's queries, the rows left out since they came after the watermark had passed them."""

    def __init__(self):
        self._dropped: dict[str, int] = defaultdict(int)
        self._ended: dict[str, Event] = defaultdict(Event)

    @classmethod
    def watch(cls, session: SparkSession) -> LateRows:
        listener = cls()
        session.streams.addListener(listener)
        return listener

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._dropped[str(progress.id)] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def of(self, query, seconds: float = 60) -> int:
        """The count of a query that has ended, with those of its earlier runs from the same checkpoint."""
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError("the query's last progress hasn't been reported")
        return self._dropped[str(query.id)]


def to_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start appending a stream to a parquet table, each row exactly once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_key(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint folder belongs to, made when the folder is first used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run-key")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path)
        out.writeBytes(uuid.uuid4().hex)
        out.close()
    source = files.open(path)
    try:
        return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source).decode()
    finally:
        source.close()


def _store(rows: DataFrame, folder: str, run: str, epoch: int) -> None:
    """Write one epoch's rows. A repeated epoch replaces its own folder, so a retry adds nothing twice."""
    rows.write.mode("overwrite").parquet(f"{folder}/run={run}/epoch={epoch}")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What all runs have written below ``folder``, with ``run`` and ``epoch``."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{schema}, run string, epoch long")
    return spark.read.schema(f"{schema}, run string, epoch long").option("basePath", folder).parquet(folder)


OUTBOX = (
    "event_id long, user_id string, alert_type string, severity string, score int, timestamp string, subject string,"
    " body_text string, body_html string"
)


def write_outbox(alerts: DataFrame, folder: str, checkpoint: str, policy: Policy = DEFAULT_POLICY, trigger=None):
    """Append notifications for alerts whose user and rule were not notified before, in this run or an earlier one.

    What this run has notified is keyed state; what earlier runs have is listed once, when the job starts.
    """
    session = alerts.sparkSession
    run, keys = run_key(session, checkpoint), ["user_id", "alert_type"]
    earlier = f"{checkpoint}/notified-before"
    stored(session, folder, OUTBOX).filter(F.col("run") != run).select(*keys).distinct().write.mode("overwrite").parquet(earlier)
    columns = alerts.filter(is_high_risk(policy, "score")).select("event_id", *INPUT)
    first = columns.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FirstAlertProcessor(), outputStructType=columns.schema, outputMode="append", timeMode="None"
    )

    def notify(batch: DataFrame, epoch: int) -> None:
        sent = batch.sparkSession.read.schema("user_id string, alert_type string").parquet(earlier)
        _store(render(batch.join(sent, keys, "left_anti"), policy), folder, run, epoch)

    return (
        first.writeStream.foreachBatch(notify)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_feed(
    events: DataFrame, folder: str, checkpoint: str, role: str = "admin", policy: Policy = DEFAULT_POLICY, delay: str = "10 minutes", trigger=None
):
    """Detect, and append one JSON record per event with totals that run on from batch to batch.

    A batch of the detection query holds all events between two watermarks, however the input was admitted, so it comes
    wholly after the batches before it. Totals are stored cumulated, so a batch reads those of the one before only.
    """
    session = events.sparkSession
    run = run_key(session, checkpoint)
    sums = "events long, alerts long"

    def publish(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        counted = batch.withColumn("one", F.lit(1)).withColumn("event_alerts", n_alerts()).persist()
        try:
            n, alerts = counted.agg(F.count("*"), F.coalesce(F.sum("event_alerts"), F.lit(0))).first()
            before = (0, 0) if epoch == 0 else own.read.schema(sums).parquet(f"{folder}/totals/run={run}/epoch={epoch - 1}").first()
            running = (
                with_running_totals(counted, {"total_events": "one", "total_alerts": "event_alerts"})
                .withColumn("total_events", F.col("total_events") + F.lit(before[0]))
                .withColumn("total_alerts", F.col("total_alerts") + F.lit(before[1]))
                .withColumn("rate", percent_text(F.col("total_alerts"), F.col("total_events")))
            )
            _store(feed_records(running, role, policy), f"{folder}/records", run, epoch)
            _store(own.createDataFrame([(before[0] + n, before[1] + alerts)], sums), f"{folder}/totals", run, epoch)
        finally:
            counted.unpersist()

    return (
        detect(events, policy, delay).writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
