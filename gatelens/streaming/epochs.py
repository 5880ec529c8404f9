"""Detection by epochs: each micro-batch is settled by the window form of the rules.

What a batch settles goes through the operators of ``stream_rules.detect``, which split a user's events by time slice. So a user with
a third of all events is no more than many slices, and no Python runs beside the data. What the next batch needs is
stored by epoch: open rows that wait for the watermark, the last minutes' events, event counts by user, and the keys that have
fired. Counts and keys are stored as what an epoch adds, and as a whole in every ``WHOLE_EVERY``-th epoch; keys of past days are
left out there, since no event of theirs can come. Every table of a repeated epoch replaces its own folder, and an epoch reads
only earlier ones, so a retry or a restart adds nothing twice.

The same query writes what it doesn't take, with a reason, to a table of its own: rows without id, time or user, or that a parser has
marked (``unreadable``), and rows from before the watermark (``late``). Accepted and set-aside rows together are the input.

Beside that each epoch keeps up what a dashboard shows: the newest events and alerts, by merging an epoch's own newest with those before,
and alert counts by user and rule, from which totals, alerted users and the closing report can be read at any time.

A run may go on from what has come before (``start``): :func:`handed_over` gives the state of an earlier run, :func:`from_history` makes it
from a log. Without it a new checkpoint is a new run that knows nothing.

Compared with the keyed state of ``processor.py``: an epoch costs a pass over counts and keys, so batches should be large.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens import config
from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions.timeparts import seconds
from gatelens.plans.stream_rules import CONTEXT, FLAGS, Before, detect, fired_alerts, first_per_key, summary_of, tail_seconds
from gatelens.schema import ACCESS_EVENT
from gatelens.session import run_dir
from gatelens.streaming import jobs, replay

WHOLE_EVERY = 10
NEWEST_EVENTS, NEWEST_ALERTS = 100, 50
END = datetime.fromisoformat(jobs.END_OF_REPLAY)

OPEN = "event_id long, ts timestamp_ntz, user_id string, ip_address string, country string, status string, resource string"
COUNTS, KEYS, MARK = "user_id string, events long", "user_id string, rule string, key string", "mark timestamp_ntz"
ALERTS = "user_id string, alert_type string, n long"
EVENT_LINE = "event_id long, ts timestamp_ntz, user_id string, country string, resource string, status string"
ALERT_LINE = "event_id long, ts timestamp_ntz, user_id string, alert_type string, country string, resource string, score int, detail string, rule_order int"
STATE = {
    "open": OPEN, "tail": OPEN, "counts": COUNTS, "keys": KEYS, "alerts": ALERTS, "newest_events": EVENT_LINE, "newest_alerts": ALERT_LINE, "mark": MARK,
}
SET_ASIDE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ACCESS_EVENT.fields) + ", ts_text string, reason string"


class Epochs:
    """The tables of one run, by epoch."""

    def __init__(self, folder: str, run: str, policy: Policy, delay: timedelta):
        self.folder, self.run, self.policy, self.delay = folder, run, policy, delay
        self.started = False

    def begin(self, spark: SparkSession, start: dict[str, DataFrame] | None) -> None:
        """Store the state that the run goes on from, once for the life of its checkpoint; the mark, which comes last, tells that it's whole."""
        path = f"{self.folder}/start/mark/run={self.run}"
        self.started = jobs.exists(spark, path) and not spark.read.schema(MARK).parquet(path).isEmpty()
        if start is not None and not self.started:
            for table, schema in STATE.items():
                columns = spark.createDataFrame([], schema).columns
                start[table].select(*columns).write.mode("overwrite").parquet(f"{self.folder}/start/{table}/run={self.run}")
            self.started = True

    def _read(self, spark: SparkSession, table: str, schema: str, first: int, last: int) -> DataFrame:
        if last < max(first, 0):
            if self.started:  # before the first epoch
                return spark.read.schema(schema).parquet(f"{self.folder}/start/{table}/run={self.run}")
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*(f"{self.folder}/{table}/run={self.run}/epoch={k}" for k in range(max(first, 0), last + 1)))

    def _added(self, spark: SparkSession, table: str, schema: str, epoch: int) -> DataFrame:
        """What all epochs before ``epoch`` have added."""
        return self._read(spark, table, schema, (epoch - 1) // WHOLE_EVERY * WHOLE_EVERY, epoch - 1)

    def _store(self, rows: DataFrame, table: str, epoch: int) -> None:
        jobs._store(rows, f"{self.folder}/{table}", self.run, epoch)

    def settle(self, batch: DataFrame, epoch: int) -> None:
        """Take a micro-batch: set rows aside, keep the others open, and detect on those that the watermark has passed."""
        spark = batch.sparkSession
        found = self._read(spark, "mark", MARK, epoch - 1, epoch - 1).first()
        mark = found and found.mark
        needed = F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("user_id").isNotNull()
        readable = needed & F.coalesce(F.col("parse_ok"), F.lit(False)) if "parse_ok" in batch.columns else needed
        # The row that closes a finite replay moves the watermark, and nothing else.
        real = batch.filter(F.coalesce(F.col("ts") < F.lit(END), F.lit(True)))
        judged = real.withColumn("reason", F.when(~readable, "unreadable").when(F.lit(False) if mark is None else F.col("ts") < F.lit(mark), "late"))
        for name, kind in (("ts_text", "string"), *((f.name, f.dataType) for f in ACCESS_EVENT.fields)):
            if name not in judged.columns:
                judged = judged.withColumn(name, F.lit(None).cast(kind))
        self._store(judged.filter("reason IS NOT NULL").select(*ACCESS_EVENT.fieldNames(), "ts_text", "reason"), "set_aside", epoch)

        waiting = self._read(spark, "open", OPEN, epoch - 1, epoch - 1)
        waiting = waiting if mark is None else waiting.filter(F.col("ts") >= F.lit(mark))
        self._store(waiting.unionByName(judged.filter("reason IS NULL").select(*CONTEXT)), "open", epoch)
        latest = batch.filter(readable | (F.col("ts") >= F.lit(END))).agg(F.max("ts")).first()[0]
        mark = max((m for m in (mark, latest and latest - self.delay) if m is not None), default=None)

        closed = self._read(spark, "open", OPEN, epoch, epoch)
        closed = closed.filter(F.col("ts") < F.lit(mark)) if mark is not None else closed.limit(0)
        tail, counts, keys = self._read(spark, "tail", OPEN, epoch - 1, epoch - 1), self._added(spark, "counts", COUNTS, epoch), self._added(spark, "keys", KEYS, epoch)
        counts = counts.groupBy("user_id").agg(F.sum("events").alias("events"))
        self._store(detect(closed, self.policy, Before(tail, counts, keys)), "scored", epoch)

        self._keep_up(spark, epoch)

        # The mark may be far beyond the last event; a run that goes on from this one needs what that event leaves behind.
        last = self._read(spark, "newest_events", EVENT_LINE, epoch, epoch).agg(F.max("ts")).first()[0]
        edge = min((m for m in (mark, last) if m is not None), default=None)
        recent = closed.unionByName(tail)
        if edge is not None:
            recent = recent.filter(F.col("ts") >= F.lit(edge) - seconds(tail_seconds(self.policy)))
        self._store(recent, "tail", epoch)
        more = closed.groupBy("user_id").agg(F.count("*").alias("events"))
        new = first_per_key(closed, self.policy).select("user_id", "rule", "key").join(keys, ["user_id", "rule", "key"], "left_anti")
        if epoch % WHOLE_EVERY == 0:
            more = counts.unionByName(more).groupBy("user_id").agg(F.sum("events").alias("events"))
            new = keys.unionByName(new)
            if edge is not None:
                new = new.filter((F.col("rule") != config.OFF_HOURS) | (F.col("key") >= F.lit(edge.date().isoformat())))
        self._store(more, "counts", epoch)
        self._store(new, "keys", epoch)
        self._store(spark.createDataFrame([(mark,)], MARK), "mark", epoch)


    def _keep_up(self, spark: SparkSession, epoch: int) -> None:
        """The newest events and alerts after this epoch, and what it adds to the alert counts."""
        found = spark.read.parquet(f"{self.folder}/scored/run={self.run}/epoch={epoch}")
        alerts = fired_alerts(found, self.policy)
        for table, schema, rows, order, most in (
            ("newest_events", EVENT_LINE, found, ("ts", "event_id"), NEWEST_EVENTS),
            ("newest_alerts", ALERT_LINE, alerts, ("ts", "event_id", "rule_order"), NEWEST_ALERTS),
        ):
            before = self._read(spark, table, schema, epoch - 1, epoch - 1)
            self._store(before.unionByName(rows.select(*before.columns)).orderBy(*map(F.desc, order)).limit(most), table, epoch)
        more = alerts.groupBy("user_id", "alert_type").agg(F.count("*").alias("n"))
        if epoch % WHOLE_EVERY == 0:
            more = self._added(spark, "alerts", ALERTS, epoch).unionByName(more).groupBy("user_id", "alert_type").agg(F.sum("n").alias("n"))
        self._store(more, "alerts", epoch)


def write_epochs(
    events: DataFrame,
    folder: str,
    checkpoint: str,
    policy: Policy = DEFAULT_POLICY,
    delay: timedelta = timedelta(minutes=10),
    trigger=None,
    start: dict[str, DataFrame] | None = None,
):
    """Start the query: detected events go below ``folder/scored``, what isn't taken below ``folder/set_aside``.

    ``events`` are rows of a log, or of ``parse_events``, whose ``parse_ok`` and ``ts_text`` are used. ``start`` is the state to go on
    from; it is stored when the checkpoint is first used, and not looked at in a restart.
    """
    epochs = Epochs(folder, jobs.run_key(events.sparkSession, checkpoint), policy, delay)
    epochs.begin(events.sparkSession, start)
    return (
        events.writeStream.foreachBatch(epochs.settle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_epochs(
    spark: SparkSession,
    open_stream: replay.OpenStream,
    policy: Policy = DEFAULT_POLICY,
    delay: timedelta = timedelta(minutes=10),
    start: dict[str, DataFrame] | None = None,
) -> str:
    """Run the query over a finite stream to its end; returns the folder of its tables."""
    session = jobs.job_session(spark)
    folder = run_dir(spark, "epochs")
    replay.run_to_end(session, open_stream(session), lambda events: write_epochs(events, folder, f"{folder}/checkpoint", policy, delay, start=start), folder)
    return folder


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """What a run has detected."""
    schema = detect(spark.createDataFrame([], OPEN)).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return jobs.stored(spark, f"{folder}/scored", fields).drop("run", "epoch")


def set_aside(spark: SparkSession, folder: str) -> DataFrame:
    """What a run hasn't taken, with the reason."""
    return jobs.stored(spark, f"{folder}/set_aside", SET_ASIDE).drop("run", "epoch")


def _state(spark: SparkSession, folder: str) -> tuple[Epochs, int]:
    """The latest run's tables and its number of epochs that are settled."""
    last = jobs.stored(spark, f"{folder}/mark", MARK).agg(F.max(F.struct("epoch", "run"))).first()[0]
    epochs = Epochs(folder, last.run if last else "", DEFAULT_POLICY, timedelta())
    if last:
        epochs.begin(spark, None)
    return epochs, last.epoch + 1 if last else 0


def _after(newest: DataFrame) -> DataFrame:
    """The mark of a run that goes on after the newest settled event: what isn't later than it comes too late."""
    return newest.agg((F.max("ts") + F.expr("INTERVAL '0.000001' SECOND")).alias("mark"))


def handed_over(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What a run that has ended leaves to the one that goes on from it, ``start`` of :func:`write_epochs`.

    Rows that the run still held open are among it; the new run settles them. Totals, newest lines and the report go on, too. A
    later event than the run's last settled one is taken, even if the watermark had passed it.
    """
    epochs, n = _state(spark, folder)
    if n == 0:
        raise ValueError(f"no epoch of a run is settled in {folder}")
    state = {t: epochs._read(spark, t, schema, n - 1, n - 1) for t, schema in STATE.items() if t in ("tail", "newest_events", "newest_alerts")}
    state |= {t: epochs._added(spark, t, STATE[t], n) for t in ("counts", "keys", "alerts")}
    passed = epochs._read(spark, "mark", MARK, n - 1, n - 1).first().mark
    waiting = epochs._read(spark, "open", OPEN, n - 1, n - 1)
    state["open"] = waiting if passed is None else waiting.filter(F.col("ts") >= F.lit(passed))
    return state | {"mark": _after(state["newest_events"])}


def from_history(events: DataFrame, policy: Policy = DEFAULT_POLICY) -> dict[str, DataFrame]:
    """The state that a run over all ``events`` of a log would leave, by the window form; a stream of later events can go on from it."""
    rows = events.select(*CONTEXT).filter(F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.col("user_id").isNotNull())
    found = detect(rows, policy)
    alerts = fired_alerts(found, policy)
    newest = lambda table, *order: table.orderBy(*map(F.desc, order))
    last = rows.agg(F.max("ts")).first()[0]
    return {
        "open": rows.limit(0),
        "tail": rows.limit(0) if last is None else rows.filter(F.col("ts") >= F.lit(last) - seconds(tail_seconds(policy))),
        "counts": rows.groupBy("user_id").agg(F.count("*").alias("events")),
        "keys": first_per_key(rows, policy).select("user_id", "rule", "key"),
        "alerts": alerts.groupBy("user_id", "alert_type").agg(F.count("*").alias("n")),
        "newest_events": newest(found, "ts", "event_id").limit(NEWEST_EVENTS),
        "newest_alerts": newest(alerts, "ts", "event_id", "rule_order").limit(NEWEST_ALERTS),
        "mark": _after(rows),
    }


def newest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The newest events of a run that may still go on."""
    epochs, n = _state(spark, folder)
    return epochs._read(spark, "newest_events", EVENT_LINE, n - 1, n - 1)


def newest_alerts(spark: SparkSession, folder: str) -> DataFrame:
    epochs, n = _state(spark, folder)
    return epochs._read(spark, "newest_alerts", ALERT_LINE, n - 1, n - 1)


def per_user(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id``, ``events`` and the alerts of each rule so far, by the rules' flag names."""
    epochs, n = _state(spark, folder)
    counts = epochs._added(spark, "counts", COUNTS, n).groupBy("user_id").agg(F.sum("events").alias("events"))
    of_rule = [F.sum(F.when(F.col("alert_type") == rule, F.col("n"))).alias(flag) for rule, flag in FLAGS.items()]
    alerts = epochs._added(spark, "alerts", ALERTS, n).groupBy("user_id").agg(*of_rule)
    return counts.join(alerts, "user_id", "left").na.fill(0, list(FLAGS.values()))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row: ``events``, ``alerts`` and ``alerted_users`` so far."""
    own = sum((F.col(flag) for flag in FLAGS.values()), start=F.lit(0).cast("long"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in (F.col("events"), own, (own > 0).cast("long"))]
    return per_user(spark, folder).agg(*(c.alias(name) for c, name in zip(sums, ("events", "alerts", "alerted_users"))))


def report(spark: SparkSession, folder: str, top_users: int = 5) -> DataFrame:
    """The closing report as it stands now, from the counts by user."""
    return summary_of(per_user(spark, folder), top_users)
