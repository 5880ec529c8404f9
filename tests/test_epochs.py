"""Detection by epochs gives the window form, splits a hot user, and loses no row."""

import random
from datetime import timedelta

import pytest
from events import row
from pyspark.sql import functions as F
from test_stream_rules import random_log
from test_streaming import same, write_files

from gatelens.functions.timeparts import slice_start
from gatelens.plans import stream_rules
from gatelens.session import run_dir
from gatelens.sources.access_log import parse_events
from gatelens.streaming import epochs, jobs, replay


@pytest.fixture(scope="module")
def log():
    return random_log(12, 400)


def in_files(rows, n):
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


def test_any_admission_gives_the_window_form(spark, frame, log):
    """In order with a short delay over more epochs than lie between two whole tables, and shuffled with a long delay."""
    ordered = sorted(log, key=lambda r: (r["ts"], r["event_id"]))
    expected = stream_rules.detect(frame(log))
    for rows, n, delay in ((ordered, 13, timedelta(seconds=1)), (random.Random(3).sample(log, len(log)), 3, timedelta(days=40))):
        folder = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, in_files(rows, n)), max_files=1), delay=delay)
        assert same(epochs.scored(spark, folder), expected)
        assert epochs.set_aside(spark, folder).count() == 0


def test_what_a_dashboard_shows_is_kept_up(spark, frame, log, monkeypatch):
    """After each epoch the newest lines are the newest of all that is settled; in the end totals and report are those of the window form."""
    monkeypatch.setattr(epochs, "NEWEST_EVENTS", 7)
    monkeypatch.setattr(epochs, "NEWEST_ALERTS", 5)
    ordered = sorted(log, key=lambda r: (r["ts"], r["event_id"]))
    folder = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, in_files(ordered, 3)), max_files=1), delay=timedelta(seconds=1))
    settled = [r.epoch for r in spark.read.parquet(f"{folder}/mark").select("epoch").orderBy("epoch").collect()]
    assert settled == list(range(4))
    for e in settled:
        rows = spark.read.parquet(f"{folder}/scored").filter(F.col("epoch") <= e)
        alerts = stream_rules.fired_alerts(rows).orderBy(F.desc("ts"), F.desc("event_id"), F.desc("rule_order")).limit(5).select("event_id", "alert_type")
        assert same(spark.read.parquet(f"{folder}/newest_alerts").filter(F.col("epoch") == e).select("event_id", "alert_type"), alerts)
        events = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(7).select("event_id")
        assert same(spark.read.parquet(f"{folder}/newest_events").filter(F.col("epoch") == e).select("event_id"), events)
    detected = stream_rules.detect(frame(log))
    assert same(epochs.report(spark, folder), stream_rules.stream_summary(detected))
    fired = stream_rules.fired_alerts(detected)
    assert tuple(epochs.totals(spark, folder).first()) == (len(log), fired.count(), fired.select("user_id").distinct().count())


def test_nothing_is_kept_before_the_first_epoch(spark):
    folder = run_dir(spark, "none")
    assert epochs.newest_events(spark, folder).count() == epochs.newest_alerts(spark, folder).count() == 0
    assert tuple(epochs.totals(spark, folder).first()) == (0, 0, 0)


def test_bursts_go_on_over_epochs(spark, frame):
    """A minute that has fired doesn't fire again in the next epoch, and failures of the epoch before count."""
    rows = [row(f"2024-03-04 10:{s // 60:02d}:{s % 60:02d}", "failed") for s in range(0, 240, 5)]
    rows = [{**r, "event_id": k} for k, r in enumerate(rows)]
    folder = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, in_files(rows, 8)), max_files=1), delay=timedelta(seconds=1))
    assert same(epochs.scored(spark, folder), stream_rules.detect(frame(rows)))
    assert epochs.scored(spark, folder).filter("brute_force").count() == 4


def test_late_and_unreadable_rows_are_set_aside_and_a_restart_adds_nothing(spark, frame):
    rows = [{**row(f"2024-03-04 {10 + k // 60:02d}:{k % 60:02d}:00", event_id=k)} for k in range(120)]
    late = [{**row("2024-03-04 09:00:00", event_id=500 + k)} for k in range(3)]
    broken = [{**row("2024-03-04 11:59:00", event_id=600), "user_id": None}, {**row("2024-03-04 11:59:00", event_id=601), "ts": None}]
    folder, out = write_files(spark, frame, [rows[:80]]), run_dir(spark, "sinks")
    session = jobs.job_session(spark)

    def go():
        stream = replay.log_stream(folder, max_files=1)(session)
        replay.finish(epochs.write_epochs(stream, out, f"{out}/checkpoint", delay=timedelta(minutes=5)))
        aside = epochs.set_aside(spark, out)
        return sorted(r.event_id for r in epochs.scored(spark, out).collect()), {r.reason: r["count"] for r in aside.groupBy("reason").count().collect()}

    taken, aside = go()
    assert taken == list(range(74)) and aside == {}  # up to the last time less the delay
    assert go() == (taken, aside)
    frame(rows[80:] + late + broken).coalesce(1).write.mode("append").parquet(folder)
    taken, aside = go()
    assert taken == list(range(114)) and aside == {"late": 3, "unreadable": 2}
    assert go() == (taken, aside)
    last = spark.read.parquet(f"{out}/open").filter("epoch = 1 AND ts >= TIMESTAMP_NTZ '2024-03-04 11:54:00'").count()
    assert len(taken) + last + sum(aside.values()) == len(rows) + len(late) + len(broken)


def test_a_parser_marks_unreadable_rows(spark):
    text = "event_id string, ts string, user_id string, ip_address string, country string, action string, status string, resource string, risk_score string, scenario string"
    lines = [("1", "2024-03-04 10:00:00", "u", "i", "Spain", "a", "success", "r", "5", "n"), ("2", "never", "u", "i", "Spain", "a", "success", "r", "5", "n"),
             ("3", "2024-03-04 10:00:01", "u", "i", "Spain", "a", "success", "r", "much", "n")]
    folder, out = run_dir(spark, "lines"), run_dir(spark, "sinks")
    spark.createDataFrame(lines, text).write.parquet(folder)
    session = jobs.job_session(spark)
    stream = parse_events(session.readStream.schema(text).parquet(folder))
    replay.finish(epochs.write_epochs(stream, out, f"{out}/checkpoint"))
    assert sorted((r.event_id, r.ts_text) for r in epochs.set_aside(spark, out).collect()) == [(2, "never"), (3, "2024-03-04 10:00:01")]
    assert spark.read.parquet(f"{out}/open").select("event_id").collect() == [(1,)]


def test_a_hot_user_is_many_slices(spark, frame):
    """With a third of all events of one user, no task has above three times the median's rows, as each event goes by user and slice."""
    rng = random.Random(5)
    hot = [row(f"2024-03-{d:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", user="hot") for d in range(1, 15) for _ in range(120)]
    rest = [row(f"2024-03-{d:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", user=f"u{rng.randrange(200)}") for d in range(1, 15) for _ in range(240)]
    events = frame(hot + rest)
    sizes = events.withColumn("slice", slice_start("ts", 3600)).repartition(16, "user_id", "slice").groupBy(F.spark_partition_id()).count()
    counts = sorted(r["count"] for r in sizes.collect())
    assert counts[-1] <= 3 * counts[len(counts) // 2]
