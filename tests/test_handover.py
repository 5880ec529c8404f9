"""A run that goes on from an earlier run's state, or from a log, gives what one run over all gives."""

from datetime import timedelta

import pytest
from events import row
from pyspark.sql import functions as F
from test_epochs import in_files
from test_stream_rules import random_log
from test_streaming import same, write_files

from gatelens.plans import stream_rules
from gatelens.session import run_dir
from gatelens.streaming import epochs, jobs, replay

SHORT = timedelta(seconds=1)


@pytest.fixture(scope="module")
def log():
    return sorted(random_log(21, 300), key=lambda r: (r["ts"], r["event_id"]))


def flood(n):
    """A failure every five seconds: each part of the log begins in the middle of a burst, and of a minute that has fired."""
    rows = [row(f"2024-03-04 00:{s // 60:02d}:{s % 60:02d}", "failed", "Russia", "database") for s in range(0, 5 * n, 5)]
    return [{**r, "event_id": k} for k, r in enumerate(rows)]


def kept_up(spark, folder):
    return [epochs.newest_events(spark, folder), epochs.newest_alerts(spark, folder), epochs.totals(spark, folder), epochs.report(spark, folder)]


def test_a_run_goes_on_from_another(spark, frame, log):
    """The log is cut between two times; a row at the time of the last settled one would be late (below)."""
    parts = log[:150], log[150:]
    assert parts[0][-1]["ts"] < parts[1][0]["ts"]
    whole = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, [log])))
    one = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, in_files(parts[0], 2)), max_files=1), delay=SHORT)
    two = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, in_files(parts[1], 2)), max_files=1), delay=SHORT, start=epochs.handed_over(spark, one))
    assert same(epochs.scored(spark, one).unionByName(epochs.scored(spark, two)), stream_rules.detect(frame(log)))
    assert epochs.set_aside(spark, two).count() == 0
    for a, b in zip(kept_up(spark, two), kept_up(spark, whole)):
        assert same(a, b)


def test_a_run_goes_on_from_a_log(spark, frame):
    rows = flood(60)
    history = epochs.from_history(frame(rows[:31]))
    folder = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, in_files(rows[31:], 3)), max_files=1), delay=SHORT, start=history)
    expected = stream_rules.detect(frame(rows))
    assert same(epochs.scored(spark, folder), expected.filter("event_id >= 31"))
    assert same(epochs.report(spark, folder), stream_rules.stream_summary(expected))
    # Minutes, the day, the country and the resource that had fired don't fire again.
    assert expected.filter("event_id >= 31 AND (suspicious_country OR off_hours)").count() == 0
    assert epochs.scored(spark, folder).filter("brute_force").count() == 2


def test_open_rows_are_settled_by_the_next_run(spark, frame):
    """A run that has only stopped still holds rows open; a restart of the next run adds nothing twice."""
    rows = flood(40)
    session, one, two = jobs.job_session(spark), run_dir(spark, "one"), run_dir(spark, "two")
    stream = lambda part: replay.log_stream(write_files(spark, frame, [part]))(session)
    replay.finish(epochs.write_epochs(stream(rows[:20]), one, f"{one}/checkpoint", delay=timedelta(seconds=30)))
    settled = epochs.scored(spark, one).count()
    assert settled < 20
    start = epochs.handed_over(spark, one)
    assert start["open"].count() == 20 - settled
    rest = write_files(spark, frame, [rows[20:]])
    for _ in range(2):
        events = replay.log_stream(rest)(session)
        replay.finish(epochs.write_epochs(events, two, f"{two}/checkpoint", delay=timedelta(seconds=30), start=start))
        done = epochs.scored(spark, one).unionByName(epochs.scored(spark, two))
        assert same(done, stream_rules.detect(frame(rows)).filter(F.col("event_id") < done.count()))
        assert done.count() == 33 and epochs.set_aside(spark, two).count() == 0


def test_rows_not_later_than_what_is_settled_are_late(spark, frame):
    rows = flood(10)
    again = [{**rows[9], "event_id": 50}, row("2024-03-04 00:05:00", event_id=51)]
    folder = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, [again])), start=epochs.from_history(frame(rows)))
    assert [r.event_id for r in epochs.scored(spark, folder).collect()] == [51]
    assert [(r.event_id, r.reason) for r in epochs.set_aside(spark, folder).collect()] == [(50, "late")]


def test_an_empty_log_is_no_history(spark, frame):
    rows = flood(12)
    nothing = frame(rows).limit(0)
    folder = epochs.run_epochs(spark, replay.log_stream(write_files(spark, frame, [rows])), start=epochs.from_history(nothing))
    assert same(epochs.scored(spark, folder), stream_rules.detect(frame(rows)))
    with pytest.raises(ValueError):
        epochs.handed_over(spark, run_dir(spark, "none"))
