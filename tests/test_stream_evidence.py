"""The failures behind stream alerts: window form against a plain search, and the stream's interval join against the window form."""

import random

import pytest
from events import at, row
from test_epochs import in_files
from test_stream_rules import random_log
from test_streaming import same, write_files

from gatelens.config import BRUTE_FORCE, DEFAULT_POLICY
from gatelens.plans import stream_rules
from gatelens.streaming import replay


def plain(log, alerts):
    found = []
    for a in alerts:
        for r in log:
            gap = (a.ts - r["ts"]).total_seconds()
            counted = 0 < gap <= DEFAULT_POLICY.burst_seconds or gap == 0 and r["event_id"] <= a.event_id
            if r["user_id"] == a.user_id and r["status"] == "failed" and counted:
                found.append((a.event_id, r["event_id"]))
    return sorted(found)


def pairs(evidence):
    return sorted((r.alert_id, r.event_id) for r in evidence.collect())


@pytest.fixture(scope="module")
def log():
    return random_log(31, 400)


def test_evidence_is_what_the_alert_has_counted(spark, frame, log):
    events = frame(log)
    alerts = stream_rules.stream_alerts(events, rules=(BRUTE_FORCE,)).collect()
    found = stream_rules.stream_evidence(events)
    assert alerts and pairs(found) == plain(log, alerts)
    behind = {r.alert_id: r["count"] for r in found.groupBy("alert_id").count().collect()}
    assert behind == {a.event_id: a.trailing_failures for a in alerts}


def test_closed_edges_and_ties(spark, frame):
    """The failure 120 seconds before counts, one a second earlier doesn't, nor does one at the alert's time with a larger id."""
    times = ["10:00:00", "10:00:01", "10:00:02", "10:00:03", "10:00:04", "10:00:05", "10:02:01", "10:02:01"]
    log = [row(t, "failed", event_id=k) for k, t in enumerate(times)] + [row("10:02:01", "failed", user="u2", event_id=50)]
    found = stream_rules.stream_evidence(frame(log))
    by_alert = {}
    for alert, event in pairs(found):
        by_alert.setdefault(alert, []).append(event)
    assert by_alert == {5: [0, 1, 2, 3, 4, 5], 6: [1, 2, 3, 4, 5, 6]}
    assert {r.fired_at for r in found.filter("alert_id = 6").collect()} == {at("10:02:01")}


def test_the_stream_gives_the_window_form(spark, frame, log):
    """In one batch, and file by file out of order within a long delay on both sides."""
    expected = stream_rules.stream_evidence(frame(log))
    shuffled = random.Random(2).sample(log, len(log))
    for rows, n, delay in ((log, 1, "10 minutes"), (shuffled, 4, "40 days")):
        stream = replay.log_stream(write_files(spark, frame, in_files(rows, n)), max_files=1)
        run = replay.run_detection(spark, stream, delay=delay)
        assert same(replay.run_evidence(spark, run, stream, delay=delay, max_files=1), expected)


def test_rows_behind_the_watermark_are_not_lost_unseen(spark, frame):
    """The log's stream brings an old failure after both watermarks have passed it."""
    burst = [row(f"10:00:0{k}", "failed", event_id=k) for k in range(7)]
    later = [row(f"11:00:0{k}", "failed", event_id=20 + k) for k in range(7)]
    old = [row("09:00:00", "failed", event_id=90)]
    in_order = replay.log_stream(write_files(spark, frame, [burst, later]), max_files=1)
    run = replay.run_detection(spark, in_order, delay="1 second")
    behind = replay.log_stream(write_files(spark, frame, [burst, later, later[-1:], old]), max_files=1)
    with pytest.raises(replay.LateEvents):
        replay.run_evidence(spark, run, behind, delay="1 second")


def test_a_hot_user_is_many_keys(spark, frame):
    """The join's keys hold the cell, so a user's failures of different times meet in different tasks."""
    plan = stream_rules.stream_evidence(frame([row("10:00:00", "failed")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "own_cell" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]
