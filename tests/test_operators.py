"""Running totals, lookups, frequency tables, profiles and exact ratios."""

import random
from datetime import timedelta

import pytest
from events import at, row
from pyspark.sql import functions as F

from gatelens.config import Policy
from gatelens.functions.numbers import percent, percent_text, ratio
from gatelens.operators.frequency import frequency, top
from gatelens.operators.lookups import materialised, on_watchlist
from gatelens.operators.running import with_running_totals
from gatelens.operators.slices import with_ordinal, with_previous_failure
from gatelens.plans import analytics, profiles


@pytest.fixture(scope="module")
def log():
    rng = random.Random(1)
    rows, ts = [], at("2024-03-04 21:00:00")
    for i in range(240):
        ts += timedelta(seconds=rng.choice([0, 0, 1, 40, 900, 7200]), microseconds=rng.choice([0, 0, 7]))
        rows.append(row(ts, rng.choice(["failed", "success"]), rng.choice(["Spain", "Iran", None]), "api", f"u{i % 3 // 2}", i % 101))
    return [{**r, "event_id": i} for i, r in enumerate(rng.sample(rows, len(rows)))]


def ordered(rows):
    return sorted(rows, key=lambda r: (r["ts"], r["event_id"]))


def test_running_totals(frame, log):
    expected, total = {}, 0
    for r in ordered(log):
        total += r["risk_score"]
        expected[r["event_id"]] = total
    got = with_running_totals(frame(log), {"so_far": "risk_score"}).collect()
    assert {r.event_id: r.so_far for r in got} == expected


def test_ordinals(frame, log):
    expected = {}
    for user in {r["user_id"] for r in log}:
        own = ordered(r for r in log if r["user_id"] == user)
        expected |= {r["event_id"]: (i + 1, len(own)) for i, r in enumerate(own)}
    got = with_ordinal(frame(log), Policy(slice_seconds=300)).collect()
    assert {r.event_id: (r.ordinal, r.user_events) for r in got} == expected


def test_previous_failure_reaches_over_empty_slices(frame, log):
    expected = {}
    for user in {r["user_id"] for r in log}:
        own = ordered(r for r in log if r["user_id"] == user and r["status"] == "failed")
        for before, r in zip([None, *own], own):
            gap = None if before is None else (r["ts"] - before["ts"]).total_seconds()
            expected[r["event_id"]] = (before and before["ts"], gap)
    got = with_previous_failure(frame(log), Policy(slice_seconds=240)).collect()
    assert {r.event_id: (r.previous_ts, r.gap_seconds) for r in got} == expected


def test_profile(frame, log):
    expected = {}
    for user in {r["user_id"] for r in log}:
        own = ordered(r for r in log if r["user_id"] == user)
        for i, r in enumerate(own):
            seen = own[: i + 1]
            countries = sorted({s["country"] for s in seen} - {None})
            hours = sorted({s["ts"].hour for s in seen})
            expected[r["event_id"]] = (own[0]["ts"], r["ts"], ",".join(countries), ",".join(map(str, hours)))
    got = profiles.user_profile(frame(log), Policy(slice_seconds=240)).collect()
    assert {r.event_id: (r.first_event, r.last_event, r.countries_seen, r.hours_seen) for r in got} == expected


def test_baseline_resources(frame):
    rows = [row(at("08:00:00") + timedelta(minutes=i), resource="api" if i < 49 else f"r{i}") for i in range(60)]
    got = profiles.baseline_resources(frame(rows)).collect()
    assert sorted((r.resource, r.first_ordinal, r.uses) for r in got) == [("api", 1, 49), ("r49", 50, 1)]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_watchlist_by_any_join(spark, frame, threshold):
    events = frame([row("10:00:00", country=c) for c in ("Iran", "Spain", "China", None)])
    watchlist = spark.createDataFrame([("Iran",), ("China",), ("China",)], "name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = on_watchlist(events, watchlist, "country").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.country for r in got) == ["China", "Iran"]


def test_materialised_table_equals_its_plan(frame, log):
    events = frame(log)
    assert materialised(events).exceptAll(events).count() == 0


def test_ratios_round_half_up(spark):
    df = spark.createDataFrame([(9, 4), (1, 3), (0, 5), (1235, 10000)], "a long, b long")
    got = df.select(
        ratio(F.col("a"), F.col("b"), 1).alias("r"), percent(F.col("a"), F.col("b")).alias("p"), percent_text(F.col("a"), F.col("b")).alias("t")
    ).collect()
    assert [r.r for r in got] == [2.3, 0.3, 0.0, 0.1]
    assert [r.p for r in got] == [225.0, 33.3, 0.0, 12.4]
    assert [r.t for r in got] == ["225.00", "33.33", "0.00", "12.35"]
    assert spark.range(1).select(percent_text(F.lit(0), F.lit(0))).first()[0] == "0.00"


def test_frequency_drops_null_and_breaks_ties_by_key(frame):
    events = frame([row("10:00:00", country=c) for c in ("b", "a", None, None, "c", "c")])
    assert [tuple(r) for r in top(frequency(events, "country"), "country").collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_share_counts_rows_without_a_value_in_the_total(frame):
    events = frame([row("10:00:00", status=s) for s in ("failed", None, "success", "success")])
    assert [tuple(r) for r in analytics.share_of(events, "status").collect()] == [("success", 2, 50.0), ("failed", 1, 25.0)]


def test_levels_without_rows_are_kept(frame):
    got = analytics.risk_levels(frame([row("10:00:00", risk=r) for r in (0, 39, 70)])).collect()
    assert [(r.level, r.n) for r in got] == [("none", 1), ("low", 1), ("medium", 0), ("high", 1)]


def test_risk_stats(frame):
    got = analytics.risk_stats(frame([row("10:00:00", risk=r) for r in (0, 10, 20, 45)])).first()
    assert tuple(got) == (4, 18.8, 19.3, 0, 7.5, 15.0, 26.3, 45)


def test_null_counts(frame):
    got = analytics.null_counts(frame([row("10:00:00", country=None), row("10:00:01")])).collect()
    assert {r.column_name: r.nulls for r in got if r.nulls} == {"country": 1}


def test_empty_alert_table(frame, spark):
    from gatelens.plans.batch_rules import all_alerts, detection_rate

    events = frame([row("10:00:00")])
    alerts = all_alerts(events)
    assert tuple(analytics.alert_kpis(alerts, events).first()) == (0, 0, 0, 1)
    rate = detection_rate(events, alerts).first()
    assert (rate.total_alerts, rate.total_events, rate.alert_rate) == (0, 1, 0.0)
