"""The stream rules in window form, against hand-made cases and the event-by-event model."""

import random
from datetime import timedelta

import model
import pytest
from events import at, row

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.plans import stream_rules


def fired(df, policy=DEFAULT_POLICY):
    alerts = stream_rules.stream_alerts(df, policy).orderBy("ts", "event_id", "rule_order").collect()
    return [(a.alert_type, a.event_id) for a in alerts]


def failures(n, step, start="10:00:01"):
    return [row(at(start) + timedelta(seconds=step * i), "failed") for i in range(n)]


def test_six_failures_in_75_seconds_alert(frame):
    assert ("BRUTE_FORCE", 5) in fired(frame(failures(6, 15)))


def test_three_failures_do_not(frame):
    assert fired(frame(failures(3, 15))) == []


def test_one_alert_per_clock_minute(frame):
    assert fired(frame(failures(20, 1, "10:00:00"))) == [("BRUTE_FORCE", 5)]
    assert fired(frame(failures(20, 5, "10:00:00"))) == [("BRUTE_FORCE", 5), ("BRUTE_FORCE", 12)]


def test_success_after_failures_can_fire(frame):
    rows = failures(6, 1, "10:00:50") + [row("10:01:00")]
    assert fired(frame(rows)) == [("BRUTE_FORCE", 5), ("BRUTE_FORCE", 6)]


def test_failure_exactly_at_the_edge_counts(frame):
    rows = [row("10:00:00", "failed") for _ in range(5)]
    assert fired(frame(rows + [row("10:02:00", "failed")])) == [("BRUTE_FORCE", 5)]
    assert fired(frame(rows + [row("10:02:00.000001", "failed")])) == []


@pytest.mark.parametrize(
    "country, resource, alerts", [("Russia", "database", 1), ("Spain", "database", 0), ("Russia", "dashboard", 0)]
)
def test_suspicious_country(frame, country, resource, alerts):
    got = fired(frame([row("10:00:00", country=country, resource=resource)]))
    assert [a for a, _ in got].count("SUSPICIOUS_COUNTRY") == alerts


def test_country_fires_once_for_ever(frame):
    rows = [row(f"2024-03-0{d} 10:00:00", country="Iran", resource="billing") for d in (1, 2, 3)]
    assert fired(frame(rows)) == [("SUSPICIOUS_COUNTRY", 0)]


def test_off_hours_fires_once_per_day(frame):
    rows = [row(f"2024-03-0{d} 0{h}:00:00", resource="billing") for d in (1, 2) for h in (2, 3)]
    assert fired(frame(rows)) == [("OFF_HOURS", 0), ("OFF_HOURS", 2)]
    assert fired(frame([row("03:00:00", resource="dashboard"), row("14:00:00", resource="billing")])) == []
    nights = [row(f"{h:02d}:00:00", resource="billing", user=f"u{h}") for h in range(7)]
    assert fired(frame(nights)) == [("OFF_HOURS", h) for h in range(6)]


def history(n, resource_at):
    rows = [row(at("08:00:00") + timedelta(minutes=i)) for i in range(n)]
    for i, resource in resource_at.items():
        rows[i - 1]["resource"] = resource
    return rows


def test_compromised_account(frame):
    assert fired(frame(history(60, {55: "database", 58: "database"}))) == [("COMPROMISED_ACCOUNT", 54)]
    assert fired(frame(history(10, {9: "database"}))) == []
    assert fired(frame(history(60, {3: "database", 55: "database"}))) == []


def test_baseline_is_the_first_fifty_events(frame):
    assert fired(frame(history(60, {50: "database"}))) == []
    assert fired(frame(history(60, {51: "database"}))) == [("COMPROMISED_ACCOUNT", 50)]


def test_several_rules_on_one_event_keep_their_order(frame):
    rows = history(60, {}) + failures(5, 1, "2024-03-05 03:00:00")
    rows += [row("2024-03-05 03:00:06", "failed", "China", "billing")]
    event = stream_rules.events_with_alerts(frame(rows)).filter("event_id = 65").collect()[0]
    assert [a.alert_type for a in event.alerts] == [
        "BRUTE_FORCE", "SUSPICIOUS_COUNTRY", "OFF_HOURS", "COMPROMISED_ACCOUNT",
    ]
    assert [a.detail for a in event.alerts] == [
        "6 failures within 120 seconds",
        "Access to billing from China",
        "Access to billing at 03:00",
        "First access to billing after 66 events",
    ]
    assert event.score == 100


def random_log(seed, n=600):
    """Bursts with many ties, around slice edges and midnight."""
    rng = random.Random(seed)
    rows = []
    for user in ("a", "b", "c"):
        ts = at("2024-03-04 22:30:00")
        for i in range(n // 3):
            # One user reaches a sensitive resource only late, and a new one.
            resources = ["login", "api", "api", "api", "billing", "database"]
            if user == "a":
                resources = resources[:4] if i < 60 else ["api", "admin_panel"]
            ts += timedelta(seconds=rng.choice([0, 0, 1, 5, 20, 59, 60, 120, 121, 1800]))
            ts += timedelta(microseconds=rng.choice([0, 0, 0, 1]))
            rows.append(
                row(ts, rng.choice(["failed", "failed", "success"]), rng.choice(["Spain", "Iran", "China"]),
                    rng.choice(resources), user)
            )
    return [{**r, "event_id": i} for i, r in enumerate(rng.sample(rows, len(rows)))]


@pytest.mark.parametrize("seed, slice_seconds", [(1, 3600), (2, 240), (3, 300), (4, 86400)])
def test_window_form_equals_model(frame, seed, slice_seconds):
    rows = random_log(seed)
    policy = Policy(slice_seconds=slice_seconds)
    expected = model.stream(rows, policy)
    got = {
        r.event_id: (r.trailing_failures, r.ordinal, r.score, [a.alert_type for a in r.alerts])
        for r in stream_rules.events_with_alerts(frame(rows), policy).collect()
    }
    assert got == expected
    assert {a for *_, alerts in expected.values() for a in alerts} == set(stream_rules.FLAGS)


def test_running_kpis_equal_model(frame):
    rows = random_log(7, 300)
    expected, events, alerts, users = {}, 0, 0, set()
    per_event = model.stream(rows)
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        events, alerts = events + 1, alerts + len(per_event[r["event_id"]][3])
        users |= {r["user_id"]} if per_event[r["event_id"]][3] else set()
        expected[r["event_id"]] = (events, alerts, len(users))
    got = stream_rules.running_kpis(stream_rules.alert_counts(stream_rules.detect(frame(rows)))).collect()
    assert {r.event_id: (r.total_events, r.total_alerts, r.alerted_users) for r in got} == expected
    last = max(got, key=lambda r: r.total_events)
    assert abs(float(last.rate) - 100 * alerts / events) <= 0.005
