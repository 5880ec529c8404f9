"""The batch rules on small hand-made logs."""

import random
from datetime import timedelta

import model
import pytest
from events import at, row

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.plans import batch_rules


def burst(start, n, step=5, user="u1", **more):
    """``n`` failures, ``step`` seconds apart."""
    return [row(at(start) + timedelta(seconds=step * i), "failed", user=user, **more) for i in range(n)]


def found(df):
    return [(r.user_id, r.first_event, r.last_event, r.event_count) for r in df.orderBy("user_id", "first_event").collect()]


def test_brute_force_threshold(frame):
    assert found(batch_rules.brute_force(frame(burst("10:00:00", 10)))) == []
    alerts = found(batch_rules.brute_force(frame(burst("10:00:00", 11))))
    assert alerts == [("u1", at("10:00:00"), at("10:00:50"), 11)]


def test_brute_force_window_is_closed(frame):
    inside = burst("10:00:00", 10) + [row("10:02:00", "failed")]
    assert len(found(batch_rules.brute_force(frame(inside)))) == 1
    outside = burst("10:00:00", 10) + [row("10:02:00.000001", "failed")]
    assert found(batch_rules.brute_force(frame(outside))) == []


def test_successes_do_not_count(frame):
    rows = burst("10:00:00", 10) + [row("10:00:30")]
    assert found(batch_rules.brute_force(frame(rows))) == []


def test_adjacent_bursts_give_two_alerts(frame):
    rows = burst("10:00:00", 13, step=10) + burst("10:02:01", 13, step=5)
    alerts = found(batch_rules.brute_force(frame(rows)))
    assert alerts == [("u1", at("10:00:00"), at("10:02:00"), 13), ("u1", at("10:02:01"), at("10:03:01"), 13)]


def test_ties_at_the_anchor_count_together(frame):
    rows = [row("10:00:00", "failed", country="China" if i == 0 else "Spain", risk=i) for i in range(11)]
    alert = batch_rules.brute_force(frame(rows)).collect()[0]
    assert (alert.event_count, alert.country, alert.max_risk_score) == (11, "China", 10)
    assert alert.detail == "11 failures, the last one 0 s after the first"


def test_users_are_separate(frame):
    rows = [row(at("10:00:00") + timedelta(seconds=i), "failed", user=f"u{i % 2}") for i in range(20)]
    assert found(batch_rules.brute_force(frame(rows))) == []


@pytest.mark.parametrize("seed", range(4))
def test_brute_force_equals_walk(frame, seed):
    """Long attacks over many small slices, with ties, gaps at exactly the window length, and quiet users."""
    rng = random.Random(seed)
    policy = Policy(slice_seconds=240)
    rows = []
    for user, pace in (("hot", 6), ("dense", 1), ("edge", 12), ("quiet", 90)):
        ts = at("00:00:00")
        for _ in range(400):
            ts += timedelta(seconds=rng.choice([0, 0, 1, pace, pace, 2 * pace, 120, rng.randint(0, 2 * pace)]))
            ts += timedelta(microseconds=rng.choice([0, 0, 0, 1, 999_999]))
            status = "failed" if rng.random() < 0.9 else "success"
            rows.append(row(ts, status, rng.choice(["Spain", "Iran"]), rng.choice(["login", "billing"]), user, rng.randint(0, 100)))
    rows = [{**r, "event_id": i} for i, r in enumerate(rng.sample(rows, len(rows)))]
    alerts = batch_rules.brute_force(frame(rows), policy).collect()
    got = sorted((a.user_id, a.first_event, a.last_event, a.event_count, a.max_risk_score, a.country, a.resource) for a in alerts)
    assert got == sorted(model.bursts(rows, policy))
    assert len(got) > 20


def test_evidence_lists_the_failures_of_each_alert(frame):
    rows = burst("10:00:00", 13, step=10) + burst("10:02:01", 13, step=5) + [row("10:00:05")]
    evidence = batch_rules.alert_evidence(frame(rows)).groupBy("burst_start").count().orderBy("burst_start").collect()
    assert [(r.burst_start, r["count"]) for r in evidence] == [(at("10:00:00"), 13), (at("10:02:01"), 13)]


def test_suspicious_country(frame):
    def alerts(*rows):
        return batch_rules.suspicious_country(frame(list(rows))).count()

    assert alerts(row("10:00:00", country="Russia", resource="database")) == 1
    assert alerts(row("10:00:00", country="Spain", resource="database")) == 0
    assert alerts(row("10:00:00", country="Russia", resource="dashboard")) == 0
    assert alerts(*[row("10:00:00", country=c, resource="billing") for c in DEFAULT_POLICY.suspicious_countries]) == 5


def test_suspicious_country_names_resources_as_first_seen(frame):
    used = ["database", "admin_panel", "database", "billing"]
    rows = [row(f"10:0{i}:00", country="Iran", resource=r, risk=i) for i, r in enumerate(used)]
    alert = batch_rules.suspicious_country(frame(rows)).collect()[0]
    assert alert.detail == (
        "Iran: 4 sensitive events on database, admin_panel, billing"
    )
    assert (alert.resource, alert.max_risk_score, alert.event_count) == ("database", 3, 4)


def test_off_hours(frame):
    def alerts(*rows):
        return batch_rules.off_hours(frame(list(rows))).collect()

    assert len(alerts(row("03:00:00", resource="database"))) == 1
    assert alerts(row("14:00:00", resource="database")) == []
    assert alerts(row("03:00:00", resource="dashboard")) == []
    night = alerts(*[row(f"{h:02d}:30:00", resource="billing") for h in range(7)])
    assert [(a.event_count, a.detail) for a in night] == [
        (6, "6 sensitive events by night, hours 00 to 05")
    ]


def history(n_first, late):
    """``n_first`` ordinary accesses, one a minute, then ``late`` resources."""
    base = [row(at("08:00:00") + timedelta(minutes=i)) for i in range(n_first)]
    return base + [row(at("20:00:00") + timedelta(minutes=i), resource=r) for i, r in enumerate(late)]


def test_compromised_account_needs_more_than_two_accesses(frame):
    assert found(batch_rules.compromised_account(frame(history(10, ["database"] * 2)))) == []
    alert = batch_rules.compromised_account(frame(history(10, ["database", "billing", "database"]))).collect()[0]
    assert alert.event_count == 3
    assert alert.detail == "3 late events on resources new to the user: billing, database"


def test_compromised_account_ignores_known_resources(frame):
    rows = [row("07:00:00", resource="database")] + history(10, ["database"] * 4)
    assert found(batch_rules.compromised_account(frame(rows))) == []


def test_compromised_account_split(frame):
    """The first half is rounded down, so the middle event of an odd history belongs to the second half.

    All events of a user lie in one slice, where the exact count within the slice decides.
    """
    rows, expected = [], set()
    for size in (9, 10):
        for first_at in range(size):
            user = f"u{size}-{first_at}"
            rows += [
                row(f"10:{i:02d}:00", resource="billing" if i == first_at else "dashboard", user=user) for i in range(size)
            ]
            expected |= {user} if first_at >= size // 2 else set()
    assert {r.user_id for r in batch_rules.new_sensitive_resources(frame(rows)).collect()} == expected


def test_new_resources_equal_model(frame):
    rng = random.Random(5)
    rows = []
    for user in range(12):
        ts = at("00:00:00")
        for _ in range(rng.randint(5, 40)):
            ts += timedelta(minutes=rng.choice([0, 1, 20, 90]))
            rows.append(row(ts, resource=rng.choice(["login", "api", "api", "api", "database", "billing"]), user=f"u{user}"))
    rows = [{**r, "event_id": i} for i, r in enumerate(rows)]
    expected = set()
    for user in {r["user_id"] for r in rows}:
        own = sorted((r for r in rows if r["user_id"] == user), key=lambda r: (r["ts"], r["event_id"]))
        early, late = own[: len(own) // 2], own[len(own) // 2 :]
        new = {r["resource"] for r in late} - {r["resource"] for r in early}
        expected |= {(user, r, sum(x["resource"] == r for x in late)) for r in new & set(DEFAULT_POLICY.sensitive_resources)}
    got = batch_rules.new_sensitive_resources(frame(rows)).collect()
    assert {(r.user_id, r.used, r.event_count) for r in got} == expected
    assert expected


def test_slow_brute_force_is_per_day(frame):
    day = [row(at("00:30:00") + timedelta(hours=i), "failed") for i in range(20)]
    more = [row("2024-03-05 00:10:00", "failed")]
    assert found(batch_rules.slow_brute_force(frame(day + more))) == []
    alert = batch_rules.slow_brute_force(frame(day + [row("23:59:59", "failed")])).collect()[0]
    assert alert.detail == "21 failures spread over 2024-03-04"


def test_all_alerts_leaves_the_slow_rule_out_by_default(frame):
    rows = [row(at("00:30:00") + timedelta(hours=i), "failed") for i in range(23)]
    assert batch_rules.all_alerts(frame(rows)).count() == 0
    assert batch_rules.all_alerts(frame(rows), include_slow=True).count() == 1


def test_thresholds_come_from_the_policy(frame):
    strict = Policy(batch_burst_over=2)
    assert len(found(batch_rules.brute_force(frame(burst("10:00:00", 3)), strict))) == 1
