"""Event-by-event models of the rules in plain Python, to compare the set-based plans with."""

from __future__ import annotations

from collections import defaultdict
from datetime import timedelta

from gatelens.config import DEFAULT_POLICY


def stream(rows, policy=DEFAULT_POLICY):
    """``event_id -> (trailing failures, ordinal, score, rules that fire)``."""
    seen, failures, known, fired = defaultdict(int), defaultdict(list), defaultdict(dict), set()
    result = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        user, ts = r["user_id"], r["ts"]
        seen[user] += 1
        known[user].setdefault(r["resource"], seen[user])
        if r["status"] == "failed":
            failures[user].append(ts)
        oldest = ts - timedelta(seconds=policy.burst_seconds)
        failures[user] = [t for t in failures[user] if t >= oldest]
        recent = len(failures[user])
        watched = r["country"] in policy.suspicious_countries
        sensitive = r["resource"] in policy.sensitive_resources
        score = 30 * watched + 25 * sensitive + 20 * (r["status"] == "failed")
        score += 15 * (ts.hour < 6 or ts.hour >= 22) + 10 * (recent > 5)
        holds = {
            ("BRUTE_FORCE", ts.replace(second=0, microsecond=0)): recent > policy.stream_burst_over,
            ("SUSPICIOUS_COUNTRY", r["country"]): watched and sensitive,
            ("OFF_HOURS", ts.date()): ts.hour < 6 and sensitive,
            ("COMPROMISED_ACCOUNT", r["resource"]): sensitive and known[user][r["resource"]] > policy.baseline_events,
        }
        alerts = [rule for (rule, key), true in holds.items() if true and (user, rule, key) not in fired]
        fired |= {(user, rule, key) for (rule, key), true in holds.items() if true}
        result[r["event_id"]] = (recent, seen[user], min(score, 100), alerts)
    return result


def bursts(rows, policy=DEFAULT_POLICY):
    """``(user, first, last, count, highest risk, country, resource)`` of each batch brute-force alert."""
    by_user = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        if r["status"] == "failed":
            by_user[r["user_id"]].append(r)
    found = []
    for user, tries in by_user.items():
        start = 0
        while start < len(tries):
            end = tries[start]["ts"] + timedelta(seconds=policy.burst_seconds)
            # Anchored at an instant, the window holds all failures of that instant.
            inside = [t for t in tries if tries[start]["ts"] <= t["ts"] <= end]
            if len(inside) > policy.batch_burst_over:
                first = inside[0]
                found.append((user, first["ts"], inside[-1]["ts"], len(inside), max(t["risk_score"] for t in inside),
                              first["country"], first["resource"]))
                start = tries.index(inside[-1]) + 1
            else:
                start += 1
    return found
