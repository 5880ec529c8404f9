"""Row predicates in SQL logic: unknown input gives an unknown result, which filters and ``when`` treat as false.

They are kept as plain comparisons so that filters reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy


def is_failed(status="status") -> Column:
    return F.col(status) == "failed"


def from_suspicious_country(policy: Policy = DEFAULT_POLICY, country="country") -> Column:
    return F.col(country).isin(*policy.suspicious_countries)


def on_sensitive_resource(policy: Policy = DEFAULT_POLICY, resource="resource") -> Column:
    return F.col(resource).isin(*policy.sensitive_resources)


def night_hour(hour: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """The rule's hours: from ``night_start`` up to, not including, ``night_end``; a night may cross midnight."""
    late, early = hour >= policy.night_start, hour < policy.night_end
    return late & early if policy.night_start <= policy.night_end else late | early


def at_night(policy: Policy = DEFAULT_POLICY, ts="ts") -> Column:
    return night_hour(F.hour(ts), policy)


def at_scored_hours(policy: Policy = DEFAULT_POLICY, hour: Column | None = None) -> Column:
    """The score's hours: the night and the late evening."""
    hour = F.hour("ts") if hour is None else hour
    return (hour < policy.score_night_end) | (hour >= policy.score_evening_start)


def is_high_risk(policy: Policy = DEFAULT_POLICY, score="risk_score") -> Column:
    return F.col(score) >= policy.high_risk
