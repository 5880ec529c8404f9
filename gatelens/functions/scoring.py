"""Risk score, severity and score classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, MEDIUM, Policy
from gatelens.functions.predicates import at_scored_hours, from_suspicious_country, is_failed, on_sensitive_resource


def risk_score(attempts: Column, policy: Policy = DEFAULT_POLICY, hour: Column | None = None) -> Column:
    """Sum of the weights of the factors that hold, capped. ``attempts`` is the failure count to weigh in."""
    factors = (
        (from_suspicious_country(policy), policy.weight_country),
        (on_sensitive_resource(policy), policy.weight_resource),
        (is_failed(), policy.weight_failed),
        (at_scored_hours(policy, hour), policy.weight_hours),
        (attempts > policy.attempts_over, policy.weight_attempts),
    )
    total = sum((F.when(holds, weight).otherwise(0) for holds, weight in factors), start=F.lit(0))
    return F.least(total, F.lit(policy.score_cap)).cast("int")


def severity(score, policy: Policy = DEFAULT_POLICY) -> Column:
    """Name of the highest band whose lower bound the score reaches; below all of them, the lowest band."""
    score = F.col(score) if isinstance(score, str) else score
    bands = sorted(policy.severity_bands, key=lambda band: -band[1])
    chain = F.when(score >= bands[0][1], bands[0][0])
    for band in bands[1:-1]:
        chain = chain.when(score >= band[1], band[0])
    return chain.otherwise(bands[-1][0])


# Names of the four descriptive risk levels, lowest first.
RISK_LEVELS = ("none", "low", "medium", "high")


def risk_level(score, policy: Policy = DEFAULT_POLICY) -> Column:
    """Descriptive level: 0, up to the medium band, up to the high-risk score, and from there on; no level without a score."""
    score = F.col(score) if isinstance(score, str) else score
    none, low, medium, high = RISK_LEVELS
    middle = next(band[1] for band in policy.severity_bands if band[0] == MEDIUM)
    return F.when(score == 0, none).when(score < middle, low).when(score < policy.high_risk, medium).when(score >= policy.high_risk, high)


def event_class(alerts: Column, score: Column) -> Column:
    return F.when(alerts > 0, "critical").when(score > 0, "warning").otherwise("normal")


def score_band(score: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return F.when(score >= policy.high_risk, "high").when(score > 0, "mid").otherwise("low")
