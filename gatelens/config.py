"""Detection policy: watch lists, weights, thresholds and response guidance.

Everything a deployment may want to change lives in :class:`Policy`; operators take the policy as an argument and
turn it into literals or small dimension tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: rule names and severity names -----------------------------------------------------------------
BRUTE_FORCE = "BRUTE_FORCE"
SUSPICIOUS_COUNTRY = "SUSPICIOUS_COUNTRY"
OFF_HOURS = "OFF_HOURS"
COMPROMISED_ACCOUNT = "COMPROMISED_ACCOUNT"
SLOW_BRUTE_FORCE = "SLOW_BRUTE_FORCE"

# Order in which several rules firing on one event are listed.
STREAM_RULE_ORDER = (BRUTE_FORCE, SUSPICIOUS_COUNTRY, OFF_HOURS, COMPROMISED_ACCOUNT)

CRITICAL, HIGH, MEDIUM, LOW, NORMAL = "CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL"

# --- Severity bands: severity, min score, max score, mark, colour are fixed values; the response time is this policy's own.
SEVERITY_BANDS = (
    (CRITICAL, 90, 100, "🔴", "page the on-call analyst, contain before reading on", "#ef4444"),
    (HIGH, 70, 89, "🟠", "take over in the running shift", "#f97316"),
    (MEDIUM, 40, 69, "🟡", "put into the queue for the next working day", "#eab308"),
    (LOW, 1, 39, "🔵", "collect for the weekly trend meeting", "#3b82f6"),
    (NORMAL, 0, 0, "✅", "none", "#6b7280"),
)

# --- Playbook: per rule, the steps with the lowest severity that calls for them, most pressing first --------------------
PLAYBOOK = {
    BRUTE_FORCE: (
        (CRITICAL, "Lock the account until its owner has called back"),
        (HIGH, "Throttle logins for the account to one a minute"),
        (HIGH, "Hold the tried user names against known leak collections"),
        (MEDIUM, "Look for other accounts that fail from these addresses"),
        (LOW, "Count the burst in the login failure statistics"),
    ),
    SUSPICIOUS_COUNTRY: (
        (CRITICAL, "Cut the connection at the gateway"),
        (CRITICAL, "Inform the data owner of each listed resource"),
        (HIGH, "Export what was read from the listed resources"),
        (MEDIUM, "Compare the address with the exits of the company's tunnels"),
        (MEDIUM, "Search the ticket system for a business trip"),
        (LOW, "Keep the alert for the next review of the country list"),
    ),
    OFF_HOURS: (
        (CRITICAL, "Switch the account to read-only until the morning shift"),
        (HIGH, "List the statements and downloads of that night"),
        (MEDIUM, "Look up maintenance windows and duty rosters"),
        (LOW, "Mark the night in the user's shift plan"),
    ),
    COMPROMISED_ACCOUNT: (
        (CRITICAL, "Freeze the account together with its service keys"),
        (CRITICAL, "Roll back what was changed since the first of these accesses"),
        (HIGH, "Let its programming keys expire"),
        (MEDIUM, "Hold the granted rights against the template of the team"),
        (LOW, "Enter the resource in the access inventory"),
        (LOW, "Ask the team lead about a change of role"),
    ),
}
_RANK = {band[0]: k for k, band in enumerate(SEVERITY_BANDS)}
RECOMMENDATIONS = {
    rule: {severity: tuple(text for floor, text in steps if _RANK[floor] >= _RANK[severity]) for severity in (CRITICAL, HIGH, MEDIUM, LOW)}
    for rule, steps in PLAYBOOK.items()
}
DEFAULT_RECOMMENDATION = "Not in the playbook, let an analyst decide"


@dataclass(frozen=True)
class Policy:
    """All tunable values of the detection rules."""

    # Watch lists.
    suspicious_countries: tuple[str, ...] = ("Russia", "China", "North Korea", "Nigeria", "Iran")
    sensitive_resources: tuple[str, ...] = ("admin_panel", "database", "billing")

    # Score weights and score factors.
    weight_country: int = 30
    weight_resource: int = 25
    weight_failed: int = 20
    weight_hours: int = 15
    weight_attempts: int = 10
    score_cap: int = 100
    attempts_over: int = 5
    score_night_end: int = 6
    score_evening_start: int = 22

    # Rule thresholds. "over" values are exclusive.
    burst_seconds: int = 120
    batch_burst_over: int = 10
    stream_burst_over: int = 5
    night_start: int = 0
    night_end: int = 6
    daily_failures_over: int = 20
    new_resource_over: int = 2
    baseline_events: int = 50
    high_risk: int = 70

    severity_bands: tuple = SEVERITY_BANDS
    recommendations: dict = field(default_factory=lambda: RECOMMENDATIONS)
    default_recommendation: str = DEFAULT_RECOMMENDATION

    # Width of the per-user time slices that per-user ordering work is split into (see operators/slices.py).
    slice_seconds: int = 3600

    def __post_init__(self):
        if self.slice_seconds < 2 * self.burst_seconds:
            raise ValueError("slice_seconds must be at least twice burst_seconds")
        if self.slice_seconds % 60:
            raise ValueError("slice_seconds must be a whole number of minutes, the key of the brute-force rule")


DEFAULT_POLICY = Policy()
