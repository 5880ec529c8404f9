"""Equivalent SQL for the registered queries, run over the raw test tables by another engine.

The statements restate the rules in relational form (self joins, a recursive walk for the bursts) and share no code with
the Spark plans; only policy texts are taken from the configuration.
"""

from __future__ import annotations

from gatelens.config import DEFAULT_RECOMMENDATION, RECOMMENDATIONS, SEVERITY_BANDS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BANDS = ", ".join(
    f"({_quote(name)}, {low}, {high}, {_quote(mark)}, {_quote(respond)}, {_quote(colour)})"
    for name, low, high, mark, respond, colour in SEVERITY_BANDS
)
_ADVICE = ", ".join(
    f"({_quote(kind)}, {_quote(band)}, {i + 1}, {_quote(text)})"
    for kind, by_band in RECOMMENDATIONS.items()
    for band, texts in by_band.items()
    for i, text in enumerate(texts)
)

_SENSITIVE = "('admin_panel', 'database', 'billing')"
_WATCHED = "('Russia', 'China', 'North Korea', 'Nigeria', 'Iran')"
_TEXT_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _score(attempts: str) -> str:
    return f"""CAST(least(100,
        CASE WHEN country IN {_WATCHED} THEN 30 ELSE 0 END
      + CASE WHEN resource IN {_SENSITIVE} THEN 25 ELSE 0 END
      + CASE WHEN status = 'failed' THEN 20 ELSE 0 END
      + CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 15 ELSE 0 END
      + CASE WHEN {attempts} > 5 THEN 10 ELSE 0 END) AS INTEGER)"""


def _severity(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 90 THEN 'CRITICAL' WHEN {score} >= 70 THEN 'HIGH' WHEN {score} >= 40 THEN 'MEDIUM'"
        f" WHEN {score} >= 1 THEN 'LOW' ELSE 'NORMAL' END"
    )


def _ratio(numerator: str, denominator: str, places: int) -> str:
    units = f"((2 * {10**places} * CAST({numerator} AS BIGINT) + CAST({denominator} AS BIGINT)) // (2 * CAST({denominator} AS BIGINT)))"
    return f"(CAST({units} AS DOUBLE) / {10**places})"


def _rate_text(part: str, whole: str) -> str:
    units = f"((20000 * CAST({part} AS BIGINT) + CAST({whole} AS BIGINT)) // (2 * CAST({whole} AS BIGINT)))"
    return f"(CAST({units} // 100 AS VARCHAR) || '.' || lpad(CAST({units} % 100 AS VARCHAR), 2, '0'))"


_EVENTS = f"""WITH RECURSIVE raw_roles AS (
  SELECT event_id, ts, event_type, user_id AS uid, user_id % 10 AS prof, (user_id // 10) % 5 AS d,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         user_id % 10 = 0 AS burst,
         user_id % 10 = 2 AND event_id % 9 = 0 AS odd,
         user_id % 10 = 1 AND event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 00:00:00' AS comp
  FROM events
), shaped AS (
  SELECT event_id,
         CASE WHEN burst THEN TIMESTAMP '2024-01-15 00:00:00' + to_hours(CAST(uid % 24 AS INTEGER))
                              + to_microseconds(((event_id * 7919) % 300) * 1000000)
              WHEN comp THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_microseconds(((event_id * 7919) % 18000) * 1000000)
              ELSE ts END AS ts,
         'user_' || lpad(CAST(uid AS VARCHAR), 5, '0') AS user_id,
         CAST(CASE WHEN burst OR odd THEN event_id % 50 + 1 ELSE event_id % 50 + 150 END AS VARCHAR) || '.'
           || CAST(event_id % 256 AS VARCHAR) || '.' || CAST(uid % 256 AS VARCHAR) || '.' || CAST(k % 254 + 1 AS VARCHAR)
           AS ip_address,
         CASE WHEN burst OR odd THEN ['Russia', 'China', 'North Korea', 'Nigeria', 'Iran'][d + 1]
              ELSE ['Argentina', 'Brazil', 'Mexico', 'Spain', 'Colombia'][d + 1] END AS country,
         CASE WHEN burst THEN 'login_attempt' ELSE 'access' END AS action,
         CASE WHEN burst AND event_type <> 'purchase' THEN 'failed'
              WHEN NOT burst AND event_type = 'error' AND k < 25 THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN burst OR odd OR comp THEN ['admin_panel', 'database', 'billing'][k % 3 + 1]
              ELSE ['login', 'dashboard', 'api', 'file_storage'][k % 4 + 1] END AS resource,
         CASE WHEN burst THEN event_id % 12 ELSE 0 END AS attempts,
         CASE WHEN burst THEN 'brute_force' WHEN prof = 1 THEN 'compromised_account'
              WHEN prof = 2 THEN 'unusual_country' ELSE 'normal' END AS scenario
  FROM raw_roles
), ev AS (
  SELECT event_id, ts, user_id, ip_address, country, action, status, resource, {_score("attempts")} AS risk_score, scenario
  FROM shaped
), fail AS (SELECT * FROM ev WHERE status = 'failed')
"""

_SCORED = f"""{_EVENTS}, trail AS (
  SELECT e.event_id, count(f.event_id) AS trailing_failures
  FROM ev e LEFT JOIN fail f
    ON f.user_id = e.user_id AND f.ts >= e.ts - INTERVAL 120 SECOND
   AND (f.ts < e.ts OR (f.ts = e.ts AND f.event_id <= e.event_id))
  GROUP BY e.event_id
), scored AS (
  SELECT *, {_score("trailing_failures")} AS score FROM (
    SELECT e.*, t.trailing_failures,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS ordinal,
           count(*) OVER (PARTITION BY e.user_id) AS user_events
    FROM ev e JOIN trail t ON t.event_id = e.event_id)
), sa AS (
  SELECT 1 AS rule_order, 'BRUTE_FORCE' AS alert_type,
         CAST(trailing_failures AS VARCHAR) || ' failures within 120 seconds' AS detail, * EXCLUDE (n)
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS n
        FROM scored WHERE trailing_failures > 5) WHERE n = 1
  UNION ALL
  SELECT 2, 'SUSPICIOUS_COUNTRY', 'Access to ' || resource || ' from ' || country, * EXCLUDE (n)
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, country ORDER BY ts, event_id) AS n
        FROM scored WHERE country IN {_WATCHED} AND resource IN {_SENSITIVE}) WHERE n = 1
  UNION ALL
  SELECT 3, 'OFF_HOURS', 'Access to ' || resource || ' at ' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00', * EXCLUDE (n)
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n
        FROM scored WHERE hour(ts) < 6 AND resource IN {_SENSITIVE}) WHERE n = 1
  UNION ALL
  SELECT 4, 'COMPROMISED_ACCOUNT', 'First access to ' || resource || ' after ' || CAST(ordinal AS VARCHAR) || ' events', * EXCLUDE (n)
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, resource ORDER BY ts, event_id) AS n
        FROM scored WHERE resource IN {_SENSITIVE}) WHERE n = 1 AND ordinal > 50
)
"""

_RECORD = """min(ts) AS first_event, max(ts) AS last_event, first(country ORDER BY ts, event_id) AS country,
         first(resource ORDER BY ts, event_id) AS resource, max(risk_score) AS max_risk_score, count(*) AS event_count"""

_BATCH = f"""{_EVENTS}, moments AS (SELECT user_id, ts, count(*) AS failures, max(risk_score) AS max_risk FROM fail GROUP BY user_id, ts
), windows AS (
  SELECT a.user_id, a.ts, a.failures, CAST(sum(b.failures) AS BIGINT) AS window_failures, max(b.ts) AS window_last,
         max(b.max_risk) AS window_max_risk
  FROM moments a JOIN moments b ON b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 120 SECOND
  GROUP BY a.user_id, a.ts, a.failures
), anchors AS (SELECT user_id, ts FROM windows WHERE window_failures > 10
), bursts AS (
  SELECT user_id, min(ts) AS burst_start FROM anchors GROUP BY user_id
  UNION ALL
  SELECT b.user_id, min(a.ts) FROM bursts b
  JOIN anchors a ON a.user_id = b.user_id AND a.ts > b.burst_start + INTERVAL 120 SECOND
  GROUP BY b.user_id, b.burst_start
), evidence AS (
  SELECT f.*, b.burst_start FROM bursts b
  JOIN fail f ON f.user_id = b.user_id AND f.ts BETWEEN b.burst_start AND b.burst_start + INTERVAL 120 SECOND
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal,
         count(*) OVER (PARTITION BY user_id) AS user_events FROM ev
), used_early AS (
  SELECT DISTINCT user_id, resource FROM ranked WHERE ordinal <= user_events // 2
), new_use AS (
  SELECT r.* FROM ranked r ANTI JOIN used_early u ON u.user_id = r.user_id AND u.resource = r.resource
  WHERE r.resource IN {_SENSITIVE}
), rule1 AS (
  SELECT 'BRUTE_FORCE' AS alert_type, user_id,
         CAST(event_count AS VARCHAR) || ' failures, the last one '
           || CAST(CAST(round_even((epoch_us(last_event) - epoch_us(first_event)) / 1000000.0, 0) AS BIGINT) AS VARCHAR)
           || ' s after the first' AS detail,
         first_event, last_event, country, resource, max_risk_score, event_count
  FROM (SELECT user_id, burst_start, {_RECORD} FROM evidence GROUP BY user_id, burst_start)
), hits AS (SELECT * FROM ev WHERE country IN {_WATCHED} AND resource IN {_SENSITIVE}
), used_order AS (
  SELECT user_id, country, string_agg(resource, ', ' ORDER BY ts, event_id) AS used
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, country, resource ORDER BY ts, event_id) AS n FROM hits) WHERE n = 1
  GROUP BY user_id, country
), rule2 AS (
  SELECT 'SUSPICIOUS_COUNTRY' AS alert_type, r.user_id,
         r.country || ': ' || CAST(r.event_count AS VARCHAR) || ' sensitive events on ' || u.used AS detail,
         r.first_event, r.last_event, r.country, r.resource, r.max_risk_score, r.event_count
  FROM (SELECT user_id, country AS origin, {_RECORD} FROM hits GROUP BY user_id, origin) r
  JOIN used_order u ON u.user_id = r.user_id AND u.country = r.origin
), rule3 AS (
  SELECT 'OFF_HOURS' AS alert_type, user_id,
         CAST(event_count AS VARCHAR) || ' sensitive events by night, hours '
           || lpad(CAST(from_hour AS VARCHAR), 2, '0') || ' to ' || lpad(CAST(to_hour AS VARCHAR), 2, '0') AS detail,
         first_event, last_event, country, resource, max_risk_score, event_count
  FROM (SELECT user_id, min(hour(ts)) AS from_hour, max(hour(ts)) AS to_hour, {_RECORD}
        FROM ev WHERE hour(ts) < 6 AND resource IN {_SENSITIVE} GROUP BY user_id)
), rule4 AS (
  SELECT 'COMPROMISED_ACCOUNT' AS alert_type, user_id,
         CAST(event_count AS VARCHAR) || ' late events on resources new to the user: ' || used AS detail,
         first_event, last_event, country, resource, max_risk_score, event_count
  FROM (SELECT user_id, string_agg(DISTINCT resource, ', ' ORDER BY resource) AS used, {_RECORD}
        FROM new_use GROUP BY user_id) WHERE event_count > 2
), rule5 AS (
  SELECT 'SLOW_BRUTE_FORCE' AS alert_type, user_id,
         CAST(event_count AS VARCHAR) || ' failures spread over ' || CAST(day AS VARCHAR) AS detail,
         first_event, last_event, country, resource, max_risk_score, event_count
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, {_RECORD} FROM fail GROUP BY user_id, day) WHERE event_count > 20
), al AS (
  SELECT * FROM rule1 UNION ALL SELECT * FROM rule2 UNION ALL SELECT * FROM rule3 UNION ALL SELECT * FROM rule4
)
"""

_DIMENSIONS = f""", bands(severity, min_score, max_score, emoji, response_time, colour) AS (VALUES {_BANDS}
), advice(alert_type, severity, position, recommendation) AS (VALUES {_ADVICE})
"""


def _enriched(alerts: str, columns: str, by: str) -> str:
    """CTEs ``graded`` (one row per alert) and ``advised`` (one row per alert and recommendation)."""
    return f"""{_DIMENSIONS}, graded AS (
  SELECT a.*, b.emoji, b.response_time, b.colour, b.min_score, b.max_score FROM (SELECT {columns}, {_severity("score")} AS severity FROM {alerts}) a
  JOIN bands b ON b.severity = a.severity
), advised AS (
  SELECT g.*, coalesce(d.position, 1) AS position, coalesce(d.recommendation, {_quote(DEFAULT_RECOMMENDATION)}) AS recommendation
  FROM graded g LEFT JOIN advice d
    ON d.alert_type = g.alert_type AND d.severity = CASE WHEN g.severity = 'NORMAL' THEN 'LOW' ELSE g.severity END
), listed AS (
  SELECT {by}, string_agg(recommendation, ' | ' ORDER BY position) AS recommendations,
         string_agg('"' || recommendation || '"', ',' ORDER BY position) AS as_json,
         string_agg(CAST(position AS VARCHAR) || ') ' || recommendation, chr(10) ORDER BY position) AS numbered,
         string_agg('<li>' || recommendation || '</li>', '' ORDER BY position) AS items
  FROM advised GROUP BY {by}
)
"""


_BATCH_ENRICHED = _BATCH + _enriched(
    "al",
    f"alert_type, user_id, country, resource, max_risk_score AS score, first_event, {_TEXT_TS.format('first_event')} AS timestamp, detail",
    "alert_type, user_id, country, first_event",
)
_STREAM_COLUMNS = (
    "event_id, rule_order, ts, alert_type, user_id, country, resource, score,"
    f" {_TEXT_TS.format('ts')} AS timestamp, detail"
)
_STREAM_ENRICHED = _SCORED + _enriched("sa", _STREAM_COLUMNS, "event_id, alert_type")
_OUTBOX_SOURCE = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, alert_type ORDER BY ts, event_id) AS n
   FROM sa WHERE score >= 70) WHERE n = 1)"""
_FIELDS = (
    ("What", "detail"),
    ("Deadline", "response_time"),
    ("Who", "user_id"),
    ("When", "timestamp"),
    ("Touched", "resource || ' from ' || country"),
    ("Score", "CAST(score AS VARCHAR)"),
)
_BODY_TEXT = " || chr(10) || ".join(
    ["severity || ' ' || emoji || ' ' || user_id || ': ' || replace(alert_type, '_', ' ')"]
    + [f"'{label}: ' || {value}" for label, value in _FIELDS]
    + ["'Next:'", "numbered"]
)
_BODY_HTML = (
    "'<html><body><h1 style=\"color:' || colour || '\">' || severity || ' ' || emoji || ' ' || user_id || ': ' || replace(alert_type, '_', ' ')"
    " || '</h1><table>' || "
    + " || ".join(f"'<tr><td>{label}</td><td>' || {value} || '</td></tr>'" for label, value in _FIELDS)
    + " || '</table><ol>' || items || '</ol></body></html>'"
)
_OUTBOX = (
    _SCORED
    + _enriched(_OUTBOX_SOURCE, _STREAM_COLUMNS, "event_id, alert_type")
    + f"""SELECT event_id, user_id, alert_type, severity, score, timestamp,
       severity || ' ' || emoji || ' ' || user_id || ': ' || replace(alert_type, '_', ' ') AS subject,
       {_BODY_TEXT} AS body_text, {_BODY_HTML} AS body_html
FROM graded JOIN listed USING (event_id, alert_type)"""
)

_RUNNING = """, per_event AS (
  SELECT e.event_id, e.ts, e.user_id, count(sa.alert_type) AS n_alerts
  FROM ev e LEFT JOIN sa ON sa.event_id = e.event_id GROUP BY e.event_id, e.ts, e.user_id
), flagged AS (
  SELECT *, CASE WHEN n_alerts > 0 AND row_number() OVER (PARTITION BY user_id, n_alerts > 0 ORDER BY ts, event_id) = 1
                 THEN 1 ELSE 0 END AS newly_alerted FROM per_event
), kpis AS (
  SELECT event_id, ts, user_id, count(*) OVER so_far AS total_events,
         CAST(sum(n_alerts) OVER so_far AS BIGINT) AS total_alerts,
         CAST(sum(newly_alerted) OVER so_far AS BIGINT) AS alerted_users
  FROM flagged WINDOW so_far AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
)
"""
_MASKED = r"regexp_replace(ip_address, '^(\d+\.\d+)\.\d+\.\d+$', '\1.xxx.xxx')"
_FEED = (
    _STREAM_ENRICHED
    + _RUNNING
    + f""", alert_json AS (
  SELECT g.event_id, string_agg(
    '{{"alert_type":"' || g.alert_type || '","severity":"' || severity || '","emoji":"' || emoji || '","user_id":"' || user_id
    || '","country":"' || country || '","resource":"' || resource || '","score":' || CAST(score AS VARCHAR)
    || ',"timestamp":"' || timestamp || '","detail":"' || detail || '","response_time":"' || response_time
    || '","recommendations":[' || as_json || ']}}', ',' ORDER BY rule_order) AS alerts
  FROM graded g JOIN listed USING (event_id, alert_type) GROUP BY g.event_id
)
SELECT s.event_id,
  '{{"total_events":' || CAST(total_events AS VARCHAR) || ',"total_alerts":' || CAST(total_alerts AS VARCHAR) || ',"rate":"'
  || {_rate_text("total_alerts", "total_events")} || '","user_id":"' || s.user_id || '","country":"' || country
  || '","resource":"' || resource || '","status":"' || status || '","timestamp":"' || {_TEXT_TS.format("s.ts")}
  || '","score":' || CAST(score AS VARCHAR) || ',"ip":' || CASE WHEN alerts IS NULL THEN 'null' ELSE '"' || ip_address || '"' END
  || ',"alerts":[' || coalesce(alerts, '') || ']}}' AS record
FROM scored s JOIN kpis k ON k.event_id = s.event_id LEFT JOIN alert_json a ON a.event_id = s.event_id"""
)

_COLUMNS = ["event_id", "ts", "user_id", "ip_address", "country", "action", "status", "resource", "risk_score", "scenario"]
_ALERT_COLUMNS = "alert_type, user_id, detail, first_event, last_event, country, resource, max_risk_score, event_count"
_STREAM_ALERT = "SELECT event_id, ts, user_id, alert_type, country, resource, score, detail FROM sa"
_COUNTED = """, alert_count AS (SELECT s.*, coalesce(n, 0) AS n_alerts, names, texts FROM scored s LEFT JOIN (
  SELECT event_id, count(*) AS n, string_agg(replace(alert_type, '_', ' '), '; ' ORDER BY rule_order) AS names,
         string_agg(alert_type || ': ' || detail, '; ' ORDER BY rule_order) AS texts FROM sa GROUP BY event_id) a
  ON a.event_id = s.event_id)
"""
_CLASS = "CASE WHEN n_alerts > 0 THEN 'critical' WHEN score > 0 THEN 'warning' ELSE 'normal' END"
_PROFILE_TYPES = (
    "event_id bigint, ts timestamp_ntz, user_id string, ip_address string, country string, action string, status string,"
    " resource string, risk_score int, scenario string"
)


def _counts(key: str, source: str = "ev", limit: int | None = None, prefix: str = _EVENTS) -> str:
    tail = f" LIMIT {limit}" if limit else ""
    return f"{prefix} SELECT {key}, count(*) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY n DESC, {key}{tail}"


def _shares(key: str) -> str:
    return (
        f"{_EVENTS} SELECT {key}, count(*) AS n, {_ratio('100 * count(*)', '(SELECT count(*) FROM ev)', 1)} AS pct"
        f" FROM ev WHERE {key} IS NOT NULL GROUP BY {key}"
    )


def _mean_risk(key: str) -> str:
    return f"{_EVENTS} SELECT {key}, count(*) AS n, {_ratio('sum(risk_score)', 'count(*)', 1)} AS mean_risk FROM ev GROUP BY {key}"


def _level(name: str, condition: str) -> str:
    part = f"(SELECT count(*) FROM ev WHERE {condition})"
    return f"SELECT '{name}' AS level, {part} AS n, {_ratio(f'100 * {part}', '(SELECT count(*) FROM ev)', 1)} AS pct"


_ENRICHED_COLUMNS = "alert_type, severity, emoji, user_id, country, resource, score, timestamp, detail, response_time, recommendations, colour, min_score, max_score"
_ALL_ALERTS = f"{_BATCH} SELECT {_ALERT_COLUMNS} FROM al"
_SLOW = f"{_BATCH} SELECT {_ALERT_COLUMNS} FROM rule5"
_SO_FAR = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_TEXT_EVENTS = ", ".join(
    f"{_TEXT_TS.format('ts')} AS ts" if c == "ts" else f"CAST({c} AS VARCHAR) AS {c}" for c in _COLUMNS
)

ORACLES = {
    # Sources and sinks
    "access_events": f"{_EVENTS} SELECT {', '.join(_COLUMNS)} FROM ev",
    "alerts_roundtrip": _ALL_ALERTS,
    "export_events": f"{_EVENTS} SELECT {_TEXT_EVENTS} FROM ev",
    "parsed_events": f"""{_EVENTS} SELECT event_id, {_TEXT_TS.format('ts')} AS ts_text, date_trunc('second', ts) AS ts, user_id,
       risk_score, true AS parse_ok FROM ev""",
    "plain_log_users": f"""{_EVENTS} SELECT user_id, count(*) AS events, count(DISTINCT event_id) AS ids, min(date_trunc('second', ts)) AS first_event,
       max(date_trunc('second', ts)) AS last_event, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM ev GROUP BY user_id""",
    "alert_export": f"{_SCORED} SELECT alert_type, user_id, country, score, detail FROM sa",
    "notification_outbox": _OUTBOX,
    # Projections and filters
    "time_features": f"""{_EVENTS} SELECT event_id, ts, CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS weekday,
       monthname(ts) AS month, CAST(ts AS DATE) AS day FROM ev""",
    "failed_events": f"{_EVENTS} SELECT * FROM ev WHERE status = 'failed'",
    "suspicious_sensitive_events": f"{_EVENTS} SELECT * FROM ev WHERE country IN {_WATCHED} AND resource IN {_SENSITIVE}",
    "off_hours_sensitive_events": f"{_EVENTS} SELECT * FROM ev WHERE hour(ts) BETWEEN 0 AND 5 AND resource IN {_SENSITIVE}",
    "high_risk_events": f"""{_EVENTS} SELECT ts, user_id, country, resource, status, risk_score, scenario FROM ev
WHERE risk_score >= 70 ORDER BY risk_score DESC, ts, event_id LIMIT 15""",
    "alerts_filtered": f"{_BATCH} SELECT {_ALERT_COLUMNS} FROM al WHERE alert_type IN ('BRUTE_FORCE', 'OFF_HOURS')",
    # Scores and scalar functions
    "risk_score": f"{_EVENTS} SELECT s.event_id, s.attempts, e.risk_score AS score FROM shaped s JOIN ev e ON e.event_id = s.event_id",
    "contextual_risk": f"{_SCORED} SELECT event_id, user_id, trailing_failures, score FROM scored",
    "alert_severity": f"""{_BATCH} SELECT alert_type, user_id, first_event, max_risk_score, {_severity("max_risk_score")} AS severity
FROM al""",
    "alert_enriched": f"""{_BATCH_ENRICHED} SELECT {_ENRICHED_COLUMNS}
FROM graded JOIN listed USING (alert_type, user_id, country, first_event)""",
    "alert_recommendations": f"""{_BATCH_ENRICHED} SELECT alert_type, severity, user_id, timestamp, CAST(position AS INTEGER) AS position,
       recommendation FROM advised""",
    "risk_levels": _EVENTS
    + " UNION ALL ".join(
        [
            _level("none", "risk_score = 0"),
            _level("low", "risk_score > 0 AND risk_score < 40"),
            _level("medium", "risk_score >= 40 AND risk_score < 70"),
            _level("high", "risk_score >= 70"),
        ]
    ),
    "event_class": f"""{_SCORED}{_COUNTED} SELECT event_id, user_id, score, n_alerts, {_CLASS} AS event_class,
       CASE WHEN score >= 70 THEN 'high' WHEN score > 0 THEN 'mid' ELSE 'low' END AS score_band FROM alert_count""",
    "masked_ips": f"{_EVENTS} SELECT event_id, ip_address, {_MASKED} AS masked_ip FROM ev",
    "role_view": f"""{_SCORED}{_COUNTED} SELECT event_id, role, user_id, score,
       CASE WHEN n_alerts > 0 THEN CASE WHEN role = 'admin' THEN ip_address ELSE {_MASKED} END END AS ip
FROM alert_count, (VALUES ('admin'), ('analyst')) r(role)""",
    "feed_lines": f"""{_SCORED}{_COUNTED} SELECT event_id,
       '[' || strftime(ts, '%m/%d %H:%M:%S') || '] ' || user_id || '  ' || rpad(left(country, 10), 10, ' ') || '  '
       || rpad(left(resource, 12), 12, ' ') || '  ' || rpad(status, 8, ' ') || '  score:' || lpad(CAST(score AS VARCHAR), 3, ' ') AS line,
       strftime(ts, '%m-%d %H:%M') AS short_time, left(country, 8) AS short_country, coalesce(names, '') AS alert_names,
       {_CLASS} AS event_class FROM alert_count""",
    "failure_gaps": f"""{_EVENTS} SELECT event_id, user_id, ts, previous_ts,
       CAST(epoch_us(ts) - epoch_us(previous_ts) AS DOUBLE) / 1000000 AS gap_seconds
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_ts FROM fail)""",
    "new_sensitive_resources": f"""{_BATCH} SELECT user_id, resource, min(ts) AS first_event, max(ts) AS last_event, count(*) AS event_count
FROM new_use GROUP BY user_id, resource""",
    # Joins
    "watchlist_semi": f"{_EVENTS} SELECT * FROM ev WHERE country IN {_WATCHED}",
    "alert_evidence": f"{_BATCH} SELECT user_id, burst_start, event_id, ts, country, resource, risk_score FROM evidence",
    # Aggregates
    "events_by_user": _counts("user_id"),
    "top_active_users": _counts("user_id", limit=10),
    "failed_by_user": _counts("user_id", "fail"),
    "top_failed_users": _counts("user_id", "fail", 10),
    "scenario_share": _shares("scenario"),
    "status_share": _shares("status"),
    "events_by_country": f"{_EVENTS} SELECT country, count(*) AS n, country IN {_WATCHED} AS suspicious FROM ev GROUP BY country",
    "events_by_resource": _counts("resource"),
    "top_resources": _counts("resource", limit=10),
    "sensitive_by_country": f"{_EVENTS} SELECT country, count(*) AS n FROM ev WHERE resource IN {_SENSITIVE} GROUP BY country",
    "events_by_hour": f"""{_EVENTS}, hours AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1)
SELECT hour, n, hour < 6 AS off_hours, repeat('█', CAST(n // 20 AS INTEGER)) AS bar,
       (SELECT {_ratio('sum(n)', 'count(*)', 2)} FROM hours) AS mean_n FROM hours""",
    "risk_by_country": f"SELECT *, country IN {_WATCHED} AS suspicious FROM ({_mean_risk('country')})",
    "risk_by_scenario": _mean_risk("scenario"),
    "risk_stats": f"""{_EVENTS} SELECT count(risk_score) AS n, {_ratio('sum(risk_score)', 'count(risk_score)', 1)} AS mean,
       round(stddev_samp(risk_score), 1) AS std, min(risk_score) AS min, round(quantile_cont(risk_score, 0.25), 1) AS p25,
       round(quantile_cont(risk_score, 0.5), 1) AS p50, round(quantile_cont(risk_score, 0.75), 1) AS p75, max(risk_score) AS max
FROM ev""",
    "null_counts": _EVENTS
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM ev" for c in _COLUMNS),
    "dataset_profile": f"""{_EVENTS} SELECT count(*) AS n_rows, CAST(10 AS INTEGER) AS n_columns, '{_PROFILE_TYPES}' AS column_types,
       min(ts) AS first_ts, max(ts) AS last_ts FROM ev""",
    "events_preview": f"{_EVENTS} SELECT * FROM ev ORDER BY event_id LIMIT 3",
    "alerts_by_type": _counts("alert_type", "al", prefix=_BATCH),
    "alerts_by_user": _counts("user_id", "al", prefix=_BATCH),
    "top_alerted_users": f"""{_BATCH}, users AS (SELECT user_id, count(*) AS n FROM al GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10)
SELECT user_id, n, {_ratio('n', '(SELECT max(n) FROM users)', 3)} AS ratio FROM users""",
    "alerts_timeline": f"{_BATCH} SELECT CAST(first_event AS DATE) AS day, count(*) AS n FROM al GROUP BY 1",
    "max_risk_by_type": f"{_BATCH} SELECT alert_type, max(max_risk_score) AS max_risk FROM al GROUP BY alert_type",
    "alert_type_options": f"{_BATCH} SELECT DISTINCT alert_type FROM al",
    "latest_alerts": f"""{_BATCH} SELECT alert_type, user_id, country, resource, max_risk_score, event_count, detail FROM al
ORDER BY first_event DESC, alert_type, user_id, country LIMIT 5""",
    "alert_kpis": f"""{_BATCH} SELECT count(*) AS n_alerts, count(DISTINCT alert_type) AS n_types, count(DISTINCT user_id) AS n_users,
       (SELECT count(*) FROM ev) AS n_events FROM al""",
    # Batch rules
    "rule_brute_force": f"{_BATCH} SELECT * FROM rule1",
    "rule_suspicious_country": f"{_BATCH} SELECT * FROM rule2",
    "rule_off_hours": f"{_BATCH} SELECT * FROM rule3",
    "rule_compromised_account": f"{_BATCH} SELECT * FROM rule4",
    "rule_slow_brute_force": _SLOW,
    "all_alerts": _ALL_ALERTS,
    "all_alerts_with_slow": f"{_BATCH} SELECT {_ALERT_COLUMNS} FROM al UNION ALL SELECT {_ALERT_COLUMNS} FROM rule5",
    "detection_rate": f"""{_BATCH} SELECT (SELECT count(*) FROM al) AS total_alerts, (SELECT count(*) FROM ev) AS total_events,
       {_ratio('100 * (SELECT count(*) FROM al)', '(SELECT count(*) FROM ev)', 2)} AS alert_rate""",
    # Windows
    "failure_windows": f"{_BATCH} SELECT user_id, ts, failures, window_failures, window_last, window_max_risk FROM windows",
    "trailing_failures": f"{_SCORED} SELECT event_id, user_id, ts, trailing_failures FROM scored",
    "history_split": f"""{_BATCH} SELECT event_id, user_id, ordinal, user_events, ordinal <= user_events // 2 AS in_baseline
FROM ranked""",
    "user_event_ordinal": f"{_BATCH} SELECT event_id, user_id, ordinal, user_events FROM ranked",
    "user_profile": f"""{_EVENTS} SELECT event_id, user_id, min(ts) OVER {_SO_FAR} AS first_event, max(ts) OVER {_SO_FAR} AS last_event,
       array_to_string(list_sort(list_distinct(list(country) OVER {_SO_FAR})), ',') AS countries_seen,
       array_to_string(list_sort(list_distinct(list(hour(ts)) OVER {_SO_FAR})), ',') AS hours_seen
FROM ev""",
    "baseline_resources": f"""{_BATCH} SELECT user_id, resource, min(ordinal) AS first_ordinal, count(*) AS uses FROM ranked
WHERE ordinal <= 50 GROUP BY user_id, resource""",
    "running_kpis": f"{_SCORED}{_RUNNING} SELECT *, {_rate_text('total_alerts', 'total_events')} AS rate FROM kpis",
    # Stream rules
    "stream_rule_brute_force": f"{_SCORED} {_STREAM_ALERT} WHERE rule_order = 1",
    "stream_rule_suspicious_country": f"{_SCORED} {_STREAM_ALERT} WHERE rule_order = 2",
    "stream_rule_off_hours": f"{_SCORED} {_STREAM_ALERT} WHERE rule_order = 3",
    "stream_rule_compromised_account": f"{_SCORED} {_STREAM_ALERT} WHERE rule_order = 4",
    "stream_event_alerts": f"""{_SCORED}{_COUNTED} SELECT event_id, user_id, score, n_alerts, coalesce(texts, '') AS alerts
FROM alert_count""",
    "stream_enriched_alerts": f"{_STREAM_ENRICHED} SELECT event_id, {_ENRICHED_COLUMNS} FROM graded JOIN listed USING (event_id, alert_type)",
    "stream_summary": f"""{_SCORED}, top_users AS (SELECT user_id, count(*) AS n FROM sa GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5)
SELECT 'total' AS section, 'events' AS name, (SELECT count(*) FROM ev) AS n, '' AS rate
UNION ALL SELECT 'total', 'alerts', (SELECT count(*) FROM sa), {_rate_text('(SELECT count(*) FROM sa)', '(SELECT count(*) FROM ev)')}
UNION ALL SELECT 'type', alert_type, count(*), '' FROM sa GROUP BY alert_type
UNION ALL SELECT 'user', user_id, n, '' FROM top_users""",
    "recent_alerts": f"{_SCORED} {_STREAM_ALERT} ORDER BY ts DESC, event_id DESC, rule_order DESC LIMIT 50",
    "recent_events": f"""{_EVENTS} SELECT event_id, ts, user_id, country, resource, status FROM ev
ORDER BY ts DESC, event_id DESC LIMIT 100""",
    # Streaming jobs: the finished stream must hold what the relational form gives
    "stream_events": f"{_EVENTS} SELECT * FROM ev",
    "stream_user_state": f"""{_SCORED} SELECT user_id, count(*) AS events, min(ts) AS first_event, max(ts) AS last_event,
       string_agg(DISTINCT country, ',' ORDER BY country) AS countries,
       array_to_string(list_sort(list_distinct(list(hour(ts)))), ',') AS hours,
       coalesce(string_agg(DISTINCT resource, ',' ORDER BY resource) FILTER (WHERE ordinal <= 50), '') AS baseline,
       coalesce(string_agg(DISTINCT resource, ',' ORDER BY resource) FILTER (WHERE ordinal > 50), '') AS recent
FROM scored GROUP BY user_id""",
    "stream_alerts_dedup": f"{_SCORED} {_STREAM_ALERT}",
    "stream_epoch_alerts": f"{_SCORED} {_STREAM_ALERT}",
    "stream_alert_keys": f"""{_SCORED} SELECT user_id, alert_type, CASE rule_order WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M')
       WHEN 2 THEN country WHEN 3 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE resource END AS key FROM sa""",
    "feed_json": _FEED,
    "stream_notifications": _OUTBOX,
    "stream_hourly_kpis": f"""{_SCORED}{_RUNNING}, hours AS (
  SELECT date_trunc('hour', ts) AS hour, count(*) AS events, CAST(sum(n_alerts) AS BIGINT) AS alerts FROM per_event GROUP BY 1
), totals AS (
  SELECT *, CAST(sum(events) OVER (ORDER BY hour) AS BIGINT) AS total_events,
         CAST(sum(alerts) OVER (ORDER BY hour) AS BIGINT) AS total_alerts FROM hours
) SELECT *, {_rate_text('total_alerts', 'total_events')} AS rate FROM totals""",
    "stream_slow_brute_force": _SLOW,
}

# What an epoch keeps up must, at the end, hold what the queries over the whole table give
ORACLES["stream_newest_alerts"] = ORACLES["recent_alerts"]
ORACLES["stream_newest_events"] = ORACLES["recent_events"]
ORACLES["stream_report"] = ORACLES["stream_summary"]
ORACLES["stream_totals"] = f"""{_SCORED} SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM sa) AS alerts,
       (SELECT count(DISTINCT user_id) FROM sa) AS alerted_users"""

# A second run that goes on from the first one's state must give what one run over all gives
ORACLES["stream_resumed_alerts"] = ORACLES["stream_epoch_alerts"]
ORACLES["stream_report_after_history"] = ORACLES["stream_summary"]

ORACLES["burst_evidence"] = f"""{_SCORED} SELECT sa.user_id, sa.event_id AS alert_id, sa.ts AS fired_at, f.event_id, f.ts, f.ip_address, f.country, f.resource
FROM sa JOIN fail f ON f.user_id = sa.user_id AND f.ts >= sa.ts - INTERVAL 120 SECOND
 AND (f.ts < sa.ts OR (f.ts = sa.ts AND f.event_id <= sa.event_id)) WHERE sa.rule_order = 1"""
ORACLES["stream_alert_evidence"] = ORACLES["burst_evidence"]

# Distinct users by day and kind; exact, as the tables have fewer users than a sketch has entries
_USER_DAYS = f"""{_BATCH}, days AS (
  SELECT DISTINCT CAST(ts AS DATE) AS day, 'EVENT' AS kind, user_id FROM ev
  UNION SELECT CAST(first_event AS DATE), 'ALERT', user_id FROM al
  UNION SELECT CAST(first_event AS DATE), alert_type, user_id FROM al
)"""
ORACLES["users_by_day"] = f"{_USER_DAYS} SELECT day, kind, count(*) AS users FROM days GROUP BY day, kind"
ORACLES["users_by_week"] = f"""{_USER_DAYS} SELECT d.day, d.kind, count(DISTINCT e.user_id) AS users
FROM (SELECT DISTINCT day, kind FROM days) d JOIN days e ON e.kind = d.kind AND e.day BETWEEN d.day - 6 AND d.day GROUP BY d.day, d.kind"""
ORACLES["returning_users"] = f"""{_USER_DAYS} SELECT d.day, d.kind, count(e.user_id) AS users
FROM days d LEFT JOIN days e ON e.kind = d.kind AND e.day = d.day - 1 AND e.user_id = d.user_id
WHERE (d.day - 1, d.kind) IN (SELECT (day, kind) FROM days) GROUP BY d.day, d.kind"""
