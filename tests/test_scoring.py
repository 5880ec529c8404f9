"""Score factors, severity and level boundaries, masking and role view."""

import pytest
from events import at, row
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions import scoring
from gatelens.functions.text import html_escape, mask_ip, visible_ip

WATCHED, SENSITIVE = DEFAULT_POLICY.suspicious_countries, DEFAULT_POLICY.sensitive_resources


def scores(frame, cases):
    """Scores of ``(row, attempts)`` cases."""
    df = frame([r for r, _ in cases])
    attempts = F.element_at(F.array(*[F.lit(a) for _, a in cases]), (F.col("event_id") + 1).cast("int"))
    return [r.score for r in df.select("event_id", scoring.risk_score(attempts).alias("score")).orderBy("event_id").collect()]


def test_single_factors(frame):
    cases = [
        (row("14:00:00"), 0),
        (row("14:00:00", country="Russia"), 0),
        (row("14:00:00", resource="admin_panel"), 0),
        (row("14:00:00", status="failed"), 0),
        (row("03:00:00"), 0),
        (row("14:00:00"), 10),
    ]
    assert scores(frame, cases) == [0, 30, 25, 20, 15, 10]


def test_all_factors_reach_the_cap(frame):
    worst = row("03:00:00", "failed", "Russia", "admin_panel")
    assert scores(frame, [(worst, 10), (worst, 0)]) == [100, 90]


def test_cap_holds_with_larger_weights(frame):
    policy = Policy(weight_country=90)
    df = frame([row("03:00:00", "failed", "Russia", "admin_panel")])
    assert df.select(scoring.risk_score(F.lit(10), policy)).first()[0] == 100


def test_every_watched_country_and_sensitive_resource_counts(frame):
    assert scores(frame, [(row("14:00:00", country=c), 0) for c in WATCHED]) == [30] * len(WATCHED)
    assert scores(frame, [(row("14:00:00", resource=r), 0) for r in SENSITIVE]) == [25] * len(SENSITIVE)


def test_hour_and_attempt_boundaries(frame):
    hours = [(row(f"{h:02d}:59:59"), 0) for h in (5, 6, 21, 22)]
    assert scores(frame, hours) == [15, 0, 0, 15]
    assert scores(frame, [(row("14:00:00"), 5), (row("14:00:00"), 6)]) == [0, 10]


def test_unknown_values_score_nothing(frame):
    assert scores(frame, [(row("14:00:00", status=None, country=None, resource=None), 0)]) == [0]


def test_severity_and_level_boundaries(spark):
    values = [0, 1, 39, 40, 69, 70, 89, 90, 100]
    df = spark.createDataFrame([(v,) for v in values], "score int")
    got = df.select(scoring.severity("score").alias("s"), scoring.risk_level("score").alias("l")).collect()
    assert [r.s for r in got] == ["NORMAL", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    assert [r.l for r in got] == ["none", "low", "low", "medium", "medium", "high", "high", "high", "high"]


def test_event_class_and_band(spark):
    df = spark.createDataFrame([(1, 0), (0, 20), (0, 0), (0, 70)], "alerts int, score int")
    got = df.select(
        scoring.event_class(F.col("alerts"), F.col("score")).alias("c"), scoring.score_band(F.col("score")).alias("b")
    ).collect()
    assert [(r.c, r.b) for r in got] == [("critical", "low"), ("warning", "mid"), ("normal", "low"), ("warning", "high")]


def test_ip_mask(spark):
    df = spark.createDataFrame([("192.168.1.45",), (None,), ("abc",), ("10.0.0",)], "ip string")
    got = [r[0] for r in df.select(mask_ip("ip")).collect()]
    assert got == ["192.168.xxx.xxx", None, "xxx.xxx.xxx.xxx", "xxx.xxx.xxx.xxx"]


def test_role_view(spark):
    df = spark.createDataFrame([("admin", True), ("analyst", True), ("admin", False)], "role string, alerted boolean")
    got = df.select(visible_ip(F.col("role"), F.col("alerted"), F.lit("10.1.2.3"))).collect()
    assert [r[0] for r in got] == ["10.1.2.3", "10.1.xxx.xxx", None]


def test_html_escape(spark):
    assert spark.range(1).select(html_escape(F.lit("a<b & c>d"))).first()[0] == "a&lt;b &amp; c&gt;d"


@pytest.mark.parametrize("seconds", [120, 250])
def test_slice_width_is_checked(seconds):
    with pytest.raises(ValueError):
        Policy(slice_seconds=seconds)


def test_fixture_time():
    assert at("01:02:03").hour == 1
