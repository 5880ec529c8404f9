"""Sources and sinks, enrichment and messages."""

import pytest
from events import row
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, DEFAULT_RECOMMENDATION, Policy
from gatelens.functions.predicates import at_night
from gatelens.plans import batch_rules, enrichment, outbox
from gatelens.schema import ACCESS_EVENT, ALERT, validate_schema
from gatelens.session import run_dir, shared_dir
from gatelens.sinks import tables
from gatelens.sources import access_log


@pytest.fixture(scope="module")
def alerts(frame):
    rows = [row(f"0{h}:00:00", country="Iran", resource="billing", user=u, risk=80) for h in (1, 2) for u in ("a", 'b "x", y')]
    return batch_rules.all_alerts(frame(rows))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_alert_table_roundtrip(spark, alerts, fmt):
    path = run_dir(spark, "alerts")
    assert tables.write_alerts(alerts, path, fmt) == 4
    stored = access_log.read_alerts(spark, path, fmt)
    assert stored.schema == ALERT
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, alerts.collect()))


def test_no_alert_writes_no_data(spark, alerts):
    path = run_dir(spark, "alerts")
    assert tables.write_alerts(alerts.filter("false"), path) == 0
    assert access_log.read_alerts(spark, path).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_access_log_scan(spark, frame, fmt):
    path = run_dir(spark, "log")
    events = frame([row("10:00:00.000007"), row("11:00:00", country="Iran")])
    events.write.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").format(fmt).save(path)
    assert sorted(map(tuple, access_log.read_access_log(spark, path, fmt).collect())) == sorted(map(tuple, events.collect()))
    assert access_log.stream_access_log(spark, path, fmt=fmt).isStreaming


def test_export_is_sorted_and_readable(spark, frame):
    events = frame([row(f"1{i % 3}:00:0{i}.5") for i in range(9)])
    path = run_dir(spark, "export")
    tables.export_log(events, path)
    parsed = access_log.parse_events(access_log.read_raw_log(spark, path))
    assert access_log.quarantined(parsed).count() == 0
    stored = access_log.accepted(parsed)
    assert stored.schema == ACCESS_EVENT
    files = [[r.ts for r in spark.read.csv(f, header=True).collect()] for f in sorted(stored.inputFiles())]
    assert [t for f in files for t in f] == sorted(t for f in files for t in f)


def test_unreadable_rows_are_set_aside(spark):
    good = ("1", "2024-03-04 10:00:00", "u", "1.2.3.4", "Spain", "access", "success", "api", "0", "normal")
    bad = [
        ("2", "04/03/2024", *good[2:]),
        ("3", None, *good[2:]),
        ("x", *good[1:]),
        ("5", good[1], None, *good[3:]),
        ("6", *good[1:8], "high", "normal"),
    ]
    raw = spark.createDataFrame([good, *bad], ", ".join(f"{c} string" for c in ACCESS_EVENT.fieldNames()))
    parsed = access_log.parse_events(raw)
    assert [r.event_id for r in access_log.accepted(parsed).collect()] == [1]
    assert {r.ts_text for r in access_log.quarantined(parsed).collect()} == {"04/03/2024", None, "2024-03-04 10:00:00"}
    assert access_log.quarantined(parsed).count() == 5


def test_schema_check(spark, frame):
    events = frame([row("10:00:00")])
    assert validate_schema(events, ACCESS_EVENT) is events
    with pytest.raises(ValueError, match="missing columns: country"):
        validate_schema(events.drop("country"), ACCESS_EVENT)
    with pytest.raises(ValueError, match="risk_score is string, expected int"):
        validate_schema(events.withColumn("risk_score", F.lit("1")), ACCESS_EVENT)


def test_log_files_are_checked_and_null_keys_set_aside(spark, frame):
    rows = [row("10:00:00"), {**row("10:01:00"), "user_id": None}, row("10:02:00", country=None)]
    good, missing, typed = (run_dir(spark, n) for n in ("good", "missing", "typed"))
    frame(rows).withColumn("extra", F.lit(1)).write.parquet(good)
    frame(rows).drop("status").write.parquet(missing)
    frame(rows).withColumn("risk_score", F.lit("1")).write.parquet(typed)
    events, aside = access_log.load_access_log(spark, good)
    assert (events.count(), aside.count(), events.schema) == (2, 1, ACCESS_EVENT)
    with pytest.raises(ValueError, match="missing columns: status"):
        access_log.read_access_log(spark, missing)
    with pytest.raises(ValueError, match="risk_score is string"):
        access_log.read_access_log(spark, typed)


def test_csv_goes_by_its_header(spark, frame):
    events = frame([row("10:00:00", country="Iran"), row("10:01:00", resource="api")])
    path, short = run_dir(spark, "csv"), run_dir(spark, "csv")
    text = events.withColumn("ts", F.col("ts").cast("string")).select(*reversed(ACCESS_EVENT.fieldNames()))
    text.write.options(**access_log.TEXT_OPTIONS).csv(path)
    text.drop("country").write.options(**access_log.TEXT_OPTIONS).csv(short)
    got, aside = access_log.load_access_log(spark, path, "csv")
    assert sorted(got.collect()) == sorted(events.collect()) and aside.count() == 0
    with pytest.raises(ValueError, match="missing columns: country"):
        access_log.read_access_log(spark, short, "csv")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_a_log_without_ids_gets_them(spark, frame, fmt):
    twice = [row("10:00:00"), row("10:00:00"), row("10:00:00", country="Iran")]
    path = run_dir(spark, "plain")
    plain = frame(twice).drop("event_id").withColumnRenamed("ts", "timestamp")
    if fmt in ("csv", "json"):
        plain = plain.withColumn("timestamp", F.col("timestamp").cast("string"))
    plain.coalesce(1).write.format(fmt).options(**access_log._options(fmt)).save(path)
    read = lambda: sorted((r.event_id, r.country) for r in access_log.read_access_log(spark, path, fmt, {"timestamp": "ts"}).collect())
    assert len({i for i, _ in read()}) == 3 and read() == read()


def test_alert_export_is_quoted(spark, frame):
    path = run_dir(spark, "export")
    alerts = frame([row("03:00:00")]).select(F.lit("X").alias("alert_type"), "user_id", F.lit('a "b", c').alias("country"), F.lit(1).alias("score"), F.lit("d").alias("detail"))
    tables.write_alert_export(alerts, "admin", path)
    assert '"a ""b"", c"' in "".join(r[0] for r in spark.read.text(path).collect())
    assert spark.read.schema(tables.EXPORTED).options(**access_log.TEXT_OPTIONS).csv(path).first().country == 'a "b", c'


@pytest.mark.parametrize("start, end, hours", [(0, 6, {0, 5}), (22, 6, {0, 5, 22, 23}), (6, 6, set())])
def test_nights_may_cross_midnight(frame, start, end, hours):
    events = frame([row(f"{h:02d}:00:00") for h in (0, 5, 6, 12, 21, 22, 23)])
    got = events.filter(at_night(Policy(night_start=start, night_end=end))).collect()
    assert {r.ts.hour for r in got} == hours


def test_only_admins_export(frame):
    events = frame([row("03:00:00", resource="billing")])
    alerts = events.select(F.lit("X").alias("alert_type"), "user_id", "country", F.lit(1).alias("score"), F.lit("d").alias("detail"), "ts")
    assert tables.alert_export(alerts, "admin").columns == ["alert_type", "user_id", "country", "score", "detail"]
    with pytest.raises(PermissionError):
        tables.alert_export(alerts, "analyst")


def one_alert(spark, kind, score, detail="d"):
    columns = "event_id long, alert_type string, user_id string, country string, resource string, score int, detail string"
    return spark.createDataFrame([(1, kind, "u", "Iran", "billing", score, detail)], columns).withColumn(
        "ts", F.expr("TIMESTAMP_NTZ '2024-03-04 10:00:00.25'")
    )


@pytest.mark.parametrize(
    "kind, score, severity, expected",
    [
        ("BRUTE_FORCE", 95, "CRITICAL", DEFAULT_POLICY.recommendations["BRUTE_FORCE"]["CRITICAL"]),
        ("OFF_HOURS", 0, "NORMAL", DEFAULT_POLICY.recommendations["OFF_HOURS"]["LOW"]),
        ("SOMETHING_ELSE", 75, "HIGH", (DEFAULT_RECOMMENDATION,)),
    ],
)
def test_recommendations(spark, kind, score, severity, expected):
    got = enrichment.enrich(one_alert(spark, kind, score)).first()
    assert (got.severity, tuple(got.recommendations), got.timestamp) == (severity, expected, "2024-03-04 10:00:00")


def test_a_higher_severity_calls_for_all_steps_of_a_lower_one():
    for by in DEFAULT_POLICY.recommendations.values():
        lists = [by[level] for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
        assert all(len(high) > 0 and high[len(high) - len(low) :] == low for high, low in zip(lists, lists[1:]))


def test_enrichment_joins_nothing_and_has_the_band(spark):
    rows = enrichment.enrich(one_alert(spark, "OFF_HOURS", 72))
    assert (rows.first().min_score, rows.first().max_score) == (70, 89)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_outbox_keeps_the_first_high_risk_alert(spark):
    low = one_alert(spark, "OFF_HOURS", 69)
    later = one_alert(spark, "OFF_HOURS", 95, "later").withColumn("ts", F.expr("ts + INTERVAL '5' SECOND"))
    first = one_alert(spark, "OFF_HOURS", 70, "a<b & c").withColumn("ts", F.expr("ts + INTERVAL '1' SECOND"))
    sent = outbox.notification_outbox(low.unionByName(later).unionByName(first)).collect()
    assert [(m.score, m.subject) for m in sent] == [(70, "HIGH 🟠 u: OFF HOURS")]
    assert "What: a<b & c" in sent[0].body_text and "1) List the statements" in sent[0].body_text
    assert "<td>a&lt;b &amp; c</td>" in sent[0].body_html


def test_threshold_of_the_outbox_is_configurable(spark):
    assert outbox.notification_outbox(one_alert(spark, "OFF_HOURS", 69), Policy(high_risk=60)).count() == 1


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert run_dir(spark, "x") != run_dir(spark, "x")
