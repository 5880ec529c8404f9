"""Every registered query against its SQL in DuckDB.

``GATELENS_SF_DIR`` chooses another table folder; the smallest one keeps the suite quick.
"""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from gatelens.oracles import ORACLES
from gatelens.queries import REGISTRY

SF_DIR = os.environ.get("GATELENS_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    assert differences(result, con, SQL[name]) == []


@pytest.mark.parametrize(
    "name", [n for n in QUERIES if n.startswith(("rule_", "stream_rule_")) or n in ("alert_evidence", "notification_outbox")]
)
def test_no_rule_is_empty(con, name):
    assert con.sql(f"SELECT count(*) FROM ({SQL[name]})").fetchall()[0][0] > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["alert_type", "user_id", "detail", "first_event", "last_event", "country", "resource",
                          "max_risk_score", "event_count"]
    assert {r.alert_type: r["count"] for r in df.groupBy("alert_type").count().collect()} == {
        "BRUTE_FORCE": 5, "SUSPICIOUS_COUNTRY": 4, "OFF_HOURS": 5, "COMPROMISED_ACCOUNT": 3,
    }
