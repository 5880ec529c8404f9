from __future__ import annotations

import pytest
from compare import connect, differences
from odd import ODD
from pyspark.sql import functions as F

from gatelens.llm import source_mix as m


def targets(spark, sizes):
    rows = m.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()
    return {r.source: (r.source_size, pytest.approx(r.target), r.rate) for r in rows}


def test_targets_follow_weights_and_caps(spark):
    found = targets(spark, [("a", 600), ("b", 10), ("c", 390), (None, 0)])
    # Weights 1, 2, 3, 1 of 1000 words: b stops at 30, the null source at 0, the rest share 970 as 1 to 3.
    assert {k: v[1] for k, v in found.items()} == {"a": 242.5, "b": 30, "c": 727.5, None: 0}
    assert found["b"][2] == 3 and found[None][2] == 0


def test_everything_stopped_or_empty(spark):
    assert targets(spark, [("a", 0)])["a"] == (0, 0.0, 0.0)
    assert targets(spark, [("a", 50)])["a"][1] == 50
    assert targets(spark, []) == {}


def test_copies_follow_the_rate_and_agree(docs, prose):
    rows = docs([(k, prose(10), "en", f"s{k % 3}") for k in range(900)])
    plan = m.mix_plan(rows)
    first = {r.doc_id: r.copies for r in plan.collect()}
    assert first == {r.doc_id: r.copies for r in m.mix_plan(rows.repartition(5)).collect()}
    for r in plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.12 * r.target + 60
    assert m.emit(plan).count() == sum(first.values())
    assert m.emit(plan).groupBy("doc_id", "copy").count().filter("count > 1").isEmpty()


def test_odd_rows_and_clashing_columns(docs):
    table = docs(ODD).withColumn("size", F.lit("mine")).withColumn("target", F.lit(-1))
    rows = m.mix_plan(table).collect()
    assert len(rows) == len(ODD)
    assert {r.size for r in rows if not (r.text or "").strip()} == {0}
    assert {r.size for r in rows if r.doc_id == 7} == {3001}
    assert all(0 <= r.copies <= 3 for r in rows)
    assert m.mix_plan(docs(ODD).limit(0)).count() == 0


def test_query_equals_sql_on_odd_sources(spark, docs, folder):
    rows = [(k, "x " * (k % 7), "en", [None, "", "a", "é", "b"][k % 5]) for k in range(120)] + [(None, "two words", "en", "a"), (3, None, "en", None)]
    path = folder(documents=docs(rows, 1))
    con = connect(path)
    con.execute("DROP VIEW documents")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    assert differences(m.op10_source_mix(spark, path), con, m.ORACLES["op10_source_mix"]) == []
