"""Maps the generic ``events`` test table to access events.

The test table is too sparse for the rules, so some users' times are folded into bursts. All arithmetic is on integers,
so any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.config import DEFAULT_POLICY, Policy
from gatelens.functions import scoring
from gatelens.schema import ACCESS_EVENT, RAW_EVENT, validate_schema

# Countries and resources the adapter hands out by position.
WATCHED_COUNTRIES = ("Russia", "China", "North Korea", "Nigeria", "Iran")
HOME_COUNTRIES = ("Argentina", "Brazil", "Mexico", "Spain", "Colombia")
SENSITIVE = ("admin_panel", "database", "billing")
ORDINARY = ("login", "dashboard", "api", "file_storage")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def adapt(raw: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """ACCESS_EVENT rows from raw events; works on batch and streaming input."""
    uid, eid = F.col("uid"), F.col("event_id")
    prof, k = F.col("prof"), F.col("k")
    base = raw.select(
        "event_id",
        "ts",
        "event_type",
        F.col("user_id").alias("uid"),
        (F.col("user_id") % 10).alias("prof"),
        (F.floor(F.col("user_id") / 10) % 5).alias("d"),
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int").alias("k"),
    )
    roles = base.select(
        "*",
        (prof == 0).alias("burst"),
        ((prof == 2) & (eid % 9 == 0)).alias("odd"),
        (
            (prof == 1) & (F.col("event_type") == "error") & (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
        ).alias("comp"),
    )
    shifted = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((eid * 7919) % 300).cast("decimal(18,6)"))
    night = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((eid * 7919) % 18000).cast("decimal(18,6)"))
    hours = F.make_dt_interval(F.lit(0), (uid % 24).cast("int"))
    abroad = F.col("burst") | F.col("odd")
    shaped = roles.select(
        "event_id",
        F.when(F.col("burst"), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'") + hours + shifted)
        .when(F.col("comp"), F.to_date("ts").cast("timestamp_ntz") + night)
        .otherwise(F.col("ts"))
        .alias("ts"),
        F.concat(F.lit("user_"), F.lpad(uid.cast("string"), 5, "0")).alias("user_id"),
        F.concat_ws(
            ".",
            F.when(abroad, eid % 50 + 1).otherwise(eid % 50 + 150).cast("string"),
            (eid % 256).cast("string"),
            (uid % 256).cast("string"),
            (k % 254 + 1).cast("string"),
        ).alias("ip_address"),
        F.when(abroad, _pick(WATCHED_COUNTRIES, F.col("d"))).otherwise(_pick(HOME_COUNTRIES, F.col("d"))).alias("country"),
        F.when(F.col("burst"), "login_attempt").otherwise("access").alias("action"),
        F.when(F.col("burst") & (F.col("event_type") != "purchase"), "failed")
        .when(~F.col("burst") & (F.col("event_type") == "error") & (k < 25), "failed")
        .otherwise("success")
        .alias("status"),
        F.when(abroad | F.col("comp"), _pick(SENSITIVE, k % 3)).otherwise(_pick(ORDINARY, k % 4)).alias("resource"),
        F.when(F.col("burst"), eid % 12).otherwise(0).alias("attempts"),
        F.when(F.col("burst"), "brute_force")
        .when(prof == 1, "compromised_account")
        .when(prof == 2, "unusual_country")
        .otherwise("normal")
        .alias("scenario"),
    )
    scored = shaped.withColumn("risk_score", scoring.risk_score(F.col("attempts"), policy))
    return scored.select(*ACCESS_EVENT.fieldNames())


def access_events(spark: SparkSession, sf_dir: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    raw = spark.read.schema(RAW_EVENT).parquet(f"{sf_dir}/events.parquet")
    return validate_schema(adapt(raw, policy), ACCESS_EVENT)
