"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from gatelens.operators.lookups import materialised
from gatelens.plans import batch_rules, stream_rules
from gatelens.queries import REGISTRY
from gatelens.sources.adapter import access_events
from gatelens.session import local_session

# The better of two runs counts; streaming jobs run once.
BATCH = [
    "access_events",
    "export_events",
    "events_by_hour",
    "risk_stats",
    "top_failed_users",
    "failure_windows",
    "contextual_risk",
    "user_profile",
    "history_split",
    "rule_brute_force",
    "rule_suspicious_country",
    "rule_off_hours",
    "rule_compromised_account",
    "rule_slow_brute_force",
    "all_alerts",
    "alert_evidence",
    "alert_enriched",
    "stream_event_alerts",
    "stream_enriched_alerts",
    "stream_summary",
    "running_kpis",
    "notification_outbox",
]
STREAMING = ["stream_alerts_dedup", "stream_slow_brute_force", "stream_epoch_alerts"]


#: How often each event of the table is taken for the two hot logs.
HOT_COPIES = (3, 12)


def hot_log(spark, sf_dir: str, copies: int):
    """The table's events several times over, a third of them one user's failures within two hours."""
    events = access_events(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    events = events.withColumn("event_id", F.col("event_id") * copies + F.col("copy")).drop("copy")
    hot = F.col("event_id") % 3 == 0
    flood = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'") + F.make_dt_interval(secs=(F.xxhash64("event_id") % 3600 + 3600).cast("decimal(18,6)"))
    return events.withColumns(
        {
            "user_id": F.when(hot, "hot").otherwise(F.col("user_id")),
            "status": F.when(hot, "failed").otherwise(F.col("status")),
            "ts": F.when(hot, flood).otherwise(F.col("ts")),
        }
    )


def hot_seconds(spark, sf_dir: str) -> dict[str, float]:
    out = {}
    for copies in HOT_COPIES:
        log = materialised(hot_log(spark, sf_dir, copies))
        for name, plan in (("brute_force", batch_rules.brute_force), ("detect", stream_rules.detect)):
            start = time.perf_counter()
            plan(log).write.format("noop").mode("overwrite").save()
            out[f"{name}_x{copies}"] = round(time.perf_counter() - start, 3)
    return out


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="gatelens-bench")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {name: round(min(timed(spark, name, sf_dir) for _ in range(2)), 3) for name in BATCH}
    seconds.update({name: round(timed(spark, name, sf_dir), 3) for name in STREAMING})
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
                "events": events,
                "hot_user_seconds": hot_seconds(spark, sf_dir),
                "events_per_sec": {name: round(events / s) for name, s in seconds.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
