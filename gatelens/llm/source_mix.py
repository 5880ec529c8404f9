"""Mixing sources to target weights.

Sizes are summed per source, each source gets a target number of words and from it a repetition rate, and each document is
emitted ``floor(rate)`` times, plus once more with the rate's fraction as probability. The chance comes from a hash of the
seed and the id, so a rerun takes the same copies.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with equal ids share
their chance; a source without words has target 0 and rate 0; an empty table gives an empty result; only ``doc_id``,
``text`` and ``source`` are read, and other columns are passed on, unless they carry the name of an added one (these are replaced).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.tables import read_table, saved
from gatelens.llm.words import as_bytes

SEED = "mix"
MOST_REPEATS = 3
WEIGHTS = 3
ADDED = ("size", "source_size", "target", "rate", "copies")


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Words between white space, 0 for null; splitting bytes takes a third of the time of a regular expression."""
    return pa.array([len(t.split()) if t else 0 for t in as_bytes(text)], pa.int64())


def source_targets(sizes: DataFrame, weights: int = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rate`` from rows of ``source`` and ``size``.

    Weights go 1, 2, ... ``weights`` and again, by source in code point order, null last. The words of all sources are shared by weight.
    A share above ``most_repeats`` times the source stops there and the rest is shared again: with sources by cap over
    weight, a source is stopped if what is left for it and its successors would lift it to its cap.
    The windows are over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", (rank % weights + 1).cast("double"))
    cap = F.col("source_size").cast("double") * most_repeats
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most_repeats).over(upto), F.lit(0))
    by = by.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    by = by.withColumn("stopped", cap <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything)  # the first that is not stopped
    target = F.when(F.col("stopped"), cap).otherwise(F.least(cap, F.col("weight") * level))
    by = by.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return by.select("source", "source_size", "target", rate.alias("rate"))


def chance(id_column: str, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def copies(rate: Column, id_column: str, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + (chance(id_column, seed) < rate - whole).cast("long")).cast("long")


def mix_plan(docs: DataFrame, seed: str = SEED, weights: int = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``, each in one row.

    The table of sources is stored, so its size is known when Spark chooses how to join it.
    """
    docs = docs.drop(*ADDED).withColumn("size", word_count("text"))
    targets = saved(source_targets(docs.select("source", "size"), weights, most_repeats), "sources")
    targets = targets.withColumnRenamed("source", "mix_source")
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["mix_source"]), "left").drop("mix_source")
    return joined.withColumn("copies", copies(F.col("rate"), "doc_id", seed))


def emit(plan: DataFrame) -> DataFrame:
    """Each document as often as planned; ``copy`` counts from 1."""
    kept = plan.filter("copies > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


QUERIES = {"op10_source_mix": op10_source_mix}
ORACLES = {
    "op10_source_mix": f"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {WEIGHTS} + 1)::DOUBLE AS weight
    FROM sized GROUP BY source
), shares AS (
    SELECT 0 AS step, source, source_size, weight, false AS stopped FROM sources
    UNION ALL
    SELECT step + 1, source, source_size, weight,
           stopped OR {MOST_REPEATS}.0 * source_size <= weight
               * (sum(source_size) OVER () - coalesce(sum(CASE WHEN stopped THEN {MOST_REPEATS} * source_size END) OVER (), 0))
               / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0)
    FROM shares WHERE step < (SELECT count(*) FROM sources)
), final AS (
    SELECT source, source_size, coalesce(stopped, true) AS stopped, weight,
           (sum(source_size) OVER () - coalesce(sum(CASE WHEN stopped THEN {MOST_REPEATS} * source_size END) OVER (), 0))::DOUBLE
               / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0) AS level
    FROM shares WHERE step = (SELECT max(step) FROM shares)
), targets AS (
    SELECT source, source_size,
           CASE WHEN stopped THEN {MOST_REPEATS}.0::DOUBLE * source_size ELSE weight * level END AS target FROM final
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
), planned AS (
    SELECT doc_id, size, source_size, target, rate,
           (floor(rate) + (CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {2**52}
                < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS copies
    FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, rate, copies FROM planned
"""
}
