"""Frequency tables and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.numbers import ratio


def frequency(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per value of ``key``; null is not a value."""
    return df.groupBy(key).agg(F.count("*").alias(name)).filter(F.col(key).isNotNull())


def top(counts: DataFrame, key: str, k: int | None = None, name: str = "n") -> DataFrame:
    """Largest counts first, ties by key; all rows if ``k`` is not given."""
    ordered = counts.orderBy(F.desc(name), key)
    return ordered if k is None else ordered.limit(k)


def mean_by(df: DataFrame, key: str, value: str, name: str, places: int = 1) -> DataFrame:
    """Mean of an integer column per key, rounded half up."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return sums.filter(F.col(key).isNotNull() & (F.col("n") > 0)).select(
        key, F.col("n"), ratio(F.col("total"), F.col("n"), places).alias(name)
    )
