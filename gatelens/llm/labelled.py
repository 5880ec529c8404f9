"""Bounded samples of labelled documents, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.tables import fold_of


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int], folds: int, held: int) -> DataFrame:
    """``doc_id``, ``text`` and the labels of documents outside the held-out fold: for each value of ``column`` the first ids by
    hash, as many as ``most`` says. Only ids are ordered and broadcast, their number is bounded by ``most``."""
    known = labels.filter(F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held)).dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [known.filter(F.col(column) == value).orderBy(order, "doc_id").limit(n) for value, n in most.items()]
    chosen = reduce(DataFrame.unionByName, parts)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
