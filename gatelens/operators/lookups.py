"""Lookups against small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.session import run_dir

def materialised(table: DataFrame) -> DataFrame:
    """Run the plan once and keep its rows as a table in the shared folder, for plans that read them several times."""
    path = run_dir(table.sparkSession, "table")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def on_watchlist(events: DataFrame, watchlist: DataFrame, column: str) -> DataFrame:
    """Events whose ``column`` is in the one-column table ``watchlist``; Spark picks the join by the table's size."""
    names = watchlist.select(F.col(watchlist.columns[0]).alias(column)).distinct()
    return events.join(names, column, "left_semi")
