"""Intermediate tables in the shared folder, documents in blocks, folds, and connected components.

A block holds some megabytes of whole documents. Blocks exchange keys instead of rows: a block sends each of its distinct
keys once, as one binary value per (bucket, block), a bucket's task compares what it got from all blocks and answers with
one binary value in the same order. So a key that a third of all documents share reaches a bucket once per block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.session import run_dir

BLOCK_BYTES = 8_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Run the plan and keep its rows in the shared folder: readers no longer depend on executors that ran it."""
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def dealt_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, by_id: bool = True) -> tuple[DataFrame, int]:
    """Documents (``doc_id``, ``text``) in blocks of consecutive ids, one a partition, and the block count. Nothing is stored yet.

    Equal ids are in one block, null ids in the first; if not ``by_id``, rows are dealt evenly, whatever their ids.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(size / block_bytes), shuffle_partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id") if by_id else rows.repartition(n)
    return dealt.withColumn("block", F.spark_partition_id()), n


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, by_id: bool = True) -> tuple[DataFrame, int]:
    """``dealt_blocks``, stored bucketed by ``block``: joins on ``block`` then leave the texts where they are."""
    dealt, n = dealt_blocks(docs, block_bytes, by_id)
    return by_block(dealt, n, "blocks"), n


def by_block(df: DataFrame, n: int, name: str) -> DataFrame:
    """The rows, stored in ``n`` buckets of their ``block``."""
    spark = df.sparkSession
    path, table = run_dir(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, "block").saveAsTable(table)
    return spark.table(table)


def ordered(table: pa.Table) -> pa.Table:
    """A block's documents by id, null first; equal ids by text."""
    import pyarrow.compute as pc

    by = [("doc_id", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=by, null_placement="at_start"))


def binary_rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def compacted(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` with each partition's share replaced by as few links with the same components."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(root(x), x) for x in list(parent)]
            return pa.RecordBatch.from_pylist([{"a": r, "b": x} for r, x in pairs if r != x], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:  # bounded memory: the rest of the partition starts a new forest
                yield stars()
                parent.clear()
        yield stars()

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return links.select("a", "b").mapInArrow(forest, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` for each node of the links ``a``, ``b``; a component's name is its smallest node.

    Large-star and small-star steps in turn: each hangs a node's neighbours under the smallest of them, until only stars
    are left: no node has two smaller neighbours, or a smaller and a larger one. All links stay distributed, and each round is stored, so a
    lost executor costs no more than a round.
    """
    edges = saved(compacted(links.filter("a <> b")).distinct(), "links")  # here and below a < b
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        below, above = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        nodes = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), ((below > 1) | ((below > 0) & (above > 0))).alias("open")), "nodes")
        if not nodes.agg(F.bool_or("open")).first()[0]:
            break
        large = edges.join(nodes, "a").select(F.col("least").alias("a"), "b")
        # b's smaller neighbours and b itself hang under the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("least"))
        small = large.join(low, "b").select(F.col("least").alias("x"), F.col("a").alias("y")).union(low.select(F.col("least").alias("x"), F.col("b").alias("y")))
        edges = saved(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
