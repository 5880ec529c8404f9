"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it.

Equal vectors are one node that carries the smallest ids of its rows, enough for any result. The graph starts from random
hyperplane cells, in which small chunks are compared whole. Each round then gathers at every node the vectors of its neighbours and
reverse neighbours (a Spark join), compares them with each other (neighbours of neighbours), and keeps each node's best.
Rounds end when few edges change. Queries start at their own node and expand their best unexpanded nodes, a join a round, until
none of the best ``BEAM`` is unexpanded; these are ranked by the exact cosine in double precision.

The graph's joins carry vectors as unit vectors of 16-bit floats; hubs take part with at most ``REVERSE`` reverse neighbours a
round, new ones first, then by hash, as the method does. All rows are nodes; nothing is gathered beyond a node's lists.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as do rows with a
null id and vectors of another length than the commonest; a repeated id with the same vector counts once, with different
vectors it is a row each; with fewer candidates than wanted all are returned; equal scores go by id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.tables import read_table, saved, shuffle_partitions

NEIGHBOURS, REVERSE, BEAM, EXPANDED = 30, 30, 96, 16
TREES, CHUNK, CELL = 3, 160, 2000
MOST_ROUNDS, MOST_STEPS, FEW = 8, 12, 0.01
#: A node hands on so many of a member's best new neighbours a round; the others can come up in later rounds.
HANDED_ON = 8
EVERY, WANTED = 50, 5

EDGES_DDL = "node long, near long, score float"


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``vector`` (array of float) of the rows that take part."""
    vector = F.col(vector_column).cast("array<float>")
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector")).filter(
        F.col("id").isNotNull() & F.coalesce(F.forall("vector", good) & F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    lengths = kept.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return kept.filter(F.size("vector") == (lengths["length"] if lengths else 0))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width = len(batch.column(0)[0]) if batch.num_rows else 0
        v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, max(1, width))
        wide = v.astype(np.float64)
        unit = (wide / np.abs(wide).max(1, keepdims=True, initial=1e-300)) if len(v) else wide
        unit = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([x.tobytes() for x in unit], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary()), batch.column(2)],
            names=["node", "unit", "vector", "ids"],
        )


def nodes_of(vectors: DataFrame, ids_kept: int = WANTED + 1) -> DataFrame:
    """``node`` (the smallest id with a vector), ``unit``, ``vector`` and the ``ids_kept`` smallest ``ids`` of each distinct vector.

    The row limit per vector is applied before the shuffle, so a vector of any frequency stays small.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = vectors.dropDuplicates(["id", "vector"]).withColumn("place", place).filter(F.col("place") <= ids_kept)
    rows = first.groupBy("vector").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    # Two vectors may share a repeated id: a node's name must be its own.
    again = F.row_number().over(Window.partitionBy("node").orderBy("vector"))
    rows = rows.withColumn("again", again).withColumn("node", F.when(F.col("again") == 1, F.col("node")).otherwise(F.xxhash64("vector")))
    return rows.select("vector", "node", "ids").mapInArrow(_pack, "node long, unit binary, vector binary, ids array<long>")


def _units(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float16).reshape(len(values), -1).astype(np.float32)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _cells(trees: int, bits: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch.column(1))
            planes = np.random.default_rng(17).standard_normal((unit.shape[1], trees, max(1, bits))).astype(np.float32)
            sides = (np.einsum("nd,dtb->ntb", unit, planes) > 0)[:, :, :bits]
            cells = (sides * (1 << np.arange(bits))).sum(2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(cells[:, t].astype(np.int64)), *batch.columns], names=["tree", "cell", "node", "unit"])

    return cut


def _compared(rows: pa.Table) -> pa.Table:
    """The best neighbours within chunks of a cell that lie along a random direction."""
    node, unit = rows.column("node").to_numpy(), _units(rows.column("unit"))
    along = unit @ np.random.default_rng(int(rows.column("tree")[0].as_py())).standard_normal(unit.shape[1]).astype(np.float32)
    order, out = np.lexsort((node, along)), []
    for part in np.array_split(order, max(1, math.ceil(len(order) / CHUNK))):
        scores = unit[part] @ unit[part].T
        np.fill_diagonal(scores, -2)
        best = _best(scores, min(NEIGHBOURS, max(1, len(part) - 1)))
        score = np.take_along_axis(scores, best, 1)
        own = score > -2
        out.append((np.repeat(node[part], own.sum(1)), node[part][best][own], score[own]))
    return _edges(out)


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
    return pa.table({"node": pa.array(columns[0], pa.int64()), "near": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float32())})


def kept_best(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Each node's ``k`` nearest, each once; ``fresh`` if no row of the edge is ``old``. One exchange, on the node, serves both steps."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "near"))
    once = edges.repartition("node").groupBy("node", "near").agg(F.max("score").alias("score"), (~F.max("old")).alias("fresh"))
    return once.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def first_graph(nodes: DataFrame) -> DataFrame:
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / CHUNK)))
    cells = saved(nodes.select("node", "unit").mapInArrow(_cells(TREES, bits), "tree int, cell long, node long, unit binary"), "cells")
    sizes = cells.groupBy("tree", "cell").count().withColumn("parts", F.ceil(F.col("count") / CELL)).drop("count")
    salted = cells.join(sizes, ["tree", "cell"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")))
    found = salted.select("tree", "cell", "salt", "node", "unit").groupBy("tree", "cell", "salt").applyInArrow(_compared, EDGES_DDL)
    return kept_best(found.withColumn("old", F.lit(False)))


def _local_join(rows: pa.Table) -> pa.Table:
    """For each center, all pairs of its neighbours that are better than what either of the two has, one of them being new."""
    rows = rows.sort_by("center")
    center, node, worst = (rows.column(c).to_numpy() for c in ("center", "node", "worst"))
    fresh, unit = rows.column("fresh").to_numpy(zero_copy_only=False).astype(bool), _units(rows.column("unit"))
    starts = np.flatnonzero(np.r_[True, center[1:] != center[:-1]])
    out = []
    for s, e in zip(starts, np.r_[starts[1:], len(center)]):
        if e - s < 2 or not fresh[s:e].any():
            continue
        scores = unit[s:e] @ unit[s:e].T
        scores[~(fresh[s:e, None] | fresh[None, s:e])] = -2
        np.fill_diagonal(scores, -2)
        better = scores > worst[s:e, None]
        if e - s > HANDED_ON:
            better &= scores >= np.partition(scores, -HANDED_ON, axis=1)[:, -HANDED_ON, None]
        i, j = np.nonzero(better)
        out.append((node[s + i], node[s + j], scores[i, j]))
    return _edges(out).group_by(["node", "near"]).aggregate([("score", "max")]).rename_columns(["node", "near", "score"])


def descend(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """One round: the graph's edges and all better ones found. ``fresh`` marks edges that the round before didn't have."""
    buckets = 4 * shuffle_partitions(nodes.sparkSession)
    worst = graph.groupBy("node").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    worst = worst.select("node", F.when(F.col("n") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.col("worst")).cast("float").alias("worst"))
    ahead = graph.select(F.col("node").alias("center"), F.col("near").alias("node"), "fresh")
    place = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("node", "center")))
    back = graph.select(F.col("near").alias("center"), "node", "fresh").withColumn("place", place).filter(F.col("place") <= REVERSE).drop("place")
    members = ahead.union(back).groupBy("center", "node").agg(F.max("fresh").alias("fresh"))
    known = nodes.select("node", "unit").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
    lists = members.join(known, "node").withColumn("bucket", F.pmod(F.xxhash64("center"), F.lit(buckets)))
    found = lists.select("bucket", "center", "node", "fresh", "worst", "unit").groupBy("bucket").applyInArrow(_local_join, EDGES_DDL)
    before = graph.select("node", "near", "score", F.lit(True).alias("old"))
    return kept_best(before.union(found.withColumn("old", F.lit(False))))


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """``node``, ``near``, ``score``: each node's approximate nearest neighbours, from stored ``nodes``."""
    graph = saved(first_graph(nodes), "graph")
    for _ in range(MOST_ROUNDS):
        graph = saved(descend(nodes, graph), "graph")
        n, changed = graph.agg(F.count("*"), F.sum(F.col("fresh").cast("long"))).first()
        if (changed or 0) <= FEW * n:
            break
    return graph.select("node", "near", "score")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of 16-bit unit vectors, for the walk."""
    for batch in batches:
        q, v = (_units(batch.column(k)) if batch.num_rows else np.zeros((0, 1)) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("nd,nd->n", q, v).astype(np.float64))], names=["query", "node", "score"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines in double precision."""
    for batch in batches:
        q, v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) for k in (2, 3)) if batch.num_rows else (np.zeros((0, 1)),) * 2
        s = np.einsum("nd,nd->n", q, v) / (np.sqrt(np.einsum("nd,nd->n", q, q)) * np.sqrt(np.einsum("nd,nd->n", v, v)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["query", "node", "score"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, steps: int = MOST_STEPS) -> DataFrame:
    """``query``, ``node``, ``score``: the best ``beam`` nodes that a greedy walk from the query's own node has met.

    ``queries`` holds ``query`` (a node) and its ``unit`` vector. Each step is stored; it joins the nodes to expand with
    their edges in both directions and with the vectors of what they lead to.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "near"))
    back = graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "score").withColumn("place", place).filter(F.col("place") <= REVERSE).drop("place")
    links = saved(graph.union(back).select("node", "near").distinct(), "links")
    vectors, asked = nodes.select("node", "unit"), queries.select("query", F.col("unit").alias("of"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    turn = Window.partitionBy("query", "expanded").orderBy(F.desc("score"), "node")
    # ``now``: the node is expanded in the next step; it is decided where the step before ranks a query's nodes.
    own = [F.col("query").alias("node"), F.lit(1.0).alias("score"), F.lit(False).alias("expanded"), F.lit(True).alias("now")]
    state = saved(queries.select("query", *own), "state")
    for _ in range(steps):
        reached = state.filter("now").select("query", "node").join(links, "node").select("query", F.col("near").alias("node")).distinct()
        reached = reached.join(state.select("query", "node"), ["query", "node"], "left_anti")
        pairs = reached.join(vectors, "node").join(asked, "query").select("query", "node", "of", "unit")
        new = pairs.mapInArrow(_near, "query long, node long, score double").withColumn("expanded", F.lit(False))
        old = state.select("query", "node", "score", (F.col("expanded") | F.col("now")).alias("expanded"))
        best = old.unionByName(new).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= beam).drop("place")
        state = saved(best.withColumn("now", ~F.col("expanded") & (F.row_number().over(turn) <= EXPANDED)), "state")
        if state.filter("now").isEmpty():
            break
    return state.select("query", "node", "score")


def nearest(rows: DataFrame, wanted: int = WANTED, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, the found id (under its column's name) and ``score`` for the rows whose id ``every`` divides, against all other rows."""
    nodes = saved(nodes_of(usable(rows, id_column, vector_column), wanted + 1), "nodes")
    graph = neighbour_graph(nodes)
    asked = saved(usable(rows, id_column, vector_column).filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"]), "asked")
    packed = asked.select("vector", "id", F.array("id").alias("ids")).mapInArrow(_pack, "id long, unit binary, vector binary, ids array<long>")
    own = packed.select("id", "vector").join(nodes.select("node", "vector"), "vector")
    queries = saved(own.select("node").distinct().join(nodes.select(F.col("node").alias("query"), "unit", "vector"), F.col("node") == F.col("query")).drop("node"), "queries")
    met = search(nodes, graph, queries).select("query", "node")
    pairs = met.join(queries.select("query", F.col("vector").alias("of")), "query").join(nodes.select("node", "vector"), "node")
    found = pairs.select("query", "node", "of", "vector").mapInArrow(_scores, "query long, node long, score double")
    each = own.select("id", F.col("node").alias("query")).join(found, "query").join(nodes.select("node", F.explode("ids").alias("found")), "node")
    best = each.filter("found <> id").groupBy("id", "found").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "found"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= wanted)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias(id_column), "score")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_nn_descent": op3_nn_descent}
ORACLES = {}
