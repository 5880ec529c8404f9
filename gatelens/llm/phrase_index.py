"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` reads the documents once and stores, per segment (some million words of whole documents), each term's
postings: its positions in the segment as one binary value. Segments are filled where the documents are read, so storing
the index shuffles nothing. ``find`` takes the postings of the terms that the phrases hold, gathers them per segment,
and intersects each phrase's offset-adjusted lists, beginning with its rarest term. It returns exact phrases
(``distance`` 0) and, with ``slop``, proximity matches: every term at most ``slop`` words from where the phrase has it.

Phrases are taken in blocks of bounded size, so a benchmark of any size works; the corpus is never gathered.

Defined cases: null and empty texts have no words and hit nothing; an item without words has no window; an item with
a null id counts in ``n_hit``, but has no name among the items; rows with equal
ids are separate documents (with separate results); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.tables import read_table, saved
from gatelens.llm.words import ALNUM, as_bytes

WINDOW = 10
SEGMENT_WORDS = 1_500_000
#: Phrases that one task holds at a time, next to a segment's postings of their terms.
PHRASES_PER_BLOCK = 20_000

POSTINGS = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("positions", pa.binary()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("starts", pa.binary())])
POSTINGS_DDL = "segment long, term binary, n int, positions binary, doc_ids binary, nulls binary, starts binary"


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _segments(batches: Iterator[pa.RecordBatch], segment_words: int) -> Iterator[pa.RecordBatch]:
    """Postings of whole documents. The row with a null term lists the segment's documents and where they start."""
    first = TaskContext.get().partitionId() << 32
    numbers, ids, counts, pieces, held = _Numbers(), [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal numbers, ids, counts, pieces, held, first
        # A free position after each document keeps phrases from running on into the next.
        starts = np.r_[0, np.cumsum(np.array(counts, np.int64) + 1)].astype(np.int64)
        terms = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        positions = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)] or [np.zeros(0, np.int64)]).astype("<i4")
        order = np.argsort(terms, kind="stable")
        sizes = np.bincount(terms, minlength=len(numbers)).astype(np.int32)
        payload = positions[order].tobytes()
        bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64) * 4
        lists = pa.Array.from_buffers(pa.large_binary(), len(numbers), [None, pa.py_buffer(bounds), pa.py_buffer(payload)]).cast(pa.binary())
        nothing = pa.nulls(len(numbers), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), first)), pa.array(list(numbers), pa.binary()), pa.array(sizes), lists, nothing, nothing, nothing], schema=POSTINGS)
        known = np.array([0 if i is None else i for i in ids], "<i8")
        missing = np.array([i is None for i in ids], "?")
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((first, None, len(ids), None, known.tobytes(), missing.tobytes(), starts.astype("<i4").tobytes()), POSTINGS)], schema=POSTINGS)
        numbers, ids, counts, pieces, held, first = _Numbers(), [], [], [], 0, first + 1

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = words_of(text)
            ids.append(doc_id)
            counts.append(len(words))
            pieces.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            held += len(words)
            if held >= segment_words:
                yield from flush()
    if ids:
        yield from flush()


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of ``doc_id`` and ``text``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return saved(rows.mapInArrow(lambda batches: _segments(batches, segment_words), POSTINGS_DDL), "index")


def phrases_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item`` (the id as text), ``window`` and ``words`` for each run of ``width`` words; a shorter item is one phrase."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                if words:
                    out += [{"item": item, "window": k, "words": words[k : k + width]} for k in range(max(1, len(words) - width + 1))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("item", pa.string()), ("window", pa.int32()), ("words", pa.list_(pa.binary()))])
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(windows, "item string, window int, words array<binary>")


def intersect(lists: list[tuple[int, np.ndarray]], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts at which every term of a phrase is where the phrase has it, at most ``slop`` off, and the largest offset.

    ``lists`` holds (offset, sorted positions). The rarest term's list gives the candidates.
    """
    lists = sorted(lists, key=lambda x: len(x[1]))
    starts = lists[0][1].astype(np.int64) - lists[0][0]
    off = np.zeros(len(starts), np.int64)
    for offset, positions in lists[1:]:
        if not len(starts):
            break
        wanted = starts + offset
        at = np.searchsorted(positions, wanted)
        above = positions[np.minimum(at, len(positions) - 1)]
        gap = np.abs(above - wanted)
        if slop:
            gap = np.minimum(gap, np.abs(positions[np.maximum(at - 1, 0)] - wanted))
        near = gap <= slop
        starts, off = starts[near], np.maximum(off[near], gap[near])
    return starts, off


def _united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one; documents are apart by a free position, so none runs into the next."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def _matches(segment: pa.Table, phrases: list[tuple[str, list[list[bytes]]]], slop: int) -> pa.Table:
    lists, table = {}, None
    for term, positions, doc_ids, nulls, starts in zip(*(segment.column(c).to_pylist() for c in ("term", "positions", "doc_ids", "nulls", "starts"))):
        if term is None:
            table = (np.frombuffer(doc_ids, "<i8"), np.frombuffer(nulls, "?"), np.frombuffer(starts, "<i4").astype(np.int64))
        else:
            lists[term] = np.frombuffer(positions, "<i4")
    parts = []  # arrays of document, start and end, with the item and whether they are exact
    ids, missing, bounds = table or (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(1, np.int64))
    for item, windows in phrases if len(ids) else ():
        found: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        for words in windows:
            if all(w in lists for w in words):
                starts, off = intersect([(k, lists[w]) for k, w in enumerate(words)], slop)
                doc = np.searchsorted(bounds, np.maximum(starts, 0), side="right") - 1
                own = (starts >= 0) & (starts + len(words) < bounds[np.minimum(doc + 1, len(ids))])  # whole in one document
                for exact in (True, False) if len(starts) else ():
                    s = starts[own & ((off == 0) == exact)]
                    found[exact].append((s, s + len(words)))
        for exact, spans in found.items():
            if spans and sum(len(s) for s, _ in spans):
                s, e = _united(*(np.concatenate(x) for x in zip(*spans)))
                doc = np.searchsorted(bounds, s, side="right") - 1
                parts.append((doc, s - bounds[doc], e - bounds[doc], item, exact))
    doc, start, end = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3))
    each = [len(p[0]) for p in parts]
    return pa.table(
        {
            "segment": pa.array(np.full(len(doc), segment.column("segment")[0].as_py(), np.int64)),
            "doc": pa.array(doc),
            "doc_id": pa.array(ids[doc], pa.int64(), mask=missing[doc]),
            "item": pa.array([p[3] for p, n in zip(parts, each) for _ in range(n)], pa.string()),
            "start": pa.array(start),
            "end": pa.array(end),
            "exact": pa.array(np.repeat([p[4] for p in parts], each).astype(bool)),
        }
    )


MATCHES_DDL = "segment long, doc long, doc_id long, item string, start long, end long, exact boolean"


def _searcher(sent: Broadcast, slop: int):
    def search(segment: pa.Table) -> pa.Table:
        return _matches(segment, sent.value, slop)

    return search


def find(index: DataFrame, phrases: DataFrame, slop: int = 0, per_block: int = PHRASES_PER_BLOCK) -> DataFrame:
    """Where the items' phrases are: ``segment``, ``doc`` (the document's place there), ``doc_id``, ``item``, ``start`` and
    ``end`` (word positions, phrases that overlap or touch united) and ``exact`` (else: proximity matches).

    Items are dealt into blocks of about ``per_block`` phrases, and a block's terms choose the postings that are read.
    Only one block is on the driver or in a task at once.
    """
    spark = index.sparkSession
    blocks = max(1, math.ceil(phrases.count() / per_block))
    hashed = F.when(F.col("item").isNull(), F.xxhash64("words")).otherwise(F.xxhash64("item"))
    phrases = saved(phrases.withColumn("part", F.pmod(hashed, F.lit(blocks))), "phrases")
    found = spark.createDataFrame([], MATCHES_DDL)
    for part in range(blocks):
        items: dict[str, list[list[bytes]]] = {}
        for row in phrases.filter(F.col("part") == part).sort("item", "window").collect():
            items.setdefault(row.item, []).append([bytes(w) for w in row.words])
        terms = sorted({w for windows in items.values() for words in windows for w in words})
        wanted = F.broadcast(spark.createDataFrame([(w,) for w in terms], "term binary"))
        postings = index.join(wanted, "term", "left_semi").select(*POSTINGS.names).union(index.filter("term is null"))
        search = _searcher(spark.sparkContext.broadcast(list(items.items())), slop)
        found = found.union(postings.groupBy("segment").applyInArrow(search, MATCHES_DDL))
    return found


def documents_in(index: DataFrame) -> DataFrame:
    """``segment``, ``doc``, ``doc_id`` and ``n_words`` of each indexed document."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for segment, doc_ids, nulls, starts in batch.itertuples(index=False):
                ids = pd.array(np.frombuffer(doc_ids, "<i8"), "Int64")
                ids[np.frombuffer(nulls, "?")] = pd.NA
                yield pd.DataFrame({"segment": segment, "doc": np.arange(len(ids)), "doc_id": ids, "n_words": np.diff(np.frombuffer(starts, "<i4").astype(np.int64)) - 1})

    rows = index.filter("term is null").select("segment", "doc_ids", "nulls", "starts")
    return rows.mapInPandas(unpack, "segment long, doc long, doc_id long, n_words long")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document ``n_words``, ``n_hit`` (words inside exact phrases), ``items`` (sorted ids of the items with exact
    phrases), and ``near_items`` (ids of those with proximity matches only).

    Spans are united per document in a running scan, so their number, not the covered words, sets the cost.
    """
    index = build_index(docs)
    found = find(index, phrases_of(items, width), slop)
    per_doc = found.groupBy("segment", "doc").agg(
        F.array_sort(F.collect_list(F.when(F.col("exact"), F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.array_sort(F.collect_set("item")).alias("any"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, span: F.struct(
            F.greatest(acc["end"], span["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), span["end"] - F.greatest(acc["end"], span["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    per_doc = per_doc.select("segment", "doc", covered.alias("n_hit"), "items", F.array_except("any", "items").alias("near_items"))
    none = F.array().cast("array<string>")
    return documents_in(index).join(per_doc, ["segment", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def op2_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=1)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


QUERIES = {"op2_phrase_index": op2_phrase_index}
ORACLES = {}
