"""Substring deduplication with difference-cover anchors.

A window of ``width`` words is removed where its word sequence also starts earlier in the corpus. With a difference cover
D of a period p, for any two places i and j some shift k < p brings both i + k and j + k to positions in D modulo p. So
two equal runs of ``width`` words share an aligned pair of ``width - p + 1`` words, an anchor, and only windows at cover
positions (4 of 13) are hashed and exchanged. Where an anchor's hash occurs twice, it is extended to the windows of full
width around it; these are compared by 96 bits of hash, and all but the first place of each is removed.

Documents are stored once in blocks of consecutive ids, and blocks exchange distinct hashes (see ``tables``), so the first
block to send a window has its first place, and a passage of any frequency reaches a task once per block.

Defined cases: null and empty texts have no words; fewer than ``width`` words are never a window; rows with equal ids are
ordered by text, null ids come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.tables import in_blocks, ordered, read_table, saved
from gatelens.llm.words import WordHashes, as_bytes, bucket_slices, mixed, window_hashes

WIDTH = 20
#: Every residue modulo 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)

SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
SENT_DDL = "bucket long, block int, keys binary, more binary"
FLAGS = pa.schema([("block", pa.int32()), ("round", pa.int32()), ("bucket", pa.int64()), ("flags", pa.binary())])
FLAGS_DDL = "block int, round int, bucket long, flags binary"

_hashes = WordHashes()


class _Block:
    """A block's words as one stream, and the windows found in it; the same each time it is made."""

    def __init__(self, table: pa.Table):
        self.table = ordered(table)
        self.words = [t.split() if t else [] for t in as_bytes(self.table.column("text"))]
        self.starts = np.r_[0, np.cumsum([len(w) for w in self.words])].astype(np.int64)
        self.ids = mixed(np.concatenate([_hashes.of(w) for w in self.words] or [np.zeros(0, np.uint64)]))

    def room(self) -> np.ndarray:
        """Words from each position to its document's end."""
        return np.repeat(self.starts[1:], np.diff(self.starts)) - np.arange(len(self.ids))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchor windows."""
        width = WIDTH - PERIOD + 1
        h = window_hashes(self.ids, width)
        place = (np.arange(len(self.ids)) - np.repeat(self.starts[:-1], np.diff(self.starts)))[: len(h)] % PERIOD
        at = np.flatnonzero(np.isin(place, COVER) & (self.room()[: len(h)] >= width))
        return at, h[at]

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and two hashes of the full windows around shared anchors."""
        h, g = window_hashes(self.ids, WIDTH), window_hashes(self.ids, WIDTH, 1)
        seen = np.r_[0, np.cumsum(shared)]
        # An anchor at q is inside the window at p if p <= q <= p + PERIOD - 1.
        n = len(h)
        last = np.minimum(np.arange(n) + PERIOD, len(shared))
        at = np.flatnonzero((seen[last] > seen[:n]) & (self.room()[:n] >= WIDTH))
        return at, h[at], g[at].astype(np.uint32)


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of hashes: the places of the first of each distinct pair, in sorted order, and each pair's number."""
    order = np.lexsort((g, h))  # stable: equal pairs stay in order of place
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])][: len(h)]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _bits(rows: list[tuple[int, bytes]], sizes: list[int]) -> np.ndarray:
    """The answers to a block's sorted keys, bucket after bucket."""
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for (_, b), n in zip(sorted(rows), sizes)]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).astype(bool)


def _answers(flags: pa.Table, turn: int) -> list[tuple[int, bytes]]:
    return [(r["bucket"], r["flags"]) for r in flags.to_pylist() if r["round"] == turn]


def _send(block: int, h: np.ndarray, more: np.ndarray, buckets: int, narrow: bool) -> pa.Table:
    rows = [(b, block, (h[s].astype(np.uint32) if narrow else h[s]).tobytes(), more[s].tobytes()) for b, s in bucket_slices(h, buckets)]
    return pa.Table.from_pylist([dict(zip(SENT.names, r)) for r in rows], schema=SENT)


def _shared_anchors(block: _Block, flags: pa.Table, buckets: int) -> np.ndarray:
    at, h = block.anchors()
    keys, number, times = np.unique(h, return_inverse=True, return_counts=True)
    elsewhere = _bits(_answers(flags, 0), [s.stop - s.start for _, s in bucket_slices(keys, buckets)])
    shared = np.zeros(len(block.ids), bool)
    shared[at] = (elsewhere | (times > 1))[number] if len(at) else False
    return shared


def _answer_anchors(rows: pa.Table) -> pa.Table:
    """Which of each block's keys another block has sent, too."""
    parts = [np.frombuffer(k, np.uint32) for k in rows.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = flags[order[:-1][same]] = True
    return _answer(rows, parts, flags, 0)


def _answer_windows(rows: pa.Table) -> pa.Table:
    """Which of each block's windows no earlier block has sent."""
    rows = rows.sort_by("block")
    parts = [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]
    first, _ = _distinct(np.concatenate(parts), np.concatenate([np.frombuffer(m, np.uint32) for m in rows.column("more").to_pylist()]))
    flags = np.zeros(sum(map(len, parts)), bool)
    flags[first] = True
    return _answer(rows, parts, flags, 1)


def _answer(rows: pa.Table, parts: list[np.ndarray], flags: np.ndarray, turn: int) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])
    cut = [np.packbits(flags[e - len(p) : e]).tobytes() for e, p in zip(ends, parts)]
    n = len(parts)
    return pa.table({"block": rows.column("block"), "round": pa.array([turn] * n, pa.int32()), "bucket": rows.column("bucket"), "flags": pa.array(cut, pa.binary())})


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row of ``doc_id`` and ``text``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (the kept words with one space between)."""
    blocks, n_blocks = in_blocks(docs)
    buckets = n_blocks  # a block of 8 MB has about a million words

    def send_anchors(table: pa.Table) -> pa.Table:
        keys = np.unique(_Block(table).anchors()[1])
        return _send(table.column("block")[0].as_py(), keys, np.zeros(0, np.uint32), buckets, True)

    def send_windows(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SENT.empty_table()
        block = _Block(table)
        _, h, g = block.windows(_shared_anchors(block, flags, buckets))
        first, _ = _distinct(h, g)
        return _send(key[0].as_py(), h[first], g[first], buckets, False)

    def remove(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        block = _Block(table)
        at, h, g = block.windows(_shared_anchors(block, flags, buckets))
        first, number = _distinct(h, g)
        here = _bits(_answers(flags, 1), [s.stop - s.start for _, s in bucket_slices(h[first], buckets)])
        is_first = np.zeros(len(at), bool)
        is_first[first[here]] = True  # the block's first place of a window that no earlier block has
        marks = np.zeros(len(block.ids) + 1, np.int64)
        gone = at[~is_first]
        np.add.at(marks, gone, 1)
        np.add.at(marks, np.minimum(gone + WIDTH, len(block.ids)), -1)
        covered = np.cumsum(marks[:-1]) > 0
        texts, removed = [], []
        for words, s, e in zip(block.words, block.starts, block.starts[1:]):
            out = covered[s:e]
            removed.append(int(out.sum()))
            texts.append(b" ".join([w for w, c in zip(words, out.tolist()) if not c] if removed[-1] else words))
        return pa.table(
            {
                "doc_id": block.table.column("doc_id"),
                "n_words": pa.array(np.diff(block.starts)),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    by_block = blocks.groupBy("block")
    shared = by_block.applyInArrow(send_anchors, SENT_DDL).groupBy("bucket").applyInArrow(_answer_anchors, FLAGS_DDL)
    shared = saved(shared, "anchors")
    first = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_windows, SENT_DDL).groupBy("bucket").applyInArrow(_answer_windows, FLAGS_DDL)
    flags = saved(first, "windows").union(shared)
    return by_block.cogroup(flags.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLES = {}
