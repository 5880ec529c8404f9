"""Jaccard self-join of documents on word n-grams, by rare-first prefix filtering.

A document's set holds its distinct word n-grams, hashed to 64 bits; equal sets are one node. Grams are ordered by
rarity: by their count in a table of hashed counts over the whole corpus, then by hash. Two sets of n grams that reach the
threshold t share a gram among the first n - ceil(t n) + 1 of each, so only these prefixes are exchanged. Within a gram's
list, pairs must pass the length filter and the positional filter; each pair then meets its texts once, passes the suffix
filter and is verified by its exact intersection. Links give connected components.

Pairs are taken in rounds, so that a group of many copies isn't expanded into all its pairs. Round 1 proposes, per
gram, each set with the list's oldest document and with a random neighbour, and of these a set's pairs from most lists. In further
rounds, as long as they find links, each set outside a list's main component meets the most promising of some neighbours of other components. The last round
proposes every other pair whose two sets are still in different components, in the first list that both are in: the pairs left
out can't change a component, so components are exact. A set that shares grams with a group and links with none of it is compared
with all of the group, but by counts alone. Before texts are moved, a pair must pass an upper bound of its intersection from both sets'
counts in 128 ranges of the hash.
Lists of a gram that very many sets hold are split into cells that cover all pairs of their parts.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than n words the whole sequence is one
gram; null and empty texts have no set and link with nothing; rows with equal ids are separate documents that share an
id; a null id takes part, but names a component only if all its ids are null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.tables import components, read_table, saved, shuffle_partitions
from gatelens.llm.words import LOWER, WordHashes, as_bytes, bucket_slices, mixed, window_hashes

GRAM = 4
PERCENT = 85
SKETCH_BITS, SKETCH_PARTS = 21, 64
ENTRIES_PER_BUCKET = 500_000
#: A gram's list is split when its count is beyond the mean count of the table by more than this.
LONG_LIST = 200_000
FILTER_BITS = 22
#: Round 1 keeps so many of a set's pairs from long lists, those that most lists propose.
TRIED = 6
#: So many times at most sets that are left apart meet some of their neighbours, before they meet all.
NEAR_ROUNDS = 3
#: Of so many neighbours in a list, those that may share most.
AHEAD, BEST = 64, 2
RANGES = 128

_hashes = WordHashes()


def grams(text: bytes | None, n: int = GRAM) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = mixed(_hashes.of(words))
    return np.unique(window_hashes(ids, min(n, len(words))))


def set_id(h: np.ndarray) -> int | None:
    """A name for the whole set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())))) if len(h) else None


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with 100 * it >= percent * the union, for sets of these sizes."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def range_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each range; a count that doesn't fit stands for any number."""
    return np.minimum(np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=RANGES), 65535).astype(np.uint16)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per document; then the partition's counts per hash cell, in parts, with a null in place of the set."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        ids, sizes, ranges = [], [], []
        for text in as_bytes(batch.column(1)):
            h = grams(text, n)
            np.add.at(counts, _cell(h), 1)
            ids.append(set_id(h))
            sizes.append(len(h))
            ranges.append(range_counts(h).tobytes() if len(h) else None)
        nothing = pa.nulls(len(ids))
        columns = [batch.column(0), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ranges, pa.binary()), nothing.cast(pa.int32()), nothing.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=SETS)
    parts = [p.tobytes() for p in counts.reshape(SKETCH_PARTS, -1)]
    yield pa.RecordBatch.from_pylist([{"part": k, "counts": p} for k, p in enumerate(parts)], schema=SETS)


SETS = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("ranges", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
SETS_DDL = "doc_id long, sid long, n long, ranges binary, part int, counts binary"


def _summed(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(c, np.uint32) for c in rows.column("counts").to_pylist()], axis=0, dtype=np.int64)
    return pa.table({"part": rows.column("part")[:1], "counts": pa.array([np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()], pa.binary())})


ENTRY = [("keys", np.uint32), ("sids", np.int64), ("docs", np.int64), ("sizes", np.int32), ("places", np.int32)]
LISTS_DDL = "bucket long, keys binary, sids binary, docs binary, sizes binary, places binary"
NO_ID = np.iinfo(np.int64).max
LISTS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c, _ in ENTRY)])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, buckets: int, n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Prefix grams of each set, packed per bucket: list key, set, its size, and the gram's place in its order."""
    usual, held, n_held = counts.mean(), [], 0

    def flush() -> pa.RecordBatch:
        keys, sids, docs, sizes, places = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        own = {"keys": keys.astype(np.uint32), "sids": sids[order], "docs": docs[order], "sizes": sizes[order], "places": places[order]}
        rows = [{"bucket": b} | {c: own[c][s].tobytes() for c, _ in ENTRY} for b, s in bucket_slices(keys, buckets)]
        return pa.RecordBatch.from_pylist(rows, schema=LISTS)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            h = grams(text, n)
            if not len(h):
                continue
            count = counts[_cell(h)]
            first = np.lexsort((h, count))[: prefix_length(len(h), percent)]
            sid = set_id(h)
            keys, places = h[first], np.arange(len(first), dtype=np.int32)
            parts = np.ceil(np.maximum(count[first].astype(float) - usual, 1) / LONG_LIST).astype(np.int64)
            for k in np.flatnonzero(parts > 1):  # every pair of parts has a cell; a set goes to the cells of its part
                own, m = sid % int(parts[k]), int(parts[k])
                cells = np.array([min(own, o) * m + max(own, o) + 1 for o in range(m)], np.uint64)
                keys = np.r_[keys, mixed(h[first[k]] + cells)]
                places = np.r_[places, np.full(m, places[k], np.int32)]
            whole = np.r_[parts == 1, np.ones(len(keys) - len(first), bool)]
            keys, places = mixed(keys[whole]), places[whole]
            own = NO_ID if doc_id is None else doc_id
            held.append((keys, np.full(len(keys), sid, np.int64), np.full(len(keys), own, np.int64), np.full(len(keys), len(h), np.int32), places))
            n_held += len(keys)
            if n_held >= 400_000:
                yield flush()
                held, n_held = [], 0
    if held:
        yield flush()


def _lists(rows: pa.Table) -> pa.Table:
    """A bucket's lists that hold two different sets or more, by key, size and set."""
    key, sid, doc, size, place = (np.concatenate([np.frombuffer(b, t) for b in rows.column(c).to_pylist()]) for c, t in ENTRY)
    order = np.lexsort((doc, sid, size, key))
    key, sid, doc, size, place = key[order], sid[order], doc[order], size[order], place[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]  # copies are one node, by the smallest id
    key, sid, doc, size, place = key[new], sid[new], doc[new], size[new], place[new]
    alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
    out = [x[~alone].tobytes() for x in (key, sid, doc, size, place)]
    return pa.Table.from_pylist([dict(zip(LISTS.names, (rows.column("bucket")[0].as_py(), *out)))] if out[0] else [], schema=LISTS)


def _passing(i: np.ndarray, j: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters, for pairs of entries of one list; ``size[i] <= size[j]``."""
    a, b = size[i].astype(np.int64), size[j].astype(np.int64)
    best = 1 + np.minimum(a - place[i] - 1, b - place[j] - 1)
    return (100 * a >= percent * b) & (best >= least_overlap(a, b, percent))


def _pair_table(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def _first_pairs(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Each entry with its list's oldest document and with its successor in an order by hash of set and gram; all pairs of
    lists of up to three. ``whole`` says that the list has all its pairs here."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            key, sid, doc, size, place = (np.frombuffer(getattr(row, c), t) for c, t in ENTRY)
            starts = _starts(key)
            lengths = np.diff(np.r_[starts, len(key)])
            start, length, at = np.repeat(starts, lengths), np.repeat(lengths, lengths), np.arange(len(key))
            shuffled = np.lexsort((mixed(sid.view(np.uint64) ^ key.astype(np.uint64)), key))
            oldest = np.repeat(np.lexsort((doc, key))[starts], lengths)
            short = length <= 3
            one, two = at[short & (at + 1 < start + length)], at[short & (at + 2 < start + length)]
            many = at[(length > 3) & (at + 1 < start + length)]
            far = at[(length > 3) & (oldest != at)]
            i = np.r_[one, two, shuffled[many], oldest[far]]
            j = np.r_[one + 1, two + 2, shuffled[many + 1], far]
            whole = np.r_[np.ones(len(one) + len(two), bool), np.zeros(len(many) + len(far), bool)]
            i, j = np.minimum(i, j), np.maximum(i, j)  # entries of a list are in order of size
            ok = _passing(i, j, size, place, percent)
            i, j, whole = i[ok], j[ok], whole[ok]
            yield pd.DataFrame({"a": np.minimum(sid[i], sid[j]), "b": np.maximum(sid[i], sid[j]), "whole": whole})


def tried_first(pairs: DataFrame) -> DataFrame:
    """The pairs of round 1, each once: those from whole lists, and of each set's others the ones that most lists propose."""
    counted = saved(pairs.groupBy("a", "b").agg(F.max("whole").alias("whole"), F.count("*").alias("lists")), "proposed")
    rank = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("lists"), other))
    others = counted.filter("not whole")
    best = [others.withColumn("rank", rank(side, other)).filter(F.col("rank") <= TRIED).select("a", "b") for side, other in (("a", "b"), ("b", "a"))]
    return counted.filter("whole").select("a", "b").union(best[0].union(best[1]).distinct())


def _open_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of lists of four and more: in shorter ones round 1 has met every pair."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            key, sid, _, size, place = (np.frombuffer(getattr(row, c), t) for c, t in ENTRY)
            starts = _starts(key)
            many = np.repeat(np.diff(np.r_[starts, len(key)]) > 3, np.diff(np.r_[starts, len(key)]))
            if many.any():
                whole = key[many].astype(np.int64) + (row.bucket << 32)
                yield pd.DataFrame({"bucket": row.bucket, "key": whole, "sid": sid[many], "size": size[many], "place": place[many]})


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose range counts allow the intersection that they need."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, RANGES).astype(np.int64) for k in (2, 3))
        size_x, size_y = (batch.column(k).to_numpy() for k in (4, 5))
        most = np.minimum(x, y).sum(1)
        unknown = (np.minimum(x, y) == 65535).any(1)
        keep = unknown | (most >= least_overlap(size_x, size_y, percent))
        yield batch.select([0, 1]).filter(pa.array(keep))


def _mixed_lists(rows: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of rows in order of ``key``, the start and end of each list that meets several components, its entries' components as
    numbers, and the entries outside the one that most have."""
    key, comp = rows["key"].to_numpy(), rows["component"].to_numpy()
    starts = _starts(key)
    for s, e in zip(starts, np.r_[starts[1:], len(key)]):
        if (comp[s:e] != comp[s]).any():
            which = np.unique(comp[s:e], return_inverse=True)[1]
            yield s, e, which, np.flatnonzero(which != np.bincount(which).argmax())


def _most_shared(ranges: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """An upper bound of the intersection of set ``i`` with each of the sets ``j``, from their range counts."""
    least = np.minimum(ranges[j], ranges[i])
    return np.where((least == 65535).any(1), np.iinfo(np.int64).max, least.sum(1, dtype=np.int64))


def _sorted_open(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values(["key", "size", "sid"])
    return rows, np.frombuffer(b"".join(rows["ranges"]), np.uint16).reshape(-1, RANGES)


def _near_pairs(rows: pd.DataFrame, percent: int, salt: int) -> pd.DataFrame:
    """Each entry outside its list's main component with those ``BEST`` of the next ``AHEAD`` entries, in an order by hash, that are of
    other components, pass the filters and may share most."""
    rows, ranges = _sorted_open(rows)
    sid, size, place = (rows[c].to_numpy() for c in ("sid", "size", "place"))
    seed, a, b = mixed(np.array([salt + 1], np.uint64)), [], []
    for s, e, which, others in _mixed_lists(rows):
        order = np.argsort(mixed(sid[s:e].view(np.uint64) ^ seed), kind="stable")
        rank = np.empty(e - s, np.int64)
        rank[order] = np.arange(e - s)
        for m in others:
            far = order[(rank[m] + np.arange(1, min(AHEAD + 1, e - s))) % (e - s)]
            far = far[which[far] != which[m]]
            far = far[_passing(np.minimum(m, far) + s, np.maximum(m, far) + s, size, place, percent)]
            shared = _most_shared(ranges, s + m, s + far)
            best = np.argsort(-shared, kind="stable")[:BEST]
            best = best[shared[best] >= least_overlap(size[s + m].astype(np.int64), size[s + far[best]].astype(np.int64), percent)]
            a.append(np.full(len(best), sid[s + m]))
            b.append(sid[s + far[best]])
    return _pair_table(np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)]))


def _cross_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """All pairs of a list whose sets are in different components and pass the filters and the range counts, if it is the first list that both are in.

    ``lists`` are the set's lists in order of the gram's place, which is the same order for all sets.
    """
    rows, ranges = _sorted_open(rows)
    key, sid, size, place, lists = (rows[c].to_numpy() for c in ("key", "sid", "size", "place", "lists"))
    a, b = [], []
    for s, e, which, others in _mixed_lists(rows):
        flat, owner, at = np.concatenate(lists[s:e]), np.repeat(np.arange(e - s), [len(x) for x in lists[s:e]]), np.arange(e - s)
        is_other = np.isin(at, others)
        for m in others:
            far = np.flatnonzero((which != which[m]) & (~is_other | (at > m)))
            far = far[_passing(np.minimum(m, far) + s, np.maximum(m, far) + s, size, place, percent)]
            far = far[_most_shared(ranges, s + m, s + far) >= least_overlap(size[s + m].astype(np.int64), size[s + far].astype(np.int64), percent)]
            earlier = lists[s + m][: np.flatnonzero(lists[s + m] == key[s])[0]]
            if len(far) and len(earlier):
                met = np.zeros(e - s, bool)
                met[owner[np.isin(flat, earlier)]] = True
                far = far[~met[far]]
            a.append(np.full(len(far), sid[s + m]))
            b.append(sid[s + far])
    return _pair_table(np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)]))


def most_common(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """The suffix filter: an upper bound of the intersection of two sorted arrays, from halves around a middle value."""
    if not len(a) or not len(b):
        return 0
    if depth == 0:
        return min(len(a), len(b))
    middle = b[len(b) // 2]
    at = int(np.searchsorted(a, middle))
    same = int(at < len(a) and a[at] == middle)
    return same + most_common(a[:at], b[: len(b) // 2], depth - 1) + most_common(a[at + same :], b[len(b) // 2 + 1 :], depth - 1)


def _verified(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}

    def of(sid: int, text: bytes) -> np.ndarray:
        if sid not in known:
            if len(known) >= 256:
                known.clear()
            known[sid] = grams(text, n)
        return known[sid]

    for batch in batches:
        keep = []
        for a, b, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
            x, y = of(a, s), of(b, t)
            least = int(least_overlap(len(x), len(y), percent))
            keep.append(most_common(x, y) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def jaccard_components(docs: DataFrame, n: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Per row of ``doc_id`` and ``text``: ``doc_id``, ``n_shingles`` (the set's size), ``component_id`` (the smallest id of
    the component) and ``n_component`` (its documents)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # Sets and counts. The counts are a table of fixed size.
    both = saved(source.mapInArrow(lambda batches: _sets(batches, n), SETS_DDL), "sets")
    sets = both.filter("part is null").select("doc_id", "sid", "n", "ranges")
    summed = both.filter("part is not null").groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(r.counts, np.uint32) for r in sorted(summed, key=lambda r: r.part)]) if summed else np.zeros(1 << SKETCH_BITS, np.uint32)
    sent = spark.sparkContext.broadcast(counts)
    del summed, counts
    entries = sets.agg(F.sum(F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1)).first()[0] or 0
    buckets = max(math.ceil(int(entries) / ENTRIES_PER_BUCKET), shuffle_partitions(spark))

    # The lists of prefix grams.
    packed = source.mapInArrow(lambda batches: _prefixes(batches, sent.value, buckets, n, percent), LISTS_DDL)
    lists = saved(packed.groupBy("bucket").applyInArrow(_lists, LISTS_DDL), "lists")
    sent.destroy()

    of_set = saved(sets.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("ranges").alias("ranges")), "nodes")
    a, b = (of_set.select(F.col("sid").alias(s), F.col("doc_id").alias(f"doc_{s}"), F.col("n").alias(f"n_{s}"), F.col("ranges").alias(f"ranges_{s}")) for s in "ab")

    def verified(possible: DataFrame) -> DataFrame:
        """The links among stored pairs that their range counts leave possible."""
        wanted = possible.select(F.col("a").alias("sid")).union(possible.select(F.col("b").alias("sid"))).distinct()
        chosen = saved(of_set.select("sid", "doc_id").join(wanted, "sid"), "chosen")
        texts = texts_of(source, chosen, n)
        with_a = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")).join(possible, "a")
        with_b = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")).join(with_a, "b")
        return saved(with_b.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _verified(batches, n, percent), "a long, b long"), "links")

    pairs = saved(tried_first(lists.mapInPandas(lambda batches: _first_pairs(batches, percent), "a long, b long, whole boolean")), "pairs")
    known = pairs.join(a, "a").join(b, "b").select("a", "b", "ranges_a", "ranges_b", "n_a", "n_b")
    possible = saved(known.mapInArrow(lambda batches: _possible(batches, percent), "a long, b long"), "possible")
    labels = saved(components(verified(possible)), "labels")
    entry = saved(lists.mapInPandas(_open_entries, "bucket long, key long, sid long, size long, place long"), "entries")

    def open_entries() -> DataFrame:
        """The entries of lists that meet several components."""
        labelled = entry.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        several = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
        return saved(labelled.join(several.select("key"), "key", "left_semi").join(of_set.select("sid", "ranges"), "sid"), "open")

    def joined(links: DataFrame) -> DataFrame:
        """The components after further links."""
        stars = labels.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        return saved(components(links.union(stars)), "labels")

    for salt in range(NEAR_ROUNDS):
        near = open_entries().groupBy("bucket").applyInPandas(_near(percent, salt), "a long, b long").distinct()
        near = saved(near.join(pairs, ["a", "b"], "left_anti"), "near")
        links = verified(near)
        pairs = pairs.select("a", "b").union(near)
        if links.isEmpty():
            break
        labels = joined(links)
    left = open_entries()
    lists_of = left.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("lists"))
    more = left.join(lists_of, "sid").groupBy("bucket").applyInPandas(lambda rows: _cross_pairs(rows, percent), "a long, b long").distinct()
    labels = joined(verified(saved(more.join(pairs, ["a", "b"], "left_anti"), "more")))

    nodes = sets.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = nodes.filter("sid is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_component"))
    return nodes.join(named, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_component", F.lit(1).cast("long")).alias("n_component"),
    )


def _near(percent: int, salt: int):
    def near(rows: pd.DataFrame) -> pd.DataFrame:
        return _near_pairs(rows, percent, salt)

    return near


def texts_of(source: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """``sid`` and ``text`` for chosen sets (``sid``, ``doc_id`` of one of their documents).

    Most other documents are kept out by a bit table of fixed size before the join; the driver gets its set parts, whatever the number of sets.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    numbered = chosen.select((cell + 1).alias("number"))  # Spark's bitmaps count from 1
    parts = numbered.groupBy(F.bitmap_bucket_number("number").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, found in parts.collect():
        bits[(part - 1) * len(found) : part * len(found)] = np.frombuffer(found, np.uint8)
    mask = source.sparkSession.sparkContext.broadcast(bits)
    likely = source.withColumn("cell", cell).mapInArrow(_masker(mask), "doc_id long, text string")
    met = likely.join(chosen, likely["doc_id"].eqNullSafe(chosen["doc_id"])).select("sid", "text")
    texts = saved(met.mapInArrow(lambda batches: _own_texts(batches, n), "sid long, text string").dropDuplicates(["sid"]), "texts")
    mask.destroy()
    return texts


def _masker(mask):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(mask.value, bitorder="little")
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(2).to_numpy()] == 1)).select([0, 1])

    return likely


def _own_texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Where several texts have an id (repeated or null), those of the set."""
    for batch in batches:
        own = [set_id(grams(t, n)) == sid for sid, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)))]
        yield batch.filter(pa.array(own, pa.bool_()))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLES = {}
