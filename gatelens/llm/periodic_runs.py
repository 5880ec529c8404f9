"""Periodic runs of words: maximal stretches with a smallest period, found through Lyndon arrays.

Every run holds a Lyndon root, the smallest rotation of its period in one of the two orders of words, and that root is the longest
Lyndon word at its start. So the Lyndon arrays under an order and its reverse name a (start, period) for each run; the root is
extended to both sides by longest common extensions (LCE), and stretches of enough periods are runs.

* The arrays come from the first phase of Baier's suffix sorter (``lyndon_array``): suffixes are grouped by a prefix, groups are
  processed from the highest, and each passes its prefix on to the nearest position before it that belongs to a lower group. When a group's turn
  comes, its prefix is the longest Lyndon word at its positions.
* LCEs are exact: words of length 2^k have ranks (``Factors``), and an extension is read off from the longest to the shortest.
* A run of e periods holds each of its words e times. So words that are rarer than that cut a text, and pieces too short for
  a run are left out, until nothing changes (``pieces``). This loses no run, and both steps above see only what is left.

Words are compared as they are. Work is done within tasks, some texts at a time or one long text; memory is linear in a text, times
the logarithm of its longest piece.

Defined cases: null and empty texts have no words and no runs; runs of the same stretch with another period are runs of their own; repeated
rows are answered each; a null id is passed on; an empty table gives an empty result; other columns are passed on by ``with_runs`` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.tables import read_table
from gatelens.llm.words import as_bytes, by_bytes

LEAST_LENGTH, LEAST_PERIODS = 6, 4


def lyndon_array(ids: list[int]) -> list[int]:
    """For each position the length of the longest Lyndon word that starts there, by Baier's grouping.

    Groups are linked in order of their prefixes. Positions whose group hasn't been processed are linked, too, so the nearest
    one before a position is at hand when its group is taken out from left to right.
    """
    n = len(ids)
    left, right, length = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
    values = sorted(set(ids))
    first = {value: g for g, value in enumerate(values)}
    group = [first[value] for value in ids]
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(group):
        members[g].append(i)
    prefix, lower, upper = [1] * len(values), list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    current = len(values) - 1
    while current >= 0:
        own = prefix[current]
        times: dict[int, int] = {}  # positions before, and how many of this group follow them directly
        for i in members[current]:
            if group[i] != current:
                continue  # it has moved up
            length[i] = own
            before, after = left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                times[before] = times.get(before, 0) + 1
        members[current] = []
        # Out of one old group, more repeats of the prefix make the higher new group, which is split off first.
        new: dict[tuple[int, int], int] = {}
        for i, k in sorted(times.items(), key=lambda x: -x[1]):
            old = group[i]
            g = new.get((old, k))
            if g is None:
                g = new[old, k] = len(members)
                members.append([])
                prefix.append(prefix[old] + k * own)
                lower.append(old)
                upper.append(upper[old])
                lower[upper[old]] = upper[old] = g
            group[i] = g
            members[g].append(i)
        current = lower[current]
    return length


class Factors:
    """Ranks of the factors of length 2^k of a sequence, for extensions to both sides of pairs of positions."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)] if len(ids) else [np.zeros(0, np.int32)]
        while (half := 1 << (len(self.ranks) - 1)) * 2 <= longest:
            low = self.ranks[-1]
            pairs = low[:-half].astype(np.int64) * len(ids) + low[half:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence reads alike from ``a`` and from ``b`` on, for a < b."""
        return self._extend(a, b, 0, 1)

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far it reads alike up to ``a`` and up to ``b``, both exclusive, for a < b."""
        return self._extend(a, b, -1, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, shift: int, sign: int) -> np.ndarray:
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            while True:  # a length may take the longest factor more than once
                x, y = a + sign * far + shift * step, b + sign * far + shift * step
                fits = (x >= 0) & (y < len(rank))
                fits[fits] = rank[x[fits]] == rank[y[fits]]
                far[fits] += step
                if k < len(self.ranks) - 1 or not fits.any():
                    break
        return far


def pieces(ids: np.ndarray, lengths: np.ndarray, least_length: int, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that can lie in a run, and the number of each one's piece, in order."""
    at, piece = np.arange(len(ids)), np.repeat(np.arange(len(lengths)), lengths)
    n_words = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        _, word, counts = np.unique(piece * n_words + ids[at], return_inverse=True, return_counts=True)
        kept = counts[word] >= least_periods
        at, old = at[kept], piece[kept]
        piece = np.cumsum(np.r_[False, (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1])][: len(at)])
        long = np.bincount(piece)[piece] >= least_length if len(at) else kept[:0]
        if kept.all() and long.all():
            break
        at, piece = at[long], piece[long]
    return at, np.unique(piece, return_inverse=True)[1] if len(at) else piece


def find_runs(ids: np.ndarray, lengths: np.ndarray, least_length: int, least_periods: int) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of the runs of the texts that ``lengths`` cuts ``ids`` into, in this order."""
    least_length = max(least_length, least_periods)
    at, piece = pieces(ids, lengths, least_length, least_periods)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    # All pieces in one sequence, each with an end of its own, so that no extension leaves a piece.
    sizes = np.bincount(piece)
    places = np.arange(len(at)) + piece
    whole = np.empty(len(at) + len(sizes), np.int64)
    whole[places] = ids[at]
    whole[np.cumsum(sizes + 1) - 1] = ids.max() + 1 + np.arange(len(sizes))
    roots = []
    for end, size in zip(np.cumsum(sizes + 1) - 1, sizes):
        own = whole[end - size : end]
        for ordered in (own, -own):
            period = np.array(lyndon_array(ordered.tolist()))
            start = np.flatnonzero(period * least_periods <= size)
            roots.append(np.column_stack([start + end - size, period[start]]))
    start, period = np.unique(np.concatenate(roots), axis=0).T
    factors = Factors(whole, int(sizes.max()))
    back = factors.back(start, start + period)
    length = back + period + factors.ahead(start, start + period)
    fits = (length >= least_periods * period) & (length >= least_length)
    found = np.unique(np.column_stack([start - back, length, period])[fits], axis=0)
    origin = np.empty(len(whole), np.int64)
    origin[places] = at
    first = origin[found[:, 0]]
    text = np.searchsorted(np.cumsum(lengths), first, side="right")
    order = np.lexsort((found[:, 2], first))
    return text[order], (first - (np.cumsum(lengths) - lengths)[text])[order], found[order, 1], found[order, 2]


class _Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _answer(texts: list[bytes | None], least_length: int, least_periods: int) -> pa.StructArray:
    words = [t.split() if t else [] for t in texts]
    numbers, lengths = _Numbers(), np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((numbers[w] for own in words for w in own), np.int64, int(lengths.sum()))
    text, start, length, period = find_runs(ids, lengths, least_length, least_periods)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    collapsed = []
    for k, own in enumerate(words):
        gone = np.zeros(len(own) + 1, np.int64)
        for r in range(bounds[k], bounds[k + 1]):
            gone[start[r] + period[r]] += 1
            gone[start[r] + length[r]] -= 1
        gone = np.cumsum(gone[:-1]) if bounds[k] < bounds[k + 1] else None
        collapsed.append(b" ".join(own if gone is None else [w for w, g in zip(own, gone.tolist()) if not g]))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.array(lengths), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["n_words", "runs", "collapsed"],
    )


def with_runs(docs: DataFrame, column: str = "periodic", least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The documents with a struct of ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``:
    the words, joined by one space, without those that a run holds after its first period."""

    @F.arrow_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def answer(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([_answer(as_bytes(part), least_length, least_periods) for part in by_bytes(text)])

    return docs.withColumn(column, answer(F.col("text").cast("string")))


def with_periods(doc_id: Column, text: Column) -> Column:
    """The text of the query's rule: where crc32 of the id is divisible by 10, its words from a place on repeat with a period."""
    code = F.crc32(doc_id.cast("string").cast("binary"))
    chosen = (code % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g, n = F.floor(code / 10), F.size(words)
    first = (g % n).cast("int")
    period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, first + 1, period), F.ceil((n - first) / period).cast("int")))
    return F.when(chosen, F.array_join(F.concat(F.slice(words, F.lit(1), first), F.slice(repeated, F.lit(1), n - first)), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("periodic.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    rows = with_runs(docs).withColumn("longest", longest)
    return rows.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES = {}
