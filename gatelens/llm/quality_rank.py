"""Quality by Bradley-Terry ranking.

A document's score is a weighted sum of its features. Preference pairs (a labelled good document and a labelled bad one)
teach the weights by logistic loss on the pairs' feature differences: the chance that the good one wins is the logistic
function of the difference of scores. The decision threshold is a quantile of the training scores, the share of bad documents
among the labelled ones, and ``quality`` maps scores to 0..1 so that the threshold becomes 0.3.

Features describe the text's shape (case, symbols, repetition, lines, compressibility), each cut into bins at its
quantiles, so the sum is of step functions. Fitted to a bounded sample of labelled documents; every text is scored whole.

Defined cases: null text counts as empty; an empty text has all shares 0 and gets a score like any other; repeated rows are scored
each; without labelled documents of both kinds every score is 0.5; ties in features share a bin; an empty table
gives an empty result; labels, language, source and id are no features; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.labelled import labelled_sample
from gatelens.llm.tables import fold_of, read_table
from gatelens.llm.words import as_bytes

FOLDS, HELD = 5, 0
MOST_FITTED = {0: 3000, 1: 5000}
PAIRS, BINS = 40_000, 12
CUT = 0.3

_KIND = bytes(1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else 0 if c in b" \t\n\v\f\r" else 4 for c in range(256))
NAMES = (
    "words", "word_length", "upper", "symbols", "digits", "distinct", "repeated", "commonest", "symbol_ends", "lines",
    "repeated_lines", "longest_line", "squeezed", "capitals", "long_words", "distinct_thirds",
)


def shape(text: bytes | None) -> list[float]:
    """The features in the order of ``NAMES``."""
    text = text or b""
    words = text.split()
    kinds = np.bincount(np.frombuffer(text.translate(_KIND), np.uint8), minlength=5)
    letters, n, size = max(1, kinds[1] + kinds[2]), max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    ends = sum(w[-1] in b"!*#$%&|@^~=<>" for w in words)
    third = max(1, len(words) // 3)
    thirds = [len(set(words[k : k + third])) / third for k in range(0, len(words) - third + 1, third)] or [0.0]
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        kinds[1] / letters,
        kinds[4] / size,
        kinds[3] / size,
        math.log1p(len(counts)) / math.log1p(n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        counts.most_common(1)[0][1] / n if words else 0.0,
        ends / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, lines), default=0) / size,
        len(zlib.compress(text, 1)) / size,
        sum(w[:1].isupper() for w in words) / n,
        sum(len(w) > 20 for w in words) / n,
        min(thirds),
    ]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 0/1 column per feature and bin: (documents, features * bins)."""
    n, k = values.shape
    bins = edges.shape[1] + 1
    out = np.zeros((n, k * bins), np.float32)
    for f in range(k):
        out[np.arange(n), f * bins + np.searchsorted(edges[f], values[:, f], side="right")] = 1
    return out


@dataclass
class Ranking:
    """Bin edges and weights; ``scale`` and ``cut`` take a raw score to 0..1."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def raw(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.edges) @ self.weights

    def quality(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0)
        z = self.scale * (self.raw(values) - self.cut) + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, rounds: int = 300, ridge: float = 1e-3, rate: float = 0.5) -> np.ndarray:
    """Weights from pairs of feature rows, by gradient steps with momentum."""
    difference = better - worse
    w = v = np.zeros(difference.shape[1], np.float64)
    for t in range(rounds):
        z = difference @ v
        lost = 1 / (1 + np.exp(np.clip(z, -30, 30)))  # the chance given to the worse document
        new = v + rate * (difference.T @ lost / len(z) - ridge * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def fit_ranking(values: np.ndarray, good: np.ndarray, seed: int = 5) -> Ranking:
    """From features and 0/1 labels of a bounded sample. Pairs are drawn at random from all pairs of a good and a bad one."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(values, quantiles, axis=0).T.copy() if len(values) else np.zeros((len(NAMES), BINS - 1))
    yes, no = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(yes) or not len(no):
        return Ranking(edges, np.zeros(len(NAMES) * BINS), math.log(CUT / (1 - CUT)), 1.0)
    rng = np.random.default_rng(seed)
    rows = binned(values, edges)
    weights = bradley_terry(rows[rng.choice(yes, PAIRS)], rows[rng.choice(no, PAIRS)])
    raw = rows @ weights
    return Ranking(edges, weights, float(np.quantile(raw, len(no) / len(good))), 1.0)


def fit(sample: DataFrame, share_bad: float | None = None) -> Ranking:
    """From a bounded table of ``doc_id``, ``text`` and ``quality``; ``share_bad`` is the share of bad documents where the
    sample's differs from it: the threshold is that quantile of the scores, weighted to it."""

    def extract(batches):
        for batch in batches:
            rows = [np.array(shape(t)).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["shape", "quality", "doc_id"])

    known = sample.select("text", F.col("quality").cast("int").alias("quality"), "doc_id").dropna(subset=["quality"])
    got = known.mapInArrow(extract, "shape binary, quality int, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    values = np.array([np.frombuffer(s) for s in got["shape"]]).reshape(-1, len(NAMES))
    good = got["quality"].to_numpy()
    ranking = fit_ranking(values, good)
    if share_bad is not None and 0 < (good == 0).sum() < len(good):
        raw = ranking.raw(values)
        weight = np.where(good == 0, share_bad / (good == 0).sum(), (1 - share_bad) / (good == 1).sum())
        order = np.argsort(raw, kind="stable")
        k = int(np.searchsorted(np.cumsum(weight[order]), share_bad))
        ranking.cut = float((raw[order][min(k, len(raw) - 1)] + raw[order][min(k + 1, len(raw) - 1)]) / 2)
    return ranking


def with_quality(docs: DataFrame, ranking: Ranking, column: str = "quality_score") -> DataFrame:
    """The documents with their score from 0 to 1, from ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(ranking)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        values = np.array([shape(t) for t in as_bytes(text)]).reshape(-1, len(NAMES))
        return pa.array(sent.value.quality(values), pa.float64())

    return docs.withColumn(column, score(F.col("text").cast("string")))


def op5_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    share = labels.filter(fold_of("doc_id", FOLDS) != HELD).agg(F.avg(F.when(F.col("quality") == 0, 1.0).when(F.col("quality") == 1, 0.0))).first()[0]
    ranking = fit(labelled_sample(docs, labels, "quality", MOST_FITTED, FOLDS, HELD), share)
    rows = with_quality(docs, ranking, "score")
    return rows.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op5_quality_rank": op5_quality_rank}
ORACLES = {}
