"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over hashed words and word beginnings; each model
also sees the earlier categories' probabilities, as logits. In fitting, these come from models that haven't seen the
document (out of fold), so a later model learns how far an earlier one can be trusted.

The label table has two columns, so the query's chain is ``low_quality``, then ``toxic``; the operator takes any number of categories.
It is fitted to a bounded sample of labelled documents (``most`` per value of the last category); every text is scored whole.

Defined cases: null, empty and wordless texts have no features and get the models' base rates; repeated rows are scored each; rows without
a label, or with a null label in some category, aren't fitted; with one class only, a category's probability is its rate;
an empty table gives an empty result; other columns are passed on by ``with_toxicity`` and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.labelled import labelled_sample
from gatelens.llm.tables import fold_of, read_table
from gatelens.llm.words import ALNUM, as_bytes, in_parts

FOLDS, HELD = 5, 0
BITS = 18
BEGINNINGS = (4, 5, 6, 7)
KEPT_FEATURES, LEAST_ASSOCIATION = 20_000, 12.0  # the second: a chi-square value
OUT_OF_FOLD = 3
MOST_FITTED = {1: 2500, 0: 5000}
CHAIN = ("low_quality", "toxic")


class _Cells(dict):
    """The hashed features of a word: itself and its beginnings. Emptied when large."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 50_000:
            self.clear()
        parts = [b"w" + word, *(b"%d" % n + word[:n] for n in BEGINNINGS if len(word) >= n)]
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(p) & ((1 << BITS) - 1) for p in parts)
        return value


_cells = _Cells()


Row = tuple[np.ndarray, np.ndarray]


def features(text: bytes | None) -> Row:
    """The hashed features of a text's distinct words (runs of letters and digits, A-Z lower-cased) and their values,
    log2(1 + the distinct words that have the feature)."""
    words = set(text.translate(ALNUM).split()) if text else ()
    cells, counts = np.unique(np.array([c for w in words for c in _cells[w]], np.int32), return_counts=True)
    return cells, np.log2(1 + counts).astype(np.float32)


@dataclass
class Linear:
    """A logistic model: weights of hashed features, of the earlier categories' logits, and a bias."""

    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def logit(self, rows: list[Row], earlier: np.ndarray) -> np.ndarray:
        """``earlier``: (rows, earlier categories)."""
        own = np.array([self.weights[cells] @ values for cells, values in rows]) if rows else np.zeros(0)
        return own + earlier @ self.chained + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: list[Row], earlier: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 2e-3) -> Linear:
    """Balanced logistic regression by accelerated gradient steps, over the features most associated with the label."""
    weights, chained = np.zeros(1 << BITS, np.float32), np.zeros(earlier.shape[1])
    rate = y.mean() if len(y) else 0.0
    if rate in (0.0, 1.0):
        return Linear(weights, chained, 8.0 if rate else -8.0)
    n, p = len(y), y.sum()
    seen, positive = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (cells, _), label in zip(rows, y):  # a document's features are distinct
        seen[cells] += 1
        positive[cells] += label
    usual = seen * rate
    score = (positive - usual) ** 2 / np.maximum(usual * (1 - rate) * (1 - seen / n), 1e-9) * (seen >= 3) * (seen < n)
    kept = np.sort(np.argsort(-score, kind="stable")[:KEPT_FEATURES])
    kept = kept[score[kept] >= LEAST_ASSOCIATION]
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    inside = [place[cells] >= 0 for cells, _ in rows]
    columns, values = (np.concatenate(x) for x in zip(*((place[cells[own]], values[own]) for (cells, values), own in zip(rows, inside))))
    owner = np.repeat(np.arange(n), [own.sum() for own in inside])
    balance = np.where(y == 1, 0.5 / p, 0.5 / (n - p))
    w, c, b = np.zeros(len(kept)), np.zeros(earlier.shape[1]), 0.0
    # A feature's step shrinks with its share of the documents; Nesterov's momentum over all parameters.
    share = np.bincount(columns, balance[owner] * values * values, len(kept)) if len(kept) else np.zeros(0)
    size = np.sqrt(np.maximum(np.bincount(owner, minlength=n).mean(), 1) * np.maximum(share, 1e-4))
    vw, vc, vb = w.copy(), c.copy(), b
    for t in range(rounds):
        z = np.bincount(owner, vw[columns] * values, n) + earlier @ vc + vb
        g = (_sigmoid(z) - y) * balance
        nw = vw - (np.bincount(columns, g[owner] * values, len(kept)) + ridge * vw) / size
        nc, nb = vc - 0.2 * (earlier.T @ g + ridge * vc), vb - g.sum()
        m = t / (t + 3)
        vw, vc, vb = nw + m * (nw - w), nc + m * (nc - c), nb + m * (nb - b)
        w, c, b = nw, nc, nb
    weights[kept] = w
    return Linear(weights, c, float(b))


@dataclass
class Chain:
    """The models in order, and for each the probability from which its category holds."""

    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, rows: list[Row]) -> np.ndarray:
        logits = np.zeros((len(rows), 0))
        for model in self.models:
            logits = np.column_stack([logits, np.clip(model.logit(rows, logits), -8, 8)])
        return _sigmoid(logits)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability with the best F1, midway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][p[order][1:] == p[order][:-1]] = -1  # equal probabilities stay together
    k = int(np.argmax(f1))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def fit_chain(rows: list[Row], labels: np.ndarray, categories: tuple[str, ...], folds: np.ndarray) -> Chain:
    """``labels``: (documents, categories); ``folds``: each document's part for out-of-fold predictions."""
    logits, models, thresholds = np.zeros((len(rows), 0)), [], []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        out = np.zeros(len(rows))
        for fold in range(OUT_OF_FOLD):
            own, rest = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            model = fit_linear([rows[i] for i in rest], logits[rest], y[rest])
            out[own] = np.clip(model.logit([rows[i] for i in own], logits[own]), -8, 8)
        models.append(fit_linear(rows, logits, y))
        thresholds.append(best_threshold(_sigmoid(out), y) if len(rows) else 0.5)
        logits = np.column_stack([logits, out])
    return Chain(categories, models, thresholds)


def fit(sample: DataFrame, categories: tuple[str, ...]) -> Chain:
    """The chain from a bounded table of ``doc_id``, ``text`` and a 0/1 column per category."""

    def extract(batches):
        for batch in batches:
            rows = [features(t) for t in as_bytes(batch.column(1))]
            packed = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed, *batch.columns[2:]], names=["doc_id", "cells", "values", *categories])

    known = sample.select("doc_id", "text", *(F.col(c).cast("int") for c in categories)).dropna(subset=list(categories))
    got = known.mapInArrow(extract, "doc_id long, cells binary, values binary, " + ", ".join(f"`{c}` int" for c in categories)).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    rows = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(got["cells"], got["values"])]
    folds = np.array([xxhash.xxh3_64_intdigest(b"fold%d" % i) % OUT_OF_FOLD for i in got["doc_id"]], int)
    return fit_chain(rows, got[list(categories)].to_numpy(), categories, folds)


def with_toxicity(docs: DataFrame, chain: Chain, column: str = "toxicity") -> DataFrame:
    """The documents with a struct of the categories' probabilities (``p_<category>``) and decisions, from ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(c, T.IntegerType()) for c in chain.categories]

    @F.arrow_udf(T.StructType(fields))
    def score(text: pa.Array) -> pa.Array:
        model: Chain = sent.value
        p = np.concatenate([model.probabilities([features(t) for t in as_bytes(part)]) for part in in_parts(text)])
        columns = [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array((p[:, k] >= t).astype(np.int32)) for k, t in enumerate(model.thresholds)]
        return pa.StructArray.from_arrays(columns, names=[f.name for f in fields])

    return docs.withColumn(column, score(F.col("text").cast("string")))


def corpus_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Chain:
    """The chain fitted to the folder's labels, on texts of ``docs``."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality")).alias("low_quality"), "toxic")
    return fit(labelled_sample(docs, labels, "toxic", MOST_FITTED, FOLDS, HELD), CHAIN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_toxicity(docs, corpus_chain(spark, sf_dir, docs))
    return rows.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), F.col("toxicity.toxic").alias("toxic"), F.col("toxicity.p_toxic").alias("score"), F.col("toxicity.p_low_quality").alias("low_quality_score"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES = {}
