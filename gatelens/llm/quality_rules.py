"""Quality rules: base counts, and a calibrated n-gram model for what passes them.

The model is a logistic regression over hashed n-grams: single words, word pairs, which of three successive words are equal, and
character pairs and triples, each kind as shares of its own number. It is trained on labelled rows by AdaGrad steps. Three models
that haven't seen a document give its out-of-fold logit, and a logistic curve through these (Platt), weighted to the labels' real
rates, makes the final model's logit a probability. Texts are scored whole, in Arrow batches, against fixed thresholds.

Fitted to a bounded sample: at most ``MOST_FITTED`` labelled documents of each class, outside fold 0 of 5, which is left for measuring.

Defined cases: null text counts as empty; an empty text has no words, so the base rules reject it; repeated rows are judged each; labels of
null ids, null labels and ids without a document aren't used; of conflicting labels of an id the smallest holds; without labels of both classes
the probability is the share of good labels, or 0.5 without any; an empty table gives an empty result; other columns are passed
on by ``with_rules`` and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.labelled import labelled_sample
from gatelens.llm.tables import fold_of, read_table
from gatelens.llm.words import WordHashes, as_bytes, by_bytes, mixed, windows_of

FOLDS, HELD = 5, 0
MOST_FITTED = {0: 1500, 1: 2500}
OUT_OF_FOLD = 3
EPOCHS, RATE, RIDGE = 6, 0.4, 1e-6
CELLS = 1 << 16  # for each kind of n-gram
KINDS = ("word", "word pair", "equal words", "character pair", "character triple")
#: A share of all n-grams is small; this brings values near 1.
SCALE = 20.0

LEAST_WORDS, MOST_REPEATED_PERCENT, REPEATED_WINDOW = 20, 30, 8
#: Probabilities of being good: below the first a text is rejected, from the second on it passes without reserve.
KEPT_FROM, GOOD_FROM = 0.5, 0.9

SPACES, SYMBOLS, CONTINUATION = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_hashes = WordHashes()


def _cells(h: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(h + np.uint64(kind)) >> np.uint64(48)).astype(np.int64) + kind * CELLS


class Texts:
    """Some texts with their words and characters as streams of numbers."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        words = [t.split() for t in self.texts]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.ids = np.concatenate([_hashes.of(w) for w in words] or [np.zeros(0, np.uint64)])

    def n_grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind: the cells of all n-grams, text by text, and their number per text."""
        ids, n = self.ids, self.n_words
        points = [t.decode(errors="replace").encode("utf-32-le") for t in self.texts]
        chars, lengths = np.frombuffer(b"".join(points), np.uint32).astype(np.uint64), np.array([len(p) // 4 for p in points], np.int64)
        equal = np.zeros(max(0, len(ids) - 2), np.uint64)
        if len(ids) > 2:
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            equal = (a == b).astype(np.uint64) + 2 * (b == c).astype(np.uint64) + 4 * (a == c).astype(np.uint64)
        inside = np.arange(len(equal)) + 3 <= np.repeat(np.cumsum(n), n)[: len(equal)]
        found = [(ids, n), windows_of(ids, n, 2), (equal[inside], np.maximum(n - 2, 0)), windows_of(chars, lengths, 2), windows_of(chars, lengths, 3)]
        return [(_cells(h, kind), counts) for kind, (h, counts) in enumerate(found)]

    def repeated(self) -> np.ndarray:
        """Words per text that lie in a window which the text has twice or more. Windows are compared by 64 bits, with the text's number."""
        w, n = REPEATED_WINDOW, self.n_words
        h, counts = windows_of(self.ids, n, w)
        owner = np.repeat(np.arange(len(n)), counts)
        keys = mixed(h ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        # The k-th window of a text starts at its k-th word.
        first = np.cumsum(n) - n
        at = (np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts))[twice]
        marks = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + w, -1)
        covered = np.r_[0, np.cumsum(np.cumsum(marks[:-1]) > 0)]
        return covered[first + n] - covered[first]

    def base(self) -> list[np.ndarray]:
        """The counts in the order of ``BASE``."""
        chars, symbols, lines = [], [], []
        for t in self.texts:
            chars.append(len(t.translate(None, SPACES + CONTINUATION)))
            symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
            full = [line for line in t.split(b"\n") if line.strip(SPACES)]
            lines.append(len(full) - len(set(full)))
        return [self.n_words, *(np.array(x, np.int64) for x in (chars, symbols, lines)), self.repeated()]


@dataclass
class Model:
    """Weights of the cells and a bias; ``slope`` and ``level`` take a logit to a calibrated one."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    level: float = 0.0

    def logit(self, texts: Texts) -> np.ndarray:
        z = np.full(len(texts.texts), self.bias)
        for cells, counts in texts.n_grams():
            sums = np.r_[0, np.cumsum(self.weights[cells], dtype=np.float64)]
            ends = np.cumsum(counts)
            z += SCALE * (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)
        return z

    def probability(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.slope * self.logit(texts) + self.level)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Row = tuple[np.ndarray, np.ndarray]


def training_row(text: bytes | None) -> Row:
    """The distinct cells of a text, and their values."""
    cells, values = [], []
    for found, counts in Texts([text]).n_grams():
        own, times = np.unique(found, return_counts=True)
        cells.append(own.astype(np.int32))
        values.append((SCALE * times / max(1, counts[0])).astype(np.float32))
    return np.concatenate(cells), np.concatenate(values)


def fit_weights(rows: list[Row], y: np.ndarray, weight: np.ndarray, seed: int = 13) -> Model:
    """AdaGrad over the rows in random order, ``EPOCHS`` times."""
    w, seen = np.zeros(len(KINDS) * CELLS, np.float32), np.full(len(KINDS) * CELLS, 1e-6, np.float32)
    bias, bias_seen = 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            cells, values = rows[k]
            g = weight[k] * (1 / (1 + np.exp(-np.clip(w[cells] @ values + bias, -30, 30))) - y[k])
            step = g * values + RIDGE * w[cells]
            seen[cells] += step * step
            w[cells] -= RATE * step / np.sqrt(seen[cells])
            bias_seen += g * g
            bias -= RATE * g / np.sqrt(bias_seen)
    return Model(w, float(bias))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and level of the logistic curve through logits and labels, by Newton steps; targets are drawn in as Platt does."""
    yes, no = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([z, np.ones(len(z))])
    v = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ v)
        gradient = x.T @ (weight * (p - target)) + 1e-6 * v
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        v = v - np.clip(step, -1, 1)
        if abs(step).max() < 1e-6:
            break
    return float(v[0]), float(v[1])


def fit_model(rows: list[Row], good: np.ndarray, folds: np.ndarray, share_good: float) -> Model:
    """``good``: 0/1 labels; ``folds``: each row's part for out-of-fold logits; ``share_good``: among all labels."""
    y, n = good.astype(float), len(good)
    if not 0 < y.sum() < n:
        p = min(max(share_good, 1e-3), 1 - 1e-3)
        return Model(np.zeros(len(KINDS) * CELLS, np.float32), float(np.log(p / (1 - p))))
    balance = np.where(y == 1, 0.5 * n / y.sum(), 0.5 * n / (n - y.sum()))
    z = np.zeros(n)
    for fold in range(OUT_OF_FOLD):
        own, rest = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
        part = fit_weights([rows[i] for i in rest], y[rest], balance[rest])
        z[own] = [part.weights[rows[i][0]] @ rows[i][1] + part.bias for i in own]
    model = fit_weights(rows, y, balance)
    real = np.where(y == 1, share_good * n / y.sum(), (1 - share_good) * n / (n - y.sum()))
    model.slope, model.level = platt(z, y, real)
    return model


def fit(sample: DataFrame, share_good: float) -> Model:
    """From a bounded table of ``doc_id``, ``text`` and ``quality`` (0 or 1)."""

    def extract(batches):
        for batch in batches:
            rows = [training_row(t) for t in as_bytes(batch.column(0))]
            packed = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*packed, batch.column(1), batch.column(2)], names=["cells", "values", "quality", "doc_id"])

    known = sample.select("text", F.col("quality").cast("int").alias("quality"), "doc_id").dropna(subset=["quality"])
    got = known.mapInArrow(extract, "cells binary, values binary, quality int, doc_id long").toPandas()
    got = got.sort_values(["doc_id", "cells"], kind="stable")
    rows = [(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(got["cells"], got["values"])]
    folds = (mixed(got["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(OUT_OF_FOLD)).astype(int)
    return fit_model(rows, got["quality"].to_numpy(), folds, share_good)


def with_rules(docs: DataFrame, model: Model, column: str = "rules") -> DataFrame:
    """The documents with a struct of the base counts, ``base_failed``, the probability ``p_good``, ``verdict`` (``reject``, ``pass`` or ``good``,
    the model's alone) and ``kept``, from ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [(name, pa.int64()) for name in BASE] + [("base_failed", pa.bool_()), ("p_good", pa.float64()), ("verdict", pa.string()), ("kept", pa.bool_())]
    types = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType()}

    @F.arrow_udf(T.StructType([T.StructField(name, types[kind]) for name, kind in kinds]))
    def judge(text: pa.Array) -> pa.Array:
        parts = []
        for part in by_bytes(text):
            texts = Texts(as_bytes(part))
            base, p = texts.base(), sent.value.probability(texts)
            failed = (base[0] < LEAST_WORDS) | (100 * base[4] > MOST_REPEATED_PERCENT * base[0])
            verdict = np.select([p < KEPT_FROM, p < GOOD_FROM], ["reject", "pass"], "good")
            columns = [*base, failed, p, verdict.tolist(), ~failed & (p >= KEPT_FROM)]
            parts.append(pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], names=[name for name, _ in kinds]))
        return pa.concat_arrays(parts)

    return docs.withColumn(column, judge(F.col("text").cast("string")))


def corpus_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model fitted to the folder's labels, on texts of ``docs``."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labels = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = labels.filter(fold_of("doc_id", FOLDS) != HELD).agg(F.avg("quality")).first()[0]
    return fit(labelled_sample(docs, labels, "quality", MOST_FITTED, FOLDS, HELD), 0.5 if share is None else share)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_rules(docs, corpus_model(spark, sf_dir, docs))
    return rows.select("doc_id", *(F.col(f"rules.{c}").alias(c) for c in (*BASE, "base_failed", "kept")), F.col("rules.p_good").alias("score"))


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLES = {}
