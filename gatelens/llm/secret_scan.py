"""Secret scans with a character convolutional network over every candidate and its context.

Fixed patterns give the base findings. Candidates are the base findings' secrets and all other runs of 16 or more token
characters (12 or more with a digit), or parts of such runs left and right of a base finding. The network sees 62 characters:
18 before, 36 of the candidate, and 8 after. Over a longer candidate it slides in overlapping windows, and the largest logit
counts. It is trained on windows of labelled candidates (label: a base pattern found it), a bounded sample by hash; in a part of
the training the context is blanked, so that a secret without a telling key is known by itself. Logits of all held-out
candidates, counted in a histogram per kind, calibrate the probability and set, per kind, the highest threshold that
keeps the wanted recall. Candidates at or above it are added to the base findings, which always stay.

Defined cases: null text counts as empty and has no findings; rows with equal ids are scanned each; a null id counts as
empty text for its fold; without labelled candidates of both labels nothing is added; a kind without held-out findings
takes the threshold of all kinds; an empty table gives an empty result; other columns are passed on by ``redacted`` and not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelens.llm.tables import read_table, saved
from gatelens.llm.words import in_parts

FOLDS, HELD = 5, 0
MOST_FITTED = 2000
RECALL = 0.99
BEFORE, HEAD, TAIL, AFTER = 18, 20, 16, 8
WIDTH = BEFORE + HEAD + TAIL + AFTER
EMBEDDED, FILTERS, KERNEL = 8, 20, 5
BINS, REACH = 400, 20.0

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "network")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
HAS_DIGIT = re.compile(r"[0-9]")
REPLACEMENT = "[SECRET]"


def base_findings(text: str) -> list[tuple[int, int, int, int, int]]:
    """``(start, kind, end, secret's start, secret's end)`` in order; per kind leftmost and not overlapping.

    A run of 24 hex digits or more starts where a run of any length does, so the shorter ones need no matching.
    """
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, label)``: the base findings' secrets, and the token runs' parts outside base findings."""
    out = [(s, e, 1) for _, _, _, s, e in base]
    spans = sorted((b[0], b[2]) for b in base)
    for m in TOKEN.finditer(text):
        for s, e in outside(*m.span(), spans):
            if e - s >= 16 or e - s >= 12 and HAS_DIGIT.search(text, s, e):
                out.append((s, e, 0))
    return out


def outside(start: int, end: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a run that no span covers; ``spans`` are in order of start."""
    for a, b in spans:
        if a >= end:
            break
        if b > start:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def window(text: str, start: int, end: int) -> bytes:
    """The network's view of a candidate: ASCII, others as ``?``, blanks as 0. Of a candidate longer than head and tail it holds the two ends only; see ``windows``."""
    head = text[start : min(end, start + HEAD)]
    tail = text[max(start + len(head), end - TAIL) : end]
    view = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + head.ljust(HEAD, "\0") + tail.rjust(TAIL, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    return view.encode("ascii", "replace")


def windows(text: str, start: int, end: int) -> bytes:
    """The candidate's windows one after another: each of its characters is in one or more, with what is around it."""
    size = HEAD + TAIL
    if end - start <= size:
        return window(text, start, end)
    return b"".join(window(text, k, k + size) for k in [*range(start, end - size, size // 2), end - size])


def kind_of(token: str) -> int:
    """0 lower-case hex, 1 upper case and digits, 2 other."""
    return 0 if re.fullmatch(r"[0-9a-f]+", token) else 1 if re.fullmatch(r"[A-Z0-9]+", token) else 2


def codes(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)


def largest(values: np.ndarray, views: list[bytes]) -> np.ndarray:
    """Of each candidate's windows' values the largest."""
    return np.maximum.reduceat(values, np.cumsum([0] + [len(v) // WIDTH for v in views[:-1]])) if views else values


class Network:
    """Embedding, one convolution, the largest response before, in and after the candidate, and a logistic output."""

    NAMES = ("embedding", "kernel", "kernel_bias", "out", "out_bias")
    CUTS = (0, BEFORE - 2, BEFORE + HEAD + TAIL - 2, WIDTH - KERNEL + 1)

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"embedding": f(0.5, 128, EMBEDDED), "kernel": f(0.2, KERNEL * EMBEDDED, FILTERS), "kernel_bias": np.zeros(FILTERS, np.float32), "out": f(0.2, 3 * FILTERS), "out_bias": np.zeros(1, np.float32)}

    def _pooled(self, x: np.ndarray):
        e = self.w["embedding"][x]
        patches = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * EMBEDDED)
        response = np.maximum(patches @ self.w["kernel"] + self.w["kernel_bias"], 0)
        parts = [response[:, a:b] for a, b in zip(self.CUTS, self.CUTS[1:])]
        return patches, parts, np.concatenate([p.max(1) for p in parts], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [self._pooled(x[k : k + 1024])[2] @ self.w["out"] + self.w["out_bias"][0] for k in range(0, len(x), 1024)]
        return np.concatenate(out) if out else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, least_steps: int = 800, batch: int = 128, rate: float = 0.004, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-least_steps * batch // max(1, len(x))))
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                view = x[at].copy()
                view[rng.random(len(at)) < 0.3, :BEFORE] = 0
                grads = self._gradients(view, y[at])
                step += 1
                for name, g in grads.items():
                    first[name] += (g - first[name]) * 0.1
                    second[name] += (g * g - second[name]) * 0.005
                    self.w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.995**step)) + 1e-7)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        patches, parts, pooled = self._pooled(x)
        z = pooled @ self.w["out"] + self.w["out_bias"][0]
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        back = d[:, None] * self.w["out"]
        response = np.zeros((len(x), WIDTH - KERNEL + 1, FILTERS), np.float32)
        rows, columns = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k, (part, start) in enumerate(zip(parts, self.CUTS)):
            top = part.argmax(1)
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            response[rows, start + top, columns] = back[:, own] * (pooled[:, own] > 0)
        flat = response.reshape(-1, FILTERS)
        d_patches = (flat @ self.w["kernel"].T).reshape(len(x), -1, KERNEL, EMBEDDED)
        d_embedding = np.zeros_like(self.w["embedding"])
        for k in range(KERNEL):
            np.add.at(d_embedding, x[:, k : k + d_patches.shape[1]].ravel(), d_patches[:, :, k].reshape(-1, EMBEDDED))
        return {"embedding": d_embedding, "kernel": patches.reshape(len(flat), -1).T @ flat, "kernel_bias": flat.sum(0), "out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}


@dataclass
class Scanner:
    """The network, its calibration (probability = logistic of slope * logit + shift) and each kind's threshold."""

    network: Network | None
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float, float] = (2.0, 2.0, 2.0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(x) + self.shift, -30, 30)))

    def findings(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """``(start, kind, end)`` of each text's base and added findings, in order."""
        out, views, places = [], [], []
        for k, text in enumerate(texts):
            base = base_findings(text) if text else []
            out.append([b[:3] for b in base])
            if text and self.network:
                for s, e, label in candidates(text, base):
                    if not label:
                        views.append(windows(text, s, e))
                        places.append((k, s, e, kind_of(text[s:e])))
        if views:
            p = largest(self.probabilities(codes(views)), views)
            for (k, s, e, kind), chance in zip(places, p):
                if chance >= self.thresholds[kind]:
                    out[k].append((s, 3, e))
        return [sorted(x) for x in out]


CANDIDATES = pa.schema([("held", pa.bool_()), ("label", pa.int32()), ("kind", pa.int32()), ("stratum", pa.int32()), ("view", pa.binary())])
CANDIDATES_DDL = "held boolean, label int, kind int, stratum int, view binary"


def labelled_candidates(docs: DataFrame) -> DataFrame:
    """Every candidate of every text with its label and, in ``view``, its windows; ``stratum`` parts them by label and by having a digit."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = zlib.crc32((doc_id or "").encode()) % FOLDS == HELD
                for s, e, label in candidates(text, base_findings(text)) if text else ():
                    token = text[s:e]
                    rows.append((held, label, kind_of(token), 2 * label + bool(HAS_DIGIT.search(token)), windows(text, s, e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, CANDIDATES)], schema=CANDIDATES)

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(extract, CANDIDATES_DDL)


def fit(docs: DataFrame, most_fitted: int = MOST_FITTED, recall: float = RECALL) -> Scanner:
    """The network is fitted to at most ``most_fitted`` candidates' windows per stratum; calibration and thresholds take all held-out ones."""
    spark = docs.sparkSession
    known = saved(labelled_candidates(docs), "candidates")
    order = F.xxhash64("view")
    starts = F.sequence(F.lit(1), F.octet_length("view"), F.lit(WIDTH))
    each = known.filter(~F.col("held")).select("label", "stratum", F.explode(F.transform(starts, lambda k: F.substring("view", k, WIDTH))).alias("view"))
    parts = [each.filter(F.col("stratum") == s).dropDuplicates(["view"]).orderBy(order, "view").limit(most_fitted) for s in range(4)]
    sample = reduce(DataFrame.union, parts).toPandas()
    y = sample["label"].to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        return Scanner(None)
    network = Network()
    network.train(codes([bytes(v) for v in sample["view"]]), y)
    sent = spark.sparkContext.broadcast(network)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3, BINS), np.int64)
        for batch in batches:
            views = batch.column(2).to_pylist()
            z = largest(sent.value.logits(codes(views)), views)
            at = np.clip((z + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(int)
            np.add.at(total, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), at), 1)
        label, kind, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(kind), pa.array(cell), pa.array(total[label, kind, cell])], names=["label", "kind", "cell", "n"])

    held = known.filter("held").select("label", "kind", "view").mapInArrow(count, "label long, kind long, cell long, n long")
    histogram = np.zeros((2, 3, BINS))
    for r in held.groupBy("label", "kind", "cell").agg(F.sum("n").alias("n")).collect():  # at most 2 x 3 x BINS rows
        histogram[r["label"], r["kind"], r["cell"]] = r["n"]
    return calibrated(network, histogram, recall)


def calibrated(network: Network, histogram: np.ndarray, recall: float) -> Scanner:
    """Slope and shift by Newton steps on the histogram (label, kind, logit cell), thresholds from its upper tails."""
    lower = (np.arange(BINS) / BINS * 2 - 1) * REACH
    z, negative, positive = lower + REACH / BINS, histogram[0].sum(0) + 1e-3, histogram[1].sum(0) + 1e-3
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        n = negative + positive
        g = np.array([((p * n - positive) * z).sum() + 0.1 * (a - 1), (p * n - positive).sum() + 0.1 * b])
        v = n * p * (1 - p)
        step = np.linalg.solve(np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]]), g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -3, 3)
    a = max(a, 1e-3)

    def threshold(counts: np.ndarray) -> float:
        """The probability at the lower edge of the highest cell from which on ``recall`` of the findings lie."""
        if not counts.sum():
            return 2.0
        above = np.cumsum(counts[::-1])[::-1] / counts.sum()
        return float(1 / (1 + np.exp(-np.clip(a * lower[np.flatnonzero(above >= recall)[-1]] + b, -30, 30))))

    every = threshold(histogram[1].sum(0))
    return Scanner(network, float(a), float(b), tuple(threshold(h) if h.sum() else every for h in histogram[1]))


FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))


def with_findings(docs: DataFrame, scanner: Scanner, column: str = "findings") -> DataFrame:
    """The documents with their findings (code points, end exclusive) in order of start, then kind as listed."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.arrow_udf(FINDINGS)
    def find(text: pa.Array) -> pa.Array:
        found = [f for part in in_parts(text) for f in sent.value.findings(part.to_pylist())]
        rows = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in f] for f in found]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])))

    return docs.withColumn(column, find(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def redacted(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The documents with every finding in ``text`` replaced, and ``n_chars``, if there is one, counted anew where it was; others stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.arrow_udf(T.StringType())
    def replace(text: pa.Array) -> pa.Array:
        out = []
        for part in in_parts(text):
            texts = part.to_pylist()
            out.append(pa.array([without(t, f) for t, f in zip(texts, sent.value.findings(texts))], pa.string()))
        return pa.concat_arrays(out)

    changed = replace(F.col("text").cast("string"))
    out = docs.withColumn("__kept_text", F.col("text")).withColumn("text", changed)
    if "n_chars" in docs.columns:
        count = F.when(F.col("text").eqNullSafe(F.col("__kept_text")), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", count)
    return out.drop("__kept_text")


def without(text: str | None, findings: list[tuple[int, int, int]]) -> str | None:
    """The text with each run of overlapping findings replaced."""
    if not findings:
        return text
    parts, at, i = [], 0, 0
    while i < len(findings):
        start, _, end = findings[i]
        i += 1
        while i < len(findings) and findings[i][0] < end:
            end = max(end, findings[i][2])
            i += 1
        parts += [text[at:start], REPLACEMENT]
        at = end
    return "".join(parts) + text[at:]


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_findings(docs, fit(docs))
    text = lambda found: F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(text(F.filter("findings", lambda f: f["kind"] != "network")), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
        of("network").alias("n_network"),
    )


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES = {}
