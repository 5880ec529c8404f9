"""Language identification with segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary; each language has its own piece probabilities. A word's probability in a language
sums over all its segmentations into pieces, by a forward pass; a text's is the product over its words. Probabilities
are fitted by expectation and maximisation (forward and backward passes give each piece's expected count) on word counts
of a bounded sample of labelled documents, ``most_fitted`` per language by hash; both steps run over Spark's partitions.

Words are runs of letters, lower-cased and whole, whatever their length; pieces have any length up to the vocabulary's longest.
The passes keep as many letters as that at a time, and scale their probabilities on the way, so that long words neither
underflow nor fill the memory. A letter that no piece holds is an unknown piece.

Defined cases: null text or a text without a letter is ``und`` with score 0; so is every text if no language is learned;
empty texts likewise; rows with equal ids are predicted each; a null id counts as empty text for its fold; between
languages of equal probability the first by name wins; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelens.llm.tables import fold_of, read_table, saved
from gatelens.llm.words import MULTIPLIERS, mixed

FOLDS, HELD = 5, 0
MOST_FITTED, ROUNDS = 1000, 4
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
WORDS_AT_ONCE = 400_000
#: Words of one length in a pass, places of its lattice held at a time, letters between two scalings, parts of a language that are ranked apart.
ABREAST, PLACES, SCALED, SALTS = 10_000, 2_000_000, 8, 64
UNDETERMINED = "und"


def load_pieces(path: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary's ordinary pieces, numbered from 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return {p: k for k, p in enumerate(dict.fromkeys(map(model.id_to_piece, ids)))}


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each after a word-start mark."""
    found = LETTERS.findall(text.lower()) if text else ()
    return [WORD_START + word for word in found if word.isalpha() or any(c.isalpha() for c in word)]


class PieceTable:
    """The pieces by hash, in two tables, so that many parts of words are looked up at once."""

    BITS = 21

    def __init__(self, pieces: dict[str, int]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        hashes = np.zeros(self.size, np.uint64)
        for piece, k in pieces.items():
            h = np.zeros((1, 1), np.uint64)
            for code in _codes([piece]).T:
                h = _longer(h, code[:, None])
            hashes[k] = _finished(h, len(piece))[0, 0]
        ids, (first, second) = np.arange(self.size, dtype=np.int32), self._slots(hashes)
        self.hashes = np.append(hashes, np.uint64(0))
        self.tables = [np.full(1 << self.BITS, self.size, np.int32) for _ in range(2)]
        self.tables[0][first] = ids
        lost = self.tables[0][first] != ids
        self.tables[1][second[lost]] = ids[lost]
        if (self.tables[1][second[lost]] != ids[lost]).any():
            raise ValueError("two pieces share both slots; use more bits")

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64), (h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces' numbers; ``size + 1`` for none."""
        out = np.full(h.shape, self.size + 1, np.int32)
        for table, slot in zip(self.tables, self._slots(h)):
            k = table[slot]
            hit = (self.hashes[k] == h) & (k < self.size)
            out[hit] = k[hit]
        return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return h * MULTIPLIERS[0] + codes.astype(np.uint64) + np.uint64(1)


def _finished(h: np.ndarray, size: int) -> np.ndarray:
    return mixed(h ^ (np.uint64(size) << np.uint64(56)))


class Hits(NamedTuple):
    """Pieces in words of one length, by end (letters up to there), then word. Each word has one or more at each end."""

    end: np.ndarray
    word: np.ndarray
    size: np.ndarray
    piece: np.ndarray


def lattice(codes: np.ndarray, pieces: PieceTable, low: int, high: int) -> Hits:
    """The pieces that end after ``low`` and not after ``high`` letters. The number beyond the pieces means the unknown piece."""
    unknown, none = pieces.size, pieces.size + 1
    first = max(0, low - pieces.longest + 1)
    codes = codes[:, first:high]
    n, m = codes.shape
    found = np.full((high - low, n, min(pieces.longest, m)), none, np.int32)
    h = np.zeros(codes.shape, np.uint64)
    for size in range(1, found.shape[2] + 1):
        h = _longer(h[:, : m - size + 1], codes[:, size - 1 :])
        skipped = max(0, low - first - size + 1)  # these end before the range
        at = first + skipped + size - 1 - low
        found[at:, :, size - 1] = pieces.find(_finished(h[:, skipped:], size)).T
    letters = found[:, :, 0]
    letters[letters == none] = unknown
    end, word, size = np.nonzero(found != none)
    return Hits(end + low + 1, word, size + 1, found[end, word, size])


def passed(codes: np.ndarray, pieces: PieceTable, p: np.ndarray, each: bool = False) -> np.ndarray:
    """Logarithms of the words' probabilities, (words, languages); ``p`` is (pieces + 2, languages). If ``each``, those of
    all their beginnings: (letters + 1, words, languages)."""
    n, m = codes.shape
    reach = pieces.longest
    step = max(SCALED, PLACES // (n * reach))
    alpha = np.zeros((reach + min(step, m) + 1, n, p.shape[1]))  # beginnings of low - reach letters and more
    alpha[reach] = 1
    scale = np.zeros(alpha.shape[1:])
    logs = [scale[None]] if each else []
    for low in range(0, m, step):
        high = min(m, low + step)
        hits = lattice(codes, pieces, low, high)
        starts = np.flatnonzero(np.r_[True, (hits.word[1:] != hits.word[:-1]) | (hits.end[1:] != hits.end[:-1])]).reshape(high - low, n)
        cuts = np.r_[starts[:, 0], len(hits.end)]
        back = hits.end - hits.size - low + reach
        for k in range(high - low):
            own, now = slice(cuts[k], cuts[k + 1]), k + 1 + reach
            alpha[now] = np.add.reduceat(alpha[back[own], hits.word[own]] * p[hits.piece[own]], starts[k] - cuts[k], axis=0)
            if each:
                logs.append((np.log(alpha[now]) + scale)[None])
            if (low + k + 1) % SCALED == 0:
                window = alpha[now - reach + 1 : now + 1]
                largest = window.max(0)
                window /= largest
                scale = scale + np.log(largest)
        alpha[1 : reach + 1] = alpha[high - low + 1 : high - low + reach + 1].copy()
    return np.concatenate(logs) if each else np.log(alpha[reach]) + scale


def backward_table(pieces: dict[str, int]) -> PieceTable:
    """The same numbers for the pieces read from their ends."""
    return PieceTable({piece[::-1]: k for piece, k in pieces.items()})


def expected(words: list[str], pieces: PieceTable, backwards: PieceTable, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words of one length that occur ``times`` often, for one language: ``p`` is (pieces + 2, 1)."""
    codes = _codes(words)
    n, m = codes.shape
    forward = passed(codes, pieces, p, each=True)[:, :, 0]
    backward = passed(codes[:, ::-1], backwards, p, each=True)[::-1, :, 0]
    out = np.zeros(len(p))
    step = max(SCALED, PLACES // (n * pieces.longest))
    for low in range(0, m, step):
        end, word, size, piece = lattice(codes, pieces, low, min(m, low + step))
        share = np.exp(forward[end - size, word] + backward[end, word] - forward[m, word])
        out += np.bincount(piece, share * p[piece, 0] * times[word], len(p))
    return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words, those of one length together, at most ``ABREAST`` at a time."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else ():
        yield from (part[k : k + ABREAST] for k in range(0, len(part), ABREAST))


class LanguageModel:
    """``languages`` in order of name, and their piece probabilities (pieces + 2, languages); the last row is 0."""

    def __init__(self, languages: list[str], pieces: PieceTable, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at in by_length(words):
            out[at] = passed(_codes([words[k] for k in at]), self.pieces, self.p)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its probability among the learned ones."""
        numbers: dict[str, int] = {}
        docs = [[numbers.setdefault(w, len(numbers)) for w in words_of(t)] for t in texts]
        scores = self.word_scores(list(numbers))
        languages, sure = [], []
        for doc in docs:
            if not doc or not self.languages:
                languages.append(UNDETERMINED)
                sure.append(0.0)
                continue
            at, times = np.unique(doc, return_counts=True)
            total = times @ scores[at]
            total = np.exp(total - total.max())
            languages.append(self.languages[int(total.argmax())])
            sure.append(float(total.max() / total.sum()))
        return languages, sure


def word_counts(sample: DataFrame) -> DataFrame:
    """``lang``, ``word`` and ``n`` over ``lang`` and ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(text))
            langs, words = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expectation(model, backwards):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: LanguageModel = model.value
        total = np.zeros_like(m.p)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                k = m.languages.index(lang)
                words, times = rows["word"].tolist(), rows["n"].to_numpy(float)
                for at in by_length(words):
                    total[:, k] += expected([words[j] for j in at], m.pieces, backwards.value, m.p[:, k : k + 1], times[at])
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

    return step


def fit(docs: DataFrame, pieces: dict[str, int], most_fitted: int = MOST_FITTED, rounds: int = ROUNDS) -> LanguageModel:
    """Piece probabilities from ``doc_id``, ``text`` and ``lang`` of the rows whose language is known."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull())
    chosen = known.select("doc_id", "lang").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)))
    # The first of each part of a language, then of the language: what one task ranks is bounded.
    for group in (["lang", "salt"], ["lang"]):
        first = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id")
        chosen = chosen.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most_fitted).drop("place")
    chosen = chosen.select("doc_id", "lang").distinct()
    counts = saved(word_counts(known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")).repartition("word"), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    table = PieceTable(pieces)
    p = np.full((len(pieces) + 2, len(languages)), 1 / (len(pieces) + 1))
    p[-1] = 0
    backwards = spark.sparkContext.broadcast(backward_table(pieces))
    for _ in range(rounds if languages else 0):
        model = spark.sparkContext.broadcast(LanguageModel(languages, table, p))
        got = counts.mapInPandas(_expectation(model, backwards), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros_like(p)
        model.destroy()
        n[got["piece"], got["lang"]] = got["n"]
        n[:-1] += 0.1  # no piece is impossible
        n[-1] = 0
        p = n / n.sum(0)
    backwards.destroy()
    return LanguageModel(languages, table, p)


def predicted(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id") -> DataFrame:
    """The id with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:  # some megabytes of text at a time
                texts, size = [], 0
                for t in batch.column(1).slice(start):
                    texts.append(t.as_py())
                    size += len(texts[-1] or "")
                    if size > 6 * WORDS_AT_ONCE:
                        break
                langs, scores = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_column, "lang_pred", "score"])
                start += len(texts)

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, F.col("text").cast("string")).mapInArrow(predict, f"`{id_column}` {kind}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold_of("doc_id", FOLDS) != HELD), load_pieces())
    rows = predicted(docs, model)
    return rows.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES = {}
