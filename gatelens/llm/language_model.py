"""Language-model scoring with a gated recurrent network over a corpus-wide vocabulary.

Documents are dealt to blocks and stored as numbers of their words, so texts are split into words once; blocks send their distinct words' hashes and counts to buckets and get back the
counts over all training documents (see ``tables``). From these counts come the unigram base, the vocabulary (the most
frequent words, as many as the square root of the training words, ``VOCABULARY`` at least) and, for the rest, word shapes: 64
classes by a word's last two bytes, each with its own counts. The network's symbols are the end, the vocabulary and the shapes; a word outside the vocabulary has the probability of its shape times
(c + 1) / (N + V + 1) among the shape's words. Symbols are grouped by frequency into classes for the factored softmax.

The network is fitted by truncated backpropagation in numpy to every training document: blocks are dealt to rounds, in a round each of
its blocks fits a copy to its own training documents, and the copies' weights are averaged, weighted by tokens, on the executors. In scoring, documents run side by side and their states go on from window to window.

Defined cases: null text counts as empty, which is one end token; rows with equal ids are scored each; a null id counts as
empty text for its fold; without training documents N = V = 0 and the network is unfitted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.gru import Gru
from gatelens.llm.tables import BLOCK_BYTES, by_block, dealt_blocks, fold_of, in_blocks, ordered, read_table, saved  # noqa: F401
from gatelens.llm.words import bucket_slices, mixed

FOLDS, HELD = 7, 2
#: The vocabulary and the classes of symbols grow from these on.
VOCABULARY, CLASSES = 959, 32
SHAPES, HIDDEN = 64, 16
#: So many copies' weights are averaged at a time.
SHARDS = 6
#: Each round takes in one of so many shares of the blocks, and so the next round starts from what it has learned.
ROUNDS, EPOCHS = 2, 1

SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("shapes", pa.binary())])
SENT_DDL = "bucket long, block int, keys binary, counts binary, shapes binary"
#: A block's documents and words, as they are stored.
CODES = [("ids", np.int64), ("null", np.bool_), ("held", np.bool_), ("lengths", np.int32), ("words", np.int32), ("keys", np.uint64), ("shapes", np.uint8)]
CODED = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c, _ in CODES)])
CODED_DDL = "block int, ids binary, null binary, held binary, lengths binary, words binary, keys binary, shapes binary"
GOT = pa.schema([("block", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()), ("keys", pa.binary()), ("shapes", pa.binary())])
GOT_DDL = "block int, bucket long, counts binary, keys binary, shapes binary"
#: In place of a block: the row with a bucket's frequent words, and the one with its shapes' totals.
WORDS, TOTALS = -1, -2
MERGED = 16
WEIGHTS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("weights", pa.binary())])
WEIGHTS_DDL = "part long, n long, weights binary"
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def shapes_of(words: np.ndarray) -> np.ndarray:
    """The shapes of words (of one byte or more), by their last two bytes or their only one."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
    last = letters[ends - 1].astype(np.int64)
    endings, number = np.unique(np.where(sizes > 1, letters[np.maximum(ends - 2, 0)] * np.int64(256) + last, -1 - last), return_inverse=True)
    return np.array([zlib.crc32(bytes(divmod(e, 256) if e >= 0 else [-1 - e])) % SHAPES for e in endings.tolist()], np.uint8)[number]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' numbers of words, all their words as numbers, and the distinct words that these count."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))  # at x20 and x09 to x0D, as bytes.split()
    found = lists.flatten().dictionary_encode()
    numbers, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary.cast(pa.binary())
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    kept = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # space at a text's ends leaves empty words there
    own = kept[numbers]
    lengths = np.bincount(text[own], minlength=len(lists))
    return lengths.astype(np.int32), (np.cumsum(kept) - 1).astype(np.int32)[numbers[own]], words.to_numpy(zero_copy_only=False)[kept]


class Block:
    """A block's documents as numbers of its distinct words, with these words' hashes and shapes."""

    def __init__(self, block: int, ids: np.ndarray, null: np.ndarray, held: np.ndarray, lengths: np.ndarray, words: np.ndarray, keys: np.ndarray, shapes: np.ndarray):
        self.block, self.ids, self.null, self.held, self.lengths, self.words, self.keys, self.shapes = block, ids, null, held, lengths, words, keys, shapes

    @classmethod
    def parsed(cls, table: pa.Table) -> Block:
        table = ordered(table)
        ids = table.column("doc_id").to_pylist()
        lengths, numbers, words = words_of(table.column("text").combine_chunks())
        own = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        keys, at, key_of = np.unique(own, return_index=True, return_inverse=True)
        return cls(
            table.column("block")[0].as_py(),
            np.array([0 if i is None else i for i in ids], np.int64),
            np.array([i is None for i in ids], bool),
            np.array([zlib.crc32(b"" if i is None else b"%d" % i) % FOLDS == HELD for i in ids], bool),
            lengths,
            key_of.astype(np.int32)[numbers],
            keys,
            shapes_of(words)[at],
        )

    @classmethod
    def stored(cls, row: dict) -> Block:
        return cls(row["block"], *(np.frombuffer(row[c], kind) for c, kind in CODES))

    def row(self) -> dict:
        return {"block": self.block} | {c: getattr(self, c).tobytes() for c, _ in CODES}

    def docs(self) -> list[np.ndarray]:
        return np.split(self.words, np.cumsum(self.lengths)[:-1])

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.words[np.repeat(~self.held, self.lengths)], minlength=len(self.keys))


def _code(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([Block.parsed(table).row()], schema=CODED)


def _code_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents, which are one block."""
    if own := list(batches):
        yield from _code(pa.Table.from_batches(own)).to_batches()


def _send(block: Block, buckets: int) -> pa.RecordBatch:
    counts = block.training_counts().astype(np.int64)
    rows = [dict(zip(SENT.names, (b, block.block, block.keys[s].tobytes(), counts[s].tobytes(), block.shapes[s].tobytes()))) for b, s in bucket_slices(block.keys, buckets)]
    return pa.RecordBatch.from_pylist(rows, schema=SENT)


def _count(rows: pa.Table, vocabulary: int) -> pa.Table:
    """To each block the counts of its words; and the bucket's frequent words and its shapes' totals."""
    parts = [np.frombuffer(k, np.uint64) for k in rows.column("keys").to_pylist()]
    keys, at, number = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    counts = np.bincount(number, np.concatenate([np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist()])).astype(np.int64)
    shapes = np.concatenate([np.frombuffer(s, np.uint8) for s in rows.column("shapes").to_pylist()])[at]
    ends = np.cumsum([len(p) for p in parts])
    bucket = rows.column("bucket")[0].as_py()
    out = [{"block": b, "bucket": bucket, "counts": counts[number[e - len(p) : e]].tobytes()} for b, e, p in zip(rows.column("block").to_pylist(), ends, parts)]
    totals = np.stack([np.bincount(shapes, counts, SHAPES), np.bincount(shapes, counts > 0, SHAPES)]).astype(np.int64)
    return pa.Table.from_pylist(out + _summary(bucket, keys, counts, shapes, totals, vocabulary), schema=GOT)


def _summary(bucket: int, keys: np.ndarray, counts: np.ndarray, shapes: np.ndarray, totals: np.ndarray, vocabulary: int) -> list[dict]:
    """The most frequent words, ties by hash, in one row, and the shapes' counts and distinct words in another."""
    top = np.lexsort((keys, -counts))[:vocabulary]
    top = top[counts[top] > 0]
    words = {"block": WORDS, "bucket": bucket, "counts": counts[top].tobytes(), "keys": keys[top].tobytes(), "shapes": shapes[top].tobytes()}
    return [words, {"block": TOTALS, "bucket": bucket, "counts": totals.tobytes()}]


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and shapes of several summaries' words, and the sum of their totals."""
    words = [r for r in rows if r["block"] == WORDS]
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in words] or [np.zeros(0, kind)])
    totals = sum((np.frombuffer(r["counts"], np.int64) for r in rows if r["block"] == TOTALS), np.zeros(2 * SHAPES, np.int64))
    return join("keys", np.uint64), join("counts", np.int64), join("shapes", np.uint8), totals.reshape(2, SHAPES)


def _merger(vocabulary: int):
    def merge(rows: pa.Table) -> pa.Table:
        keys, counts, shapes, totals = _unpacked(rows.to_pylist())
        return pa.Table.from_pylist(_summary(0, keys, counts, shapes, totals, vocabulary), schema=GOT)

    return merge


class Symbols:
    """What the network reads and writes: 0 the end, then words and shapes by frequency."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, shape_n: np.ndarray, shape_v: np.ndarray, n_docs: int):
        """``words``: the vocabulary's hashes; ``shape_n``, ``shape_v``: what other training words add up to, by shape."""
        counts = np.r_[word_counts, shape_n]
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        by_hash = np.argsort(words)
        self.words, self.word_symbols, self.shape_symbols = words[by_hash], number[: len(words)][by_hash], number[len(words) :]
        self.counts = np.r_[n_docs, counts[order]]
        self.shape_n, self.shape_v = shape_n, shape_v

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the block's distinct words, and whether the vocabulary holds them."""
        at = np.minimum(np.searchsorted(self.words, block.keys), max(0, len(self.words) - 1))
        known = self.words[at] == block.keys if len(self.words) else np.zeros(len(block.keys), bool)
        symbols = self.shape_symbols[block.shapes]
        symbols[known] = self.word_symbols[at[known]] if known.any() else 0
        return symbols, known


def _with_end(docs: list[np.ndarray], symbols: np.ndarray) -> list[np.ndarray]:
    return [np.append(symbols[d], 0).astype(np.int32) for d in docs]


def vocabulary_size(least: int, n_words: int) -> int:
    return max(least, math.isqrt(n_words))


def _trainer(weights, known, epochs: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights after a block's training documents, and how many tokens these have."""
        for block in _stored(batches):
            docs = _with_end([d for d, held in zip(block.docs(), block.held) if not held], known.value.of(block)[0])
            if docs:
                own = Gru.loaded(weights.value)
                own.train(docs, epochs)
                yield pa.RecordBatch.from_pylist([{"part": block.block, "n": sum(map(len, docs)), "weights": own.dumped()}], schema=WEIGHTS)

    return train


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block.stored(batch.slice(k, 1).to_pylist()[0])


def _averager(parts: int):
    def average(rows: pa.Table) -> pa.Table:
        total, n = {}, rows.column("n").to_pylist()
        for k, data in enumerate(rows.column("weights")):
            for name, w in Gru.loaded(data.as_py()).w.items():
                total[name] = total.get(name, 0) + w.astype(np.float64) * n[k]
        mean = Gru({name: (w / sum(n)).astype(np.float32) for name, w in total.items()})
        return pa.Table.from_pylist([{"part": rows.column("part")[0].as_py() % parts, "n": sum(n), "weights": mean.dumped()}], schema=WEIGHTS)

    return average


def fitted(blocks: DataFrame, n_blocks: int, symbols: Symbols, rounds: int, epochs: int) -> tuple[Gru, int]:
    """The network fitted to the training documents of all blocks (of text, or coded), and the tokens that all rounds took in.

    A round's weights meet in a tree, so that no task holds more than some copies, and the driver one.
    """
    context = blocks.sparkSession.sparkContext
    model, taken = Gru.started(symbols.counts.astype(float), max(CLASSES, math.isqrt(len(symbols.counts))), HIDDEN), 0
    known = context.broadcast(symbols)
    coded = blocks if "words" in blocks.columns else blocks.groupBy("block").applyInArrow(_code, CODED_DDL)
    for k in range(rounds):
        weights = context.broadcast(model.dumped())
        own = coded.filter(F.pmod("block", F.lit(rounds)) == k)
        made = saved(own.mapInArrow(_trainer(weights, known, epochs), WEIGHTS_DDL), "weights")
        left = n_blocks
        while left > 1:
            left = -(-left // max(2, SHARDS))
            made = made.groupBy(F.pmod("part", F.lit(left)).alias("to")).applyInArrow(_averager(left), WEIGHTS_DDL)
        got = made.collect()  # one row at most
        if got:
            model, taken = Gru.loaded(bytes(got[0].weights)), taken + got[0].n
        weights.destroy()
    return model, taken


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per row of ``doc_id`` and ``text``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    spark = docs.sparkSession
    dealt, n_blocks = dealt_blocks(docs, by_id=False)
    coded = by_block(dealt.mapInArrow(_code_partition, CODED_DDL), n_blocks, "coded")
    sent = coded.mapInArrow(_sender(n_blocks), SENT_DDL)
    most = vocabulary_size(vocabulary, n_blocks * BLOCK_BYTES)  # no text has more words than bytes
    got = saved(sent.groupBy("bucket").applyInArrow(_counter(most), GOT_DDL), "counts")

    n_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(fold_of("doc_id", FOLDS) != HELD).count()
    summaries = got.filter("block < 0").groupBy(F.pmod("bucket", F.lit(MERGED)).alias("part")).applyInArrow(_merger(most), GOT_DDL)
    words, counts, shapes, (shape_n, shape_v) = _unpacked([r.asDict() for r in summaries.collect()])  # at most MERGED of each
    train_tokens, distinct = int(shape_n.sum()) + n_docs, int(shape_v.sum()) + (n_docs > 0)
    top = np.lexsort((words, -counts))[: vocabulary_size(vocabulary, int(shape_n.sum()))]
    words, counts, shapes = words[top], counts[top], shapes[top]
    shape_n = shape_n - np.bincount(shapes, counts, SHAPES).astype(np.int64)
    shape_v = shape_v - np.bincount(shapes, minlength=SHAPES)
    symbols = Symbols(words, counts, shape_n, shape_v, n_docs)

    model, _ = fitted(coded, n_blocks, symbols, ROUNDS, EPOCHS)

    scorer = _scorer(spark.sparkContext.broadcast(model.dumped()), spark.sparkContext.broadcast(symbols), train_tokens, distinct, n_docs)
    scores = coded.groupBy("block").cogroup(got.filter("block >= 0").select("block", "bucket", "counts").groupBy("block")).applyInArrow(scorer, SCORES_DDL)
    return scores.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


def _sender(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _stored(batches):
            yield _send(block, buckets)

    return send


def _counter(vocabulary: int):
    def count(rows: pa.Table) -> pa.Table:
        return _count(rows, vocabulary)

    return count


def _scorer(weights, known, train_tokens: int, distinct: int, n_docs: int):
    log_all = math.log10(train_tokens + distinct + 1)
    log_end = math.log10(n_docs + 1) - log_all

    def score(table: pa.Table, counts: pa.Table) -> pa.Table:
        block, symbols, model = Block.stored(table.to_pylist()[0]), known.value, Gru.loaded(weights.value)
        found = sorted(zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist()))
        c = np.concatenate([np.frombuffer(x, np.int64) for _, x in found] or [np.zeros(0, np.int64)])
        of_word, in_vocabulary = symbols.of(block)
        base = np.log10(c + 1) - log_all
        among = np.log10(c + 1) - np.log10(symbols.shape_n + symbols.shape_v + 1)[block.shapes]
        rest = np.where(in_vocabulary, 0.0, among)
        docs = block.docs()
        network = model.score(_with_end(docs, of_word)) / math.log(10)
        return pa.table(
            {
                "doc_id": pa.array(block.ids, mask=block.null),
                "held_out": pa.array(block.held),
                "n_tokens": pa.array([len(d) + 1 for d in docs], pa.int64()),
                "n_known": pa.array([int((c[d] > 0).sum()) + (n_docs > 0) for d in docs], pa.int64()),
                "base_score": pa.array([float(base[d].sum()) + log_end for d in docs], pa.float64()),
                "score": pa.array([float(s + rest[d].sum()) for s, d in zip(network, docs)], pa.float64()),
            }
        )

    return score


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_documents(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_language_model": op8_language_model}
ORACLES = {}
