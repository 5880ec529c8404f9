from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from odd import ODD, fold

from gatelens.llm import gru
from gatelens.llm import language_model as m
from gatelens.llm.gru import Gru, lanes_of

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def corpus(n=150):
    """Sentences in which each word depends on the one before."""
    rng = random.Random(12)
    follows = {w: [f"{c}{k}" for c, k in ((rng.choice("abcd"), rng.randrange(12)) for _ in range(3))] for w in (f"{c}{k}" for c in "abcd" for k in range(12))}
    rows = []
    for k in range(n):
        w, text = "a0", []
        for _ in range(rng.randint(3, 120)):
            text.append(w)
            w = rng.choice(follows[w])
        rows.append((k, " ".join(text) + (f" rare{k}" if k % 3 else "")))
    return rows


def plain(rows):
    words = [(i, (t or "").encode().translate(LOW).split() + ["end"]) for i, t in rows]
    counts = Counter(w for i, ws in words if fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, fold(i, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words), key=str)


def rounded(got):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str)


def test_base_equals_plain_counts_and_the_network_beats_it(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(m, "EPOCHS", 12)
    monkeypatch.setattr(m, "SHARDS", 2)
    rows = corpus()
    got = m.op8_language_model(spark, folder(documents=docs(rows + ODD))).collect()
    assert rounded(got) == plain(rows + ODD)
    held = [r for r in got if r.held_out and r.doc_id in dict(rows)]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_every_training_document_is_learned_from(spark, docs):
    """Turning round the words of training documents leaves all counts as they are, but not what the network learns."""
    rows = [(k, f"a{k % 7} b{k % 5} c{k % 3} d{k % 2} e") for k in range(2200)]
    ids = [r[0] for r in docs(rows).orderBy(m.F.xxhash64("doc_id", m.F.lit("fit")).desc()).select("doc_id").collect()]
    last = [i for i in ids if fold(i, 7) != 2][:60]
    turned = [(k, " ".join(reversed(t.split())) if k in last else t) for k, t in rows]
    one, two = ({r.doc_id: (r.base_score, r.score) for r in m.score_documents(docs(x)).collect()} for x in (rows, turned))
    other = [k for k, _ in rows if k not in last]
    assert all(abs(one[k][0] - two[k][0]) < 1e-9 for k, _ in rows)
    assert sum(abs(one[k][1] - two[k][1]) > 1e-6 for k in other) > 0.9 * len(other)


def test_a_round_takes_in_all_training_tokens(docs):
    rows = corpus(400)
    blocks, n = m.in_blocks(docs(rows), block_bytes=4000)
    symbols = m.Symbols(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(m.SHAPES, np.int64), np.ones(m.SHAPES, np.int64), 1)
    assert n > 2 * m.SHARDS
    assert m.fitted(blocks, n, symbols, 1, 1)[1] == sum(len(t.split()) + 1 for k, t in rows if fold(k, 7) != 2)


def test_the_vocabulary_grows():
    assert m.vocabulary_size(m.VOCABULARY, 1000) == m.VOCABULARY and m.vocabulary_size(m.VOCABULARY, 10**10) == 100_000


def test_no_training_documents(spark, docs, folder):
    only_held = [(k, "some words") for k in range(60) if fold(k, 7) == 2]
    got = m.op8_language_model(spark, folder(documents=docs(only_held))).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(3, 0, 0, 0.0)}
    assert m.op8_language_model(spark, folder(documents=docs([]).limit(0))).count() == 0


@pytest.fixture(scope="module")
def model():
    made = Gru.started(np.arange(1, 21, dtype=float), 4, 5)
    for k in made.w:
        made.w[k] = (made.w[k] * 2).astype(np.float64)
    return made


def test_probabilities_sum_to_one(model):
    h = np.random.default_rng(0).standard_normal((3, 5))
    total = sum(np.exp(model.log_probabilities(h, np.full(3, s))) for s in range(20))
    assert np.allclose(total, 1)


def test_scoring_side_by_side_equals_one_by_one(model):
    """Lanes, windows and restarts don't matter: each document starts from the zero state and keeps its state to its end."""
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 20, n), 0).astype(np.int32) for n in (0, 1, 5, 40, 130, 7, 64)]
    together = model.score(docs, most_lanes=3, window=8)
    for d, expected in zip(docs, together):
        h, total = np.zeros((1, 5)), 0.0
        for before, now in zip(np.r_[0, d[:-1]], d):
            h = model.steps(h, np.array([[before]]), np.array([[False]]))[-1]
            total += model.log_probabilities(h, np.array([now]))[0]
        assert abs(total - expected) < 1e-4


def test_texts_are_split_once(spark, docs):
    """Training and scoring read the stored numbers of the words; coded blocks give the network that blocks of text give."""
    rows = corpus(120) + ODD
    plan = m.score_documents(docs(rows))._jdf.queryExecution().toString()
    assert "words" in plan and "text" not in plan
    blocks, n = m.in_blocks(docs(rows), block_bytes=4000)
    symbols = m.Symbols(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(m.SHAPES, np.int64), np.ones(m.SHAPES, np.int64), 1)
    coded = blocks.groupBy("block").applyInArrow(m._code, m.CODED_DDL)
    (one, taken), (two, of_coded) = m.fitted(blocks, n, symbols, 1, 1), m.fitted(coded, n, symbols, 1, 1)
    assert taken == of_coded and all(np.allclose(one.w[k], two.w[k], atol=1e-4) for k in one.w)


def test_texts_are_not_stored_beside_their_numbers(spark, docs, monkeypatch):
    """Documents go to their blocks and become numbers in one step."""
    kept = []
    stored = m.by_block
    monkeypatch.setattr(m, "by_block", lambda df, n, name: kept.append(df.columns) or stored(df, n, name))
    monkeypatch.setattr(m, "in_blocks", None)
    rows = corpus(60) + ODD
    assert rounded(m.score_documents(docs(rows)).collect()) == plain(rows)
    assert kept == [m.CODED.names]


def test_words_equal_plain_split():
    """Cut at six characters and no other, A-Z in lower case; null and empty texts, space at the ends, one-byte words."""
    texts = [None, "", "   ", " a  b ", "\x0bA\x1cb\x85c d\u2003E \u00c9\x00 x\x1f", "\n\nzz\tZz\r", "\u00e9", "a a\x0ca", "Q"]
    lengths, numbers, words = m.words_of(m.pa.array(texts))
    expected = [(t or "").encode().translate(LOW).split() for t in texts]
    assert lengths.tolist() == [len(w) for w in expected]
    assert [words[k] for k in numbers] == [w for ws in expected for w in ws]
    assert len(set(words)) == len(words)
    assert m.shapes_of(words).tolist() == [m.zlib.crc32(w[-2:]) % m.SHAPES for w in words]
    for none in ([], [None, " "]):
        lengths, numbers, words = m.words_of(m.pa.array(none, m.pa.string()))
        assert lengths.tolist() == [0] * len(none) and len(numbers) == len(words) == len(m.shapes_of(words)) == 0


def test_chunks_change_no_gradient(model, monkeypatch):
    """A class's tokens in one chunk or in several; classes without tokens."""
    rng = np.random.default_rng(6)
    x, y, fresh, own = rng.integers(0, 20, (9, 4)), rng.integers(0, 10, (9, 4)), rng.random((9, 4)) < 0.2, rng.random((9, 4)) < 0.9
    monkeypatch.setattr(gru, "CHUNK", 1000)
    one = model._gradients(np.zeros((4, 5)), x, y, own, fresh)[0]
    monkeypatch.setattr(gru, "CHUNK", 3)
    several = model._gradients(np.zeros((4, 5)), x, y, own, fresh)[0]
    for k, (rows, g) in one.items():
        assert np.array_equal(rows, several[k][0]) and np.allclose(g, several[k][1])


@pytest.mark.parametrize("factor", [1, 300])
def test_chunks_and_large_weights_change_no_probability(factor):
    """Slices of more tokens than a chunk; weights whose exponentials need a shift."""
    made = Gru.started(np.arange(1, 21, dtype=float), 4, 5)
    made.w["class_w"], made.w["word_w"] = made.w["class_w"] * factor, made.w["word_w"] * factor
    rng = np.random.default_rng(4)
    h, y = np.tanh(rng.standard_normal((5000, 5)) * 3).astype(np.float32), rng.integers(0, 20, 5000)
    w = {k: v.astype(np.float64) for k, v in made.w.items()}
    log_softmax = lambda x: x - np.log(np.exp(x).sum(-1, keepdims=True))
    classes, at = log_softmax(h @ w["class_w"] + w["class_b"]), np.arange(5000)
    words = log_softmax(np.einsum("nh,nhk->nk", h, w["word_w"][y // 5]) + w["word_b"][y // 5])
    assert np.allclose(made.log_probabilities(h, y), classes[at, y // 5] + words[at, y % 5], rtol=1e-4, atol=1e-4)


def test_gradients(model):
    rng = np.random.default_rng(2)
    x, y, fresh = rng.integers(0, 20, (6, 3)), rng.integers(0, 20, (6, 3)), rng.random((6, 3)) < 0.2
    h0, own = np.zeros((3, 5)), rng.random((6, 3)) < 0.9

    def loss():
        states = model.steps(h0, x, fresh).reshape(-1, 5)
        return -model.log_probabilities(states[own.ravel()], y.ravel()[own.ravel()]).mean()

    grads = {k: np.zeros(w.shape) for k, w in model.w.items()}
    for k, (rows, g) in model._gradients(h0, x, y, own, fresh)[0].items():
        grads[k][rows] = g
    for k, at in (("inputs", (int(x[1, 1]), 7)), ("state", (2, 11)), ("state", (1, 3)), ("bias", (4,)), ("class_w", (1, 2)), ("word_w", (int(y[0, 0]) // 5, 3, 1)), ("word_b", (2, 2))):
        model.w[k][at] += 1e-3
        up = loss()
        model.w[k][at] -= 2e-3
        down = loss()
        model.w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 3e-3 * max(1, abs(grads[k][at]))


def test_training_learns_a_cycle():
    docs = [np.array([1 + (k + s) % 5 for k in range(30)] + [0], np.int32) for s in range(5)] * 6
    made = Gru.started(np.ones(6), 2, 8)
    before = made.score(docs).sum()
    made.train(docs, 40, lanes=4)
    assert made.score(docs).sum() > before / 4


def test_lanes_are_even():
    lengths = np.array([1000, 3, 500, 400, 90, 10, 900, 2])
    lane, start, used = lanes_of(lengths, 8)
    assert used.sum() == lengths.sum() and used.max() < 2 * 1000 and (np.diff(used) <= 0).all()
    for k in range(len(used)):
        own = np.flatnonzero(lane == k)
        order = own[np.argsort(start[own])]
        assert (start[order] == np.r_[0, np.cumsum(lengths[order])[:-1]]).all()
