from __future__ import annotations

import random

import numpy as np
import pytest
from odd import ODD, fold

from gatelens.llm import language_id as m

ENDS = {"aa": ["tion", "ment", "ing"], "bb": ["keit", "ung", "sch"], "cc": ["ción", "dad", "ez"]}


def corpus(n=240):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        lang = rng.choice(list(ENDS))
        rows.append((k, " ".join(rng.choice(["re", "an", "to", "ma"]) + rng.choice(ENDS[lang]) for _ in range(rng.randint(2, 30))).capitalize() + ".", lang))
    return rows


def segmentations(word, longest=16):
    if not word:
        yield ()
    for k in range(1, min(longest, len(word)) + 1):
        for rest in segmentations(word[k:]):
            yield (word[:k], *rest)


@pytest.fixture(scope="module")
def small():
    pieces = {p: k for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab"])}
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces) + 2, 2))
    p[-1] = 0
    return pieces, p / p.sum(0)


def chance(parts, pieces, p):
    """0 for a part that is neither a piece nor one unknown letter."""
    out = np.ones(p.shape[1])
    for part in parts:
        out = out * (p[pieces[part]] if part in pieces else p[-2] if len(part) == 1 else 0)
    return out


def total(word, pieces, p):
    """The sum over all segmentations, by the last part."""
    sums = [np.ones(p.shape[1])]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[start] * chance([word[start:end]], pieces, p) for start in range(end)))
    return sums[-1]


def test_forward_sums_all_segmentations(small):
    pieces, p = small
    for word in ("▁abab", "▁bba", "▁axb", "▁"):
        every = sum(chance(s, pieces, p) for s in segmentations(word))
        assert np.allclose(np.exp(m.passed(m._codes([word]), m.PieceTable(pieces), p)[0]), every)
        assert np.allclose(total(word, pieces, p), every)


@pytest.mark.parametrize("places", [m.PLACES, 40])
def test_long_pieces_and_whole_words(monkeypatch, places):
    """Words of more letters, and pieces of more, than are scaled or held at a time."""
    monkeypatch.setattr(m, "PLACES", places)
    pieces = {q: k for k, q in enumerate(["a", "b", "▁", "ab", "bbabbabbabbabbab", "abbabbabbabb", "▁abbabbabbab", "babbabba"])}
    rng = np.random.default_rng(8)
    p = rng.random((len(pieces) + 2, 3))
    p[-1] = 0
    p /= p.sum(0)
    words = ["▁" + "abb" * 13, "▁" + "bba" * 13, "▁" + "ab" * 19 + "x"]
    got = np.exp(m.passed(m._codes(words), m.PieceTable(pieces), p))
    assert np.allclose(got, [total(w, pieces, p) for w in words], rtol=1e-9)
    # Without the long pieces, the sum is another one.
    short = {q: k for q, k in pieces.items() if len(q) < 8}
    assert not np.allclose(got[0], total(words[0], short, p), rtol=1e-3)


def test_very_long_word_does_not_underflow(small):
    pieces, p = small
    one, two = (m.passed(m._codes(["▁" + "ab" * k]), m.PieceTable(pieces), p)[0] for k in (3000, 6000))
    assert np.isfinite(two).all() and np.allclose(two / one, 2, rtol=1e-2)


@pytest.mark.parametrize("places", [m.PLACES, 30])
def test_expected_counts(small, monkeypatch, places):
    monkeypatch.setattr(m, "PLACES", places)
    pieces, p = small
    words, times = ["▁ababxbababba", "▁abbabbabbabb"], np.array([2.0, 3.0])
    count = np.zeros(len(p))
    for word, n in zip(words, times):
        all_ = [(s, c) for s in segmentations(word, 3) if (c := chance(s, pieces, p)[0])]
        whole = sum(c for _, c in all_)
        for s, c in all_:
            for part in s:
                count[pieces.get(part, len(pieces))] += n * c / whole
    assert np.allclose(m.expected(words, m.PieceTable(pieces), m.backward_table(pieces), p[:, :1], times)[:-1], count[:-1])


def test_held_out_accuracy_and_learning_rows(spark, docs, folder):
    rows = corpus()
    got = {r.doc_id: r for r in m.op9_language_id(spark, folder(documents=docs(rows))).collect()}
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.95
    # A language that only held-out rows have isn't learned.
    other = [(i, t, "zz" if fold(i, 5) == 0 else lang) for i, t, lang in rows]
    assert "zz" not in {r.lang_pred for r in m.op9_language_id(spark, folder(documents=docs(other))).collect()}


def test_odd_rows(spark, docs, folder):
    rows = corpus(90) + [(900 + k, t, lang) for k, (t, lang) in enumerate([(None, "aa"), ("", "aa"), ("123 ... 4_5", "bb"), ("² ½", "aa"), ("x" * 100_000, None), ("漢字", None)])] + [(i, t, None) for i, t in ODD]
    got = {r.doc_id: r for r in m.op9_language_id(spark, folder(documents=docs(rows))).collect()}
    assert all(got[900 + k].lang_pred == "und" and got[900 + k].score == 0 for k in range(4))
    assert all(got[900 + k].lang_pred in ENDS for k in (4, 5))


def test_nothing_to_learn(spark, docs, folder):
    got = m.op9_language_id(spark, folder(documents=docs([(k, "some words", None) for k in range(6)]))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert m.op9_language_id(spark, folder(documents=docs([]).limit(0))).count() == 0


def test_vocabulary():
    pieces = m.load_pieces()
    assert m.PieceTable(pieces).longest == max(map(len, pieces)) > 8
    assert 25_000 < len(pieces) <= 32_000 and sorted(pieces.values()) == list(range(len(pieces))) and "▁the" in pieces
