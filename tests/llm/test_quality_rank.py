from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from odd import ODD, fold

from gatelens.llm import quality_rank as m


def corpus(n=300):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 150))]
        bad = rng.random() < 0.25
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words[:8] for _ in range(12)] if kind == 1 else [w + "###" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    return rows, labels


def tables(spark, docs, folder, rows, labels):
    return folder(documents=docs(rows), labels=spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int"))


def test_held_out_ranking_and_threshold(spark, docs, folder):
    rows, labels = corpus()
    got = {r.doc_id: r for r in m.op5_quality_rank(spark, tables(spark, docs, folder, rows, labels)).collect()}
    assert all(got[i].held_out == (fold(i, 5) == 0) and got[i].predicted == (got[i].score >= 0.3) for i in got)
    held = [(got[i].score, q, got[i].predicted) for i, q in labels if fold(i, 5) == 0]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([p == q for _, q, p in held]) > 0.95


def plain_shape(text):
    """The sixteen features, one by one, on UTF-8 bytes."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    upper, lower = len(re.findall(rb"[A-Z]", data)), len(re.findall(rb"[a-z\x80-\xff]", data))
    symbols = len(re.findall(rb"[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]", data))
    n, size = len(words) or 1, len(data) or 1
    lines = [line for line in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", line)]
    third = len(words) // 3 or 1
    parts = [words[k : k + third] for k in range(0, len(words), third)]
    return [
        math.log(1 + len(words)), sum(len(w) for w in words) / n, upper / ((upper + lower) or 1), symbols / size, len(re.findall(rb"[0-9]", data)) / size,
        math.log(1 + len(set(words))) / math.log(1 + n), sum(words[k] == words[k - 1] for k in range(1, len(words))) / n,
        max((words.count(w) for w in set(words)), default=0) / n, sum(chr(w[-1]) in "!*#$%&|@^~=<>" for w in words) / n, len(lines) / n,
        1 - len(set(lines)) / (len(lines) or 1), max((len(x) for x in lines), default=0) / size, len(zlib.compress(data, 1)) / size,
        sum(w[:1].isupper() for w in words) / n, sum(len(w) > 20 for w in words) / n,
        min((len(set(x)) / third for x in parts if len(x) == third), default=0.0),
    ]


def test_scores_equal_a_plain_sum_over_bins(docs):
    rows, labels = corpus(150)
    values = np.array([m.shape(t.encode()) for _, t in rows])
    ranking = m.fit_ranking(values, np.array([q for _, q in labels]))
    ranking.cut, ranking.scale = 0.7, 1.3
    rows = rows + ODD + [(900, "Line one\n\nLine one\n \nx = 5 %\n"), (901, "a" * 50 + " " + "É" * 30)]
    got = sorted(((r.text or "", r.quality_score) for r in m.with_quality(docs(rows), ranking).collect()), key=str)
    bins, expected = m.BINS, []
    for _, text in rows:
        raw = 0.0
        for f, value in enumerate(plain_shape(text)):
            raw += ranking.weights[f * bins + sum(edge <= value for edge in ranking.edges[f].tolist())]
        expected.append((text or "", 1 / (1 + math.exp(-(1.3 * (raw - 0.7) + math.log(0.3 / 0.7))))))
    for (text, score), (other, plain) in zip(got, sorted(expected, key=str)):
        assert text == other and abs(score - plain) < 1e-5, text[:80]


def test_pairs_set_the_order_not_the_level():
    """Bradley-Terry sees differences only: a constant feature gets no weight."""
    rng = np.random.default_rng(2)
    better, worse = (np.column_stack([np.ones(500), rng.standard_normal(500) + s, rng.standard_normal(500)]) for s in (1.0, 0.0))
    w = m.bradley_terry(better, worse)
    assert abs(w[0]) < 1e-9 and w[1] > 0.5 and abs(w[2]) < 0.3
    chance = 1 / (1 + np.exp(-(better - worse) @ w))
    assert chance.mean() > 0.6


def test_threshold_is_the_quantile_of_the_share_of_bad_documents():
    rng = np.random.default_rng(1)
    values = rng.standard_normal((400, len(m.NAMES)))
    good = (rng.random(400) < 0.8).astype(int)
    ranking = m.fit_ranking(values, good)
    assert abs(np.mean(ranking.quality(values) < m.CUT) - np.mean(good == 0)) < 0.02


def test_odd_rows_and_missing_labels(spark, docs, folder):
    for labels in ([], [(4, 1)], [(4, 1), (9, None)]):
        got = m.op5_quality_rank(spark, tables(spark, docs, folder, ODD, labels)).collect()
        assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    rows, labels = corpus(120)
    got = m.op5_quality_rank(spark, tables(spark, docs, folder, rows + ODD, labels)).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert m.op5_quality_rank(spark, tables(spark, docs, folder, [], labels)).count() == 0


def test_ids_and_labels_are_no_features(spark, docs, folder):
    rows, labels = corpus(150)
    base = {r.doc_id: r.score for r in m.op5_quality_rank(spark, tables(spark, docs, folder, rows, labels)).collect()}
    twin = [(10_000, rows[0][1], "xx", "other")]
    assert {r.doc_id: r.score for r in m.op5_quality_rank(spark, tables(spark, docs, folder, rows + twin, labels)).collect()}[10_000] == base[0]
