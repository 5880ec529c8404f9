from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from odd import ODD, fold

from gatelens.llm import quality_rules as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def plain_base(text):
    """The counts of the contract, one text at a time."""
    text = text or ""
    words = WORD.findall(text)
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside))
    return (*counts, len(words) < 20 or 100 * len(inside) > 30 * len(words))


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def window(ids, k):
    h = k
    for x in ids:
        h = (h * 0x9E3779B97F4A7C15 + x) & M64
    return mix(h)


def plain_logit(model, text):
    """The weighted sum over a text's n-grams, one by one."""
    words = [xxhash.xxh3_64_intdigest(w.encode()) for w in WORD.findall(text or "")]
    chars = [ord(c) for c in text or ""]
    three = lambda x: [x[k : k + 3] for k in range(len(x) - 2)]
    kinds = [words, [window(w, 2) for w in zip(words, words[1:])], [(a == b) + 2 * (b == c) + 4 * (a == c) for a, b, c in three(words)],
             [window(c, 2) for c in zip(chars, chars[1:])], [window(c, 3) for c in three(chars)]]
    z = model.bias
    for kind, grams in enumerate(kinds):
        z += sum(float(model.weights[(mix((g + kind) & M64) >> 48) + kind * m.CELLS]) for g in grams) * m.SCALE / max(1, len(grams))
    return z


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w for w in words for _ in range(3)] if kind == 1 else [w + "###" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    return rows, labels


def tables(spark, docs, folder, rows, labels):
    return folder(documents=docs(rows), labels=spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def model():
    rows, labels = corpus()
    y = np.array([q for _, q in labels])
    return m.fit_model([m.training_row(t.encode()) for _, t in rows], y, np.arange(len(y)) % m.OUT_OF_FOLD, 0.7)


def test_base_counts_and_scores_equal_the_plain_version(spark, docs, model):
    rng = random.Random(5)
    passage = " ".join(f"w{k}" for k in range(9))
    rows = ODD + corpus(60, 8)[0] + [(500, "　wide space one\x0btwo\x0c three\r\nfour\n \nfour\n \nfour"), (501, f"{passage} x {passage} y {passage}"), (502, "a " * 40), (503, "a b " * 40), (504, "# $ <> | && %%%* x\nx\nx \nx")]
    rows += [(600 + k, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 30)))) for k in range(60)]
    got = m.with_rules(docs(rows), model).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[1] is not None)
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: key((r.doc_id, r.text))), sorted(rows, key=key)):
        assert tuple(r.rules[c] for c in (*m.BASE, "base_failed")) == plain_base(text), text
        z = model.slope * plain_logit(model, text) + model.level
        assert r.rules.p_good == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
        assert r.rules.kept == (not r.rules.base_failed and r.rules.p_good >= m.KEPT_FROM)
        assert r.rules.verdict == ("reject" if r.rules.p_good < m.KEPT_FROM else "pass" if r.rules.p_good < m.GOOD_FROM else "good")


def test_training_rows_give_the_same_logit(model):
    for _, text in corpus(20, 9)[0]:
        cells, values = m.training_row(text.encode())
        assert model.weights[cells] @ values + model.bias == pytest.approx(model.logit(m.Texts([text.encode()]))[0], abs=1e-4)


def test_held_out_accuracy_and_calibration(spark, docs, folder):
    rows, labels = corpus(900, 4)
    got = {r.doc_id: r for r in m.op13_quality_rules(spark, tables(spark, docs, folder, rows, labels)).collect()}
    held = [(got[i].score, q) for i, q in labels if fold(i, 5) == 0]
    assert np.mean([(p >= 0.5) == q for p, q in held]) > 0.97
    assert np.mean([(p - q) ** 2 for p, q in held]) < 0.03
    assert abs(np.mean([p for p, _ in held]) - np.mean([q for _, q in held])) < 0.05


def test_probabilities_are_calibrated_where_classes_overlap():
    rng = np.random.default_rng(6)
    y = (rng.random(20_000) < 0.4).astype(float)
    z = rng.standard_normal(20_000) + 2 * y
    p = m.sigmoid(np.column_stack([z, np.ones(len(z))]) @ np.array(m.platt(z, y, np.ones(len(z)))))
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[part].mean()) < 0.04


def test_odd_rows_and_missing_labels(spark, docs, folder):
    for labels, p in (([], 0.5), ([(4, 1)], 0.999), ([(4, 1), (9, None), (None, 0)], 0.999), ([(4, 0), (4, 1)], 0.001)):
        got = m.op13_quality_rules(spark, tables(spark, docs, folder, ODD, labels)).collect()
        assert len(got) == len(ODD) and {round(r.score, 6) for r in got} == {p}
    rows, labels = corpus(150)
    got = m.op13_quality_rules(spark, tables(spark, docs, folder, rows + ODD, labels)).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert m.op13_quality_rules(spark, tables(spark, docs, folder, [], labels)).count() == 0


def test_other_columns_are_passed_on(docs, model):
    table = docs([(1, "one two")]).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept")
    row = m.with_rules(table, model, "rules").first()
    assert row.n_words == "en" and row.kept == "s" and row.rules.n_words == 2
