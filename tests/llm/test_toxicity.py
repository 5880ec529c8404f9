from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd import ODD, fold
from pyspark.sql import functions as F

from gatelens.llm import toxicity as m


@pytest.fixture(scope="module")
def corpus():
    """Insults of two kinds in random prose; the second category needs the first and a word of its own."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        rude, threat = rng.random() < 0.3, False
        if rude:
            text[rng.randrange(len(text))] = rng.choice(["scoundrel", "nitwit"]) + rng.choice(["", "ly", "s"])
            if threat := rng.random() < 0.5:
                text.append("beware")
        elif rng.random() < 0.2:
            text.append("beware")
        rows.append((k, " ".join(text)))
        labels.append((k, int(rude), int(threat)))
    return rows, labels


@pytest.fixture(scope="module")
def chain(spark, docs, corpus):
    rows, labels = corpus
    known = spark.createDataFrame(labels, "doc_id long, rude int, threat int")
    sample = docs(rows).join(known.filter("doc_id % 5 <> 0"), "doc_id")
    return m.fit(sample, ("rude", "threat"))


def plain_probabilities(chain, text):
    """The chain, one document and one feature at a time."""
    words = set(re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda c: c[0].lower(), (text or "").encode())))
    parts = [b"w" + w for w in words] + [str(n).encode() + w[:n] for w in words for n in (4, 5, 6, 7) if len(w) >= n]
    cells = Counter(xxhash.xxh3_64_intdigest(x) % 2**m.BITS for x in parts)
    logits = []
    for model in chain.models:
        z = model.bias + sum(float(model.weights[c]) * math.log2(1 + n) for c, n in cells.items()) + sum(x * w for x, w in zip(logits, model.chained))
        logits.append(min(8, max(-8, z)))
    return [1 / (1 + math.exp(-z)) for z in logits]


def test_rows_equal_a_plain_chain(docs, corpus, chain):
    rows = corpus[0][:150] + ODD + [(800, "Nitwit! BEWARE, scoundrel-ly; ünïcödé scoundrels 123 beware")]
    got = sorted(((r.text or "", r.t.p_rude, r.t.p_threat, r.t.rude, r.t.threat) for r in m.with_toxicity(docs(rows), chain, "t").collect()), key=lambda r: r[0])
    expected = sorted(((text or "", *plain_probabilities(chain, text)) for _, text in rows), key=lambda r: r[0])
    for (text, p, q, rude, threat), (other, plain_p, plain_q) in zip(got, expected, strict=True):
        assert text == other and p == pytest.approx(plain_p, abs=1e-5) and q == pytest.approx(plain_q, abs=1e-5)
        assert (rude, threat) == (p >= chain.thresholds[0], q >= chain.thresholds[1])


def test_held_out_accuracy(spark, docs, corpus, chain):
    rows, labels = corpus
    got = {r.doc_id: r.t for r in m.with_toxicity(docs(rows), chain, "t").collect()}
    held = [r for r in labels if r[0] % 5 == 0]
    assert np.mean([got[i].rude == rude for i, rude, _ in held]) > 0.95
    assert np.mean([got[i].threat == threat for i, _, threat in held]) > 0.9


def test_a_later_model_uses_the_earlier_probability(chain):
    """``beware`` alone is no threat: its model leans on the first one."""
    assert chain.models[0].chained.shape == (0,) and chain.models[1].chained[0] > 0.1
    rude, alone = (chain.probabilities([m.features(t)])[0] for t in (b"w1 scoundrel w2 beware", b"w1 w3 w2 beware"))
    assert rude[1] > alone[1]


def test_out_of_fold_logits_are_used_in_fitting():
    """With labels at random an in-sample first model would look sure; out of fold it doesn't."""
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 500, 30)).astype(np.int32), None) for _ in range(240)]
    rows = [(c, np.ones(len(c), np.float32)) for c, _ in rows]
    y = rng.integers(0, 2, (240, 2))
    y[:, 1] = y[:, 0]
    made = m.fit_chain(rows, y, ("a", "b"), rng.integers(0, 3, 240))
    assert abs(made.models[1].chained[0]) < 0.5


def test_same_result_on_other_partitions(docs, corpus, chain):
    rows = corpus[0][:100] + ODD
    score = lambda table: sorted((str(r.doc_id), round(r.t.p_threat, 9)) for r in m.with_toxicity(table, chain, "t").collect())
    assert score(docs(rows, 1)) == score(docs(rows, 4))


def test_odd_rows(docs, chain):
    table = docs(ODD).withColumn("toxicity", F.lit("old"))
    rows = m.with_toxicity(table, chain).collect()
    assert len(rows) == len(ODD)
    empty = {r.toxicity.p_rude for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1 and 0 < empty.pop() < 0.5
    assert m.with_toxicity(table.limit(0), chain).count() == 0


def test_one_class_or_no_labels(spark, docs):
    label = lambda rows: docs([(k, "some text") for k in range(4)]).join(spark.createDataFrame(rows, "doc_id long, c int"), "doc_id")
    for rows, high in (([(k, 0) for k in range(4)], False), ([(k, 1) for k in range(4)], True), ([], False), ([(1, None)], False)):
        p = m.fit(label(rows), ("c",)).probabilities([m.features(b"x")])
        assert (p[0, 0] > 0.5) == high


def test_query_learns_from_its_fold_only(spark, docs, corpus, folder):
    rows, labels = corpus
    table = [(i, 1, rude) for i, rude, _ in labels] + [(3, None, None), (None, 1, 1), (10**9, 1, 1)]
    path = folder(documents=docs(rows + ODD[3:5]), labels=spark.createDataFrame(table, "doc_id long, quality int, toxic int"))
    got = [r for r in m.op1_toxicity(spark, path).collect()]
    assert len(got) == len(rows) + 2
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    truth = dict((i, rude) for i, rude, _ in labels)
    assert np.mean([r.toxic == truth[r.doc_id] for r in got if r.held_out]) > 0.9
