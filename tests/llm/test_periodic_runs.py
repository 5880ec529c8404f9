from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from odd import ODD

from gatelens.llm import periodic_runs as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(s):
    """The longest Lyndon word at each place: a word is one if it is smaller than each of its proper suffixes."""
    n = len(s)
    is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
    return [max(e - i for e in range(i + 1, n + 1) if is_lyndon(s[i:e])) for i in range(n)]


def plain_runs(words, least_length=6, least_periods=4):
    """For each period the maximal stretches, without those that have a smaller period."""
    n, found = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            own = words[i : i + length]
            if length >= max(least_length, least_periods * q) and not any(own[: length - p] == own[p:] for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, s + e)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{e},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequences(seed, count=300):
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.choice((1, 2, 2, 3, 4))
        s = [rng.randrange(letters) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            s += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(2, 6) + s[: rng.randint(0, 9)]
        yield s


def test_lyndon_arrays_by_grouping():
    for s in sequences(1):
        assert m.lyndon_array(s) == plain_lyndon(s)
        assert m.lyndon_array([-x for x in s]) == plain_lyndon([-x for x in s])


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least_length, least_periods", [(6, 4), (2, 2), (1, 3), (9, 2)])
def test_runs_equal_the_plain_version(least_length, least_periods):
    texts = [*sequences(2), fibonacci(120), [0] * 50, [k.bit_count() % 2 for k in range(128)], list(range(50)), [0, 1] * 40 + [2] + [0, 1] * 40]
    ids = np.array([x for s in texts for x in s])
    got = list(zip(*(x.tolist() for x in m.find_runs(ids, np.array([len(s) for s in texts]), least_length, least_periods))))
    assert got == [(k, *r) for k, s in enumerate(texts) for r in plain_runs(s, least_length, least_periods)]


def test_extensions():
    rng = random.Random(3)
    s = np.array([rng.randrange(2) for _ in range(200)] + [0] * 60)
    for longest in (1, 5, 64, 260):
        factors = m.Factors(s, longest)
        pairs = [sorted(rng.sample(range(len(s)), 2)) for _ in range(300)]
        a, b = np.array(pairs).T
        for x, y, ahead, back in zip(a, b, factors.ahead(a, b), factors.back(a, b)):
            assert ahead == next((k for k in range(len(s)) if y + k >= len(s) or s[x + k] != s[y + k]), 0)
            assert back == next(k for k in range(len(s) + 1) if x - k - 1 < 0 or s[x - k - 1] != s[y - k - 1])


def test_a_long_text_takes_linear_steps():
    s = [0, 1, 0, 0, 1] * 30_000
    _, start, length, period = m.find_runs(np.array(s), np.array([len(s)]), 6, 4)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [150_000], [5])


def test_words_that_are_too_rare_cut_a_text():
    ids = np.array([0, 1, 2, 0, 1, 3, 0, 1, 0, 1, 0, 1, 0, 1, 4, 0])
    at, piece = m.pieces(ids, np.array([len(ids)]), 6, 4)
    assert at.tolist() == list(range(6, 14)) and set(piece.tolist()) == {0}


def corpus():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, text(rng.randint(0, 120))) for k in range(150)]
    rows += [(200 + k, f"{text(9)} {' '.join([text(rng.randint(1, 7))] * rng.randint(3, 8))}\n{text(20)}\t{' '.join([text(2)] * 7)}") for k in range(60)]
    return rows + ODD


def test_query_equals_the_plain_version(spark, docs, folder):
    rows = corpus()
    got = [tuple(r) for r in m.op12_periodic_runs(spark, folder(documents=docs(rows))).collect()]
    assert sorted(got, key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 100


def test_words_and_extra_columns(docs):
    table = docs([(1, "x " + "ä b　\x0b" * 5 + " y")]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    row = m.with_runs(table).first()
    assert row.runs == "en" and row.collapsed == "s"
    assert [tuple(r) for r in row.periodic.runs] == [(1, 10, 2)] and row.periodic.collapsed == "x ä b　 y"


def test_empty(spark, docs, folder):
    assert m.op12_periodic_runs(spark, folder(documents=docs([]).limit(0))).collect() == []
