from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from odd import ODD
from pyspark.sql.classic.dataframe import DataFrame

from gatelens.llm import ngram_join as m
from gatelens.llm import tables
from gatelens.llm.tables import components, saved

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain(rows, n=4, percent=85):
    """All pairs, then the smallest id of each component."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(LOW).split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted(((r[0], len(s), least.get(root(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets))), key=str)


def found(table):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in m.jaccard_components(table).collect()), key=str)


def corpus(seed, groups=12, copies=14):
    """Groups of near copies: each edits a base, or another copy, in a few places; a line that many documents hold."""
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefghijklmnop") + rng.choice("qrstuv") for _ in range(n)]
    line, rows = text(30), []
    for g in range(groups):
        made = [text(rng.choice([8, 40, 80, 150]))]
        for _ in range(copies):
            copy = list(rng.choice(made))
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["zz", "yy"])
            made.append(copy)
        rows += [(1000 * g + k, " ".join(c + (line if rng.random() < 0.2 else []))) for k, c in enumerate(made)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(docs, seed):
    rows = corpus(seed) + ODD
    expected = plain(rows)
    assert found(docs(rows)) == expected
    assert sum(r[0] != r[2] for r in expected) > 40


def test_split_lists_change_nothing(docs, monkeypatch):
    rows = corpus(3, groups=5, copies=20)
    monkeypatch.setattr(m, "LONG_LIST", 4)
    monkeypatch.setattr(m, "ENTRIES_PER_BUCKET", 100)
    assert found(docs(rows)) == plain(rows)


def test_threshold_is_closed(docs):
    """17 of 20 grams in common link, 16 of 20 don't."""
    base = [f"a{k}" for k in range(23)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:20])), (3, " ".join(base[:19]))]
    assert [r[2] for r in found(docs(rows))] == [1, 1, 1] and [r[2] for r in found(docs([rows[0], rows[2]]))] == [1, 3]


def test_suffix_filter_never_underestimates():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(2))
        assert m.most_common(a, b) >= len(np.intersect1d(a, b))


def test_rare_grams_come_first(docs):
    """The prefix leaves out the grams of a line that all documents hold."""
    counts = np.zeros(1 << m.SKETCH_BITS, np.int64)
    common, own = m.grams(b"c0 c1 c2 c3 c4 c5"), m.grams(b"x0 x1 x2 x3 x4 x5 x6 x7 x8 x9")
    counts[m._cell(common)] = 1000
    h = np.union1d(common, own)
    first = np.lexsort((h, counts[m._cell(h)]))[: m.prefix_length(len(h), 85)]
    assert not np.isin(h[first], common).any()


def test_empty(docs):
    assert found(docs([]).limit(0)) == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(500)] + [(1000, 1000 + k) for k in range(1, 300)] + [(7, 7)]
    random.Random(1).shuffle(links)
    rows = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.component for r in rows} == {0, 1000} and len(rows) == 501 + 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_that_are_stars_need_no_further_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tables, "saved", lambda df, name: made.append(name) or saved(df, name))
    rows = tables.components(spark.createDataFrame([(1, k) for k in range(2, 40)], "a long, b long").coalesce(1)).collect()
    assert {(r.node, r.component) for r in rows} == {(k, 1) for k in range(1, 40)}
    assert made.count("links") == 1


def test_the_driver_gets_parts_of_a_bit_table_and_not_a_row_for_each_set(spark, docs, monkeypatch):
    rows = [(k, f"w{k}") for k in range(3000)] + [(None, "no id")]
    collect, got = DataFrame.collect, []
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: got.append(collect(self)) or got[-1])
    chosen = spark.createDataFrame([(m.set_id(m.grams(t.encode())), i) for i, t in rows if i is None or i % 2], "sid long, doc_id long")
    texts = m.texts_of(docs(rows).select("doc_id", "text"), chosen, m.GRAM)
    assert max(map(len, got)) <= 128
    assert sorted(r.text for r in texts.toLocalIterator()) == sorted(t for i, t in rows if i is None or i % 2)


def test_query(spark, docs, folder):
    rows = corpus(5, groups=3)
    got = m.op7_ngram_join(spark, folder(documents=docs(rows))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows)


def test_a_set_beside_a_group_meets_what_may_link_and_once():
    """Of a group that shares two grams with other sets, only those pairs are made whose range counts leave a link possible."""
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    base = fresh(60)
    sets = [np.r_[base, fresh(40)] for _ in range(200)]
    sets += [np.r_[base, fresh(40)], np.r_[sets[0][:95], fresh(5)]]  # one far from all, one near to the first
    component = [0] * 200 + [200, 201]
    one = pd.DataFrame({"sid": range(202), "size": 100, "component": component, "ranges": [m.range_counts(s).tobytes() for s in sets]})
    one["lists"] = [np.array([3, 1])] * 202
    rows = pd.concat([one.assign(bucket=0, key=key, place=place) for key, place in ((3, 0), (1, 1))])
    assert m._cross_pairs(rows, 80).to_numpy().tolist() == [[0, 201]]
    assert len(m._cross_pairs(rows[rows["key"] == 1], 80)) == 0  # its first list has the pair
    near = {tuple(p) for salt in range(24) for p in m._near_pairs(rows, 80, salt).to_numpy().tolist()}
    assert near == {(0, 201)}
