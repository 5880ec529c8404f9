from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from odd import ODD

from gatelens.llm import phrase_index as m

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def plain(docs, items, width=10):
    """Every window of every item against every document."""
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for k in range(max(1, len(p) - width + 1) if p else 0):
                piece = p[k : k + width]
                for s in range(len(w) - len(piece) + 1):
                    if w[s : s + len(piece)] == piece:
                        hit |= set(range(s, s + len(piece)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([25, 12, 10, 3, 1, 11])] + [(10, "Ünï-cödé, 5x"), (11, ""), (12, None), (13, "only?")]
    rows = [(k, text(200)) for k in range(30)]
    rows += [(100 + k, text(15) + " ... " + items[k % 6][1].upper() + "!" + text(8)) for k in range(20)] + [(200, "ünï CÖDÉ 5X"), (201, items[0][1] * 3)]
    return rows + ODD, items


def test_equals_plain_search(spark, docs, corpus):
    rows, items = corpus
    found = m.contamination(docs(rows), items_table(spark, items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found), key=str) == plain(rows, items)
    assert sum(r.n_hit > 0 for r in found) > 20


def test_blocks_of_phrases_and_small_segments_change_nothing(spark, docs, corpus):
    rows, items = corpus
    index = m.build_index(docs(rows), segment_words=50)
    phrases = m.phrases_of(items_table(spark, items))
    place = lambda r: (r.doc_id, r["item"], r.start, r.end, r.exact)
    whole = m.find(m.build_index(docs(rows, 1)), phrases).collect()
    parts = m.find(index, phrases, per_block=4).collect()
    assert sorted(map(place, parts), key=str) == sorted(map(place, whole), key=str)


def test_proximity():
    lists = lambda *x: [(k, np.array(p, np.int32)) for k, p in enumerate(x)]
    starts, off = m.intersect(lists([0, 10, 20], [1, 12, 23], [2, 12, 25]), slop=1)
    assert list(zip(starts.tolist(), off.tolist())) == [(0, 0), (10, 1)]
    assert m.intersect(lists([0, 10], [1, 12]), 0)[0].tolist() == [0]


def test_near_items_have_no_exact_phrase(spark, docs):
    items = items_table(spark, [(1, "one two three four"), (2, "six seven eight")])
    rows = [(1, "one two oops three four"), (2, "one two three four"), (3, "six eight seven"), (4, "nothing")]
    found = {r.doc_id: (list(r["items"]), list(r.near_items)) for r in m.contamination(docs(rows), items, slop=1).collect()}
    assert found == {1: ([], ["1"]), 2: (["1"], []), 3: ([], ["2"]), 4: ([], [])}


def test_items_without_id_count_as_hits(spark, docs):
    items = items_table(spark, [(1, "one two three"), (None, "four five six"), (None, "three four"), (None, None)])
    rows = docs([(1, "x four five six y"), (2, "one two three four five six"), (3, "nothing")])
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in m.contamination(rows, items).collect()} == {1: (3, []), 2: (6, ["1"]), 3: (0, [])}
    phrases = m.phrases_of(items)
    found = m.find(m.build_index(rows), phrases, per_block=1).collect()
    assert sorted((r.doc_id, r["item"] or "", r.start, r.end) for r in found) == [(1, "", 1, 4), (2, "", 2, 4), (2, "", 3, 6), (2, "1", 0, 3)]


def test_phrases_do_not_cross_documents(spark, docs):
    items = items_table(spark, [(1, "left right")])
    rows = docs([(1, "x left"), (2, "right y"), (3, "left right")], 1)
    assert {r.doc_id for r in m.contamination(rows, items).filter("n_hit > 0").collect()} == {3}


def test_empty_tables(spark, docs):
    nothing = docs([]).limit(0)
    assert m.contamination(nothing, items_table(spark, [(1, "a b")])).count() == 0
    assert m.contamination(docs([(1, "a b")]), items_table(spark, [])).collect()[0].n_hit == 0


def test_query_columns(spark, docs, folder):
    path = folder(documents=docs([(1, "a b c"), (2, "c")]), benchmark=items_table(spark, [(7, "b c"), (30, "a b")]))
    rows = {r.doc_id: r for r in m.op2_phrase_index(spark, path).collect()}
    assert rows[1].items_sha256 == hashlib.sha256(b"30,7").hexdigest() and rows[1].n_items == 2 and rows[1].contaminated
    assert rows[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not rows[2].contaminated
