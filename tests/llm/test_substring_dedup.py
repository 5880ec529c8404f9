from __future__ import annotations

import hashlib
import random

from odd import ODD

from gatelens.llm import substring_dedup as m


def plain(rows, width=20):
    """Windows in order of id, then text; later equal ones are removed."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            piece = tuple(words[k : k + width])
            if piece in seen:
                gone |= set(range(k, k + width))
            seen.add(piece)
        out.append((doc_id, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def found(table):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in m.dedup_substrings(table).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 34, 60, 140)]
    rows = [(k, text(rng.randint(0, 90))) for k in range(40)]
    rows += [(100 + k, f"{text(rng.randint(0, 30))} {rng.choice(shared)} {text(rng.randint(0, 9))}") for k in range(60)]
    return rows + [(300, "r " * 100), (301, "r " * 25 + text(30))] + ODD


def test_every_distance_is_a_difference():
    assert {(a - b) % m.PERIOD for a in m.COVER for b in m.COVER} == set(range(m.PERIOD))


def test_equals_window_by_window(docs):
    rows = corpus(1)
    assert found(docs(rows)) == plain(rows)
    assert sum(r[2] for r in plain(rows)) > 1000


def test_few_and_many_blocks_agree(docs, monkeypatch, spark):
    rows = corpus(2)
    blocks = m.in_blocks
    monkeypatch.setattr(m, "in_blocks", lambda table: blocks(table, 400))
    assert found(docs(rows)) == plain(rows)


def test_empty(docs):
    assert found(docs([]).limit(0)) == []


def test_query(spark, docs, folder):
    rows = corpus(3)[:50]
    got = m.op4_substring_dedup(spark, folder(documents=docs(rows))).collect()
    assert {(r.doc_id, r.kept_sha256) for r in got} == {(r[0], hashlib.sha256(r[3].encode()).hexdigest()) for r in plain(rows)}
