from __future__ import annotations

import numpy as np

from gatelens.llm import nn_descent as m

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, wanted=5, every=50):
    """All pairs, in double precision on 32-bit vectors."""
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float32).astype(float)
    norm = np.sqrt((v * v).sum(1))
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = v @ v[k] / (norm * norm[k])
        order = [j for j in np.lexsort((ids, -s)) if j != k][:wanted]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 16))
    rows = [(k, centers[k % 12] + 0.7 * rng.standard_normal(16)) for k in range(1500)]
    expected, got = plain(rows), found(m.nearest(table(spark, rows)))
    assert set(got) == set(expected)
    hits = [i for q in expected for i, _ in expected[q] if i in dict(got[q])]
    assert len(hits) >= 0.95 * 5 * len(expected)
    scores = {q: dict(x) for q, x in plain(rows, wanted=1500).items()}
    assert all(abs(scores[q][i] - s) < 1e-12 for q in got for i, s in got[q])


def test_rounds_improve_the_graph(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 24)).astype(np.float32)
    nodes = m.saved(m.nodes_of(m.usable(table(spark, list(enumerate(v))), "vec_id", "embedding")), "nodes")
    first = m.saved(m.first_graph(nodes), "graph")
    mean = lambda g: g.agg({"score": "avg"}).first()[0]
    assert mean(m.neighbour_graph(nodes)) > mean(first)


def test_equal_vectors_ties_go_by_id(spark):
    rows = [(k, [1.0, 2.0]) for k in range(200, 0, -1)] + [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (350, [-1.0, 0.5])]
    got = found(m.nearest(table(spark, rows)))
    assert [i for i, _ in got[50]] == [1, 2, 3, 4, 5] and [i for i, _ in got[300]] == [1, 2, 3, 4, 5]
    assert len({s for _, s in got[50]}) == 1


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1, 0, 0]), (50, [0, 1, 0]), (1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 0]), (5, [float("nan"), 1, 0]), (6, [float("inf"), 1, 0]), (7, [1, 1]), (None, [1, 1, 1]), (100, [0, 0, 0]), (8, [1, 1, 0]), (8, [1, 1, 0])]
    got = found(m.nearest(table(spark, rows)))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {0: [8, 50], 50: [8, 0]}


def test_few_and_no_rows(spark):
    assert found(m.nearest(table(spark, [(0, [1, 2])]))) == {}
    assert found(m.nearest(table(spark, []))) == {}


def test_query(spark, folder):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(8)) for k in range(120)]
    got = found(m.op3_nn_descent(spark, folder(embeddings=table(spark, rows))))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in plain(rows).items()}
