"""The pipeline's stages against plain versions on a small corpus."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from odd import ODD
from pyspark.sql import functions as F

from gatelens.llm import secret_scan, source_mix
from test_ngram_join import plain as plain_components
from test_phrase_index import plain as plain_phrases
from test_secret_scan import plain as plain_secrets

ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "seven small words")]


@pytest.fixture(scope="module")
def tables(spark, docs, folder):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], []
    for k in range(260):
        body, toxic = text(rng.randint(30, 80)), rng.random() < 0.3
        if toxic:
            body[5:5] = [rng.choice(["scoundrel", "nitwit", "dunderhead"]) + e for e in ("", "s", "ly")]
        if k % 9 == 0:
            body += ITEMS[k % 2][1].split()
        if k % 7 == 0:
            body.insert(3, f"password=a1b2c3d4{k}")
        rows.append((k, " ".join(body), "en", f"s{k % 4}"))
        labels.append((k, 1 if k % 11 else 0, int(toxic)))
        if k % 5 == 0:
            copy = list(body)
            copy[-1] = "changed"
            rows.append((1000 + k, " ".join(copy), "en", f"s{k % 3}"))
            labels.append((1000 + k, 1, int(toxic)))
    rows += [(3000 + i if i is not None else None, t, None, None) for i, t in ODD]
    path = folder(
        documents=docs(rows), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    return rows, {i: t for i, _, t in labels}, path


def test_stages(spark, tables):
    rows, toxic, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    before = rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.columns[: len(columns)] == columns
        docs = corpus_pipeline.saved(out, name)
        after = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        if name == "toxicity":
            gone = Counter(before) - Counter(after)
            wrong = sum(toxic.get(r[0], 0) != (gone[r] > 0) for r in before)
            assert wrong <= 0.03 * len(before)
        elif name == "near_duplicates":
            component = {i: c for i, _, c in plain_components([r[:2] for r in before])}
            kept = [r for r in before if r[0] is None or component[r[0]] == r[0]]
            assert Counter(after) == Counter({r: 1 if r[0] is not None else n for r, n in Counter(kept).items()})
        elif name == "decontamination":
            hit = {i for i, _, n, _ in plain_phrases([r[:2] for r in before], ITEMS) if n}
            assert Counter(after) == Counter(r for r in before if r[0] not in hit) and hit
        elif name == "secrets":
            assert len(after) == len(before)
            texts = {r[0]: r[1] for r in before}
            for doc_id, text, *_ in after:
                if doc_id is not None:
                    assert not plain_secrets(text)
                    assert (secret_scan.REPLACEMENT in (text or "")) >= bool(plain_secrets(texts[doc_id]))
        else:
            size = lambda r: len((r[1] or "").encode().split())
            sizes = defaultdict(int)
            for r in before:
                sizes[r[3]] += size(r)
            target = {r.source: r.rate for r in source_mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
            times = Counter(after)
            assert all(math.floor(target[r[3]]) <= times[r] / before.count(r) <= math.ceil(target[r[3]]) for r in before)
        before = after


def texts_after(stage, spark, docs, folder, rows):
    path = folder(documents=docs(rows), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"))
    out = stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert "__key" not in out.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_near_duplicates_are_decided_by_row(spark, docs, folder, prose):
    one, two, three, four, five = (prose(60) for _ in range(5))
    rows = [(1, one), (2, one + " x"), (2, two), (3, three), (3, four), (None, five), (None, five + " x"), (None, two + " y"), (4, None), (4, None)]
    got = texts_after(corpus_pipeline.without_near_duplicates, spark, docs, folder, rows)
    five_kept = [r for r in got if r[1] in (five, five + " x")]
    assert len(five_kept) == 1
    assert sorted(five_kept + [(1, one), (2, two), (3, three), (3, four), (4, None), (4, None)], key=str) == got


def test_near_duplicates_have_five_word_shingles_and_80_percent(spark, docs, folder):
    """80 of 100 shingles in common, 79 of 100, and scattered edits that four words and 0.85 miss."""
    words = [f"a{k}" for k in range(104)]
    other, edited = [f"b{k}" for k in range(104)], [f"c{k}" for k in range(200)]
    edits = [f"edit{k}" if k % 50 == 25 else w for k, w in enumerate(edited)]
    rows = [(k, " ".join(w)) for k, w in enumerate([words, words[:84], other, other[:83], edited, edits])]
    expected = {c for _, _, c in plain_components(rows, 5, 80)}
    assert expected == {0, 2, 3, 4} and len({c for _, _, c in plain_components(rows)}) == 6
    assert texts_after(corpus_pipeline.without_near_duplicates, spark, docs, folder, rows) == sorted((rows[k] for k in expected), key=str)


def test_benchmark_passages_are_decided_by_row(spark, docs, folder, prose):
    clean, other = prose(40), prose(40)
    rows = [(1, clean), (1, other + " " + ITEMS[0][1]), (None, clean + " z"), (None, other + " " + ITEMS[1][1])]
    assert texts_after(corpus_pipeline.without_benchmark, spark, docs, folder, rows) == sorted([rows[0], rows[2]], key=str)


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables[2])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() > 50


def test_clashing_names_are_passed_on(spark, tables, folder):
    """Columns named like those that stages add keep their values, at each stage and in the mix."""
    names = ["copy", "size", "Target", "rate", "copies", "source_size", "__key", "__toxicity", "__gone", "__kept_text", "component_id", "a.b"]
    plain = spark.read.parquet(f"{tables[2]}/documents.parquet").filter("doc_id is not null")
    docs = plain.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    read = lambda name: spark.read.parquet(f"{tables[2]}/{name}.parquet")
    path = folder(documents=docs, benchmark=read("benchmark"), labels=read("labels"))
    out = corpus_pipeline.saved(corpus_pipeline.run(spark, path), "out")
    assert out.columns == [*docs.columns, "copy_"]
    rows = out.collect()
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names) and all(r.copy_ >= 1 for r in rows)
    assert Counter((r.doc_id, r.text, r.copy_) for r in rows) == Counter((r.doc_id, r.text, r["copy"]) for r in corpus_pipeline.run(spark, folder(documents=plain, benchmark=read("benchmark"), labels=read("labels"))).collect())


def test_empty_documents(spark, docs, folder, tables):
    path = folder(documents=docs([]), benchmark=spark.createDataFrame(ITEMS, "item_id long, text string"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, path).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
