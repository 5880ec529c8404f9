from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent)]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from (id, text) or (id, text, lang, source)."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes tables as a test-data folder and returns its path."""

    def build(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, table in tables.items():
            table.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return build


@pytest.fixture
def prose():
    """Random words from a small vocabulary, the same for each test."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))
