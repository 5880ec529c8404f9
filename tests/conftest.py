from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from gatelens.schema import ACCESS_EVENT  # noqa: E402
from gatelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=2, app="gatelens-tests", memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Access events from ``row`` dicts; ids follow the list order unless given."""

    def build(rows):
        fields = ACCESS_EVENT.fieldNames()
        numbered = [{**r, "event_id": i if r["event_id"] is None else r["event_id"]} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[f] for f in fields) for r in numbered], ACCESS_EVENT)

    return build
