"""The greedy choice of bursts: piecewise walks against one walk, and their cost."""

import random
from datetime import timedelta

import numpy as np
import pytest
from events import at

from gatelens.config import Policy
from gatelens.operators import bursts, walks

REACH = 120_000_000


def one_walk(times):
    out = []
    for t in times:
        if not out or t > out[-1] + REACH:
            out.append(t)
    return out


def times_of(rng, n, gaps):
    return np.unique(np.cumsum([rng.choice(gaps) for _ in range(n)])).astype(np.int64)


@pytest.mark.parametrize("gaps", [(1_000_000,), (1, 7, 30_000_000), (60_000_000, 120_000_000, 120_000_001), (250_000, 400_000_000)])
def test_functions_compose_like_one_walk(gaps):
    """Slices of 240 s, folded in groups of three and again: what a walk leaves with is the same at every border."""
    rng = random.Random(len(gaps))
    times = times_of(rng, 900, gaps)
    width = 2 * REACH
    slices = [(k, times[(times // width) == k]) for k in range(int(times[-1] // width) + 1)]
    slices = [(k, t) for k, t in slices if len(t)]
    functions = [walks.of_slice(t, k * width, REACH) for k, t in slices]
    came, whole = None, one_walk(times.tolist())
    got = []
    for (k, t), f in zip(slices, functions):
        got += t[walks.taken(t, came, REACH)].tolist()
        came = walks.left_with(f, came, REACH)
        assert came == [w for w in whole if w < (k + 1) * width][-1]
    assert got == whole
    for a in range(0, len(functions) - 6, 5):
        folded = functions[a]
        for f in functions[a + 1 : a + 6]:
            folded = walks.composed(folded, f, REACH)
        begins = slices[a][0] * width
        for came in [None, begins - 1, begins - REACH, begins - REACH // 3]:
            step = came
            for f in functions[a : a + 6]:
                step = walks.left_with(f, step, REACH)
            assert walks.left_with(folded, came, REACH) == step


def test_functions_hold_no_more_than_the_first_stretch():
    """One anchor a second for 20 hours: a function has at most the 121 entries of its first 120 s, at any level."""
    times = np.arange(0, 72_000, dtype=np.int64) * 1_000_000
    hours = [walks.of_slice(times[3600 * k : 3600 * (k + 1)], 3_600_000_000 * k, REACH) for k in range(20)]
    folded = hours[0]
    for f in hours[1:]:
        folded = walks.composed(folded, f, REACH)
        assert len(folded[0]) <= 122
    assert max(len(f[0]) for f in hours) <= 122


def anchors(spark, rows):
    return spark.createDataFrame(rows, "user_id string, ts timestamp_ntz, mark int")


@pytest.mark.parametrize("slice_seconds", [240, 3600])
def test_pick_equals_one_walk(spark, slice_seconds):
    rng, rows, expected = random.Random(5), [], set()
    start = at("2024-01-31 22:00:00")
    for user, gaps in (("dense", (1.0, 0.5)), ("mixed", (20, 100, 120, 120.000001, 3000)), ("sparse", (4000, 90_000)), ("edge", (59.999999, 0.000001))):
        t, last = start, None
        for k in range(700):
            t += timedelta(microseconds=round(rng.choice(gaps) * 1e6))
            rows.append((user, t, k))
            if last is None or t > last + timedelta(seconds=120):
                expected.add((user, t, k))
                last = t
    rng.shuffle(rows)
    got = bursts.pick_bursts(anchors(spark, rows).repartition(4), Policy(slice_seconds=slice_seconds)).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_no_anchors_and_no_null_users(spark):
    assert bursts.pick_bursts(anchors(spark, [])).count() == 0


def test_a_flood_costs_rows_not_their_square():
    """Steps of the passes over one user's two hours at 1, 4 and 16 anchors a second."""
    work = []
    for rate in (1, 4, 16):
        times = np.arange(7200 * rate, dtype=np.int64) * (1_000_000 // rate)
        steps = walks.of_slice(times, 0, REACH)
        work.append((len(times), len(steps[0])))
    assert [n for n, _ in work] == [7200, 28_800, 115_200]
    assert all(entries <= 121 * rate + 1 for (_, entries), rate in zip(work, (1, 4, 16)))


def test_plan_has_no_collected_lists(spark):
    plan = bursts.pick_bursts(anchors(spark, [("u", at("10:00:00"), 1)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
