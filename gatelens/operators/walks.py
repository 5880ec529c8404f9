"""The greedy walk over a user's anchors, in pieces: what a walk makes of a slice, of a day, of a month.

A walk takes an anchor if it lies more than ``reach`` after the last one taken. What a stretch of time does to a walk is a
function from the last time taken before it to the last time taken in it. It is stored as a step function: ``starts``
(increasing), ``lasts``, and ``rest``. A walk that comes in with the time ``t`` enters at the first start after ``t + reach`` and
leaves with that entry's last; if there is none, it leaves with ``rest``, and if that is None, unchanged. Only the
stretch's first ``reach`` of time has several entries, so a function doesn't grow with the stretch. Times are microseconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

Steps = tuple[np.ndarray, np.ndarray, int | None]


def successors(times: np.ndarray, reach: int) -> np.ndarray:
    """For each of the sorted times, the place of the first one more than ``reach`` later."""
    return np.searchsorted(times, times + reach, side="right")


def of_slice(times: np.ndarray, begins: int, reach: int) -> Steps:
    """The function of a slice that begins at ``begins``, from its sorted times, by one pass from the end."""
    after, last = successors(times, reach), times.copy()
    for i in range(len(times) - 1, -1, -1):
        if after[i] < len(times):
            last[i] = last[after[i]]
    entries = min(len(times), int(np.searchsorted(times, begins + reach, side="right")) + 1)
    return (*_merged(times[:entries], last[:entries]), None)


def _merged(starts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring entries with one last, as the latest of them."""
    keep = np.r_[lasts[1:] != lasts[:-1], True][: len(lasts)]
    return starts[keep], lasts[keep]


def left_with(steps: Steps, came_with: int | None, reach: int) -> int | None:
    """The last time taken after the stretch, of a walk that came with ``came_with`` (None: nothing taken yet)."""
    starts, lasts, rest = steps
    k = 0 if came_with is None else int(np.searchsorted(starts, came_with + reach, side="right"))
    if k < len(starts):
        return int(lasts[k])
    return came_with if rest is None else rest


def composed(first: Steps, second: Steps, reach: int) -> Steps:
    """The function of two stretches one after the other."""
    starts, lasts, rest = first
    lasts = np.array([left_with(second, int(t), reach) for t in lasts], np.int64)
    # Who passes the first stretch unchanged comes from before it, and is at the second one's first entry.
    rest = left_with(second, rest, reach)
    return (*_merged(starts, lasts), rest)


def taken(times: np.ndarray, came_with: int | None, reach: int) -> list[int]:
    """Places of the anchors that a walk takes."""
    after = successors(times, reach)
    i, out = 0 if came_with is None else int(np.searchsorted(times, came_with + reach, side="right")), []
    while i < len(times):
        out.append(i)
        i = int(after[i])
    return out


def micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy("datetime64[us]").astype(np.int64)


def steps_of(row) -> Steps:
    return np.asarray(row.starts, np.int64), np.asarray(row.lasts, np.int64), None if pd.isna(row.rest) else int(row.rest)
