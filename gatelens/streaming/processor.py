"""Keyed state of the detection stream.

The key is a lane, a group of users by hash: Spark's cost per key, of some ten milliseconds, is paid per lane, not per user.
Rows of a lane may arrive in any order within the watermark delay. They wait in state, in sorted parts of an arriving frame,
until the watermark has passed them, and are then taken in ``(ts, event_id)`` order, so the result does not depend on arrival order
or batching as long as no row comes after the watermark has passed it. Parts are merged by their first times: one is read when
all rows before it have been taken, so only rows of parts that overlap in time are held at once. A lane has a timer at the
earliest waiting row of a frame; when the first one fires, all that the watermark has passed is taken in one scan. The processor
only finds what needs history: the event's ordinal, the recent failures, and which rules fire for the first time for their key. Scores
and texts are column expressions on its output.

What is kept per user is bounded: failures of the last ``burst_seconds``, the last minute and day that fired (events
come in time order, so older ones cannot return), and sets limited by the watch lists, resources, countries and hours. With a
time to live, a user's state goes when the watermark has passed the user's last event by that much; a user who comes back
then starts anew.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatelens.config import DEFAULT_POLICY, Policy

MICROS = 1_000_000

# Rows that wait for the watermark, one map entry per part, column by column. ``at`` is the event time in microseconds.
# A part has at most PART_ROWS rows, and a step of the rules takes at most STEP_ROWS.
PART_ROWS, STEP_ROWS = 2_000, 10_000
# So many users' profiles are held at once; they are read when the first of their rows is taken.
PROFILES = 20_000
_COLUMNS = ["event_id", "at", "user_id", "ip_address", "country", "status", "resource"]
_NUMBERS = ("event_id", "at")
_PENDING = (
    "event_id array<long>, at array<long>, user_id array<string>, ip_address array<string>, country array<string>,"
    " status array<string>, resource array<string>"
)

# ``failures`` are the recent failures' times.
_PROFILE = (
    "events long, first_at long, last_at long, fired_minute long, fired_day long, failures array<long>,"
    " countries array<string>, hours array<int>, baseline array<string>, recent array<string>, fired_countries array<string>"
)

OUTPUT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("trailing_failures", T.LongType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("brute_force", T.BooleanType()),
        T.StructField("suspicious_country", T.BooleanType()),
        T.StructField("off_hours", T.BooleanType()),
        T.StructField("compromised_account", T.BooleanType()),
    ]
)


class _Profile:
    """A user's history, while rows are taken."""

    __slots__ = ("events", "first_at", "last_at", "fired_minute", "fired_day", "failures", "countries", "hours", "baseline", "recent", "fired_countries")

    def __init__(self, stored: tuple | None):
        numbers, sets = (stored[:5], stored[5:]) if stored else ((0, None, None, None, None), ((),) * 6)
        self.events, self.first_at, self.last_at, self.fired_minute, self.fired_day = numbers
        self.failures = deque(sets[0])
        self.countries, self.hours, self.baseline, self.recent, self.fired_countries = map(set, sets[1:])

    def stored(self) -> tuple:
        known = [sorted(s - {None}) for s in (self.countries, self.hours, self.baseline, self.recent, self.fired_countries)]
        return self.events, self.first_at, self.last_at, self.fired_minute, self.fired_day, list(self.failures), *known


Rows = dict[str, np.ndarray]


def _in_order(parts: list[Rows]) -> Rows:
    rows = {c: np.concatenate([p[c] for p in parts]) for c in _COLUMNS}
    order = np.lexsort((rows["event_id"], rows["at"]))
    return {c: v[order] for c, v in rows.items()}


def _columns(of) -> Rows:
    """The columns of a frame, or of a stored part given as a dict of lists."""
    out = {}
    for c in _COLUMNS:
        if c in _NUMBERS:
            out[c] = np.asarray(of[c], dtype="int64")
        else:
            out[c] = np.empty(len(of[c]), dtype=object)
            out[c][:] = [v if isinstance(v, str) else None for v in of[c]]
    return out


class DetectionProcessor(StatefulProcessor):
    def __init__(self, policy: Policy = DEFAULT_POLICY, ttl_ms: int | None = None):
        self._policy, self._ttl_ms = policy, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._profile = handle.getMapState("profile", "user_id string", _PROFILE)
        self._pending = handle.getMapState("pending", "first long, part int", _PENDING)
        # With a time to live, the time of the newest row that has come from each user.
        self._newest = handle.getMapState("newest", "user_id string", "at long") if self._ttl_ms is not None else None
        self._settled: dict[tuple, int] = {}

    def _wait(self, rows: Rows) -> None:
        """Keep rows, which are in order, and have a timer at the first one's time."""
        for start in range(0, len(rows["at"]), PART_ROWS):
            own = {c: v[start : start + PART_ROWS].tolist() for c, v in rows.items()}
            key = (own["at"][0], 0)
            while self._pending.containsKey(key):
                key = (key[0], key[1] + 1)
            self._pending.updateValue(key, tuple(own[c] for c in _COLUMNS))
        self._handle.registerTimer(int(rows["at"][0]) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._settled.pop(key, None)
        for batch in rows:
            own = _in_order([_columns(batch)])
            self._wait(own)
            if self._newest is not None:
                for user, at in dict(zip(own["user_id"].tolist(), own["at"].tolist())).items():  # the last of each user
                    if not self._newest.containsKey((user,)) or self._newest.getValue((user,))[0] < at:
                        self._newest.updateValue((user,), (at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed; the lane's first timer that fires does it for all."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self._settled.get(key) == passed:
            return
        waiting = sorted(self._pending.keys())
        held, profiles = _columns({c: [] for c in _COLUMNS}), {}
        for k, part in enumerate(waiting):
            if part[0] >= passed:
                break
            read = _columns(dict(zip(_COLUMNS, self._pending.getValue(part))))
            self._pending.removeKey(part)
            held = _in_order([held, read])
            until = min(waiting[k + 1][0], passed) if k + 1 < len(waiting) else passed
            n = int(np.searchsorted(held["at"], until))
            for start in range(0, n, STEP_ROWS):
                taken = {c: v[start : min(start + STEP_ROWS, n)] for c, v in held.items()}
                if len(profiles) >= PROFILES:
                    self._store(profiles)
                yield self._apply(key, taken, profiles)
            held = {c: v[n:] for c, v in held.items()}
        self._store(profiles)
        if len(held["at"]):
            self._wait(held)
        left = [part for part in waiting if part[0] >= passed]
        if left:
            self._handle.registerTimer(left[0][0] // 1000)
        if self._newest is not None:
            self._forget(passed)
        self._settled[key] = passed

    def _store(self, profiles: dict[str, _Profile]) -> None:
        for user, profile in profiles.items():
            self._profile.updateValue((user,), profile.stored())
        profiles.clear()

    def _forget(self, passed: int) -> None:
        """Let idle users' state go, and have a timer for the next of them. A user with waiting rows isn't idle."""
        gone = [(at // 1000 + self._ttl_ms, user) for (user,), (at,) in list(self._newest.iterator())]
        for at, user in gone:
            if at * 1000 < passed:
                self._newest.removeKey((user,))
                self._profile.removeKey((user,))
        later = [at for at, _ in gone if at * 1000 >= passed]
        if later:
            self._handle.registerTimer(min(later))

    def _apply(self, key: tuple, rows: Rows, profiles: dict[str, _Profile]) -> pd.DataFrame:
        """What each of the rows, which are in order, saw; ``profiles`` holds the users' profiles after the last one."""
        policy, users = self._policy, rows["user_id"].tolist()
        for user in set(users) - profiles.keys():
            profiles[user] = _Profile(self._profile.getValue((user,)) if self._profile.containsKey((user,)) else None)

        at = rows["at"]
        failed = [s == "failed" for s in rows["status"]]
        minute, day, hour = at // (60 * MICROS), at // (86_400 * MICROS), (at // (3_600 * MICROS)) % 24
        late, early_hour = hour >= policy.night_start, hour < policy.night_end
        night = late & early_hour if policy.night_start <= policy.night_end else late | early_hour
        reach, most, baseline_events = policy.burst_seconds * MICROS, policy.stream_burst_over, policy.baseline_events
        watched, sensitive = set(policy.suspicious_countries), set(policy.sensitive_resources)

        found = []
        columns = (users, at, failed, minute, day, hour, night, rows["country"], rows["resource"])
        for user, t, fails, m, d, h, dark, country, resource in zip(*(c if isinstance(c, list) else c.tolist() for c in columns)):
            p = profiles[user]
            p.events += 1
            p.last_at = t
            if p.first_at is None:
                p.first_at = t
            recent = p.failures
            if fails:
                recent.append(t)
            while recent and recent[0] < t - reach:
                recent.popleft()
            burst = abroad = off_hours = new = False
            if len(recent) > most and p.fired_minute != m:
                burst, p.fired_minute = True, m
            early = p.events <= baseline_events
            if resource in sensitive:
                if country in watched and country not in p.fired_countries:
                    abroad = True
                    p.fired_countries.add(country)
                if dark and p.fired_day != d:
                    off_hours, p.fired_day = True, d
                new = not early and resource not in p.baseline and resource not in p.recent
            p.countries.add(country)
            p.hours.add(h)
            (p.baseline if early else p.recent).add(resource)
            found.append((len(recent), p.events, burst, abroad, off_hours, new))
        names = ("trailing_failures", "ordinal", "brute_force", "suspicious_country", "off_hours", "compromised_account")
        return pd.DataFrame(rows | dict(zip(names, zip(*found))))[OUTPUT.fieldNames()]

    def close(self) -> None:
        pass


class FirstAlertProcessor(StatefulProcessor):
    """Passes on the first alert of each user and rule, once for the life of the checkpoint."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sent = handle.getValueState("sent", "sent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            candidates = batch if first is None else pd.concat([first, batch])
            first = candidates.sort_values(["ts", "event_id"], kind="stable").head(1)
        if not self._sent.exists():
            self._sent.update((True,))
            yield first

    def close(self) -> None:
        pass
