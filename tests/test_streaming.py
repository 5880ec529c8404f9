"""The streaming jobs give what the window form gives, whatever the arrival order and batching."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from events import row
from pyspark.sql import functions as F
from test_stream_rules import random_log

from gatelens.plans import batch_rules, feed, outbox, stream_rules
from gatelens.plans.enrichment import enrich
from gatelens.schema import ACCESS_EVENT
from gatelens.session import run_dir
from gatelens.streaming import jobs, replay
from gatelens.streaming import processor as processing
from gatelens.streaming.processor import DetectionProcessor


@pytest.fixture(scope="module")
def log():
    return random_log(11, 450)


def write_files(spark, frame, parts):
    """One file per part, in arrival order."""
    folder = run_dir(spark, "input")
    for part in parts:
        frame(part).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def run(spark, frame, log):
    """A detection run over four files whose rows are shuffled across files within a day."""
    rows = random.Random(3).sample(log, len(log))
    folder = write_files(spark, frame, [rows[i::4] for i in range(4)])
    return replay.run_detection(spark, replay.log_stream(folder, max_files=1), delay="3 days")


def same(a, b):
    columns = sorted(a.columns)
    key = lambda r: str(tuple(r))
    return sorted(a.select(columns).collect(), key=key) == sorted(b.select(columns).collect(), key=key)


def test_shuffled_files_give_the_window_form(spark, frame, run, log):
    assert same(replay.scored_table(spark, run), stream_rules.detect(frame(log)))


def test_state_holds_the_whole_history(spark, run, log):
    state = {r.user_id: r for r in replay.user_state(spark, run).collect()}
    for user in {r["user_id"] for r in log}:
        own = sorted((r for r in log if r["user_id"] == user), key=lambda r: (r["ts"], r["event_id"]))
        assert state[user].events == len(own)
        assert (state[user].first_event, state[user].last_event) == (own[0]["ts"], own[-1]["ts"])
        assert state[user].baseline == ",".join(sorted({r["resource"] for r in own[:50]}))
        assert state[user].recent == ",".join(sorted({r["resource"] for r in own[50:]}))
        assert state[user].hours == ",".join(str(h) for h in sorted({r["ts"].hour for r in own}))


@pytest.mark.parametrize("delay", ["3 days", "1 minute"])
def test_feed_equals_window_form_under_any_admission(spark, frame, log, delay):
    """A file per batch, several state partitions; shuffled files with a long delay, ordered ones with a short one."""
    rows = random.Random(3).sample(log, len(log)) if delay == "3 days" else sorted(log, key=lambda r: (r["ts"], r["event_id"]))
    folder = write_files(spark, frame, [rows[i::4] for i in range(4)] if delay == "3 days" else [rows[i * 150 : (i + 1) * 150] for i in range(3)])
    got = replay.run_feed(spark, replay.log_stream(folder, max_files=1), "analyst", delay=delay)
    assert same(got, feed.feed_json(stream_rules.detect(frame(log)), "analyst"))


def test_builtin_dedup_gives_each_key_once(spark, run, log):
    """Equal to the keys of the alerts that fired; and with a short span a key comes again after it."""
    scored = replay.scored_table(spark, run)
    got = [tuple(r) for r in replay.run_alert_keys(spark, run).collect()]
    fired = stream_rules.fired_alerts(scored).select("user_id", "alert_type").collect()
    assert len(got) == len(set(got)) == len(fired) > 0
    assert sorted(r[:2] for r in got) == sorted(map(tuple, fired))
    assert set(got) == {tuple(r) for r in stream_rules.alert_candidates(scored).select("user_id", "alert_type", "key").collect()}
    session, out = jobs.job_session(spark), run_dir(spark, "keys")
    ordered = run_dir(spark, "ordered")
    for k in range(5):  # the same events in five months; a key goes in the batch after the one that moved the watermark past it
        scored.withColumn("ts", F.col("ts") + F.make_interval(months=F.lit(k))).coalesce(1).write.mode("append").parquet(ordered)
    stream = session.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(ordered)
    replay.finish(jobs.to_files(jobs.alert_keys(stream, span="8 days"), f"{out}/keys", f"{out}/checkpoint"))
    again = [tuple(r) for r in spark.read.parquet(f"{out}/keys").collect()]
    assert len(again) > len(set(again)) and set(got) <= set(again)


def test_outbox_equals_window_form(spark, frame, run, log):
    expected = outbox.notification_outbox(stream_rules.stream_alerts(frame(log)))
    assert expected.count() > 0
    assert same(replay.run_outbox(spark, run), expected)


def test_hourly_totals_end_at_the_overall_totals(spark, run):
    scored = replay.scored_table(spark, run)
    last = replay.run_hourly_kpis(spark, run).orderBy(F.desc("hour")).first()
    assert last.total_events == scored.count()
    assert last.total_alerts == stream_rules.fired_alerts(scored).count()


def test_outbox_remembers_over_batches_and_runs(spark, frame, log):
    """A restart adds nothing; a new checkpoint keeps the first run's rows and notifies only what no run has."""
    ordered = sorted(log, key=lambda r: (r["ts"], r["event_id"]))
    folder = write_files(spark, frame, [ordered[i * 150 : (i + 1) * 150] for i in range(3)])
    run = replay.run_detection(spark, replay.log_stream(folder, max_files=1), delay="1 minute")
    scored = replay.scored_table(spark, run)
    assert same(scored, stream_rules.detect(frame(log)))

    session = jobs.job_session(spark)
    out = run_dir(spark, "sinks")
    half = run_dir(spark, "half")
    scored.filter(F.col("ts") < ordered[220]["ts"]).write.parquet(half)

    def sent(source, checkpoint):
        stream = session.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(source)
        replay.finish(jobs.write_outbox(stream_rules.fired_alerts(stream), f"{out}/outbox", f"{out}/{checkpoint}"))
        return sorted(tuple(r) for r in jobs.stored(spark, f"{out}/outbox", jobs.OUTBOX).select("run", "user_id", "alert_type", "event_id").collect())

    first = sent(half, "one")
    assert len(first) == len({r[1:3] for r in first}) > 0
    assert sent(half, "one") == first
    both = sent(f"{run}/scored", "two")
    assert set(first) <= set(both) and len(both) == len({r[1:3] for r in both})
    everything = outbox.notification_outbox(stream_rules.stream_alerts(frame(log))).select("user_id", "alert_type").collect()
    assert {r[1:3] for r in both} == {tuple(r) for r in everything}


def test_late_rows_are_left_out_counted_and_found(spark, frame):
    """Newest file first, over more than a hundred batches: rows out and late rows make up the rows in."""
    rows = [row(f"2024-03-04 {10 + h:02d}:{m:02d}:00") for h in range(12) for m in range(0, 60, 6)]
    rows = [{**r, "event_id": i} for i, r in enumerate(rows)]
    folder = write_files(spark, frame, [[r] for r in reversed(rows)])
    stream = replay.log_stream(folder, max_files=1)
    with pytest.raises(replay.LateEvents):
        replay.run_detection(spark, replay.log_stream(folder, max_files=40))
    run = replay.run_detection(spark, stream, allow_late=True)
    scored = replay.scored_table(spark, run)
    late = replay.late_events(frame(rows), scored)
    assert scored.count() + late.count() == len(rows) and late.count() > 100


class FakeState(dict):
    """The map and value states of a processor, kept in memory."""

    def getValue(self, key):
        return self[key]

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def get(self):
        return self.setdefault("value", None)

    def update(self, value):
        self["value"] = value


@pytest.mark.parametrize("part_rows, step_rows", [(3, 5), (2_000, 10_000)])
def test_a_step_handles_a_bounded_number_of_rows_in_order(log, monkeypatch, part_rows, step_rows):
    monkeypatch.setattr(processing, "PART_ROWS", part_rows)
    monkeypatch.setattr(processing, "STEP_ROWS", step_rows)
    taken, timers = [], set()

    class Watched(DetectionProcessor):
        def _apply(self, user_id, rows, profile):
            taken.append(len(rows["at"]))
            return super()._apply(user_id, rows, profile)

    processor = Watched()
    handle = SimpleNamespace(getValueState=lambda *a: FakeState(), getMapState=lambda *a: FakeState(), registerTimer=timers.add)
    processor.init(handle)
    own = [r for r in log if r["user_id"] == log[0]["user_id"]]
    micros = lambda r: int((r["ts"] - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    frame = pd.DataFrame([{**r, "at": micros(r)} for r in random.Random(1).sample(own, len(own))])
    for part in (frame[: len(frame) // 2], frame[len(frame) // 2 :]):
        list(processor.handleInputRows((log[0]["user_id"],), iter([part]), None))
    assert len(timers) <= 2  # one for each arriving frame
    out = []
    middle = sorted(frame["at"])[len(frame) // 2] // 1000
    for now in (middle, middle, 10**14):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
        out += processor.handleExpiredTimer((log[0]["user_id"],), clock, None)
        assert sum(map(len, out)) == (frame["at"] < now * 1000).sum()
        assert processor._pending or now == 10**14
    out = pd.concat(out)
    assert max(taken) <= step_rows
    assert out["ordinal"].tolist() == list(range(1, len(own) + 1)) and out["at"].is_monotonic_increasing
    assert not processor._pending


def test_a_lane_of_many_users_costs_a_part_and_a_timer(log):
    """State calls and frames are per lane, not per user; each user has a history of its own."""
    pending, timers = FakeState(), []
    maps = {"pending": pending, "profile": FakeState()}
    handle = SimpleNamespace(getValueState=lambda *a: FakeState(), getMapState=lambda name, *a: maps[name], registerTimer=timers.append)
    processor = DetectionProcessor()
    processor.init(handle)
    users = [None] + [f"u{k}" for k in range(299)]
    rows = [{**r, "user_id": u, "event_id": i * 300 + k, "at": i * 90_000_000} for i, r in enumerate(log[:5]) for k, u in enumerate(users)]
    list(processor.handleInputRows((7,), iter([pd.DataFrame(random.Random(2).sample(rows, len(rows)))]), None))
    assert len(pending) == len(timers) == 1
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**12)
    out = list(processor.handleExpiredTimer((7,), clock, None)) + list(processor.handleExpiredTimer((7,), clock, None))
    assert len(out) == 1 and len(out[0]) == len(rows) and not pending
    found = {(r.user_id or "", r.event_id): r.ordinal for r in out[0].itertuples()}
    assert found == {(r["user_id"] or "", r["event_id"]): r["event_id"] // 300 + 1 for r in rows}
    assert {u for (u,) in maps["profile"]} == set(users)


def test_null_ids_and_users_take_part(spark, frame, log):
    """An event without an id leaves the other ids of its lane alone, large ones included."""
    rows = [{**r, "event_id": (1 << 60) + i, "user_id": None if i % 7 == 0 else r["user_id"]} for i, r in enumerate(log[:60])]
    events = frame(rows).withColumn("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id")))
    folder = run_dir(spark, "input")
    events.coalesce(1).write.parquet(folder)
    scored = replay.scored_table(spark, replay.run_detection(spark, replay.log_stream(folder)))
    assert same(scored.select("event_id", "ts", "user_id", "ip_address", "status"), events.select("event_id", "ts", "user_id", "ip_address", "status"))


def days_of(users):
    """Events at noon of the given days of March."""
    rows = [row(f"2024-03-{d:02d} 12:{m:02d}:00", user=u, resource="billing") for u, days in users.items() for d in days for m in (0, 20, 40)]
    return [{**r, "event_id": i} for i, r in enumerate(sorted(rows, key=lambda r: (r["ts"], r["user_id"])))]


def test_idle_users_lose_their_state_and_active_ones_keep_it(spark, frame):
    """Batches in time order, without a closing row: the watermark ends at the last day less the delay."""
    rows = days_of({"idle": [1], "active": range(1, 13), "back": [1, 11]})
    folder = write_files(spark, frame, [[r for r in rows if r["ts"].day == d] for d in range(1, 13)])
    session = jobs.job_session(spark)

    def run(name, **more):
        out = run_dir(spark, name)
        stream = replay.log_stream(folder, max_files=1)(session)
        replay.finish(jobs.to_files(jobs.detect(stream, delay="1 minute", **more), f"{out}/scored", f"{out}/scored-checkpoint"))
        rows = replay.scored_table(spark, out).select("user_id", "event_id", "ordinal", "compromised_account", "score").collect()
        return {r.event_id: r for r in rows}, {r.user_id: r.events for r in replay.user_state(spark, out).collect()}

    kept, all_state = run("kept")
    got, state = run("ttl", idle_ttl=timedelta(days=3))
    assert set(all_state) == {"idle", "active", "back"}
    assert set(state) == {"active", "back"}
    assert [got[i] for i in got if got[i].user_id == "active"] == [kept[i] for i in got if kept[i].user_id == "active"]
    assert got.keys() == kept.keys()
    back = [r for r in got.values() if r.user_id == "back"]
    assert sorted(r.ordinal for r in back) == [1, 1, 2, 2, 3, 3]  # anew after ten days


def test_slow_brute_force_equals_batch(spark, frame):
    rows = [row(f"2024-03-0{d} {h:02d}:{m:02d}:00", "failed", user=f"u{d % 2}") for d in (1, 2, 3) for h in range(8) for m in (0, 7, 9)]
    events = frame(rows)
    folder = run_dir(spark, "input")
    events.write.parquet(folder)
    got = replay.run_slow_brute_force(spark, replay.log_stream(folder))
    assert got.count() == 3
    assert same(got, batch_rules.slow_brute_force(events))


def test_alert_stream_can_be_enriched(spark, run):
    session, out = jobs.job_session(spark), run_dir(spark, "enriched")
    stored = replay.scored_table(session, run)
    stream = session.readStream.schema(stored.schema).parquet(f"{run}/scored")
    enriched = enrich(stream_rules.fired_alerts(stream), keep=("event_id",))
    replay.finish(jobs.to_files(enriched, f"{out}/alerts", f"{out}/checkpoint"))
    assert same(spark.read.parquet(f"{out}/alerts"), enrich(stream_rules.fired_alerts(stored), keep=("event_id",)))


def test_event_stream_passes_rows_through(spark, frame, log):
    folder = write_files(spark, frame, [log])
    assert same(replay.run_stream_events(spark, replay.log_stream(folder)), frame(log))
    assert replay.log_stream(folder)(spark).schema == ACCESS_EVENT
