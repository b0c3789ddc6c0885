"""Joins in time, late rows, windows of streams and the state machine against plain versions."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import intervals
from ledgerloom.operators.asof import asof_join
from ledgerloom.plans import temporal
from ledgerloom.sources.storage import new_path
from ledgerloom.streaming import state_machine, windows
from tests.test_catalogue import SF, duck, test_equals_sql  # noqa: F401

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("name", ["restatements", "price_revisions", "outage_events", "version_at_event", "stream_late", "stream_sessions", "stream_sliding", "stream_followed", "stream_jobs"])
def test_queries_equal_sql(spark, duck, name):  # noqa: F811
    test_equals_sql(spark, duck, name)


def spans(seed=1):
    draw = random.Random(seed)
    points = [(i, draw.choice(["a", "b", None]), draw.choice([None, draw.randint(0, 10**6), 500, 500, -(10**6)])) for i in range(300)]
    held = []
    for i in range(120):
        begin = draw.choice([None, draw.randint(-100, 10**6), 500])
        length = draw.choice([0, 1, 30, 5000, 10**5, 3 * 10**8, -5])
        held.append((i, draw.choice(["a", "b", None]), begin, draw.choice([None, (begin or 0) + length])))
    return points, held


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join(spark, monkeypatch, keys, how):
    monkeypatch.setattr(intervals, "HOT", 5)
    points, held = spans()
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in points] * 2, "id long, k string, at timestamp")
    right = spark.createDataFrame([(i, k, at(a), at(b), "x") for i, k, a, b in held], "span long, k string, since timestamp, until timestamp, _salt string")
    right = right if keys else right.drop("k")
    want = []
    for i, k, t in points * 2:
        met = [s for s, h, a, b in held if t is not None and (not keys or k is not None and k == h) and (a is None or a <= t) and (b is None or t < b)]
        want += [(i, s) for s in met] or ([(i, None)] if how == "left" else [])
    found = intervals.interval_join(left, right, "at", "since", "until", keys, how=how)
    assert sorted(((r.id, r.span) for r in found.collect()), key=str) == sorted(want, key=str)
    assert found.columns == ["id", "k", "at", "span", "since", "until", "_salt"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_buckets_are_salted(spark, monkeypatch):
    """Many points in one bucket, with a threshold that they pass."""
    monkeypatch.setattr(intervals, "LEAST", 50)
    left = spark.range(400).select("id", F.lit(START).cast("timestamp").alias("at"))
    right = spark.createDataFrame([(1, at(-10), at(10)), (2, at(0), at(1)), (3, at(1), at(5))], "span long, since timestamp, until timestamp")
    found = intervals.interval_join(left, right, "at", "since", "until")
    assert found.groupBy("span").count().orderBy("span").collect() == [(1, 400), (2, 400)]


def test_pairs_of_equal_instants_are_written_small(spark, tmp_path):
    """Copies at the same instants: pairs grow with their square, the bytes of the written result far less."""
    copies = spark.range(150).select(F.col("id").alias("copy"))
    instants = spark.range(40).select((F.col("id") * 60).alias("second"))
    left = instants.crossJoin(copies).select((F.col("copy") * 1000 + F.col("second") / 60).cast("long").alias("id"), F.timestamp_seconds("second").alias("at"))
    right = left.where("id % 2 = 0").select(F.col("id").alias("span"), F.col("at").alias("since"), (F.col("at") + F.expr("INTERVAL 20 MINUTES")).alias("until"))
    intervals.interval_join(left, right, "at", "since", "until").select("id", "span").write.parquet(f"{tmp_path}/pairs")
    n = 150 * 150 * sum(min(20, 40 - i) for i in range(0, 40, 2))
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() == found.distinct().count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.2 * n


def test_small_blocks_of_hot_buckets(spark, monkeypatch):
    """Blocks, parts, salts and tasks of a few points each, on both sides of 1970, with null columns."""
    for name, value in (("BLOCK", 4), ("TASK", 50), ("LEAST", 20), ("HOT", 50)):
        monkeypatch.setattr(intervals, name, value)
    draw, base = random.Random(4), dt.datetime(1970, 1, 1)
    points = [(draw.choice([i, None]), base + dt.timedelta(seconds=draw.choice([0, -1, draw.randint(-20_000, 20_000)]))) for i in range(300)]
    held = [(i, base + dt.timedelta(seconds=(begin := draw.randint(-20_000, 20_000))), base + dt.timedelta(seconds=begin + draw.choice([1, 600, 3000, 30_000]))) for i in range(80)]
    left = spark.createDataFrame(points, "`an id` long, at timestamp")
    right = spark.createDataFrame(held, "span long, since timestamp, until timestamp")
    want = [(i, t, s) for i, t in points for s, a, b in held if a <= t < b]
    found = [(r[0], r[1], r[2]) for r in intervals.interval_join(left, right, "at", "since", "until").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_interval_join_of_nothing(spark):
    points, held = spans()
    left = spark.createDataFrame([(i, at(t)) for i, _, t in points], "id long, at timestamp")
    right = spark.createDataFrame([], "span long, since timestamp, until timestamp")
    assert intervals.interval_join(left, right, "at", "since", "until").count() == 0
    assert intervals.interval_join(left, right, "at", "since", "until", how="left").count() == len(points)
    assert intervals.interval_join(left.limit(0), right, "at", "since", "until", how="left").count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 400))), max_size=25), st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 400))), max_size=25), st.booleans())
def test_asof_join(spark, left, right, strictly):
    rows = spark.createDataFrame([(i, k, at(t), i) for i, (k, t) in enumerate(left)], "n long, k string, at timestamp, _found long")
    held = spark.createDataFrame([(i, k, at(t), i * 10) for i, (k, t) in enumerate(right)], "n long, k string, at timestamp, price long")
    found = {r.n: r.last_price for r in asof_join(rows, held, ["k"], "at", ["n"], strictly=strictly, span=100).collect()}
    want = {}
    for i, (k, t) in enumerate(left):
        before = [(u, j) for j, (h, u) in enumerate(right) if h == k and t is not None and u is not None and ((u, j) < (t, i) or not strictly and (u, j) == (t, i))]
        want[i] = max(before)[1] * 10 if before else None
    assert found == want


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def deliveries(seed):
    draw = random.Random(seed)
    rows, now = [], 0
    for n in range(4):
        batch = []
        for _ in range(40):
            now += draw.choice([60, 1200, 7200])
            batch.append((len(rows) + len(batch), at(draw.choice([now, now, now, now - 90_000, now - 1000, None])), draw.choice([1, 2, 3, None]), draw.choice(["view", "purchase"]), 1.5))
        rows += batch
        yield batch


def test_late_rows_are_kept_apart_and_a_repeated_batch_changes_nothing(spark):
    split, folder = windows.Accepted(spark, EVENTS, "12 hours"), new_path(spark, "arrivals")
    newest, late, good = None, set(), set()
    for batch in deliveries(3):
        spark.createDataFrame(batch, EVENTS).write.mode("append").parquet(folder)
        split.take(spark.readStream.schema(EVENTS).parquet(folder))
        for r in batch:
            (late if r[1] is None or newest and r[1] < newest - dt.timedelta(hours=12) else good).add(r[0])
        newest = max([r[1] for r in batch if r[1]] + ([newest] if newest else []))
    assert late and {r.event_id for r in split.rows(late=True).collect()} == late and {r.event_id for r in split.rows().collect()} == good
    split._split(spark.createDataFrame(batch, EVENTS), 3)
    assert {r.event_id for r in split.rows(late=True).collect()} == late and split.rows().count() == len(good)


def accepted(spark, rows):
    split, folder = windows.Accepted(spark, EVENTS, "1 day"), new_path(spark, "arrivals")
    spark.createDataFrame(rows, EVENTS).write.parquet(folder)
    split.take(spark.readStream.schema(EVENTS).parquet(folder))
    return split


def test_sessions_and_joins_of_odd_rows(spark):
    rows = [(1, at(0), 1, "view", 1.0), (2, at(1000), 1, "view", 1.0), (3, at(1000), 1, "view", None), (4, at(3000), 1, "purchase", 2.0), (5, at(0), None, "view", 1.0), (6, at(10), None, "purchase", 1.0), (7, None, 1, "view", 1.0)]
    split = accepted(spark, rows)
    found = windows.run_to_end(lambda: windows.sessions(split.stream(), ["user_id"], {"n": F.count(F.lit(1))}), split, "30 minutes", [{"user_id": -1}], "s")
    assert sorted(((r.user_id, r.session_start, r.session_end, r.n) for r in found.collect()), key=str) == sorted([(1, at(0), at(2800), 3), (1, at(3000), at(4800), 1), (None, at(0), at(1810), 2)], key=str)
    split = accepted(spark, rows)

    def build():
        first, then = (split.stream().where(F.col("event_type") == kind).select("event_id", "user_id", "ts") for kind in ("view", "purchase"))
        return windows.followed(first, then, "user_id", within="2000 seconds")

    pairs = windows.run_to_end(build, split, "1 hour", [{"event_type": "view", "user_id": -1}, {"event_type": "purchase", "user_id": -2}], "f")
    assert sorted(((r.event_id, r.then_event_id) for r in pairs.collect()), key=str) == [(1, None), (2, 4), (3, 4), (5, None)]


def test_streams_of_nothing(spark):
    assert windows.Accepted(spark, EVENTS, "1 day").rows().count() == 0
    split = accepted(spark, [])
    assert windows.run_to_end(lambda: windows.sliding(split.stream(), ["event_type"], {"n": F.count(F.lit(1))}), split, "6 hours", [{}], "s").count() == 0
    assert split.rows(late=True).count() == 0


def plain_machine(events, limit, end):
    state, since, out = None, None, []
    for t, status, i in sorted(events, key=lambda e: (e[0], state_machine.ORDER.index(e[1]), e[2])):
        if state == "running" and since + limit < t:
            out.append((None, since + limit, "stuck"))
            state = "stuck"
        outcome = "repeated" if status == state else "ok" if status in state_machine.LEGAL[state] else "illegal"
        out.append((i, t, outcome))
        if outcome == "ok":
            state, since = status, t
    if state == "running" and since + limit < end:
        out.append((None, since + limit, "stuck"))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.sampled_from(state_machine.ORDER)), max_size=12), st.lists(st.integers(0, 130), max_size=4), st.integers(0, 30))
def test_the_machine_doesnt_see_how_events_are_spread(events, watermarks, limit):
    """Events passed by rising watermarks, in parts, give what they give at once."""
    events = [(t, s, i) for i, (t, s) in enumerate(events)]
    rows, was, since, rest = [], None, None, events
    for mark in [*sorted(watermarks), 200]:
        due, rest = [e for e in rest if e[0] < mark], [e for e in rest if e[0] >= mark]
        made, was, since = state_machine.advanced(1, was, since, due, mark, limit)
        rows += made
    assert [(r[1], r[2], r[5]) for r in rows] == plain_machine(events, limit, 200)


def test_jobs_in_several_batches_equal_one(spark):
    """Events that come in five deliveries, out of order inside the delay, with repeats, against the plain machine over what was in time."""
    draw = random.Random(6)
    split, folder, path, checkpoint = windows.Accepted(spark, EVENTS, "1 day"), new_path(spark, "arrivals"), new_path(spark, "jobs"), new_path(spark, "checkpoint")

    def build():
        named = split.stream().select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("at"), F.when(F.col("event_type") != "other", F.expr(temporal.JOB_STATUS)).alias("status"))
        return state_machine.job_transitions(named)

    rows = []
    for n in range(5):
        batch = [(1000 * n + i, at(draw.randint(100_000 * n, 100_000 * n + 260_000)), draw.choice([1, 2, 3, None]), draw.choice(["signup", "view", "error", "purchase", "other"]), 1.0) for i in range(40)]
        batch += batch[:3]
        spark.createDataFrame(batch, EVENTS).write.mode("append").parquet(folder)
        split.take(spark.readStream.schema(EVENTS).parquet(folder))
        windows.advance(build(), path, checkpoint)
    rows = [(r.event_id, r.ts, r.user_id, r.event_type) for r in split.rows().collect()]
    assert split.rows(late=True).count() > 0
    split.close("6 hours", [{"event_type": "view", "user_id": -1}])
    windows.advance(build(), path, checkpoint)
    got, events = defaultdict(list), defaultdict(list)
    for r in spark.read.parquet(path).collect():
        got[r.job_id].append((r.event_id, int((r.at - START).total_seconds()), r.outcome))
    status = {"signup": "queued", "view": "running", "error": "failed", "purchase": "complete"}
    for i, t, user, kind in rows:
        if user and kind != "other":
            events[user].append((int((t - START).total_seconds()), status[kind], i))
    assert set(got) == set(events)
    for job in events:
        assert sorted(got[job], key=str) == sorted(plain_machine(events[job], 6 * 3600, 10**9), key=str)
