"""The dynamic cascade on two file streams: matches, late rows, restarts."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tierflow.plans import pipeline as pl
from tierflow.streaming import stream as st

BASE = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
POSTS = "doc_id long, text string, lang string, source string, n_chars long, seen timestamp_ntz"
FAR = BASE + dt.timedelta(days=400)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful operator is a state store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def event(i, minutes, user=1):
    return (i, at(minutes), user, "view", 50.0 + i, '{"k": 40}')


def post(i, minutes):
    return (i, f"post number {i} about nothing", "en", "src", 10, at(minutes))


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(str(folder), name))


def inputs(spark, folder, posts, events):
    for i, rows in enumerate([*posts, [(None, None, None, None, None, FAR)]]):
        write(spark, folder, f"posts/{i}", rows, POSTS)
    for i, rows in enumerate([*events, [(None, FAR, None, None, None, None)]]):
        write(spark, folder, f"events/{i}", rows, EVENTS)
    return str(folder / "posts/*"), str(folder / "events/*")


def test_late_and_unmatched_posts_stay(spark, tmp_path):
    posts = [[post(1, 10), post(2, 20)], [post(3, 300)], [post(4, 301), post(5, 12)]]
    events = [[event(100, 5), event(1, 10)], [event(3, 300, user=2), event(101, 299, user=2)], [event(4, 301), event(5, 12)]]
    paths = inputs(spark, tmp_path, posts, events)
    got = {r.id: r for r in st.live_route(spark, *paths, pl.decide).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert [got[i].device_id for i in (1, 2, 3, 4, 5)] == [1, None, 2, 1, None]  # 2 has no event, 5 came too late for its own
    assert [i for i in got if got[i].late] == [5]
    default = pl._default_phi(pl.CASCADE_V1)
    assert got[2].phi == got[5].phi == pytest.approx(default)
    assert all(r.tau is not None and r.tier_used in (1, 2) for r in got.values())


def test_order_of_arrival_within_the_lateness_does_not_matter(spark, tmp_path):
    rows = [(i, 10 + 3 * i) for i in range(12)]
    events = [event(i, m, user=i % 2) for i, m in rows] + [event(100 + i, m - 1, user=i % 2) for i, m in rows]
    whole, cut = tmp_path / "whole", tmp_path / "cut"
    one = inputs(spark, whole, [[post(*x) for x in rows]], [events])
    mixed = sorted(events, key=lambda e: (e[1].minute // 9, -e[0]))
    many = inputs(spark, cut, [[post(*x) for x in reversed(rows[:7])], [post(*x) for x in reversed(rows[7:])]], [mixed[:9], mixed[9:]])
    a, b = ({r.id: (r.device_id, r.phi, r.tau, r.prediction, r.late) for r in st.live_route(spark, *p, pl.decide, lateness_seconds=3600).collect()} for p in (one, many))
    assert a == b and len(a) == 12 and not any(x[-1] for x in a.values())


def test_resumes_behind_the_last_epoch(spark, tmp_path):
    """A stream that breaks off in its third micro-batch goes on from its checkpoint and equals one that didn't."""
    rows = [(i, 10 + 30 * i) for i in range(6)]
    events = [event(i, m) for i, m in rows]
    paths = inputs(spark, tmp_path / "in", [[post(*x) for x in rows[k:k + 2]] for k in (0, 2, 4)], [events[k:k + 2] for k in (0, 2, 4)])
    whole = {tuple(r) for r in st.live_route(spark, *paths, pl.decide).select("id", "device_id", "phi", "tau", "late").collect()}
    broken = {"left": 2}

    def decide(df):
        broken["left"] -= 1
        if broken["left"] < 0:
            raise RuntimeError("broken off")
        return pl.decide(df)
    base = str(tmp_path / "state")
    with pytest.raises(Exception, match="broken off"):
        st.live_route(spark, *paths, decide, base=base)
    again = {tuple(r) for r in st.live_route(spark, *paths, pl.decide, base=base).select("id", "device_id", "phi", "tau", "late").collect()}
    assert again == whole and len(whole) == 6


def test_a_device_larger_than_a_frame(spark, tmp_path):
    """Readings of one device come to the controller in many frames; what one holds is a bucket of the state store."""
    from tierflow.config import CASCADE_V1
    from tierflow.streaming import controller
    from tierflow.operators import telemetry
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (id * 7919) % 3000)").alias("ts"),
                                 F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.rand(1) * 100).alias("value"), F.lit('{"k": 10}').alias("props"))
    path = str(tmp_path / "in")
    rows.repartition(3).write.parquet(path)
    largest = 100
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(largest))
    try:
        stream = controller.pid_stream(st.events_stream(spark, path), bucket_seconds=60)
        got = st.drain(stream, "pid-frames", [], mode="append")
        want = telemetry.pid(telemetry.pid_inputs_v1(telemetry.health_v1(telemetry.telemetry_from_events(spark.read.parquet(path))), CASCADE_V1), CASCADE_V1)
        both = got.join(want.select("reading_id", F.col("phi").alias("p")), "reading_id")
        assert got.filter("late").count() == 0 and both.count() == n
        assert both.filter("abs(phi - p) > 1e-9").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
