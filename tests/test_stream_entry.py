import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tierflow.config import CASCADE_V1
from tierflow.streaming import stream as st

SF = "/root/testdata/sf0.001"


def test_stream_pid_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    d = tmp_path / "in"
    spark.createDataFrame([(1, base + dt.timedelta(seconds=10), 1, "view", 50.0, '{"k": 10}'),
                           (2, base + dt.timedelta(seconds=20), 1, "view", 60.0, '{"k": 10}')], schema) \
        .coalesce(1).write.parquet(str(d / "a"))
    spark.createDataFrame([(3, base + dt.timedelta(seconds=15), 1, "view", 70.0, '{"k": 10}'),
                           (4, base + dt.timedelta(seconds=30), 1, "view", 70.0, '{"k": 10}')], schema) \
        .coalesce(1).write.parquet(str(d / "b"))
    s = st.pid_stream(st.events_stream(spark, str(d / "*"), max_files=1))
    out = {r.reading_id: r.late for r in st.drain(s, "pid-late", [], mode="append").collect()}
    assert out == {1: False, 2: False, 3: True, 4: False}


def test_stream_pid_of_a_busy_device_in_any_file_order(spark, tmp_path):
    """40,000 readings of one device in one micro-batch, spread over files: as the batch controller, none late."""
    from tierflow.operators import telemetry
    rows = (spark.range(40_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id div 3)").alias("ts"),
        F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.rand(1) * 100).alias("value"), F.lit('{"k": 10}').alias("props")))
    path = str(tmp_path / "in")
    rows.repartition(4, F.rand(2)).write.parquet(path)
    got = st.drain(st.pid_stream(st.events_stream(spark, path)), "pid-busy", [], mode="append")
    tel = telemetry.health_v1(telemetry.telemetry_from_events(spark.read.parquet(path)))
    want = telemetry.pid(telemetry.pid_inputs_v1(tel, CASCADE_V1), CASCADE_V1)
    both = got.join(want.select("reading_id", F.col("phi").alias("p"), F.col("integral").alias("i")), "reading_id")
    assert got.filter("late").count() == 0 and both.count() == 40_000
    assert both.filter("abs(phi - p) > 1e-9 or abs(integral - i) > 1e-6").count() == 0


def test_stream_pid_forgets_idle_devices(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    d = tmp_path / "in"
    for name, rows in (("a", [(1, base, 1), (2, base, 2)]), ("b", [(3, base + dt.timedelta(hours=5), 2)]),
                       ("c", [(4, base + dt.timedelta(hours=6), 2)]), ("d", [(5, base + dt.timedelta(hours=7), 1)])):
        spark.createDataFrame([(i, t, u, "view", 99.0, '{"k": 10}') for i, t, u in rows], schema).coalesce(1).write.parquet(str(d / name))
    s = st.pid_stream(st.events_stream(spark, str(d / "*"), max_files=1), idle_seconds=3600)
    out = {r.reading_id: r for r in st.drain(s, "pid-idle", [], mode="append").collect()}
    assert out[5].integral == out[1].integral  # starts anew: the first step's floor, not seven hours


def test_entry_and_catalogue(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "source" in df.columns and "tier2_rate" in df.columns
