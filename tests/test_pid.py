import datetime as dt

import pytest
from pyspark.sql import functions as F

from tierflow.config import CASCADE_V1, CASCADE_V2
from tierflow.operators import telemetry

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, seq, cols):
    rows = [(0, T0 + dt.timedelta(seconds=t), i, *[float(x) for x in v]) for i, (t, v) in enumerate(seq)]
    return spark.createDataFrame(rows, "device_id long, ts timestamp_ntz, reading_id long, " + cols)


def test_pid_v1_golden(spark):
    seq = [(0, (0.5, 0.4)), (1, (0.6, 0.4)), (1.02, (0.9, 0.5)), (2.02, (1.0, 0.5)), (3.02, (1.0, 1.0))]
    df = _rows(spark, seq, "t_norm double, mem_norm double").withColumn("setpoint", F.lit(85.0))
    for chunk in (3600, 1):
        out = telemetry.pid(telemetry.pid_inputs_v1(df, CASCADE_V1), CASCADE_V1, chunk_seconds=chunk).orderBy("reading_id")
        got = [(r.phi_raw, r.phi) for r in out.collect()]
        want_raw = [-170.300085, -0.266085, 5.013575, 0.015575, 0.031575]
        want_phi = [0.0, 0.0, 1.0, 0.015575, 0.031575]
        for (raw, phi), wr, wp in zip(got, want_raw, want_phi):
            assert raw == pytest.approx(wr, abs=1e-5)
            assert phi == pytest.approx(wp, abs=1e-5)


def test_pid_v2_golden(spark):
    cpu = [(0, (.2, .5, 0, .1, 0, 0)), (1, (.9, .5, .8, .1, 0, 0)), (2, (1, .5, .8, .1, 0, 0))]
    cols = ", ".join(f"{c} double" for c in ["cpu_load_norm", "ram_usage_norm", "cpu_temp_norm", "swap_norm",
                                               "gpu_temp_norm", "vram_usage_norm"])
    out = telemetry.pid(telemetry.pid_inputs_v2(_rows(spark, cpu, cols), CASCADE_V2), CASCADE_V2).orderBy("reading_id")
    assert [round(r.phi, 3) for r in out.collect()] == [0.0, 0.239, 0.095]
    gpu = [(0, (.2, .5, 0, .1, .5, .4)), (0.02, (.2, .5, 0, .1, .9, .4))]
    out = telemetry.pid(telemetry.pid_inputs_v2(_rows(spark, gpu, cols), CASCADE_V2), CASCADE_V2).orderBy("reading_id")
    assert [round(r.phi, 3) for r in out.collect()] == [0.0, 1.0]


def _brute_pid(rows, floor=1e-3):
    out, integ, pe, pt = {}, 0.0, 0.0, None
    for t, rid, e, sec in sorted(rows):
        d = floor if pt is None else max(t - pt, floor)
        integ = min(50, max(-50, integ + e * d))
        out[rid] = min(1.0, max(0.0, 0.008 * e + 0.002 * integ + 0.004 * (e - pe) / d + sec))
        pe, pt = e, t
    return out


def test_chunked_scan_equals_sequential(spark):
    import random
    rnd = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += rnd.choice([0.0005, 0.3, 5, 40, 900])
        rows.append((0, T0 + dt.timedelta(seconds=t), i, rnd.random() * 0.3 + 0.7, rnd.random()))
    df = spark.createDataFrame(rows, "device_id long, ts timestamp_ntz, reading_id long, t_norm double, mem_norm double") \
              .withColumn("setpoint", F.lit(85.0))
    inp = telemetry.pid_inputs_v1(df, CASCADE_V1)
    ref = _brute_pid([(round((r[1] - T0).total_seconds() * 1e6) / 1e6, r[2], r[3] * 85 - 85, 0.1 * r[4]) for r in rows])
    for chunk, parts in ((60, 1), (3600, 7), (1, 3)):
        got = {r.reading_id: r.phi for r in telemetry.pid(inp.repartition(parts), CASCADE_V1, chunk_seconds=chunk).collect()}
        for k, v in ref.items():
            assert got[k] == pytest.approx(v, abs=1e-9)


def test_chunked_scan_of_errors_of_any_sign(spark):
    """Errors on both sides of the set-point, long enough to meet both limits: as the sequential loop, on any chunking."""
    import random
    rnd = random.Random(8)
    rows, t = [], 0.0
    for i in range(900):
        t += rnd.choice([0.0005, 0.3, 5, 40, 900])
        device = rnd.choice([0, 0, 1, 2])
        e = rnd.uniform(-30, 30) if device < 2 else -rnd.uniform(0, 30)  # device 2 stays below: the closed form
        rows.append((device, T0 + dt.timedelta(seconds=t), i, e, rnd.random() * 0.1))
    df = spark.createDataFrame(rows, "device_id long, ts timestamp_ntz, reading_id long, error double, secondary double")
    want, low, high = {}, False, False
    for d in range(3):
        mine = [(round((r[1] - T0).total_seconds() * 1e6) / 1e6, r[2], r[3], r[4]) for r in rows if r[0] == d]
        want |= _brute_pid(mine)
    for chunk, parts in ((60, 1), (3600, 7), (1, 3)):
        out = telemetry.pid(df.repartition(parts), CASCADE_V1, chunk_seconds=chunk)
        got = out.select("reading_id", "phi", "integral").collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.phi == pytest.approx(want[r.reading_id], abs=1e-9)
            low, high = low or r.integral == -50, high or r.integral == 50
    assert low and high


def test_clamp_functions_compose():
    from itertools import accumulate

    from hypothesis import given
    from hypothesis import strategies as hs

    from tierflow.operators.scan import clamp_of
    step = hs.lists(hs.integers(-9, 9).map(float), max_size=30)

    @given(step, step, hs.integers(-5, 5).map(float))
    def check(a, b, v):
        run = lambda x, steps: list(accumulate(steps, lambda y, s: min(5.0, max(-5.0, y + s)), initial=x))[-1]
        f = lambda x, steps: min(clamp_of(steps, 5.0)[1], max(clamp_of(steps, 5.0)[0], x + clamp_of(steps, 5.0)[2]))
        assert f(v, a) == run(v, a)
        assert f(f(v, a), b) == f(v, a + b) == run(v, a + b)
    check()
