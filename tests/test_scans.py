import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierflow.operators import scan, telemetry
from tierflow.operators.split import sample_exact, split_stratified
from tierflow.operators.topk import topk_per_group

T0 = dt.datetime(2024, 1, 1)


def test_asof_equals_merge_asof(spark):
    rnd = random.Random(5)
    reads = [(rnd.randint(0, 3), T0 + dt.timedelta(seconds=rnd.randint(0, 20000)), i, rnd.random()) for i in range(600)]
    posts = [(1000 + i, rnd.randint(0, 4), T0 + dt.timedelta(seconds=rnd.randint(0, 20000))) for i in range(300)]
    r = spark.createDataFrame(reads, "device_id long, ts timestamp_ntz, reading_id long, v double")
    p = spark.createDataFrame(posts, "id long, device_id long, ts timestamp_ntz")
    for strict in (False, True):
        got = {x.id: x.reading_id for x in telemetry.latest_reading(p, r, ["reading_id", "v"], strict=strict,
                                                                    chunk_seconds=600).collect()}
        rp = pd.DataFrame(reads, columns=["device_id", "ts", "reading_id", "v"]).sort_values(["ts", "reading_id"])
        for pid, dev, ts in posts:
            cand = rp[(rp.device_id == dev) & ((rp.ts < ts) if strict else (rp.ts <= ts))]
            want = None if cand.empty else int(cand.iloc[-1].reading_id)
            assert got[pid] == want


def test_trailing_count_brute(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("ab"), rnd.randint(0, 3000)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, sec long")
    got = {r.id: r.n for r in scan.trailing_count(df, "k", "sec", 60, out="n").collect()}
    for i, k, s in rows:
        assert got[i] == sum(1 for _, k2, s2 in rows if k2 == k and s - 59 <= s2 <= s)


def test_exact_rank_and_splits_partition_invariant(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    a = {r.id: r.split for r in split_stratified(df.repartition(1)).collect()}
    b = {r.id: r.split for r in split_stratified(df.repartition(7)).collect()}
    assert a == b
    n1 = sum(1 for i in range(3000) if i % 7 == 0)
    test1 = sum(1 for i, s in a.items() if s == "test" and i % 7 == 0)
    test0 = sum(1 for i, s in a.items() if s == "test" and i % 7 != 0)
    assert test1 == round(n1 * 0.2) and test0 == round((3000 - n1) * 0.2)
    s = sample_exact(df, 123)
    assert s.count() == 123 and sorted(r.sample_rank for r in s.collect()) == list(range(1, 124))
    assert sample_exact(df, 0).count() == 3000  # falsy = no cap


def test_topk_two_phase_exact(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["cold"]), i, rnd.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = topk_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, out_rank="r").collect()
    for g in ("hot", "cold"):
        want = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:5]
        assert [x.id for x in sorted([x for x in got if x.g == g], key=lambda x: x.r)] == [w[1] for w in want]


def test_pid_scan_of_a_positive_error(spark):
    from tierflow.config import CASCADE_V1
    rows = [(0, T0 + dt.timedelta(seconds=s), i, e, 0.0) for i, (s, e) in enumerate([(0, -5.0), (10, 2.0), (20, -1.0), (30, 9.0)])]
    df = spark.createDataFrame(rows, "device_id long, ts timestamp_ntz, reading_id long, error double, secondary double")
    got = {r.reading_id: r.integral for r in telemetry.pid(df, CASCADE_V1).collect()}
    assert got == pytest.approx({0: -0.005, 1: 19.995, 2: 9.995, 3: 50.0})


def test_half_failed_reads_take_the_group_defaults(spark):
    rows = [(1, 60.0, None, 50.0, 6.4, 12.8, 0.5, 2.0), (2, None, 8.0, 50.0, None, 12.8, 0.5, 2.0), (3, 42.5, 8.0, 50.0, 6.4, 12.8, 0.5, 0.0)]
    tel = spark.createDataFrame(rows, "reading_id long, gpu_temp_c double, vram_gb double, cpu_pct double, ram_gb double, ram_total_gb double, swap_gb double, swap_total_gb double") \
        .selectExpr("1L AS device_id", "timestamp'2024-01-01' AS ts", "*", "map('acpitz', array(45.0D)) AS sensors")
    v1 = {r.reading_id: (r.t_norm, r.mem_norm) for r in telemetry.health_v1(tel).collect()}
    assert v1 == {1: (0.5, 0.5), 2: (0.5, 0.5), 3: (0.5, 0.5)}
    v2 = {r.reading_id: tuple(r)[3:] for r in telemetry.health_v2(tel).collect()}
    assert v2[1] == (0.5, 0.5, 0.5, 0.25, 0.0, 0.0) and v2[2] == (0.0,) * 6 and v2[3] == (0.5, 0.5, 0.5, 0.0, 0.5, 0.5)


def test_buckets_keep_to_their_bound_however_values_are_bunched(spark):
    """Half of the ids lie in a ten-millionth of the range, and half of those in a ten-millionth of that."""
    from tierflow.operators.scan import bounded_buckets
    ids = [*range(0, 10**15, 10**12), *range(10**9, 10**9 + 500), *(2 * 10**9 + i * 10**5 for i in range(500)), 10**9 + 7, 10**9 + 7]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = bounded_buckets(df, "id", most_rows=40, parts=16).collect()
    by = {}
    for r in got:
        by.setdefault(r._bucket, []).append(r.id)
    assert len(got) == len(ids) and max(map(len, by.values())) <= 40
    order = [by[b] for b in sorted(by)]
    assert all(max(a) < min(b) for a, b in zip(order, order[1:]))
    batches = {r.id: r.batch_id for r in telemetry.batch_ids(df.distinct(), "id", 64, most_rows=40).collect()}
    assert batches == {i: n // 64 for n, i in enumerate(sorted(set(ids)))}
    assert {r._bucket for r in bounded_buckets(df.where("id = 7000000000000"), "id").collect()} <= {""}


def test_quantiles_of_many_columns_in_a_few_passes(spark, monkeypatch):
    import math
    import random

    import numpy as np

    from tierflow.operators import metrics
    rnd = random.Random(5)
    values = {"a": [rnd.choice([0.0, -1.5, 1e300, -1e-300, 2.0]) for _ in range(999)], "b": [rnd.gauss(0, 1) for _ in range(999)],
              "c": [1e9 + rnd.randrange(3) * 1e-6 for _ in range(999)], "d": [None if i % 3 else float(i) for i in range(999)], "e": [None] * 999, "f": [math.nan] * 998 + [4.0]}
    df = spark.createDataFrame(list(zip(*values.values())), ", ".join(f"{c} double" for c in values)).repartition(4)
    passes, plain = [], metrics._summaries
    monkeypatch.setattr(metrics, "_summaries", lambda *a: passes.append(1) or plain(*a))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = metrics.exact_summaries(df, list(values), probs)
    assert len(passes) <= 5
    for c, v in values.items():
        v = [x for x in v if x is not None and not math.isnan(x)]
        assert got[c]["count"] == len(v)
        for p in probs:
            assert got[c][p] == (pytest.approx(float(np.quantile(v, p)), rel=1e-12, abs=1e-300) if v else None), (c, p)
    assert got["b"]["std"] == pytest.approx(np.std(values["b"], ddof=1)) and got["f"]["std"] is None
