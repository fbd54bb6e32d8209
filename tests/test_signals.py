import math

import pytest
from pyspark.sql import functions as F

from tierflow.functions.signals import h_token, psi_socio, tau_dynamic, tau_terms


def test_psi_golden(spark):
    rows = [(0.0, 0.0, 0.0, "UNKNOWN", 0.075), (0.0, -5.0, 0.0, "TWITTER", 0.0525),
            (20.0, 4900.0, 100.0, "TWITTER", 0.260661), (1e6, 1e7, 500.0, "TIKTOK", 0.9625),
            (5e6, 5e7, 900.0, "TIKTOK", 0.9625)]
    df = spark.createDataFrame(rows, "rt double, fol double, ppm double, plat string, want double")
    for got, want in df.select(psi_socio("rt", "fol", "ppm", "plat"), "want").collect():
        assert got == pytest.approx(want, abs=1e-6)


def test_h_golden(spark):
    rows = [([], 0.0), ([7], 0.0), ([1, 2, 3, 4], 0.134250), ([1, 1, 2], 0.061641), (list(range(128)), 0.469876)]
    df = spark.createDataFrame(rows, "tok array<int>, want double")
    for got, want in df.select(h_token(F.col("tok")), "want").collect():
        assert got == pytest.approx(want, abs=1e-6)


def test_tau_golden_and_range(spark):
    rows = [(0.0, 0.075, 0.0, 0.71), (0.1, 0.2, 0.134242, 0.732410), (0.05, 0.9625, 0.4, 0.751638),
            (0.0, 0.5, 0.469876, 0.758449), (1.0, 0.0, 1.0, 0.869935)]
    df = spark.createDataFrame(rows, "phi double, psi double, h double, want double")
    out = df.select(tau_dynamic("phi", "psi", "h").alias("t"), "want", tau_terms("phi", "psi", "h").alias("c")).collect()
    for t, want, c in out:
        assert t == pytest.approx(want, abs=1e-6)
        assert c["tau_dynamic"] == t
        # reachable range with z in [0, 2]
        assert 0.71 - 1e-9 <= t <= 0.86994


def test_h_property_random(spark):
    import random
    rnd = random.Random(7)
    data = [[rnd.randint(0, 20) for _ in range(rnd.randint(0, 50))] for _ in range(200)]
    df = spark.createDataFrame([(d,) for d in data], "tok array<int>")
    got = [r[0] for r in df.select(h_token(F.col("tok"))).collect()]
    for d, g in zip(data, got):
        if not d:
            assert g == 0.0
            continue
        from collections import Counter
        n = len(d)
        s = sum((c / n) * math.log(c / n + 1e-12) for c in Counter(d).values())
        assert g == pytest.approx(min(1.0, max(0.0, -s / math.log(30522 + 1e-12))), abs=1e-12)


def test_sql_functions_equal_the_columns(spark):
    from tierflow.functions import signals as sg
    from tierflow.functions import sql
    from tierflow.functions.text import clean_text, clean_tokens
    assert len(sql.register(spark)) == 11
    rows = [("I'm HERE @you http://x.y/z #tag, Ünïcode  twice twice", 5000.0, 120.0, 30.0, "reddit", 0.3), (None, None, None, None, None, 0.0),
            ("", 2e6, 2e7, 900.0, "TikTok", 1.0), ("a a b \\ c\nd", 0.0, 0.0, 0.0, "else", 0.5)]
    df = spark.createDataFrame(rows, "t string, r double, f double, b double, p string, phi double")
    df.createOrReplaceTempView("posts_for_sql")
    by_sql = spark.sql("SELECT *, tau_dynamic(phi, psi, h) AS tau FROM (SELECT phi, clean_text(t) AS c, psi_socio(r, f, b, p) AS psi,"
                       " coalesce(h_token(clean_tokens(t)), 0D) AS h FROM posts_for_sql)").collect()
    cols = df.select("phi", clean_text("t").alias("c"), sg.psi_socio("r", "f", "b", "p").alias("psi"), F.coalesce(sg.h_token(clean_tokens("t")), F.lit(0.0)).alias("h"))
    by_col = cols.withColumn("tau", sg.tau_dynamic("phi", "psi", "h")).collect()
    for a, b in zip(by_sql, by_col):
        assert a.c == b.c and all(abs(a[k] - b[k]) < 1e-12 for k in ("psi", "h", "tau")), (a, b)
