"""Text work is done once a row, by passes whose cost is linear in the text, and not in one task."""
import hashlib
import math
import os
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tierflow.functions import token_sums as ts
from tierflow.functions.text import clean_tokens, stripped_text
from tierflow.operators import features as ft
from tierflow.operators.scoring import linear_score_by_join, tier2_scorer
from tierflow.plans import catalog

SF0001 = "/root/testdata/sf0.001"


def _unit(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2 ** 32


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_matched_not_split_around(spark):
    texts = [None, "", "   ", "It's A1 --- über x@me #tag http://a.b/c?d e'f\n9", "ıİ ß don't", "''"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", clean_tokens("text").alias("t"))
    assert "[^a-z0-9" not in _plan(df)
    for i, t in df.collect():
        if texts[i] is None:
            assert t is None
        else:
            low = re.sub(r"@\w+|#", "", re.sub(r"http\S+|www\.\S+", "", texts[i].lower()))
            assert t == [x for x in re.split(r"[^a-z0-9']+", low) if x]
    terms = ft.terms(spark.createDataFrame([(1, "it's a a"), (2, ""), (3, "''")], "id int, clean string"))
    assert "[^a-z0-9" not in _plan(terms)
    assert sorted(x.term for x in terms.collect()) == sorted(["it", "s", "a", "a", "it s", "s a", "a a"])


def test_sums_over_tokens_match_a_plain_loop(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["x", None]), (5, ["don't"] * 5 + ["b"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = {r.id: r for r in df.select("id", ts.hashed_weight_sum(F.col("t"), "t2:", True).alias("w"), ts.stand_in_valence_sum(F.col("t"), 1.0).alias("v"),
                                      ts.entropy_sum(F.col("t")).alias("e"), tier2_scorer().prob(F.col("t")).alias("p")).collect()}
    for i, t in rows:
        if t is None:
            assert got[i].w is got[i].v is got[i].e is None and got[i].p == 0.5
            continue
        feats = t + [f"{a} {b}" for a, b in zip(t, t[1:])]
        if None in t:
            assert got[i].w is None
        else:
            s = 0.0
            for x in feats:
                s += 2 * _unit("t2:" + x) - 1
            assert got[i].w == s
            assert math.isclose(got[i].p, 1 / (1 + math.exp(-s / math.sqrt(len(feats)))) if t else 0.5)
        assert math.isclose(got[i].v, sum(round(8 * _unit("val:" + x) - 4, 1) for x in t if x is not None), abs_tol=1e-9)
        runs = [t.count(x) for x in {x for x in t if x is not None}] + [1] * t.count(None)
        assert math.isclose(got[i].e, sum(c / len(t) * math.log(c / len(t) + 1e-12) for c in runs), abs_tol=1e-12)


def test_stretches_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(ts, "STRETCH", 3)
    tokens = pa.array([["a"], ["b"] * 7, None, [], ["c", "d"], ["e"], ["f"]])
    parts = list(ts._stretches(tokens))
    assert [x for p in parts for x in p.to_pylist()] == tokens.to_pylist() and len(parts) > 2


def test_cascade_joins_read_scores_made_once(spark):
    for name in ("route_split_semi_anti", "route_overlay"):
        assert "regexp" not in _plan(catalog.QUERIES[name](spark, SF0001)), name


def test_stream_route_lots_are_not_written_by_one_task(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    n = docs.count()
    docs.repartition(5).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    monkeypatch.setattr(catalog, "_scratch", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(catalog, "read_table", lambda spark, sf, name: spark.read.option("maxPartitionBytes", "1k").parquet(os.path.join(sf, f"{name}.parquet")))
    before = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    try:
        got = catalog.QUERIES["stream_route"](spark, str(tmp_path / "sf")).count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[1])
    assert got == n
    for lot in range(4):
        assert len([f for f in os.listdir(tmp_path / "post-files" / str(lot)) if f.endswith(".parquet")]) > 1


def test_term_counts_move_texts_not_terms(spark):
    rows = [(1, "a b a"), (1, "a"), (None, "b"), (None, "b c")]
    tc = ft.term_counts(spark.createDataFrame(rows, "id int, clean string"))
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", tc._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("term" in x for x in dealt)
    assert {(r.id, r.term): r.c for r in tc.collect()} == {(1, "a"): 3, (1, "b"): 1, (1, "a b"): 1, (1, "b a"): 1, (None, "b"): 2, (None, "c"): 1, (None, "b c"): 1}


ODD = [None, "", "   ", "It's A1 --- über x@me #tag http://a.b/c?d e'f\n9", "ıİ ß don't K", "''", "www.x.y z www. httpq", "a" * 70 + " b b b", "@ # @x"]


def test_sums_from_the_text_are_those_over_its_tokens(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string").coalesce(1).select("id", stripped_text("text").alias("s"), clean_tokens("text").alias("t"))
    for stretch in (ts.TEXT_STRETCH, 5):
        monkeypatch.setattr(ts, "TEXT_STRETCH", stretch)
        got = df.select("id", F.size("t").alias("n"), ts.hashed_weight_sum(F.col("t"), "t2:", True).alias("w"), ts.entropy_sum(F.col("t")).alias("e"), ts.stand_in_valence_sum(F.col("t"), 1.0).alias("v"),
                        ts.text_sums(F.col("s"), "t2:", True, True, 1.0).alias("x"), "t", ts.text_counts(F.col("s")).alias("c"), ts.text_counts(F.col("s"), False).alias("u")).collect()
        assert len(got) == len(ODD)
        for r in got:
            if ODD[r.id] is None:
                assert r.x.n is r.x.w is r.x.e is r.x.v is None and not r.c
                continue
            assert (r.n, r.w, r.e, r.v) == (r.x.n, r.x.w, r.x.e, r.x.v), r.id
            assert sorted(x for t, c in r.c for x in [t] * c) == sorted(r.t)
            assert sorted(x for t, c in r.u for x in [t] * c) == sorted(re.findall("[a-z0-9]+", " ".join(r.t)))


def test_text_bound_queries_build_no_token_arrays(spark):
    for name in ("route_dynamic", "dynamic_route_summary", "model_comparison", "mentions", "brand_sentiment", "trend_growth", "linear_score_join"):
        assert "regexp_extract_all" not in _plan(catalog.QUERIES[name](spark, SF0001)), name
    assert "regexp_extract_all" not in _plan(catalog._tagged(spark, SF0001).select("product", "demographic", "spectrum_bucket", "date", "sentiment", "sarcasm"))


def test_join_scores_from_the_text_are_those_of_its_tokens(spark):
    rows = [(1, "a b a"), (1, "c'd a"), (2, None), (3, "b"), (None, "a a"), (None, "b")]
    d = spark.createDataFrame(rows, "id int, s string").withColumn("tokens", clean_tokens("s"))
    w = spark.createDataFrame([("a", 0.5), ("b", -0.25), ("c'd", 2.0)], "term string, weight double")
    got = [sorted(map(tuple, linear_score_by_join(d, w, **x).collect()), key=str) for x in ({}, {"text_col": "s"})]
    assert got[0] == got[1] and len(got[0]) == 6


def test_words_and_pairs_are_hashed_side_by_side(monkeypatch):
    calls = []
    monkeypatch.setattr(ts, "LANES", 7)
    monkeypatch.setattr(ts.hashlib, "md5", lambda x, of=hashlib.md5: calls.append(x) or of(x))
    words = ["", "a", "don't", "é" * 9, *("x" * k for k in range(20, 70))]
    key, pairs = b"t2:", [(i, (i * 7) % len(words)) for i in range(len(words))] + [(0, 0), (1, 0)]
    found = ts._units(key, pa.array(words)), ts._units(key, pa.array(words), *(pa.array(x).to_numpy() for x in zip(*pairs)))
    messages = [key + x.encode() for x in words], [key + f"{words[a]} {words[b]}".encode() for a, b in pairs]
    assert calls == [m for each in messages for m in each if len(m) > 55]  # those that don't fit a block of MD5
    for got, each in zip(found, messages):
        assert got.tolist() == [_unit(m.decode()) for m in each]
    assert len(ts._units(key, pa.array([], pa.string()))) == 0


def test_tags_join_their_events_behind_the_text_work(spark):
    """The text isn't shuffled for the join: no column of it stands above it."""
    plan = _plan(catalog._tagged(spark, SF0001).select("id", "prediction", "score10", "topic"))
    above = plan[:plan.index("Join ")]
    assert "stripped" not in above and "run(" not in above
    assert "run(" in plan
