import pytest
from pyspark.sql import functions as F

from tierflow.config import RouterConfig
from tierflow.operators import metrics, routing
from tierflow.operators.scoring import PandasBatchScorer, autodetect_label_map, tier1_scorer, tier2_scorer
from tierflow.operators.social import spectrum_bucket


def test_metrics_golden(spark):
    y = [0, 0, 0, 1, 1, 1, 1, 1]
    p = [0, 1, 0, 1, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    m = metrics.accuracy_f1(df, "y", "p").first()
    assert m.accuracy == pytest.approx(0.75) and m.f1_macro == pytest.approx(0.733333, abs=1e-6)
    rep = {r.row: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rep["Negative"].f1 == pytest.approx(2 / 3) and rep["Negative"].support == 3
    assert rep["Positive"].precision == pytest.approx(0.8) and rep["Positive"].support == 5


def test_label_map_golden(spark):
    heads = [("a", ["NEGATIVE", "POSITIVE"]), ("b", ["LABEL_0", "LABEL_1"]), ("c", ["POS", "NEG"]),
             ("d", ["negative", "neutral", "positive"]), ("e", ["a", "b", "c", "d", "e"])]
    df = spark.createDataFrame([(m, i, n) for m, ns in heads for i, n in enumerate(ns)], "model string, idx int, name string")
    got = {(r.model, r.idx): r.mapped for r in autodetect_label_map(df).collect()}
    assert [got[("a", 0)], got[("a", 1)]] == [0, 1]
    assert [got[("c", 0)], got[("c", 1)]] == [1, 0]
    assert [got[("d", i)] for i in range(3)] == [0, 1, 1]
    assert [got[("e", i)] for i in range(5)] == [0, 1, 1, 1, 1]


def test_threshold_validation():
    for bad in (0.0, 1.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            RouterConfig(threshold=bad)


def test_boundary_conf_equal_tau_stays_tier1(spark):
    df = spark.createDataFrame([(1, 0.85)], "id long, c1 double")
    assert df.select((F.col("c1") < F.lit(0.85)).alias("e")).first().e is False


def test_spectrum_boundaries(spark):
    vals = [(0.6, "Ultra Positive"), (0.5999, "Positive"), (0.15, "Positive"), (0.1499, "Neutral"),
            (-0.15, "Negative"), (-0.6, "Ultra Negative")]
    df = spark.createDataFrame(vals, "s double, want string")
    assert all(g == w for g, w in df.select(spectrum_bucket("s"), "want").collect())


def _docs(spark):
    import random
    rnd = random.Random(2)
    words = ["good", "bad", "fine", "meh", "great", "awful", "ok", "so", "very", "not"]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 30))]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def test_cascade_partition_and_monotone(spark):
    d = _docs(spark)
    prev = -1
    for t in (0.55, 0.7, 0.85, 0.95):
        r = routing.route_fixed(d, tier1_scorer(), tier2_scorer(), t)
        n = r.count()
        esc = r.filter("escalate").count()
        acc = r.filter("NOT escalate").count()
        assert esc + acc == n == 300
        assert r.filter("tier_used = 2").count() == esc
        assert esc >= prev
        prev = esc


def test_tier2_only_sees_escalated_rows(spark):
    d = _docs(spark).withColumn("text", F.array_join("tokens", " "))

    def factory():
        def predict(texts):
            return [1] * len(texts), [0.99] * len(texts)
        return predict

    t1 = PandasBatchScorer("t1-test", lambda: (lambda texts: ([0] * len(texts), [0.5 + (len(x) % 10) / 20 for x in texts])), 16)
    t2 = PandasBatchScorer("t2-test", factory, 8)
    seen = {}

    def score2(df):
        s = t2.score(df)
        seen["n"] = s.count()
        return s

    out = routing.route_fixed_frames(d, lambda df: t1.score(df), score2, 0.8)
    esc = out.filter("escalate").count()
    assert seen["n"] == esc
    assert out.filter("tier_used = 2").count() == esc
    assert out.count() == 300


def test_latency_warmup_single_batch(spark):
    b = spark.createDataFrame([("m", 0, 10, 2.0)], "model string, batch_idx long, n long, elapsed_s double")
    r = metrics.latency_after_warmup(b, ["model"], 1).first()
    assert r.avg_latency_ms == pytest.approx(200.0)


def test_router_stats_empty(spark):
    e = spark.createDataFrame([], "tier_used int, tier1_latency double, tier2_latency double")
    r = metrics.router_stats(e).first()
    assert r.total_samples == 0 and r.tier2_rate == 0.0


def test_baseline_joined_equals_the_fitted_model(spark):
    """M4 -> M5 -> M7: scores from the (term, weight) table are the model's own, and the classes are told apart."""
    import random

    from pyspark.ml.functions import vector_to_array

    from tierflow.operators.scoring import sparse_rows, train_lr
    rnd = random.Random(3)
    common, good, bad = [f"c{i}" for i in range(60)], ["fine", "great", "nice"], ["awful", "poor", "bad"]
    rows = [(i, " ".join(rnd.choices(common, k=12) + rnd.choices(good if i % 2 else bad, k=2)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, clean string, label int")
    model = train_lr(df.where("id < 200"))
    test = df.where("id >= 200")
    got = {r.id: (r.pred, r.conf) for r in model.predict(test).collect()}
    x = sparse_rows(model.features(test), model.indexed, model.model.numFeatures)
    want = {r.id: (int(r.prediction), max(r.p)) for r in model.model.transform(x).select("id", "prediction", vector_to_array("probability").alias("p")).collect()}
    assert len(got) == 100 and all(got[i][0] == p and abs(got[i][1] - c) < 1e-9 for i, (p, c) in want.items())
    assert sum(got[i][0] == i % 2 for i in got) >= 95


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    from tierflow.operators.scoring import PandasBatchScorer
    folder = str(tmp_path)

    def factory():
        import os
        import uuid
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: ([len(t) % 2 for t in texts], [0.5 + (len(t) % 5) / 10 for t in texts])
    df = spark.range(400).selectExpr("id", "repeat('x', cast(id % 7 as int)) AS text", "'kept' AS other").repartition(16)
    got = PandasBatchScorer("m", factory, batch_size=16).score(df).collect()
    assert len(got) == 400 and {r.other for r in got} == {"kept"} and all(r.pred == len(r.text) % 2 for r in got)
    loads = [f.split("-")[0] for f in __import__("os").listdir(folder)]
    assert len(loads) == len(set(loads))  # no worker loaded twice, though there were more tasks
