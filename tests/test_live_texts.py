"""The live cascade's texts stay in intake's log: neither state nor a second copy of the input holds them."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tierflow.plans import catalog
from tierflow.plans import pipeline as pl
from tierflow.streaming import stream as st

BASE = dt.datetime(2024, 1, 1)
FAR = BASE + dt.timedelta(days=400)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
POSTS = "doc_id long, text string, lang string, source string, n_chars long, seen timestamp_ntz"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def inputs(spark, folder, texts):
    """(id, text) by lots; an event for each id but the last lot's, when it first comes."""
    had = set()
    for i, lot in enumerate([*texts, [(None, None)]]):
        at = [FAR if k is None else BASE + dt.timedelta(minutes=10 + 20 * i) for k, _ in lot]
        spark.createDataFrame([(k, x, "en", "src", 1, t) for (k, x), t in zip(lot, at)], POSTS).coalesce(1).write.parquet(str(folder / f"posts/{i}"))
        known = {k for k, _ in lot} - had if i != len(texts) - 1 else {-1}
        had |= known
        spark.createDataFrame([(k, at[0], 1, "view", 50.0, '{"k": 40}') for k in known or {-2}], EVENTS).coalesce(1).write.parquet(str(folder / f"events/{i}"))
    return str(folder / "posts/*"), str(folder / "events/*")


def test_state_holds_no_text(spark, tmp_path):
    rnd = random.Random(3)
    texts = [[(4 * lot + i, f"{4 * lot + i} " + " ".join(f"{rnd.getrandbits(60):x}" for _ in range(20_000))) for i in range(4)] for lot in range(3)]
    paths = inputs(spark, tmp_path, texts)
    got = st.live_route(spark, *paths, lambda df: pl.decide(df).withColumn("said", F.col("clean")), base=str(tmp_path / "base")).collect()
    assert {(r.id, r.said) for r in got} == {x for lot in texts for x in lot}
    assert sum(r.device_id is not None for r in got) == 8
    whole = sum(len(x) for lot in texts for _, x in lot)
    assert whole > 3_000_000 and size(tmp_path / "base" / "route" / "checkpoint") < whole / 10


def test_posts_of_one_id_keep_their_own_texts(spark, tmp_path):
    paths = inputs(spark, tmp_path, [[(1, "one"), (1, "another"), (2, None), (3, "")], [(1, "third")], [(9, "last")]])
    got = st.live_route(spark, *paths, lambda df: pl.decide(df).withColumn("said", F.col("clean"))).collect()
    assert sorted((r.id, r.said) for r in got if r.id != 2) == [(1, "another"), (1, "one"), (1, "third"), (3, ""), (9, "last")]
    assert [r.said for r in got if r.id == 2] == [None]


def test_no_copy_of_all_posts_beside_the_lots(spark, tmp_path):
    spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("post "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(50).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(id, 0, 0, 0)").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
                           F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))

    def checkpoints():
        return sum(x.startswith("rdd-") for _, d, _ in os.walk(spark.conf.get("spark.checkpoint.dir")) for x in d)
    before = checkpoints()
    base = catalog._live_inputs(spark, str(tmp_path), F.expr("doc_id % 11 = 5"), F.expr("event_id % 7 = 3"), 2)
    assert checkpoints() == before
    lots = [spark.read.parquet(os.path.join(base, "posts", x)).where("doc_id is not null").select("doc_id", "seen").collect() for x in sorted(os.listdir(os.path.join(base, "posts")))]
    assert sorted(r.doc_id for lot in lots for r in lot) == list(range(60))
    assert max(r.seen for r in lots[0]) < min(r.seen for r in lots[1]) and [r.doc_id % 11 for r in lots[-2]] == [5] * 5 and lots[-1] == []
