"""Terms by blocks and shards: M4's weights and the baseline's fit, against the relational forms."""
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierflow.operators import features as ft
from tierflow.operators import scoring
from tierflow.operators import term_blocks as tb
from tierflow.plans import catalog
from tierflow.session import settle

ODD = [(None, "a b a", 1), (None, "b a's", 0), (500, None, 1), (501, "", 0), (502, "x " * 400, 1)]


@pytest.fixture(scope="module")
def posts(spark):
    """Ids that come once, twice, or as null; more terms than rows."""
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(30_000)]
    rows = [(i % 150, " ".join(rnd.choices(words, k=40)), i % 150 % 2) for i in range(200)]
    return spark.createDataFrame(rows + ODD, "id long, clean string, label int").repartition(3)


def test_weights_by_blocks_are_the_relational_ones(spark, posts):
    tc = ft.term_counts(posts)
    want = {(r.id, r.term): r.weight for r in ft.tfidf(tc, ft.vocabulary(tc), spark.createDataFrame([(205.0,)], "n double")).collect()}
    for count in (1, 7):
        x = tb.term_blocks(posts, count)
        got = {(r.id, r.term): r.weight for r in tb.tfidf(x, tb.vocabulary(x), 205.0).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_tfidf_moves_no_row_of_a_term(spark, tmp_path):
    """Each (id, term) row used to be dealt by term, sorted, and dealt again by id."""
    spark.createDataFrame([(i, f"some text {i % 3} of post {i}", "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalog.QUERIES["tfidf_weights"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"(SortMergeJoin|Window|Exchange[^\n]*term#)", plan)


def test_a_block_codes_its_texts_alike_in_any_order(monkeypatch):
    ids, text = [3, None, 1, 3, 2], ["b a b", "a c", None, "b a", "c"]
    first = tb.coded(pa.array(ids), pa.array(text))
    for order in ([4, 3, 2, 1, 0], [1, 0, 3, 4, 2]):
        again = tb.coded(pa.array([ids[i] for i in order]), pa.array([text[i] for i in order]))
        assert again.ids.to_pylist() == first.ids.to_pylist() == [1, 2, 3, None]
        for c in ("first", "second", "ends", "row", "n"):
            assert getattr(again, c).tolist() == getattr(first, c).tolist()
    terms = first.terms(np.arange(len(first.ends)))
    assert terms.to_pylist() == ["a", "a b", "a c", "b", "b a", "c"] and first.df.tolist() == [2, 1, 1, 1, 1, 2]
    dealt = {i: s for s, of in first.dealt(5) for i in of.tolist()}
    assert [dealt[i] for i in range(6)] == tb.shard_of(terms, 5).tolist()


def test_the_fit_holds_no_vector_of_terms_on_the_driver(posts, monkeypatch):
    """Ten pairs of vectors of the vocabulary's size filled the driver at 1 GB."""
    sizes, summed = [], tb.TermMatrix.summed

    def seen(self, of, arg=None, size=None):
        found = summed(self, of, arg, size)
        sizes.append(max(found.size, 0 if arg is None else np.size(arg)))
        return found
    monkeypatch.setattr(tb.TermMatrix, "summed", seen)
    model = scoring.train_lr(posts, tol=1e-13)
    rows = posts.select("id").distinct().count()
    assert model.vocabulary.count() > 2 * rows and max(sizes) <= rows and len(sizes) < 50
    assert "coefficients" not in vars(model)
    settled = posts.select("id", F.col("label").cast("double").alias("label"), "clean")
    capped = scoring._train_capped(settled, settled.agg(F.count(F.lit(1)).cast("double").alias("n")), 1.0, 1000, 10 ** 6, 2, 1e-13)
    assert abs(model.coefficients - capped.coefficients).max() < 1e-6 and abs(model.intercept - capped.intercept) < 1e-6


def test_gradient_vanishes_at_the_fit(posts):
    once = posts.where("id is not null").dropDuplicates(["id"]).localCheckpoint()
    got = scoring.lr_gradient_norms(scoring.train_lr(once, tol=1e-9), once).first()
    assert got.n_train == once.count() and got.at_fit < 1e-5 * got.at_zero


def test_shuffles_of_a_settled_frame_are_gone(spark):
    """They stayed on disk beside the checkpoint until the driver's garbage was collected."""
    def shuffles():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    before = shuffles()
    df = settle(spark.range(1000).groupBy(F.col("id") % 7).count())
    for _ in range(50):  # executors are told, not waited for
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert df.count() == 7  # with a shuffle of its own


def test_copies_of_a_key_take_its_places_in_the_split_in_turn(spark, tmp_path):
    d = [(i % 40, f"post {i} says {i % 3}", "en", "s", 1) for i in range(60)]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    _, s = catalog._baseline(spark, str(tmp_path))
    rows = s.collect()
    assert len(rows) == 50 == len({r.clean for r in rows})
    assert sum(r.split == "test" for r in rows) == sum(round(0.2 * sum(r.label == y for r in rows)) for y in (0, 1))
