"""Toxicity: the grammar's scopes, learning, held-out accuracy, odd rows."""
import random

from pyspark.sql import functions as F

from tierflow.llm import toxicity as tx


def test_scopes_compose():
    reader = tx.Model({"idiot": 1.0, "lowe*": 2.0}).reader()
    weigh = lambda t: [round(w, 6) for w in reader.clauses(t)]
    assert weigh("an idiot") == [1.0] and weigh("a fine day") == [] and weigh("idiots idiotic") == []
    assert weigh("you are an idiot") == [1.3] and weigh("IDIOT, you know") == [1.3]
    assert weigh("he is not an idiot") == [round(1.3 * 0.4, 6)]
    assert weigh("she said you are an idiot") == [round(1.3 * 0.6, 6)]
    assert weigh("she said he was never an idiot") == [round(1.3 * 0.6 * 0.4, 6)]
    assert weigh("i will kill you") == [4.0] and weigh("i will not kill you") == [1.6] and weigh("kill the lights") == []
    assert weigh("idiot. idiot; not one") == [1.0, 1.0]
    assert weigh("loweisch xlowe lowe") == [2.0]  # a stem needs an ending, at a word's start


def test_composition_is_the_cascade():
    """The composed machine emits what the transducers emit one after another."""
    parts = [tx._scoped("N", "n", 3), tx._scoped("R", "r", 12), tx._threat, tx._target]
    starts, rnd = [0, 0, ("", 0, ""), (0, 0)], random.Random(1)
    for _ in range(200):
        word = rnd.choices(tx.CLASSES, k=12)
        state, got = tx.GRAMMAR.start, []
        for c in word:
            state, out = tx.GRAMMAR.arcs[state, c]
            got.append(out)
        want = word
        for start, step in zip(starts, parts):
            now, outs = start, []
            for c in want:
                now, o = step(now, c)
                outs.append(o)
            want = outs
        assert got == want


def test_learned_words_and_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tx.learn(docs, labels, ~tx.held_out(F.col("doc_id")))
    assert all(model.weights[w] > 2 for w in ("idiot", "scum", "trash"))
    held = tx.scores(docs, model).where(tx.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)


def test_odd_rows(spark, frame):
    model = tx.Model(logistic=(-3.0, 2.0, 2.0))
    rows = [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "you idiot"), (4, "fine words. " * 100_000 + "you idiot")]
    got = tx.scores(frame(rows), model).collect()
    assert sorted(r.predicted for r in got) == [0, 0, 1, 1, 1, 1]
    kept = tx.reject(frame(rows), model)
    assert kept.columns == frame(rows).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert tx.scores(frame([]), model).count() == 0 and tx.reject(frame([]), model).count() == 0


def test_learning_without_labels(spark, frame):
    rows = frame([(1, "a"), (2, None), (None, "x")])
    for labels in ([], [(1, 0)], [(1, None), (None, 1)], [(1, 1), (1, 0)]):
        model = tx.learn(rows, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert model.weights["idiot"] == tx.SEED_WEIGHT
    model = tx.learn(frame([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert model.logistic == tx.Model().logistic
