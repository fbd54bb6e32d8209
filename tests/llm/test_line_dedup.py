"""Line dedup and its perfect hash against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm import line_dedup as ld


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def plain(rows, min_docs, min_chars):
    held = {}
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held.setdefault(key_of(line), set()).add(n)
    often = {k for k, v in held.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = "\n".join(x for x in lines if key_of(x) not in often)
        out.append((i, len(lines), sum(key_of(x) in often for x in lines), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def rows_of(n, seed=3):
    rnd = random.Random(seed)
    lines = ["", " ", "Copyright", " copyright\t", "ÄRGER", "ärger", " x", "x\r", "ok", "é", "日本", *[f"Line {i}" for i in range(40)]]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 9)))) for i in range(n)]
    return rows + [(None, "Copyright\nown"), (None, "Copyright\nown"), (3, rows[3][1]), (3, rows[3][1]), (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "solo\n" * 5000 + "end")]


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (4, 0), (3, 3), (1, 1)])
def test_against_brute_force(spark, frame, monkeypatch, min_docs, min_chars):
    rows = rows_of(120)
    got = ld.drop_lines(frame(rows).repartition(5), min_docs=min_docs, min_chars=min_chars, with_kept=True)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, min_docs, min_chars)


def test_many_batches_and_shards(spark):
    """Batches of a few bytes and more shards than lines: every batch asks many shards, and hot lines merge on the way."""
    rows = rows_of(300, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = df.select(F.col("text"), "doc_id", F.lit("n").alias("n"), F.lit(1).alias("batch"))
    shards = 97
    prepared = ld.prepare(docs, keep=["doc_id", "n", "batch"])
    asked = prepared.select("batch", "payload", "lengths").mapInArrow(ld._ask(shards, 1), ld._ASKED)
    index = ld.line_index(asked, shards)
    held = {}
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if key_of(line):
                held.setdefault(key_of(line), set()).add(n)
    counts = []
    for r in index.collect():
        counts += np.frombuffer(r.counts, f"<u{r.width}").tolist()
        assert len(r.fingerprints) == 8 * r.n and len(r.counts) == r.width * r.n
    assert sorted(counts) == sorted(map(len, held.values()))
    got = ld.drop_lines(docs, keep=["doc_id", "n", "batch"])
    assert got.columns == ["doc_id", "n", "batch", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=str) == sorted((x[:4] for x in plain(rows, 10, 1)), key=str)


def test_perfect_hash_has_no_gaps():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 50_000):
        keys = np.zeros(n, ld._KEY)
        keys["low"], keys["high"] = rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2), np.arange(n)
        if n > 3:
            keys["low"][: n // 2] = keys["low"][0]  # half of the keys differ in one half of their bits only
        rounds = ld.build_rounds(keys)
        assert sorted(ld.slots(rounds, keys).tolist()) == list(range(n))
        assert sum(size for size, _ in rounds) < 8 * n + 200
        assert (ld.slots([], keys) == -1).all()


def test_no_rows(spark, frame):
    assert ld.drop_lines(frame([(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[1:3] for r in ld.drop_lines(frame([(1, None)]), min_docs=1).collect()] == [(1, 0)]


def test_lines_of_a_third_of_all_documents_are_one_entry_a_batch(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("own "), "id")).alias("text")).repartition(4)
    prepared = ld.prepare(df)
    asked = prepared.select("batch", "payload", "lengths").mapInArrow(ld._ask(8, 1), ld._ASKED)
    assert asked.agg(F.sum(F.length("keys") / 16)).first()[0] <= 2000 + prepared.count()
    assert ld.drop_lines(df).where("n_dropped = 1").count() == 1000
