"""Importance resampling against zlib's CRC and a document-by-document version."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.llm import importance as im

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, run):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, run=2, buckets=10_000, seed=7, percent=25, min_words=20):
    hashed = lambda fs: [zlib.crc32(f.encode()) % buckets for f in fs]
    docs = [(i, *features(t, run)) for i, t in rows]
    s, t = (Counter(b for fs in lots for b in hashed(fs)) for lots in ([f for _, _, f in docs], [features(x, run)[1] for x in target]))
    sums = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sums[0] + buckets) / ((s[b] + 1) * (sums[1] + buckets))))
    out = []
    for i, words, fs in docs:
        weight = sum(map(gain, hashed(fs))) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0]))
    for n, x in enumerate(able[:percent * len(able) // 100]):
        x[4] = n + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def rows_of(n=200, seed=2):
    rnd = random.Random(seed)
    words = ["The", "é", "日本", "2024", "x_y", "a-b", "straße", " ", *[f"w{i}" for i in range(60)], "averyverylongword" * 9]
    return [(i * 3, " ".join(rnd.choice(words[: rnd.randrange(2, 69)]) for _ in range(rnd.randrange(0, 60)))) for i in range(n)] + [(1, None), (2, ""), (4, "!?"), (5, "one")]


def test_against_brute_force(spark, frame):
    rows, target = rows_of(), ["the w1 w2 straße", None, "w3 " * 30]
    texts = spark.createDataFrame([(x,) for x in target], "text string").withColumn("doc_id", F.lit("t"))
    got = im.resample(frame(rows).repartition(5), texts)
    assert [f"{n} {t}" for n, t in got.dtypes] == [f"{n} bigint" for n in ("doc_id", "n_features", "weight", "score", "rank")]
    want = plain(rows, target)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(x[4] is not None for x in want) > 20


@pytest.mark.parametrize(("run", "block"), [(1, 50), (2, 50), (3, 20), (4, 1)])
def test_features_of_small_blocks(monkeypatch, run, block):
    """Texts cut into blocks of a few bytes give each feature once, whatever crosses the cuts."""
    monkeypatch.setattr(im, "BLOCK_BYTES", block)
    texts = [t or "" for _, t in rows_of(40)] + ["", "a b c " * 40, "a b c " * 40]
    got = [Counter() for _ in texts]
    words = [0] * len(texts)
    for doc, bucket, here, own in im.hashed_features([t.encode() for t in texts], run, 977):
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            got[d][b] += 1
        for d, n in zip(here.tolist(), own.tolist(), strict=True):
            words[d] += n
    assert got == [Counter(zlib.crc32(f.encode()) % 977 for f in features(t, run)[1]) for t in texts]
    assert words == [len(features(t, run)[0]) for t in texts]


def test_crc_by_columns():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        rows = rnd.integers(0, 256, (50, n), dtype=np.uint8)
        assert im.crc_columns(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]
    words = [b"a", b"bc", "é".encode(), b"x" * 100]
    runs = np.array([[a, b] for a in range(4) for b in range(4)])
    assert im.crc_of_runs(words, runs).tolist() == [zlib.crc32(words[a] + b" " + words[b]) for a, b in runs.tolist()]


def test_ties_nulls_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i, text) for i in range(12)] + [(5, text)] * 9 + [(None, text)] * 19
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = im.resample(df, df.limit(0), percent=50).collect()
    want = plain(rows, [], percent=50)
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((x[:4] for x in want), key=str)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert sorted((r["rank"], r.doc_id) for r in got if r["rank"]) == sorted((x[4], x[0]) for x in want if x[4])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert im.resample(none, some).count() == 0
    assert [r["rank"] for r in im.resample(some, none, min_words=0, percent=100).collect()] == [1]
