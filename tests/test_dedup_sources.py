import csv
import json

import pytest
from pyspark.sql import functions as F

from tierflow.operators.dedup import contamination, dedup_exact, dedup_near
from tierflow.sources import readers, sinks


def _jacc(a, b):
    sa = {" ".join(a[i:i + 3]) for i in range(max(len(a) - 2, 1))}
    sb = {" ".join(b[i:i + 3]) for i in range(max(len(b) - 2, 1))}
    return len(sa & sb) / len(sa | sb)


def test_near_dup_vs_brute_force(spark):
    import random
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1000, []), (1001, ["a"]), (1002, ["a"]), (1003, ["a", "b"])]
    for i in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 90))]
        rows.append((i * 3, base))
        for j in range(rnd.randint(0, 3)):
            base = list(base)
            for _ in range(rnd.randint(0, 4)):
                base[rnd.randrange(len(base))] = rnd.choice(vocab)
            rows.append((i * 3 + j + 200, base))
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r.id: r for r in dedup_near(df).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        near = [(j, _jacc(t, u)) for j, u in rows if j < i and t and u and _jacc(t, u) >= 0.7]
        want = min(near, default=(None, None))
        assert (got[i].dup_of, got[i].similarity, got[i].is_near_duplicate) == (*want, bool(near)), i
    assert sum(r.is_near_duplicate for r in got.values()) > 20


def _edited_copies(spark, k):
    """k copies of a text, each with a word of its own; exactly one shingle in forty differs."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, [*base[:10 + i % 97], f"own{i}", *base[11 + i % 97:]]) for i in range(k)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


def test_near_dup_work_grows_with_a_group_not_with_its_pairs(spark, monkeypatch):
    from tierflow.operators import dedup
    verified, plain = [], dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *a: verified.append(pairs.count()) or plain(pairs, *a))
    counts = {}
    for k in (500, 2000):
        verified.clear()
        got = dedup.dedup_near(_edited_copies(spark, k)).collect()
        assert [r.dup_of for r in sorted(got, key=lambda r: r.id)] == [None] + [0] * (k - 1)
        counts[k] = sum(verified)
    assert counts[2000] < 2000 * 8 and counts[2000] < counts[500] * 6


def test_near_dup_of_chains_takes_the_lowest_match(spark):
    """Texts that drift: each is like its neighbours only, so lists go on over several rounds."""
    rows = [(i, [f"w{j}" for j in range(i * 3, i * 3 + 60)]) for i in range(60)]
    got = {r.id: r for r in dedup_near(spark.createDataFrame(rows, "id long, tokens array<string>")).collect()}
    for i, t in rows:
        near = [(j, _jacc(t, u)) for j, u in rows if j < i and _jacc(t, u) >= 0.7]
        assert (got[i].dup_of, got[i].similarity) == min(near, default=(None, None)), i


def test_near_dup_moves_the_sets_of_texts_that_share_enough_only(spark, monkeypatch):
    """Texts with too few shingles in common with all others end at the first count, and a round reads its stretch of the lists."""
    from tierflow.operators import dedup
    rows = [(i, [f"own{i}_{j}" for j in range(60)]) for i in range(300)]
    rows += [(300 + i, [f"pair{i // 2}_{j}" for j in range(59)] + [f"end{i}"]) for i in range(20)]
    rows += [(400 + i, [f"half{i // 2}_{j}" for j in range(30)] + [f"h{i}_{j}" for j in range(30)]) for i in range(20)]
    seen, plain = [], dedup._first_matches
    monkeypatch.setattr(dedup, "_first_matches", lambda classes, *a: seen.append(sorted(r._least for r in classes.collect())) or plain(classes, *a))
    for most in (dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
        monkeypatch.setattr(dedup, "SHINGLES_A_TASK", 1000)
        seen.clear()
        got = {r.id: r.dup_of for r in dedup_near(spark.createDataFrame(rows, "id long, tokens array<string>")).collect() if r.is_near_duplicate}
        assert got == {301 + 2 * i: 300 + 2 * i for i in range(10)}
        assert seen == [list(range(300, 320))]


def test_exact_dedup_and_contamination(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, clean string")
    assert sorted((r.id, r.n_copies) for r in dedup_exact(df).collect()) == [(1, 2), (3, 1)]
    docs = spark.createDataFrame([(1, "x y a b c d e f g z".split()), (2, "a b c q q q".split())], "doc_id long, tokens array<string>")
    items = spark.createDataFrame([(7, "a b c d e f g".split())], "item_id long, tokens array<string>")
    got = [(r.doc_id, r.item_id) for r in contamination(docs, items, n=5).collect()]
    assert got == [(1, 7)]


def test_polarity_csv_and_dispatcher(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_bytes('"4","1","d","q","u","caf\xe9 good"\n"0","2","d","q","u","bad"\n"2","3","d","q","u","meh"\n'.encode("latin-1"))
    df = readers.read_polarity_csv(spark, str(p))
    got = sorted((r.id, r.label, r.text) for r in df.collect())
    assert got == [(1, 1, "café good"), (2, 0, "bad"), (3, 0, "meh")]
    with pytest.raises(ValueError):
        readers.get_data(spark, "nope", str(p))
    with pytest.raises(ValueError):
        readers.get_data(spark, "sentiment140", None)
    split = readers.get_data(spark, "sentiment140", str(p), max_samples=2)
    assert split.count() == 2


def test_polarity_csv_quoting(spark, tmp_path):
    p = tmp_path / "q.csv"
    texts = ['he said "hi", then left', "ends in a backslash \\", "a, b", "é", 'two\nlines', '"']
    with open(p, "w", encoding="latin-1", newline="") as f:
        csv.writer(f, quoting=csv.QUOTE_ALL).writerows([["4", str(i), "d", "q", "u", t] for i, t in enumerate(texts)])
    assert [r.text for r in readers.read_polarity_csv(spark, str(p)).orderBy("id").collect()] == texts


def test_split_doesnt_depend_on_files(spark, tmp_path):
    rows = [(f"text {i % 900}", i % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, "text string, label int")
    found = []
    for n in (1, 7):
        df.repartition(n, F.rand(n)).write.parquet(str(tmp_path / str(n)))
        got = readers.get_data(spark, "tweet_eval", str(tmp_path / str(n)), max_samples=500).collect()
        found.append(sorted((r.text, r.label, r.split) for r in got))
    assert found[0] == found[1] and len(found[0]) == 500



def test_wide_unpivot_and_scrape(spark):
    wide = spark.createDataFrame([(0, "t1", "c1"), (1, "t2", None)], "row_idx long, target string, rival string")
    long = readers.unpivot_wide(wide, ["row_idx"])
    assert sorted((r.product, r.message, r.is_target) for r in long.collect()) == [
        ("rival", "c1", False), ("target", "t1", True), ("target", "t2", True)]
    js = json.dumps({"target": {"name": "X", "posts": ["a", "b"]}, "competitors": {"Y": {"posts": ["c"]}}})
    f = readers.flatten_scrape(spark.createDataFrame([(1, js)], "k long, j string"), "j", ["k"])
    assert sorted((r.product, r.is_target, r.post_idx, r.post) for r in f.collect()) == [
        ("X", True, 0, "a"), ("X", True, 1, "b"), ("Y", False, 0, "c")]


def test_payload_validation(spark):
    good = json.dumps({"stats": {"total": 3, "positive": 1, "negative": 2, "sarcastic": 0, "demographics": {"a": 1},
                                 "sentiment_spectrum": {"Positive": 1}}, "daily_timeline": {}})
    wrong_type = good.replace('"total": 3', '"total": "many"')
    broken = good[:-3]
    missing = json.dumps({"daily_timeline": {}})
    df = spark.createDataFrame([(1, good), (2, wrong_type), (3, broken), (4, missing)], "id long, payload string")
    got = {r.id: r.status for r in sinks.validate_payload(df).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "rejected", 4: "rejected"}


def test_session_store_and_context_log(spark, tmp_path):
    import datetime as dt
    s = sinks.SessionStore(spark, str(tmp_path / "sessions"))
    schema = "product string, ts timestamp_ntz, score double"
    s.append(spark.createDataFrame([("p", dt.datetime(2024, 1, 1), 1.0)], schema))
    s.append(spark.createDataFrame([("p", dt.datetime(2024, 1, 2), 2.0), ("q", dt.datetime(2024, 1, 1), 3.0)], schema))
    assert s.all().count() == 3
    assert {r.product: r.score for r in s.latest().collect()} == {"p": 2.0, "q": 3.0}
    s.clear()
    assert s.all().count() == 0
    c = sinks.ContextLog(spark, str(tmp_path / "ctx"))
    c.append(spark.createDataFrame([(dt.datetime(2024, 1, i), "p") for i in range(1, 13)], "timestamp timestamp_ntz, product string"))
    assert [r.timestamp.day for r in c.last_n(10).collect()] == list(range(12, 2, -1))


def test_session_store_shows_whole_appends_only(spark, tmp_path):
    """An append that breaks off before its manifest doesn't show; of two writers of one version the second tries again."""
    store = sinks.SessionStore(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    store.append(rows(1, 2))
    rows(98, 99).write.parquet(str(tmp_path / "s/parts/broken-off"))
    assert sorted(r.id for r in store.all().collect()) == [1, 2]

    class Slow(sinks.SessionStore):
        def _newest(self):
            found = super()._newest()
            if not getattr(self, "met", False):
                self.met = True
                store.append(rows(3))  # between this writer's look and its manifest
            return found
    Slow(spark, store.path).append(rows(4))
    assert sorted(r.id for r in store.all().collect()) == [1, 2, 3, 4]
    before = store.all()
    store.clear()
    assert sorted(r.id for r in before.collect()) == [1, 2, 3, 4]  # a read that began before
    assert store.all().count() == 0 and store.all().columns == ["id"]
    store.append(rows(5))
    assert [r.id for r in store.all().collect()] == [5]


def test_wide_csv_of_many_products(spark, tmp_path):
    """2,000 columns, read by their header."""
    n = 2000
    path = tmp_path / "wide.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["row_idx", *[f"p{i}" for i in range(n)]])
        for r in range(3):
            out.writerow([r, *[f"r{r}, c{i}" if (i + r) % 2 else "" for i in range(n)]])
    got = readers.read_wide_csv(spark, str(path), ["row_idx"]).collect()
    assert {(r.row_idx, r["product"], r.message) for r in got} == {(str(r), f"p{i}", f"r{r}, c{i}") for r in range(3) for i in range(n) if (i + r) % 2}
    assert {r["product"] for r in got if r.is_target} == {"p0"}
