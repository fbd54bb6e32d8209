"""Count-cell ranking against a term-by-term version with Python's integers."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tierflow.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, min_docs=3, ranks=200):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for lang, source, text in rows]
    groups = sorted({(g, s) for g, s, _ in docs})
    out = []
    for lang in {g for g, _ in groups}:
        mine = [(s, terms) for g, s, terms in docs if g == lang]
        kept = [t for t in {t for _, terms in mine for t in terms} if sum(t in terms for _, terms in mine) >= min_docs]
        count = {s: {t: sum(terms.count(t) for x, terms in mine if x == s) for t in kept} for s in {s for s, _ in mine}}
        whole = {t: sum(c[t] for c in count.values()) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(c) for s, c in count.items()}
        for s in count:
            pairs = [(-sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept), x.encode(), x) for x in count if x != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", x, -v, n + 1) for n, (v, _, x) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


def rows_of(n=150, seed=1):
    rnd = random.Random(seed)
    words = ["The", "the", "é", "É", "日本", "zäh", "a", "b", "\U0001f600", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s1", "", "ü"]), " ".join(rnd.choice(words[: rnd.randrange(3, 35)]) for _ in range(rnd.randrange(0, 25)))) for _ in range(n)]
    return rows + [("en", "none", None), ("en", "none2", "1 2 3"), ("xx", "s", "rare"), ("xx", "t", "rare"), ("solo", "s", "a a a-b_c"), ("en", "s1", "the@the`the{the\x7fthe")] + [("en", "s2", "copy copy of")] * 5


def frame_of(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    return df.withColumn("term", F.lit("x")).withColumn("n", F.lit(5)).withColumn("rank", F.lit(1))


@pytest.mark.parametrize(("min_docs", "ranks", "held"), [(3, 200, 250_000), (2, 4, 20), (1, 7, 1)])
def test_against_term_by_term(spark, monkeypatch, min_docs, ranks, held):
    rows = rows_of()
    monkeypatch.setattr(dv, "HELD", held)
    got = dv.audit(frame_of(spark, rows).repartition(4), min_docs, ranks)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(map(tuple, got.collect())) == plain(rows, min_docs, ranks)


def test_equal_values_merge_across_cells(spark):
    """Many terms with one pair of counts, far beyond the ranks asked for: the first in UTF-8 order are listed."""
    terms = [a + b for a in "aké日" for b in "abcdefghijklmnopqrstuvwxyzäö"]
    rows = [("en", "s1", " ".join(terms))] * 3 + [("en", "s2", "other")] * 3
    got = dv.audit(frame_of(spark, rows), ranks=5).collect()
    assert sorted(map(tuple, got)) == plain(rows, ranks=5)
    assert [r.item for r in sorted(got, key=lambda r: r["rank"]) if r.part == "term" and r.source == "s1"] == sorted(terms, key=str.encode)[:5]


def test_no_rows_and_no_terms(spark):
    assert dv.audit(frame_of(spark, rows_of()).limit(0)).count() == 0
    rows = [("en", "a", None), ("en", "b", "once"), ("fr", "a", "")]
    assert sorted(map(tuple, dv.audit(frame_of(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_text_in_pieces(monkeypatch):
    text = ("Wörter und " * 1000).encode()
    whole = [w for words in dv.terms_of(text) for w in words]
    monkeypatch.setattr(dv, "PIECE", 7)
    assert [w for words in dv.terms_of(text) for w in words] == whole == "wörter und".encode().split() * 1000
    assert list(dv.terms_of(b"")) == []


def test_large_counts_stay_exact(spark):
    one = spark.range(1).select(dv._share(F.lit(9 * 10**11), F.lit(10**13), F.lit(10**9)).alias("p")).first().p
    assert one == 1 + 10**9 * (9 * 10**11 + 1) // (10**13 + 10**9)
