"""URL rules and top-k search against brute force."""
import math
import random

from pyspark.sql import functions as F

from tierflow.llm import topk, url_filter
from tierflow.llm.common import literal_rows


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    raw = rest
    for c in "/?#":
        raw = raw.split(c, 1)[0]
    path = rest[len(raw):].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), path


def judge(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return best[2], best[3]


RULES = [*url_filter.RULES, ("block", "a.example.net", "/en/x"), ("allow", "com", ""), ("block", "com", "/"), ("allow", "a.b", "/q/"), ("block", "b", "/q/rr")]


def test_rules(spark):
    rnd = random.Random(1)
    hosts = ["example.net", "A.example.NET", "xexample.net", "org", "q.org", "a.b.example.com", "com", "a.b", "z.a.b", "", "net:80", "net.", "É.net", ".net"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/fr/1", "/de/2?x=/fr/", "/q/rr/s", "/q/", "?a=/", "#/en/", "//en/"]
    urls = [f"{rnd.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/net/", "http://net/a://b", "x\n://org/fr/\n2"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[5]), (3, urls[3]), (3, urls[3])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("Host", F.lit(2))
    rules = literal_rows(spark, [*RULES, ("block", None, "/"), ("allow", "net", "/")], "verdict string, host string, path string")
    got = url_filter.judge_urls(df, rules, shards=3)
    assert got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    want = sorted((str(i), *plain_url(u), *map(str, judge(*plain_url(u), RULES))) for i, u in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == want


def test_without_rows_or_rules(spark):
    urls = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    none = literal_rows(spark, [], "verdict string, host string, path string")
    some = literal_rows(spark, url_filter.RULES, "verdict string, host string, path string")
    assert [r.verdict for r in url_filter.judge_urls(urls, none).collect()] == ["allow"]
    assert url_filter.judge_urls(urls.limit(0), some).count() == 0


def test_top_k(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, rnd.uniform(-1, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)]  # ties
    odd = [(430, None), (431, [0.1, None]), (432, [math.nan] * 6), (433, [math.inf] * 6), (None, [1.0] * 6), (500, [0.3]), (7, rows[7][1]), (600, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("q", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=10, candidate_block=64, query_block=3).collect()
    floats = {r.vec_id: r.embedding for r in df.select("vec_id", "embedding").collect()}
    ints = {i: [math.floor(1024 * x) for x in floats[i]] for i in [*range(430), 500, 600]}
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") > 5).count() == 0
    zeros = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(zeros, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]
