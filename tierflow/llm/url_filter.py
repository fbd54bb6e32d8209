"""URL filters by a sort-merge range join (DataFrame functions only).

A canonical key is the host's labels reversed, a separator, then the path:
``example.net`` + ``/en/`` gives ``net.example<sep>/en/``. A rule fits every
key that it is a prefix of, so in key order each rule is an interval and the
intervals nest. A url has one key per host suffix (itself and each parent
domain), because a path rule of a domain holds for its subdomains too.

The sweep sorts rule starts and url keys together inside a shard. Every rule
start carries the stack of rules open at that point (itself and its enclosing
rules, innermost first); the last start at or before a key holds all rules
that can still be open there, and those whose interval the key has not left
are the ones that are prefixes of it. The first of them is the answer.

Scale: urls are reduced to distinct (host, path) pairs first, so a hot url is
one row; pairs are dealt over shards by hash, so a hot host spreads; the rule
starts, a parameter table, are repeated once per shard.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, shuffle_partitions

SEP = "\u0001"
#: (verdict, host, path) of the contract's query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(SEP), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule (verdict, host, path) its key and the stack of rules open at its start, innermost first.

    Of rules with one host and path, ``block`` wins. Rules with a null part
    are left out.
    """
    own = (rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
           .dropna().groupBy("h", "p").agg(F.max("v").alias("v"))
           .select(_rule_key(F.col("h"), F.col("p")).alias("key"), F.concat("h", "p").alias("rule"), "v"))
    heads = own.select(F.col("key").alias("of"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("of", F.expr("substring(of, 1, n)").alias("key"))
    return (heads.join(own, "key")
            .groupBy("of").agg(F.sort_array(F.collect_list(F.struct((-F.length("key")).alias("n"), "key", "rule", "v"))).alias("stack"))
            .withColumnRenamed("of", "key"))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", shards: int | None = None) -> DataFrame:
    """Columns of `urls` kept, plus host, path, rule, verdict.

    The fitting rule with the longest host + path wins (of equals the one
    with the longer host). Without a fitting rule: rule null, verdict
    `default`. Null url: host and path empty. Repeated rows stay repeated.
    A column of `urls` with the name of an output column is replaced.
    """
    shards = shards or shuffle_partitions(urls.sparkSession)
    host, path = host_and_path(F.col(url_col))
    keep = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parted = urls.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))

    labels = F.split("host", r"\.")
    keyed = (parted.select("host", "path").distinct()
             .select("host", "path", F.reverse(labels).alias("labels"), F.pmod(F.xxhash64("host", "path"), F.lit(shards)).cast("int").alias("shard"))
             .select("host", "path", "shard", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
             .select("host", "path", "shard", F.concat(F.array_join(F.slice("labels", 1, F.col("n")), "."), F.lit(SEP), "path").alias("key")))
    stacks = rule_stacks(rules)
    stack_type = stacks.schema["stack"].dataType
    starts = stacks.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "key", F.lit(0).alias("kind"), "stack")
    points = keyed.select("host", "path", "shard", "key", F.lit(1).alias("kind"), F.lit(None).cast(stack_type).alias("stack"))
    sweep = Window.partitionBy("shard").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_rules = (starts.unionByName(points).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
                  .where("kind = 1 and stack is not null")
                  .select("host", "path", F.expr("filter(stack, r -> startswith(key, r.key))").alias("fits")).where("size(fits) > 0")
                  .select("host", "path", F.col("fits")[0].alias("r")))
    best = (open_rules.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("r.rule"), F.locate(SEP, F.col("r.key")), F.col("r.rule").alias("rule"), F.col("r.v").alias("v"))).alias("r"))
            .select("host", "path", F.col("r.rule").alias("rule"), F.col("r.v").alias("v")))
    return (parted.join(best, ["host", "path"], "left")
            .select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, literal_rows(spark, RULES, "verdict string, host string, path string")).drop("url")


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{_UP}', '{_LOW}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, '.' || host AS dotted FROM c)
SELECT page_id, host, path,
  CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'allow'
       WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'block'
       WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'allow'
       WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""
