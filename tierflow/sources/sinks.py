"""Sinks (S7-S12): CSV, JSON payloads with validation, append-only session
history and context log. Stores live under a folder the caller names (on a
cluster: the shared folder, e.g. next to ``spark.checkpoint.dir``)."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.topk import topk_per_group


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True, encoding: str = "UTF-8", null_value: str = "") -> None:
    """No index column; quotes doubled, blanks kept."""
    (df.write.mode(mode).option("header", header).option("encoding", encoding).option("quote", '"').option("escape", '"')
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("nullValue", null_value).csv(path))


def build_payload(tagged: DataFrame, target: str | None = None, product_col: str = "product") -> DataFrame:
    """One JSON document per product: target product, stats, demographics
    map, spectrum map and daily timeline map, keys in order.

    Posts are read once, into counts by all label columns (bounded domains:
    labels, buckets, days); every number comes from that table. Posts
    themselves stay out of the document: they are rows.
    """
    day = F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("unknown"))
    table = tagged.groupBy(product_col, "demographic", "spectrum_bucket", day.alias("day"), "sentiment", "sarcasm").agg(F.count(F.lit(1)).alias("n"))
    when = lambda c: F.when(c, F.col("n")).otherwise(F.lit(0))
    pos, neg, sar = F.col("sentiment") == "positive", F.col("sentiment") == "negative", F.col("sarcasm") == "SARCASM"
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("demo", "demographic"), ("spec", "spectrum_bucket"), ("day", "day"))])
    parts = (table.select(product_col, "n", when(pos).alias("p"), when(neg).alias("g"), when(sar).alias("s"), when(sar & pos).alias("sp"),
                          when(sar & neg).alias("sn"), F.explode(kinds).alias("k"))
             .groupBy(product_col, "k.kind", "k.key").agg(*[F.sum(c).alias(c) for c in ("n", "p", "g", "s", "sp", "sn")]))
    of = lambda kind, value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", value.alias("v"))))))
    total = lambda c: F.sum(F.when(F.col("kind") == "day", F.col(c)))
    whole = parts.groupBy(product_col).agg(
        total("n").alias("total"), total("p").alias("positive"), total("g").alias("negative"), total("s").alias("sarcastic"),
        total("sp").alias("sarcastic_to_positive"), total("sn").alias("sarcastic_to_negative"),
        of("demo", F.col("n")).alias("demographics"), of("spec", F.col("n")).alias("sentiment_spectrum"),
        of("day", F.struct(F.col("p").alias("positive"), F.col("g").alias("negative"), F.col("n").alias("total"))).alias("daily_timeline"))
    payload = F.to_json(F.struct(
        F.lit(target).alias("_target_product"),
        F.struct("total", "positive", "negative", "sarcastic", "sarcastic_to_positive", "sarcastic_to_negative", "demographics", "sentiment_spectrum").alias("stats"),
        F.col("daily_timeline")))
    return whole.select(product_col, payload.alias("payload"))


PAYLOAD_SCHEMA = T.StructType([
    T.StructField("_target_product", T.StringType()),
    T.StructField("stats", T.StructType([
        T.StructField("total", T.LongType()), T.StructField("positive", T.LongType()),
        T.StructField("negative", T.LongType()), T.StructField("sarcastic", T.LongType()),
        T.StructField("sarcastic_to_positive", T.LongType()), T.StructField("sarcastic_to_negative", T.LongType()),
        T.StructField("demographics", T.MapType(T.StringType(), T.LongType())),
        T.StructField("sentiment_spectrum", T.MapType(T.StringType(), T.LongType()))])),
    T.StructField("daily_timeline", T.MapType(T.StringType(), T.StructType([
        T.StructField("positive", T.LongType()), T.StructField("negative", T.LongType()),
        T.StructField("total", T.LongType())]))),
    T.StructField("_corrupt", T.StringType()),
])
REQUIRED = ["stats", "stats.total", "daily_timeline"]


def validate_payload(df: DataFrame, json_col: str = "payload", schema: T.StructType = PAYLOAD_SCHEMA,
                     required: list[str] = REQUIRED) -> DataFrame:
    """Parse permissively; broken JSON / wrong types land in the corrupt
    column, and missing required keys are checked explicitly (PERMISSIVE
    parsing does not flag them). Adds ``status`` accepted / rejected."""
    p = df.withColumn("_p", F.from_json(F.col(json_col), schema,
                                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    for r in required:
        ok = ok & F.col(f"_p.{r}").isNotNull()
    return p.withColumn("status", F.when(ok, "accepted").otherwise("rejected")).drop("_p")


class SessionStore:
    """Append-only session history.

    An append writes its rows to a folder of their own and then a manifest,
    one row that lists the folders the history consists of from now on;
    ``clear`` is a manifest without folders. A read goes by the newest
    manifest, so neither an append that broke off nor one under way shows.
    Manifests are numbered, and a number can be written once: of two
    appends at one time the later one reads the new manifest and tries again.
    """

    _MANIFEST = "version long, parts array<string>, columns string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _newest(self):
        try:
            return self.spark.read.schema(self._MANIFEST).parquet(os.path.join(self.path, "manifests", "*")).orderBy(F.col("version").desc()).first()
        except AnalysisException:  # nothing was ever appended
            return None

    def _commit(self, parts, columns: str, tries: int = 20) -> None:
        """Writes the next manifest; ``parts`` gives its folders from those of the one before."""
        for left in reversed(range(tries)):
            newest = self._newest()
            version = newest["version"] + 1 if newest else 1
            listed = parts(newest["parts"] if newest else [])
            row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.array(*map(F.lit, listed)).cast("array<string>").alias("parts"), F.lit(columns).alias("columns"))
            try:
                row.write.mode("error").parquet(os.path.join(self.path, "manifests", f"{version:09d}"))
                return
            except AnalysisException:  # another writer took the number
                if not left:
                    raise

    def append(self, sessions: DataFrame) -> None:
        part = uuid.uuid4().hex
        sessions.write.parquet(os.path.join(self.path, "parts", part))
        self._commit(lambda before: [*before, part], sessions.schema.json())

    def all(self) -> DataFrame:
        """The whole history; AnalysisException if nothing was ever appended."""
        newest = self._newest()
        if newest is None:
            return self.spark.read.parquet(os.path.join(self.path, "parts"))
        schema = T.StructType.fromJson(json.loads(newest["columns"]))
        if not newest["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.path, "parts", p) for p in newest["parts"]])

    def latest(self, key: str = "product", order: str = "ts") -> DataFrame:
        """The newest row of each key (ties: the greatest row)."""
        d = self.all()
        cols = [c for c in d.columns if c != key]
        newest = d.groupBy(key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("_s"))
        return newest.select(key, *[F.col(f"_s.`{c}`").alias(c) for c in cols])

    def clear(self) -> None:
        """An empty history of the same columns (no-op if absent)."""
        newest = self._newest()
        if newest is not None:
            self._commit(lambda before: [], newest["columns"])


class ContextLog(SessionStore):
    """{timestamp, product, competitor_names, summary_stats} records."""

    def last_n(self, n: int = 10, order: str = "timestamp") -> DataFrame:
        return self.all().orderBy(F.col(order).desc()).limit(n)

    def last_n_by(self, key: str, n: int, order: list[Column], chunk: Column) -> DataFrame:
        """The last n records of each key; ranked within (key, chunk) first, so a hot key is not one task."""
        return topk_per_group(self.all(), [key], order, n, chunk=chunk)
