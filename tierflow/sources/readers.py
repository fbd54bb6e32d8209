"""Sources (S1-S6, S13): explicit schemas, no inference.

Every loader returns the labelled-text schema (id LONG, text STRING,
label INT) so downstream operators do not care where rows came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import exact_hash_rank
from ..operators.split import polarity_binarise, sample_exact, split_stratified, three_class_binarise

POLARITY_CSV_SCHEMA = T.StructType([
    T.StructField("polarity", T.IntegerType()), T.StructField("c1", T.StringType()),
    T.StructField("c2", T.StringType()), T.StructField("c3", T.StringType()),
    T.StructField("c4", T.StringType()), T.StructField("text", T.StringType())])


def read_polarity_csv(spark: SparkSession, path: str, id_col: str = "c1") -> DataFrame:
    """Headerless latin-1 CSV, columns 0 (polarity 0/4) and 5 (text).
    Spark names the charset ISO-8859-1 (it rejects the alias 'latin-1')."""
    df = (spark.read.schema(POLARITY_CSV_SCHEMA).option("header", False).option("quote", '"').option("escape", '"')
          .option("multiLine", True).option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").csv(path))
    df = df.select(F.col(id_col).cast("long").alias("id"), "polarity", "text")
    return polarity_binarise(df)


def read_labelled_text(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "sentence",
                       label_col: str = "label", id_col: str | None = "idx", schema: T.StructType | None = None) -> DataFrame:
    """Binary labelled text from local parquet/json/csv files.

    Without an id column ids come from the content: rows in the order of
    md5(text, label), so they don't depend on files or partitions (equal rows
    are interchangeable)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = r.load(path)
    rows = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), *([F.col(id_col).cast("long").alias("id")] if id_col and id_col in df.columns else []))
    return (rows if "id" in rows.columns else content_ids(rows)).select("id", "text", "label")


def content_ids(rows: DataFrame) -> DataFrame:
    """Adds an id by the order of the rows' content."""
    h = F.md5(F.concat_ws("\u0001", F.coalesce("text", F.lit("\u0002")), F.coalesce(F.col("label").cast("string"), F.lit("\u0002"))))
    return exact_hash_rank(rows.withColumn("_h", h), [], "_h", "text", "id").withColumn("id", F.col("id") - 1).drop("_h")


def read_three_class(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
                     label_col: str = "label", id_col: str | None = "id") -> DataFrame:
    """S3: three-class text (0 neg, 1 neutral, 2 pos) -> binary, neutral dropped."""
    return three_class_binarise(read_labelled_text(spark, path, fmt, text_col, label_col, id_col))


def get_data(spark: SparkSession, source: str = "sst2", path: str | None = None, max_samples: int | None = None,
             test_size: float = 0.20, seed: int = 42, fmt: str = "parquet") -> DataFrame:
    """Dispatcher -> (id, text, label, split). Unknown source or a CSV
    source without a path raise ValueError. ``max_samples`` bounds the labelled
    rows that a model is fitted on; by default there is no bound."""
    readers = {"sst2": lambda: read_labelled_text(spark, path, fmt),
               "tweet_eval": lambda: read_three_class(spark, path, fmt),
               "sentiment140": lambda: read_polarity_csv(spark, path)}
    if source not in readers:
        raise ValueError(f"Unknown source '{source}'. Choose from {sorted(readers)}.")
    if path is None:
        raise ValueError(f"source '{source}' needs a local path (no downloads).")
    df = readers[source]()
    if max_samples:
        df = sample_exact(df, max_samples, seed, "id").drop("sample_rank")
    return split_stratified(df, "label", test_size, seed, "id")


def read_wide_csv(spark: SparkSession, path: str, key_cols: list[str], null_value: str = "") -> DataFrame:
    """CSV with a column per product, the target's first, as long rows; cells with ``null_value`` are none."""
    wide = (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
            .option("nullValue", null_value).csv(path))  # all strings: no inference
    return unpivot_wide(wide, key_cols)


def unpivot_wide(wide: DataFrame, key_cols: list[str]) -> DataFrame:
    """One column per product (the first is the target) -> long rows
    (key.., product, message, is_target); empty cells dropped."""
    products = [c for c in wide.columns if c not in key_cols]
    long = wide.unpivot(key_cols, products, "product", "message")
    return long.filter(F.col("message").isNotNull()).withColumn("is_target", F.col("product") == F.lit(products[0]))


SCRAPE_SCHEMA = T.StructType([
    T.StructField("target", T.StructType([T.StructField("name", T.StringType()),
                                          T.StructField("posts", T.ArrayType(T.StringType()))])),
    T.StructField("competitors", T.MapType(T.StringType(), T.StructType([
        T.StructField("posts", T.ArrayType(T.StringType()))]))),
])


def flatten_scrape(df: DataFrame, json_col: str, key_cols: list[str]) -> DataFrame:
    """{target:{name,posts[]}, competitors:{name:{posts[]}}} -> rows
    (key.., product, is_target, post_idx, post)."""
    p = df.select(*key_cols, F.from_json(json_col, SCRAPE_SCHEMA).alias("_s"))
    tgt = p.select(*key_cols, F.col("_s.target.name").alias("product"), F.lit(True).alias("is_target"),
                   F.posexplode("_s.target.posts").alias("post_idx", "post"))
    comp = p.select(*key_cols, F.explode("_s.competitors").alias("product", "_c")) \
            .select(*key_cols, "product", F.lit(False).alias("is_target"), F.posexplode("_c.posts").alias("post_idx", "post"))
    return tgt.unionByName(comp)

