"""Sampling and splitting.

Row choice depends on (seed, id) only: rows are ordered by md5(seed:id)
then id, so the same seed picks the same rows on any partitioning. Ranks
come from the bucketed exact rank (no window spans a whole class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import exact_hash_rank


def _h(seed, id_col: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sample_exact(df: DataFrame, n: int | None, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement; n falsy = no cap."""
    x = df.withColumn("_h", _h(seed, id_col))
    if n:
        # rows beyond the hash bucket in which the n-th falls never move: bucket counts (65,536 at most) tell it
        bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
        so_far = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        last = (df.select(_h(seed, id_col).alias("_h")).groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_s", so_far).where(F.col("_s") >= n).agg(F.min("_b")))
        x = x.where(bucket <= F.coalesce(last.scalar(), F.lit(65535)))
    r = exact_hash_rank(x, [], "_h", id_col, out="sample_rank")
    if n:
        r = r.filter(F.col("sample_rank") <= n)
    return r.drop("_h")


def split_stratified(df: DataFrame, label_col: str = "label", test_size: float = 0.20, seed: int = 42,
                     id_col: str = "id") -> DataFrame:
    """Per class, the round(n_class * test_size) first rows by hash are 'test'."""
    x = df.withColumn("_h", _h(seed, id_col))
    r = exact_hash_rank(x, [label_col], "_h", id_col, out="_r")
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(sizes, label_col, "inner")
    k = F.round(F.col("_n") * F.lit(test_size))
    return r.withColumn("split", F.when(F.col("_r") <= k, F.lit("test")).otherwise(F.lit("train"))) \
            .drop("_h", "_r", "_n")


def split_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Sizes and positive ratio per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label_col).cast("double")).alias("pos_ratio"))


def polarity_binarise(df: DataFrame, col: str = "polarity") -> DataFrame:
    """label = (polarity == 4); 2 also maps to 0 as in the reference."""
    return df.withColumn("label", (F.col(col) == 4).cast("int"))


def three_class_binarise(df: DataFrame, col: str = "label") -> DataFrame:
    """Keep 0 and 2, map 2 -> 1, drop neutral (1)."""
    return df.filter(F.col(col).isin(0, 2)).withColumn(col, F.when(F.col(col) == 2, 1).otherwise(0).cast("int"))
