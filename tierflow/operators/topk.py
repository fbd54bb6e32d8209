"""Top-k per group without ranking a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                   chunk: Column | None = None, chunk_buckets: int = 64, out_rank: str | None = None) -> DataFrame:
    """Rows ranked 1..k within each group by ``order``.

    Phase 1 keeps the top k inside each (group, chunk); phase 2 ranks the at
    most k x chunks survivors per group. Exact: a global top-k row is also
    top-k within its chunk. ``chunk`` defaults to a hash bucket of the row.
    """
    if chunk is None:
        chunk = F.pmod(F.xxhash64(*df.columns), F.lit(chunk_buckets))
    x = df.withColumn("_ck", chunk)
    w1 = Window.partitionBy(*group, "_ck").orderBy(*order)
    x = x.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_ck")
    w2 = Window.partitionBy(*group).orderBy(*order)
    x = x.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= k)
    return x.withColumnRenamed("_r2", out_rank) if out_rank else x.drop("_r2")
