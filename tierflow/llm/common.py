"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, read_table

__all__ = ["binary_list", "checkpoint", "checkpoint_placed", "ids_and_texts", "lean", "literal_rows", "no_cycles", "read_table", "row_slices", "shuffle_partitions"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that spark.checkpoint.dir names."""
    return cut_lineage(df)


def checkpoint_placed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that keeps its partitioning and order, so that later joins on them don't move its rows.

    Adaptive execution forgets both, so this one plan runs without it.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text), null text as empty: extra columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def literal_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small parameter table as a plan of literals (no Python, no RDD)."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    rows = list(rows)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def binary_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, without a decode."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def row_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about `most_bytes` of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a function over Arrow batches, that gives free memory back to the system when it ends.

    Spark keeps Python workers from task to task, and the allocators of
    Arrow and C keep what a task has freed: without this a worker stays as
    large as its largest task.
    """
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)
    return tidy


@contextmanager
def no_cycles():
    """Without the collector of reference cycles, which walks millions of live objects again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
