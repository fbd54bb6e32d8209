"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights per dimension (the term). In a
block of candidates every dimension has a posting list (row, weight). A query
row scatters, term by term, its weight times the posting weights into a dense
score array over the block; a partition selection keeps the block's k best,
and a final merge over blocks keeps the k best of all.

Work is a grid of (candidate block, query block) cells of bounded size, so no
side is broadcast and no cell grows with the data: the number of cells does.
Queries are a stated set against all rows, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

RESULT = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 1024.0) -> DataFrame:
    """(vec_id, terms): each component x as floor(scale * x), x as double.

    Rows with a null id, a null vector, or a null or non-finite component are
    left out. Rows that share an id count once (with differing vectors: the
    largest in array order). Results beyond the long range saturate.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(fine)
            .groupBy("vec_id").agg(F.max("x").alias("x"))
            .select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("terms")))


def _postings(table: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids in ascending order, and per term the rows that hold it with their weights."""
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    terms = table["terms"].combine_chunks()
    ends, weights = terms.offsets.to_numpy(), terms.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    rows = np.repeat(rank, lengths)
    term = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], lengths)
    weights = weights[ends[0]:ends[-1]]
    held = weights != 0
    rows, term, weights = rows[held], term[held], weights[held]
    by = np.lexsort((rows, term))
    rows, term, weights = rows[by], term[by], weights[by]
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    lists = {int(term[a]): (rows[a:b], weights[a:b]) for a, b in zip(cuts, [*cuts[1:], len(term)], strict=False)}
    return ids[order], lists


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; `ids` ascend."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        keep = np.concatenate([above, np.flatnonzero(scores == kth)[:k - len(above)]])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))]


def _cell(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _ARROW.empty_table()
        ids, lists = _postings(candidates)
        out: list[tuple] = []
        for query_id, row in zip(queries["vec_id"].to_pylist(), queries["terms"].to_pylist(), strict=True):
            scores = np.zeros(len(ids), np.int64)
            for term, w in enumerate(row):
                if w and term in lists:
                    rows, weights = lists[term]
                    if len(rows) == len(ids):  # every row holds the term: the scatter is the whole array
                        scores += w * weights
                    else:
                        scores[rows] += w * weights
            at = np.searchsorted(ids, query_id)
            if at < len(ids) and ids[at] == query_id:  # not the query's own row
                other, rest = np.delete(ids, at), np.delete(scores, at)
            else:
                other, rest = ids, scores
            keep = best(other, rest, k)
            out.append((np.full(len(keep), query_id), other[keep], rest[keep]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_ARROW)
    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
          candidate_block: int = 16384, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): per query its k highest inner products over all other rows.

    `is_query` is a condition on the column vec_id. Which vectors take part:
    see integer_vectors; a missing term counts as zero. Without rows, or
    without queries, the result is empty; a query without candidates has no
    row.
    """
    base = checkpoint(integer_vectors(vectors, id_col, vec_col))
    n, m = base.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, sets = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    block = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    cand = base.select("vec_id", "terms", block(blocks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("q"))
    quer = base.where(is_query).select("vec_id", "terms", block(sets).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"))
    found = cand.groupBy("c", "q").cogroup(quer.groupBy("c", "q")).applyInArrow(_cell(k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS t FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
