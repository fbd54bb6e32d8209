"""Resampling documents towards a target distribution by hashed features.

Features are runs of consecutive words; a feature's bucket is the CRC-32 of its
bytes modulo the number of buckets. Each bucket's gain is the log ratio of its
share in the target to its share in the documents; a document's weight is the
mean gain of its features, and Gumbel noise from a hash of its id makes the
highest scores a weighted sample without replacement.

CRCs are taken for many features at once. In a block of text words get codes
and runs of words become tuples of codes; the distinct ones are grouped by
their length in bytes, and a group is a matrix of bytes with one feature a row.
A CRC register per row is updated column by column, by one table look-up for
the whole column; the buckets are scattered back to the places of the features.

Scale: two narrow passes over the texts and no shuffle of them. The first
leaves one array of bucket counts a task, the second one narrow row a document.
Gains are one number a bucket, whatever the input. Ranks come from a range
partitioning on (score, id, row): no window spans more than one range, and
ties can't make a range grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_list, checkpoint, no_cycles, read_table, row_slices, shuffle_partitions

BUCKETS, RUN, SEED, PERCENT, MIN_WORDS = 10_000, 2, 7, 25, 20
BLOCK_BYTES = 2 << 20
#: A-Z to a-z; every other byte below 0x80 that is no digit or letter to a space.
_WORDS = bytes(bytes([b]).lower()[0] if bytes([b]).isalnum() or b >= 0x80 else 0x20 for b in range(256))


# --- CRC-32 by columns -------------------------------------------------------

@lru_cache(1)
def _crc_table() -> np.ndarray:
    """The register's change for each low byte, for the reflected polynomial 0xEDB88320."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return x


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes."""
    table, crc = _crc_table(), np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc ^ column).astype(np.uint8)] ^ (crc >> np.uint32(8))
    return ~crc


def crc_of_runs(words: list[bytes], runs: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of `runs` (codes of `words`), the words joined by one space."""
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8)  # every word with a space behind it
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    size, out = sizes[runs], np.zeros(len(runs), np.uint32)
    total = size.sum(axis=1) - 1
    order = np.argsort(total, kind="stable")
    cuts = np.flatnonzero(np.diff(total[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        n = int(total[order[a]])
        step = max(1, (16 << 20) // n)  # a matrix of 16 MB at most, or one row
        for at in range(a, b, step):
            which = order[at:min(at + step, b)]
            rows = np.empty((len(which), n + 1), np.uint8)
            shift = np.cumsum(size[which], axis=1) - size[which]
            for k in range(runs.shape[1]):  # words of one length and place fill one rectangle
                first, lengths = starts[runs[which, k]], size[which, k]
                lot = np.lexsort((shift[:, k], lengths))
                edge = np.flatnonzero((np.diff(lengths[lot], prepend=-1) != 0) | (np.diff(shift[lot, k], prepend=-1) != 0))
                for c, d in zip(edge.tolist(), [*edge[1:].tolist(), len(lot)], strict=False):
                    mine, wide, left = lot[c:d], int(lengths[lot[c]]), int(shift[lot[c], k])
                    rows[mine, left:left + wide] = flat[first[mine][:, None] + np.arange(wide)]
            out[which] = crc_columns(rows[:, :n])
    return out


# --- features of a block of texts --------------------------------------------

def _blocks(texts: list[bytes]) -> Iterator[tuple[list[list[bytes]], int]]:
    """Words of texts, as pieces (index of the first text, words of it and the next ones); a long text comes in pieces of bounded size."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        text, start = text.translate(_WORDS), 0
        while True:
            end = text.find(b" ", start + BLOCK_BYTES)
            end = len(text) if end < 0 else end
            held.append(text[start:end].split())
            size, start = size + end - start, end
            if start < len(text):  # more of the same text: it goes on in the next block
                yield held, first
                held, first, size = [], i, 0
            else:
                break
        if size >= BLOCK_BYTES:
            yield held, first
            held, first, size = [], i + 1, 0
    if held:
        yield held, first


def hashed_features(texts: list[bytes], run: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: index of a text and bucket for every feature, then index of a text and its number of words there."""
    tail: tuple[int, list[bytes]] = (-1, [])  # the last words of a text that goes on in the next block
    for lists, first in _blocks(texts):
        carried = tail[1] if tail[0] == first else []
        code: dict[bytes, int] = {}
        codes = [[code.setdefault(w, len(code)) for w in words] for words in [carried + lists[0], *lists[1:]]]
        counts = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter((c for words in codes for c in words), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(first, first + len(lists)), counts)
        words, docs, found = list(code), [], []
        for n in range(1, run + 1):
            if len(flat) < n:
                break
            runs = np.stack([flat[k:len(flat) - n + 1 + k] for k in range(n)], axis=1)
            inside = of[:len(runs)] == of[n - 1:]
            if carried:  # runs that the block before has counted
                inside[:max(0, len(carried) - n + 1)] = False
            runs, doc = runs[inside], of[:len(inside)][inside]
            if not len(runs):
                continue
            number = runs[:, 0]
            for k in range(1, n):  # a run's number, dense after every word so that it can't outgrow 64 bits
                number = number * len(words) + runs[:, k]
                if k < n - 1:
                    number = np.unique(number, return_inverse=True)[1]
            _, one, place = np.unique(number, return_index=True, return_inverse=True)
            docs.append(doc)
            found.append((crc_of_runs(words, runs[one]) % np.uint32(buckets)).astype(np.int64)[place])
        here = np.arange(first, first + len(lists))
        own = counts - np.where(here == first, len(carried), 0)
        last = carried + lists[0] if len(lists) == 1 else lists[-1]
        tail = (first + len(lists) - 1, last[len(last) - run + 1:] if run > 1 and len(last) >= run else (last if run > 1 else []))
        none = np.zeros(0, np.int64)
        yield np.concatenate(docs) if docs else none, np.concatenate(found) if found else none, here, own


def _bucket_counts(run: int, buckets: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        with no_cycles():
            for part in row_slices(batches, "text", BLOCK_BYTES):
                for _, found, _, _ in hashed_features(binary_list(part.column("text")), run, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])
    return go


def _weigh(run: int, gains: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            for part in row_slices(batches, "text", BLOCK_BYTES):
                sums, features, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for doc, found, here, own in hashed_features(binary_list(part.column("text")), run, len(gains)):
                    np.add.at(sums, doc, gains[found])
                    features += np.bincount(doc, minlength=part.num_rows)
                    np.add.at(words, here, own)
                weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
                yield pa.record_batch([part.column("rest"), pa.array(features), pa.array(words), pa.array(weight)], names=["rest", "n_features", "n_words", "weight"])
    return go


# --- the operator ------------------------------------------------------------

def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of the column `text`: one number a bucket."""
    found = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_bucket_counts(run, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[row.bucket] = row.n
    return out


def bucket_gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the documents'), one added to each bucket."""
    above = (target + 1).astype(float) * float(docs.sum() + len(docs))
    below = (docs + 1).astype(float) * float(target.sum() + len(target))
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, keep: list[str], run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep` of `docs`, and n_features, n_words, weight, by the texts of `target`."""
    gains = bucket_gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    slim = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"))
    schema = slim.select("rest", *[F.lit(0).cast("long").alias(c) for c in ("n_features", "n_words", "weight")]).schema
    return slim.select("text", "rest").mapInArrow(_weigh(run, gains), schema).select("rest.*", "n_features", "n_words", "weight")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_features, weight, score, rank), a row per row of `docs`; rank is null for those not drawn.

    Both tables have a column `text`; null counts as empty, with no
    features and weight 0. Of the N documents of at least `min_words` words
    the floor(percent * N / 100) highest scores are drawn, ties to the
    smaller id, null ids last, then in any order (rows that repeat an id
    have the same noise). A null id is hashed as ''. Without target texts
    all gains follow from the added ones. No rows: no rows. Other columns
    don't matter.
    """
    spark = docs.sparkSession
    scored = weigh(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), "text"), target, ["id"], run, buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = checkpoint(scored.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= min_words
    n = scored.where(enough).count()
    drawn = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    # a range's rows stand next to each other in the order; its number is kept with them
    ranges = checkpoint(scored.where(enough).repartitionByRange(shuffle_partitions(spark), *order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = ranges.join(before, "range").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(rest.select(columns))


def query(spark, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _crc_literals() -> str:
    return ", ".join(str(int(x)) for x in _crc_table())


def _features(table: str, key: str) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""SELECT {key} AS id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT {key}, {words} AS w FROM {table})"""


SQL = f"""
WITH d AS MATERIALIZED ({_features('documents', 'doc_id')}), b AS MATERIALIZED ({_features('benchmark', 'item_id')}),
o AS MATERIALIZED (SELECT f, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t
      FROM (SELECT unnest(f) AS f, FALSE AS target FROM d UNION ALL SELECT unnest(f), TRUE FROM b) GROUP BY f),
x AS (SELECT f, s, t, hex(encode(f)) AS x FROM o),
c AS MATERIALIZED (SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i::BIGINT + 1, 2))::BIGINT)),
      lambda r, y: xor(r >> 8, [{_crc_literals()}][(xor(r, y) & 255) + 1]::BIGINT)), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM x),
n AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((sum(c.t) + 1)::DOUBLE * (any_value(n.s) + {BUCKETS})::DOUBLE / ((sum(c.s) + 1)::DOUBLE * (any_value(n.t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM c, n GROUP BY bucket),
k AS (SELECT u.id, sum(gain) AS total, count(*) AS n FROM (SELECT id, unnest(f) AS f FROM d) u JOIN c ON c.f = u.f JOIN g ON g.bucket = c.bucket GROUP BY u.id),
w AS (SELECT d.id, coalesce(k.n, 0) AS n_features, len(d.w) AS n_words, coalesce(floor(k.total::DOUBLE / k.n), 0)::BIGINT AS weight FROM d LEFT JOIN k ON k.id = d.id),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM z WHERE n_words >= {MIN_WORDS})
SELECT z.id AS doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r ON r.id = z.id
"""
