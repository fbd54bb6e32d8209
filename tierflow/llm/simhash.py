"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in SEGMENTS consecutive segments on a ring. If two
fingerprints differ in at most MAX_BITS bits, there is a segment to start from
such that every chain of l consecutive segments from it differs in at most
l * MAX_BITS / SEGMENTS bits (rounded down). For 2 bits and 3 segments: the
first segment is equal, the first two differ in at most 1 bit, all three in
at most 2. The chain of two is looked up by key: each fingerprint stands under
(start, first, second segment) and probes that key with one unset bit of the
second segment set (of two fingerprints that differ there, one has it unset).
What shares a key has passed the chain of two; the full Hamming check follows.

Scale: documents are reduced to distinct fingerprints (exact copies, however
many, are one row) before any pair is formed. A key held by more than HOT
fingerprints is not paired up: its members are dealt anew under every
fingerprint within one bit of theirs. Two of them are at most two bits apart
just when they share such a neighbour, so linking each to the least holder of
the neighbour finds the same components exactly, with 65 rows a member
instead of the square of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import binary_list, checkpoint, ids_and_texts, lean, no_cycles
from .components import connected

SHINGLE = 3
MAX_BITS = 2
#: First bit (from the lowest) and width of each segment.
SEGMENTS = [(0, 21), (21, 21), (42, 22)]
HOT = 64
SEED = 42

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's word shingles (ASCII lower case, ASCII white space); 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_digest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-shingle] + 1)
        hashes = [xxh64_digest(text[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist(), strict=True)]
    counts = np.zeros(2048, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.frombuffer(b"".join(hashes[i:i + (1 << 16)]), np.uint8).reshape(-1, 8)
        counts += np.bincount((part + _COLUMN).ravel(), minlength=2048)
    set_bits = (counts.reshape(8, 256) @ _BITS).ravel()  # highest bit first
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), one row per row of `docs`; null text as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            for batch in batches:
                found = [fingerprint(t, shingle) for t in binary_list(batch.column("text"))]
                yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])
    return ids_and_texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    low, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _with_one_more(key: Column, segment: Column, width: int) -> Column:
    """The key, whose low bits are `segment`, with each unset bit of the segment set in turn."""
    unset = F.filter(F.array(*[F.lit(b) for b in range(width)]), lambda b: segment.bitwiseAND(_bit(b)) == 0)
    return F.transform(unset, lambda b: key.bitwiseOR(_bit(b)))


def _chains(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holders (key, fp), three a fingerprint, and probes (key, fp): the chain of two segments from each start."""
    holders, probes = [], []
    for i in range(len(SEGMENTS)):
        first, second = _segment(F.col("fp"), i), _segment(F.col("fp"), i + 1)
        key = F.lit(i << 44).bitwiseOR(F.shiftleft(first, 22)).bitwiseOR(second)
        holders.append(key)
        probes.append(_with_one_more(key, second, SEGMENTS[(i + 1) % len(SEGMENTS)][1]))
    return (fps.select(F.explode(F.array(*holders)).alias("key"), "fp"),
            fps.select(F.explode(F.concat(*probes)).alias("key"), "fp"))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fps` (fp); their components are those of all pairs at most MAX_BITS apart."""
    holders, probes = _chains(fps)
    crowded = holders.groupBy("key").count().where(F.col("count") > hot).select("key")
    few = holders.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("u"))
    others = holders.select("key", F.col("fp").alias("v"), F.lit(False).alias("probe")).unionByName(probes.select("key", F.col("fp").alias("v"), F.lit(True).alias("probe")))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    pairs = few.join(others, "key").where(near & (F.col("probe") | (F.col("u") < F.col("v")))).select("u", "v")

    members = holders.unionByName(probes).join(crowded, "key", "left_semi").select("fp").distinct()
    around = F.transform(F.array(*[F.lit(b) for b in range(64)]), lambda b: F.col("fp").bitwiseXOR(_bit(b)))
    balls = members.select(F.explode(F.concat(F.array("fp"), around)).alias("ball"), "fp")
    least = balls.groupBy("ball").agg(F.min("fp").alias("v"))
    spread = balls.join(least, "ball").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(spread)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id, component), one row per row of `docs`.

    fingerprint: 16 hex digits; component: one fingerprint that names the
    component. component_id: the smallest doc_id reachable
    over links of at most MAX_BITS bits, the row's own included. Null and
    empty texts, and texts of white space, have fingerprint zero and link
    like any other. Rows with a null id link too; component_id is null where
    no row of a component has an id. Repeated rows stay repeated; other
    columns don't matter.
    """
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(whole, "root").select("fp", "component_id", "root")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return marked.join(of_fp, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("root").alias("component"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, all columns as they are: the row with the smallest id.

    Of rows that share that id, one stays. In a component without an id, one
    row with the smallest text stays.
    """
    found = components(docs, id_col, text_col, shingle)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    heads = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    # the rows of one id: as a rule, one
    among = Window.partitionBy("id").orderBy(F.xxhash64("t", *[F.col(f"row.`{c}`") for c in docs.columns]))
    named = rows.join(heads, "id", "left_semi").withColumn("n", F.row_number().over(among)).where("n = 1").select("row")
    # components without an id: their rows are told apart by text
    bare = rows.where("id is null").select(F.xxhash64("t").alias("doc_id"), "t", "row")
    marks = fingerprints(bare.select("doc_id", F.col("t").alias("text")).distinct())
    alone = found.where("component_id is null").select("fingerprint", "component").distinct()
    grouped = marks.join(alone, F.lower(F.lpad(F.hex("fp"), 16, "0")) == F.col("fingerprint")).select("doc_id", "component").distinct()
    least = Window.partitionBy("component").orderBy("t", F.xxhash64("row"))
    nameless = bare.join(grouped, "doc_id").withColumn("n", F.row_number().over(least)).where("n = 1").select("row")
    return named.unionByName(nameless).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return components(read_table(spark, sf_dir, "documents"))
