"""Line deduplication through a sharded minimal perfect hash.

A line's key (stripped, A-Z lower-cased) is known by 128 hash bits. The
distinct keys of the corpus are dealt over shards; in each shard a minimal
perfect hash gives every key its own slot in 0..n-1, and the slot indexes two
compact arrays: a fingerprint of 64 bits and the number of documents that hold
the key. Documents probe the arrays; no line is joined to a line.

The perfect hash is built in rounds: every key left takes a place in a bit
array twice as long as the keys left, places taken once are set, and the keys
of places taken more often go to the next round. A key's slot is the number of
bits set before its own, so the hash needs about three bits a key and the
slots have no gaps.

Documents travel in batches of a few MB that stay where they lie. A batch asks
each shard once, with its distinct keys, and gets one bit a key back; so a line
that a third of all documents hold is one entry a batch, counted before it
moves. Shards grow in number with the lines, so a shard's arrays don't.
Two lines count as one only if all 128 bits agree; a key that isn't in the
index (probing other documents than the indexed) is taken for one that is with
a chance of 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import binary_list, checkpoint, checkpoint_placed, read_table, row_slices, shuffle_partitions

BATCH_BYTES = 4 << 20
SHARD_LINES = 1 << 20
_KEY = np.dtype([("high", "<u8"), ("low", "<u8")])
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Bits set among the values of one byte.
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)

INDEX = "shard int, n long, rounds array<struct<size: long, bits: binary>>, fingerprints binary, width int, counts binary"
_INDEX = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("rounds", pa.list_(pa.struct([("size", pa.int64()), ("bits", pa.binary())]))),
                    ("fingerprints", pa.binary()), ("width", pa.int32()), ("counts", pa.binary())])
_ASKED = "shard int, batch long, keys binary, counts binary"


# --- the perfect hash of one shard -------------------------------------------

def _places(keys: np.ndarray, turn: int, size: int) -> np.ndarray:
    """Where keys fall in the bit array of a round: another hash of both halves each time."""
    x = (keys["low"] ^ (keys["high"] + _U(turn * int(_MIX[0]) % 2**64))) * _MIX[1]
    x ^= x >> _U(29)
    x *= _MIX[0]
    x ^= x >> _U(32)
    return (x % _U(size)).astype(np.int64)


def build_rounds(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(size, packed bits) per round, for distinct keys; ends when every key has a place of its own."""
    rounds: list[tuple[int, np.ndarray]] = []
    while len(keys):
        size = 2 * len(keys) + 6
        at = _places(keys, len(rounds), size)
        taken = np.bincount(at, minlength=size) == 1
        rounds.append((size, np.packbits(taken)))
        keys = keys[~taken[at]]
    return rounds


def slots(rounds: list[tuple[int, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """Each key's slot, or -1 if no round has a bit for it; a key that wasn't indexed may get any slot."""
    out = np.full(len(keys), -1, np.int64)
    left, before = np.arange(len(keys)), 0
    for turn, (size, bits) in enumerate(rounds):
        upto = np.append(0, np.cumsum(_ONES[bits], dtype=np.int64))
        if len(left):
            at = _places(keys[left], turn, size)
            byte = bits[at >> 3]
            own = (byte >> (7 - (at & 7)).astype(np.uint8)) & 1
            rank = upto[at >> 3] + _ONES[byte >> (8 - (at & 7)).astype(np.uint8)]
            hit = own.astype(bool)
            out[left[hit]] = before + rank[hit]
            left = left[~hit]
        before += int(upto[-1])
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts summed."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.lexsort((k["low"], k["high"]))
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


def _index_row(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    rounds = build_rounds(keys)
    at = slots(rounds, keys)
    prints = np.empty(len(keys), "<u8")
    prints[at] = keys["high"] ^ (keys["low"] * _MIX[0])
    width = int(np.min_scalar_type(counts.max() if len(counts) else 0).itemsize)
    held = np.empty(len(keys), f"<u{width}")
    held[at] = counts
    return pa.RecordBatch.from_pylist([{"shard": shard, "n": len(keys), "rounds": [{"size": s, "bits": b.tobytes()} for s, b in rounds],
                                        "fingerprints": prints.tobytes(), "width": width, "counts": held.tobytes()}], _INDEX)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of the shards of one partition, whose rows come shard by shard."""
    shard, keys, counts, held, merged = None, [], [], 0, 0
    for part in batches:
        for i in range(part.num_rows):
            of = part.column("shard")[i].as_py()
            if of != shard and shard is not None:
                yield _index_row(shard, *_merged(keys, counts))
                keys, counts, held, merged = [], [], 0, 0
            shard = of
            keys.append(np.frombuffer(part.column("keys")[i].as_buffer(), _KEY).copy())
            counts.append(np.frombuffer(part.column("counts")[i].as_buffer(), "<u4").copy())
            held += len(keys[-1])
            if held > 2 * merged + SHARD_LINES:  # entries of frequent lines shrink as they come
                k, c = _merged(keys, counts)
                keys, counts, held, merged = [k], [c], len(k), len(k)
    if shard is not None:
        yield _index_row(shard, *_merged(keys, counts))


def _probe(at_least: int):
    """One bit a key, for each batch's keys: held by so many documents. A shard's index row comes before the batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rounds, prints, counts = None, [], None, None
        for part in batches:
            batch, bits = [], []
            for i in range(part.num_rows):
                of = part.column("shard")[i].as_py()
                if part.column("batch")[i].as_py() is None:
                    row = part.slice(i, 1).select(["rounds", "fingerprints", "width", "counts"]).to_pylist()[0]
                    shard, rounds = of, [(r["size"], np.frombuffer(r["bits"], np.uint8)) for r in row["rounds"]]
                    prints, counts = np.frombuffer(row["fingerprints"], "<u8"), np.frombuffer(row["counts"], f"<u{row['width']}")
                    continue
                keys = np.frombuffer(part.column("keys")[i].as_buffer(), _KEY)
                often = np.zeros(len(keys), bool)
                if of == shard and len(prints):
                    at = slots(rounds, keys)
                    known = (at >= 0) & (prints[at] == (keys["high"] ^ (keys["low"] * _MIX[0])))
                    often = known & (counts[at] >= at_least)
                if often.any():
                    batch.append((part.column("batch")[i].as_py(), of))
                    bits.append(np.packbits(often).tobytes())
            yield pa.record_batch([pa.array([b for b, _ in batch], pa.int64()), pa.array([s for _, s in batch], pa.int32()), pa.array(bits, pa.binary())], names=["batch", "shard", "bits"])
    return run


# --- batches of documents ----------------------------------------------------

class _Lines:
    """The lines of a batch: their keys' hashes, the distinct ones by shard, and where each line's key is."""

    def __init__(self, payload: bytes, lengths: list[int], shards: int, at_least_chars: int) -> None:
        raw, self.lines, self.ends, start = zstandard.decompress(payload), [], [], 0
        for n in lengths:
            self.lines.extend(raw[start:start + n].split(b"\n"))
            self.ends.append(len(self.lines))
            start += n
        stripped = list(map(bytes.strip, map(bytes.lower, self.lines)))  # both touch ASCII only
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, stripped)), ">u8").reshape(-1, 2)
        every = np.empty(len(keys), _KEY)
        every["high"], every["low"] = keys[:, 0], keys[:, 1]
        # a code point starts at every byte but 10xxxxxx ones; n bytes hold n / 4 code points at least
        self.long = np.fromiter((len(k) >= at_least_chars and (len(k) >= 4 * at_least_chars or len(k.decode("utf-8", "replace")) >= at_least_chars) for k in stripped), bool, len(stripped))
        self.which = np.flatnonzero(self.long)
        keyed = every[self.which]
        shard = (keyed["low"] % _U(shards)).astype(np.int32)
        doc = np.searchsorted(self.ends, self.which, side="right")
        order = np.lexsort((doc, keyed["low"], keyed["high"], shard))
        k, d = keyed[order], doc[order]
        new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
        again = ~new & (np.append(False, d[1:] == d[:-1]) if len(d) else new)  # once more in its document
        self.place = np.empty(len(k), np.int64)
        self.place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.keys, self.shard = k[first], shard[order][first]
        self.counts = (np.add.reduceat((~again).astype(np.int64), first) if len(first) else first).astype("<u4")

    def by_shard(self) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(self.shard, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.shard)], strict=False):
            yield int(self.shard[a]), a, b

    def dropped(self, answers: list[dict] | None) -> np.ndarray:
        """True for the lines to drop."""
        bits, often = {a["shard"]: a["bits"] for a in answers or ()}, np.zeros(len(self.keys), bool)
        for shard, a, b in self.by_shard():
            if shard in bits:
                often[a:b] = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=b - a)
        out = np.zeros(len(self.lines), bool)
        out[self.which] = often[self.place]
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    at = TaskContext.get().partitionId() << 32
    press = zstandard.ZstdCompressor(level=1)
    for part in row_slices(batches, "raw", BATCH_BYTES):
        texts = binary_list(part.column("raw"))
        raw = b"".join(texts)
        ends = pa.array([0, len(texts)], pa.int32())
        yield pa.record_batch([pa.array([at], pa.int64()), pa.array([press.compress(raw)], pa.binary()), pa.array([raw.count(b"\n") + len(texts)], pa.int64()),
                               pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, part.column("rest"))],
                              names=["batch", "payload", "n", "lengths", "rest"])
        at += 1


def _rows(part: pa.RecordBatch) -> Iterator[dict]:
    slim = part.select([c for c in part.schema.names if c != "rest"])
    for i in range(part.num_rows):
        yield slim.slice(i, 1).to_pylist()[0]


def _ask(shards: int, at_least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in _rows(part):
                lines = _Lines(row["payload"], row["lengths"], shards, at_least_chars)
                found = [(s, lines.keys[a:b].tobytes(), lines.counts[a:b].tobytes()) for s, a, b in lines.by_shard()]
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int32()), pa.array([row["batch"]] * len(found), pa.int64()),
                                       pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())], names=["shard", "batch", "keys", "counts"])
    return run


def _cut(shards: int, at_least_chars: int, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, row in enumerate(_rows(part)):
                lines = _Lines(row["payload"], row["lengths"], shards, at_least_chars)
                gone = lines.dropped(row["answers"])
                starts = [0, *lines.ends[:-1]]
                kept = [b"\n".join([x for x, g in zip(lines.lines[a:b], gone[a:b].tolist(), strict=True) if not g]) for a, b in zip(starts, lines.ends, strict=True)]
                so_far = np.append(0, np.cumsum(gone))
                rest = part.column("rest").slice(i, 1).flatten()
                columns = [*rest.flatten(), pa.array(np.subtract(lines.ends, starts), pa.int64()), pa.array(so_far[lines.ends] - so_far[starts], pa.int64()),
                           pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = [*[f.name for f in rest.type], "n_lines", "n_dropped", "kept_sha256"]
                if with_kept:
                    columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("kept")
                yield pa.record_batch(columns, names=names)
    return run


# --- the operator ------------------------------------------------------------

def prepare(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Batches (batch, payload, n, lengths, rest) of compressed texts beside the columns `keep`, in the shared folder; they are not moved again."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(text.alias("raw"), F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("rest"))
    packed = StructType([StructField("batch", LongType()), *slim.select(F.lit(b"").alias("payload")).schema, StructField("n", LongType()),
                         StructField("lengths", ArrayType(LongType())), StructField("rest", ArrayType(slim.schema["rest"].dataType))])
    return checkpoint_placed(slim.mapInArrow(_pack, packed).repartition(shuffle_partitions(docs.sparkSession), "batch").sortWithinPartitions("batch"))


def line_index(asked: DataFrame, shards: int) -> DataFrame:
    """The index, one row a shard (INDEX), over all keys that the batches ask for; kept in the shared folder."""
    dealt = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "batch")
    return checkpoint(dealt.mapInArrow(_build, INDEX))


def probe(asked: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(batch, answers): per batch and shard with a frequent key, one bit a key."""
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema if f.name not in asked.columns}
    questions = asked.select("shard", "batch", "keys", F.lit(None).cast("binary").alias("counts"), *empty.values())
    arrays = index.select("shard", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("binary").alias("keys"), "counts", *empty)
    both = arrays.unionByName(questions).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("batch"))
    found = checkpoint(both.mapInArrow(_probe(min_docs), "batch long, shard int, bits binary"))
    return found.groupBy("batch").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))


def drop_lines(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_docs: int = 10, min_chars: int = 1, with_kept: bool = False) -> DataFrame:
    """One row per row of `docs`: the columns `keep` (doc_id, if none are given), n_lines, n_dropped, kept_sha256, and the text `kept` if asked for.

    Texts are split at \\n; a line's key is the line without white space
    (``[\\x20\\x09-\\x0D]``) at both ends, A-Z lower-cased. Keys of at least
    `min_chars` code points that stand in at least `min_docs` documents lose
    all their lines everywhere; the others stay as they are, joined by \\n.

    Null or empty text: one empty line, of the empty key. Every row is a
    document of its own, also where ids repeat or are null; a line counts
    once a document however often it stands in it. Long texts are whole
    lines of one batch. No rows: no rows. Columns outside `keep` don't
    matter; `keep` shouldn't name a result.
    """
    shards_of = shuffle_partitions(docs.sparkSession)
    prepared = prepare(docs, text_col, keep)
    total = prepared.agg(F.sum("n")).first()[0] or 0
    shards = max(shards_of, -(-total // SHARD_LINES))
    asked = prepared.select("batch", "payload", "lengths").mapInArrow(_ask(shards, min_chars), _ASKED)
    answers = probe(asked, line_index(asked, shards), shards, min_docs)
    both = prepared.drop("n").join(answers, "batch", "left")
    rest = prepared.schema["rest"].dataType.elementType
    result = StructType([*rest.fields, *StructType.fromDDL("n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_kept else "")).fields])
    return both.mapInArrow(_cut(shards, min_chars, with_kept), result)


def query(spark, sf_dir: str) -> DataFrame:
    return drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key AS often FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = often GROUP BY doc_id
"""
