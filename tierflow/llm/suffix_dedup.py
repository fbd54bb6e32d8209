"""Suffix-array deduplication with a logarithmic family of indexes.

Removes every byte that lies in a LENGTH-byte string which also starts in a
document with a smaller id. Texts are bytes; strings never cross documents and
are judged on the input.

Documents travel in batches of a few MB. A batch's suffix array is a sorted
array of suffixes with the smallest id of the batch that has each; suffixes
are compared by a fingerprint of as many bytes as matter, since the scan asks
just for equality over that length. In an index shard (suffixes dealt by hash)
batches arrive one after another; each is merge-scanned against the levels of
the shard, its new suffixes become a level, and levels of like size are merged,
so there are logarithmically many and each suffix is moved that many times.

The arrays are sparse at first. Of the places in each LENGTH-byte window the
one whose K-byte string has the lowest hash is the window's anchor, so equal
windows have equal anchors at equal offsets. Consecutive windows with one
anchor form a block (up to LENGTH - K + 1 windows). Three passes:

1. One suffix per block: (anchor string, block). The scan tells a block that a
   smaller id holds whole; all its windows go. It also tells anchor strings
   that stand in several different blocks: of each such block the first
   holder, and rows of other batches with its id, enter pass 2. Other blocks can't share a window with anything.
2. One suffix per window of those blocks. The scan tells the windows that a
   smaller id holds.
3. The answers meet the texts again, and the covered bytes are taken out.

Scale: what moves is a few bytes a block, about one for every 15 bytes of
text, already reduced to one per batch and content, so a passage in a third of
all documents is one row a batch; the texts move once, compressed, and passes
2 and 3 join the answers to where they lie. Shards grow in number with the
input. Hash collisions: 80 and 64 bits beside the shard's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import checkpoint, checkpoint_placed, lean, row_slices, shuffle_partitions

LENGTH, K = 50, 20
WINDOWS = LENGTH - K + 1
BATCH_BYTES = 2 << 20
SHARD_BYTES = 64 << 20
SEGMENT = 1 << 17
_NO_ID = np.iinfo(np.int64).max
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_BASE = 0x9DDFEA08EB382D69  # odd: its powers have inverses modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _B
    x ^= x >> _U(29)
    x *= _C
    x ^= x >> _U(32)
    return x


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a segment."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(SEGMENT + LENGTH + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _words(raw, n: int, at: int) -> np.ndarray:
    """The 8 bytes from each of n places on, as one number."""
    return np.ndarray((n,), "<u8", raw, offset=at, strides=(1,))


class Blocks:
    """The blocks of a batch's bytes: document, anchor's hash, content's hash, first window and number of windows."""

    def __init__(self, raw: bytes, lengths: np.ndarray):
        self.raw = raw
        ends = np.cumsum(lengths)
        parts: list[tuple] = []
        total = len(raw)
        for a in range(0, max(0, total - LENGTH + 1), SEGMENT):
            n = min(SEGMENT, total - LENGTH + 1 - a)
            parts.append(self._segment(a, n, ends))
        if not parts:
            parts = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        self.doc, self.anchor, self.content, self.first, self.count = (np.concatenate(p) for p in zip(*parts, strict=True))

    def _segment(self, a: int, n: int, ends: np.ndarray) -> tuple:
        """Blocks among the n windows from place a on. A block that a segment's end cuts is two: harmless, they differ from their like and meet in pass 2."""
        places = n + WINDOWS - 1
        low, mid, high = (_words(self.raw, places, a + o) for o in (0, 8, K - 8))
        h = _mix((low * _A) ^ (mid * _C) ^ _mix(high * _B))
        least = (h & _U(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64)  # ties to the leftmost
        width = 1
        while 2 * width <= WINDOWS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WINDOWS:
            rest = WINDOWS - width
            least = np.minimum(least[:len(least) - rest], least[rest:])
        anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(a, a + n)
        doc = np.searchsorted(ends, start, side="right")
        whole = start + LENGTH <= ends[np.minimum(doc, len(ends) - 1)]
        turn = np.empty(n, bool)
        turn[0] = True
        turn[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(turn)
        count = np.diff(first, append=n)
        keep = whole[first]
        first, count = first[keep], count[keep]
        up, down = _powers()
        span = n + LENGTH - 1
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum((np.frombuffer(self.raw, np.uint8, span, a).astype(np.uint64) + _U(1)) * up[:span], out=sums[1:])
        size = count + (LENGTH - 1)
        content = (sums[first + size] - sums[first]) * down[first]
        content = _mix(content ^ _mix((size.astype(np.uint64) << _U(32)) | (anchor[first] - first).astype(np.uint64)))
        return doc[first], _mix(h[anchor[first]] * _A), content, first + a, count

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some blocks: the block of each window, its fingerprint, and the hash that deals it."""
        count = self.count[which]
        of = np.repeat(which, count)
        start = self.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        words = _words(self.raw, len(self.raw) - 7, 0)
        x = np.full(len(of), _A, np.uint64)
        deal = np.full(len(of), _B, np.uint64)
        for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            w = words[start + offset]
            x = _mix(x ^ (w * _C))
            deal = (deal ^ w) * _A
        return of, x, _mix(deal)


def _least_holders(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """Order that sorts by key (first array first), then id, and keeps the first of each key."""
    order = np.lexsort((ids, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order[new]


_PRESS, _LOOSEN = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart (sorted numbers share their high bytes)."""
    planes = [np.ascontiguousarray(c.astype(c.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return _PRESS.compress(b"".join(planes))


def _unpacked(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = _LOOSEN.decompress(blob), [], 0
    for kind in kinds:
        width = int(kind[1])
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(f">{kind}").ravel().astype(np.int64 if kind[0] == "i" else np.uint64))
        at += n * width
    return out


class Levels:
    """A logarithmic family of suffix arrays. An entry: key (two numbers), smallest id, and the place of its holder."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def scan(self, key: np.ndarray, more: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Merge-scans a sorted array against the levels, then adds it.

        Returns which entries a smaller id holds; the places of earlier
        entries that lost their key to a smaller id; and pairs (place,
        holder's place) of entries that share key and id with their holder.
        """
        held, known = np.zeros(len(key), bool), np.zeros(len(key), bool)
        lost, twins = [np.empty(0, np.int64)], [(np.empty(0, np.int64),) * 2]
        for level in self.levels:
            at = np.searchsorted(level[0], key)
            inside = np.minimum(at, len(level[0]) - 1)
            while True:  # equal first numbers with other seconds: step on
                other = (at < len(level[0])) & (level[0][inside] == key) & (level[1][inside] != more)
                if not other.any():
                    break
                at = at + other
                inside = np.minimum(at, len(level[0]) - 1)
            same = np.flatnonzero((at < len(level[0])) & (level[0][inside] == key))
            known[same] = True
            there = inside[same]
            held[same] = level[2][there] < ids[same]
            equal = level[2][there] == ids[same]
            twins.append((place[same[equal]], level[3][there[equal]]))
            better = ids[same] < level[2][there]
            same, there = same[better], there[better]
            lost.append(level[3][there])
            level[2][there], level[3][there] = ids[same], place[same]
        new = np.flatnonzero(~known)
        if len(new):
            self.levels.append([c[new] for c in (key, more, ids, place)])
            while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
                self._merge()
        return held, np.concatenate(lost), tuple(np.concatenate(t) for t in zip(*twins, strict=True))

    def _merge(self) -> None:
        both = [np.concatenate(c) for c in zip(self.levels.pop(), self.levels.pop(), strict=True)]
        order = np.lexsort((both[1], both[0]))
        self.levels.append([c[order] for c in both])

    def whole(self) -> list[np.ndarray]:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0]


#: Entries gathered into one batch of an index shard.
_GATHER = 1 << 15


def _answer(rows: list[tuple[int, int, bytes]], wide: bool) -> Iterator[tuple[int, bytes]]:
    """The answers to a shard's arrays (batch, n, blob): (batch, bits).

    A bit per entry: a smaller id has it. If `wide`, another: its anchor
    string stands in different blocks, and it is the first holder of its own
    or shares its id with that.
    """
    family, starts = Levels(), np.cumsum([0, *(n for _, n, _ in rows)])
    held = np.zeros(starts[-1], bool)
    pairs: list[tuple] = []
    near: list[tuple] = []

    def settle(columns: list[np.ndarray]) -> None:
        order = np.lexsort((columns[2], columns[1], columns[0]))
        key, more, ids, place = (c[order] for c in columns)
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
        lead = np.flatnonzero(~again)
        leader = lead[np.cumsum(~again) - 1]
        held[place[ids[leader] < ids]] = True
        twin = again & (ids[leader] == ids)
        near.append((place[twin], place[leader[twin]]))
        found, lost, twins = family.scan(key[lead], more[lead], ids[lead], place[lead])
        held[place[lead[found]]] = True
        held[lost] = True
        pairs.append(twins)

    waiting: list[list[np.ndarray]] = []
    for i, (_, n, blob) in enumerate(rows):
        key, *more, ids = _unpacked(blob, n, *(("u8", "u2", "i8") if wide else ("u8", "i8")))
        waiting.append([key, more[0] if wide else np.zeros(n, np.uint64), ids, np.arange(starts[i], starts[i + 1])])
        if i == len(rows) - 1 or starts[i + 1] - waiting[0][3][0] >= _GATHER:
            settle([np.concatenate(c) for c in zip(*waiting, strict=True)])
            waiting.clear()
    for place, holder in (*pairs, *near):  # what shares key and id with its holder shares its fate
        held[place] |= held[holder]
    enters = np.zeros(starts[-1], bool)
    if wide:
        key, _, _, place = family.whole()
        anchor = key >> _U(32)
        alike = np.zeros(len(anchor) + 1, bool)
        alike[1:-1] = anchor[1:] == anchor[:-1]
        enters[place[alike[1:] | alike[:-1]]] = True
        for place, holder in (*pairs, *near):  # a twin's holder may be a leader whose own holder came before: pairs first
            enters[place] |= enters[holder]
    for i, (batch, _, _) in enumerate(rows):
        part = slice(starts[i], starts[i + 1])
        yield batch, np.packbits(np.concatenate([held[part], enters[part]]) if wide else held[part]).tobytes()


def _answers(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of shard and batch."""
        now, rows = None, []

        def done() -> pa.RecordBatch:
            found = list(_answer(rows, wide))
            return pa.record_batch([pa.array([b for b, _ in found], pa.int64()), pa.array([now] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())],
                                   names=["batch", "shard", "bits"])
        for part in batches:
            for shard, batch, n, blob in zip(*(part.column(c).to_pylist() for c in ("shard", "batch", "n", "blob")), strict=True):
                if shard != now and rows:
                    yield done()
                    rows = []
                now = shard
                rows.append((batch, n, blob))
        if rows:
            yield done()
    return run


class _Batch:
    """A batch of documents: blocks, the first holder of each different block, and what the shards answer about them."""

    def __init__(self, payload: bytes, lengths: list[int], ids: list[int], shards: int):
        self.raw, self.lengths, self.ids, self.shards = _LOOSEN.decompress(payload), np.array(lengths, np.int64), np.array(ids, np.int64), shards
        self.blocks = b = Blocks(self.raw, self.lengths)
        self.id_of = self.ids[b.doc]
        self.key = ((b.anchor >> _U(32)) << _U(32)) | (b.content >> _U(32))
        self.more = b.content & _U(0xFFFF)
        self.lead = _least_holders((self.key, self.more), self.id_of)
        self.shard = (b.anchor[self.lead] % _U(shards)).astype(np.int64)

    def first_arrays(self) -> Iterator[tuple[int, int, bytes]]:
        for shard, which in _by_shard(self.shard):
            at = self.lead[which]
            yield shard, len(at), _packed(self.key[at], self.more[at].astype(np.uint16), self.id_of[at])

    def first_answers(self, answers: list[dict]) -> None:
        self.held, self.enters = np.zeros(len(self.lead), bool), np.zeros(len(self.lead), bool)
        bits = {a["shard"]: a["bits"] for a in answers or ()}
        for shard, which in _by_shard(self.shard):
            n = len(which)
            got = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=2 * n).astype(bool)
            self.held[which], self.enters[which] = got[:n], got[n:]
        which = np.sort(self.lead[self.enters])
        self.of, self.mark, deal = self.blocks.windows(which) if len(which) else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.window_id = self.id_of[self.of]
        self.window_lead = _least_holders((self.mark,), self.window_id)
        self.window_shard = (deal[self.window_lead] % _U(self.shards)).astype(np.int64)

    def second_arrays(self) -> Iterator[tuple[int, int, bytes]]:
        for shard, which in _by_shard(self.window_shard):
            at = self.window_lead[which]
            yield shard, len(at), _packed(self.mark[at], self.window_id[at])

    def covered(self, answers: list[dict]) -> np.ndarray:
        """True for the bytes to remove."""
        b = self.blocks
        # of every block, the first holder of its like
        order = np.lexsort((self.id_of, self.more, self.key))
        turn = np.ones(len(order), bool)
        turn[1:] = (self.key[order[1:]] != self.key[order[:-1]]) | (self.more[order[1:]] != self.more[order[:-1]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(turn) - 1  # lead is in the order of the groups
        gone = self.held[group] | (self.id_of > self.id_of[self.lead[group]]) if len(order) else np.zeros(0, bool)

        held = np.zeros(len(self.window_lead), bool)
        bits = {a["shard"]: a["bits"] for a in answers or ()}
        for shard, which in _by_shard(self.window_shard):
            held[which] = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=len(which)).astype(bool)
        place = np.searchsorted(self.mark[self.window_lead], self.mark)
        flagged = held[place] | (self.window_id > self.window_id[self.window_lead[place]]) if len(place) else np.zeros(0, bool)

        edge = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(edge, b.first[gone], 1)
        np.add.at(edge, b.first[gone] + b.count[gone] + LENGTH - 1, -1)
        # windows of an entering block, put where the same document has the block
        starts = np.flatnonzero(np.diff(self.of, prepend=-1))
        window_at = dict(zip(self.of[starts].tolist(), starts.tolist(), strict=True)) if len(starts) else {}
        for i in np.flatnonzero(~gone & self.enters[group]).tolist() if len(order) else ():
            w = window_at[int(self.lead[group[i]])]
            for k in np.flatnonzero(flagged[w:w + b.count[i]]).tolist():
                edge[b.first[i] + k] += 1
                edge[b.first[i] + k + LENGTH] -= 1
        return np.cumsum(edge[:-1]) > 0


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
        yield int(shard[order[a]]), order[a:b]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    at = TaskContext.get().partitionId() << 32
    for part in row_slices(batches, "raw", BATCH_BYTES):
        texts = part.column("raw").to_pylist()
        ids = part.column("id")
        rest = part.column("rest")
        ends = pa.array([0, len(texts)], pa.int32())
        yield pa.record_batch([
            pa.array([at], pa.int64()), pa.array([_PRESS.compress(b"".join(texts))], pa.binary()), pa.array([list(map(len, texts))], pa.list_(pa.int64())),
            pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, rest)], names=["batch", "payload", "lengths", "ids", "rest"])
        at += 1


def _arrays(shards: int, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in _rows(part):
                batch = _Batch(row["payload"], row["lengths"], row["ids"], shards)
                if second:
                    batch.first_answers(row["first"])
                found = list(batch.second_arrays() if second else batch.first_arrays())
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int32()), pa.array([row["batch"]] * len(found), pa.int64()),
                                       pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], names=["shard", "batch", "n", "blob"])
    return run


def _rows(part: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, without the columns that only pass through."""
    slim = part.select([c for c in part.schema.names if c != "rest"])
    for i in range(part.num_rows):
        yield {c: v[0] for c, v in slim.slice(i, 1).to_pydict().items()}


def _results(shards: int, kept_as: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, row in enumerate(_rows(part)):
                batch = _Batch(row["payload"], row["lengths"], row["ids"], shards)
                batch.first_answers(row["first"])
                gone = batch.covered(row["second"])
                ends = np.cumsum(batch.lengths)
                starts = ends - batch.lengths
                turn = gone.copy()
                turn[1:] &= ~gone[:-1]
                turn[starts[batch.lengths > 0]] = gone[starts[batch.lengths > 0]]
                counts = [np.append(0, np.cumsum(x)) for x in (gone, turn)]
                removed, spans = (c[ends] - c[starts] for c in counts)
                view, kept = np.frombuffer(batch.raw, np.uint8), []
                for a, b, n in zip(starts.tolist(), ends.tolist(), removed.tolist(), strict=True):
                    kept.append(batch.raw[a:b] if not n else view[a:b][~gone[a:b]].tobytes())
                rest = part.column("rest").slice(i, 1).flatten()
                columns = [*rest.flatten(), pa.array(batch.lengths), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                names = [*[f.name for f in rest.type], "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if kept_as:
                    columns.append(pa.array(kept, pa.binary()) if kept_as == "binary" else pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                    names.append("kept")
                yield pa.record_batch(columns, names=names)
    return run


def _ask(arrays: DataFrame, shards: int, wide: bool) -> DataFrame:
    """(batch, answers) of all shards, kept in the shared folder."""
    dealt = arrays.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "batch")
    return checkpoint(dealt.mapInArrow(lean(_answers(wide)), "batch long, shard int, bits binary"))


def _with(prepared: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """An answer is a bit or two a block: what a batch gets is smaller than the batch."""
    gathered = answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "bits")).alias(name))
    return prepared.join(gathered, "batch", "left")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, kept_as: str | None = None) -> DataFrame:
    """One row per row of `docs`: the columns `keep` (the id, if none are given), n_bytes, n_removed, n_spans, kept_sha256, and kept if asked for.

    n_spans counts maximal removed runs. kept_as "binary" gives the bytes
    left, "string" the text, without characters that lost a byte. Null text counts as empty: nothing
    to remove. A null id counts as larger than every id, and as equal to
    other null ids. Rows with one id don't affect each other, repeated rows
    neither. Other columns don't matter; `keep` shouldn't name a result.
    """
    spark = docs.sparkSession
    keep = keep or [id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    slim = docs.select(text.alias("raw"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.struct(*keep).alias("rest"))
    packed_type = StructType([StructField("batch", LongType()), *slim.select(F.lit(b"").alias("payload")).schema, StructField("lengths", ArrayType(LongType())),
                              StructField("ids", ArrayType(LongType())), StructField("rest", ArrayType(slim.schema["rest"].dataType))])
    prepared = checkpoint_placed(slim.mapInArrow(lean(_pack), packed_type).repartition(shuffle_partitions(spark), "batch").sortWithinPartitions("batch"))
    total = prepared.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-total // SHARD_BYTES))

    texts = prepared.drop("rest")
    arrays = "shard int, batch long, n long, blob binary"
    first = _ask(texts.mapInArrow(lean(_arrays(shards, False)), arrays), shards, True)
    second = _ask(_with(texts, first, "first").mapInArrow(lean(_arrays(shards, True)), arrays), shards, False)
    results = StructType([*slim.schema["rest"].dataType.fields, *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
                          *slim.select(F.lit("").alias("kept_sha256"), F.lit(b"").cast(kept_as or "binary").alias("kept")).schema.fields[:2 if kept_as else 1]])
    return _with(_with(prepared, first, "first"), second, "second").mapInArrow(lean(_results(shards, kept_as)), results)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return deduplicate(read_table(spark, sf_dir, "documents"))


#: Every window as hexadecimal text. Parts of 128 windows keep substr from walking long texts.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
k AS (SELECT doc_id, n, h, unnest(range((n + 127) // 128)) AS k FROM b),
q AS MATERIALIZED (SELECT doc_id, n, k, substr(h, 256 * k + 1, 354) AS part FROM k),
p AS (SELECT doc_id, n, k, part, unnest(range(least(128, n - 128 * k))) AS j FROM q),
w AS MATERIALIZED (SELECT doc_id, 128 * k + j AS i, substr(part, 2 * j + 1, 2) AS byte, CASE WHEN 128 * k + j + 50 <= n THEN substr(part, 2 * j + 1, 100) END AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM w WHERE s IS NOT NULL GROUP BY s),
f AS (SELECT w.doc_id, w.i, w.byte, coalesce(m.least < w.doc_id, false) AS hit FROM w LEFT JOIN m ON w.s = m.s),
c AS (SELECT doc_id, i, byte, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
t AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS turn FROM c),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE turn) AS n_spans, string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY i) AS kept FROM t GROUP BY doc_id)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(a.n_removed, 0) AS n_removed, coalesce(a.n_spans, 0) AS n_spans, sha256(unhex(coalesce(a.kept, ''))) AS kept_sha256
FROM b LEFT JOIN a USING (doc_id)
"""
