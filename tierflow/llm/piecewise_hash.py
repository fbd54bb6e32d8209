"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last few bytes marks a chunk boundary where its top
bits are all ones, so boundaries follow the content and an edit moves just
the boundaries near it. Each chunk gives one character of a signature, however
often its like stands in the text. The block size starts at the power of two
that gives MOST / 2 to MOST chunks in a varied text and is halved while the
signature is shorter than MOST / 2; signatures are never cut, so a repetitive
text may have a longer one. A fingerprint holds the signatures at that size
and at twice it: ``size:signature:signature``. Two fingerprints are compared
where they have a block size in common, by an edit distance (insertions and
deletions) between the signatures, from a bit-parallel longest common
subsequence. A text and its edited form, whose sizes may differ where the text
is repetitive, are also compared at the smaller of their sizes.

Scale: fingerprints need no shuffle. Comparing a text with its neighbour in
id order shuffles each text once, by id ranges; a range also gets the first
document of the range that follows, so no global order or single task is
needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import binary_list, ids_and_texts, literal_rows, shuffle_partitions

MOST = 64
#: Fewest characters that two signatures must have in one common run (of a short one: all but the last), else chance decides.
RUN = 4
SEGMENT = 1 << 18
_WINDOW = 8
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rolled(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """In segments: the first place, and per place the mixed value of the last 8 bytes up to it (zeros before the start)."""
    for a in range(0, len(raw), SEGMENT):
        n = min(SEGMENT, len(raw) - a)
        window = raw[max(0, a - _WINDOW + 1):a + n]
        window = bytes(n + _WINDOW - 1 - len(window)) + window
        yield a, np.ndarray((n,), "<u8", window, strides=(1,)) * _MIX


def _least(level: int) -> np.uint64:
    """Values from here on have their top `level` bits set."""
    return np.uint64(((1 << level) - 1) << (64 - level) if level else 0)


def _marks(raw: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that end a chunk at this level, in order, and their values."""
    places, values = [], []
    for a, v in _rolled(raw):
        at = np.flatnonzero(v >= _least(level))
        places.append(at + (a + 1))
        values.append(v[at])
    return np.concatenate(places), np.concatenate(values)


def _signature(raw: bytes, ends: np.ndarray) -> str:
    view, out, start = memoryview(raw), [], 0
    for a in range(0, len(ends), SEGMENT):
        cuts = [start, *ends[a:a + SEGMENT].tolist()]
        out.append("".join([_ALPHABET[xxh32_intdigest(view[x:y]) & 63] for x, y in zip(cuts, cuts[1:], strict=False)]))
        start = cuts[-1]
    if start != len(raw):
        out.append(_ALPHABET[xxh32_intdigest(view[start:]) & 63])
    return "".join(out)


def _signatures(raw: bytes, level: int, places: np.ndarray, values: np.ndarray) -> str:
    return f"{1 << level}:{_signature(raw, places)}:{_signature(raw, places[values >= _least(level + 1)])}"


def fingerprint(raw: bytes) -> str:
    """``size:signature:signature`` of some bytes; of none, ``1::``."""
    if not raw:
        return "1::"
    level = max(0, (len(raw) // (MOST // 2)).bit_length() - 1)
    places, values = _marks(raw, level)
    while level and len(places) + (not len(places) or int(places[-1]) != len(raw)) < MOST // 2:
        level -= 1
        places, values = _marks(raw, level)
    return _signatures(raw, level, places, values)


def _at_size(raw: bytes, mark: str, size: int) -> str:
    """The fingerprint of some bytes, at this block size: `mark` if it has it."""
    if not raw or mark.startswith(f"{size}:"):
        return mark
    level = size.bit_length() - 1
    return _signatures(raw, level, *_marks(raw, level))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step a character; ends that are alike count as they are."""
    if len(a) < len(b):
        a, b = b, a
    front = len(commonprefix((a, b)))
    a, b = a[front:], b[front:]
    back = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[:len(a) - back], b[:len(b) - back]
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return front + back + len(a) - row.bit_count()


def _share_run(a: str, b: str) -> bool:
    n = min(RUN, len(a) - 1, len(b) - 1)  # the last chunk ends where the text does
    return n > 0 and not {a[i:i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i:i + n] for i in range(len(b) - n + 1))


def likeness(one: str, other: str) -> float:
    """0 to 1: 1 - edit distance / joint length of the signatures at a common block size; 0 without one or
    without a common run; 1 for equal fingerprints."""
    if one == other:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), other.split(":")
    a, b = int(a), int(b)
    pairs = [(a1, b1), (a2, b2)] if a == b else [(a1, b2)] if a == 2 * b else [(a2, b1)] if b == 2 * a else []
    return max((2 * _common(x, y) / (len(x) + len(y)) for x, y in pairs if _share_run(x, y)), default=0.0)


def _likeness_of_edit(raw: bytes, mark: str, edited: bytes, edited_mark: str) -> float:
    """Likeness of a text and its edited form, also at the smaller of their block sizes."""
    a, b = (int(m.partition(":")[0]) for m in (mark, edited_mark))
    found = likeness(mark, edited_mark)
    return found if a == b else max(found, likeness(_at_size(raw, mark, min(a, b)), _at_size(edited, edited_mark, min(a, b))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row per row of `docs`, without a shuffle; null text as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in binary_list(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])
    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending id order; each is compared with the row after it. A row that is not its range's own ends the range's chain."""
    held: tuple | None = None  # (range, own, id, text, fingerprint)
    out: list[tuple] = []

    def compare(row: tuple, then: tuple) -> tuple:
        text, other = row[3].decode("utf-8"), then[3].decode("utf-8")
        cut = len(text) // 3
        edited = (text[:len(text) - cut] + other[:cut]).encode("utf-8")
        mark = row[4] if edited == row[3] else fingerprint(edited)
        return (row[2], len(text), hashlib.sha256(edited).hexdigest(), row[4], mark, _likeness_of_edit(row[3], row[4], edited, mark), likeness(row[4], then[4]))

    for batch in batches:
        columns = zip(batch.column("at").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(),
                      binary_list(batch.column("text")), strict=True)
        for at, own, doc_id, raw in columns:
            row = (at, own, doc_id, raw, fingerprint(raw))
            if held is not None and held[1] and held[0] == at:
                out.append(compare(held, row))
            held = row
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            out = []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of `docs`.

    The next document is the one that follows in descending id order, after
    the last the first; a single row follows itself. Rows with one id are
    ordered by their text, null ids come last. Null text counts as empty; an
    empty text's edited text is empty. Equal texts have equal fingerprints
    and likeness 1. Other columns don't matter; no rows give no rows.
    """
    spark = docs.sparkSession
    ranges = ranges or shuffle_partitions(spark)
    slim = ids_and_texts(docs, id_col, text_col)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = slim.select(key.alias("k"))
    cuts = sorted({int(c) for c in ids.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.2 / ranges)} if ranges > 1 else ())
    # range r holds the ids above cut r-1 and up to cut r; cuts are as few as ranges, whatever the data
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < key)) if cuts else F.lit(0)
    placed = slim.withColumn("at", at.cast("int"))
    tops = {r["at"]: r["k"] for r in placed.groupBy("at").agg(F.max(key).alias("k")).collect()}
    if not tops:
        return literal_rows(spark, [], _DDL)
    held = sorted(tops)
    # a range's last row is followed by the first row of the range below it; that first row is sent to both
    above = dict(zip(held, [*held[1:], held[0]], strict=True))
    look = lambda of: F.create_map(*[F.lit(x) for r in held for x in (r, of[r])])[F.col("at")]
    place = lambda at, own: F.struct(at.alias("at"), F.lit(own).alias("own"))
    here, there = place(F.col("at"), True), place(look(above), False)
    dealt = (placed.select("doc_id", "text", F.explode(F.when(key == look(tops), F.array(here, there)).otherwise(F.array(here))).alias("g"))
             .select("doc_id", "text", "g.at", "g.own"))
    order = ["at", F.desc("own"), F.desc_nulls_last("doc_id"), "text"]
    return dealt.repartitionById(max(held) + 1, F.col("at")).sortWithinPartitions(*order).mapInArrow(_pairs, _DDL)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return with_next(read_table(spark, sf_dir, "documents"))
