"""Token counts with overlap resynchronisation for huge documents.

A document that fits a chunk is counted in one piece. A huge one is cut into
overlapping chunks; each is encoded on its own with offsets, and neighbours
are spliced at a boundary inside their overlap that is proven stable: a place
after white space, seen by both chunks, where both have a token start. White
space always ends a word of the pre-tokenizer and is dropped, so the words
(and the normalisation, which never composes across white space) on either
side of such a place don't depend on the other side. If the overlap holds no
such place the right chunk starts further left, twice as far each time, up to
the splice before; if even that fails the two chunks become one, and longer.

The same proof lets a chunk that needs no offsets be encoded word by word:
the library encodes each distinct white-space unit once, and the
counts of all its places are summed. Text is read as UTF-8 bytes and cut at
ASCII white space, which no unit or special string contains.

Scale: one narrow pass, no shuffle; memory is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_list, ids_and_texts, no_cycles, row_slices

SPACE = b" \t\n\r\x0b\x0c"
CHUNK, OVERLAP = 16_384, 256
BLOCK_BYTES = 2 << 20
#: Distinct units a task remembers (about 60 MB); beyond, those not in the block at hand are forgotten.
MEMO_UNITS = 500_000


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer, once per Python worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class UnitCounter:
    """Token counts of texts (bytes), by distinct white-space unit."""

    def __init__(self, tokenizer, most: int = MEMO_UNITS):
        self.tokenizer, self.most, self.counts = tokenizer, most, {}

    def learn(self, units: set[bytes]) -> None:
        new = list(units.difference(self.counts))
        if not new:
            return
        if len(self.counts) + len(new) > self.most:
            self.counts = {u: self.counts[u] for u in units.intersection(self.counts)}
        encoded = self.tokenizer.encode_batch_fast([u.decode("utf-8") for u in new], add_special_tokens=False)
        self.counts.update(zip(new, map(len, encoded), strict=True))

    def block(self, texts: list[bytes]) -> list[int]:
        cut = [t.split() for t in texts]
        self.learn(set().union(*cut))
        get = self.counts.__getitem__
        return [sum(map(get, units)) for units in cut]


def encode_offsets(tokenizer, raw: bytes) -> np.ndarray:
    """Byte offsets at which the tokens of `raw` start."""
    text = raw.decode("utf-8")
    starts = np.array([s for s, _ in tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
    if len(text) == len(raw) or not len(starts):
        return starts
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.flatnonzero(lead)[starts]


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and (raw[at] & 0xC0) == 0x80:
        at -= 1
    return at


def _stable(raw: bytes, left: tuple[int, int, np.ndarray], right: tuple[int, int, np.ndarray]) -> int | None:
    """The middle-most proven place to splice two encoded chunks (start, end, absolute token starts), or None."""
    low, high = right[0], left[1]
    both = np.intersect1d(left[2], right[2])
    both = both[(both > low) & (both < high)]
    buf = np.frombuffer(raw, np.uint8)
    after_space = np.isin(buf[both - 1], np.frombuffer(SPACE, np.uint8))
    places = both[after_space]
    return int(places[np.argmin(np.abs(places - (low + high) // 2))]) if len(places) else None


def spliced_starts(tokenizer, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP,
                   encode: Callable[..., np.ndarray] = encode_offsets) -> np.ndarray:
    """Byte offsets of all token starts of a text of any length."""
    if len(raw) <= chunk:
        return encode(tokenizer, raw)
    kept: list[np.ndarray] = []
    begin, end = 0, _char_start(raw, chunk)
    left = (begin, end, encode(tokenizer, raw[begin:end]))
    floor = 0  # the last splice: nothing left of it is looked at again
    while left[1] < len(raw):
        reach, place, back = min(len(raw), left[1] + chunk - overlap), None, overlap
        stop = _char_start(raw, reach) if reach < len(raw) else reach
        if stop <= left[1]:
            stop = min(len(raw), left[1] + chunk)
            stop = _char_start(raw, stop) if stop < len(raw) else stop
        while place is None:
            start = _char_start(raw, max(floor, left[1] - back))
            right = (start, stop, start + encode(tokenizer, raw[start:stop]))
            place = _stable(raw, left, right)
            if place is None and start <= floor:
                break
            back *= 2
        if place is None:  # no white space since the last splice: one chunk, twice as long
            stop = min(len(raw), floor + 2 * (stop - floor))
            stop = _char_start(raw, stop) if stop < len(raw) else stop
            left = (floor, stop, floor + encode(tokenizer, raw[floor:stop]))
            continue
        kept.append(left[2][(left[2] >= floor) & (left[2] < place)])
        left, floor = right, place
    kept.append(left[2][left[2] >= floor])
    return np.concatenate(kept)


def _count_block(path: str, chunk: int, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnitCounter(load(path))  # its memory ends with the task
        with no_cycles():
            for block in row_slices(batches, "text", BLOCK_BYTES):
                texts = binary_list(block.column("text"))
                n = counter.block([t if len(t) <= chunk else b"" for t in texts])
                n = [c if len(t) <= chunk else len(spliced_starts(counter.tokenizer, t, chunk, overlap)) for t, c in zip(texts, n, strict=True)]
                yield pa.record_batch([block.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(n, pa.int64())], schema=schema)
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of `docs`.

    Counts are those of the library's encode without added special tokens.
    Null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows stay repeated; other columns don't matter. The tokenizer
    file must be at `tokenizer_path` on every executor, and its
    pre-tokenizer must end words at white space and drop it.
    """
    counted = ids_and_texts(docs, id_col, text_col).mapInArrow(
        _count_block(tokenizer_path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
