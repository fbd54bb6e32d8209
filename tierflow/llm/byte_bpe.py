"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of the corpus is reduced to its distinct pre-tokens, laid end to end
as one array of byte tokens with links to the next and previous token. An
inverted index holds, per token pair that has a merge, the positions where the
pair stands. Merges are replayed over the whole block in rank order: a merge
visits just the positions its pair's list names, drops those that an earlier
merge has changed, joins the rest, and enters the two new neighbour pairs of
each into the index. Every merge is thus applied once to all words of the
block rather than word after word. Pre-tokens don't affect each other, so the
ids are those of encoding each alone, whatever the block.

A corpus is replayed block by block (a bounded part of a partition): there is
no shuffle, and no table of words that would grow with the corpus has to
reach every task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ids_and_texts, lean, no_cycles, row_slices

#: Unicode's White_Space, in which the tokenizer's patterns are written.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Before white space that follows another character no pre-token reaches across: a place to cut whole texts.
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
BLOCK_BYTES = 2 << 20
#: About 40 MB a task.
MEMO_PIECES = 200_000
#: Ids decoded at once.
LOT_IDS = 1 << 19


class Ranks:
    """A rank file: token bytes by id, and the rank of every pair of tokens whose bytes join to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs that have a merge, ascending, and its rank."""
        of = self.of
        pairs = [((of[t[:i]] << 32) | of[t[i:]], r) for t, r in of.items() for i in range(1, len(t)) if t[:i] in of and t[i:] in of]
        codes, ranks = np.array(pairs, np.int64).reshape(-1, 2).T
        by = np.argsort(codes, kind="stable")
        return codes[by], ranks[by]

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 without a merge (or where a token is -1)."""
        codes, ranks = self.merges
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where((codes[at] == code) & (left >= 0) & (right >= 0), ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Every merge applied in rank order over all words (none empty): all their ids, and where each word's ids end."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        token = np.append(token, -1)  # a place that stands for "no neighbour"
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - lengths] = n

        index: dict[int, list[np.ndarray]] = {}  # rank of a pair's merge -> positions of its left tokens
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            held = ranks >= 0
            places, ranks = places[held], ranks[held]
            if not len(places):
                return
            by = np.argsort(ranks, kind="stable")
            places, ranks = places[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for a, b, r in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ranks)], ranks[cuts].tolist(), strict=True):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        enter(np.arange(n), self.of_pairs(token[:n], token[after[:n]]))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            right = after[at]
            live = (token[at] >= 0) & (self.of_pairs(token[at], token[right]) == rank)
            at, right = at[live], right[live]
            if len(at) > 1 and (chained := right[:-1] == at[1:]).any():  # overlaps as in "aaa": from the left, every other
                run = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.append(True, ~chained), run, 0))
                take = (run - first) % 2 == 0
                at, right = at[take], right[take]
            if not len(at):
                continue
            beyond, left = after[right], before[at]
            token[at], token[right] = rank, -1
            after[at] = beyond
            before[beyond] = at  # the place n takes any value
            enter(at, self.of_pairs(token[at], token[beyond]))
            enter(left, self.of_pairs(token[left], token[at]))
        token = token[:n]
        kept = token >= 0
        return token[kept], np.cumsum(kept)[ends - 1]

    @cached_property
    def decoded(self) -> Strings:
        return Strings({r: t for t, r in self.of.items()})

    @cached_property
    def decimal(self) -> Strings:
        """Ids as decimals with a space behind."""
        return Strings({r: b"%d " % r for r in self.of.values()})


class Strings:
    """A byte string per id, end to end in one array: ids are replaced by theirs in one gather."""

    def __init__(self, of: dict[int, bytes]):
        top = max(of, default=-1) + 1
        self.size = np.fromiter((len(of[i]) if i in of else -1 for i in range(top)), np.int32, top)
        ends = np.cumsum(np.maximum(self.size, 0))
        self.start = (ends - np.maximum(self.size, 0)).astype(np.int32)
        self.flat = np.frombuffer(b"".join(of[i] for i in range(top) if i in of), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids' strings end to end, and where each ends. An unknown id raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise KeyError("an id that the rank file doesn't have")
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        at += np.repeat(self.start[ids] - (ends - size).astype(np.int32), size)
        return memoryview(self.flat[at]), ends


class Encoder:
    """Encodes texts; remembers distinct pieces (a run of white space and what follows it)."""

    def __init__(self, ranks: Ranks, pattern: str, most: int = MEMO_PIECES):
        import regex
        self.ranks, self.pattern, self.most = ranks, regex.compile(pattern), most
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Replays the merges over the pre-tokens of pieces not seen yet; over `most` pieces, others are forgotten."""
        new = list(pieces.difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > self.most:
            self.known = {p: self.known[p] for p in pieces.intersection(self.known)}
        split = list(map(self.pattern.findall, new))
        words = list(set(chain.from_iterable(split)))
        ids, ends = self.ranks.replay([w.encode("utf-8") for w in words])
        packed, ends = ids.astype("<i4").tobytes(), (4 * ends).tolist()
        of_word = {w: packed[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}
        self.known.update((piece, of_word[parts[0]] if len(parts) == 1 else b"".join(map(of_word.__getitem__, parts))) for piece, parts in zip(new, split, strict=True))

    def block(self, texts: list[str]) -> Iterator[bytes]:
        """Per text its ids, four bytes each."""
        cut = list(map(_PIECE.findall, texts))
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        for pieces in cut:
            yield b"".join(map(get, pieces))


def _encode_blocks(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Ranks.load(path), pattern)  # its memory ends with the task
        with no_cycles():
            for block in row_slices(batches, "text", BLOCK_BYTES):
                rows = list(encoder.block(block.column("text").to_pylist()))
                ends = np.cumsum([0, *map(len, rows)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))
                yield pa.record_batch([block.column("doc_id"), ids], names=["doc_id", "ids"])
    return run


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), one row per row of `docs`.

    Null text counts as empty: no ids. A null id stays null; repeated rows
    stay repeated; other columns don't matter. The pattern must keep white
    space apart from a character before it, as byte-level patterns do.
    """
    return ids_and_texts(docs, id_col, text_col).mapInArrow(lean(_encode_blocks(ranks_path, pattern)), "doc_id long, ids array<int>")


def _joined(strings: Strings, ids: pa.Array) -> Iterator[list[tuple[int, memoryview, bool]]]:
    """The strings of each row's ids: lots of (row, bytes, whether the row ends there); a long row comes in several."""
    ends = ids.offsets.to_numpy().astype(np.int64)
    flat, ends = ids.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], ends - ends[0]
    row = 0
    for start in range(0, max(len(flat), 1), LOT_IDS):
        part = flat[start:start + LOT_IDS]
        text, at = strings.join(part)
        at = np.append(0, at)
        lot = []
        while row < len(ids):
            a, b = max(int(ends[row]), start) - start, min(int(ends[row + 1]) - start, len(part))
            over = int(ends[row + 1]) <= start + len(part)
            lot.append((row, text[int(at[a]):int(at[b])], over))
            if not over:
                break
            row += 1
        yield lot


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.load(path)
        for batch in batches:
            ids = batch.column("ids")
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            columns = []
            for strings, behind in ((ranks.decimal, 1), (ranks.decoded, 0)):  # a decimal has a space behind it: the last one goes
                hashes, now = [], hashlib.sha256()
                for lot in _joined(strings, ids):
                    for _, text, over in lot:
                        now.update(text[:max(len(text) - behind, 0)] if over else text)
                        if over:
                            hashes.append(now.hexdigest())
                            now = hashlib.sha256()
                columns.append(pa.array(hashes, pa.string()))
            counts = pc.list_value_length(ids).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), counts, *columns, ids], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the ids of `encode_ids`, and digests made while they are decoded.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of
    the bytes that the ids decode to; of nothing for a null or empty text.
    A block's ids are decoded by the task that made them.
    """
    encoded, digested = _encode_blocks(ranks_path, pattern), _digests(ranks_path)
    return ids_and_texts(docs, id_col, text_col).mapInArrow(lean(lambda batches: digested(encoded(batches))),
                                                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def _decode_blocks(path: str, ids_col: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.load(path)

        def done(batch: pa.RecordBatch, start: int, out: list) -> pa.RecordBatch:
            part = batch.slice(start, len(out))
            return pa.record_batch([part.column("doc_id"), pa.array(out, pa.binary()), *map(part.column, keep)], names=["doc_id", "decoded", *keep])
        for batch in batches:
            start, held, out, parts = 0, 0, [], []
            ids = batch.column(ids_col)
            valid = ids.is_valid().to_pylist()
            for lot in _joined(ranks.decoded, ids.fill_null([]) if ids.null_count else ids):
                for row, text, over in lot:
                    parts.append(text)
                    if over:
                        out.append(b"".join(parts) if valid[row] else None)
                        held, parts = held + len(out[-1] or b""), []
                        if held > BLOCK_BYTES:
                            yield done(batch, start, out)
                            start, held, out = start + len(out), 0, []
            if out:
                yield done(batch, start, out)
    return run


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, decoded): the bytes that each row's ids stand for; null for null, empty for none. An unknown id raises.

    Columns named in `keep` follow as they are.
    """
    slim = encoded.select(*dict.fromkeys(["doc_id", ids_col, *keep]))
    schema = ", ".join(["doc_id long, decoded binary", *[f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep]])
    return slim.mapInArrow(lean(_decode_blocks(ranks_path, ids_col, list(keep))), schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table
    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")
