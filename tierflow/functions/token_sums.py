"""Per-row sums over token arrays, in Arrow batches.

Each is a function of (row, tokens) alone. A stretch of rows meets every
distinct token (or pair of neighbours) once: it is hashed once and its value
gathered, where a higher-order function would hash each occurrence anew. They
are hashed side by side, a step of MD5 for thousands at a time: most pairs of a
stretch are distinct, and a call for each took most of the time. Sums
run in the order of the tokens, as a fold over the array does.
"""

from __future__ import annotations

import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import TWO32

#: Tokens of a stretch of rows: bounds a worker's memory, whatever the length of the texts.
STRETCH = 1 << 18


def unit(key: bytes, token: str) -> float:
    """``hashing.token_unit`` of one token."""
    return int.from_bytes(hashlib.md5(key + token.encode()).digest()[:4], "big") / TWO32


#: Messages hashed side by side: some arrays of them fit a core's cache. MD5 pads a block of 64 bytes with 9 at least.
LANES, ONE_BLOCK = 1 << 14, 55
_SHIFTS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """First four digest bytes, as an unsigned big-endian number, of padded messages of one block each (RFC 1321)."""
    m = blocks.view("<u4").T.copy()
    a, b, c, d = (np.full(len(blocks), x) for x in _START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[at]
        f += _SINES[i]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_SHIFTS[i])) | (f >> np.uint32(32 - _SHIFTS[i])))
    return (a + _START[0]).byteswap()


def _put(blocks: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Lays data[start:start + size] into each block from byte ``at`` on."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    blocks.reshape(-1)[np.repeat(np.arange(len(blocks)) * 64 + at, size) + within] = data[np.repeat(start, size) + within]


def _units(key: bytes, words: pa.Array, first: np.ndarray | None = None, second: np.ndarray | None = None) -> np.ndarray:
    """``unit`` of each word, or of the pairs of words ``first`` and ``second`` with a space between."""
    ends, data = _plain(words)
    sizes = np.diff(ends)
    first = np.arange(len(sizes)) if first is None else first
    found = np.empty(len(first))
    for s in range(0, len(first), LANES):
        part = slice(s, s + LANES)
        pieces = [first[part], *([] if second is None else [second[part]])]
        size = len(key) + sum(sizes[x] for x in pieces) + len(pieces) - 1
        short = size <= ONE_BLOCK
        heads = np.empty(len(size), np.uint32)
        for i in np.flatnonzero(~short).tolist():
            long = key + b" ".join(data[ends[x[i]]:ends[x[i] + 1]].tobytes() for x in pieces)
            heads[i] = int.from_bytes(hashlib.md5(long).digest()[:4], "big")
        size, pieces = size[short], [x[short] for x in pieces]
        blocks, row = np.zeros((len(size), 64), np.uint8), np.arange(len(size))
        blocks[:, :len(key)] = np.frombuffer(key, np.uint8)
        at = np.full(len(size), len(key))
        for k, x in enumerate(pieces):
            if k:
                blocks[row, at] = ord(" ")
                at = at + 1
            _put(blocks, at, data, ends[x], sizes[x])
            at = at + sizes[x]
        blocks[row, size] = 0x80
        blocks.view("<u4")[:, 14] = size * 8
        heads[short] = _md5_heads(blocks)
        found[part] = heads / TWO32
    return found


#: Values of words, or of pairs of them, as ``_units`` takes them.
Values = Callable[..., np.ndarray]


def _weights(key: bytes) -> Values:
    return lambda *words: 2.0 * _units(key, *words) - 1.0


def _stretches(tokens: pa.Array) -> Iterator[pa.Array]:
    """Slices of whole rows that hold about STRETCH tokens each."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(tokens):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + STRETCH, side="right")))
        yield tokens.slice(start, stop - start)
        start = stop


def _coded(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each token, and the distinct tokens by code; the last code is that of a null token."""
    flat = tokens.flatten().dictionary_encode()
    words = flat.dictionary
    codes = pc.fill_null(flat.indices.cast(pa.int64()), len(words)).to_numpy(zero_copy_only=False)
    return pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False), codes, words


def _masked(sums: np.ndarray, tokens: pa.Array) -> pa.Array:
    return pa.array(sums, mask=tokens.is_null().to_numpy(zero_copy_only=False) | np.isnan(sums))


def _summed(tokens: pa.Array, values: Values, of_null: float, with_bigrams: bool = False) -> pa.Array:
    return _masked(_sums(*_coded(tokens), len(tokens), values, of_null, with_bigrams), tokens)


def _sums(rows: np.ndarray, codes: np.ndarray, words: pa.Array, size: int, values_of: Values, of_null: float, with_bigrams: bool = False) -> np.ndarray:
    values = np.append(values_of(words), of_null)[codes]
    if with_bigrams and len(rows):
        words = pa.concat_arrays([words.cast(pa.large_string()), pa.array([""], pa.large_string())])
        inside = rows[1:] == rows[:-1]
        pairs, found = pd.factorize(codes[:-1][inside] * len(words) + codes[1:][inside])
        each = values_of(words, *np.divmod(found, len(words)))
        # a row's bigrams follow all of its tokens
        rows, values = np.concatenate([rows, rows[1:][inside]]), np.concatenate([values, each[pairs]])
    return np.bincount(rows, values, size)


def _entropy(tokens: pa.Array) -> pa.Array:
    return _masked(_entropies(*_coded(tokens), len(tokens)), tokens)


def _entropies(rows: np.ndarray, codes: np.ndarray, words: pa.Array, size: int) -> np.ndarray:
    order = pc.sort_indices(words).to_numpy(zero_copy_only=False)  # by bytes, so by code points
    rank = np.zeros(len(words) + 1, np.int64)  # nulls in front, each a token of its own
    rank[order] = np.arange(1, len(words) + 1)
    runs, count = np.unique(rows * (len(words) + 1) + rank[codes], return_counts=True)
    row, kind = np.divmod(runs, len(words) + 1)
    n = np.bincount(rows, minlength=size)
    p = np.where(kind > 0, count, 1) / n[row]
    return np.bincount(row, p * np.log(p + 1e-12) * np.where(kind > 0, 1, count), size)


def _udf(of: Callable[[pa.Array], pa.Array]):
    def run(tokens: pa.Array) -> pa.Array:
        found = [of(part) for part in _stretches(tokens)]
        return pa.concat_arrays(found) if found else pa.array([], pa.float64())
    # given here, since the worker takes them as types
    run.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def hashed_weight_sum(tokens: Column, key: str, with_bigrams: bool = False) -> Column:
    """Sum of 2u - 1 over the tokens, then their bigrams; u is ``token_unit`` under ``key``. Null if a token is."""
    prefix = key.encode()
    return _udf(lambda t: _summed(t, _weights(prefix), np.nan, with_bigrams))(tokens)


def _valences(rate: float) -> Values:
    def valence(x: str) -> float:
        return float(Decimal(repr(8.0 * unit(b"val:", x) - 4.0)).quantize(Decimal("0.1"), ROUND_HALF_UP))

    def values(words: pa.Array) -> np.ndarray:
        found, held = np.zeros(len(words)), np.flatnonzero(_units(b"lex:", words) < rate)
        found[held] = [valence(x) for x in words.take(pa.array(held)).to_pylist()]
        return found
    return values


def stand_in_valence_sum(tokens: Column, rate: float) -> Column:
    """Sum of ``social.stand_in_valence`` over the tokens."""
    return _udf(lambda t: _summed(t, _valences(rate), 0.0))(tokens)


def entropy_sum(tokens: Column) -> Column:
    """``signals.entropy_sum``: over distinct tokens in order, p * ln(p + 1e-12)."""
    return _udf(_entropy)(tokens)


# --- the same sums from the text itself --------------------------------------

#: Bytes of text of a stretch of rows.
TEXT_STRETCH = 1 << 22
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_IN_TOKEN = _IN_WORD.copy()
_IN_TOKEN[ord("'")] = True  # text.TOKEN_RE


def _plain(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows, from 0, and the bytes they lie in."""
    text = pc.fill_null((text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_string()), "")
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], data[ends[0]:ends[-1]]


def _text_stretches(ends: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for stretches of whole rows that hold about TEXT_STRETCH bytes each."""
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TEXT_STRETCH, side="right")) - 1)
        yield ends[start:stop + 1] - ends[start], data[ends[start]:ends[stop]]
        start = stop


def _text_coded(ends: np.ndarray, data: np.ndarray, in_token: np.ndarray = _IN_TOKEN) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``_coded`` of the tokens, runs of a class of bytes, that stand in the rows' bytes; the distinct tokens as an array."""
    inside = in_token[data]
    before, behind = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], behind[:-1] = inside[:-1], inside[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    before[edges] = behind[edges - 1] = False
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1
    places = np.concatenate([[0], np.cumsum(stop - start)])
    flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data[inside])).dictionary_encode()
    return np.searchsorted(ends, start, side="right") - 1, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary


def text_sums(text: Column, key: str | None = None, with_bigrams: bool = False, entropy: bool = False, valence_rate: float | None = None) -> Column:
    """Struct of n, the tokens of ``text.stripped_text``, and the sums asked for: w (``hashed_weight_sum``), e
    (``entropy_sum``), v (``stand_in_valence_sum``). Null text: all null.

    One pass for all of them, from the text: an array of its tokens would have
    to be built and carried to the worker string by string, once for each sum.
    """
    prefix, valence = (key or "").encode(), None if valence_rate is None else _valences(valence_rate)
    fields = ["n", *(["w"] if key is not None else []), *(["e"] if entropy else []), *(["v"] if valence else [])]

    def of(ends: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        rows, codes, words = _text_coded(ends, data)
        size, found = len(ends) - 1, []
        found.append(np.bincount(rows, minlength=size))
        if key is not None:
            found.append(_sums(rows, codes, words, size, _weights(prefix), 0.0, with_bigrams))
        if entropy:
            found.append(_entropies(rows, codes, words, size))
        if valence:
            found.append(_sums(rows, codes, words, size, valence, 0.0))
        return found

    def run(text: pa.Array) -> pa.Array:
        parts = [of(*x) for x in _text_stretches(*_plain(text))]
        null = text.is_null().to_numpy(zero_copy_only=False)
        columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int32() if f == "n" else pa.float64(), mask=null if parts else None) for i, f in enumerate(fields)]
        return pa.StructArray.from_arrays(columns, fields)
    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ", ".join(f"{f} {'int' if f == 'n' else 'double'}" for f in fields))(text)


def text_counts(text: Column, apostrophes: bool = True) -> Column:
    """Array of (term, c): the distinct tokens of a text and how often each stands in it.

    Tokens as in ``text_sums``; without ``apostrophes`` the runs of [a-z0-9].
    """
    of_class = _IN_TOKEN if apostrophes else _IN_WORD
    made = pa.list_(pa.struct([("term", pa.string()), ("c", pa.int64())]))

    def run(text: pa.Array) -> pa.Array:
        parts = []
        for ends, data in _text_stretches(*_plain(text)):
            rows, codes, words = _text_coded(ends, data, of_class)
            runs, count = np.unique(rows * max(len(words), 1) + codes, return_counts=True)
            row, code = np.divmod(runs, max(len(words), 1))
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ends) - 1))]).astype(np.int32)
            cells = pa.StructArray.from_arrays([words.take(pa.array(code)).cast(pa.string()), pa.array(count.astype(np.int64))], ["term", "c"])
            parts.append(pa.ListArray.from_arrays(pa.array(upto), cells).cast(made))
        return pa.concat_arrays(parts) if parts else pa.array([], made)
    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<term: string, c: bigint>>")(text)
