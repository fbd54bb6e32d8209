"""Terms of texts by blocks of texts and shards of terms (M1-M5).

Counting (row, term) pairs as rows of a table moves each of them several
times. Here texts are dealt into blocks by id. A block is one task's work: it
codes its terms as numbers, and sends each distinct term once, with the number
of its rows, to the shard that the term's hash names. A shard sees all of what
the blocks say of its terms and answers in the order it was asked, so that no
term comes back. A block codes its texts alike each time: its terms stand in the
order of their words, its rows in the order of ids.

Terms are uni-grams and bi-grams of cleaned text (runs of [a-z0-9]); those of
all rows of an id count together, and no bi-gram reaches over a row's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.token_sums import _IN_WORD, _plain, _text_coded
from ..session import settle

#: Bytes of text of a block: bounds a task's memory. An id's texts are never parted.
BLOCK_BYTES = 1 << 23
#: Rows of a batch that goes back.
BATCH = 1 << 16


def blocks_for(size: int | None) -> int:
    return max(1, -(-(size or 0) // BLOCK_BYTES))


@dataclass
class Coded:
    """A block: distinct ids in ascending order (a null last), its terms as pairs of words, and their cells."""
    ids: pa.Array
    words: pa.Array
    first: np.ndarray
    second: np.ndarray  # -1: a uni-gram
    ends: np.ndarray  # of each term's cells
    row: np.ndarray
    n: np.ndarray

    @cached_property
    def df(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def terms(self, of: np.ndarray) -> pa.Array:
        second = self.words.take(pa.array(self.second[of], mask=self.second[of] < 0))
        return pc.binary_join_element_wise(self.words.take(pa.array(self.first[of])), second, pa.scalar(" ", pa.large_string()), null_handling="skip")

    def dealt(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """The terms of each shard that has some, in their order."""
        shard = _shard(_hashes(self.words), self.first, self.second, shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        yield from ((s, order[bounds[s]:bounds[s + 1]]) for s in range(shards) if bounds[s] < bounds[s + 1])


def coded(ids, text) -> Coded:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    kinds = ids.dictionary_encode(null_encoding="encode")
    kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
    order = pc.array_sort_indices(kinds.dictionary, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row_of = place[kinds.indices.to_numpy()]
    at, codes, words = _text_coded(*_plain(text), _IN_WORD)
    by_word = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[by_word] = np.arange(len(words))
    code, w, size = rank[codes], len(words) + 1, max(1, len(order))
    inside = at[1:] == at[:-1]
    keys = np.concatenate([code * w, (code[:-1] * w + code[1:] + 1)[inside]])
    rows = row_of[np.concatenate([at, at[1:][inside]])]
    known = None
    if w * w * size >= 1 << 62:
        known, keys = np.unique(keys, return_inverse=True)
    cells = keys * size + rows
    cells.sort()
    new = np.flatnonzero(np.diff(cells, prepend=-1))
    n = np.diff(np.append(new, len(cells)))
    key, row = np.divmod(cells[new], size)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    term = key[start] if known is None else known[key[start]]
    first, second = np.divmod(term, w)
    return Coded(kinds.dictionary.take(pa.array(order)), words.take(pa.array(by_word)), first, second - 1, np.append(start[1:], len(key))[:len(start)], row.astype(np.int32), n)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def _shard(h: np.ndarray, first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    x, pair = h[first], second >= 0
    x[pair] = x[pair] * np.uint64(0x9E3779B97F4A7C15) + (h[second[pair]] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(shards)).astype(np.int32)


def shard_of(terms: pa.Array, shards: int) -> np.ndarray:
    """The shard of each term, as ``Coded.dealt`` deals them."""
    parts = pc.split_pattern(terms.cast(pa.large_string()), " ")
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten().dictionary_encode()
    codes, start = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, ends[:-1])[:len(terms)]
    second = np.full(len(terms), -1)
    pair = ends - start > 1
    second[pair] = codes[start[pair] + 1]
    return _shard(_hashes(flat.dictionary), codes[start], second, shards)


# --- what blocks send ---------------------------------------------------------

_ASKED = "block int, shard int, sizes binary, words binary, df binary"
_CELLS = _ASKED + ", row binary, n binary"


def _asked(block: Coded, number: int, shards: int, cells: bool) -> pa.RecordBatch:
    rows = []
    starts = block.ends - block.df
    for shard, of in block.dealt(shards):
        ends, data = _plain(block.terms(of))
        row = {"block": number, "shard": shard, "sizes": np.diff(ends).astype(np.int32).tobytes(), "words": data.tobytes(), "df": block.df[of].astype(np.int32).tobytes()}
        if cells:
            at = _runs(starts[of], block.df[of])
            row |= {"row": block.row[at].tobytes(), "n": block.n[at].astype(np.int32).tobytes()}
        rows.append(row)
    names = ["block", "shard", "sizes", "words", "df", *(["row", "n"] if cells else [])]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c in ("block", "shard") else pa.binary()) for c in names], names)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run behind the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _strings(table: pa.Table) -> pa.Array:
    """The terms of all requests, one behind the other."""
    ends = np.concatenate([[0], np.cumsum(_joined(table["sizes"], np.int32), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(x.as_py() for x in table["words"])))


def _coded_terms(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    found = _strings(table).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


@dataclass
class TermBlocks:
    """Rows (block, id, text) of ``count`` blocks; as many shards of terms."""
    rows: DataFrame
    count: int
    id_col: str

    def asked(self, cells: bool = False) -> DataFrame:
        """(block, shard, what the block says of the shard's terms)."""
        count = self.count

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [b for b in batches if b.num_rows]
            if found:
                table = pa.Table.from_batches(found)
                yield _asked(coded(table.column(1), table.column(2)), table.column(0)[0].as_py(), count, cells)
        return self.rows.mapInArrow(send, _CELLS if cells else _ASKED).repartitionById(count, "shard")


def term_blocks(df: DataFrame, count: int, text_col: str = "clean", id_col: str = "id") -> TermBlocks:
    """M1/M2 of cleaned text. Texts move once, to the partition of their block."""
    rows = df.select(_block(id_col, count).alias("block"), F.col(id_col), F.col(text_col)).repartitionById(count, "block")
    return TermBlocks(rows, count, id_col)


def _block(id_col: str, count: int):
    return F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int")


@dataclass
class BlockVocabulary:
    """M3: rows (block, shard, df) that answer the blocks' requests; df is 0 for a term in too few rows."""
    answers: DataFrame


def vocabulary(blocks: TermBlocks, min_df: int = 2) -> BlockVocabulary:
    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        codes, words = _coded_terms(table)
        df = np.bincount(codes, _joined(table["df"], np.int32), len(words)).astype(np.int64)
        df[df < min_df] = 0
        ends = np.cumsum([len(x.as_py()) // 4 for x in table["sizes"]])
        each = np.split(df[codes], ends[:-1])
        yield pa.RecordBatch.from_arrays([table["block"].combine_chunks(), table["shard"].combine_chunks(), pa.array([x.tobytes() for x in each], pa.binary())], ["block", "shard", "df"])
    return BlockVocabulary(blocks.asked().mapInArrow(answer, "block int, shard int, df binary").repartitionById(blocks.count, "block"))


def tfidf(blocks: TermBlocks, vocab: BlockVocabulary, n_docs: float) -> DataFrame:
    """M4: (id, term, weight) for vocabulary terms, as ``features.tfidf``."""
    count, id_col = blocks.count, blocks.id_col
    made = T.StructType([blocks.rows.schema[id_col], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table([pa.array([], texts.schema.field(1).type), pa.array([], pa.string()), pa.array([], pa.float64())], [id_col, "term", "weight"])
        block, said = coded(texts.column(1), texts.column(2)), dict(zip(answers["shard"].to_pylist(), answers["df"]))
        df = np.zeros(len(block.ends), np.int64)
        for shard, of in block.dealt(count):
            df[of] = np.frombuffer(said[shard].as_py(), np.int64)
        held = np.flatnonzero(df)
        idf = np.log((1.0 + n_docs) / (1.0 + df[held])) + 1.0
        at = _runs((block.ends - block.df)[held], block.df[held])
        row, w = block.row[at], (1.0 + np.log(block.n[at])) * np.repeat(idf, block.df[held])
        w /= np.sqrt(np.bincount(row, w * w, len(block.ids)))[row]
        terms, term = block.terms(held).cast(pa.string()), np.repeat(np.arange(len(held)), block.df[held])
        parts = [pa.RecordBatch.from_arrays([block.ids.take(pa.array(row[s:s + BATCH])), terms.take(pa.array(term[s:s + BATCH])), pa.array(w[s:s + BATCH])], [id_col, "term", "weight"]) for s in range(0, max(1, len(w)), BATCH)]
        return pa.Table.from_batches(parts)
    return blocks.rows.groupBy("block").cogroup(vocab.answers.groupBy("block")).applyInArrow(weigh, made)


# --- the weights of all rows, by shards of terms ------------------------------

_SHARD = "sizes binary, words binary, df binary, weight binary, ends binary, row binary, n binary"


class TermMatrix:
    """M4's weights of rows by shards of terms: a shard has all cells of its terms, and rows are numbers.

    What is summed over the terms of a row is a vector of one number a row; such vectors live on
    the driver, and nothing there grows with the vocabulary. Cells are a row's number and a count.
    ``ids``: (id, copies, label) of each row, the sum of ``label`` over the copies of an id.
    """

    def __init__(self, rows: DataFrame, n_docs: float, min_df: int = 2, table: DataFrame | None = None, label_col: str = "label", text_col: str = "clean") -> None:
        """Vocabulary: the terms in ``min_df`` ids or more, or ``table`` (term, df, weight)."""
        label = F.col(label_col).cast("double")
        count = blocks_for(rows.agg(F.sum(F.octet_length(text_col))).first()[0])
        found = rows.groupBy("id").agg(F.count(label).alias("copies"), F.coalesce(F.sum(label), F.lit(0.0)).alias("label")).withColumn("block", _block("id", count)).toArrow().combine_chunks()
        self.ids = found.take(pc.sort_indices(found, sort_keys=[("block", "ascending"), ("id", "ascending")], null_placement="at_end"))
        self.size, self.n_docs = self.ids.num_rows, n_docs
        first = np.searchsorted(self.ids["block"].to_numpy(), np.arange(count))
        asked = term_blocks(rows, count, text_col).asked(cells=True)
        if table is None:
            self.shards = asked.mapInArrow(lambda batches: _sharded(batches, None, first, min_df), _SHARD)
        else:
            def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column(0), count)), *b.columns], ["shard", "term", "df", "weight"])
            of = table.select("term", F.col("df").cast("long").alias("df"), F.col("weight").cast("double").alias("weight")).mapInArrow(deal, "shard int, term string, df long, weight double").repartitionById(count, "shard")
            self.shards = asked.groupBy("shard").cogroup(of.groupBy("shard")).applyInArrow(lambda a, b: pa.Table.from_batches(_sharded(a.to_batches(), b, first, 0), schema=_EMPTY.schema), _SHARD)
        self.shards = settle(self.shards)
        # fewer sums than shards come to the driver: a task adds up several shards
        self.dealt = self.shards.coalesce(max(1, min(count, rows.sparkSession.sparkContext.defaultParallelism)))
        self.norm = None
        self.norm = np.sqrt(self.summed(lambda s, _: s.to_rows(np.square(s.x))))
        self.norm[self.norm == 0.0] = 1.0

    def summed(self, of: Callable[["Shard", np.ndarray | None], np.ndarray], arg: np.ndarray | None = None, size: int | None = None) -> np.ndarray:
        """The sum of ``of(shard, arg)``, vectors of one number a row unless a ``size`` is given."""
        sc, n, size = self.shards.sparkSession.sparkContext, self.n_docs, self.size if size is None else size
        rows, sent = self.size, sc.broadcast((arg, self.norm))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arg, norm = sent.value
            out = np.zeros(size)
            for b in batches:
                for i in range(b.num_rows):
                    out += of(Shard(b, i, n, rows, norm), arg)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])
        out = np.zeros(size)
        for part in self.dealt.mapInArrow(run, "v binary").toLocalIterator() if rows * 8 > 1 << 26 else self.dealt.mapInArrow(run, "v binary").collect():
            out += np.frombuffer(part[0])
        sent.destroy()
        return out

    def gram(self, a: np.ndarray) -> np.ndarray:
        """X X' a, X being the rows' weights."""
        return self.summed(lambda s, a: s.times(s.back(a)), a)

    def margins(self) -> np.ndarray:
        """X w for the weights of the table."""
        return self.summed(lambda s, _: s.times(s.weight))

    def weights(self, a: np.ndarray) -> DataFrame:
        """(term, df, weight): the vocabulary, and X' a."""
        sc, n, rows = self.shards.sparkSession.sparkContext, self.n_docs, self.size
        sent = sc.broadcast((a, self.norm))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, norm = sent.value
            for b in batches:
                for i in range(b.num_rows):
                    s = Shard(b, i, n, rows, norm)
                    terms = _strings(pa.Table.from_batches([b.slice(i, 1)])).cast(pa.string())
                    yield from pa.Table.from_arrays([terms, pa.array(s.df), pa.array(s.back(a))], ["term", "df", "weight"]).to_batches(BATCH)
        return self.shards.mapInArrow(run, "term string, df long, weight double")


_EMPTY = pa.table({c: pa.array([], pa.binary()) for c in ("sizes", "words", "df", "weight", "ends", "row", "n")})


def _sharded(batches: Iterable[pa.RecordBatch], table: pa.Table | None, first: np.ndarray, min_df: int) -> Iterator[pa.RecordBatch]:
    """One row for a shard: its terms, each with its cells in the order of rows, from what the blocks sent."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    sent = pa.Table.from_batches(found)
    sent = sent.take(pc.sort_indices(sent, sort_keys=[("block", "ascending")]))
    codes, words = _coded_terms(sent)
    local = _joined(sent["df"], np.int32)
    if table is None:
        df = np.bincount(codes, local, len(words)).astype(np.int64)
        held, weight = df >= min_df, np.zeros(len(words))
    else:
        at = pc.index_in(words, value_set=table["term"].cast(pa.large_string()).combine_chunks())
        held = at.is_valid().to_numpy(zero_copy_only=False)
        df, weight = np.zeros(len(words), np.int64), np.zeros(len(words))
        at = at.drop_null().to_numpy()
        df[held], weight[held] = table["df"].to_numpy()[at], table["weight"].to_numpy()[at]
    cells = np.repeat(codes, local)
    blocks = np.repeat(first[sent["block"].to_numpy()], [len(x.as_py()) // 4 for x in sent["row"]])
    row, n = (_joined(sent["row"], np.int32) + blocks).astype(np.int32), _joined(sent["n"], np.int32)
    place = np.flatnonzero(held[cells])
    place = place[np.argsort(cells[place], kind="stable")]
    ends = np.cumsum(np.bincount(cells[place], minlength=len(words))[held])
    ends_of, data = _plain(words.take(pa.array(np.flatnonzero(held))))
    parts = [np.diff(ends_of).astype(np.int32), data, df[held], weight[held], ends.astype(np.int64), row[place], n[place].astype(np.min_scalar_type(int(n.max(initial=1))))]
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], _EMPTY.column_names)


class Shard:
    """A row of ``TermMatrix.shards``; x: its cells' weights before rows are scaled."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_docs: float, rows: int, norm: np.ndarray | None) -> None:
        _, _, df, weight, ends, row, n = (c[i].as_buffer() for c in batch.columns)
        self.df, self.weight, self.rows, self.norm = np.frombuffer(df, np.int64), np.frombuffer(weight), rows, norm
        ends, self.row = np.frombuffer(ends, np.int64), np.frombuffer(row, np.int32)
        self.term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        n = np.frombuffer(n, f"u{len(n) // max(1, len(self.row))}" if len(self.row) else np.uint8)
        self.x = (1.0 + np.log(n.astype(float))) * (np.log((1.0 + n_docs) / (1.0 + self.df)) + 1.0)[self.term]

    def to_rows(self, cells: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, cells, self.rows)

    def back(self, a: np.ndarray) -> np.ndarray:
        """X' a of the shard's terms."""
        return np.bincount(self.term, self.x * (a / self.norm)[self.row], len(self.df))

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.to_rows(self.x * w[self.term]) / self.norm
