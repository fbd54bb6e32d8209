"""Audit of how far the sources of a language differ in their terms, by count cells.

Counts decide everything: two terms with equal counts in a group and in its
language have the same value there. So values are not evaluated and ranked
term by term but cell by cell:

1. Tasks count terms by (language, source) before anything moves; one shuffle
   on (language, term) gives each term's counts, its count in the language and
   in how many of the language's documents it stands.
2. Terms of a group fall into cells (group count, language count) with a
   multiplicity. The value is evaluated once a cell, cells of equal value
   merge, and cumulative multiplicities tell which values reach the ranks
   asked for. Only those cells are expanded into terms, in UTF-8 order.
3. The value of a pair of sources is a sum over all kept terms, most of which
   stand in neither or one of the two. With f(a, b) the value at counts a
   and b, that sum is V f(0, 0) + sum_a [f(a, 0) - f(0, 0)] + sum_b [f(0, b)
   - f(0, 0)] + sum_(a, b) [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]. The two
   sums over one source run over its cells of equal count; the last needs only
   the terms that stand in both sources, found by a join on the term.

All numbers are integers: decimals where a product outgrows a long.

Scale: a hot source or word is counted in the tasks first, so it is some rows
a task. Nothing is gathered: no group's terms or a term's sources in one row.
The windows that rank see at most TERM_RANKS values of a group, its sources,
or the terms of one value. Pairs grow with the square of a language's number
of sources, as the result does.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_list, checkpoint, no_cycles, read_table, row_slices

MIN_DOCS, TERM_RANKS, SCALE = 3, 200, 1_000_000_000
#: A task passes its counts on when it holds this many.
HELD = 250_000
PIECE = 1 << 20
#: A-Z to a-z; every other byte below 0x80 that is no letter to a space.
_TERMS = bytes(bytes([b]).lower()[0] if bytes([b]).isalpha() or b >= 0x80 else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a piece of it at a time."""
    text, start = text.translate(_TERMS), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (lang, source, term) occurrences and documents; a group's row without a term says that it exists."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    with no_cycles():
        for part in row_slices(batches, "text", 4 << 20):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), binary_list(part.column("text")), strict=True):
                count, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in terms_of(text):
                    count.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(docs) for _, docs in groups.values()) > HELD:
                yield from _counted(groups)
                groups = {}
        yield from _counted(groups)


def _counted(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (count, docs) in groups.items():
        terms = [None, *docs]
        yield pa.record_batch([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                               pa.array([0, *map(count.__getitem__, docs)], pa.int64()), pa.array([0, *docs.values()], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kinds)); null where there are no kept terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    below = (total + kinds).cast("decimal(19,0)")
    return F.when(kinds > 0, 1 + F.call_function("div", above, below))


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(kept, groups). kept: lang, source, term, n, in_lang (its count in the language), first (one row of each term of a language). groups: lang, source, total, kinds, lang_total, p0."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    term = Window.partitionBy("lang", "term")
    counts = (texts.mapInArrow(_count, _COUNTS).repartition("lang", "term")
              .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
              .withColumn("in_lang", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term))
              .withColumn("first", F.row_number().over(term.orderBy("source")) == 1))
    counts = checkpoint(counts.where((F.col("lang_docs") >= min_docs) | F.col("term").isNull()).drop("docs", "lang_docs"))
    kept = counts.where(F.col("term").isNotNull())
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    per_lang = per_group.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("kinds"))
    groups = (counts.where(F.col("term").isNull()).select("lang", "source").join(per_group.drop("firsts"), ["lang", "source"], "left").join(per_lang, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kinds", "lang_total")]))
    return kept, checkpoint(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kinds"))))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every other source of the language."""
    p = _share(F.col("n"), F.col("total"), F.col("kinds"))
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), "p0")
    cells = rows.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    a, b = (rows.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("p0").alias(f"p0_{s}")) for s in ("source", "item"))
    pa_, pb, za, zb = (F.col(c) for c in ("p_source", "p_item", "p0_source", "p0_item"))
    both = (a.join(b, ["lang", "term"]).where("source <> item").groupBy("lang", "source", "item")
            .agg(F.sum(_value(pa_, pb) - _value(pa_, zb) - _value(za, pb) + _value(za, zb)).alias("part")))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("z"))
    across = cells.join(other, "lang").where("source <> other")
    p_, p0, z, m = (F.col(c) for c in ("p", "p0", "z", "m"))
    mine = across.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(m * (_value(p_, z) - _value(p0, z))).alias("part"))
    theirs = across.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(F.sum(m * (_value(z, p_) - _value(z, p0))).alias("part"))
    neither = (groups.join(other, "lang").where("source <> other")
               .select("lang", "source", F.col("other").alias("item"), F.coalesce(F.col("kinds") * _value(p0, z), F.lit(0)).alias("part")))
    return neither.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has above its language's share, to rank `ranks`."""
    p, q = _share(F.col("n"), F.col("total"), F.col("kinds")), _share(F.col("in_lang"), F.col("lang_total"), F.col("kinds"))
    cells = (kept.groupBy("lang", "source", "n", "in_lang").agg(F.count(F.lit(1)).alias("m")).join(groups.drop("p0"), ["lang", "source"])
             .withColumn("p", p).withColumn("q", q).where("n > 0 and p > q")
             .select("lang", "source", "n", "in_lang", "m", _value(F.col("p"), F.col("q")).alias("value")))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = (cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
              .withColumn("nth", F.row_number().over(group)).where(F.col("nth") <= ranks)  # each value is a term at least
              .withColumn("before", F.coalesce(F.sum("m").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .where(F.col("before") < ranks).select("lang", "source", "value", "before"))
    reach = cells.drop("m").join(values, ["lang", "source", "value"])
    alike = Window.partitionBy("lang", "source", "value").orderBy("term")
    return (kept.join(reach, ["lang", "source", "n", "in_lang"]).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= ranks)
            .withColumn("rank", (F.col("before") + F.col("nth")).cast("int")).where(F.col("rank") <= ranks)
            .select("lang", "source", F.col("term").alias("item"), "value", "rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of `docs`.

    Reads the columns lang, source and text, nulls as ''; others don't
    matter. Every row is a document, also if repeated. Groups without terms
    are in the part `pair` like any other; a language without kept terms has
    values 0 there and no rows in the part `term`. A language of one source
    has no pairs. Ties go to the smaller item in UTF-8 order. No rows: no
    rows.
    """
    kept, groups = term_counts(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(order).cast("int"))
    terms = term_values(kept, groups, ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS in_lang FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS kinds, sum(in_lang) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.in_lang FROM g JOIN k ON k.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + ({SCALE} * (x.n + 1)::HUGEINT) // (t.total + v.kinds) AS p,
      1 + ({SCALE} * (x.in_lang + 1)::HUGEINT) // (v.total + v.kinds) AS q
      FROM x JOIN t ON t.lang = x.lang AND t.source = x.source JOIN v ON v.lang = x.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
