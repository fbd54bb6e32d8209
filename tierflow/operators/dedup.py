"""Deduplication.

Exact: one aggregation keyed by the hash of the cleaned text; the survivor
is the lowest id. Partial aggregation makes a hot key (a text copied a
million times) cost one row per task before the shuffle.

Near: exact Jaccard similarity over word 3-gram shingles, candidates by
prefix filtering, in ascending order of ids up to the first match (see
``dedup_near``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import bounded_buckets, exact_rank

#: Shingles a task counts the holders of, and rows up to which a side of a join goes to all tasks instead of shuffling the other.
SHINGLES_A_TASK = 1 << 22
BROADCAST_ROWS = 1 << 19


def dedup_exact(df: DataFrame, id_col: str = "id", text_col: str = "clean") -> DataFrame:
    """(survivor id, copies) per distinct text."""
    return df.groupBy(F.md5(F.col(text_col)).alias("_k")).agg(
        F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_copies")).drop("_k")


def shingles(tokens: Column, k: int = 3) -> Column:
    """Word k-gram shingles (k = 3); texts shorter than k give one shingle of
    all tokens. Built with zip_with over shifted copies, so the token array
    is read a constant number of times (no per-position lambda lookups)."""
    n = F.size(tokens)
    assert k == 3, "k = 3 shingles"
    ab = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    abc = F.zip_with(ab, F.slice(tokens, 3, F.greatest(n, F.lit(1))), lambda x, c: F.concat(x, F.lit(" "), c))
    grams = F.filter(abc, lambda x: x.isNotNull())
    return (F.when(n == 0, F.array().cast("array<string>"))
            .when(n < k, F.array(F.array_join(tokens, " "))).otherwise(grams))


def dedup_near(df: DataFrame, id_col: str = "id", tokens_col: str = "tokens", k: int = 3, min_similarity: float = 0.7) -> DataFrame:
    """(id, is_near_duplicate, dup_of, similarity) for every row: exact.

    A row is a near duplicate if the Jaccard similarity of its distinct
    shingles to those of a lower id is at least ``min_similarity``; dup_of is
    the lowest such id. Equal shingle sets are one class, known by its lowest
    id. A class that holds too many shingles alone has no match
    (``_open_classes``); the sets of the others are all that moves from there on.
    Two sets that similar share a shingle among the rarest of each (all
    but the share they must have in common), so a class meets others on
    those alone, in ascending order of their ids, and stops at its first
    match (``_first_matches``).
    """
    sets = df.select(F.col(id_col).alias("_id"), F.sort_array(F.array_distinct(F.transform(shingles(F.col(tokens_col), k), lambda g: F.xxhash64(g)))).alias("_s"))
    # no condition on _s before the cut: pushed down, it would build the sets again
    marked = cut_lineage(sets.withColumn("_c", F.xxhash64("_s", F.size("_s")))).where("size(_s) > 0")
    open_ = marked.join(_few(cut_lineage(_open_classes(marked, min_similarity))), "_c", "left_semi")
    classes = cut_lineage(open_.groupBy("_c").agg(F.min("_id").alias("_least"), F.any_value("_s").alias("_s")))
    best = _first_matches(classes, min_similarity)
    ids = marked.select("_id", "_c")
    found = (ids.join(ids.groupBy("_c").agg(F.min("_id").alias("_least")), "_c").join(best, "_c", "left")
             .withColumn("_b", F.coalesce("_b", F.struct(F.col("_least").alias("_to"), F.lit(1.0).alias("_sim"))))
             .where(F.col("_b._to") < F.col("_id")).select(F.col("_id").alias(id_col), "_b"))
    return df.select(id_col).join(found, id_col, "left").select(
        id_col, F.col("_b").isNotNull().alias("is_near_duplicate"), F.col("_b._to").alias("dup_of"), F.col("_b._sim").alias("similarity"))


def _few(df: DataFrame) -> DataFrame:
    """A frame whose lineage is cut, to be broadcast if it has few rows: the other side of a join stays where it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _open_classes(marked: DataFrame, min_similarity: float) -> DataFrame:
    """(_c): classes that hold enough shingles together with any others to be that similar to one.

    Only a shingle and its holder move, in the order of the rows, so that the
    holder costs next to nothing; what comes back is a count a class and task.
    """
    sizes = marked.groupBy("_c").agg(F.any_value(F.size("_s")).alias("_n"))
    tasks = -(-(marked.agg(F.sum(F.size("_s")).alias("n")).first()["n"] or 0) // SHINGLES_A_TASK)
    tasks = max(tasks, int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    holders = marked.select("_c", F.explode("_s").alias("_g")).repartition(tasks, "_g").groupBy("_g").agg(F.min("_c").alias("_c"), F.max("_c").alias("_other"))
    own = holders.where("_c = _other").groupBy("_c").agg(F.count(F.lit(1)).alias("_own"))
    return sizes.join(own, "_c", "left").where(F.col("_n") - F.coalesce("_own", F.lit(0)) >= F.ceil(F.col("_n") * F.lit(min_similarity) - 1e-9)).select("_c")


def _rare_shingles(classes: DataFrame, min_similarity: float) -> DataFrame:
    """(_c, _least, _n, _held, _i, _g): per class the shingles that a class so similar must share one of.

    A class's shingles that others hold, too, in order of rarity: ``_held``
    of them, ``_i`` counts from 0. Its own ones come first in that order and
    match nothing: they are just counted.
    """
    held = classes.select("_c", "_least", F.size("_s").alias("_n"), F.explode("_s").alias("_g"))
    shared = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    room = F.size("_o") - F.ceil(F.col("_n") * F.lit(min_similarity) - 1e-9).cast("int") + 1
    return (held.join(shared, "_g").groupBy("_c", "_least", "_n").agg(F.sort_array(F.collect_list(F.struct("_df", "_g"))).alias("_o")).where(room > 0)
            .select("_c", "_least", "_n", F.size("_o").alias("_held"), F.posexplode(F.slice("_o", 1, room)).alias("_i", "_p")).select("_c", "_least", "_n", "_held", "_i", F.col("_p._g").alias("_g")))


def _verified(pairs: DataFrame, sets: DataFrame, min_similarity: float) -> DataFrame:
    """The pairs (_c, _d) whose whole sets are that similar, with ``_sim``."""
    both = F.size(F.array_intersect("_s", "_s2"))
    pairs = _few(cut_lineage(pairs))
    right = sets.select(F.col("_c").alias("_d"), F.col("_s").alias("_s2")).join(pairs.select("_c", "_d"), "_d")
    return (sets.join(pairs, "_c").join(right, ["_c", "_d"])
            .withColumn("_sim", both / (F.size("_s") + F.size("_s2") - both).cast("double")).where(F.col("_sim") >= min_similarity))


def _first_matches(classes: DataFrame, min_similarity: float, growth: int = 4) -> DataFrame:
    """(_c, _b (_to, _sim)): per class its match with the lowest id, if that is below its own.

    The classes that hold a rare shingle stand in ascending order of their
    ids. A round takes, for each class and shingle, the next few of those in
    front of it (``growth`` times as many in each round), sorts out pairs
    whose sizes, or whose places in the order of rarity, leave too few
    shingles to share, and verifies the others on their whole sets. A list is
    left as soon as it has come to the class's best match: of k edited copies
    of a text, each looks at a bounded number in front of it, not at k.
    Rounds grow with the logarithm of the longest list.
    """
    rare = bounded_buckets(cut_lineage(_rare_shingles(classes, min_similarity)), "_least")
    ranked = cut_lineage(exact_rank(rare, ["_g"], F.col("_bucket"), ["_least"], out="_pos"))
    front = ranked.where("_pos > 1").select("_c", "_least", "_n", "_held", "_i", "_g", "_pos")
    other = ranked.select("_g", F.col("_pos").alias("_at"), F.col("_c").alias("_d"), F.col("_least").alias("_to"), F.col("_n").alias("_m"), F.col("_held").alias("_held2"), F.col("_i").alias("_j"))
    sets = classes.select("_c", "_s")
    best = classes.select("_c", F.lit(None).cast(f"struct<_to: {classes.schema['_least'].dataType.simpleString()}, _sim: double>").alias("_b")).where("false")
    at, step, rows = 1, 1, front.count()
    while True:
        # all lists that go on have come to the same place, so a round reads a stretch of places
        asked = front.withColumn("_at", F.explode(F.sequence(F.lit(at).cast("long"), F.least(F.lit(at + step - 1), F.col("_pos") - 1))))
        asked = F.broadcast(asked) if rows * step <= BROADCAST_ROWS else asked
        fetched = cut_lineage(other.where(F.col("_at").between(at, at + step - 1)).join(asked, ["_g", "_at"]).join(best, "_c", "left")
                              .where(F.col("_b").isNull() | (F.col("_to") < F.col("_b._to"))))
        need = F.ceil((F.col("_n") + F.col("_m")) * F.lit(min_similarity / (1 + min_similarity)) - 1e-9)
        most = 1 + F.least(F.col("_held") - F.col("_i"), F.col("_held2") - F.col("_j")) - 1
        pairs = fetched.where((F.least("_n", "_m") >= F.greatest("_n", "_m") * F.lit(min_similarity) - 1e-9) & (most >= need)).select("_c", "_d", "_to").distinct()
        near = _verified(pairs, sets, min_similarity)
        best = cut_lineage(best.unionByName(near.select("_c", F.struct("_to", "_sim").alias("_b"))).groupBy("_c").agg(F.min("_b").alias("_b")))
        # a list goes on behind what it has reached, while that is below the class's best match and in front of the class
        reached = fetched.groupBy("_c", "_g").agg(F.max("_to").alias("_reached"))
        front = cut_lineage(front.where(F.col("_pos") > at + step).join(reached, ["_c", "_g"]).join(best, "_c", "left")
                            .where(F.col("_b").isNull() | (F.col("_reached") < F.col("_b._to"))).drop("_reached", "_b"))
        rows = front.count()
        if rows == 0:
            return best
        at, step = at + step, step * growth


def word_ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by a space; texts shorter than n have none."""
    size = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                  tokens_col: str = "tokens", n: int = 5, min_containment: float = 0.8) -> DataFrame:
    """(doc, item, containment): share of an item's distinct word n-grams
    that occur in the document, kept when >= min_containment. Adaptive execution
    broadcasts the item shingles if their measured size allows; only matches
    are aggregated."""
    ish = items.select(item_id, F.explode(F.array_distinct(word_ngrams(F.col(tokens_col), n))).alias("sh"))
    isz = ish.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_sh"))
    dsh = docs.select(doc_id, F.explode(F.array_distinct(word_ngrams(F.col(tokens_col), n))).alias("sh"))
    hits = dsh.join(ish, "sh", "inner") \
              .groupBy(doc_id, item_id).agg(F.count(F.lit(1)).alias("n_hit"))
    return hits.join(isz, item_id, "inner") \
               .withColumn("containment", F.col("n_hit") / F.col("n_sh")) \
               .filter(F.col("containment") >= min_containment) \
               .select(doc_id, item_id, "containment")
