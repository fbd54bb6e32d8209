"""Vectoriser features (M1-M4) as relational operators.

tf = 1 + ln(count) (sublinear), idf = ln((1 + n) / (1 + df)) + 1, rows
L2-normalised; vocabulary = terms with df >= min_df, the max_features most
frequent (ties by term) if a cap is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyzer_tokens
from ..functions.token_sums import text_counts
from .scoring import bigrams


def terms(df: DataFrame, text_col: str = "clean", id_col: str = "id", ngram_max: int = 2,
          cleaned: bool = True) -> DataFrame:
    """(id, term) rows: uni-grams and, if ngram_max >= 2, bi-grams.

    ``cleaned``: the input is output of clean_text (only [a-z0-9' ]), where
    accent stripping and lower-casing are no-ops and word-character runs
    are runs of [a-z0-9]; matching those gives the same tokens cheaper."""
    if cleaned:
        t = F.regexp_extract_all(F.col(text_col), F.lit("[a-z0-9]+"), 0)
    else:
        t = analyzer_tokens(text_col)
    feats = F.concat(t, bigrams(t)) if ngram_max >= 2 else t
    return df.select(id_col, F.explode(feats).alias("term"))


def term_counts(df: DataFrame, text_col: str = "clean", id_col: str = "id", ngram_max: int = 2,
                cleaned: bool = True) -> DataFrame:
    """(id, term, c). Texts are dealt by id before they are taken apart, so that
    counting moves each text once, not each of its terms. Uni-grams of cleaned
    (or stripped) text are counted over all texts of an id, laid behind each other."""
    if cleaned and ngram_max < 2:
        whole = df.select(id_col, text_col).groupBy(id_col).agg(F.array_join(F.collect_list(text_col), " ").alias("_t"))
        return whole.select(id_col, F.explode(text_counts(F.col("_t"), apostrophes=False)).alias("_t")).select(id_col, "_t.term", "_t.c")
    dealt = df.select(id_col, text_col).repartition(id_col)
    return terms(dealt, text_col, id_col, ngram_max, cleaned).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("c"))


def vocabulary(tc: DataFrame, min_df: int = 2, max_features: int | None = None, id_col: str = "id") -> DataFrame:
    """Terms in at least ``min_df`` rows; ``max_features`` keeps the most frequent (M3's own cap, off by default)."""
    v = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("tf")).filter(F.col("df") >= min_df)
    if max_features is None:
        return v
    # the tf of the last term kept, from a histogram of tf (far fewer rows than terms); ties at it go by term
    by_tf = Window.orderBy(F.col("tf").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = v.groupBy("tf").agg(F.count(F.lit(1)).alias("_n")).withColumn("_sum", F.sum("_n").over(by_tf))
    cut = cut.where(F.col("_sum") - F.col("_n") < max_features).select("tf", (F.lit(max_features) - F.col("_sum") + F.col("_n")).alias("_room"), "_n")
    whole = v.join(cut, "tf")
    last = Window.partitionBy("tf").orderBy("term")
    edge = whole.where("_room < _n").withColumn("_r", F.row_number().over(last)).where("_r <= _room")
    return whole.where("_room >= _n").select(*v.columns).unionByName(edge.select(*v.columns))


def tfidf(tc: DataFrame, vocab: DataFrame, n_docs: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, term, weight) for vocabulary terms; n_docs is a one-row frame (n)."""
    j = tc.join(vocab.select("term", "df"), "term", "inner")
    w = (F.lit(1.0) + F.log(F.col("c").cast("double"))) * \
        (F.log((F.lit(1.0) + n_docs.scalar()) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))  # over one row's terms
    return j.withColumn("w", w).select(id_col, "term", (F.col("w") / norm).alias("weight"))
