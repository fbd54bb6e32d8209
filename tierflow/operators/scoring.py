"""Scorers: DataFrame(id, tokens/text) -> prediction, confidence.

Two kinds share one contract (columns ``<p>pred`` and ``<p>conf``):

* ``ExprScorer`` - a model written as Column expressions (JVM-side, lazy per
  row, so ``when(escalate, tier2)`` evaluates tier 2 only on escalated rows).
  ``HashedLinearScorer`` is a deterministic *stand-in* linear model used for
  oracle-checked routing: weight(t) = 2*u(md5(key||t)) - 1,
  p = sigmoid(sum(w)/sqrt(n)), confidence = max(p, 1-p). No transformer
  runtime ships with this repo; real models plug in as ``PandasBatchScorer``.
* ``PandasBatchScorer`` - any Python ``texts -> (preds, confs)`` callable run
  through ``mapInPandas`` (Arrow batches, model loaded once per Python
  worker). Route with filter + union so it only sees escalated rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signals import sigmoid
from ..functions.token_sums import hashed_weight_sum, text_counts, text_sums


@dataclass(frozen=True)
class ScorerConfig:
    """Model presets (M11). ``max_length`` None = whole text (default here);
    the reference's tiers truncate at 128 / 256 tokens."""
    name: str
    batch_size: int
    max_length: int | None = None
    label_map: dict | None = None


TIER1_PRESET = ScorerConfig("tier1", batch_size=32)
TIER2_PRESET = ScorerConfig("tier2", batch_size=16)


def bigrams(tokens: Column) -> Column:
    nxt = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(tokens, nxt, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda x: x.isNotNull())


class ExprScorer:
    name: str = "expr"

    def columns(self, tokens: Column) -> tuple[Column, Column]:  # pragma: no cover - interface
        raise NotImplementedError

    def prob(self, tokens: Column) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def sums(self, text: Column, entropy: bool = False) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def prob_of(self, sums: Column) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def with_scores(self, df: DataFrame, tokens_col: str = "tokens", pred_col: str = "pred",
                    conf_col: str = "conf", only_if: Column | None = None, text_col: str | None = None,
                    sums_col: str | None = None) -> DataFrame:
        """Adds (pred, conf). The probability is materialised in its own
        column first: pred and conf both read it, and an expensive
        expression read twice is not re-inlined by the optimizer, so the
        model runs once per row (and only where ``only_if`` holds).

        With ``text_col``, the stripped text the tokens lie in, the model's
        sums come from it (``sums``) and no array of tokens is built; with
        ``sums_col`` they stand there already."""
        tmp = f"_prob_{pred_col}"
        # an Arrow pass sees all rows: tokens of the others don't go to it
        of = lambda c: c if only_if is None else F.when(only_if, c)
        if text_col or sums_col:
            made = sums_col or f"_sums_{pred_col}"
            scored = df if sums_col else df.withColumn(made, self.sums(of(F.col(text_col))))
            out = scored.withColumn(tmp, of(self.prob_of(F.col(made))))
            out = out if sums_col else out.drop(made)
        else:
            out = df.withColumn(tmp, of(self.prob(of(F.col(tokens_col)))))
        pv = F.col(tmp)
        out = out.withColumn(pred_col, F.when(pv.isNull(), F.lit(None)).otherwise(
            F.when(pv > 0.5, F.lit(1)).otherwise(F.lit(0))).cast("int")) \
                 .withColumn(conf_col, F.greatest(pv, F.lit(1.0) - pv))
        return out.drop(tmp)

    def score(self, df: DataFrame, tokens_col: str = "tokens", prefix: str = "") -> DataFrame:
        return self.with_scores(df, tokens_col, f"{prefix}pred", f"{prefix}conf")


@dataclass
class HashedLinearScorer(ExprScorer):
    """Stand-in linear model on hashed token weights (uni- or uni+bi-grams)."""
    name: str = "tier1"
    key: str = "t1:"
    use_bigrams: bool = False
    max_length: int | None = None

    def prob(self, tokens: Column) -> Column:
        t = F.slice(tokens, 1, self.max_length) if self.max_length else tokens
        s = hashed_weight_sum(t, self.key, self.use_bigrams)
        return self._prob(F.size(t), s)

    def sums(self, text: Column, entropy: bool = False) -> Column:
        if self.max_length:
            raise ValueError("a model of the first tokens takes tokens")
        return text_sums(text, self.key, self.use_bigrams, entropy)

    def prob_of(self, sums: Column) -> Column:
        return self._prob(sums["n"], sums["w"])

    def _prob(self, k: Column, s: Column) -> Column:
        # feature count from the token count (no second pass over the features)
        n = (k + F.greatest(k - 1, F.lit(0))) if self.use_bigrams else k
        return F.when(n > 0, sigmoid(s / F.sqrt(n.cast("double")))).otherwise(F.lit(0.5))

    def columns(self, tokens: Column) -> tuple[Column, Column]:
        p = self.prob(tokens)
        # argmax over [1-p, p]; a tie goes to the lower index (class 0)
        return (F.when(p > 0.5, F.lit(1)).otherwise(F.lit(0)).cast("int"),
                F.greatest(p, F.lit(1.0) - p))


def tier1_scorer(max_length: int | None = None) -> HashedLinearScorer:
    return HashedLinearScorer(name="tier1", key="t1:", use_bigrams=False, max_length=max_length)


def tier2_scorer(max_length: int | None = None) -> HashedLinearScorer:
    return HashedLinearScorer(name="tier2", key="t2:", use_bigrams=True, max_length=max_length)


# --------------------------------------------------------------------------
# Python models through Arrow batches (M6/M8)
# --------------------------------------------------------------------------

_MODELS: dict = {}


def _loaded(factory: Callable[[], Callable]) -> Callable:
    """The worker's model of a factory: made on first use, kept for the tasks that follow."""
    key = (factory.__module__, getattr(factory, "__qualname__", repr(factory)))
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


@dataclass
class PandasBatchScorer:
    """Run ``factory()`` -> ``predict(texts) -> (preds, confs)`` per Arrow batch.

    The factory, a function of an importable module, is called once per Python
    worker process; batches are sliced to ``batch_size`` rows, and each row
    gets the per-row share of its batch's wall time as ``latency_s``. Rows keep
    their columns on the way through, so nothing is joined back.
    """
    name: str
    factory: Callable[[], Callable]
    batch_size: int = 32
    label_map: dict | None = None

    def score(self, df: DataFrame, text_col: str = "text", prefix: str = "",
              id_col: str = "id") -> DataFrame:
        factory, bs, lmap = self.factory, self.batch_size, self.label_map
        schema = T.StructType([*df.schema.fields, T.StructField(f"{prefix}pred", T.IntegerType()),
                               T.StructField(f"{prefix}conf", T.DoubleType()),
                               T.StructField(f"{prefix}latency_s", T.DoubleType())])

        def run(batches):
            from tierflow.operators import scoring  # the worker's module, not a copy sent with the task
            model = scoring._loaded(factory)
            for pdf in batches:
                for s in range(0, len(pdf), bs):
                    part = pdf.iloc[s:s + bs]
                    texts = part[text_col].fillna("").tolist()
                    t0 = time.perf_counter()
                    preds, confs = model(texts)
                    el = (time.perf_counter() - t0) / max(len(texts), 1)
                    preds = [int(lmap.get(int(p), int(p))) if lmap else int(p) for p in preds]
                    yield part.assign(**{f"{prefix}pred": preds, f"{prefix}conf": [float(c) for c in confs],
                                         f"{prefix}latency_s": [el] * len(texts)})

        return df.mapInPandas(run, schema)


# --------------------------------------------------------------------------
# label maps
# --------------------------------------------------------------------------

def autodetect_label_map(names: DataFrame) -> DataFrame:
    """(model, idx, name) -> (model, idx, name, mapped): 'neg'/label_0/0/false -> 0,
    'pos'/label_1/1/true -> 1, otherwise 0 only for the model's lowest idx."""
    low = F.lower(F.col("name"))
    lowest = F.min("idx").over(Window.partitionBy("model"))
    mapped = (F.when(low.contains("neg") | low.isin("label_0", "0", "false"), F.lit(0))
              .when(low.contains("pos") | low.isin("label_1", "1", "true"), F.lit(1))
              .when(F.col("idx") == lowest, F.lit(0)).otherwise(F.lit(1)))
    return names.withColumn("mapped", mapped.cast("int"))


def remap_predictions(raw: DataFrame, label_map: DataFrame, override: DataFrame | None = None, raw_col: str = "raw_pred") -> DataFrame:
    """Raw output ids as classes, per model of ``label_map`` (model, idx,
    mapped); entries of ``override`` (model, idx, mapped) win. Ids without an
    entry are left out."""
    maps = label_map.select("model", "idx", "mapped")
    if override is not None:
        wins = override.select("model", "idx", F.col("mapped").alias("_wins"))
        maps = maps.join(wins, ["model", "idx"], "left").select("model", "idx", F.coalesce("_wins", "mapped").cast("int").alias("mapped"))
    maps = maps.select("model", F.col("idx").alias(raw_col), F.col("mapped").alias("prediction"))
    return raw.join(maps, raw_col)


# --------------------------------------------------------------------------
# linear scoring by join (M7) and the baseline (M5)
# --------------------------------------------------------------------------

def linear_score_by_join(docs: DataFrame, weights: DataFrame, id_col: str = "id",
                         tokens_col: str = "tokens", intercept: float = 0.0, text_col: str | None = None) -> DataFrame:
    """sum of term weights per row -> sigmoid -> (pred, conf).

    Tokens are counted per (row, token) before they meet the weight table,
    which adaptive execution broadcasts if its measured size allows. With
    ``text_col``, the stripped text the tokens lie in, that is done where the
    text is, without a shuffle; rows of an id add up in the sum.
    """
    if text_col:
        cells = docs.select(id_col, F.explode(text_counts(F.col(text_col))).alias("_t"))
        return score_features(docs.select(id_col), cells.select(id_col, F.col("_t.term").alias("term"), F.col("_t.c").cast("double").alias("value")), weights, intercept, id_col)
    counts = docs.select(id_col, F.explode(tokens_col).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return score_features(docs.select(id_col), counts, weights, intercept, id_col)


def score_features(ids: DataFrame, features: DataFrame, weights: DataFrame, intercept: float = 0.0, id_col: str = "id") -> DataFrame:
    """M7: (id, pred, conf) of a linear model over (id, term, value) rows; terms without a weight count nothing."""
    # hashed, not sorted: terms are long keys, and the table has each once
    s = features.join(weights.select("term", "weight").hint("shuffle_hash"), "term").groupBy(id_col).agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
    p = sigmoid(F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(intercept))
    return (ids.join(s, id_col, "left")
            .select(id_col, F.when(p > 0.5, 1).otherwise(0).cast("int").alias("pred"),
                    F.greatest(p, 1 - p).alias("conf")))


@dataclass
class LinearBaseline:
    """The fitted baseline: what M4 needs of the train rows, and the (term, weight) table."""
    vocabulary: DataFrame
    n_docs: DataFrame
    weights: DataFrame
    intercept: float

    @cached_property
    def indexed(self) -> DataFrame:
        """(term, i): the terms numbered in an order of their own."""
        from ..session import cut_lineage
        from .scan import exact_hash_rank
        ranked = exact_hash_rank(self.vocabulary.withColumn("_h", F.md5("term")), [], "_h", "term", "i")
        return cut_lineage(ranked.select("term", (F.col("i") - 1).cast("int").alias("i")))

    @cached_property
    def coefficients(self) -> np.ndarray:
        """The weights by number, all on the driver."""
        found = self.indexed.join(self.weights, "term").select("i", "weight").toArrow()
        out = np.zeros(max(1, len(found)))
        out[found["i"].to_numpy()] = found["weight"].to_numpy()
        return out

    @property
    def model(self):
        """The weights as a Spark ML model, for vectors of ``sparse_rows``."""
        from pyspark.ml.classification import LogisticRegressionModel
        from pyspark.ml.linalg import DenseVector
        return LogisticRegressionModel._create_from_java_class("org.apache.spark.ml.classification.LogisticRegressionModel", "tierflow_baseline", DenseVector(self.coefficients), self.intercept)

    def features(self, df: DataFrame, text_col: str = "clean") -> DataFrame:
        from . import features as ft
        return ft.tfidf(ft.term_counts(df, text_col), self.vocabulary, self.n_docs)

    def predict(self, df: DataFrame, text_col: str = "clean") -> DataFrame:
        """(id, pred, conf) by joining M4's weights of the rows to the model's."""
        x = self.features(df, text_col).withColumnRenamed("weight", "value")
        return score_features(df.select("id"), x, self.weights, self.intercept)


def packed_rows(features: DataFrame, indexed: DataFrame, size: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, features), the struct a sparse vector consists of, from (id, term, weight) and (term, i).

    Ids of ``ids`` without a known term get an empty vector.
    """
    cells = features.join(indexed, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("_c"))
    if ids is not None:
        cells = ids.join(cells, "id", "left").withColumn("_c", F.coalesce("_c", F.array().cast(cells.schema["_c"].dataType)))
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("_c.i").alias("indices"), F.col("_c.weight").alias("values"))
    return cells.select("id", parts.alias("features"))


def sparse_rows(features: DataFrame, indexed: DataFrame, size: int, ids: DataFrame | None = None) -> DataFrame:
    """``packed_rows`` as Spark ML vectors: the Arrow pass only gives the struct its type."""
    from pyspark.ml.linalg import VectorUDT
    packed = packed_rows(features, indexed, size, ids)
    typed = T.StructType([packed.schema["id"], T.StructField("features", VectorUDT())])
    return packed.mapInArrow(lambda batches: batches, typed)


def train_lr(train: DataFrame, text_col: str = "clean", label_col: str = "label", C: float = 1.0,
             max_iter: int = 1000, max_features: int | None = None, min_df: int = 2, tol: float = 1e-6, settled: bool = False) -> LinearBaseline:
    """M5: logistic regression on M4's weights, fitted by passes of Spark jobs (``logistic``).

    Minimises the summed log loss plus |w|^2 / (2 C), the intercept without
    a penalty. The driver holds vectors of a number a row; terms, their cells and
    weights stay on the executors (``term_blocks.TermMatrix``). ``max_features`` is the
    reference's own vocabulary cap, off by default; under it the coefficients
    live on the driver. ``settled``: ``train`` is a checkpoint already.
    """
    from ..session import settle
    from . import logistic
    from .term_blocks import TermMatrix
    rows = train.select("id", F.col(label_col).cast("double").alias("label"), F.col(text_col).alias("clean"))
    rows = rows if settled else settle(rows)
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
    if max_features is not None:
        return _train_capped(rows, n, C, max_iter, max_features, min_df, tol)
    matrix = TermMatrix(rows, n.first()[0], min_df)
    a, intercept = logistic.fit_by_terms(matrix, C, max_iter, tol)
    table = settle(matrix.weights(a))
    return LinearBaseline(table.select("term", "df"), n, table.select("term", "weight"), intercept)


def _train_capped(rows: DataFrame, n: DataFrame, C: float, max_iter: int, max_features: int, min_df: int, tol: float) -> LinearBaseline:
    import pyarrow as pa

    from ..session import cut_lineage
    from . import features as ft
    from . import logistic
    counts = ft.term_counts(rows)
    model = LinearBaseline(cut_lineage(ft.vocabulary(counts, min_df, max_features)), n, None, 0.0)
    size = max(1, model.indexed.count())
    x = cut_lineage(packed_rows(ft.tfidf(counts, model.vocabulary, n), model.indexed, size, rows.select("id")).join(rows.select("id", "label"), "id"))
    w, model.intercept = logistic.fit(x.select("label", "features.indices", "features.values"), size, C, max_iter, tol)
    table = rows.sparkSession.createDataFrame(pa.table({"i": pa.array(range(size), pa.int32()), "weight": w}))
    model.weights = cut_lineage(model.indexed.join(table, "i").select("term", "weight"))
    return model


def lr_predict(model: LinearBaseline, df: DataFrame, text_col: str = "clean") -> DataFrame:
    return model.predict(df, text_col)


def lr_gradient_norms(model: LinearBaseline, train: DataFrame, label_col: str = "label", text_col: str = "clean", C: float = 1.0, settled: bool = False) -> DataFrame:
    """(n_train, at_fit, at_zero): Euclidean norms of the gradient of M5's
    penalised loss over ``train``, at the model's weights and at zero ones.

    Component j is the sum over rows of x_ij (p_i - y_i), plus w_j / C but
    for the intercept. The terms of ``train``, counted anew, meet the (term, df, weight)
    table in shards of terms; margins are summed over the shards, and each shard then has its
    components. ``settled``: ``train`` is a checkpoint already.
    """
    from ..session import settle
    from .logistic import _sigmoid
    from .term_blocks import TermMatrix
    rows = train.select("id", F.col(label_col).cast("double").alias("label"), F.col(text_col).alias("clean"))
    rows = rows if settled else settle(rows)
    x = TermMatrix(rows, model.n_docs.first()[0], table=model.vocabulary.join(model.weights, "term"))
    known = x.ids["id"].is_valid().to_numpy(zero_copy_only=False)  # a null id meets no term
    copies, y = x.ids["copies"].to_numpy(), x.ids["label"].to_numpy()
    r = copies * _sigmoid(np.where(known, x.margins(), 0.0) + model.intercept) - y
    z = 0.5 * copies - y
    both = x.summed(lambda s, v: np.array([np.square(s.back(v[0]) + s.weight / C).sum(), np.square(s.back(v[1])).sum()]), (r * known, z * known), 2)
    found = (rows.count(), float(np.sqrt(both[0] + r.sum() ** 2)), float(np.sqrt(both[1] + z.sum() ** 2)))
    return rows.sparkSession.createDataFrame([found], "n_train long, at_fit double, at_zero double")
