"""Two-tier routing.

Escalate iff tier-1 confidence < threshold (strict): conf == threshold stays
on tier 1. Tier 2 must only see escalated rows:

* expression scorers: ``when(escalate, tier2)`` - CaseWhen evaluates the
  tier-2 branch only for escalated rows, one scan, no union, no shuffle;
* Python scorers: the tier-1 output is persisted, escalated rows are
  filtered and scored, and the two sides are re-joined by id (J3 overlay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TIER1_NAME, TIER2_NAME, validate_threshold
from ..session import cut_lineage
from .scoring import ExprScorer

# Stand-in cost model for the expression scorers (seconds per feature):
# deterministic "latency" columns so latency reports can be oracle-checked.
TIER1_SEC_PER_TOKEN = 1e-5
TIER2_SEC_PER_FEATURE = 4e-5


def tier_label(escalate) -> F.Column:
    """P10: tier name of a decision."""
    e = F.col(escalate) if isinstance(escalate, str) else escalate
    return F.when(e, F.lit(TIER2_NAME)).otherwise(F.lit(TIER1_NAME))


def score_tier1(df: DataFrame, t1: ExprScorer, tokens: str = "tokens", text: str | None = None, sums: str | None = None) -> DataFrame:
    """``text``, ``sums``: see ``ExprScorer.with_scores``."""
    n = F.size(tokens).cast("double")
    return t1.with_scores(df, tokens, "p1", "c1", text_col=text, sums_col=sums) \
             .withColumn("tier1_latency", n * F.lit(TIER1_SEC_PER_TOKEN))


def route_expr(scored1: DataFrame, t2: ExprScorer, escalate_col: str = "escalate",
               tokens: str = "tokens", text: str | None = None) -> DataFrame:
    """Decisions given an ``escalate`` column; tier 2 evaluated lazily per row."""
    esc = F.col(escalate_col)
    nfeat = (2 * F.size(tokens) - 1).cast("double")
    return (t2.with_scores(scored1, tokens, "p2", "c2", only_if=esc, text_col=text)
            .withColumn("tier2_latency", F.when(esc, F.greatest(nfeat, F.lit(0.0)) * TIER2_SEC_PER_FEATURE)
                        .otherwise(F.lit(0.0)))
            .withColumn("prediction", F.when(esc, F.col("p2")).otherwise(F.col("p1")))
            .withColumn("confidence", F.when(esc, F.col("c2")).otherwise(F.col("c1")))
            .withColumn("tier_used", F.when(esc, F.lit(2)).otherwise(F.lit(1)))
            .withColumn("tier", tier_label(esc)))


def route_fixed(df: DataFrame, t1: ExprScorer, t2: ExprScorer, threshold: float = 0.85,
                tokens: str = "tokens", text: str | None = None) -> DataFrame:
    """Fixed-threshold cascade over expression scorers."""
    validate_threshold(threshold)
    s1 = score_tier1(df, t1, tokens, text)
    return route_expr(s1.withColumn("escalate", F.col("c1") < F.lit(threshold)), t2, "escalate", tokens, text)


def route_fixed_frames(df: DataFrame, score1, score2, threshold: float = 0.85,
                       id_col: str = "id") -> DataFrame:
    """J2 for frame scorers (e.g. ``PandasBatchScorer.score``): score tier 1
    once (persisted: it feeds two branches), send only ``conf < threshold``
    rows to tier 2, overlay tier 2 by id (J3)."""
    validate_threshold(threshold)
    s1 = score1(df).withColumnRenamed("pred", "p1").withColumnRenamed("conf", "c1") \
        .withColumn("escalate", F.col("c1") < F.lit(threshold))
    s1 = cut_lineage(s1)  # it feeds two branches; survives lost executors, needs no release
    esc = s1.filter("escalate").select(*[c for c in df.columns])
    s2 = score2(esc)
    lat = [F.col("latency_s").alias("tier2_latency")] if "latency_s" in s2.columns else []
    s2 = s2.select(id_col, F.col("pred").alias("p2"), F.col("conf").alias("c2"), *lat)
    return overlay(s1, s2, id_col)


def overlay(s1: DataFrame, s2: DataFrame, id_col: str = "id") -> DataFrame:
    """Tier-2 prediction replaces tier 1 where present (left join by id)."""
    j = s1.join(s2, id_col, "left")
    has2 = F.col("p2").isNotNull()
    return (j.withColumn("prediction", F.coalesce("p2", "p1"))
             .withColumn("confidence", F.when(has2, F.col("c2")).otherwise(F.col("c1")))
             .withColumn("tier_used", F.when(has2, F.lit(2)).otherwise(F.lit(1))))


def escalated_subset(decisions: DataFrame, escalated_ids: DataFrame, id_col: str = "id",
                     escalated: bool = True) -> DataFrame:
    """Rows whose id is (not) in the escalated id set (semi / anti join)."""
    return decisions.join(escalated_ids.select(id_col), id_col, "left_semi" if escalated else "left_anti")


def batch_latency_modes(dec: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per-row tier-2 latency vs the batch mean of the escalated rows."""
    w = Window.partitionBy(batch_col, "tier_used")
    return dec.withColumn("tier2_latency_batched",
                          F.when(F.col("tier_used") == 2, F.avg("tier2_latency").over(w)).otherwise(F.lit(0.0)))


def threshold_grid(spark, thresholds) -> DataFrame:
    for t in thresholds:
        validate_threshold(t)
    return spark.createDataFrame([(float(t),) for t in thresholds],
                                 T.StructType([T.StructField("threshold", T.DoubleType(), False)]))


def sweep(scored: DataFrame, grid: DataFrame, label: str = "label") -> DataFrame:
    """Both tiers scored once; every row falls into the gap between
    two thresholds of the sorted grid (a parameter, a few values), one
    aggregation counts rows by gap, and the thresholds expand what is left of
    it. Needs p1, c1, p2, c2, tier1_latency, tier2_cost."""
    steps = sorted(r["threshold"] for r in grid.collect())
    gap = sum((F.col("c1") >= F.lit(t)).cast("int") for t in steps)  # escalated by the thresholds from this one on
    cells = scored.groupBy(gap.alias("_gap"), F.col(label).alias("y"), "p1", "p2").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("tier1_latency").alias("_l1"), F.sum("tier2_cost").alias("_l2"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)]))
    x = cells.select("*", each.alias("_t"))
    esc = F.col("_t.i") >= F.col("_gap")
    cm = x.groupBy(F.col("_t.threshold").alias("threshold"), "y", F.when(esc, F.col("p2")).otherwise(F.col("p1")).alias("p")).agg(
        F.sum("_n").alias("n"), F.sum(F.when(esc, F.col("_n")).otherwise(F.lit(0))).alias("n_esc"),
        F.sum(F.col("_l1") + F.when(esc, F.col("_l2")).otherwise(F.lit(0.0))).alias("lat"),
        F.sum("_l1").alias("lat1"), F.sum("_l2").alias("lat2"))
    # tiny (thresholds x classes^2), and several reports read it
    return cut_lineage(cm)
