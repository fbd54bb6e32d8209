"""Evaluation aggregates.

Every metric is computed from one small confusion table per group
(``groupBy(group, label, prediction).count()``), so the data is read once
and only a handful of rows per group cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, pred: str, group: list[str]) -> DataFrame:
    """(group.., y, p, n): groups x classes^2 rows."""
    return df.groupBy(*group, F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame, group: list[str]) -> DataFrame:
    """tp/fp/fn/support per class for classes in label U prediction: a cell
    counts for its label and, if another, for its prediction."""
    zero, n, hit = F.lit(0).cast("long"), F.col("n").cast("long"), F.col("y") == F.col("p")
    of_label = F.struct(F.col("y").alias("cls"), F.when(hit, n).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(hit, zero).otherwise(n).alias("fn"), n.alias("support"))
    of_pred = F.struct(F.col("p").alias("cls"), zero.alias("tp"), n.alias("fp"), zero.alias("fn"), zero.alias("support"))
    cells = cm.select(*group, F.explode(F.when(hit, F.array(of_label)).otherwise(F.array(of_label, of_pred))).alias("c"))
    return cells.groupBy(*group, F.col("c.cls").alias("cls")).agg(*[F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "fn", "support")])


def _prf(pc: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (pc.withColumn("precision", F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0)))
              .withColumn("recall", F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)))
              .withColumn("f1", F.coalesce(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0))))


def accuracy_f1(df: DataFrame, label: str = "label", pred: str = "prediction",
                group: list[str] | None = None) -> DataFrame:
    """A1/A2: accuracy and macro F1 (zero-division -> 0) per group, both from
    the per-class counts."""
    group = group or []
    return accuracy_f1_of(confusion(df, label, pred, group), group)


def accuracy_f1_of(cm: DataFrame, group: list[str]) -> DataFrame:
    """A1/A2 from a confusion table (group.., y, p, n)."""
    pc = _prf(per_class(cm, group))
    return pc.groupBy(*group).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          group: list[str] | None = None, class_names: dict | None = None) -> DataFrame:
    """A3: per-class precision/recall/f1/support plus accuracy, macro avg and
    weighted avg rows (one ``row`` label column), from one pass: a group's
    classes are a handful, gathered and unpacked again with its totals."""
    group = group or []
    pc = _prf(per_class(confusion(df, label, pred, group), group))
    names = class_names or {0: "Negative", 1: "Positive"}
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    title = F.coalesce(F.element_at(m, F.col("cls")), F.col("cls").cast("string"))
    row = lambda t, p, r, f, s: F.struct(t.alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.cast("long").alias("support"))
    by = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    one = pc.groupBy(*group).agg(
        F.collect_list(row(title, F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"))).alias("_rows"),
        F.struct(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f")).alias("_m"),
        F.struct(by("precision").alias("p"), by("recall").alias("r"), by("f1").alias("f")).alias("_w"),
        F.sum("support").alias("_s"), (F.sum("tp") / F.sum("support")).alias("_a"))
    no = F.lit(None).cast("double")
    extra = F.array(row(F.lit("accuracy"), no, no, F.col("_a"), F.col("_s")),
                    row(F.lit("macro avg"), F.col("_m.p"), F.col("_m.r"), F.col("_m.f"), F.col("_s")),
                    row(F.lit("weighted avg"), F.col("_w.p"), F.col("_w.r"), F.col("_w.f"), F.col("_s")))
    return one.select(*group, F.explode(F.concat("_rows", extra)).alias("_r")).select(*group, "_r.*")


def router_stats(dec: DataFrame, group: list[str] | None = None, tier_col: str = "tier_used",
                 t1_lat: str = "tier1_latency", t2_lat: str = "tier2_latency") -> DataFrame:
    """Samples, tier counts, latency sums, tier2_rate, avg_latency (/max(n,1))."""
    group = group or []
    g = dec.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col(tier_col) == 1).alias("tier1_count"),
        F.count_if(F.col(tier_col) == 2).alias("tier2_count"),
        F.sum(F.col(t1_lat) + F.col(t2_lat)).alias("total_latency"),
        F.sum(t1_lat).alias("tier1_total_lat"),
        F.sum(t2_lat).alias("tier2_total_lat"))
    n = F.greatest(F.col("total_samples"), F.lit(1))
    return g.withColumn("tier2_rate", F.col("tier2_count") / n) \
            .withColumn("avg_latency", F.col("total_latency") / n)


def latency_after_warmup(batches: DataFrame, group: list[str], warmup: int = 1) -> DataFrame:
    """batches(model, batch_idx, n, elapsed_s) -> mean ms per row with
    the first ``warmup`` batches dropped (all batches if none would be left),
    and total time."""
    keep = F.col("batch_idx") >= warmup
    g = batches.groupBy(*group).agg(
        F.sum(F.when(keep, F.col("elapsed_s"))).alias("_e"),
        F.sum(F.when(keep, F.col("n"))).alias("_n"),
        F.sum("elapsed_s").alias("total_time_s"),
        F.sum("n").alias("rows"))
    avg = F.coalesce(F.try_divide(F.col("_e"), F.col("_n").cast("double")),
                     F.col("total_time_s") / F.greatest(F.col("rows"), F.lit(1)))
    return g.select(*group, (avg * 1000.0).alias("avg_latency_ms"), "total_time_s",
                    F.col("rows").cast("long").alias("rows"))


def best_flags(df: DataFrame, maximise: list[str], minimise: list[str]) -> DataFrame:
    """Flag rows holding the best value of each metric (over the whole table)."""
    w = Window.partitionBy(F.lit(1))
    for c in maximise:
        df = df.withColumn(f"best_{c}", F.col(c) == F.max(c).over(w))
    for c in minimise:
        df = df.withColumn(f"best_{c}", F.col(c) == F.min(c).over(w))
    return df


def histogram(df: DataFrame, value: str, bins: int = 30, group: list[str] | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed."""
    group = group or []
    stats = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if group:
        j = df.join(stats, group, "inner")
    else:
        lo, hi = stats.select("_lo").scalar(), stats.select("_hi").scalar()
        j = df.withColumn("_lo", lo).withColumn("_hi", hi)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width * bins)
                                   .cast("int"))).otherwise(F.lit(0))
    return (j.withColumn("bin", b.cast("int")).groupBy(*group, "bin")
             .agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("lo"), F.min("_hi").alias("hi")))


#: Parts that a step of ``quantile_steps`` cuts a value range into.
PARTS = 1 << 16


def _magnitude(v: Column) -> Column:
    """A slot that doesn't fall as v grows: by sign and sixteenths of a power of two."""
    size = F.lit(20_000) + F.floor(F.log2(F.abs(v)) * 16)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _summaries(df: DataFrame, slots: list[tuple[str, Column]]) -> list[dict[int, Row]]:
    """Per (column, slot expression; null: left out) its slots with n, least, most, mean and variance: one pass for all."""
    cells = [F.struct(F.lit(i).alias("i"), slot.cast("long").alias("slot"), F.col(c).alias("v")) for i, (c, slot) in enumerate(slots)]
    each = df.select(F.explode(F.filter(F.array(*cells), lambda x: x["slot"].isNotNull())).alias("x")).select("x.*")
    found = each.groupBy("i", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    out: list[dict[int, Row]] = [{} for _ in slots]
    for r in found.collect():  # PARTS rows a range at most, or what the magnitudes of doubles allow
        out[r["i"]][r["slot"]] = r
    return out


def exact_summaries(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, dict]:
    """Per column count, mean, std, min, max and the exact quantiles ``probs`` (linear interpolation); nulls and NaN are left out.

    No task sees all rows, and all columns and ranks go together: the first
    pass counts values by magnitude and sums up each slot, which gives the
    simple figures; every further one counts PARTS equal parts of the ranges
    that hold a wanted rank, until each of those holds one value. A pass is
    one partial aggregate; doubles need four or five at most, values with a
    few decimals two.
    """
    x = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    first = _summaries(x, [(c, _magnitude(F.col(c))) for c in cols])
    out, open_ranges = {}, {}
    for c, slots in zip(cols, first, strict=True):
        n = sum(r["n"] for r in slots.values())
        mean = sum(r["mean"] * r["n"] for r in slots.values()) / n if n else None
        spread = sum(r["n"] * (r["var"] + (r["mean"] - mean) * (r["mean"] - mean)) for r in slots.values())
        out[c] = {"count": n, "mean": mean, "std": (spread / (n - 1)) ** 0.5 if n > 1 else None,
                  "min": min((r["least"] for r in slots.values()), default=None), "max": max((r["most"] for r in slots.values()), default=None), "at": {}}
        ranks = sorted({k for p in probs for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}) if n else []
        open_ranges |= _located(c, slots, 0, ranks, out[c]["at"])
    while open_ranges:
        keys = list(open_ranges)
        slots = []
        for c, a, b, _ in keys:
            v, width = F.col(c), (b - a) / PARTS
            part = F.least(F.lit(PARTS - 1), F.floor((v - F.lit(a)) / F.lit(width)).cast("long")) if width > 0 else F.when(v < b, F.lit(0)).otherwise(F.lit(1))
            slots.append((c, F.when((v >= F.lit(a)) & (v <= F.lit(b)), part)))
        found = _summaries(x, slots)
        after: dict = {}
        for key, cells in zip(keys, found, strict=True):
            after |= _located(key[0], cells, key[3], open_ranges[key], out[key[0]]["at"])
        open_ranges = after
    for c in cols:
        n, at = out[c]["count"], out[c].pop("at")
        for p in probs:
            place = p * (n - 1)
            one = at.get(int(place))
            out[c][p] = None if not n else one + (at[min(int(place) + 1, n - 1)] - one) * (place - int(place))
    return out


def _located(col: str, slots: dict[int, Row], before: int, ranks: list[int], at: dict[int, float]) -> dict[tuple, list[int]]:
    """Puts the ranks whose slot holds one value into ``at``; the others by the range of their slot (column, least, most, rows before it)."""
    left: dict[tuple, list[int]] = {}
    ranks = list(ranks)
    for _, r in sorted(slots.items()):
        while ranks and ranks[0] < before + r["n"]:
            if r["least"] == r["most"]:
                at[ranks[0]] = r["least"]
            else:
                left.setdefault((col, r["least"], r["most"], before), []).append(ranks[0])
            ranks.pop(0)
        before += r["n"]
    return left


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> dict[float, float]:
    """Exact quantiles with linear interpolation (``exact_summaries``)."""
    found = exact_summaries(df, [col], probs)[col]
    return {p: found[p] for p in probs}


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """(stat, col...) with count, mean, std, min, quartiles and max, 2 dp."""
    quartiles = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    found = exact_summaries(df, cols, list(quartiles.values()))
    number = lambda v: None if v is None else float(v)
    stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    table = df.sparkSession.createDataFrame([(s, *[number(found[c][quartiles.get(s, s)]) for c in cols]) for s in stats], "stat string, " + ", ".join(f"{c} double" for c in cols))
    return table.select("stat", *[F.round(c, 2).alias(c) for c in cols])
