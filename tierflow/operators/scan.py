"""Skew-safe ordered scans.

Order-dependent operators (running sums, lag, "latest value so far",
exact rank) are usually written as one window partitioned by the key. When
one key holds a third of all rows that window runs in one task. Here every
scan is split into (key, chunk) windows plus a small per-chunk summary
table that carries state across chunks (a two-level prefix scan):

    rows --window(key, chunk)--> local results --agg--> chunk table
    chunk table --window(key)--> carry-in per chunk --join(key, chunk)--> rows

The rows are shuffled once, on (key, chunk); the chunk table has one row
per non-empty chunk, so its window over the key is small even for a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def epoch_seconds(ts) -> Column:
    """Event time as double seconds since the epoch (microsecond precision)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def time_chunk(t_seconds: Column, chunk_seconds: int) -> Column:
    return F.floor(t_seconds / F.lit(float(chunk_seconds))).cast("long")


# --------------------------------------------------------------------------
# exact rank by a hash order, within groups (C1 sample, C2 split)
# --------------------------------------------------------------------------

def exact_rank(df: DataFrame, group_cols: list[str], bucket: Column, order_cols: list,
               out: str = "_rank") -> DataFrame:
    """1-based rank of each row within ``group_cols`` by ``order_cols``.

    ``bucket`` must be non-decreasing in the order (e.g. the leading hex
    digits of a hash, or floor(id / width)); rank = rows of the group in
    earlier buckets + row_number inside the (group, bucket). No window spans
    a whole group, and the bucket-count table is small.
    """
    x = df.withColumn("_bkt", bucket)
    keys = list(group_cols) + ["_bkt"]
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_bkt") if group_cols else Window.orderBy("_bkt")
    offsets = counts.select(*keys, F.coalesce(
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    wl = Window.partitionBy(*keys).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order_cols])
    ranked = x.withColumn("_rn", F.row_number().over(wl))
    return (ranked.join(offsets, keys, "inner")
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_bkt", "_rn", "_off"))


def bounded_buckets(df: DataFrame, col: str, most_rows: int = 1_000_000, parts: int = 1024, out: str = "_bucket") -> DataFrame:
    """Adds ``out``, a string that doesn't fall as the number ``col`` grows, with at most ``most_rows`` rows of one value of it.

    The range of values is cut into ``parts`` equal parts, and each part that
    holds too many rows again, between its own least and greatest value,
    until none does; so buckets follow the data, and their number grows with
    it. The parts that are cut again are a table, joined to the rows at each
    level; it takes as many levels as values are bunched within bunches, two
    or three as a rule. Rows of a single value can't be told apart: they
    stay in one bucket. Null values go to the first bucket.
    """
    x = df.withColumn(out, F.lit("")).withColumn("_v", F.col(col).cast("double"))
    whole = df.agg(F.lit("").alias(out), F.min(F.col(col).cast("double")).alias("_a"), F.max(F.col(col).cast("double")).alias("_b"), F.count(F.lit(1)).alias("_n"))
    crowded = cut_lineage(whole.where((F.col("_n") > most_rows) & (F.col("_a") < F.col("_b"))).drop("_n"))
    while not crowded.isEmpty():
        part = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * parts)))
        step = F.format_string(f".%0{len(str(parts - 1))}d", F.coalesce(part, F.lit(0)).cast("int"))
        x = x.join(crowded, out, "left").withColumn(out, F.when(F.col("_a").isNull(), F.col(out)).otherwise(F.concat(out, step))).withColumn("_again", F.col("_a").isNotNull()).drop("_a", "_b")
        counts = x.where("_again").groupBy(out).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        x = x.drop("_again")
        crowded = cut_lineage(counts.where((F.col("_n") > most_rows) & (F.col("_a") < F.col("_b"))).drop("_n"))
    return x.drop("_v")


def exact_hash_rank(df: DataFrame, group_cols: list[str], hash_col: str, tie_col: str,
                    out: str = "_rank", bucket_hex_digits: int = 4) -> DataFrame:
    """Rank by (hex hash, tie); buckets are the hash's leading hex digits."""
    b = F.conv(F.substring(F.col(hash_col), 1, bucket_hex_digits), 16, 10).cast("int")
    return exact_rank(df, group_cols, b, [hash_col, tie_col], out)


# --------------------------------------------------------------------------
# PID controller as a chunked scan
# --------------------------------------------------------------------------

def pid_scan(df: DataFrame, key: str, t_col: str, tie_col: str, err_col: str,
             secondary_col: str, kp: float, ki: float, kd: float,
             integral_limit: float, dt_floor: float, chunk_seconds: int = 3600,
             prefix: str = "") -> DataFrame:
    """Discrete PID over each key's rows in (t, tie) order; ``t_col`` holds
    integer microseconds so time differences are exact.

    dt = max(t - t_prev, floor) (floor for a key's first row), e_prev = 0 for
    the first row, I = clip(I_prev + e*dt, +-limit), D = (e - e_prev)/dt,
    phi = clip(kp*e + ki*I + kd*D + secondary, 0, 1).

    Where no error of a key is positive (normalised readings are clipped to
    <= 1, so error = (T_norm - 1) * setpoint <= 0) the clamped integral is
    greatest(-limit, running sum), by windows alone. Keys with a positive
    error take the general scan (``_clamped_scan``); adaptive execution drops
    that branch when no key does.
    """
    t = F.col(t_col)
    e = F.col(err_col)
    c = F.floor(t / F.lit(chunk_seconds * 1_000_000)).cast("long")
    x = df.withColumn("_c", c)
    wl = Window.partitionBy(key, "_c").orderBy(t, F.col(tie_col))
    x = (x.withColumn("_lt", F.lag(t).over(wl))
          .withColumn("_le", F.lag(e).over(wl))
          .withColumn("_rn", F.row_number().over(wl)))
    sec = lambda a, b: (a - b).cast("double") / F.lit(1e6)
    local_inc = F.when(F.col("_rn") > 1, e * F.greatest(sec(t, F.col("_lt")), F.lit(dt_floor))).otherwise(F.lit(0.0))
    x = x.withColumn("_inc", local_inc) \
         .withColumn("_cum", F.sum("_inc").over(wl.rowsBetween(Window.unboundedPreceding, 0)))
    order_key = F.struct(t, F.col(tie_col))
    chunks = x.groupBy(key, "_c").agg(
        F.min_by(t, order_key).alias("_ft"), F.min_by(e, order_key).alias("_fe"),
        F.max_by(t, order_key).alias("_lst"), F.max_by(e, order_key).alias("_lse"),
        F.sum("_inc").alias("_rest"), F.max(e).alias("_emax"))
    wc = Window.partitionBy(key).orderBy("_c")
    chunks = (chunks
              .withColumn("_pt", F.lag("_lst").over(wc))
              .withColumn("_pe", F.lag("_lse").over(wc))
              .withColumn("_finc", F.col("_fe") * F.when(F.col("_pt").isNull(), F.lit(dt_floor))
                          .otherwise(F.greatest(sec(F.col("_ft"), F.col("_pt")), F.lit(dt_floor))))
              .withColumn("_tot", F.col("_finc") + F.col("_rest"))
              .withColumn("_off", F.coalesce(F.sum("_tot").over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("_pos", F.max(F.col("_emax")).over(wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
              .select(key, "_c", "_pt", "_pe", "_finc", "_off", F.coalesce(F.col("_pos") > 0, F.lit(False)).alias("_pos")))
    scratch = ("_c", "_lt", "_le", "_rn", "_inc", "_cum", "_pt", "_pe", "_finc", "_off", "_pos")
    closed = x.join(chunks.where(~F.col("_pos")), [key, "_c"], "inner")
    bound = lambda v: F.greatest(F.lit(-integral_limit), F.least(F.lit(integral_limit), v))
    closed = closed.withColumn("_integral", bound(F.col("_off") + F.col("_finc") + F.col("_cum")))
    general = x.join(chunks.where("_pos"), [key, "_c"], "inner")
    general = _clamped_scan(general.withColumn("_step", F.coalesce(F.when(F.col("_rn") == 1, F.col("_finc")).otherwise(F.col("_inc")), F.lit(0.0))), key, "_c", "_rn", "_step", integral_limit, "_integral").drop("_step")
    y = closed.unionByName(general)
    first = F.col("_rn") == 1
    prev_t = F.when(first, F.col("_pt")).otherwise(F.col("_lt"))
    prev_e = F.coalesce(F.when(first, F.col("_pe")).otherwise(F.col("_le")), F.lit(0.0))
    dt = F.when(prev_t.isNull(), F.lit(dt_floor)).otherwise(F.greatest(sec(t, prev_t), F.lit(dt_floor)))
    p = f"{prefix}"
    y = (y.withColumn(f"{p}dt", dt)
          .withColumnRenamed("_integral", f"{p}integral")
          .withColumn(f"{p}derivative", (e - prev_e) / dt)
          .withColumn(f"{p}phi_raw", F.lit(kp) * e + F.lit(ki) * F.col(f"{p}integral")
                      + F.lit(kd) * F.col(f"{p}derivative") + F.col(secondary_col))
          .withColumn(f"{p}phi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"{p}phi_raw")))))
    return y.drop(*scratch)


def clamp_of(steps: Iterable[float], limit: float) -> tuple[float, float, float]:
    """v -> clip(v + step, +-limit), one step after the other, as one function v -> clip(v + offset, low, high): (low, high, offset).

    Such functions are closed under composition: behind (low, high, offset)
    the next step gives (clip(low + step), clip(high + step), offset + step).
    """
    low, high, offset = -float("inf"), float("inf"), 0.0
    for s in steps:
        low, high, offset = min(limit, max(-limit, low + s)), min(limit, max(-limit, high + s)), offset + s
    return low, high, offset


def _clamped_scan(df: DataFrame, key: str, chunk: str, order: str, step: str, limit: float, out: str) -> DataFrame:
    """Adds ``out``, the running sum of ``step`` clipped to +-``limit`` after every row, for steps of any sign.

    Rows are in (``chunk``, ``order``) order per key. Each chunk's rows
    compose to one clamp function, a small table; the functions of a key,
    applied one after the other to 0, give the value that each chunk starts
    from; and each chunk is run from there. A task holds a chunk, not a key.
    """
    kind, number = df.schema[key].dataType.simpleString(), df.schema[chunk].dataType.simpleString()

    def compose(rows: pa.Table) -> pa.Table:
        low, high, offset = clamp_of(rows.sort_by(order).column(step).to_pylist(), limit)
        return rows.slice(0, 1).select([key, chunk]).append_column("_low", [[low]]).append_column("_high", [[high]]).append_column("_by", [[offset]])

    def carry(functions: pa.Table) -> pa.Table:
        functions, value, starts = functions.sort_by(chunk), 0.0, []
        for low, high, offset in zip(*(functions.column(c).to_pylist() for c in ("_low", "_high", "_by")), strict=True):
            starts.append(value)
            value = min(high, max(low, value + offset))
        return functions.select([key, chunk]).append_column("_from", [starts])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        start = rows.column("_from")[0].as_py()
        values = list(accumulate(rows.column(step).to_pylist(), lambda v, s: min(limit, max(-limit, v + s)), initial=start))[1:]
        return rows.drop_columns(["_from"]).append_column(out, [pa.array(values, pa.float64())])

    functions = (df.select(key, chunk, order, step).groupBy(key, chunk)
                 .applyInArrow(compose, f"`{key}` {kind}, `{chunk}` {number}, _low double, _high double, _by double"))
    starts = functions.groupBy(key).applyInArrow(carry, f"`{key}` {kind}, `{chunk}` {number}, _from double")
    return df.join(starts, [key, chunk]).select(*df.columns, "_from").groupBy(key, chunk).applyInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


# --------------------------------------------------------------------------
# as-of join: latest right row at or before each left row, per key
# --------------------------------------------------------------------------

def asof_latest(left: DataFrame, right: DataFrame, key: str, t_col: str, value_cols: list[str],
                left_tie: str, right_tie: str, chunk_seconds: int = 3600,
                out_t: str = "reading_t", strict: bool = False) -> DataFrame:
    """For each left row, the values of the newest right row of the same key
    with t <= left t (right rows sort before left rows at equal t), or with
    t < left t when ``strict``. ``left_tie`` must identify a left row.

    Only narrow (key, t, tie) columns of the left side enter the scan: a
    union with the right side, then a chunked "last non-null so far" scan;
    the found values are joined back to the left rows by ``left_tie``, so
    expensive left columns are computed once. NULL when no reading yet.
    """
    rk, lk = (1, 0) if strict else (0, 1)
    vals = F.struct(*[F.col(v) for v in value_cols], F.col(t_col).alias(out_t))
    vtype = right.select(vals).schema[0].dataType
    r = right.select(F.col(key), F.col(t_col), F.lit(rk).alias("_kind"),
                     F.col(right_tie).cast("long").alias("_tie"), vals.alias("_v"))
    l = left.select(F.col(key), F.col(t_col), F.lit(lk).alias("_kind"),
                    F.col(left_tie).cast("long").alias("_tie"), F.lit(None).cast(vtype).alias("_v"))
    u = r.unionByName(l).withColumn("_c", time_chunk(F.col(t_col), chunk_seconds))
    wl = Window.partitionBy(key, "_c").orderBy(F.col(t_col), F.col("_kind"), F.col("_tie")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_loc", F.last("_v", ignorenulls=True).over(wl))
    order_key = F.struct(F.col(t_col), F.col("_kind"), F.col("_tie"))
    chunks = (u.groupBy(key, "_c")
              .agg(F.max_by(F.when(F.col("_kind") == rk, F.col("_v")),
                            F.when(F.col("_kind") == rk, order_key)).alias("_cl")))
    # carry-in: the last reading of any earlier chunk of the key
    wc = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(key, "_c", F.last("_cl", ignorenulls=True).over(wc).alias("_carry"))
    found = (u.filter(F.col("_kind") == lk).join(carry, [key, "_c"], "inner")
             .select(F.col("_tie").alias("_lt"), F.coalesce(F.col("_loc"), F.col("_carry")).alias("_val")))
    out = left.join(found, left[left_tie].cast("long") == found["_lt"], "left").drop("_lt")
    return out.select(*[F.col(c) for c in left.columns],
                      *[F.col(f"_val.{v}").alias(v) for v in value_cols],
                      F.col(f"_val.{out_t}").alias(out_t))


# --------------------------------------------------------------------------
# trailing range count per key over whole seconds
# --------------------------------------------------------------------------

def trailing_count(df: DataFrame, key: str, sec_col: str, width_seconds: int = 60,
                   out: str = "n_window") -> DataFrame:
    """Rows of the same key with second in [s - width + 1, s], for each row.

    Pre-aggregates to one row per (key, second), then runs the range sum in
    (key, bucket) windows where each bucket also sees a copy of the
    previous bucket (the only one a frame can reach); joins back on
    (key, second). A hot key is split across its buckets.
    """
    per_sec = df.groupBy(key, sec_col).agg(F.count(F.lit(1)).alias("_n"))
    bkt = F.floor(F.col(sec_col) / F.lit(width_seconds)).cast("long")
    own = per_sec.withColumn("_b", bkt).withColumn("_own", F.lit(True))
    ctx = per_sec.withColumn("_b", bkt + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(key, "_b").orderBy(F.col(sec_col)).rangeBetween(-(width_seconds - 1), 0)
    rates = (own.unionByName(ctx)
             .withColumn(out, F.sum("_n").over(w))
             .filter("_own")
             .select(key, sec_col, F.col(out).cast("long").alias(out)))
    return df.join(rates, [key, sec_col], "inner")
