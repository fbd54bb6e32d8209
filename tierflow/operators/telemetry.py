"""Telemetry time series (T1-T10): normalisation, controller, as-of lookup.

The reference polls sensors in a thread; here readings are rows of a
table or stream ``(device_id, ts, reading_id, raw sensor columns)`` and
the controller is an ordered scan per device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CPU_SENSOR_KEYS_V1, CPU_SENSOR_KEYS_V2, HEALTH_V2_LABELS, CASCADE_V1, CASCADE_V2, CascadeConfig
from ..functions.signals import clip
from .scan import asof_latest, epoch_seconds, pid_scan

GPU_EVENT_TYPES = ("view", "purchase")


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Derive raw sensor readings from the ``events`` table.

    device = user_id; GPU machines report on 'view'/'purchase' rows;
    value drives temperatures and CPU load, props.k drives memory. A CPU
    temperature sensor is exposed only on 'error' ('coretemp') and
    'signup' ('acpitz') rows; 'click' rows report no swap device.
    """
    k = F.get_json_object("props", "$.k").cast("double")
    v = F.col("value")
    gpu = F.col("event_type").isin(*GPU_EVENT_TYPES)
    sensor_temp = F.lit(30.0) + v / 3.0
    sensors = (F.when(F.col("event_type") == "error",
                      F.create_map(F.lit("coretemp"), F.array(sensor_temp, sensor_temp - 4.0)))
               .when(F.col("event_type") == "signup",
                     F.create_map(F.lit("acpitz"), F.array(sensor_temp)))
               .otherwise(F.create_map().cast("map<string,array<double>>")))
    return events.select(
        F.col("user_id").alias("device_id"),
        F.col("ts"),
        F.col("event_id").alias("reading_id"),
        F.col("event_type"),
        F.when(gpu, F.lit(30.0) + v / 2.0).alias("gpu_temp_c"),
        F.when(gpu, k * 0.16).alias("vram_gb"),
        v.alias("cpu_pct"),
        sensors.alias("sensors"),
        (k * 0.128).alias("ram_gb"),
        F.lit(12.8).alias("ram_total_gb"),
        (k * 0.02).alias("swap_gb"),
        F.when(F.col("event_type") == "click", F.lit(0.0)).otherwise(F.lit(2.0)).alias("swap_total_gb"),
    )


def _first_sensor_v1(sensors: Column, keys) -> Column:
    return F.coalesce(*[F.try_element_at(F.try_element_at(sensors, F.lit(kk)), F.lit(1)) for kk in keys])


def health_v1(tel: DataFrame, cfg: CascadeConfig = CASCADE_V1) -> DataFrame:
    """[T_norm, MEM_norm] and the mode's set-point per reading."""
    gpu = F.col("gpu_temp_c").isNotNull() | F.col("vram_gb").isNotNull()
    # a read is whole or it failed: with half of it missing, both take the default
    whole = F.col("gpu_temp_c").isNotNull() & F.col("vram_gb").isNotNull()
    gpu_t = F.when(whole, clip(F.col("gpu_temp_c") / cfg.gpu_setpoint, 0, 1)).otherwise(F.lit(0.5))
    gpu_m = F.when(whole, clip(F.col("vram_gb") / cfg.vram_capacity_gb, 0, 1)).otherwise(F.lit(0.5))
    sensor = _first_sensor_v1(F.col("sensors"), CPU_SENSOR_KEYS_V1)
    cpu_t = F.coalesce(clip(sensor / cfg.cpu_setpoint, 0, 1), clip(F.col("cpu_pct") / 100.0, 0, 1), F.lit(0.4))
    cpu_m = F.coalesce(clip(F.col("ram_gb") / cfg.ram_capacity_gb, 0, 1), F.lit(0.4))
    return tel.select(
        "device_id", "ts", "reading_id",
        F.when(gpu, F.lit("gpu")).otherwise(F.lit("cpu")).alias("mode"),
        F.when(gpu, gpu_t).otherwise(cpu_t).alias("t_norm"),
        F.when(gpu, gpu_m).otherwise(cpu_m).alias("mem_norm"),
        F.when(gpu, F.lit(cfg.gpu_setpoint)).otherwise(F.lit(cfg.cpu_setpoint)).alias("setpoint"),
    )


def _cpu_temp_v2(sensors: Column, keys) -> Column:
    def mx(arr):
        return F.array_max(F.filter(arr, lambda r: r.isNotNull()))
    by_key = F.coalesce(*[mx(F.try_element_at(sensors, F.lit(kk))) for kk in keys])
    nonempty = F.filter(F.map_values(sensors), lambda a: F.size(F.filter(a, lambda r: r.isNotNull())) > 0)
    any_sensor = mx(F.try_element_at(nonempty, F.lit(1)))
    return F.coalesce(by_key, any_sensor)


def health_v2(tel: DataFrame, cfg: CascadeConfig = CASCADE_V2) -> DataFrame:
    """The six-element vector. A block (CPU, GPU) whose read failed in
    part is all zeros; a machine without sensors or swap reads 0 there."""
    cpu = F.col("cpu_pct").isNotNull() & F.col("ram_gb").isNotNull() & (F.col("ram_total_gb") > 0) & F.col("swap_total_gb").isNotNull()
    gpu = F.col("gpu_temp_c").isNotNull() & F.col("vram_gb").isNotNull()
    zero = F.lit(0.0)
    swap = F.when(F.col("swap_total_gb") > 0, clip(F.col("swap_gb") / F.col("swap_total_gb"), 0, 1))
    return tel.select(
        "device_id", "ts", "reading_id",
        F.when(cpu, clip(F.col("cpu_pct") / 100.0, 0, 1)).otherwise(zero).alias("cpu_load_norm"),
        F.when(cpu, clip(F.col("ram_gb") / F.col("ram_total_gb"), 0, 1)).otherwise(zero).alias("ram_usage_norm"),
        F.when(cpu, F.coalesce(clip(_cpu_temp_v2(F.col("sensors"), CPU_SENSOR_KEYS_V2) / cfg.cpu_setpoint, 0, 1), zero))
        .otherwise(zero).alias("cpu_temp_norm"),
        F.when(cpu, F.coalesce(swap, zero)).otherwise(zero).alias("swap_norm"),
        F.when(gpu, clip(F.col("gpu_temp_c") / cfg.gpu_setpoint, 0, 1)).otherwise(zero).alias("gpu_temp_norm"),
        F.when(gpu, clip(F.col("vram_gb") / cfg.vram_capacity_gb, 0, 1)).otherwise(zero).alias("vram_usage_norm"),
    )


def health_labeled(h2: DataFrame) -> DataFrame:
    """T5: vector -> {label: value} map."""
    return h2.select("device_id", "ts", "reading_id", F.map_from_arrays(
        F.array(*[F.lit(x) for x in HEALTH_V2_LABELS]),
        F.array(*[F.col(x) for x in HEALTH_V2_LABELS])).alias("health"))


def pid_inputs_v1(h1: DataFrame, cfg: CascadeConfig = CASCADE_V1) -> DataFrame:
    return h1.withColumn("error", F.col("t_norm") * F.col("setpoint") - F.col("setpoint")) \
             .withColumn("secondary", F.lit(cfg.mem_weight) * F.col("mem_norm"))


def pid_inputs_v2(h2: DataFrame, cfg: CascadeConfig = CASCADE_V2) -> DataFrame:
    gpu = F.col("gpu_temp_norm") > 0
    err = F.when(gpu, F.col("gpu_temp_norm") * cfg.gpu_setpoint - cfg.gpu_setpoint) \
        .otherwise(F.col("cpu_load_norm") * cfg.cpu_setpoint - cfg.cpu_setpoint)
    sec = F.when(gpu, 0.08 * F.col("vram_usage_norm") + 0.04 * F.col("ram_usage_norm")) \
        .otherwise(0.08 * F.col("ram_usage_norm") + 0.05 * F.col("swap_norm") + 0.04 * F.col("cpu_temp_norm"))
    return h2.withColumn("mode", F.when(gpu, F.lit("gpu")).otherwise(F.lit("cpu"))) \
             .withColumn("error", err).withColumn("secondary", sec)


def pid(df: DataFrame, cfg: CascadeConfig, key: str = "device_id", ts: str = "ts",
        tie: str = "reading_id", chunk_seconds: int = 3600) -> DataFrame:
    """T8/T9 over rows carrying ``error`` and ``secondary`` columns."""
    x = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    out = pid_scan(x, key, "_t", tie, "error", "secondary", cfg.kp, cfg.ki, cfg.kd,
                   cfg.integral_limit, cfg.dt_floor, chunk_seconds)
    return out.drop("_t")


def latest_reading(posts: DataFrame, readings: DataFrame, value_cols: list[str],
                   key: str = "device_id", ts: str = "ts", post_tie: str = "id",
                   reading_tie: str = "reading_id", chunk_seconds: int = 3600,
                   strict: bool = False) -> DataFrame:
    """Newest reading of the post's device at or before the post
    (readings sort before posts at equal time). Adds ``value_cols`` and
    ``reading_t``; NULL when the device has no reading yet."""
    p = posts.withColumn("_t", epoch_seconds(ts))
    r = readings.withColumn("_t", epoch_seconds(ts)).select(key, "_t", reading_tie, *value_cols)
    out = asof_latest(p, r, key, "_t", value_cols, post_tie, reading_tie, chunk_seconds, out_t="reading_t",
                      strict=strict)
    return out.drop("_t")


def batch_ids(df: DataFrame, order_col: str, batch_size: int, out: str = "batch_id",
              most_rows: int = 1_000_000) -> DataFrame:
    """Batch index of each row in ``order_col`` order: floor((rank-1)/B).

    Exact rank from (bucket, row_number) instead of one global row_number
    window: buckets are cut from the values until none holds more than
    ``most_rows`` rows, however the values are bunched, so no task sees more.
    """
    from .scan import bounded_buckets, exact_rank
    r = exact_rank(bounded_buckets(df, order_col, most_rows), [], F.col("_bucket"), [order_col], out="_pos")
    return r.withColumn(out, F.floor((F.col("_pos") - 1) / F.lit(batch_size)).cast("long")).drop("_pos", "_bucket")
