"""Shared derived frames: the driver tables bound to the reference's inputs.

documents -> posts (id, text, clean, tokens); labels.quality -> gold label;
documents JOIN events (event_id = doc_id) -> post context (device, ts,
topic); events -> telemetry readings. Everything stays lazy; each query
adds its own projection so Catalyst prunes columns down to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CASCADE_V1, CascadeConfig
from ..functions.hashing import std_normal, unit_hash
from ..functions.signals import clip, h_of, h_token, psi_socio, tau_terms, tau_dynamic
from ..functions.text import TOKEN_RE, clean_text, clean_tokens, stripped_text, word_tokens
from ..operators import routing, telemetry
from ..operators.scoring import tier1_scorer, tier2_scorer
from ..session import read_table, spread


def docs(spark: SparkSession, sf: str, with_text: bool = False, stripped: bool = False) -> DataFrame:
    """Posts: (id, lang, source, tokens, clean); tokens from one regex split
    of the whole text, clean = tokens joined by single spaces. ``stripped``
    adds the text the tokens lie in, for sums that don't need the array."""
    d = spread(read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    if stripped:
        return with_tokens(d.withColumnRenamed("doc_id", "id"), stripped=True)
    cols = [F.col("doc_id").alias("id"), "lang", "source", clean_tokens("text").alias("tokens")]
    if with_text:
        cols.insert(1, "text")
    return d.select(*cols).withColumn("clean", F.array_join("tokens", " "))


def with_tokens(df: DataFrame, text_col: str = "text", stripped: bool = False) -> DataFrame:
    """Adds tokens (one regex split of the whole text) and clean; ``stripped``: see ``docs``."""
    if stripped:
        x = df.withColumn("stripped", stripped_text(text_col)).drop(text_col)
        return x.withColumn("tokens", F.regexp_extract_all("stripped", F.lit(TOKEN_RE), 0)).withColumn("clean", F.array_join("tokens", " "))
    return df.withColumn("tokens", clean_tokens(text_col)).withColumn("clean", F.array_join("tokens", " ")).drop(text_col)


def labelled_docs(spark: SparkSession, sf: str, stripped: bool = False) -> DataFrame:
    """Labelled posts: the label join runs first so text work is spent on
    labelled rows only (labels are a fraction of the documents)."""
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")
    return with_tokens(spread(d).join(labelled(spark, sf), "id", "inner"), stripped=stripped)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def with_social(df: DataFrame, id_col: str = "id", seed: str = "") -> DataFrame:
    """X11: follower, retweet, burst and platform per row from hashed
    uniforms (Box-Muller normals), so values depend on the id alone."""
    k = (lambda s: f"{seed}{s}")
    fol = F.floor(F.round(clip(F.exp(F.lit(8.5) + 2.0 * std_normal(k("followers"), F.col(id_col))), 0, 1e7), 6))
    rt = F.floor(F.round(clip(F.exp(F.lit(3.0) + 2.5 * std_normal(k("retweets"), F.col(id_col))), 0, 1e6), 6))
    bu = F.round(F.lit(1.0) + 199.0 * unit_hash(k("burst"), F.col(id_col)), 2)
    return (df.withColumn("follower_count", fol.cast("long"))
              .withColumn("retweet_count", rt.cast("long"))
              .withColumn("burst_rate_ppm", bu)
              .withColumn("platform", F.lit("TWITTER")))


def with_signals(df: DataFrame, cfg: CascadeConfig = CASCADE_V1, phi: str | None = None) -> DataFrame:
    """Adds psi, h and the component struct; phi column or 0 when absent. A
    column ``sums`` (``ExprScorer.sums`` with entropy) gives h without tokens."""
    phi_c = F.col(phi) if phi else F.lit(0.0)
    x = (df.withColumn("psi", psi_socio("retweet_count", "follower_count", "burst_rate_ppm", "platform", cfg))
           .withColumn("h", h_of(F.col("sums.n"), F.col("sums.e"), cfg) if "sums" in df.columns else h_token("tokens", cfg))
           .withColumn("phi", phi_c.cast("double")))
    return x.withColumn("tau", tau_dynamic("phi", "psi", "h", cfg))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with tier-1 scores (p1, c1, tier1_latency)."""
    return routing.score_tier1(docs(spark, sf), tier1_scorer())


def scored_both(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> DataFrame:
    """Both tiers scored once (for sweeps): p1, c1, p2, c2, latencies."""
    s = routing.score_tier1(frame, tier1_scorer()) if frame is not None else scored(spark, sf)
    nfeat = F.greatest((2 * F.size("tokens") - 1).cast("double"), F.lit(0.0))
    return tier2_scorer().with_scores(s, "tokens", "p2", "c2") \
        .withColumn("tier2_cost", nfeat * routing.TIER2_SEC_PER_FEATURE)


def with_arrival(spark: SparkSession, sf: str, posts: DataFrame) -> DataFrame:
    """Adds a post's arrival event: device, ts and topic (null without one)."""
    ev = read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("device_id"), F.col("event_type").alias("topic"))
    return posts.join(ev, "id", "left")


def readings_v1(spark: SparkSession, sf: str, cfg: CascadeConfig = CASCADE_V1) -> DataFrame:
    tel = telemetry.telemetry_from_events(read_table(spark, sf, "events"))
    return telemetry.health_v1(tel, cfg)


def _default_phi(cfg: CascadeConfig) -> float:
    """The controller's first step over the default vector (0.4, 0.4)."""
    e, dt = 0.4 * cfg.cpu_setpoint - cfg.cpu_setpoint, cfg.dt_floor
    total = max(-cfg.integral_limit, min(cfg.integral_limit, e * dt))
    return max(0.0, min(1.0, cfg.kp * e + cfg.ki * total + cfg.kd * e / dt + cfg.mem_weight * 0.4))


def dynamic_route(spark: SparkSession, sf: str, cfg: CascadeConfig = CASCADE_V1, chunk_seconds: int = 3600, posts: DataFrame | None = None) -> DataFrame:
    """As-of reading -> PID per device over its posts -> tau -> route.

    The latest reading strictly before the post is used (the sidecar's last
    completed poll); a device without one takes the CPU defaults (0.4, 0.4).
    The controller runs on a narrow (id, device, ts) frame; its phi is
    joined once to the scored posts, so text work happens once per post. A
    post without an arrival event has no place in a device's order: it gets
    the phi that a first step over the default vector gives.
    """
    ev = read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("device_id"))
    narrow = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(ev, "id", "inner")
    rd = readings_v1(spark, sf, cfg)
    x = telemetry.latest_reading(narrow, rd, ["t_norm", "mem_norm", "setpoint"], strict=True,
                                 chunk_seconds=chunk_seconds)
    x = (x.withColumn("t_norm", F.coalesce("t_norm", F.lit(0.4)))
          .withColumn("mem_norm", F.coalesce("mem_norm", F.lit(0.4)))
          .withColumn("setpoint", F.coalesce("setpoint", F.lit(cfg.cpu_setpoint))))
    phi = telemetry.pid(telemetry.pid_inputs_v1(x, cfg), cfg, tie="id", chunk_seconds=chunk_seconds) \
        .select("id", "device_id", "phi")
    return route_by_phi((docs(spark, sf, stripped=True) if posts is None else posts).join(phi, "id", "left"), cfg)


def route_by_phi(posts: DataFrame, cfg: CascadeConfig = CASCADE_V1) -> DataFrame:
    """Posts with a phi (null: the default) -> tier 1 -> tau -> decisions.

    Where the stripped text is at hand, the sums of tier 1 and the entropy
    come from it in one pass."""
    if "stripped" in posts.columns:
        x = posts.withColumn("sums", tier1_scorer().sums(F.col("stripped"), entropy=True))
        return decide(routing.score_tier1(x, tier1_scorer(), sums="sums"), cfg)
    return decide(routing.score_tier1(posts, tier1_scorer()), cfg)


def decide(scored: DataFrame, cfg: CascadeConfig = CASCADE_V1) -> DataFrame:
    """Posts with tier-1 scores and a phi (null: the default) -> tau -> decisions."""
    x = with_social(scored).withColumn("phi", F.coalesce("phi", F.lit(_default_phi(cfg))))
    y = with_signals(x, cfg, phi="phi")
    return routing.route_expr(y.withColumn("escalate", F.col("c1") < F.col("tau")), tier2_scorer(), "escalate", text="stripped" if "stripped" in y.columns else None)


def components(df: DataFrame, cfg: CascadeConfig = CASCADE_V1) -> DataFrame:
    return df.withColumn("components", tau_terms("phi", "psi", "h", cfg))
