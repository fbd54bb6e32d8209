"""P1 and X1-X9 as SQL functions: plain SQL, inlined by the optimizer, no Python."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from ..config import CASCADE_V1, UNKNOWN_PRIOR, CascadeConfig
from .text import HANDLE_HASH_RE, TOKEN_SPLIT_RE, URL_RE


def _definitions(cfg: CascadeConfig) -> dict[str, str]:
    lit = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    num = lambda x: f"{float(x)!r}D"
    prior = " ".join(f"WHEN {lit(k)} THEN {num(v)}" for k, v in cfg.platform_priors.items())
    wv, wa, wb, wp = map(num, cfg.psi_weights)
    lo, hi = num(cfg.tau_min), num(cfg.tau_max)
    # entropy: a fold over the sorted tokens that closes a run whenever the token changes
    term = "CASE WHEN a.c > 0 THEN a.c / a.n * ln(a.c / a.n + 1e-12D) ELSE 0D END"
    start = "named_struct('p', CAST(NULL AS STRING), 'c', 0D, 's', 0D, 'n', CAST(size(tokens) AS DOUBLE))"
    more, turn = "named_struct('p', a.p, 'c', a.c + 1D, 's', a.s, 'n', a.n)", f"named_struct('p', x, 'c', 1D, 's', a.s + {term}, 'n', a.n)"
    return {
        "clip_to(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NULL THEN NULL ELSE greatest(lo, least(hi, x)) END",
        "clean_tokens(t STRING) RETURNS ARRAY<STRING>":
            f"filter(split(regexp_replace(regexp_replace(lower(t), {lit(URL_RE)}, ''), {lit(HANDLE_HASH_RE)}, ''), {lit(TOKEN_SPLIT_RE)}), x -> x <> '')",
        "clean_text(t STRING) RETURNS STRING": "array_join(clean_tokens(t), ' ')",
        "platform_prior(p STRING) RETURNS DOUBLE": f"CASE upper(p) {prior} ELSE {num(UNKNOWN_PRIOR)} END",
        "virality(retweets DOUBLE) RETURNS DOUBLE": f"clip_to(coalesce(retweets, 0D) / {num(cfg.retweet_cap)}, 0D, 1D)",
        "authority(followers DOUBLE) RETURNS DOUBLE":
            f"CASE WHEN coalesce(followers, 0D) > 0 THEN clip_to(log1p(followers) / {num(math.log1p(cfg.follower_cap))}, 0D, 1D) ELSE 0D END",
        "burst(ppm DOUBLE) RETURNS DOUBLE": f"clip_to(coalesce(ppm, 0D) / {num(cfg.burst_cap)}, 0D, 1D)",
        "psi_socio(retweets DOUBLE, followers DOUBLE, ppm DOUBLE, platform STRING) RETURNS DOUBLE":
            f"clip_to({wv} * virality(retweets) + {wa} * authority(followers) + {wb} * burst(ppm) + {wp} * platform_prior(platform), 0D, 1D)",
        "h_token(tokens ARRAY<STRING>) RETURNS DOUBLE":
            f"CASE WHEN size(tokens) > 0 THEN clip_to(-aggregate(sort_array(tokens), {start}, (a, x) -> CASE WHEN a.p = x THEN {more} ELSE {turn} END, a -> a.s + {term})"
            f" / {num(math.log(cfg.vocab_size + 1e-12))}, 0D, 1D) ELSE 0D END",
        "sigmoid(z DOUBLE) RETURNS DOUBLE": "1D / (1D + exp(-z))",
        "tau_dynamic(phi DOUBLE, psi DOUBLE, h DOUBLE) RETURNS DOUBLE":
            f"clip_to(sigmoid(phi * (1D - psi) + h) * ({hi} - {lo}) + {lo}, {lo}, {hi})",
    }


def register(spark: SparkSession, cfg: CascadeConfig = CASCADE_V1) -> list[str]:
    """Creates the functions in the session, and returns their names."""
    names = []
    for head, body in _definitions(cfg).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    return names
