"""Dynamic-threshold math as Column expressions.

All of it is arithmetic on columns, so it stays inside whole-stage codegen;
the token entropy is summed in Arrow batches, row by row, so no token is ever
shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CASCADE_V1, UNKNOWN_PRIOR, CascadeConfig
from .token_sums import entropy_sum


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def clip(x, lo: float, hi: float) -> Column:
    """clip(x, lo, hi); NULL in -> NULL out (Spark's least/greatest skip NULLs)."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x.cast("double"))))


def platform_prior(platform, cfg: CascadeConfig = CASCADE_V1) -> Column:
    m = F.create_map(*[x for k, v in cfg.platform_priors.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(m, F.upper(_c(platform))), F.lit(UNKNOWN_PRIOR))


def virality(retweets, cfg: CascadeConfig = CASCADE_V1) -> Column:
    return clip(F.coalesce(_c(retweets).cast("double"), F.lit(0.0)) / cfg.retweet_cap, 0.0, 1.0)


def authority(followers, cfg: CascadeConfig = CASCADE_V1) -> Column:
    f = F.coalesce(_c(followers).cast("double"), F.lit(0.0))
    return F.when(f > 0, clip(F.log1p(f) / math.log1p(cfg.follower_cap), 0.0, 1.0)).otherwise(F.lit(0.0))


def burst(ppm, cfg: CascadeConfig = CASCADE_V1) -> Column:
    return clip(F.coalesce(_c(ppm).cast("double"), F.lit(0.0)) / cfg.burst_cap, 0.0, 1.0)


def psi_socio(retweets, followers, ppm, platform, cfg: CascadeConfig = CASCADE_V1) -> Column:
    wv, wa, wb, wp = cfg.psi_weights
    s = (F.lit(wv) * virality(retweets, cfg) + F.lit(wa) * authority(followers, cfg)
         + F.lit(wb) * burst(ppm, cfg) + F.lit(wp) * platform_prior(platform, cfg))
    return clip(s, 0.0, 1.0)


def h_token(tokens, cfg: CascadeConfig = CASCADE_V1) -> Column:
    """Normalised token entropy in [0, 1]; empty -> 0; one distinct token -> 0."""
    t = _c(tokens)
    return h_of(F.size(t), entropy_sum(t), cfg)


def h_of(n: Column, entropy: Column, cfg: CascadeConfig = CASCADE_V1) -> Column:
    """``h_token`` from the number of tokens and their ``entropy_sum``."""
    raw = -entropy / math.log(cfg.vocab_size + 1e-12)
    # raw is never NULL here, so clip without a NULL test
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def tau_dynamic(phi, psi, h, cfg: CascadeConfig = CASCADE_V1) -> Column:
    phi, psi, h = _c(phi), _c(psi), _c(h)
    z = sigmoid_input(phi, psi, h, cfg)
    return clip(sigmoid(z) * (cfg.tau_max - cfg.tau_min) + cfg.tau_min, cfg.tau_min, cfg.tau_max)


def physical_term(phi, psi) -> Column:
    return _c(phi) * (F.lit(1.0) - _c(psi))


def sigmoid_input(phi, psi, h, cfg: CascadeConfig = CASCADE_V1) -> Column:
    if cfg.sign == "documented":
        # prose variant: social urgency and complexity push tau down
        return physical_term(phi, psi) - _c(h)
    return physical_term(phi, psi) + _c(h)


def tau_terms(phi, psi, h, cfg: CascadeConfig = CASCADE_V1) -> Column:
    """The six-field component record of one routing decision."""
    phi, psi, h = _c(phi), _c(psi), _c(h)
    return F.struct(
        tau_dynamic(phi, psi, h, cfg).alias("tau_dynamic"),
        phi.alias("phi_physical"),
        psi.alias("psi_socio"),
        h.alias("h_token"),
        physical_term(phi, psi).alias("physical_term"),
        sigmoid_input(phi, psi, h, cfg).alias("sigmoid_input"),
    )
