"""Deterministic per-row randomness: a value depends on (key, id) only, so it
is the same on any partitioning, any cluster size and in the SQL oracle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def unit_hash(key: str, ident) -> Column:
    """u in [0, 1): first 8 hex digits of md5(key || ':' || id) / 2^32."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    h = F.md5(F.concat(F.lit(f"{key}:"), ident.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(TWO32)


def token_unit(token: Column, key: str = "") -> Column:
    """u in [0, 1) of a token string (optionally namespaced by key)."""
    s = F.concat(F.lit(key), token) if key else token
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") / F.lit(TWO32)


def std_normal(key: str, ident) -> Column:
    """Box-Muller normal from two hashed uniforms."""
    u1 = unit_hash(f"{key}.a", ident)
    u2 = unit_hash(f"{key}.b", ident)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)
