"""SQL fragments for the DuckDB oracle.

Each fragment states the same semantics as the Spark code path in plain
ANSI-ish SQL (DuckDB dialect), independently of how Spark executes it.
"""

from __future__ import annotations

from ..functions.text import HANDLE_RE, NON_ALNUM_RE, SPACES_RE, URL_RE


def q(s: str) -> str:
    return s.replace("'", "''")


def clean(x: str) -> str:
    y = f"lower({x})"
    y = f"regexp_replace({y}, '{q(URL_RE)}', '', 'g')"
    y = f"regexp_replace({y}, '{q(HANDLE_RE)}', '', 'g')"
    y = f"regexp_replace({y}, '#', '', 'g')"
    y = f"regexp_replace({y}, '{q(NON_ALNUM_RE)}', ' ', 'g')"
    y = f"regexp_replace({y}, '{q(SPACES_RE)}', ' ', 'g')"
    return f"trim({y})"


def tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def u(key: str, ident: str) -> str:
    return f"((('0x' || substr(md5('{key}:' || CAST({ident} AS VARCHAR)), 1, 8))::BIGINT) / 4294967296.0::DOUBLE)"


def tok_u(key: str, t: str) -> str:
    return f"((('0x' || substr(md5('{key}' || {t}), 1, 8))::BIGINT) / 4294967296.0::DOUBLE)"


def normal(key: str, ident: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(key + '.a', ident)})) * cos(2.0::DOUBLE * pi() * {u(key + '.b', ident)}))"


def bigram_feats(tok: str) -> str:
    return f"list_concat({tok}, list_transform(range(1, len({tok})), lambda i: {tok}[i] || ' ' || {tok}[i + 1]))"


def prob(feats: str, key: str) -> str:
    s = f"coalesce(list_sum(list_transform({feats}, lambda t: 2.0::DOUBLE * {tok_u(key, 't')} - 1.0::DOUBLE)), 0.0::DOUBLE)"
    return (f"(CASE WHEN len({feats}) > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-({s} / sqrt(len({feats})::DOUBLE)))) "
            f"ELSE 0.5::DOUBLE END)")


def clip(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({float(lo)}::DOUBLE, least({float(hi)}::DOUBLE, ({x})::DOUBLE)) END)"


def prior(platform: str) -> str:
    return (f"(CASE upper({platform}) WHEN 'TWITTER' THEN 0.35 WHEN 'REDDIT' THEN 0.45 WHEN 'INSTAGRAM' THEN 0.60 "
            f"WHEN 'TIKTOK' THEN 0.75 WHEN 'UNKNOWN' THEN 0.50 ELSE 0.50 END)::DOUBLE")


def psi(rt: str, fol: str, ppm: str, plat: str) -> str:
    v = clip(f"coalesce({rt}, 0)::DOUBLE / 1000000.0")
    a = f"(CASE WHEN coalesce({fol}, 0) > 0 THEN {clip(f'ln(1 + {fol}::DOUBLE) / ln(1 + 10000000.0::DOUBLE)')} ELSE 0.0::DOUBLE END)"
    b = clip(f"coalesce({ppm}, 0)::DOUBLE / 500.0")
    return clip(f"0.30::DOUBLE * {v} + 0.30::DOUBLE * {a} + 0.25::DOUBLE * {b} + 0.15::DOUBLE * {prior(plat)}")


def tau(phi: str, psi_: str, h: str, tmin: float = 0.5, tmax: float = 0.92) -> str:
    z = f"(({phi}) * (1.0::DOUBLE - ({psi_})) + ({h}))"
    return clip(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{z})) * {tmax - tmin!r}::DOUBLE + {tmin!r}::DOUBLE", tmin, tmax)


def social_cols(ident: str) -> str:
    f = f"CAST(floor(round({clip(f'exp(8.5::DOUBLE + 2.0::DOUBLE * {normal('followers', ident)})', 0, 1e7)}, 6)) AS BIGINT)"
    r = f"CAST(floor(round({clip(f'exp(3.0::DOUBLE + 2.5::DOUBLE * {normal('retweets', ident)})', 0, 1e6)}, 6)) AS BIGINT)"
    b = f"round(1.0::DOUBLE + 199.0::DOUBLE * {u('burst', ident)}, 2)"
    return f"{f} AS follower_count, {r} AS retweet_count, {b} AS burst_rate_ppm, 'TWITTER' AS platform"


def epoch_s(ts: str) -> str:
    return f"(epoch_us({ts})::DOUBLE / 1000000.0::DOUBLE)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
