"""Product-sentiment rollups.

Posts are tagged once (product, community, demographic, lexicon score,
spectrum bucket, routed sentiment, intent) and every report is an
aggregate over that table. The lexicon is a (token, valence) table joined
to exploded tokens; scores use the published VADER normalisation
s / sqrt(s^2 + 15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPECTRUM, SPECTRUM_FLOOR
from ..functions.hashing import token_unit
from ..functions.token_sums import stand_in_valence_sum, text_sums

VADER_ALPHA = 15.0
# Stand-in lexicon: a token carries a valence with probability LEX_RATE,
# valence uniform in [-4, 4] rounded to 0.1 (the reference names a lexicon
# scorer but ships none; real lexicons plug in as a table).
LEX_RATE = 0.03


def stand_in_valence(tok: Column) -> Column:
    return F.when(token_unit(tok, "lex:") < LEX_RATE, F.round(F.lit(8.0) * token_unit(tok, "val:") - F.lit(4.0), 1))


def with_stand_in_compound(df: DataFrame, tokens_col: str = "tokens", out: str = "compound", text_col: str | None = None) -> DataFrame:
    """M12 for the stand-in lexicon, whose valence is a function of the token:
    summed in the same row pass as the other text work (no corpus-wide
    lexicon table, no second pass). Same values as ``lexicon_polarity``
    with ``stand_in_lexicon``. With ``text_col``, the stripped text, no array
    of tokens is built."""
    summed = text_sums(F.col(text_col), valence_rate=LEX_RATE)["v"] if text_col else stand_in_valence_sum(F.col(tokens_col), LEX_RATE)
    x = df.withColumn("_lex_s", summed)  # read twice below: materialised once
    return x.withColumn(out, F.col("_lex_s") / F.sqrt(F.col("_lex_s") * F.col("_lex_s") + F.lit(VADER_ALPHA))) \
            .drop("_lex_s")


def stand_in_lexicon(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, valence) for the distinct tokens of ``df`` that carry one."""
    t = df.select(F.explode(tokens_col).alias("token")).distinct()
    return t.withColumn("valence", stand_in_valence(F.col("token"))).filter(F.col("valence").isNotNull())


def lexicon_polarity(df: DataFrame, lexicon: DataFrame, id_cols: list[str], tokens_col: str = "tokens",
                     out: str = "compound") -> DataFrame:
    """Compound in [-1, 1] per row from a (token, valence) table; tokens
    are counted per row first, so a common token is one row a post."""
    ex = df.select(*id_cols, F.explode(tokens_col).alias("token")).groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("_k"))
    s = ex.join(lexicon.select("token", "valence"), "token", "inner").groupBy(*id_cols).agg(F.sum(F.col("valence") * F.col("_k")).alias("_s"))
    j = df.join(s, id_cols, "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    return j.withColumn(out, F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(VADER_ALPHA))).drop("_s")


def spectrum_bucket(score) -> Column:
    """Half-open spectrum intervals."""
    s = F.col(score) if isinstance(score, str) else score
    (up, up_n), (p, p_n), (neu, neu_n), (neg, neg_n) = SPECTRUM
    return (F.when(s >= up, F.lit(up_n)).when(s >= p, F.lit(p_n)).when(s > neu, F.lit(neu_n))
            .when(s > neg, F.lit(neg_n)).otherwise(F.lit(SPECTRUM_FLOOR)))


def score10(compound) -> Column:
    """P20: compound [-1, 1] -> 0..10 (linear map; the source fixes only the range)."""
    c = F.col(compound) if isinstance(compound, str) else compound
    return (c + F.lit(1.0)) * F.lit(5.0)


def demographic(followers) -> Column:
    f = F.col(followers) if isinstance(followers, str) else followers
    return F.when(f >= 100000, "influencer").when(f >= 10000, "creator").otherwise("regular")


COMPLEX_CONF = 0.6


def intent(conf1, compound) -> Column:
    """P18 intent from the tier-1 confidence and the lexicon score."""
    c1 = F.col(conf1) if isinstance(conf1, str) else conf1
    s = F.col(compound) if isinstance(compound, str) else compound
    return (F.when(c1 < COMPLEX_CONF, "COMPLEX").when(s >= 0.15, "POSITIVE").when(s <= -0.15, "NEGATIVE")
            .otherwise("NEUTRAL"))


# Fixed parameter table: community rules (keyword -> community); the
# reference names a predefined cluster list without giving one.
COMMUNITY_RULES = [
    ("the", "english_speakers"), ("and", "english_speakers"), ("of", "english_speakers"),
    ("und", "german_speakers"), ("der", "german_speakers"), ("die", "german_speakers"),
    ("le", "french_speakers"), ("la", "french_speakers"), ("des", "french_speakers"),
    ("el", "spanish_speakers"), ("los", "spanish_speakers"), ("que", "spanish_speakers"),
]


def community_tag(df: DataFrame, rules: DataFrame, id_col: str = "id", tokens_col: str = "tokens",
                  default: str = "general") -> DataFrame:
    """Community with the most keyword hits (ties by name); default when none."""
    ex = df.select(id_col, F.explode(tokens_col).alias("token"))
    hits = ex.join(rules, "token", "inner").groupBy(id_col, "community") \
             .agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy(id_col).agg(F.min_by(F.struct("community", "hits"),
                                             F.struct(-F.col("hits"), F.col("community"))).alias("_b"))
    best = best.select(id_col, F.col("_b.community").alias("community"), F.col("_b.hits").alias("hits"))
    return df.join(best, id_col, "left").withColumn("community", F.coalesce("community", F.lit(default))) \
             .withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
