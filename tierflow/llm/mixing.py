"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents fall into cells (source, language, topic). A cell's token total is
scaled in turn so that the totals by source, by language and by topic meet
their targets; after a fixed number of sweeps each cell has a weight, the ratio
of its fitted to its own total. Documents are then drawn by Poisson sampling:
each is kept with its cell's probability, min(1, scale * weight), where the
scale is calibrated so that the expected tokens kept meet a share of the input.
The draw is a hash of the id, so it is the same on any partitioning.

Targets are given as shares, or by a temper: the share of a source, language or
topic in the tokens, to that power, made to sum to 1 (below 1 it flattens).

Scale: one narrow pass counts tokens, one partial aggregate gives the cells;
fitting works on cells alone, as windows and joins of a table as small as the
number of cells, cut off by a reliable checkpoint; probabilities join the
documents by cell: broadcast up to a counted number of cells, else as an
equi-join that adaptive execution splits where a cell is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SWEEPS = 8
#: The bounded fit ends when no cell moves by more than this part of its tokens, or after so many sweeps.
STILL, BOUNDED_SWEEPS = 1e-3, 40
#: Steps of the search for the scale: each fixes which cells are kept whole and solves for the rest.
STEPS = 6
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}
SHARE = 0.8
#: Cells (about 100 bytes each) up to which they are broadcast; beyond, adaptive execution joins by cell.
BROADCAST_CELLS = 50_000
DIMENSIONS = ("source", "lang", "topic")

#: Topics of the registered query, by what a text looks like; the first that fits.
TOPICS = (("shouting", "!! "), ("symbols", "%%% "), ("list", " | "))


def topic_of(text: Column) -> Column:
    """A topic by fixed marks in the text; others are prose."""
    out = None
    for name, mark in TOPICS:
        out = (F if out is None else out).when(F.contains(text, F.lit(mark)), F.lit(name))
    return out.otherwise(F.lit("prose"))


def token_count(text: Column) -> Column:
    """Words by ASCII white space; an empty text counts as one token, so that it can be drawn."""
    return F.greatest(F.lit(1), F.size(F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")), " +"))).cast("long")


def cells(docs: DataFrame, source: str, lang: str, topic: Column, tokens: Column) -> DataFrame:
    """(source, lang, topic, n_docs, tokens); null parts are a part of their own, the empty string."""
    parts = [F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(topic, F.lit("")).alias("topic")]
    return docs.select(*parts, tokens.alias("n")).groupBy(*DIMENSIONS).agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"))


def _margin(table: DataFrame, by: str, of: str) -> DataFrame:
    return table.groupBy(by).agg(F.sum(of).alias("margin"))


def tempered(table: DataFrame, by: str, power: float) -> DataFrame:
    """(by, target): shares of the tokens to a power, made to sum to the tokens."""
    raw = _margin(table, by, "tokens").withColumn("p", F.pow(F.col("margin").cast("double"), F.lit(power)))
    whole, tokens = raw.agg(F.sum("p"), F.sum("margin").cast("double")).first()
    return raw.select(by, (F.col("p") / F.lit(whole) * F.lit(tokens)).alias("target"))


def given(table: DataFrame, shares: DataFrame, by: str) -> DataFrame:
    """(by, target) from a table (by, share); values without a share get none, shares of values not there are left out and the rest scaled up."""
    there = _margin(table, by, "tokens").join(shares, by, "left").select(by, "margin", F.coalesce("share", F.lit(0.0)).alias("share"))
    whole, tokens = there.agg(F.sum("share"), F.sum("margin").cast("double")).first()
    return there.select(by, (F.col("share") / F.lit(whole) * F.lit(tokens) if whole else F.lit(0.0)).alias("target"))


def rake(table: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """`table` (source, lang, topic, n_docs, tokens) with `weight`: fitted over own tokens."""
    fitted = table.withColumn("fitted", F.col("tokens").cast("double"))
    targets = {by: checkpoint(t) for by, t in targets.items()}  # as small as the table
    for _ in range(sweeps):
        for by in DIMENSIONS:
            margin = F.sum("fitted").over(Window.partitionBy(by))  # over cells, not documents
            fitted = (fitted.withColumn("margin", margin).join(targets[by], by)
                      .select(*table.columns, F.when(F.col("margin") > 0, F.col("fitted") * F.col("target") / F.col("margin")).otherwise(F.lit(0.0)).alias("fitted")))
        fitted = checkpoint(fitted)
    return fitted.select(*table.columns, (F.col("fitted") / F.col("tokens")).alias("weight"))


def reachable(target: DataFrame, table: DataFrame, by: str, share: float) -> DataFrame:
    """(by, target, full) with no target above the tokens there are over `share`; what is above goes to the others in proportion."""
    room = F.least(F.col("target"), F.col("margin") / F.lit(share))
    both = checkpoint(target.join(_margin(table, by, "tokens"), by))
    total, scale = both.agg(F.sum("target")).first()[0] or 0.0, 1.0
    while True:  # each step fills one value more, or ends
        grown = both.withColumn("target", F.col("target") * F.lit(scale)).withColumn("full", F.col("target") * F.lit(share) >= F.col("margin"))
        whole, rest = grown.agg(F.sum(F.when(F.col("full"), F.col("margin") / F.lit(share)).otherwise(F.lit(0.0))), F.sum(F.when(~F.col("full"), F.col("target")))).first()
        step = (total - whole) / rest if rest else 1.0
        if step <= 1 + 1e-12:
            return grown.select(by, room.alias("target"), "full")
        scale *= step


def rake_bounded(table: DataFrame, targets: dict[str, DataFrame], share: float, sweeps: int = BOUNDED_SWEEPS) -> DataFrame:
    """`rake`, but no cell is fitted above its tokens over `share`, so that nothing is cut when `share` of all is drawn.

    Cells of a value that must be kept whole are fixed so. Within a margin the
    factor of the others is exact: cells in the order in which they fill up,
    and the factor of the first that doesn't once those before it are full.
    """
    if share <= 0:
        return rake(table, targets)
    fitted = table.withColumn("fitted", F.col("tokens").cast("double")).withColumn("room", F.col("tokens") / F.lit(min(1.0, share)))
    fixed = F.lit(False)
    for by in DIMENSIONS:
        fitted = fitted.join(reachable(targets[by], table, by, min(1.0, share)).select(by, F.col("target").alias(f"to_{by}"), F.col("full").alias(f"full_{by}")), by)
        fixed = fixed | F.col(f"full_{by}")
    fitted = fitted.withColumn("fixed", fixed).drop(*[f"full_{by}" for by in DIMENSIONS])
    fitted = checkpoint(fitted.withColumn("fitted", F.when(F.col("fixed"), F.col("room")).otherwise(F.col("fitted"))))
    columns = fitted.columns
    for _ in range(sweeps):
        step = fitted.withColumn("was", F.col("fitted"))
        for by in DIMENSIONS:
            margin = Window.partitionBy(by)  # over cells, not documents
            turn = margin.orderBy(F.desc("fixed"), F.desc(F.col("fitted") / F.col("room")), *[d for d in DIMENSIONS if d != by])
            before = F.coalesce(F.sum("room").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            step = step.withColumn("before", before).withColumn("rest", F.sum("fitted").over(turn.rowsBetween(0, Window.unboundedFollowing)))
            step = step.withColumn("factor", F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.col(f"to_{by}") - F.col("before")) / F.col("rest")))
            step = step.withColumn("factor", F.max(F.when(~F.col("fixed") & (F.col("factor") * F.col("fitted") <= F.col("room") * F.lit(1 + 1e-12)), F.col("factor"))).over(margin))
            fill = F.least(F.col("room"), F.coalesce(F.col("factor") * F.col("fitted"), F.col("room")))
            step = step.withColumn("fitted", F.when(F.col("fixed"), F.col("room")).when(F.col("fitted") > 0, fill).otherwise(F.lit(0.0)))
        step = checkpoint(step.select(*columns, "was"))
        moved = step.agg(F.max(F.abs(F.col("fitted") - F.col("was")) / F.col("tokens"))).first()[0]
        fitted = step.select(*columns)
        if moved is None or moved <= STILL:
            break
    return fitted.select(*table.columns, (F.col("fitted") / F.col("tokens")).alias("weight"))


def calibrate(weighted: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """`weighted` with `probability`: min(1, scale * weight), the scale such that `share` of the tokens are expected to be kept."""
    tokens, fitted = weighted.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("weight"))).first()
    scale = share * tokens / fitted if fitted else 0.0
    for _ in range(steps):
        full = F.col("weight") * F.lit(scale) >= 1
        whole, rest = weighted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(F.lit(0))), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("tokens") * F.col("weight")))).first()
        if rest:  # the scale never falls: a cell once kept whole stays so
            scale = max(scale, (share * tokens - whole) / rest)
    return weighted.withColumn("probability", F.least(F.lit(1.0), F.coalesce(F.col("weight") * F.lit(scale), F.lit(0.0))))


def draw(doc_id: Column) -> Column:
    """A number from 0 to under 1 by the id: 48 bits of its md5. A null id draws 0."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)), F.lit(0.0))


def _targets(table: DataFrame, shares: dict[str, DataFrame] | None, temper: dict[str, float] | None) -> dict[str, DataFrame]:
    temper = TEMPER | (temper or {})
    return {by: given(table, shares[by], by) if shares and by in shares else tempered(table, by, temper[by]) for by in DIMENSIONS}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None,
        tokens: Column | None = None, shares: dict[str, DataFrame] | None = None, temper: dict[str, float] | None = None, share: float = SHARE,
        bounded: bool = True) -> DataFrame:
    """The columns of `docs`, plus mix_topic, mix_tokens, mix_weight, mix_probability, mix_kept, one row per row.

    `shares` may hold a table (name, share) for any of source, lang and
    topic; the others are tempered. Null sources, languages and topics form
    a value of their own. If not `bounded`, cells are fitted as if they could
    be drawn more than once and cut at probability 1, which misses targets. Null text counts as empty, as one token. Rows with
    one id share their draw; a null id is kept wherever its probability isn't
    0. A column of `docs` with the name of a result is replaced. No rows
    give no rows.
    """
    topic = topic_of(F.coalesce(F.col(text_col), F.lit(""))) if topic is None else topic
    tokens = token_count(F.col(text_col)) if tokens is None else tokens
    table = checkpoint(cells(docs, source, lang, topic, tokens))
    targets = _targets(table, shares, temper)
    found = checkpoint(calibrate(rake_bounded(table, targets, share) if bounded else rake(table, targets), share)).select(
        F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    if found.count() <= BROADCAST_CELLS:
        found = F.broadcast(found)
    names = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_kept")
    own = docs.select(*[c for c in docs.columns if c.lower() not in names], F.coalesce(topic, F.lit("")).alias("mix_topic"), tokens.alias("mix_tokens"))
    joined = own.join(found, (F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col("_s")) & (F.coalesce(F.col(lang).cast("string"), F.lit("")) == F.col("_l")) & (F.col("mix_topic") == F.col("_t")))
    return joined.drop("_s", "_l", "_t").withColumn("mix_kept", draw(F.col(id_col)) < F.col("mix_probability"))


def marginals(marked: DataFrame, source: str = "source", lang: str = "lang", shares: dict[str, DataFrame] | None = None, temper: dict[str, float] | None = None,
              share: float = SHARE) -> DataFrame:
    """(dimension, value, own, target, expected, drawn, feasible) of a result of `mix` with these options.

    Shares of the tokens: of all, as wanted, by the probabilities, and of the
    rows kept. Feasible: the value has the tokens that its target asks for.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = F.col("mix_tokens")
    table = checkpoint(marked.groupBy(part(source).alias("source"), part(lang).alias("lang"), F.col("mix_topic").alias("topic")).agg(
        F.sum(n).alias("tokens"), F.sum(n * F.col("mix_probability")).alias("expected"), F.sum(F.when(F.col("mix_kept"), n).otherwise(F.lit(0))).alias("drawn")))
    total, expected, drawn = table.agg(F.sum("tokens"), F.sum("expected"), F.sum("drawn")).first()
    of = lambda c, whole: (F.col(c) / F.lit(float(whole or 1))).alias(c)
    out = None
    for by, target in _targets(table, shares, temper).items():
        sums = table.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tokens", "expected", "drawn")]).join(target, by)
        rows = sums.select(F.lit(by).alias("dimension"), F.col(by).alias("value"), of("tokens", total).alias("own"), of("target", total), of("expected", expected), of("drawn", drawn),
                           (F.col("target") * F.lit(share) <= F.col("tokens")).alias("feasible"))
        out = rows if out is None else out.unionByName(rows)
    return out


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are drawn, all columns as they are, by default columns and options of mix."""
    slim = docs.select("doc_id", "text", "source", "lang", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    return mix(slim, **options).where("mix_kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document its tokens, topic, weight, probability and whether it is drawn (rounded: SQL sums in another order)."""
    from .common import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs, bounded=False).select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"),
                            F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def _sql() -> str:
    """The query in SQL, sweep by sweep."""
    case = " ".join(f"WHEN contains(t, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    steps = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, source, lang, CASE {case} ELSE 'prose' END AS topic,
  greatest(1, len(regexp_split_to_array(trim(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')), ' +')))::BIGINT AS n FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n)::BIGINT AS tokens FROM e GROUP BY ALL)"""]
    for by in DIMENSIONS:
        steps.append(f"""g_{by} AS MATERIALIZED (SELECT {by}, pow(sum(tokens)::DOUBLE, {TEMPER[by]}) / sum(pow(sum(tokens)::DOUBLE, {TEMPER[by]})) OVER () * sum(sum(tokens)::DOUBLE) OVER () AS target FROM c GROUP BY {by})""")
    last = "c"
    of = "tokens::DOUBLE"
    for s in range(SWEEPS):
        for by in DIMENSIONS:
            now = f"f{s}_{by}"
            steps.append(f"""{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, {of} * target / sum({of}) OVER (PARTITION BY {by}) AS fitted FROM {last} JOIN g_{by} USING ({by}))""")
            last, of = now, "fitted"
    steps.append(f"w AS MATERIALIZED (SELECT *, fitted / tokens AS weight FROM {last})")
    steps.append(f"s0 AS MATERIALIZED (SELECT {SHARE} * sum(tokens) / sum(tokens * weight) AS scale FROM w)")
    for i in range(STEPS):
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT CASE WHEN rest > 0 THEN greatest(scale, ({SHARE} * total - whole) / rest) ELSE scale END AS scale FROM (
  SELECT sum(tokens) AS total, sum(CASE WHEN weight * scale >= 1 THEN tokens ELSE 0 END) AS whole, sum(CASE WHEN weight * scale >= 1 THEN 0.0 ELSE tokens * weight END) AS rest, max(scale) AS scale FROM w, s{i}))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, topic, n AS n_tokens, round(weight, 6) AS weight, round(least(1.0, weight * scale), 6) AS probability,
  (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) < least(1.0, weight * scale) AS kept
FROM e JOIN w USING (source, lang, topic), s{STEPS}"""


SQL = _sql()
