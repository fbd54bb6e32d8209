"""Query catalogue: one Spark builder and (where expressible) one oracle SQL
per operator of the survey inventory.

Builders take (spark, sf_dir) and return a lazy DataFrame over the whole
tables. Doubles are rounded to 6 decimals on both sides so the oracle
comparison is insensitive to summation order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CASCADE_V1, CASCADE_V2, SWEEP_LIBRARY, SWEEP_NOTEBOOK
from ..functions import arrays
from ..functions.text import STOPWORDS, analyzer_tokens, remove_stopwords, strip_for_tokens, strip_html, word_tokens, clean_text
from ..operators import metrics, routing, scan, telemetry
from ..operators.scoring import tier1_scorer, tier2_scorer
from ..session import cut_lineage, ensure_checkpoint_dir, read_table, settle, shuffles_go, spread
from . import pipeline as pl
from . import sqlfrag as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------------------
# shared SQL CTEs
# ---------------------------------------------------------------------------

DOCS_CTE = f"""docs AS (SELECT doc_id AS id, lang, source, {S.clean('text')} AS clean FROM documents),
dt AS (SELECT *, {S.tokens('clean')} AS tok FROM docs)"""

T1P = S.prob("tok", "t1:")
T2F = S.bigram_feats("tok")
T2P = S.prob(T2F, "t2:")

SCORED_CTE = f"""{DOCS_CTE},
sc AS (SELECT id, lang, source, tok, len(tok) AS n_tok,
              CASE WHEN {T1P} > 0.5 THEN 1 ELSE 0 END AS p1,
              greatest({T1P}, 1.0::DOUBLE - {T1P}) AS c1,
              CASE WHEN {T2P} > 0.5 THEN 1 ELSE 0 END AS p2,
              greatest({T2P}, 1.0::DOUBLE - {T2P}) AS c2,
              len(tok)::DOUBLE * 1e-5 AS tier1_latency,
              greatest(2 * len(tok) - 1, 0)::DOUBLE * 4e-5 AS tier2_cost
       FROM dt)"""

H_CTE = """hc AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(tok) AS t FROM dt) GROUP BY id, t),
hn AS (SELECT id, len(tok) AS n FROM dt),
hs AS (SELECT hc.id, sum((c::DOUBLE / n) * ln(c::DOUBLE / n + 1e-12)) AS s FROM hc JOIN hn USING (id) GROUP BY hc.id),
hh AS (SELECT hn.id, hn.n, CASE WHEN hn.n > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, -hs.s / ln(30522 + 1e-12))) ELSE 0.0::DOUBLE END AS h
       FROM hn LEFT JOIN hs USING (id))"""


def acc_f1_sql(src: str, group: list[str]) -> str:
    """accuracy + macro F1 per group over a source with columns (group.., y, p)."""
    g = ", ".join(group)
    gj = " AND ".join(f"k.{c} = m.{c}" for c in group)
    return f"""cm AS (SELECT {g}, y, p, count(*) AS n FROM ({src}) GROUP BY {g}, y, p),
kls AS (SELECT DISTINCT {g}, cls FROM (SELECT {g}, y AS cls FROM cm UNION ALL SELECT {g}, p AS cls FROM cm)),
pc AS (SELECT {', '.join('k.' + c for c in group)}, k.cls,
              sum(CASE WHEN m.y = k.cls AND m.p = k.cls THEN m.n ELSE 0 END) AS tp,
              sum(CASE WHEN m.y <> k.cls AND m.p = k.cls THEN m.n ELSE 0 END) AS fp,
              sum(CASE WHEN m.y = k.cls AND m.p <> k.cls THEN m.n ELSE 0 END) AS fn,
              sum(CASE WHEN m.y = k.cls THEN m.n ELSE 0 END) AS support
       FROM kls k JOIN cm m ON {gj} GROUP BY {', '.join('k.' + c for c in group)}, k.cls),
f1 AS (SELECT {g}, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f1_macro FROM pc GROUP BY {g}),
acc AS (SELECT {g}, sum(n) AS n, sum(CASE WHEN y = p THEN n ELSE 0 END)::DOUBLE / sum(n) AS accuracy FROM cm GROUP BY {g})"""


# ---------------------------------------------------------------------------
# text (P1, P2, P12-P17, M1, M10)
# ---------------------------------------------------------------------------

@register("clean_text", f"SELECT doc_id, {S.clean('text')} AS clean FROM documents")
def q_clean_text(spark, sf):
    return spread(read_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", clean_text("text").alias("clean"))


@register("clean_conversations", f"SELECT conv_id, turn, {S.clean('text')} AS clean, "
          f"len({S.tokens(S.clean('text'))})::BIGINT AS n_tokens FROM conversations")
def q_clean_conversations(spark, sf):
    c = spread(read_table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", clean_text("text").alias("clean"))
    return c.withColumn("n_tokens", F.size(word_tokens("clean")).cast("long"))


def _strip_html_sql(x: str) -> str:
    y = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
    y = f"regexp_replace({y}, '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
    y = f"regexp_replace({y}, '<[^>]*>', ' ', 'g')"
    y = f"regexp_replace({y}, '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g')"
    y = f"regexp_replace({y}, '{S.q(S.SPACES_RE)}', ' ', 'g')"
    return f"trim({y})"


@register("html_strip", f"SELECT page_id, {_strip_html_sql('html')} AS text FROM pages")
def q_html_strip(spark, sf):
    return spread(read_table(spark, sf, "pages").select("page_id", "html")).select("page_id", strip_html("html").alias("text"))


@register("html_clean_text", f"SELECT page_id, {S.clean(_strip_html_sql('html'))} AS clean FROM pages")
def q_html_clean_text(spark, sf):
    """P1 on stripped pages: URLs and handles do occur there."""
    return spread(read_table(spark, sf, "pages").select("page_id", "html")).select("page_id", clean_text(strip_html("html")).alias("clean"))


MARKUP_RATIO = 0.25


@register("markup_filter", f"""SELECT page_id, {S.r6(f'length({_strip_html_sql("html")})::DOUBLE / greatest(length(html), 1)')} AS text_ratio,
       length({_strip_html_sql("html")})::DOUBLE / greatest(length(html), 1) < {MARKUP_RATIO} AS mostly_markup FROM pages""")
def q_markup_filter(spark, sf):
    """Ratio of visible text to raw markup; below the ratio = mostly markup."""
    p = read_table(spark, sf, "pages")
    ratio = F.length(strip_html("html")).cast("double") / F.greatest(F.length("html"), F.lit(1))
    return p.select("page_id", r6(ratio).alias("text_ratio"), (ratio < MARKUP_RATIO).alias("mostly_markup"))


TRUNC_CHARS = 280


@register("truncate_comments", f"SELECT doc_id, substr(text, 1, {TRUNC_CHARS}) AS snippet, "
          f"length(text) > {TRUNC_CHARS} AS truncated FROM documents")
def q_truncate(spark, sf):
    """Cap each comment's characters (the cap is the operator)."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.substring("text", 1, TRUNC_CHARS).alias("snippet"),
                    (F.length("text") > TRUNC_CHARS).alias("truncated"))


_SW_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


@register("stopwords", f"""WITH {DOCS_CTE}
SELECT id AS doc_id, len(tok)::BIGINT AS n_tokens,
       len(list_filter(tok, lambda t: NOT list_contains({_SW_SQL}, t)))::BIGINT AS n_kept FROM dt""")
def q_stopwords(spark, sf):
    d = pl.docs(spark, sf)
    return d.select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"),
                    F.size(remove_stopwords(F.col("tokens"), STOPWORDS)).cast("long").alias("n_kept"))


@register("token_reduction", f"""WITH {DOCS_CTE},
raw AS (SELECT sum(len(list_filter(string_split(regexp_replace(text, '{S.q(S.SPACES_RE)}', ' ', 'g'), ' '), lambda t: t <> '')))::BIGINT AS before FROM documents),
aft AS (SELECT sum(len(list_filter(tok, lambda t: NOT list_contains({_SW_SQL}, t))))::BIGINT AS after FROM dt)
SELECT before AS tokens_before, after AS tokens_after, {S.r6('1.0 - after::DOUBLE / greatest(before, 1)')} AS reduction FROM raw, aft""")
def q_token_reduction(spark, sf):
    """Tokens before (raw whitespace split) vs after cleaning + stop words."""
    raw_tok = F.filter(F.split(F.regexp_replace("text", S.SPACES_RE, " "), " "), lambda t: t != "")
    j = pl.docs(spark, sf, with_text=True).agg(
        F.sum(F.size(raw_tok)).cast("long").alias("tokens_before"),
        F.sum(F.size(remove_stopwords(F.col("tokens"), STOPWORDS))).cast("long").alias("tokens_after"))
    return j.withColumn("reduction", r6(F.lit(1.0) - F.col("tokens_after") / F.greatest(F.col("tokens_before"), F.lit(1))))


@register("text_preview", f"""WITH {DOCS_CTE}
SELECT d.id AS doc_id, CASE WHEN l.quality = 1 THEN 'POS' ELSE 'NEG' END AS label_name, substr(d.clean, 1, 80) AS preview
FROM docs d JOIN labels l ON l.doc_id = d.id""")
def q_text_preview(spark, sf):
    """Label name and the first 80 characters of the cleaned text."""
    d = pl.docs(spark, sf).join(pl.labelled(spark, sf), "id", "inner")
    return d.select(F.col("id").alias("doc_id"),
                    F.when(F.col("label") == 1, "POS").otherwise("NEG").alias("label_name"),
                    F.substring("clean", 1, 80).alias("preview"))


@register("seq_cap", f"""WITH {DOCS_CTE}
SELECT id AS doc_id, len(tok)::BIGINT AS n_tokens, least(len(tok), 128)::BIGINT AS n_kept_tier1,
       least(len(tok), 256)::BIGINT AS n_kept_tier2, len(tok) > 128 AS truncated_tier1 FROM dt""")
def q_seq_cap(spark, sf):
    """What the tier-1 (128) and tier-2 (256) sequence caps keep of each
    whole tokenised text."""
    d = pl.docs(spark, sf)
    n = F.size("tokens")
    return d.select(F.col("id").alias("doc_id"), n.cast("long").alias("n_tokens"),
                    F.size(F.slice("tokens", 1, 128)).cast("long").alias("n_kept_tier1"),
                    F.size(F.slice("tokens", 1, 256)).cast("long").alias("n_kept_tier2"),
                    (n > 128).alias("truncated_tier1"))


# ---------------------------------------------------------------------------
# signals (X1-X11, A15, A16)
# ---------------------------------------------------------------------------

@register("synthetic_social", f"SELECT doc_id, {S.social_cols('doc_id')} FROM documents")
def q_synthetic_social(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    return pl.with_social(d, "doc_id")


def _describe_sql(cols: list[str]) -> str:
    parts = []
    stats = [("count", "count({c})::DOUBLE"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
             ("min", "min({c})::DOUBLE"), ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
             ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})::DOUBLE")]
    for name, expr in stats:
        sel = ", ".join(f"round(CAST({expr.format(c=c)} AS DOUBLE), 2) AS {c}" for c in cols)
        parts.append(f"SELECT '{name}' AS stat, {sel} FROM soc")
    return " UNION ALL ".join(parts)


@register("social_describe", f"""WITH soc AS (SELECT value, length(props) AS props_chars, hour(ts) AS hour FROM events)
{_describe_sql(['value', 'props_chars', 'hour'])}""")
def q_social_describe(spark, sf):
    """count/mean/std/min/quartiles/max, 2 dp, of the events' columns.
    Quartiles are exact, found by counting in a few passes for all columns
    together (metrics.exact_summaries)."""
    d = read_table(spark, sf, "events").select(
        F.col("value").cast("double").alias("value"), F.length("props").cast("double").alias("props_chars"), F.hour("ts").cast("double").alias("hour"))
    return metrics.describe(d, ["value", "props_chars", "hour"])


@register("platform_counts", "SELECT event_type AS platform, count(*) AS n FROM events GROUP BY event_type")
def q_platform_counts(spark, sf):
    """Value counts (the channel of the events)."""
    return read_table(spark, sf, "events").groupBy(F.col("event_type").alias("platform")).agg(F.count(F.lit(1)).alias("n"))


@register("psi_socio", f"""WITH soc AS (SELECT doc_id, {S.social_cols('doc_id')} FROM documents)
SELECT doc_id, {S.r6(S.clip('retweet_count::DOUBLE / 1000000.0'))} AS virality,
       {S.r6(f"CASE WHEN follower_count > 0 THEN {S.clip('ln(1 + follower_count::DOUBLE) / ln(1 + 10000000.0::DOUBLE)')} ELSE 0.0 END")} AS authority,
       {S.r6(S.clip('burst_rate_ppm / 500.0'))} AS burst, {S.r6(S.prior('platform'))} AS prior,
       {S.r6(S.psi('retweet_count', 'follower_count', 'burst_rate_ppm', 'platform'))} AS psi FROM soc""")
def q_psi_socio(spark, sf):
    from ..functions import signals as sg
    d = pl.with_social(read_table(spark, sf, "documents").select("doc_id"), "doc_id")
    return d.select("doc_id", r6(sg.virality("retweet_count")).alias("virality"),
                    r6(sg.authority("follower_count")).alias("authority"),
                    r6(sg.burst("burst_rate_ppm")).alias("burst"),
                    r6(sg.platform_prior("platform")).alias("prior"),
                    r6(sg.psi_socio("retweet_count", "follower_count", "burst_rate_ppm", "platform")).alias("psi"))


@register("h_token", f"""WITH {DOCS_CTE}, {H_CTE}
SELECT id AS doc_id, n::BIGINT AS n_tokens, {S.r6('h')} AS h_token FROM hh""")
def q_h_token(spark, sf):
    from ..functions.signals import h_token
    d = pl.docs(spark, sf)
    return d.select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"),
                    r6(h_token("tokens")).alias("h_token"))


@register("tau_components", f"""WITH {DOCS_CTE}, {H_CTE},
soc AS (SELECT doc_id AS id, {S.social_cols('doc_id')} FROM documents),
x AS (SELECT id, 0.0::DOUBLE AS phi, {S.psi('retweet_count', 'follower_count', 'burst_rate_ppm', 'platform')} AS psi, h FROM soc JOIN hh USING (id))
SELECT id AS doc_id, {S.r6(S.tau('phi', 'psi', 'h'))} AS tau_dynamic, {S.r6('phi')} AS phi_physical, {S.r6('psi')} AS psi_socio,
       {S.r6('h')} AS h_token, {S.r6('phi * (1 - psi)')} AS physical_term, {S.r6('phi * (1 - psi) + h')} AS sigmoid_input FROM x""")
def q_tau_components(spark, sf):
    """The six-field component record with phi = 0 (no telemetry)."""
    d = pl.components(pl.with_signals(pl.with_social(pl.docs(spark, sf))))
    c = "components"
    return d.select(F.col("id").alias("doc_id"), *[r6(F.col(f"{c}.{f}")).alias(f) for f in
                    ["tau_dynamic", "phi_physical", "psi_socio", "h_token", "physical_term", "sigmoid_input"]])


# ---------------------------------------------------------------------------
# scoring and routing
# ---------------------------------------------------------------------------

@register("linear_score", f"""WITH {SCORED_CTE}
SELECT id AS doc_id, p1 AS prediction, {S.r6('c1')} AS confidence FROM sc""")
def q_linear_score(spark, sf):
    """M7: stand-in tier-1 linear model (hashed token weights), JVM-side."""
    s = pl.scored(spark, sf)
    return s.select(F.col("id").alias("doc_id"), F.col("p1").alias("prediction"), r6("c1").alias("confidence"))


@register("softmax_argmax", """SELECT vec_id,
  (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS argmax,
  round(1.0::DOUBLE / list_sum(list_transform(embedding, lambda e: exp(e::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS top_prob
FROM embeddings""")
def q_softmax_argmax(spark, sf):
    """M9: logits -> softmax -> (argmax with lowest-index ties, top probability)."""
    e = read_table(spark, sf, "embeddings")
    probs = arrays.softmax(F.col("embedding"))
    return e.select("vec_id", arrays.argmax(F.col("embedding")).alias("argmax"), r6(arrays.top_prob(probs)).alias("top_prob"))


THRESHOLD = 0.85


@register("route_fixed", f"""WITH {SCORED_CTE}
SELECT id AS doc_id, c1 < {THRESHOLD} AS escalate,
       CASE WHEN c1 < {THRESHOLD} THEN p2 ELSE p1 END AS prediction,
       {S.r6(f'CASE WHEN c1 < {THRESHOLD} THEN c2 ELSE c1 END')} AS confidence,
       CASE WHEN c1 < {THRESHOLD} THEN 2 ELSE 1 END AS tier_used,
       CASE WHEN c1 < {THRESHOLD} THEN 'BERT (Tier-2)' ELSE 'DistilBERT (Tier-1)' END AS tier FROM sc""")
def q_route_fixed(spark, sf):
    """Fixed-threshold cascade; tier 2 evaluated only on escalated rows."""
    d = routing.route_fixed(pl.docs(spark, sf), tier1_scorer(), tier2_scorer(), THRESHOLD)
    return d.select(F.col("id").alias("doc_id"), "escalate", "prediction", r6("confidence").alias("confidence"),
                    "tier_used", "tier")


@register("route_overlay", f"""WITH {SCORED_CTE},
t2 AS (SELECT id, p2 FROM sc WHERE c1 < {THRESHOLD})
SELECT sc.id AS doc_id, coalesce(t2.p2, sc.p1) AS prediction, t2.p2 IS NOT NULL AS from_tier2 FROM sc LEFT JOIN t2 USING (id)""")
def q_route_overlay(spark, sf):
    """Tier-2 rows (scored only on the escalated subset) overlaid by id."""
    # cut: the overlay reads it twice, and a filter on c1 would score rows again in front of the model
    esc = F.col("c1") < THRESHOLD
    s1 = cut_lineage(pl.scored(spark, sf).select("id", "p1", "c1", F.when(esc, F.col("tokens")).alias("tokens")))
    esc = s1.filter(esc)
    t2 = tier2_scorer().with_scores(esc, "tokens", "p2", "c2").select("id", "p2", "c2")
    o = routing.overlay(s1.select("id", "p1", "c1"), t2)
    return o.select(F.col("id").alias("doc_id"), "prediction", (F.col("tier_used") == 2).alias("from_tier2"))


@register("route_split_semi_anti", f"""WITH {SCORED_CTE},
esc AS (SELECT id FROM sc WHERE c1 < {THRESHOLD})
SELECT 'escalated' AS subset, count(*) AS n, {S.r6('avg(c1)')} AS avg_conf FROM sc WHERE id IN (SELECT id FROM esc)
UNION ALL
SELECT 'accepted' AS subset, count(*) AS n, {S.r6('avg(c1)')} AS avg_conf FROM sc WHERE id NOT IN (SELECT id FROM esc)""")
def q_route_split_semi_anti(spark, sf):
    """Escalated / accepted subsets via semi and anti joins on the id set."""
    s1 = cut_lineage(pl.scored(spark, sf).select("id", "c1"))  # four branches read it
    esc_ids = s1.filter(F.col("c1") < THRESHOLD).select("id")
    a = routing.escalated_subset(s1, esc_ids, escalated=True).agg(
        F.lit("escalated").alias("subset"), F.count(F.lit(1)).alias("n"), r6(F.avg("c1")).alias("avg_conf"))
    b = routing.escalated_subset(s1, esc_ids, escalated=False).agg(
        F.lit("accepted").alias("subset"), F.count(F.lit(1)).alias("n"), r6(F.avg("c1")).alias("avg_conf"))
    return a.unionByName(b)


BATCH = 64


@register("route_latency_modes", f"""WITH {SCORED_CTE},
b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // {BATCH} AS batch_id FROM sc),
d AS (SELECT id, batch_id, c1 < {THRESHOLD} AS esc, tier1_latency,
             CASE WHEN c1 < {THRESHOLD} THEN tier2_cost ELSE 0.0 END AS tier2_latency FROM b)
SELECT id AS doc_id, batch_id::BIGINT AS batch_id, {S.r6('tier1_latency')} AS tier1_latency, {S.r6('tier2_latency')} AS tier2_latency,
       {S.r6('CASE WHEN esc THEN avg(tier2_latency) OVER (PARTITION BY batch_id, esc) ELSE 0.0 END')} AS tier2_latency_batched FROM d""")
def q_route_latency_modes(spark, sf):
    """Per-row tier-2 latency vs the batch mean (batch_escalation)."""
    d = routing.route_fixed(pl.docs(spark, sf), tier1_scorer(), tier2_scorer(), THRESHOLD)
    d = telemetry.batch_ids(d, "id", BATCH)
    d = routing.batch_latency_modes(d)
    return d.select(F.col("id").alias("doc_id"), "batch_id", r6("tier1_latency").alias("tier1_latency"),
                    r6("tier2_latency").alias("tier2_latency"), r6("tier2_latency_batched").alias("tier2_latency_batched"))


# ---------------------------------------------------------------------------
# evaluation
# ---------------------------------------------------------------------------

def _eval_frame(spark, sf) -> DataFrame:
    """Long table (model, id, y, p) for tier 1, tier 2, fixed cascade."""
    s = pl.scored_both(spark, sf, pl.labelled_docs(spark, sf))
    esc = F.col("c1") < THRESHOLD
    return s.select("id", F.col("label").alias("y"), F.explode(F.array(
        F.struct(F.lit("tier1").alias("model"), F.col("p1").alias("p")),
        F.struct(F.lit("tier2").alias("model"), F.col("p2").alias("p")),
        F.struct(F.lit("cascade_fixed").alias("model"), F.when(esc, F.col("p2")).otherwise(F.col("p1")).alias("p")),
    )).alias("m")).select("id", "y", "m.model", "m.p")


EVAL_SRC = f"""SELECT 'tier1' AS model, l.quality AS y, p1 AS p FROM sc JOIN labels l ON l.doc_id = sc.id
UNION ALL SELECT 'tier2', l.quality, p2 FROM sc JOIN labels l ON l.doc_id = sc.id
UNION ALL SELECT 'cascade_fixed', l.quality, CASE WHEN c1 < {THRESHOLD} THEN p2 ELSE p1 END FROM sc JOIN labels l ON l.doc_id = sc.id"""


@register("eval_accuracy_f1", f"""WITH {SCORED_CTE}, {acc_f1_sql(EVAL_SRC, ['model'])}
SELECT acc.model, acc.n::BIGINT AS n, {S.r6('accuracy')} AS accuracy, {S.r6('f1_macro')} AS f1_macro FROM acc JOIN f1 USING (model)""")
def q_eval_accuracy_f1(spark, sf):
    """A1/A2: accuracy and macro F1 per model on the labelled documents."""
    m = metrics.accuracy_f1(_eval_frame(spark, sf), "y", "p", ["model"])
    return m.select("model", F.col("n").cast("long").alias("n"), r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"))


@register("classification_report", f"""WITH {SCORED_CTE}, {acc_f1_sql(EVAL_SRC, ['model'])},
prf AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS pr,
                  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS rc,
                  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f FROM pc)
SELECT model, CASE cls WHEN 0 THEN 'Negative' WHEN 1 THEN 'Positive' ELSE CAST(cls AS VARCHAR) END AS "row",
       {S.r6('pr')} AS "precision", {S.r6('rc')} AS recall, {S.r6('f')} AS f1, support::BIGINT AS support FROM prf
UNION ALL SELECT model, 'accuracy', NULL, NULL, {S.r6('sum(tp)::DOUBLE / sum(support)')}, sum(support)::BIGINT FROM prf GROUP BY model
UNION ALL SELECT model, 'macro avg', {S.r6('avg(pr)')}, {S.r6('avg(rc)')}, {S.r6('avg(f)')}, sum(support)::BIGINT FROM prf GROUP BY model
UNION ALL SELECT model, 'weighted avg', {S.r6('sum(pr * support) / sum(support)')}, {S.r6('sum(rc * support) / sum(support)')},
       {S.r6('sum(f * support) / sum(support)')}, sum(support)::BIGINT FROM prf GROUP BY model""")
def q_classification_report(spark, sf):
    """A3: per-class precision/recall/F1/support + accuracy, macro and weighted avg."""
    r = metrics.classification_report(_eval_frame(spark, sf), "y", "p", ["model"])
    return r.select("model", "row", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "support")


@register("threshold_sweep", f"""WITH {SCORED_CTE},
g AS (SELECT unnest({list(SWEEP_LIBRARY)}::DOUBLE[]) AS threshold),
x AS (SELECT g.threshold, l.quality AS y, CASE WHEN c1 < g.threshold THEN p2 ELSE p1 END AS p, c1 < g.threshold AS esc,
             tier1_latency + CASE WHEN c1 < g.threshold THEN tier2_cost ELSE 0.0 END AS lat
      FROM sc JOIN labels l ON l.doc_id = sc.id CROSS JOIN g),
{acc_f1_sql('SELECT threshold, y, p FROM x', ['threshold'])},
r AS (SELECT threshold, avg(lat) * 1000 AS lat_ms, avg(CASE WHEN esc THEN 1.0 ELSE 0.0 END) * 100 AS rate FROM x GROUP BY threshold)
SELECT threshold, round(accuracy, 4) AS accuracy, round(f1_macro, 4) AS f1_macro, round(lat_ms, 3) AS avg_latency_ms, round(rate, 1) AS tier2_rate_pct
FROM acc JOIN f1 USING (threshold) JOIN r USING (threshold)""")
def q_threshold_sweep(spark, sf):
    """Library sweep (8 thresholds); both tiers scored once; latency
    t1 + t2 for escalated rows; rounding 4/4/3/1."""
    return _sweep_df(spark, sf, SWEEP_LIBRARY, "router")


@register("threshold_sweep_weighted", f"""WITH {SCORED_CTE},
g AS (SELECT unnest({list(SWEEP_NOTEBOOK)}::DOUBLE[]) AS threshold),
x AS (SELECT g.threshold, l.quality AS y, CASE WHEN c1 < g.threshold THEN p2 ELSE p1 END AS p, c1 < g.threshold AS esc,
             tier1_latency, tier2_cost
      FROM sc JOIN labels l ON l.doc_id = sc.id CROSS JOIN g),
{acc_f1_sql('SELECT threshold, y, p FROM x', ['threshold'])},
r AS (SELECT threshold, avg(CASE WHEN esc THEN 1.0 ELSE 0.0 END) AS rr, avg(tier1_latency) * 1000 AS t1, avg(tier2_cost) * 1000 AS t2 FROM x GROUP BY threshold)
SELECT threshold, {S.r6('accuracy')} AS accuracy, {S.r6('f1_macro')} AS f1_macro, {S.r6('t1 * (1 - rr) + t2 * rr')} AS avg_latency_ms, {S.r6('rr * 100')} AS tier2_rate_pct
FROM acc JOIN f1 USING (threshold) JOIN r USING (threshold)""")
def q_threshold_sweep_weighted(spark, sf):
    """A10: notebook sweep (9 thresholds); latency = t1*(1-r) + t2*r."""
    return _sweep_df(spark, sf, SWEEP_NOTEBOOK, "weighted")


def _sweep_df(spark, sf, grid, mode: str) -> DataFrame:
    s = pl.scored_both(spark, sf, pl.labelled_docs(spark, sf))
    g = routing.threshold_grid(spark, grid)
    cm = routing.sweep(s, g)  # (threshold, y, p, n, n_esc, lat) - tiny
    pc = metrics.per_class(cm, ["threshold"])
    pc = pc.withColumn("f1", F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"),
                                                     2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    f1 = pc.groupBy("threshold").agg(F.avg("f1").alias("f1_macro"))
    tot = cm.groupBy("threshold").agg(
        F.sum("n").alias("_n"), F.sum("n_esc").alias("_e"), F.sum("lat").alias("_lat"),
        (F.sum("lat1") / F.sum("n")).alias("_t1"), (F.sum("lat2") / F.sum("n")).alias("_t2"),
        F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("_ok"))
    out = tot.join(f1, "threshold")
    acc = F.col("_ok") / F.col("_n")
    rate = F.col("_e") / F.col("_n")
    if mode == "router":
        return out.select("threshold", F.round(acc, 4).alias("accuracy"), F.round("f1_macro", 4).alias("f1_macro"),
                          F.round(F.col("_lat") / F.col("_n") * 1000, 3).alias("avg_latency_ms"),
                          F.round(rate * 100, 1).alias("tier2_rate_pct"))
    lat = (F.col("_t1") * (1 - rate) + F.col("_t2") * rate) * 1000
    return out.select("threshold", r6(acc).alias("accuracy"), r6("f1_macro").alias("f1_macro"),
                      r6(lat).alias("avg_latency_ms"), r6(rate * 100).alias("tier2_rate_pct"))


@register("confidence_summary", f"""WITH {SCORED_CTE}
SELECT count(*) AS n, {S.r6('avg(c1)')} AS mean_conf, count(*) FILTER (WHERE c1 < {THRESHOLD}) AS n_below,
       {S.r6(f'count(*) FILTER (WHERE c1 < {THRESHOLD})::DOUBLE / count(*)')} AS share_below FROM sc""")
def q_confidence_summary(spark, sf):
    """Mean tier-1 confidence, count and share below the threshold."""
    s = pl.scored(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c1")).alias("mean_conf"),
                 F.count_if(F.col("c1") < THRESHOLD).alias("n_below"),
                 r6(F.count_if(F.col("c1") < THRESHOLD) / F.count(F.lit(1))).alias("share_below"))


# ---------------------------------------------------------------------------
# telemetry (T1-T9), as-of (T7), dynamic routing
# ---------------------------------------------------------------------------

TEL_CTE = """tel AS (SELECT user_id AS device_id, ts, event_id AS reading_id, event_type,
       CASE WHEN event_type IN ('view', 'purchase') THEN 30.0::DOUBLE + value / 2.0 END AS gpu_temp_c,
       CASE WHEN event_type IN ('view', 'purchase') THEN k * 0.16::DOUBLE END AS vram_gb,
       value AS cpu_pct,
       CASE WHEN event_type IN ('error', 'signup') THEN 30.0::DOUBLE + value / 3.0 END AS sensor_temp,
       k * 0.128::DOUBLE AS ram_gb, 12.8::DOUBLE AS ram_total_gb, k * 0.02::DOUBLE AS swap_gb,
       CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS swap_total_gb
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""

HV1_CTE = f"""hv1 AS (SELECT device_id, ts, reading_id,
       CASE WHEN gpu_temp_c IS NOT NULL OR vram_gb IS NOT NULL THEN 'gpu' ELSE 'cpu' END AS mode,
       CASE WHEN gpu_temp_c IS NOT NULL OR vram_gb IS NOT NULL THEN CASE WHEN gpu_temp_c IS NULL OR vram_gb IS NULL THEN 0.5::DOUBLE ELSE {S.clip('gpu_temp_c / 85.0')} END
            ELSE coalesce({S.clip('sensor_temp / 75.0')}, {S.clip('cpu_pct / 100.0')}, 0.4) END AS t_norm,
       CASE WHEN gpu_temp_c IS NOT NULL OR vram_gb IS NOT NULL THEN CASE WHEN gpu_temp_c IS NULL OR vram_gb IS NULL THEN 0.5::DOUBLE ELSE {S.clip('vram_gb / 16.0')} END
            ELSE coalesce({S.clip('ram_gb / 12.8')}, 0.4) END AS mem_norm,
       CASE WHEN gpu_temp_c IS NOT NULL OR vram_gb IS NOT NULL THEN 85.0 ELSE 75.0 END::DOUBLE AS setpoint
FROM tel)"""

_CPU_READ = "(cpu_pct IS NOT NULL AND ram_gb IS NOT NULL AND ram_total_gb > 0 AND swap_total_gb IS NOT NULL)"
_GPU_READ = "(gpu_temp_c IS NOT NULL AND vram_gb IS NOT NULL)"

HV2_CTE = f"""hv2 AS (SELECT device_id, ts, reading_id,
       CASE WHEN {_CPU_READ} THEN {S.clip('cpu_pct / 100.0')} ELSE 0.0 END AS cpu_load_norm,
       CASE WHEN {_CPU_READ} THEN {S.clip('ram_gb / ram_total_gb')} ELSE 0.0 END AS ram_usage_norm,
       CASE WHEN {_CPU_READ} THEN coalesce({S.clip('sensor_temp / 90.0')}, 0.0) ELSE 0.0 END AS cpu_temp_norm,
       CASE WHEN {_CPU_READ} AND swap_total_gb > 0 THEN coalesce({S.clip('swap_gb / swap_total_gb')}, 0.0) ELSE 0.0 END AS swap_norm,
       CASE WHEN {_GPU_READ} THEN {S.clip('gpu_temp_c / 85.0')} ELSE 0.0 END AS gpu_temp_norm,
       CASE WHEN {_GPU_READ} THEN {S.clip('vram_gb / 16.0')} ELSE 0.0 END AS vram_usage_norm
FROM tel)"""


def pid_sql(src: str, key: str, tie: str, dt_floor: float) -> str:
    """PID over rows of ``src`` (key, t, tie, e, sec) with plain windows."""
    return f"""pq AS (SELECT *, lag(t) OVER w AS pt, lag(e) OVER w AS pe FROM ({src}) WINDOW w AS (PARTITION BY {key} ORDER BY t, {tie})),
pr AS (SELECT *, CASE WHEN pt IS NULL THEN {dt_floor!r}::DOUBLE ELSE greatest((t - pt)::DOUBLE / 1000000.0, {dt_floor!r}::DOUBLE) END AS dt FROM pq),
ps AS (SELECT *, sum(e * dt) OVER (PARTITION BY {key} ORDER BY t, {tie} ROWS UNBOUNDED PRECEDING) AS run FROM pr),
pid AS (SELECT *, greatest(-50.0::DOUBLE, least(50.0::DOUBLE, run)) AS integral,
               {S.clip(f"0.008::DOUBLE * e + 0.002::DOUBLE * greatest(-50.0::DOUBLE, least(50.0::DOUBLE, run)) + 0.004::DOUBLE * (e - coalesce(pe, 0.0)) / dt + sec")} AS phi FROM ps)"""


@register("health_v1", f"""WITH {TEL_CTE}, {HV1_CTE}
SELECT device_id, reading_id, mode, {S.r6('t_norm')} AS t_norm, {S.r6('mem_norm')} AS mem_norm, setpoint FROM hv1""")
def q_health_v1(spark, sf):
    """Two-element health vector and set-point per reading."""
    h = pl.readings_v1(spark, sf)
    return h.select("device_id", "reading_id", "mode", r6("t_norm").alias("t_norm"), r6("mem_norm").alias("mem_norm"), "setpoint")


V2_COLS = ["cpu_load_norm", "ram_usage_norm", "cpu_temp_norm", "swap_norm", "gpu_temp_norm", "vram_usage_norm"]


def _hv2(spark, sf):
    return telemetry.health_v2(telemetry.telemetry_from_events(read_table(spark, sf, "events")), CASCADE_V2)


@register("health_v2", f"""WITH {TEL_CTE}, {HV2_CTE}
SELECT device_id, reading_id, {', '.join(f"{S.r6(c)} AS {c}" for c in V2_COLS)} FROM hv2""")
def q_health_v2(spark, sf):
    """Six-element health vector per reading."""
    h = _hv2(spark, sf)
    return h.select("device_id", "reading_id", *[r6(c).alias(c) for c in V2_COLS])


@register("health_labeled", f"""WITH {TEL_CTE}, {HV2_CTE}
SELECT reading_id, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT reading_id, {', '.join(V2_COLS)} FROM hv2)
ON {', '.join(V2_COLS)} INTO NAME metric VALUE value)""")
def q_health_labeled(spark, sf):
    """T5: the labelled read {label: value}, one row per (reading, label)."""
    h = telemetry.health_labeled(_hv2(spark, sf))
    return h.select("reading_id", F.explode("health").alias("metric", "value")).withColumn("value", r6("value"))


@register("pid_v1", f"""WITH {TEL_CTE}, {HV1_CTE},
{pid_sql(f"SELECT device_id, reading_id, epoch_us(ts) AS t, t_norm * setpoint - setpoint AS e, 0.10::DOUBLE * mem_norm AS sec FROM hv1", 'device_id', 'reading_id', 1e-3)}
SELECT device_id, reading_id, {S.r6('integral')} AS integral, {S.r6('phi')} AS phi FROM pid""")
def q_pid_v1(spark, sf):
    """PID v1 per device over its readings (chunked scan, skew-safe)."""
    x = telemetry.pid(telemetry.pid_inputs_v1(pl.readings_v1(spark, sf), CASCADE_V1), CASCADE_V1)
    return x.select("device_id", "reading_id", r6("integral").alias("integral"), r6("phi").alias("phi"))


@register("pid_v2", f"""WITH {TEL_CTE}, {HV2_CTE},
{pid_sql(f'''SELECT device_id, reading_id, epoch_us(ts) AS t,
   CASE WHEN gpu_temp_norm > 0 THEN gpu_temp_norm * 85.0 - 85.0 ELSE cpu_load_norm * 90.0 - 90.0 END AS e,
   CASE WHEN gpu_temp_norm > 0 THEN 0.08 * vram_usage_norm + 0.04 * ram_usage_norm
        ELSE 0.08 * ram_usage_norm + 0.05 * swap_norm + 0.04 * cpu_temp_norm END AS sec FROM hv2''', 'device_id', 'reading_id', 1e-6)}
SELECT device_id, reading_id, {S.r6('integral')} AS integral, {S.r6('phi')} AS phi FROM pid""")
def q_pid_v2(spark, sf):
    """CPU-aware PID v2 (GPU when gpu_temp_norm > 0)."""
    x = telemetry.pid(telemetry.pid_inputs_v2(_hv2(spark, sf), CASCADE_V2), CASCADE_V2)
    return x.select("device_id", "reading_id", r6("integral").alias("integral"), r6("phi").alias("phi"))


@register("asof_telemetry", f"""WITH {TEL_CTE}, {HV1_CTE},
posts AS (SELECT d.doc_id AS id, e.user_id AS device_id, e.ts FROM documents d JOIN events e ON e.event_id = d.doc_id)
SELECT p.id AS doc_id, p.device_id, r.reading_id, {S.r6('r.t_norm')} AS t_norm, {S.r6('r.mem_norm')} AS mem_norm
FROM posts p ASOF LEFT JOIN hv1 r ON p.device_id = r.device_id AND p.ts > r.ts""")
def q_asof_telemetry(spark, sf):
    """Newest reading of the post's device strictly before the post."""
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("device_id"))
    posts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(ev, "id")
    x = telemetry.latest_reading(posts, pl.readings_v1(spark, sf), ["reading_id", "t_norm", "mem_norm"], strict=True)
    return x.select(F.col("id").alias("doc_id"), "device_id", "reading_id", r6("t_norm").alias("t_norm"), r6("mem_norm").alias("mem_norm"))


DYN_CTE = f"""{SCORED_CTE}, {H_CTE}, {TEL_CTE}, {HV1_CTE},
ctx AS (SELECT sc.*, e.ts, e.user_id AS device_id FROM sc JOIN events e ON e.event_id = sc.id),  -- the controller's steps: posts with an arrival
soc AS (SELECT doc_id AS id, {S.social_cols('doc_id')} FROM documents),
aso AS (SELECT ctx.*, r.t_norm, r.mem_norm, r.setpoint FROM ctx ASOF LEFT JOIN hv1 r ON ctx.device_id = r.device_id AND ctx.ts > r.ts),
pin AS (SELECT id, device_id, epoch_us(ts) AS t,
               coalesce(t_norm, 0.4) * coalesce(setpoint, 75.0) - coalesce(setpoint, 75.0) AS e,
               0.10::DOUBLE * coalesce(mem_norm, 0.4) AS sec FROM aso),
{pid_sql('SELECT * FROM pin', 'device_id', 'id', 1e-3)},
dyn AS (SELECT sc.id, sc.source, pid.device_id, coalesce(pid.phi, 0.0::DOUBLE) AS phi, {S.psi('retweet_count', 'follower_count', 'burst_rate_ppm', 'platform')} AS psi, hh.h,
               sc.p1, sc.c1, sc.p2, sc.c2
        FROM sc LEFT JOIN pid USING (id) JOIN soc USING (id) JOIN hh USING (id)),
dyn2 AS (SELECT *, {S.tau('phi', 'psi', 'h')} AS tau FROM dyn)"""


@register("route_dynamic", f"""WITH {DYN_CTE}
SELECT id AS doc_id, device_id, {S.r6('phi')} AS phi, {S.r6('psi')} AS psi, {S.r6('h')} AS h, {S.r6('tau')} AS tau,
       c1 < tau AS escalate, CASE WHEN c1 < tau THEN p2 ELSE p1 END AS prediction, CASE WHEN c1 < tau THEN 2 ELSE 1 END AS tier_used FROM dyn2""")
def q_route_dynamic(spark, sf):
    """As-of telemetry -> PID per device -> Psi, H -> tau -> route."""
    d = pl.dynamic_route(spark, sf)
    return d.select(F.col("id").alias("doc_id"), "device_id", r6("phi").alias("phi"), r6("psi").alias("psi"),
                    r6("h").alias("h"), r6("tau").alias("tau"), "escalate", "prediction", "tier_used")


@register("dynamic_route_summary", f"""WITH {DYN_CTE}
SELECT source, count(*) AS n, {S.r6('avg(CASE WHEN c1 < tau THEN 1.0 ELSE 0.0 END)')} AS tier2_rate, {S.r6('avg(tau)')} AS avg_tau,
       count(l.doc_id) AS n_labelled,
       {S.r6('avg(CASE WHEN l.doc_id IS NULL THEN NULL WHEN (CASE WHEN c1 < tau THEN p2 ELSE p1 END) = l.quality THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM dyn2 LEFT JOIN labels l ON l.doc_id = dyn2.id GROUP BY source""")
def q_dynamic_route_summary(spark, sf):
    """Flagship (J6): per product - rows, tier-2 rate, mean tau, accuracy on labelled rows."""
    d = pl.dynamic_route(spark, sf).join(pl.labelled(spark, sf), "id", "left")
    ok = F.when(F.col("label").isNull(), F.lit(None)).otherwise((F.col("prediction") == F.col("label")).cast("double"))
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("escalate").cast("double"))).alias("tier2_rate"),
        r6(F.avg("tau")).alias("avg_tau"), F.count("label").alias("n_labelled"), r6(F.avg(ok)).alias("accuracy"))


@register("escalation_delta", f"""WITH {DYN_CTE}
SELECT {S.r6(f'avg(CASE WHEN c1 < {THRESHOLD} THEN 1.0 ELSE 0.0 END)')} AS fixed_rate,
       {S.r6('avg(CASE WHEN c1 < tau THEN 1.0 ELSE 0.0 END)')} AS dynamic_rate,
       {S.r6(f'(avg(CASE WHEN c1 < tau THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN c1 < {THRESHOLD} THEN 1.0 ELSE 0.0 END)) * 100')} AS delta_pp FROM dyn2""")
def q_escalation_delta(spark, sf):
    """Dynamic minus fixed escalation rate, percentage points."""
    d = pl.dynamic_route(spark, sf)
    fixed = F.avg((F.col("c1") < THRESHOLD).cast("double"))
    dyn = F.avg(F.col("escalate").cast("double"))
    return d.agg(r6(fixed).alias("fixed_rate"), r6(dyn).alias("dynamic_rate"), r6((dyn - fixed) * 100).alias("delta_pp"))


@register("component_stats", f"""WITH {DYN_CTE},
u AS (UNPIVOT (SELECT phi AS Phi_physical, psi AS Psi_socio, h AS H_token, tau AS tau_dynamic FROM dyn2)
      ON Phi_physical, Psi_socio, H_token, tau_dynamic INTO NAME component VALUE v)
SELECT component, {S.r6('avg(v)')} AS mean, {S.r6('stddev_pop(v)')} AS std, {S.r6('min(v)')} AS min, {S.r6('max(v)')} AS max FROM u GROUP BY component""")
def q_component_stats(spark, sf):
    """Mean, population std, min, max of Phi, Psi, H, tau."""
    d = pl.dynamic_route(spark, sf)
    u = d.select(F.explode(F.array(
        F.struct(F.lit("Phi_physical").alias("component"), F.col("phi").alias("v")),
        F.struct(F.lit("Psi_socio").alias("component"), F.col("psi").alias("v")),
        F.struct(F.lit("H_token").alias("component"), F.col("h").alias("v")),
        F.struct(F.lit("tau_dynamic").alias("component"), F.col("tau").alias("v")))).alias("x")).select("x.*")
    return u.groupBy("component").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"),
                                      r6(F.min("v")).alias("min"), r6(F.max("v")).alias("max"))


@register("tau_histogram", f"""WITH {DYN_CTE},
u AS (UNPIVOT (SELECT tau AS tau_dynamic, psi AS psi_socio, h AS h_token FROM dyn2) ON tau_dynamic, psi_socio, h_token INTO NAME signal VALUE v),
m AS (SELECT signal, min(v) AS lo, max(v) AS hi FROM u GROUP BY signal)
SELECT signal, (CASE WHEN hi > lo THEN least(29, floor((v - lo) / (hi - lo) * 30)) ELSE 0 END)::INTEGER AS bin, count(*) AS n
FROM u JOIN m USING (signal) GROUP BY signal, bin""")
def q_tau_histogram(spark, sf):
    """30-bin histograms of tau, Psi and H (last bin closed)."""
    d = cut_lineage(pl.dynamic_route(spark, sf).select("tau", "psi", "h"))  # three numbers a post: the range and the bins both read them
    u = d.select(F.explode(F.array(
        F.struct(F.lit("tau_dynamic").alias("signal"), F.col("tau").alias("v")),
        F.struct(F.lit("psi_socio").alias("signal"), F.col("psi").alias("v")),
        F.struct(F.lit("h_token").alias("signal"), F.col("h").alias("v")))).alias("x")).select("x.*")
    return metrics.histogram(u, "v", 30, ["signal"]).select("signal", "bin", "n")


@register("model_comparison", f"""WITH {DYN_CTE},
src AS (SELECT 'tier1' AS model, l.quality AS y, p1 AS p, 0.0 AS esc FROM dyn2 JOIN labels l ON l.doc_id = dyn2.id
  UNION ALL SELECT 'tier2', l.quality, p2, 1.0 FROM dyn2 JOIN labels l ON l.doc_id = dyn2.id
  UNION ALL SELECT 'cascade_fixed', l.quality, CASE WHEN c1 < {THRESHOLD} THEN p2 ELSE p1 END, CASE WHEN c1 < {THRESHOLD} THEN 1.0 ELSE 0.0 END FROM dyn2 JOIN labels l ON l.doc_id = dyn2.id
  UNION ALL SELECT 'cascade_dynamic', l.quality, CASE WHEN c1 < tau THEN p2 ELSE p1 END, CASE WHEN c1 < tau THEN 1.0 ELSE 0.0 END FROM dyn2 JOIN labels l ON l.doc_id = dyn2.id),
{acc_f1_sql('SELECT model, y, p FROM src', ['model'])},
rr AS (SELECT model, avg(esc) AS rate FROM src GROUP BY model),
t AS (SELECT model, accuracy, f1_macro, rate FROM acc JOIN f1 USING (model) JOIN rr USING (model))
SELECT model, printf('%.4f', accuracy) AS accuracy, printf('%.4f', f1_macro) AS f1_macro, {S.r6('rate')} AS tier2_rate,
       accuracy = max(accuracy) OVER () AS best_accuracy, f1_macro = max(f1_macro) OVER () AS best_f1, rate = min(rate) OVER () AS best_rate FROM t""")
def q_model_comparison(spark, sf):
    """One row per model (union of results), formatted
    metrics and best-value flags.

    Text work is spent on labelled posts, once: labels are joined first, and
    tier 2 is scored once a row, as a model of its own and for the cascades
    alike. One aggregation by all outcomes leaves a handful of cells, which
    are laid out as one confusion table a model."""
    d = pl.dynamic_route(spark, sf, posts=pl.labelled_docs(spark, sf, stripped=True))
    d = tier2_scorer().with_scores(d.drop("p2", "c2"), pred_col="p2", conf_col="c2", text_col="stripped")
    cells = (d.select(F.col("label").alias("y"), "p1", "p2", (F.col("c1") < THRESHOLD).alias("fixed"), F.col("escalate").alias("dynamic"))
             .groupBy("y", "p1", "p2", "fixed", "dynamic").agg(F.count(F.lit(1)).alias("n")))
    model = lambda name, esc: F.struct(F.lit(name).alias("model"), F.when(esc, F.col("p2")).otherwise(F.col("p1")).alias("p"), esc.alias("esc"))
    each = F.explode(F.array(model("tier1", F.lit(False)), model("tier2", F.lit(True)), model("cascade_fixed", F.col("fixed")), model("cascade_dynamic", F.col("dynamic"))))
    cm = cut_lineage(cells.select("y", "n", each.alias("m")).groupBy("m.model", "y", "m.p").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("m.esc"), F.col("n")).otherwise(0)).alias("esc")))
    m = metrics.accuracy_f1_of(cm, ["model"])
    rr = cm.groupBy("model").agg((F.sum("esc") / F.sum("n")).alias("rate"))
    t = metrics.best_flags(m.join(rr, "model"), ["accuracy", "f1_macro"], ["rate"])
    return t.select("model", F.format_string("%.4f", "accuracy").alias("accuracy"),
                    F.format_string("%.4f", "f1_macro").alias("f1_macro"), r6("rate").alias("tier2_rate"),
                    F.col("best_accuracy"), F.col("best_f1_macro").alias("best_f1"), F.col("best_rate"))


# ---------------------------------------------------------------------------
# labels, sampling, splits
# ---------------------------------------------------------------------------

from ..operators import split as sp  # noqa: E402
from ..operators import features as ft  # noqa: E402
from ..operators import term_blocks as tb  # noqa: E402
from ..operators.scoring import autodetect_label_map, remap_predictions  # noqa: E402

SAMPLE_N = 500
SEED = 42


@register("polarity_binarise", "SELECT doc_id, quality * 4 AS polarity, (quality * 4 = 4)::INTEGER AS label FROM labels")
def q_polarity_binarise(spark, sf):
    """Polarity {0,4} -> label {0,1} (labels.quality stands in for polarity/4)."""
    l = read_table(spark, sf, "labels").select("doc_id", (F.col("quality") * 4).alias("polarity"))
    return sp.polarity_binarise(l)


@register("label_binarise", "SELECT vec_id, label % 3 AS label3, CASE WHEN label % 3 = 2 THEN 1 ELSE 0 END AS label "
          "FROM embeddings WHERE label % 3 IN (0, 2)")
def q_label_binarise(spark, sf):
    """Three-class labels (embeddings.label % 3): keep 0/2, 2 -> 1."""
    e = read_table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("label3"))
    return sp.three_class_binarise(e.withColumn("label", F.col("label3")), "label")


# Fixed parameter table: output label names of some typical classifier heads.
# Output names by model, one per logit of an embedding (64).
N_LOGITS = 64
LABEL_HEADS = [
    ("numbered", [f"LABEL_{i}" for i in range(N_LOGITS)]),
    ("signed", [f"{'positive' if i % 2 else 'NEG'} {i}" for i in range(N_LOGITS)]),
    ("plain", [f"class {i}" for i in range(N_LOGITS)]),
]
#: Explicit entries (model, id, class) that win over the detected ones.
LABEL_OVERRIDES = [("plain", 3, 1), ("plain", 5, 1), ("signed", 1, 0)]
_HEADS_SQL = ", ".join(f"('{m}', {i}, '{n}')" for m, names in LABEL_HEADS for i, n in enumerate(names))


@register("label_map_autodetect", f"""WITH heads(model, idx, name) AS (VALUES {_HEADS_SQL}),
lm AS (SELECT model, idx, CASE WHEN lower(name) LIKE '%neg%' OR lower(name) IN ('label_0', '0', 'false') THEN 0
                       WHEN lower(name) LIKE '%pos%' OR lower(name) IN ('label_1', '1', 'true') THEN 1
                       WHEN idx = min(idx) OVER (PARTITION BY model) THEN 0 ELSE 1 END AS mapped FROM heads),
ov AS (SELECT * FROM (VALUES ('plain', 3, 1), ('plain', 5, 1), ('signed', 1, 0)) o(model, idx, mapped)),
raw AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS raw_pred FROM embeddings)
SELECT lm.model, raw.vec_id, raw.raw_pred::INTEGER AS raw_pred, coalesce(ov.mapped, lm.mapped)::INTEGER AS prediction
FROM raw JOIN lm ON lm.idx = raw.raw_pred LEFT JOIN ov ON ov.model = lm.model AND ov.idx = lm.idx""")
def q_label_map_autodetect(spark, sf):
    """Autodetected id->{0,1} maps, with overrides, applied to the argmax
    over all logits (embeddings as logits; every model reads the same)."""
    heads = spark.createDataFrame([(m, i, n) for m, names in LABEL_HEADS for i, n in enumerate(names)],
                                  "model string, idx int, name string")
    override = spark.createDataFrame(LABEL_OVERRIDES, "model string, idx int, mapped int")
    raw = read_table(spark, sf, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).cast("int").alias("raw_pred"))
    out = remap_predictions(raw, autodetect_label_map(heads), override)
    return out.select("model", "vec_id", "raw_pred", "prediction")


@register("sample_exact", f"""SELECT doc_id, sample_rank FROM (SELECT doc_id,
  row_number() OVER (ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS sample_rank FROM documents) WHERE sample_rank <= {SAMPLE_N}""")
def q_sample_exact(spark, sf):
    """Exact-n seeded sample without replacement (the cap is the operator)."""
    d = read_table(spark, sf, "documents").select("doc_id")
    return sp.sample_exact(d, SAMPLE_N, SEED, "doc_id")


SPLIT_SQL = f"""sp AS (SELECT doc_id, label, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
         count(*) OVER (PARTITION BY quality) AS n FROM labels l JOIN documents d USING (doc_id)))"""


def _split(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    l = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return sp.split_stratified(d.join(l, "doc_id"), "label", 0.2, SEED, "doc_id")


@register("split_stratified", f"WITH {SPLIT_SQL} SELECT doc_id, label, split FROM sp")
def q_split_stratified(spark, sf):
    """Stratified 80/20 split, exact per-class sizes."""
    return _split(spark, sf).select("doc_id", "label", "split")


@register("split_summary", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, {S.r6('avg(label)')} AS pos_ratio FROM sp GROUP BY split")
def q_split_summary(spark, sf):
    """Split sizes and positive ratio."""
    return sp.split_summary(_split(spark, sf)).withColumn("pos_ratio", r6("pos_ratio"))


# ---------------------------------------------------------------------------
# vectoriser features (M1-M4)
# ---------------------------------------------------------------------------

TERMS_CTE = f"""{DOCS_CTE},
atk AS (SELECT id, regexp_extract_all(strip_accents(lower(clean)), '[\\p{{L}}\\p{{N}}_]+') AS u FROM docs),
tm AS (SELECT id, unnest(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))) AS term FROM atk),
tc AS (SELECT id, term, count(*) AS c FROM tm GROUP BY id, term),
vocab AS (SELECT term, count(*) AS df, sum(c) AS tf FROM tc GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 50000)"""


@register("ngrams", f"""WITH {DOCS_CTE},
atk AS (SELECT id, regexp_extract_all(strip_accents(lower(clean)), '[\\p{{L}}\\p{{N}}_]+') AS u FROM docs)
SELECT id AS doc_id, len(u)::BIGINT AS n_unigrams, greatest(len(u) - 1, 0)::BIGINT AS n_bigrams FROM atk""")
def q_ngrams(spark, sf):
    """M1/M2: word tokens (accents stripped, \\w+) and bi-gram counts per document."""
    from ..operators.scoring import bigrams
    d = pl.docs(spark, sf)
    t = F.filter(F.split(F.col("clean"), "[^a-z0-9]+"), lambda x: x != F.lit(""))  # word runs of cleaned text
    return d.select(F.col("id").alias("doc_id"), F.size(t).cast("long").alias("n_unigrams"),
                    F.size(bigrams(t)).cast("long").alias("n_bigrams"))


@register("vocabulary", f"WITH {TERMS_CTE} SELECT term, df::BIGINT AS df, tf::BIGINT AS tf FROM vocab")
def q_vocabulary(spark, sf):
    """M3: min_df = 2, and its own cap: the 50,000 most frequent terms (ties by term)."""
    tc = ft.term_counts(pl.docs(spark, sf))
    v = ft.vocabulary(tc, max_features=50_000)
    return v.select("term", F.col("df").cast("long").alias("df"), F.col("tf").cast("long").alias("tf"))


TERMS_ALL_CTE = TERMS_CTE.replace(" ORDER BY tf DESC, term LIMIT 50000", "")


@register("tfidf_weights", f"""WITH {TERMS_ALL_CTE},
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
w AS (SELECT tc.id, tc.term, (1 + ln(tc.c)) * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w FROM tc JOIN vocab v USING (term) CROSS JOIN nd),
nrm AS (SELECT id, sqrt(sum(w * w)) AS nr FROM w GROUP BY id)
SELECT id AS doc_id, term, {S.r6('w / nr')} AS weight FROM w JOIN nrm USING (id)""")
def q_tfidf_weights(spark, sf):
    """M4: sublinear tf x smoothed idf (+1), L2 row norm, vocabulary terms only."""
    d = pl.docs(spark, sf, stripped=True).select("id", "stripped")  # its runs of [a-z0-9] are those of the cleaned text
    n, size = read_table(spark, sf, "documents").agg(F.count(F.lit(1)).cast("double"), F.sum(F.octet_length("text"))).first()
    tc = tb.term_blocks(d, tb.blocks_for(size), "stripped")
    w = tb.tfidf(tc, tb.vocabulary(tc), n)
    return w.select(F.col("id").alias("doc_id"), "term", r6("weight").alias("weight"))


# ---------------------------------------------------------------------------
# latency and router statistics (A4-A8, W1, W2), from events as batch timings
# ---------------------------------------------------------------------------

LAT_BATCH = 64

BATCH_LAT_SQL = f"""bl AS (SELECT event_type AS model, (rk - 1) // {LAT_BATCH} AS batch_idx, count(*) AS n, sum(value) / 1000.0 AS elapsed_s
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rk FROM events) GROUP BY model, batch_idx)"""


def _batch_latency(spark, sf):
    """(model, batch_idx, n, elapsed_s): events of a type in id order form
    that model's batches of 64 calls; value = ms per call."""
    e = read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), "value")
    b = scan.exact_rank(e, ["model"], F.floor(F.col("event_id") / F.lit(1 << 16)).cast("long"), ["event_id"], out="_rk")
    b = b.withColumn("batch_idx", F.floor((F.col("_rk") - 1) / LAT_BATCH).cast("long"))
    return b.groupBy("model", "batch_idx").agg(F.count(F.lit(1)).alias("n"), (F.sum("value") / 1000.0).alias("elapsed_s"))


@register("latency_warmup", f"""WITH {BATCH_LAT_SQL},
g AS (SELECT model, sum(CASE WHEN batch_idx >= 1 THEN elapsed_s END) AS e, sum(CASE WHEN batch_idx >= 1 THEN n END) AS k,
             sum(elapsed_s) AS total_time_s, sum(n) AS rows FROM bl GROUP BY model)
SELECT model, {S.r6('coalesce(e / k, total_time_s / greatest(rows, 1)) * 1000')} AS avg_latency_ms, {S.r6('total_time_s')} AS total_time_s, rows::BIGINT AS rows FROM g""")
def q_latency_warmup(spark, sf):
    """Mean ms per row with the first batch dropped, total time."""
    l = metrics.latency_after_warmup(_batch_latency(spark, sf), ["model"], warmup=1)
    return l.select("model", r6("avg_latency_ms").alias("avg_latency_ms"), r6("total_time_s").alias("total_time_s"), "rows")


@register("batch_latency_spread", f"""WITH {BATCH_LAT_SQL}
SELECT model, batch_idx::BIGINT AS batch_idx, n::BIGINT AS n, {S.r6('elapsed_s / n')} AS per_row_s FROM bl""")
def q_batch_latency_spread(spark, sf):
    """A batch's elapsed time spread evenly over its rows."""
    b = _batch_latency(spark, sf)
    return b.select("model", "batch_idx", F.col("n").cast("long").alias("n"), r6(F.col("elapsed_s") / F.col("n")).alias("per_row_s"))


@register("router_stats", f"""WITH {SCORED_CTE},
d AS (SELECT c1 < {THRESHOLD} AS esc, tier1_latency AS l1, CASE WHEN c1 < {THRESHOLD} THEN tier2_cost ELSE 0.0 END AS l2 FROM sc)
SELECT count(*) AS total_samples, count(*) FILTER (WHERE NOT esc) AS tier1_count, count(*) FILTER (WHERE esc) AS tier2_count,
       {S.r6('sum(l1 + l2)')} AS total_latency, {S.r6('sum(l1)')} AS tier1_total_lat, {S.r6('sum(l2)')} AS tier2_total_lat,
       {S.r6('count(*) FILTER (WHERE esc)::DOUBLE / greatest(count(*), 1)')} AS tier2_rate, {S.r6('sum(l1 + l2) / greatest(count(*), 1)')} AS avg_latency FROM d""")
def q_router_stats(spark, sf):
    """Router statistics of the fixed cascade."""
    d = routing.route_fixed(pl.docs(spark, sf), tier1_scorer(), tier2_scorer(), THRESHOLD)
    s = metrics.router_stats(d)
    return s.select("total_samples", "tier1_count", "tier2_count", *[r6(c).alias(c) for c in
                    ["total_latency", "tier1_total_lat", "tier2_total_lat", "tier2_rate", "avg_latency"]])


@register("global_stats", f"""WITH {SCORED_CTE},
d AS (SELECT source, id // {BATCH} AS batch_id, c1 < {THRESHOLD} AS esc, tier1_latency + CASE WHEN c1 < {THRESHOLD} THEN tier2_cost ELSE 0.0 END AS lat FROM sc),
b AS (SELECT source, batch_id, count(*) AS n, count(*) FILTER (WHERE esc) AS n2, sum(lat) AS lat FROM d GROUP BY source, batch_id)
SELECT source AS run_id, count(*) AS n_calls, sum(n)::BIGINT AS total_samples, sum(n2)::BIGINT AS tier2_count,
       {S.r6('sum(n2)::DOUBLE / greatest(sum(n), 1)')} AS tier2_rate, {S.r6('sum(lat) / greatest(sum(n), 1)')} AS avg_latency FROM b GROUP BY source""")
def q_global_stats(spark, sf):
    """Per-call stats rows merged additively into run totals (a run per product)."""
    d = routing.route_fixed(pl.docs(spark, sf), tier1_scorer(), tier2_scorer(), THRESHOLD)
    per_call = metrics.router_stats(d.withColumn("batch_id", F.floor(F.col("id") / BATCH)), ["source", "batch_id"])
    g = per_call.groupBy(F.col("source").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("total_samples").cast("long").alias("total_samples"),
        F.sum("tier2_count").cast("long").alias("tier2_count"), F.sum("total_latency").alias("_lat"))
    n = F.greatest(F.col("total_samples"), F.lit(1))
    return g.select("run_id", "n_calls", "total_samples", "tier2_count", r6(F.col("tier2_count") / n).alias("tier2_rate"),
                    r6(F.col("_lat") / n).alias("avg_latency"))


# ---------------------------------------------------------------------------
# burst rate (R1), sessions and context log
# ---------------------------------------------------------------------------

@register("burst_rate_batch", """SELECT event_id, event_type AS topic,
  count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch_us(ts) / 1000000)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS burst_rate_ppm FROM events""")
def q_burst_rate_batch(spark, sf):
    """Posts per minute of the post's topic (trailing 60 whole seconds,
    ties included), pre-aggregated per second and bucketed per minute."""
    e = read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("topic"),
                                               F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("sec"))
    r = scan.trailing_count(e, "topic", "sec", 60, out="burst_rate_ppm")
    return r.select("event_id", "topic", "burst_rate_ppm")


@register("session_latest", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS status,
  count(*) AS n_sessions FROM events GROUP BY user_id""")
def q_session_latest(spark, sf):
    """The events appended to a session store in three parts, then
    the latest session of each user by the store, and how many it holds."""
    store = _appended(spark, sf, "sessions", ["user_id", "ts", "event_id", F.col("event_type").alias("status")])
    counts = store.all().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"))
    return store.latest("user_id", "ts").join(counts, "user_id").select("user_id", "event_id", "ts", "status", "n_sessions")


def _appended(spark, sf, name, columns, cleared_first: bool = False):
    """A context log that the events were appended to in three parts by time (and with ``cleared_first`` cleared behind the first)."""
    from ..sources.sinks import ContextLog
    import os
    import uuid
    store = ContextLog(spark, os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}"))
    e = read_table(spark, sf, "events")
    for i in range(3):
        store.append(e.where(F.pmod(F.dayofyear("ts"), F.lit(3)) == i).select(*columns))
        if cleared_first and i == 0:
            store.clear()
    return store


@register("session_clear", """SELECT user_id, count(*) AS n_sessions, max(event_id) AS last_event FROM events WHERE dayofyear(ts) % 3 <> 0 GROUP BY user_id""")
def q_session_clear(spark, sf):
    """A store cleared behind its first append holds what was appended since."""
    store = _appended(spark, sf, "cleared", ["user_id", "ts", "event_id"], cleared_first=True)
    return store.all().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("event_id").alias("last_event"))


CONTEXT_N = 10


@register("context_last_n", f"""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= {CONTEXT_N}""")
def q_context_last_n(spark, sf):
    """The last n context records of each user, from a context log that
    was appended to in three parts; two-phase top-k (per user-day, then per
    user) so a hot user is not ranked in one task."""
    log = _appended(spark, sf, "context", ["user_id", "event_id", "ts", "event_type"])
    return log.last_n_by("user_id", CONTEXT_N, [F.col("ts").desc(), F.col("event_id").desc()], F.to_date("ts"))


# ---------------------------------------------------------------------------
# product-sentiment layer
# ---------------------------------------------------------------------------

from ..operators import social as so  # noqa: E402
from ..operators.topk import topk_per_group  # noqa: E402

LEX_SQL = (f"CASE WHEN {S.tok_u('lex:', 't')} < {so.LEX_RATE} THEN round(8.0::DOUBLE * {S.tok_u('val:', 't')} - 4.0::DOUBLE, 1) "
           f"ELSE 0.0::DOUBLE END")


def compound_sql(tok: str) -> str:
    s = f"coalesce(list_sum(list_transform({tok}, lambda t: {LEX_SQL})), 0.0::DOUBLE)"
    return f"({s} / sqrt({s} * {s} + 15.0::DOUBLE))"


BUCKET_SQL = """CASE WHEN compound >= 0.6 THEN 'Ultra Positive' WHEN compound >= 0.15 THEN 'Positive' WHEN compound > -0.15 THEN 'Neutral'
     WHEN compound > -0.6 THEN 'Negative' ELSE 'Ultra Negative' END"""

TAG_CTE = f"""{SCORED_CTE},
ctx AS (SELECT sc.*, e.ts, e.user_id AS device_id, e.event_type AS topic FROM sc LEFT JOIN events e ON e.event_id = sc.id),
soc AS (SELECT doc_id AS id, {S.social_cols('doc_id')} FROM documents),
tg AS (SELECT id, source AS product, lang AS community, device_id, topic, ts, CAST(ts AS DATE) AS date, p1, c1, p2,
              CASE WHEN c1 < {THRESHOLD} THEN p2 ELSE p1 END AS prediction, {compound_sql('tok')} AS compound, follower_count
       FROM ctx JOIN soc USING (id)),
tg2 AS (SELECT *, CASE WHEN prediction = 1 THEN 'positive' ELSE 'negative' END AS sentiment, {BUCKET_SQL} AS spectrum_bucket,
               (compound + 1.0) * 5.0 AS score10,
               CASE WHEN follower_count >= 100000 THEN 'influencer' WHEN follower_count >= 10000 THEN 'creator' ELSE 'regular' END AS demographic,
               CASE WHEN c1 < {so.COMPLEX_CONF} THEN 'COMPLEX' WHEN compound >= 0.15 THEN 'POSITIVE' WHEN compound <= -0.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS intent
        FROM tg),
tagged AS (SELECT *, CASE WHEN intent = 'COMPLEX' THEN CASE WHEN p2 <> p1 THEN 'SARCASM' ELSE 'LITERAL' END END AS sarcasm FROM tg2)"""


def _tagged(spark, sf) -> DataFrame:
    """One tagged row per post."""
    s = routing.route_fixed(pl.docs(spark, sf, stripped=True), tier1_scorer(), tier2_scorer(), THRESHOLD, text="stripped")
    s = so.with_stand_in_compound(s, text_col="stripped").drop("stripped", "tokens", "clean")
    s = pl.with_social(pl.with_arrival(spark, sf, s))  # behind the text work, so that no text is shuffled for it
    s = s.withColumn("intent", so.intent("c1", "compound"))  # COMPLEX rows are escalated: tier 2 is there
    return (s.withColumn("product", F.col("source")).withColumn("community", F.col("lang"))
             .withColumn("date", F.to_date("ts"))
             .withColumn("sentiment", F.when(F.col("prediction") == 1, "positive").otherwise("negative"))
             .withColumn("spectrum_bucket", so.spectrum_bucket("compound"))
             .withColumn("score10", so.score10("compound"))
             .withColumn("demographic", so.demographic("follower_count"))
             .withColumn("sarcasm", F.when(F.col("intent") == "COMPLEX",
                                           F.when(F.col("p2") != F.col("p1"), "SARCASM").otherwise("LITERAL"))))


def _conv_scored(spark, sf):
    c = spread(read_table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", clean_text("text").alias("clean"))
    c = c.withColumn("tokens", word_tokens("clean"))
    lex = so.stand_in_lexicon(c)
    return so.lexicon_polarity(c, lex, ["conv_id", "turn"])


CONV_CTE = f"""cv AS (SELECT conv_id, turn, {S.tokens(S.clean('text'))} AS tok FROM conversations),
cs AS (SELECT conv_id, turn, {compound_sql('tok')} AS compound FROM cv)"""


@register("lexicon_polarity", f"WITH {CONV_CTE} SELECT conv_id, turn, {S.r6('compound')} AS compound FROM cs")
def q_lexicon_polarity(spark, sf):
    """Lexicon compound score per message (lexicon table join)."""
    return _conv_scored(spark, sf).select("conv_id", "turn", r6("compound").alias("compound"))


@register("spectrum_buckets", f"""WITH {CONV_CTE}
SELECT {BUCKET_SQL} AS spectrum_bucket, count(*) AS n, {S.r6('avg((compound + 1.0) * 5.0)')} AS avg_score10 FROM cs GROUP BY 1""")
def q_spectrum_buckets(spark, sf):
    """Messages per spectrum bucket with the 0-10 score."""
    c = _conv_scored(spark, sf)
    return c.groupBy(so.spectrum_bucket("compound").alias("spectrum_bucket")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(so.score10("compound"))).alias("avg_score10"))


@register("tagged_rows", f"""WITH {TAG_CTE}
SELECT id AS doc_id, product, sentiment, community, demographic, {S.r6('compound')} AS spectrum_score, spectrum_bucket, date FROM tagged""")
def q_tagged_rows(spark, sf):
    """Message -> tagged row."""
    t = _tagged(spark, sf)
    return t.select(F.col("id").alias("doc_id"), "product", "sentiment", "community", "demographic",
                    r6("compound").alias("spectrum_score"), "spectrum_bucket", "date")


@register("intent_route", f"""WITH {TAG_CTE}
SELECT id AS doc_id, intent, sarcasm, CASE WHEN sarcasm = 'SARCASM' THEN 'heavy' WHEN sarcasm = 'LITERAL' THEN 'light' ELSE 'fast' END AS path FROM tagged""")
def q_intent_route(spark, sf):
    """POSITIVE/NEGATIVE/NEUTRAL -> fast path; COMPLEX -> sarcasm check
    (tier 2 evaluated only for COMPLEX rows) -> heavy or light."""
    t = _tagged(spark, sf)
    path = F.when(F.col("sarcasm") == "SARCASM", "heavy").when(F.col("sarcasm") == "LITERAL", "light").otherwise("fast")
    return t.select(F.col("id").alias("doc_id"), "intent", "sarcasm", path.alias("path"))


_RULES_SQL = ", ".join(f"('{k}', '{c}')" for k, c in so.COMMUNITY_RULES)


@register("community_tag", f"""WITH {DOCS_CTE}, rules(token, community) AS (VALUES {_RULES_SQL}),
h AS (SELECT id, community, count(*) AS hits FROM (SELECT id, unnest(tok) AS token FROM dt) JOIN rules USING (token) GROUP BY id, community),
b AS (SELECT id, arg_min(community, (-hits, community)) AS community, max(hits) AS hits FROM h GROUP BY id)
SELECT dt.id AS doc_id, coalesce(b.community, 'general') AS community, coalesce(b.hits, 0)::BIGINT AS hits FROM dt LEFT JOIN b USING (id)""")
def q_community_tag(spark, sf):
    """Best-matching community from a keyword rules table."""
    rules = spark.createDataFrame(so.COMMUNITY_RULES, "token string, community string")
    d = so.community_tag(pl.docs(spark, sf), rules)
    return d.select(F.col("id").alias("doc_id"), "community", "hits")


@register("sentiment_stats", f"""WITH {TAG_CTE}
SELECT product, count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sarcasm = 'SARCASM' AND p2 = 1) AS sarcastic_to_positive, count(*) FILTER (WHERE sarcasm = 'SARCASM' AND p2 = 0) AS sarcastic_to_negative
FROM tagged GROUP BY product""")
def q_sentiment_stats(spark, sf):
    """Per product totals, positive/negative, sarcastic re-labels."""
    t = _tagged(spark, sf).withColumn("_p2", F.col("p2"))  # tier 2 only ran on COMPLEX rows
    sar = F.col("sarcasm") == "SARCASM"
    return t.groupBy("product").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count_if(sar & (F.col("_p2") == 1)).alias("sarcastic_to_positive"),
        F.count_if(sar & (F.col("_p2") == 0)).alias("sarcastic_to_negative"))


@register("demographics", f"""WITH {TAG_CTE}
SELECT demographic, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER ()) AS INTEGER) AS pct FROM tagged GROUP BY demographic""")
def q_demographics(spark, sf):
    """Counts and integer percentages per demographic label."""
    g = _tagged(spark, sf).groupBy("demographic").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).cast("int"))


@register("clusters", f"""WITH {TAG_CTE}
SELECT community, count(DISTINCT device_id) AS users, count(*) AS posts FROM tagged GROUP BY community""")
def q_clusters(spark, sf):
    """Users and posts per community cluster."""
    t = _tagged(spark, sf)
    return t.groupBy("community").agg(F.countDistinct("device_id").alias("users"), F.count(F.lit(1)).alias("posts"))


@register("daily_timeline", f"""WITH {TAG_CTE}
SELECT date, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS total
FROM tagged GROUP BY date""")
def q_daily_timeline(spark, sf):
    """Date -> positive, negative, total."""
    t = _tagged(spark, sf)
    return t.groupBy("date").agg(F.count_if(F.col("sentiment") == "positive").alias("positive"),
                                 F.count_if(F.col("sentiment") == "negative").alias("negative"),
                                 F.count(F.lit(1)).alias("total"))


@register("brand_sentiment", f"""WITH {TAG_CTE}
SELECT product, {S.r6('avg(score10)')} AS score, {S.r6("100.0 * avg(CASE WHEN sentiment = 'positive' THEN 1.0 ELSE 0.0 END)")} AS positive_pct FROM tagged GROUP BY product""")
def q_brand_sentiment(spark, sf):
    """0-10 score and positive share per product."""
    t = _tagged(spark, sf)
    return t.groupBy("product").agg(r6(F.avg("score10")).alias("score"),
                                    r6(100.0 * F.avg((F.col("sentiment") == "positive").cast("double"))).alias("positive_pct"))


@register("share_of_voice", f"""WITH {TAG_CTE}
SELECT product, count(*) AS mentions, {S.r6('100.0 * count(*) / sum(count(*)) OVER ()')} AS share_pct FROM tagged GROUP BY product""")
def q_share_of_voice(spark, sf):
    """Mentions per product as a share of all mentions."""
    g = _tagged(spark, sf).groupBy("product").agg(F.count(F.lit(1)).alias("mentions"))
    return g.withColumn("share_pct", r6(100.0 * F.col("mentions") / F.sum("mentions").over(Window.partitionBy(F.lit(1)))))


@register("mentions", f"""WITH {TAG_CTE}
SELECT count(*) AS total_mentions, count(l.doc_id) AS n_labelled,
       {S.r6('100.0 * avg(CASE WHEN l.doc_id IS NULL THEN NULL WHEN prediction = l.quality THEN 1.0 ELSE 0.0 END)')} AS accuracy_pct
FROM tagged LEFT JOIN labels l ON l.doc_id = tagged.id""")
def q_mentions(spark, sf):
    """Total mentions and accuracy % of the routed sentiment on labelled posts."""
    t = _tagged(spark, sf).join(pl.labelled(spark, sf), "id", "left")
    ok = F.when(F.col("label").isNull(), F.lit(None)).otherwise((F.col("prediction") == F.col("label")).cast("double"))
    return t.agg(F.count(F.lit(1)).alias("total_mentions"), F.count("label").alias("n_labelled"),
                 r6(100.0 * F.avg(ok)).alias("accuracy_pct"))


@register("history_summary", f"""WITH {TAG_CTE},
ses AS (SELECT product, date, avg(score10) AS score FROM tagged GROUP BY product, date)
SELECT count(*) AS n_analyses, {S.r6('avg(score)')} AS avg_score FROM ses""")
def q_history_summary(spark, sf):
    """An analysis = one (product, day); number of analyses and mean score."""
    ses = _tagged(spark, sf).groupBy("product", "date").agg(F.avg("score10").alias("score"))
    return ses.agg(F.count(F.lit(1)).alias("n_analyses"), r6(F.avg("score")).alias("avg_score"))


@register("trend_growth", f"""WITH {TAG_CTE},
d AS (SELECT topic, date, count(*) AS discussions, avg(CASE WHEN sentiment = 'positive' THEN 1.0 ELSE 0.0 END) AS pos FROM tagged GROUP BY topic, date)
SELECT topic, date, discussions, {S.r6('100.0 * pos')} AS positive_pct,
       {S.r6('100.0 * (discussions - lag(discussions) OVER (PARTITION BY topic ORDER BY date)) / lag(discussions) OVER (PARTITION BY topic ORDER BY date)')} AS growth_pct FROM d""")
def q_trend_growth(spark, sf):
    """Per topic and day - discussions, positive %, growth vs the previous day."""
    d = _tagged(spark, sf).groupBy("topic", "date").agg(
        F.count(F.lit(1)).alias("discussions"), F.avg((F.col("sentiment") == "positive").cast("double")).alias("pos"))
    prev = F.lag("discussions").over(Window.partitionBy("topic").orderBy("date"))
    return d.select("topic", "date", "discussions", r6(100.0 * F.col("pos")).alias("positive_pct"),
                    r6(100.0 * (F.col("discussions") - prev) / prev).alias("growth_pct"))


TARGET = "src0"
MAX_COMPETITORS = 4

RANK_SQL = f"""m AS (SELECT product, count(*) AS mentions, avg(score10) AS score FROM tagged GROUP BY product),
rk AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, product) AS r FROM m WHERE product <> '{TARGET}')"""


def _product_rank(spark, sf):
    m = _tagged(spark, sf).groupBy("product").agg(F.count(F.lit(1)).alias("mentions"), F.avg("score10").alias("score"))
    # one row per product: a small table, ranking it needs no partitioning
    r = m.filter(F.col("product") != TARGET).withColumn(
        "r", F.row_number().over(Window.orderBy(F.col("mentions").desc(), F.col("product"))))
    return m, r


@register("max_competitors", f"""WITH {TAG_CTE}, {RANK_SQL}
SELECT product, mentions, r::BIGINT AS competitor_rank FROM rk WHERE r <= {MAX_COMPETITORS}""")
def q_max_competitors(spark, sf):
    """K3: at most 4 competitors, by mentions (ties by name)."""
    _, r = _product_rank(spark, sf)
    return r.filter(F.col("r") <= MAX_COMPETITORS).select("product", "mentions", F.col("r").cast("long").alias("competitor_rank"))


@register("competitor_compare", f"""WITH {TAG_CTE}, {RANK_SQL},
sel AS (SELECT product, mentions, score, TRUE AS is_target FROM m WHERE product = '{TARGET}'
        UNION ALL SELECT product, mentions, score, FALSE FROM rk WHERE r <= {MAX_COMPETITORS})
SELECT product, is_target, mentions, {S.r6('score')} AS score,
       {S.r6(f"score - max(CASE WHEN is_target THEN score END) OVER ()")} AS score_vs_target FROM sel""")
def q_competitor_compare(spark, sf):
    """Target and up to 4 competitors side by side, score relative to the target."""
    m, r = _product_rank(spark, sf)
    sel = m.filter(F.col("product") == TARGET).withColumn("is_target", F.lit(True)).unionByName(
        r.filter(F.col("r") <= MAX_COMPETITORS).drop("r").withColumn("is_target", F.lit(False)))
    tgt = F.max(F.when(F.col("is_target"), F.col("score"))).over(Window.partitionBy(F.lit(1)))
    return sel.select("product", "is_target", "mentions", r6("score").alias("score"), r6(F.col("score") - tgt).alias("score_vs_target"))


POSTS_PER_PRODUCT = 10


@register("topk_per_product", f"""WITH {TAG_CTE}
SELECT product, id AS doc_id, rn::BIGINT AS post_rank FROM (SELECT product, id, row_number() OVER (PARTITION BY product ORDER BY abs(compound) DESC, id) AS rn FROM tagged)
WHERE rn <= {POSTS_PER_PRODUCT}""")
def q_topk_per_product(spark, sf):
    """K2: the 10 strongest posts per product (two-phase top-k, skew-safe)."""
    t = _tagged(spark, sf).select("product", "id", "compound")
    k = topk_per_group(t, ["product"], [F.abs(F.col("compound")).desc(), F.col("id")], POSTS_PER_PRODUCT,
                       chunk=F.pmod(F.xxhash64("id"), F.lit(64)), out_rank="post_rank")
    return k.select("product", F.col("id").alias("doc_id"), F.col("post_rank").cast("long").alias("post_rank"))


KEYWORDS_K = 20


@register("keywords", f"""WITH {DOCS_CTE},
c AS (SELECT t AS term, count(*) AS n FROM (SELECT unnest(list_filter(tok, lambda t: NOT list_contains({_SW_SQL}, t))) AS t FROM dt) GROUP BY t
      ORDER BY n DESC, term LIMIT {KEYWORDS_K})
SELECT term, n, {S.r6('CASE WHEN max(n) OVER () > min(n) OVER () THEN (n - min(n) OVER ())::DOUBLE / (max(n) OVER () - min(n) OVER ()) ELSE 1.0 END')} AS weight FROM c""")
def q_keywords(spark, sf):
    """K4: top-20 terms without stop words, weight = min-max scaled count."""
    d = pl.docs(spark, sf)
    c = d.select(F.explode(remove_stopwords(F.col("tokens"), STOPWORDS)).alias("term")).groupBy("term") \
         .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("term")).limit(KEYWORDS_K)
    w = Window.partitionBy(F.lit(1))
    lo, hi = F.min("n").over(w), F.max("n").over(w)
    return c.select("term", "n", r6(F.when(hi > lo, (F.col("n") - lo) / (hi - lo)).otherwise(F.lit(1.0))).alias("weight"))


@register("notable_posts", f"""WITH {TAG_CTE}
SELECT id AS doc_id, product, {S.r6('compound')} AS spectrum_score FROM tagged ORDER BY abs(compound) DESC, id LIMIT 3""")
def q_notable_posts(spark, sf):
    """K5: the three posts with the strongest sentiment."""
    t = _tagged(spark, sf)
    return t.orderBy(F.abs("compound").desc(), F.col("id")).limit(3).select(
        F.col("id").alias("doc_id"), "product", r6("compound").alias("spectrum_score"))


# ---------------------------------------------------------------------------
# dedup (U2, U3), sources and sinks (S1, S5-S9), Python scorers (M5, M8),
# ablation (X10)
# ---------------------------------------------------------------------------

import hashlib as _hashlib  # noqa: E402
import math as _math  # noqa: E402
import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from ..operators import dedup as dd  # noqa: E402
from ..operators.scoring import TIER1_PRESET, TIER2_PRESET, PandasBatchScorer, lr_gradient_norms, lr_predict, train_lr  # noqa: E402
from ..sources import readers as rd  # noqa: E402
from ..sources import sinks as sk  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return _os.path.join(base, f"{name}-{_uuid.uuid4().hex}")


@register("dedup_exact", f"WITH {DOCS_CTE} SELECT min(id) AS doc_id, count(*) AS n_copies FROM docs GROUP BY md5(clean)")
def q_dedup_exact(spark, sf):
    """Exact duplicates of the cleaned text; survivor = lowest id."""
    d = dd.dedup_exact(pl.docs(spark, sf))
    return d.select(F.col("id").alias("doc_id"), "n_copies")


@register("dedup_near", f"""WITH {DOCS_CTE},
sh AS (SELECT DISTINCT id, unnest(CASE WHEN len(tok) = 0 THEN []::VARCHAR[] WHEN len(tok) < 3 THEN [array_to_string(tok, ' ')]
         ELSE list_transform(range(1, len(tok) - 1), lambda i: tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2]) END) AS g FROM dt),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
k AS (SELECT a.id, b.id AS lower_id, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND b.id < a.id GROUP BY a.id, b.id),
j AS (SELECT k.id, k.lower_id, k::DOUBLE / (x.n + y.n - k) AS sim FROM k JOIN n x ON x.id = k.id JOIN n y ON y.id = k.lower_id WHERE k::DOUBLE / (x.n + y.n - k) >= 0.7),
b AS (SELECT id, min(lower_id) AS dup_of, arg_min(sim, lower_id) AS sim FROM j GROUP BY id)
SELECT dt.id AS doc_id, b.id IS NOT NULL AS is_near_duplicate, b.dup_of, {S.r6('b.sim')} AS similarity FROM dt LEFT JOIN b USING (id)""")
def q_dedup_near(spark, sf):
    """Exact Jaccard near duplicates of a lower id."""
    d = dd.dedup_near(pl.docs(spark, sf))
    return d.select(F.col("id").alias("doc_id"), "is_near_duplicate", "dup_of", r6("similarity").alias("similarity"))


CONTAM_N = 5


def _ngrams_sql(tok: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({tok}) - {n - 2}), lambda i: array_to_string(list_slice({tok}, i, i + {n - 1}), ' ')))"


@register("benchmark_contamination", f"""WITH {DOCS_CTE},
bt AS (SELECT item_id, {S.tokens(S.clean('text'))} AS tok FROM benchmark),
ish AS (SELECT item_id, unnest({_ngrams_sql('tok', CONTAM_N)}) AS sh FROM bt),
isz AS (SELECT item_id, count(*) AS n_sh FROM ish GROUP BY item_id),
dsh AS (SELECT id AS doc_id, unnest({_ngrams_sql('tok', CONTAM_N)}) AS sh FROM dt),
hits AS (SELECT doc_id, item_id, count(*) AS n_hit FROM dsh JOIN ish USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, {S.r6('n_hit::DOUBLE / n_sh')} AS containment FROM hits JOIN isz USING (item_id) WHERE n_hit::DOUBLE / n_sh >= 0.8""")
def q_benchmark_contamination(spark, sf):
    """U3 across tables: documents that contain a benchmark passage (share
    of the item's distinct word 5-grams found in the document >= 0.8)."""
    docs = pl.docs(spark, sf).select(F.col("id").alias("doc_id"), "tokens")
    items = read_table(spark, sf, "benchmark").select("item_id", word_tokens(clean_text("text")).alias("tokens"))
    c = dd.contamination(docs, items, n=CONTAM_N, min_containment=0.8)
    return c.select("doc_id", "item_id", r6("containment").alias("containment"))


@register("polarity_csv_roundtrip", """SELECT d.doc_id, l.quality * 4 AS polarity, (l.quality = 1)::INTEGER AS label, coalesce(d.text, '') AS text
FROM documents d JOIN labels l USING (doc_id)""")
def q_polarity_csv_roundtrip(spark, sf):
    """S7 + S1 + P3: write the labelled documents' raw texts as a headerless
    6-column latin-1 CSV (quotes doubled) into the shared scratch folder, read
    it back."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    six = d.select((F.col("quality") * 4).alias("polarity"), F.col("doc_id").cast("string").alias("c1"),
                   F.lit("NO_DATE").alias("c2"), F.lit("NO_QUERY").alias("c3"), F.col("source").alias("c4"),
                   F.coalesce("text", F.lit("")).alias("text"))
    path = _scratch(spark, "polarity-csv")
    sk.write_csv(six, path, header=False, encoding="ISO-8859-1")
    back = rd.read_polarity_csv(spark, path)
    return back.select(F.col("id").alias("doc_id"), "polarity", "label", F.coalesce("text", F.lit("")).alias("text"))


def _content_split_sql(rows: str, keep: str) -> str:
    """The split of rows (text, label) whose ids come from the order of their content."""
    return f"""WITH r AS ({rows}),
i AS (SELECT text, label, row_number() OVER (ORDER BY md5(text || chr(1) || label::VARCHAR), text) - 1 AS id FROM r),
k AS ({keep}),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || id::VARCHAR), id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM k)
SELECT md5(text) AS text_md5, label::INTEGER AS label, CASE WHEN rk <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows FROM s GROUP BY ALL"""


def _content_split(spark, rows, source: str, name: str):
    path = _scratch(spark, name)
    rows.repartition(7).write.parquet(path)
    return (rd.get_data(spark, source, path, seed=SEED).groupBy(F.md5("text").alias("text_md5"), "label", "split")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("labelled_text_split", _content_split_sql(
    "SELECT coalesce(d.text, '') AS text, l.quality AS label FROM documents d JOIN labels l USING (doc_id)", "SELECT * FROM i"))
def q_labelled_text_split(spark, sf):
    """S2 + S4: labelled texts without ids, from several files, through the dispatcher."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    return _content_split(spark, d.select(F.coalesce("text", F.lit("")).alias("sentence"), F.col("quality").alias("label")), "sst2", "labelled-text")


@register("three_class_split", _content_split_sql(
    "SELECT coalesce(d.text, '') AS text, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS label FROM documents d JOIN labels l USING (doc_id)",
    "SELECT text, CASE WHEN label = 2 THEN 1 ELSE 0 END AS label, id FROM i WHERE label IN (0, 2)"))
def q_three_class_split(spark, sf):
    """S3 + S4: three classes to two, neutral dropped, through the dispatcher."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    three = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return _content_split(spark, d.select(F.coalesce("text", F.lit("")).alias("text"), three.alias("label")), "tweet_eval", "three-class")


@register("wide_csv_unpivot", f"""WITH {DOCS_CTE}
SELECT source AS product, (row_number() OVER (PARTITION BY source ORDER BY id) - 1)::BIGINT AS row_idx,
       source = (SELECT min(source) FROM docs) AS is_target, clean AS message FROM docs""")
def q_wide_csv_unpivot(spark, sf):
    """A CSV with products as columns (first column = target), written
    from the documents, read back -> long rows."""
    d = pl.docs(spark, sf).select("id", "source", "clean")
    r = scan.exact_rank(d, ["source"], F.floor(F.col("id") / F.lit(1 << 16)).cast("long"), ["id"], out="_rk")
    r = r.withColumn("row_idx", (F.col("_rk") - 1).cast("long"))
    wide = r.groupBy("row_idx").pivot("source").agg(F.first("clean"))  # products in order
    path = _scratch(spark, "wide-csv")
    sk.write_csv(wide, path, null_value="\\N")
    long = rd.read_wide_csv(spark, path, ["row_idx"], null_value="\\N")
    return long.select("product", F.col("row_idx").cast("long").alias("row_idx"), "is_target", "message")


@register("scrape_flatten", """SELECT conv_id, CASE WHEN role = 'user' THEN 'conv' || conv_id ELSE role END AS product,
  role = 'user' AS is_target, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INTEGER AS post_idx, text AS post FROM conversations""")
def q_scrape_flatten(spark, sf):
    """Nested scrape results (one per conversation: the user turns are the
    target's posts, other roles are competitors) -> JSON -> flattened rows."""
    c = read_table(spark, sf, "conversations")
    per_role = c.groupBy("conv_id", "role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("posts"))
    nested = per_role.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("posts"))).alias("tposts"),
        F.map_from_entries(F.collect_list(F.when(F.col("role") != "user", F.struct(
            F.col("role"), F.struct(F.col("posts").alias("posts")))))).alias("competitors"))
    js = nested.select("conv_id", F.to_json(F.struct(
        F.struct(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("name"),
                 F.coalesce("tposts", F.array().cast("array<string>")).alias("posts")).alias("target"),
        F.col("competitors"))).alias("json"))
    return rd.flatten_scrape(js, "json", ["conv_id"]).select("conv_id", "product", "is_target", "post_idx", "post")


def _payloads(spark, sf):
    target = read_table(spark, sf, "documents").agg(F.min("source")).first()[0]  # the first product, as in the wide table
    return sk.build_payload(_tagged(spark, sf), target)


@register("payload_json", f"""WITH {TAG_CTE},
c AS (SELECT product, demographic, spectrum_bucket, coalesce(strftime(date, '%Y-%m-%d'), 'unknown') AS day, sentiment, sarcasm FROM tagged),
m AS (SELECT product,
   (SELECT map_from_entries(list((k, n) ORDER BY k)) FROM (SELECT demographic AS k, count(*) AS n FROM c x WHERE x.product = p.product GROUP BY k)) AS demographics,
   (SELECT map_from_entries(list((k, n) ORDER BY k)) FROM (SELECT spectrum_bucket AS k, count(*) AS n FROM c x WHERE x.product = p.product GROUP BY k)) AS spectrum,
   (SELECT map_from_entries(list((k, v) ORDER BY k)) FROM (SELECT day AS k, {{'positive': count(*) FILTER (WHERE sentiment = 'positive'),
      'negative': count(*) FILTER (WHERE sentiment = 'negative'), 'total': count(*)}} AS v FROM c x WHERE x.product = p.product GROUP BY k)) AS daily
   FROM (SELECT DISTINCT product FROM c) p),
t AS (SELECT product, count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
   count(*) FILTER (WHERE sarcasm = 'SARCASM') AS sarcastic, count(*) FILTER (WHERE sarcasm = 'SARCASM' AND sentiment = 'positive') AS sp,
   count(*) FILTER (WHERE sarcasm = 'SARCASM' AND sentiment = 'negative') AS sn FROM c GROUP BY product)
SELECT product, to_json({{'_target_product': (SELECT min(source) FROM documents),
   'stats': {{'total': total, 'positive': positive, 'negative': negative, 'sarcastic': sarcastic, 'sarcastic_to_positive': sp, 'sarcastic_to_negative': sn,
             'demographics': demographics, 'sentiment_spectrum': spectrum}}, 'daily_timeline': daily}})::VARCHAR AS payload FROM t JOIN m USING (product)""")
def q_payload_json(spark, sf):
    """One JSON payload per product, keys in order."""
    return _payloads(spark, sf)


@register("payload_validate", f"""WITH {DOCS_CTE}
SELECT DISTINCT source AS product, 'accepted' AS status, 'original' AS variant FROM docs
UNION ALL SELECT DISTINCT source, 'rejected', 'truncated' FROM docs
UNION ALL SELECT DISTINCT source, 'rejected', 'missing_key' FROM docs""")
def q_payload_validate(spark, sf):
    """Payloads and two broken variants of each (truncated JSON, missing
    required key) -> accepted / rejected."""
    broken = {"original": F.col("payload"), "truncated": F.expr("substring(payload, 1, length(payload) - 2)"),
              "missing_key": F.regexp_replace("payload", '"stats":', '"statz":')}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("payload")) for k, v in broken.items()]))
    variants = _payloads(spark, sf).select("product", each.alias("v")).select("product", "v.variant", "v.payload")
    return sk.validate_payload(variants).select("product", "status", "variant")


def _py_tier1_factory():
    return _py_model("t1:", 1)


def _py_tier2_factory():
    return _py_model("t2:", 2)


def _py_model(key: str, ngrams: int):
    def predict(texts):
        preds, confs = [], []
        for t in texts:
            toks = [x for x in t.split(" ") if x]
            if ngrams == 2:
                toks = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
            s = 0.0
            for x in toks:
                s += 2.0 * (int(_hashlib.md5((key + x).encode()).hexdigest()[:8], 16) / 4294967296.0) - 1.0
            p = 1.0 / (1.0 + _math.exp(-(s / _math.sqrt(len(toks))))) if toks else 0.5
            preds.append(1 if p > 0.5 else 0)
            confs.append(max(p, 1.0 - p))
        return preds, confs
    return predict


@register("udf_batched_score", f"""WITH {SCORED_CTE}
SELECT id AS doc_id, p1 AS prediction, {S.r6('c1')} AS confidence FROM sc""")
def q_udf_batched_score(spark, sf):
    """M6/M8: a Python model through Arrow batches (mapInPandas, batch 32,
    model built once per worker). The callable re-implements the tier-1
    stand-in in plain Python, so the oracle is the same SQL formula."""
    scorer = PandasBatchScorer("py_tier1", _py_tier1_factory, batch_size=TIER1_PRESET.batch_size)
    s = scorer.score(pl.docs(spark, sf).select("id", "clean"), text_col="clean")
    return s.select(F.col("id").alias("doc_id"), F.col("pred").alias("prediction"), r6("conf").alias("confidence"))


@register("route_fixed_python", ORACLE["route_fixed"])
def q_route_fixed_python(spark, sf):
    """The fixed cascade over Python models with the tiers' batch
    sizes; only escalated rows reach the second."""
    one = PandasBatchScorer("py_tier1", _py_tier1_factory, batch_size=TIER1_PRESET.batch_size)
    two = PandasBatchScorer("py_tier2", _py_tier2_factory, batch_size=TIER2_PRESET.batch_size)
    d = routing.route_fixed_frames(pl.docs(spark, sf).select("id", "clean"), lambda x: one.score(x, "clean"), lambda x: two.score(x, "clean"), THRESHOLD)
    return d.select(F.col("id").alias("doc_id"), "escalate", "prediction", r6("confidence").alias("confidence"), "tier_used",
                    routing.tier_label("escalate").alias("tier"))


#: Steps of the oracle's solver: 300 leave less than 1e-11 of a probability to go at sf0.01.
LR_STEPS = 300

LR_SQL = f"""WITH RECURSIVE {DOCS_CTE}, {SPLIT_SQL},
gold AS MATERIALIZED (SELECT docs.id, sp.label, sp.split, regexp_extract_all(strip_accents(lower(clean)), '[\\p{{L}}\\p{{N}}_]+') AS u FROM docs JOIN sp ON sp.doc_id = docs.id),
tm AS (SELECT id, split, unnest(list_concat(u, list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))) AS term FROM gold),
tc AS MATERIALIZED (SELECT id, split, term, count(*) AS c FROM tm GROUP BY id, split, term),
vocab AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) AS j, count(*) AS df FROM tc WHERE split = 'train' GROUP BY term HAVING count(*) >= 2),
nd AS (SELECT count(*)::DOUBLE AS n FROM gold WHERE split = 'train'),
wt AS (SELECT tc.id, tc.split, v.j, (1 + ln(tc.c)) * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w FROM tc JOIN vocab v USING (term) CROSS JOIN nd),
-- rows of the design matrix; column 0 is the intercept
x AS MATERIALIZED (SELECT id, split, j, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM wt UNION ALL SELECT id, split, 0, 1.0 FROM gold),
tx AS MATERIALIZED (SELECT x.id, j, x, label FROM x JOIN gold USING (id) WHERE x.split = 'train'),
-- accelerated gradient steps on sum of log loss + |w|^2 / 2; 1 + n / 2 bounds the curvature
fit AS (SELECT 0 AS k, j, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (SELECT 0 AS j UNION ALL SELECT j FROM vocab)
  UNION ALL
  (WITH m AS (SELECT tx.id, any_value(label) AS y, sum(x * v) AS m FROM tx JOIN fit USING (j) GROUP BY tx.id),
   r AS (SELECT id, 1.0 / (1.0 + exp(-m)) - y AS r FROM m),
   g AS (SELECT j, sum(x * r) AS g FROM tx JOIN r USING (id) GROUP BY j),
   s AS (SELECT k, j, w, v - (g + CASE WHEN j > 0 THEN v ELSE 0.0 END) / (1 + 0.5 * n) AS nw FROM fit JOIN g USING (j) CROSS JOIN nd WHERE k < {LR_STEPS})
   SELECT k + 1, j, nw, nw + (sqrt(1 + 0.5 * n) - 1) / (sqrt(1 + 0.5 * n) + 1) * (nw - w) FROM s CROSS JOIN nd)),
p AS (SELECT x.id, 1.0 / (1.0 + exp(-sum(x * w))) AS p FROM x JOIN fit USING (j) WHERE x.split = 'test' AND fit.k = {LR_STEPS} GROUP BY x.id)"""


@register("lr_train_predict", f"""{LR_SQL}
SELECT id AS doc_id, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, round(greatest(p, 1.0 - p), 3) AS confidence FROM p""")
def q_lr_train_predict(spark, sf):
    """M1-M5, M7: M4's weights of the train split, logistic regression on
    them, its (term, weight) table joined to the test split. The oracle
    solves the same penalised problem by gradient steps of its own; the fit,
    which stops where the loss no longer falls in double precision, is within
    2e-7 of it, so the confidence is given to three decimals."""
    model, s = _baseline(spark, sf, tol=1e-13)
    out = lr_predict(model, s.filter("split = 'test'"))
    return out.select(F.col("id").alias("doc_id"), F.col("pred").alias("prediction"), F.round("conf", 3).alias("confidence"))


def _baseline(spark, sf, tol: float = 1e-6):
    """The model, and the labelled posts (id, label, clean, split) as a checkpoint. The split is
    taken over keys; copies of a key, in the order of their texts, take its places in turn."""
    copy = lambda order: F.row_number().over(Window.partitionBy("id", "label").orderBy(order))
    d = pl.labelled_docs(spark, sf, stripped=True).select("id", "label", F.col("stripped").alias("clean")).withColumn("_copy", copy("clean"))  # the same terms lie in it
    keys = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(pl.labelled(spark, sf), "id")
    keys = sp.split_stratified(keys, "label", 0.2, SEED, "id").withColumn("_copy", copy("split"))
    s = settle(d.join(keys, ["id", "label", "_copy"]).drop("_copy"))
    return train_lr(s.filter("split = 'train'"), "clean", "label", tol=tol, settled=True), s


@register("lr_gradient", """WITH l AS (SELECT quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality)
SELECT sum(n - round(n * 0.2))::BIGINT AS n_train, TRUE AS optimal FROM l""")
def q_lr_gradient(spark, sf):
    """M5: is the fit at its optimum? The gradient of the penalised loss at
    the (term, weight) table, one component a term, by joins over the train
    split; optimal if its norm is below 1e-3 of the one at zero weights."""
    model, s = _baseline(spark, sf)
    return lr_gradient_norms(model, s.filter("split = 'train'"), "label", settled=True).select("n_train", (F.col("at_fit") <= 1e-3 * F.col("at_zero")).alias("optimal"))


# Fixed parameter table of ablation variants: name, tau_min, tau_max,
# sign of the token-entropy term.
ABLATION = [("v1", 0.50, 0.92, 1.0), ("documented_sign", 0.50, 0.92, -1.0), ("narrow_bounds", 0.60, 0.90, 1.0)]


def _h_cte(name: str, tok: str) -> str:
    return f"""{name}c AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest({tok}) AS t FROM dt) GROUP BY id, t),
{name}n AS (SELECT id, len({tok}) AS n FROM dt),
{name}s AS (SELECT {name}c.id, sum((c::DOUBLE / n) * ln(c::DOUBLE / n + 1e-12)) AS s FROM {name}c JOIN {name}n USING (id) GROUP BY {name}c.id),
{name} AS (SELECT {name}n.id, CASE WHEN {name}n.n > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, -{name}s.s / ln(30522 + 1e-12))) ELSE 0.0::DOUBLE END AS h
       FROM {name}n LEFT JOIN {name}s USING (id))"""


_ABL_SQL = ", ".join(f"('{n}', {a}, {b}, {s})" for n, a, b, s in ABLATION)


@register("config_ablation", f"""WITH {SCORED_CTE}, {_h_cte('hf', 'tok')},
soc AS (SELECT doc_id AS id, {S.social_cols('doc_id')} FROM documents),
v(variant, tau_min, tau_max, sgn) AS (VALUES {_ABL_SQL}),
x AS (SELECT v.variant, sc.c1, v.tau_min, v.tau_max,
             0.0 * (1 - {S.psi('retweet_count', 'follower_count', 'burst_rate_ppm', 'platform')}) + v.sgn * hf.h AS z
      FROM sc JOIN soc USING (id) JOIN hf USING (id) CROSS JOIN v),
y AS (SELECT variant, c1, greatest(tau_min, least(tau_max, 1.0 / (1.0 + exp(-z)) * (tau_max - tau_min) + tau_min)) AS tau FROM x)
SELECT variant, count(*) AS n, {S.r6('avg(tau)')} AS avg_tau, {S.r6('avg(CASE WHEN c1 < tau THEN 1.0 ELSE 0.0 END)')} AS tier2_rate FROM y GROUP BY variant""")
def q_config_ablation(spark, sf):
    """Parameter variants (phi = 0). Entropy and scores are computed once
    per row; each variant is a pair of sums of the same aggregation, unpivoted
    from the one row that is left."""
    from ..functions.signals import h_token, psi_socio
    s = pl.with_social(pl.scored(spark, sf))
    s = s.select("c1", psi_socio("retweet_count", "follower_count", "burst_rate_ppm", "platform").alias("psi"), h_token("tokens").alias("h"))
    aggs = []
    for name, lo, hi, sgn in ABLATION:
        z = F.lit(0.0) * (1 - F.col("psi")) + F.lit(sgn) * F.col("h")
        tau = F.greatest(F.lit(lo), F.least(F.lit(hi), F.lit(1.0) / (1 + F.exp(-z)) * (hi - lo) + F.lit(lo)))
        aggs += [F.avg(tau).alias(f"{name}_tau"), F.avg((F.col("c1") < tau).cast("double")).alias(f"{name}_rate")]
    one = s.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(v[0]).alias("variant"), F.col(f"{v[0]}_tau").alias("t"), F.col(f"{v[0]}_rate").alias("r")) for v in ABLATION])
    return one.select("n", F.explode(rows).alias("v")).select("v.variant", "n", r6("v.t").alias("avg_tau"), r6("v.r").alias("tier2_rate"))


# ---------------------------------------------------------------------------
# streaming (R2-R7, S13): drained with availableNow; results equal the batch SQL
# ---------------------------------------------------------------------------

from ..streaming import stream as st  # noqa: E402


def _events_path(sf):
    return _os.path.join(sf, "events*.parquet")


@register("stream_burst", """SELECT epoch(time_bucket(INTERVAL '1 minute', ts))::BIGINT AS window_start, event_type AS topic, count(*) AS n
FROM events GROUP BY 1, 2""")
def q_stream_burst(spark, sf):
    """R2: per-topic posts per 1-minute tumbling window (watermark 10 min)."""
    return st.drain(st.burst_tumbling(st.events_stream(spark, _events_path(sf))), "burst", ["window_start", "topic"])


@register("stream_burst_sliding", """WITH m AS (SELECT DISTINCT epoch(time_bucket(INTERVAL '1 minute', ts))::BIGINT - k * 60 AS window_start, event_type AS topic
  FROM events, range(0, 5) r(k))
SELECT m.window_start, m.topic, round(count(*) / 5.0, 6) AS rate_ppm FROM m JOIN events e ON e.event_type = m.topic
  AND epoch(e.ts) >= m.window_start AND epoch(e.ts) < m.window_start + 300 GROUP BY 1, 2""")
def q_stream_burst_sliding(spark, sf):
    """R2: 5-minute windows sliding by 1 minute, rate = count / 5."""
    s = st.burst_sliding(st.events_stream(spark, _events_path(sf)))
    out = st.drain(s, "burst-sliding", ["window_start", "topic"])
    return out.withColumn("rate_ppm", r6("rate_ppm"))


@register("stream_timeline", """SELECT CAST(ts AS DATE) AS day, event_type AS topic, count(*) AS n, round(sum(value), 6) AS value_sum FROM events GROUP BY 1, 2""")
def q_stream_timeline(spark, sf):
    """Daily counts per topic from a 1-day event-time window."""
    return st.drain(st.daily_timeline(st.events_stream(spark, _events_path(sf))), "timeline", ["day", "topic"])


@register("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def q_stream_dedup(spark, sf):
    """The events delivered twice (two files) are deduplicated by id
    within the watermark."""
    src = _scratch(spark, "redelivery")
    ev = read_table(spark, sf, "events")
    ev.write.mode("overwrite").parquet(_os.path.join(src, "first"))
    ev.write.mode("overwrite").parquet(_os.path.join(src, "again"))
    s = st.events_stream(spark, _os.path.join(src, "*"))
    out = st.drain(st.dedup_redelivery(s).select("event_id", "user_id", "event_type"), "dedup", [], mode="append")
    return out


def _with_late(sql: str) -> str:
    head, tail = sql.rsplit("SELECT device_id, reading_id, ", 1)
    return head + "SELECT device_id, reading_id, FALSE AS late, " + tail


@register("stream_pid", _with_late(ORACLE["pid_v1"]))
def q_stream_pid(spark, sf):
    """Stateful PID per device (transformWithState); equals pid_v1
    when the readings arrive in order."""
    s = st.pid_stream(st.events_stream(spark, _events_path(sf)))
    out = st.drain(s, "pid", [], mode="append")
    return out.select("device_id", "reading_id", "late", r6("integral").alias("integral"), r6("phi").alias("phi"))


@register("stream_route", ORACLE["route_fixed"])
def q_stream_route(spark, sf):
    """Streaming fixed cascade; tier 2 runs inside foreachBatch on
    the escalated subset only. Posts come in lots of files, as many files as
    a lot has a micro-batch; the stream is stopped behind the second, and
    started again from its checkpoint when the others are there."""
    src, base = _scratch(spark, "post-files"), _scratch(spark, "route")
    posts = read_table(spark, sf, "documents")

    def deliver(lots):
        for i in lots:
            posts.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == i).write.parquet(_os.path.join(src, str(i)))
        files = spark.read.schema(st.DOCUMENTS_SCHEMA).parquet(*[_os.path.join(src, str(i)) for i in lots]).inputFiles()
        return max(1, -(-len(files) // len(lots)))

    def run(files):
        return st.drain(st.posts_stream(spark, _os.path.join(src, "*"), max_files=files), "route", [], mode="append", batch_fn=st.route_batch(THRESHOLD), base=base)
    run(deliver([0, 1]))
    out = run(deliver([2, 3]))
    return out.select(F.col("id").alias("doc_id"), "escalate", "prediction", r6("confidence").alias("confidence"),
                      "tier_used", "tier")


LIVE_LATENESS = 6 * 3600


def _live_inputs(spark, sf, docs_late, events_held, files: int, lots: int = 3) -> str:
    """Two file streams as the live cascade reads them: posts with the time they
    were seen at (half a minute or less before their event) and events, in
    ``lots`` lots by time, then the posts of ``docs_late``, then heartbeats;
    a lot has as many ``files`` as a micro-batch reads. Each lot is made from the tables
    and its shuffles go with it, so that no copy of all texts lies beside the lots."""
    base = _scratch(spark, "live-input")
    ev = read_table(spark, sf, "events")
    at = ev.select(F.col("event_id").alias("doc_id"), "ts").hint("shuffle_hash")  # texts needn't be sorted to meet their time
    seen = F.coalesce("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'")) - F.expr("make_dt_interval(0, 0, 0, pmod(doc_id, 30))")
    posts = read_table(spark, sf, "documents").join(at, "doc_id", "left").withColumn("seen", seen).select([f.name for f in st.POSTS_SCHEMA])
    second = F.unix_seconds(F.col("seen").cast("timestamp"))
    cuts = posts.select(second.cast("double").alias("s")).approxQuantile("s", [i / lots for i in range(1, lots)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    held = ev.where(~events_held)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        for name, df, t in (("posts", posts.where(~docs_late), second), ("events", held, F.unix_seconds(F.col("ts").cast("timestamp")))):
            part = df if lo is None else df.where(t >= lo)
            with shuffles_go(spark):
                st.in_files(part if hi is None else part.where(t < hi), files).write.option("compression", "zstd").parquet(_os.path.join(base, name, f"{i}"))
    with shuffles_go(spark):
        st.in_files(posts.where(docs_late), files).write.option("compression", "zstd").parquet(_os.path.join(base, "posts", f"{len(edges)}"))
    end = F.expr("timestamp_ntz'2100-01-01 00:00:00'")
    for name, like, t in (("posts", posts, "seen"), ("events", ev, "ts")):
        beat = [(end if f.name == t else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema]
        spark.range(1).select(beat).write.parquet(_os.path.join(base, name, f"{len(edges) + 1}"))
    return base


def _live(spark, sf, docs_late, events_held):
    files = spark.sparkContext.defaultParallelism
    base = _live_inputs(spark, sf, docs_late, events_held, files)
    out = st.live_route(spark, _os.path.join(base, "posts", "*"), _os.path.join(base, "events", "*"), pl.decide, lateness_seconds=LIVE_LATENESS, max_files=files,
                        groups=8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select(F.col("id").alias("doc_id"), "device_id", r6("phi").alias("phi"), r6("psi").alias("psi"), r6("h").alias("h"), r6("tau").alias("tau"),
                      "escalate", "prediction", "tier_used", "late")


@register("stream_route_dynamic", ORACLE["route_dynamic"])
def q_stream_route_dynamic(spark, sf):
    """The dynamic cascade on streams of posts and of events, several
    micro-batches of each: posts are scored when they come, matched with
    their event by a watermarked join, and routed by their device's
    controller, which is state. Equals the batch cascade."""
    return _live(spark, sf, F.lit(False), F.lit(False)).drop("late")


_LIVE_LATE, _LIVE_HELD = "doc_id % 11 = 5", "event_id % 7 = 3"
_SEEN_SQL = "coalesce(e.ts, TIMESTAMP '2024-01-01') - to_seconds(d.doc_id % 30)"


def _live_sql() -> str:
    arrived = f"""seen AS (SELECT d.doc_id, {_SEEN_SQL} AS seen FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id),
horizon AS (SELECT max(seen) - to_seconds({LIVE_LATENESS}) AS edge FROM seen WHERE NOT {_LIVE_LATE}),
tardy AS (SELECT doc_id, {_LIVE_LATE} AND seen < edge AS late FROM seen, horizon),
heard AS (SELECT * FROM events WHERE NOT {_LIVE_HELD}),
"""
    dyn = DYN_CTE.replace("JOIN events e ON e.event_id = sc.id)", "JOIN heard e ON e.event_id = sc.id JOIN tardy ON tardy.doc_id = sc.id AND NOT late)").replace("FROM events", "FROM heard")
    return f"""WITH {arrived}{dyn}
SELECT id AS doc_id, device_id, {S.r6('phi')} AS phi, {S.r6('psi')} AS psi, {S.r6('h')} AS h, {S.r6('tau')} AS tau, c1 < tau AS escalate,
       CASE WHEN c1 < tau THEN p2 ELSE p1 END AS prediction, CASE WHEN c1 < tau THEN 2 ELSE 1 END AS tier_used, tardy.late FROM dyn2 JOIN tardy ON tardy.doc_id = dyn2.id"""


@register("stream_route_late", _live_sql())
def q_stream_route_late(spark, sf):
    """The same where some events never come (their posts stay, without a
    device) and some posts come after all others (those beyond the lateness
    are marked late and get the default phi)."""
    return _live(spark, sf, F.expr(_LIVE_LATE), F.expr(_LIVE_HELD))


@register("stream_stats", f"""WITH {SCORED_CTE}
SELECT source AS run_id, count(*) AS total_samples, count(*) FILTER (WHERE c1 < {THRESHOLD}) AS tier2_count FROM sc GROUP BY source""")
def q_stream_stats(spark, sf):
    """Running router counters per run in update mode."""
    s = st.posts_stream(spark, _os.path.join(sf, "documents*.parquet"))
    dec = routing.route_fixed(s, tier1_scorer(), tier2_scorer(), THRESHOLD)
    return st.drain(st.running_stats(dec), "stats", ["run_id"], mode="update")


# ---------------------------------------------------------------------------
# P12 preprocessing, T10 phi per inference batch
# ---------------------------------------------------------------------------

from ..functions.text import EMOJI_RE, MD_RE, URL_RE  # noqa: E402


def _strip_for_tokens_sql(x: str) -> str:
    y = _strip_html_sql(x)
    y = f"regexp_replace({y}, '{S.q(URL_RE)}', ' ', 'g')"
    y = f"regexp_replace({y}, '{S.q(MD_RE)}', ' ', 'g')"
    y = f"regexp_replace({y}, '{S.q(EMOJI_RE)}', ' ', 'g')"
    y = f"regexp_replace({y}, '{S.q(S.SPACES_RE)}', ' ', 'g')"
    return f"trim({y})"


@register("preprocess_tokens", f"SELECT page_id, {_strip_for_tokens_sql('html')} AS text FROM pages")
def q_preprocess_tokens(spark, sf):
    """Strip HTML, URLs, markdown punctuation and emoji before scoring."""
    return spread(read_table(spark, sf, "pages").select("page_id", "html")).select("page_id", strip_for_tokens("html").alias("text"))


INFER_BATCH = 8

PHI_BATCH_SQL = f"""WITH {TEL_CTE}, {HV2_CTE},
posts AS (SELECT d.doc_id AS id, e.user_id AS device_id, e.ts FROM documents d JOIN events e ON e.event_id = d.doc_id),
pb AS (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY ts, id) - 1) // {INFER_BATCH} AS batch_id FROM posts),
b AS (SELECT device_id, batch_id, min(ts) AS ts, arg_min(id, (ts, id)) AS bid FROM pb GROUP BY device_id, batch_id),
a AS (SELECT b.*, r.cpu_load_norm, r.ram_usage_norm, r.cpu_temp_norm, r.swap_norm, r.gpu_temp_norm, r.vram_usage_norm
      FROM b ASOF LEFT JOIN hv2 r ON b.device_id = r.device_id AND b.ts > r.ts),
pin AS (SELECT device_id, batch_id, bid, epoch_us(ts) AS t,
   CASE WHEN coalesce(gpu_temp_norm, 0) > 0 THEN gpu_temp_norm * 85.0 - 85.0 ELSE coalesce(cpu_load_norm, 0) * 90.0 - 90.0 END AS e,
   CASE WHEN coalesce(gpu_temp_norm, 0) > 0 THEN 0.08 * coalesce(vram_usage_norm, 0) + 0.04 * coalesce(ram_usage_norm, 0)
        ELSE 0.08 * coalesce(ram_usage_norm, 0) + 0.05 * coalesce(swap_norm, 0) + 0.04 * coalesce(cpu_temp_norm, 0) END AS sec FROM a),
{pid_sql('SELECT * FROM pin', 'device_id', 'bid', 1e-6)}
SELECT pb.id AS doc_id, pb.device_id, pb.batch_id::BIGINT AS batch_id, {S.r6('pid.phi')} AS phi FROM pb JOIN pid USING (device_id, batch_id)"""


@register("phi_per_batch", PHI_BATCH_SQL)
def q_phi_per_batch(spark, sf):
    """Each device's posts in (ts, id) order form inference batches
    of 8; one v2 reading (the newest before the batch's first post) and one
    PID step per batch; every post of the batch shares its phi."""
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("device_id"))
    posts = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(ev, "id")
    t = scan.epoch_seconds("ts")
    ranked = scan.exact_rank(posts, ["device_id"], scan.time_chunk(t, 3600), ["ts", "id"], out="_rk")
    pb = ranked.withColumn("batch_id", F.floor((F.col("_rk") - 1) / INFER_BATCH).cast("long")).drop("_rk")
    b = pb.groupBy("device_id", "batch_id").agg(F.min("ts").alias("ts"), F.min_by("id", F.struct("ts", "id")).alias("bid"))
    x = telemetry.latest_reading(b, _hv2(spark, sf), V2_COLS, post_tie="bid", strict=True)
    for c in V2_COLS:
        x = x.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    phi = telemetry.pid(telemetry.pid_inputs_v2(x, CASCADE_V2), CASCADE_V2, tie="bid").select("device_id", "batch_id", "phi")
    return pb.join(phi, ["device_id", "batch_id"]).select(F.col("id").alias("doc_id"), "device_id", "batch_id",
                                                          r6("phi").alias("phi"))


# ---------------------------------------------------------------------------
# P11 target filter, M7 scoring by join with a bounded weight table
# ---------------------------------------------------------------------------

from ..functions.hashing import token_unit  # noqa: E402
from ..operators.scoring import linear_score_by_join  # noqa: E402


@register("target_timeline", f"""WITH {TAG_CTE}
SELECT date, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS total
FROM tagged WHERE product = '{TARGET}' GROUP BY date""")
def q_target_timeline(spark, sf):
    """Visualised aggregates use the target product only (filter first)."""
    t = _tagged(spark, sf).filter(F.col("product") == TARGET)
    return t.groupBy("date").agg(F.count_if(F.col("sentiment") == "positive").alias("positive"),
                                 F.count_if(F.col("sentiment") == "negative").alias("negative"),
                                 F.count(F.lit(1)).alias("total"))


@register("linear_score_join", f"""WITH {TERMS_ALL_CTE},
w AS (SELECT term, (2.0 * {S.tok_u('t1:', 'term')} - 1.0) / 4.0 AS weight FROM vocab),
x AS (SELECT id, unnest(tok) AS term FROM dt),
s AS (SELECT x.id, sum(w.weight) AS s FROM x JOIN w USING (term) GROUP BY x.id),
p AS (SELECT dt.id, 1.0 / (1.0 + exp(-coalesce(s.s, 0.0))) AS p FROM dt LEFT JOIN s USING (id))
SELECT id AS doc_id, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, {S.r6('greatest(p, 1.0 - p)')} AS confidence FROM p""")
def q_linear_score_join(spark, sf):
    """M7 join form: a linear model given as a (term, weight) table - here
    the uni-grams of the vocabulary with hashed weights - scored by counting
    a document's tokens, joining the table and summing per document."""
    d = pl.docs(spark, sf, stripped=True).select("id", "stripped")
    vocab = ft.vocabulary(ft.term_counts(d, "stripped", ngram_max=1))  # its runs of [a-z0-9] are those of the cleaned text
    weights = vocab.select("term", ((2.0 * token_unit(F.col("term"), "t1:") - 1.0) / 4.0).alias("weight"))
    s = linear_score_by_join(d, weights, "id", text_col="stripped")
    return s.select(F.col("id").alias("doc_id"), F.col("pred").alias("prediction"), r6("conf").alias("confidence"))
