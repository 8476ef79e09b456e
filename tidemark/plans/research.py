"""Features, graph, portfolio and evaluation on top of the bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import valence
from tidemark.functions.text import SPACE as S
from tidemark.operators import bars as bars_ops
from tidemark.operators import baselines, evaluation, features, graph
from tidemark.operators import macro as macro_ops
from tidemark.operators import master as master_ops
from tidemark.operators import news as news_ops
from tidemark.operators import portfolio, scan
from tidemark.plans.press import ARTICLE_TEXTS, NEWS_DAILY, NEWS_FLAGS, NEWS_SCORED, TEST_KEYWORDS, press_features
from tidemark.plans.reference_data import MACRO_FILLED, TEST_SERIES
from tidemark.plans.registry import query
from tidemark.plans.social import DOWN, SOCIAL_DAILY, TEST_LEXICON, UP, labelled_days, social_sql
from tidemark.plans.tables import Tables, with_entities

RETURNS = """returns AS (SELECT * FROM (SELECT Ticker, Date,
  Close / nullif(lag(Close) OVER (PARTITION BY Ticker ORDER BY Date), 0) - 1 AS r FROM {bars}) WHERE r IS NOT NULL)"""
SHORT, LONG = RETURNS.format(bars="bars"), RETURNS.format(bars="bars_long")


def _rounded(frame, *names: str, digits: int = 6):
    return frame.withColumns({n: F.round(n, digits) for n in names})


# -- correlation graph ------------------------------------------------------------------------

_PAIRS = f"""{SHORT},
joined AS (SELECT x.Ticker AS a, y.Ticker AS b, x.Date, x.r AS ra, y.r AS rb FROM returns x JOIN returns y
  ON x.Date = y.Date AND x.Ticker < y.Ticker),
moments AS (SELECT *, covar_pop(ra, rb) OVER w AS cov, stddev_pop(ra) OVER w AS sa, stddev_pop(rb) OVER w AS sb,
  count(*) OVER w AS n FROM joined WINDOW w AS (PARTITION BY a, b ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
pairs AS (SELECT a, b, Date, ra, rb, cov / nullif(sa * sb, 0) AS rho FROM moments WHERE n = 7)"""
_EDGES = """edges AS (SELECT a AS src, b AS dst, Date, rho, rb AS dst_r FROM pairs WHERE abs(rho) >= 0.2
  UNION ALL SELECT b, a, Date, rho, ra FROM pairs WHERE abs(rho) >= 0.2)"""


def _correlations(t: Tables):
    return graph.rolling_correlation(bars_ops.daily_returns(t.bars))


@query("rolling_corr", with_entities(f"""
, {_PAIRS} SELECT a, b, CAST(Date AS VARCHAR) AS Date, round(rho, 6) AS rho FROM pairs""", "bars"))
def rolling_corr(t: Tables):
    return _rounded(_correlations(t), "rho").select("a", "b", "Date", "rho")


@query("corr_edges", with_entities(f"""
, {_PAIRS}, {_EDGES} SELECT src, dst, CAST(Date AS VARCHAR) AS Date, round(rho, 6) AS rho FROM edges""", "bars"))
def corr_edges(t: Tables):
    return _rounded(graph.edges(_correlations(t)), "rho").select("src", "dst", "Date", "rho")


@query("block_corr", with_entities(f"""
, {_PAIRS}, {_EDGES} SELECT src, dst, CAST(Date AS VARCHAR) AS Date, round(rho, 6) AS rho FROM edges""", "bars"))
def block_corr(t: Tables):
    """The same edges from matrix products; two assets per block, so that blocks meet on small tables, too."""
    found = graph.block_correlation(bars_ops.daily_returns(t.bars), block=2)
    return _rounded(graph.edges(found), "rho").select("src", "dst", "Date", "rho")


@query("neighbor_mean", with_entities(f"""
, {_PAIRS}, {_EDGES} SELECT src AS Ticker, CAST(Date AS VARCHAR) AS Date, count(*) AS degree,
  round(avg(dst_r), 6) AS neighbour_r, round(sum(rho * dst_r) / sum(abs(rho)), 6) AS weighted_r
FROM edges GROUP BY src, Date""", "bars"))
def neighbor_mean(t: Tables):
    return _rounded(graph.neighbour_mean(graph.edges(_correlations(t))), "neighbour_r", "weighted_r")


def _hop(i: int) -> str:
    return f"""h{i} AS (SELECT o.Ticker, o.Date, o.r, CASE WHEN sum(abs(e.rho)) IS NULL THEN o.r
  ELSE 0.5 * o.r + 0.5 * sum(abs(e.rho) * h.x) / sum(abs(e.rho)) END AS x
  FROM returns o LEFT JOIN (edges e JOIN h{i - 1} h ON h.Ticker = e.dst AND h.Date = e.Date) ON e.src = o.Ticker AND e.Date = o.Date GROUP BY o.Ticker, o.Date, o.r)"""


@query("graph_smooth", with_entities(f"""
, {_PAIRS}, {_EDGES}, h0 AS (SELECT Ticker, Date, r, r AS x FROM returns), {', '.join(_hop(i) for i in (1, 2, 3))}
SELECT Ticker, CAST(Date AS VARCHAR) AS Date, round(x, 6) AS smooth FROM h3""", "bars"))
def graph_smooth(t: Tables):
    """Returns after three hops over the correlation graph of their day."""
    returns = bars_ops.daily_returns(t.bars)
    found = graph.graph_smooth(graph.edges(_correlations(t)), returns, tolerance=0.0, most_hops=3)
    return _rounded(found.select("Ticker", "Date", "smooth"), "smooth")


TAUS, CREDS = [0.0, 0.1, 0.2, 0.3, 0.5], [0.4, 0.5, 0.6, 0.7, 0.8]


@query("threshold_sweep", with_entities(f"""
, {_PAIRS} SELECT 'edges' AS "of", t AS threshold, count(*) FILTER (abs(rho) >= t) AS kept
FROM pairs, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in TAUS)}]) AS t) GROUP BY t
UNION ALL SELECT 'articles', t, count(*) FILTER (p_cred >= t)
FROM articles, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in CREDS)}]) AS t) GROUP BY t""", "bars", "articles"))
def threshold_sweep(t: Tables):
    return graph.edge_sweep(_correlations(t), TAUS).unionByName(graph.credibility_sweep(t.articles, CREDS))


# -- features ---------------------------------------------------------------------------------


@query("feature_row", with_entities(f"""
, {SOCIAL_DAILY}, {NEWS_SCORED}, {NEWS_DAILY.replace('daily AS', 'press AS', 1)}, {NEWS_FLAGS}, {MACRO_FILLED}
SELECT b.Ticker, CAST(b.Date AS VARCHAR) AS Date, Close, CAST(Volume AS DOUBLE) AS Volume,
  CAST(coalesce(cum, 0) AS DOUBLE) AS Sent_CumScore, round(coalesce(conf, 0), 6) AS Sent_Confidence,
  coalesce(News_Score, 0) AS News_Score, CAST(coalesce(News_Cnt, 0) AS DOUBLE) AS News_Cnt,
  CAST(coalesce(Event_Flag, 0) AS DOUBLE) AS Event_Flag, m.Interest_Rate, m.Current_Account,
  CAST(d.cum IS NOT NULL AS INTEGER) AS has_sent, CAST(p.Ticker IS NOT NULL OR f.Ticker IS NOT NULL AS INTEGER) AS has_news
FROM bars b LEFT JOIN daily d ON b.Ticker = d.Ticker AND b.Date = d.Date
  LEFT JOIN press p ON b.Ticker = p.Ticker AND b.Date = p.Date LEFT JOIN flags f ON b.Ticker = f.Ticker AND b.Date = f.Date
  ASOF LEFT JOIN filled m ON b.Date >= m.date
WHERE b.Ticker IN (SELECT Ticker FROM daily)""", "bars", "scored_snippets", "articles", "macro_long"))
def feature_row(t: Tables):
    """History, sentiment, news and macro values of an asset and day as one vector."""
    master = master_ops.master_with_sentiment(t.bars, labelled_days(t))
    master = master_ops.refresh_news(master, press_features(t), known="news_known")
    full = macro_ops.as_of(master, t.macro_long, TEST_SERIES)
    blocks = {
        "hist": ["Close", "Volume"], "sent": ["Sent_CumScore", "Sent_Confidence"],
        "news": ["News_Score", "News_Cnt", "Event_Flag"], "macro": ["Interest_Rate", "Current_Account"],
    }
    fused = features.fuse(full, blocks, known={"news": "news_known"})
    names = [c for cs in blocks.values() for c in cs]
    parts = fused.select("Ticker", "Date", *(F.col("x")[i].alias(n) for i, n in enumerate(names)), "has_sent", "has_news")
    return _rounded(parts, "Sent_Confidence")


@query("lexicon_score", f"""
WITH words AS (SELECT doc_id, list_filter(string_split(lower({social_sql('text')}), ' '), lambda w: w <> '') AS w FROM documents),
counted AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ({UP}))) - len(list_filter(w, lambda x: x IN ({DOWN}))) AS s FROM words)
SELECT doc_id, CAST(n AS INTEGER) AS words, CAST(s AS DOUBLE) AS score, round(s / nullif(n, 0), 6) AS mean_score FROM counted""")
def lexicon_score(t: Tables):
    return _rounded(baselines.lexicon_score(t.documents, "doc_id", "text", TEST_LEXICON), "mean_score")


_CAPITALS = "(w = upper(w) AND w <> lower(w))"
_BOOSTERS = "MAP {" + ", ".join(f"'{w}': {x}" for w, x in valence.BOOSTERS.items()) + "}"
_NEGATIONS = "(" + ", ".join(f"'{w}'" for w in valence.NEGATIONS) + ")"


def _valence_step(p: int) -> str:
    """The weight after the word ``p`` places before has raised, lowered or turned it."""
    v, damp = f"v{p - 1}", (1.0, 0.95, 0.9)[p - 1]
    never = {1: "false", 2: "l2 = 'never' AND l1 IN ('so', 'this')", 3: "l3 = 'never' AND (l2 IN ('so', 'this') OR l1 IN ('so', 'this'))"}[p]
    doubt = {1: "false", 2: "l2 = 'without' AND l1 = 'doubt'", 3: "l3 = 'without' AND (l2 = 'doubt' OR l1 = 'doubt')"}[p]
    raised = f"({v} + CASE WHEN b{p} IS NULL THEN 0 ELSE {damp} * (CASE WHEN {v} < 0 THEN -b{p} ELSE b{p} END + CASE WHEN NOT (up{p} AND mixed) THEN 0 WHEN {v} > 0 THEN 0.733 ELSE -0.733 END) END)"
    return (
        f"CASE WHEN l{p} IS NULL OR k{p} THEN {v} WHEN {never} THEN 1.25 * {raised} WHEN {doubt} THEN {raised} "
        f"WHEN l{p} IN {_NEGATIONS} OR contains(l{p}, 'n''t') THEN -0.74 * {raised} ELSE {raised} END AS v{p}"
    )


@query("vader_score", f"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, string_split(trim(regexp_replace(coalesce(text, ''), '[{S}]+', ' ', 'g')), ' ') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS raw FROM split),
bare AS (SELECT doc_id, pos, CASE WHEN length(trim(raw, '{valence.PUNCTUATION.replace("'", "''")}')) <= 2 THEN raw
  ELSE trim(raw, '{valence.PUNCTUATION.replace("'", "''")}') END AS w FROM words WHERE raw <> ''),
known AS (SELECT *, lower(w) AS l, {_CAPITALS} AS up, lower(w) IN ({UP}, {DOWN}) AS k,
  CASE WHEN lower(w) IN ({UP}) THEN 1.0 WHEN lower(w) IN ({DOWN}) THEN -1.0 END AS x, {_BOOSTERS}[lower(w)] AS b FROM bare),
near AS (SELECT *, {', '.join(f"lag(l, {p}) OVER o AS l{p}, lag(up, {p}) OVER o AS up{p}, lag(k, {p}) OVER o AS k{p}, lag(b, {p}) OVER o AS b{p}" for p in (1, 2, 3))},
  count_if(up) OVER d BETWEEN 1 AND count(*) OVER d - 1 AS mixed, min(pos) FILTER (l = 'but') OVER d AS but
  FROM known WINDOW o AS (PARTITION BY doc_id ORDER BY pos), d AS (PARTITION BY doc_id)),
s0 AS (SELECT *, CAST(CASE WHEN x IS NULL OR b IS NOT NULL THEN 0 WHEN up AND mixed THEN x + sign(x) * 0.733 ELSE x END AS DOUBLE) AS v0 FROM near),
s1 AS (SELECT *, {_valence_step(1)} FROM s0), s2 AS (SELECT *, {_valence_step(2)} FROM s1), s3 AS (SELECT *, {_valence_step(3)} FROM s2),
least_said AS (SELECT doc_id, CASE WHEN v0 = 0 THEN 0 ELSE v3 * CASE WHEN l1 = 'least' AND NOT k1 AND coalesce(l2 NOT IN ('at', 'very'), true) THEN -0.74 ELSE 1 END END
  * CASE WHEN but IS NULL OR pos = but THEN 1 WHEN pos < but THEN 0.5 ELSE 1.5 END AS v FROM s3),
sums AS (SELECT doc_id, sum(v) AS s FROM least_said GROUP BY doc_id),
marks AS (SELECT doc_id, least(len(text) - len(replace(text, '!', '')), 4) * 0.292 + CASE len(text) - len(replace(text, '?', '')) WHEN 0 THEN 0 WHEN 1 THEN 0
  WHEN 2 THEN 0.36 WHEN 3 THEN 0.54 ELSE 0.96 END AS m FROM split),
total AS (SELECT m.doc_id, coalesce(s, 0) + coalesce(sign(s), 0) * m AS t FROM marks m LEFT JOIN sums USING (doc_id))
SELECT doc_id, round(t / sqrt(t * t + 15), 6) AS compound FROM total""")
def vader_score(t: Tables):
    scored = baselines.valence_score(t.documents, "doc_id", "text", TEST_LEXICON)
    return _rounded(scored.select("doc_id", "compound"), "compound")


@query("tfidf_top_terms", f"""
WITH words AS (SELECT doc_id, unnest(list_filter(string_split(lower({social_sql('text')}), ' '), lambda w: w <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighted AS (SELECT doc_id, tf.term, tf, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf
  FROM tf JOIN df ON tf.term = df.term)
SELECT doc_id, term, tf, tfidf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS INTEGER) AS rank
FROM weighted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) <= 5""")
def tfidf_top_terms(t: Tables):
    return _rounded(baselines.top_terms(baselines.tfidf(t.documents, "doc_id", "text"), "doc_id"), "tfidf")


# -- portfolio --------------------------------------------------------------------------------

SIZES = [2, 3]
SLIPPAGE = {"1-URGENT": 5.0, "2-HIGH": 10.0, "3-MEDIUM": 25.0}
LAMBDAS = [0.1, 0.25, 0.5, 0.75, 1.0]

_FORECASTS = f"""{LONG},
forecasts AS (SELECT * FROM (SELECT *, lag(r) OVER (PARTITION BY Ticker ORDER BY Date) AS forecast FROM returns)
  WHERE forecast IS NOT NULL)"""
_WEIGHTS = f"""{_FORECASTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY Date ORDER BY forecast DESC, Ticker) AS rank FROM forecasts),
weights AS (SELECT Ticker, Date, r, rank, K, 1.0 / count(*) OVER (PARTITION BY Date, K) AS w
  FROM ranked JOIN (SELECT unnest([{', '.join(map(str, SIZES))}]) AS K) ON rank <= K)"""
_NET = f"""{_WEIGHTS},
days AS (SELECT K, Date, lag(Date) OVER (PARTITION BY K ORDER BY Date) AS prev FROM (SELECT DISTINCT K, Date FROM weights)),
held AS (SELECT d.K, d.Date, w.Ticker, w.w AS now, 0 AS before FROM days d JOIN weights w ON w.K = d.K AND w.Date = d.Date
  UNION ALL SELECT d.K, d.Date, w.Ticker, 0, w.w FROM days d JOIN weights w ON w.K = d.K AND w.Date = d.prev),
moves AS (SELECT K, Date, Ticker, abs(sum(now) - sum(before)) AS dw FROM held GROUP BY K, Date, Ticker),
costs AS (SELECT K, Date, sum(dw * (7.5 + CASE Ticker {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SLIPPAGE.items())} ELSE 50 END) / 10000) AS cost
  FROM moves GROUP BY K, Date),
gross AS (SELECT K, Date, sum(CAST(w AS DOUBLE) * r) AS gross FROM weights GROUP BY K, Date),
net AS (SELECT g.K, g.Date, gross, CAST(cost AS DOUBLE) AS cost, gross - CAST(cost AS DOUBLE) AS net
  FROM gross g JOIN costs c ON g.K = c.K AND g.Date = c.Date)"""


def _forecasts(t: Tables):
    return evaluation.previous_return(bars_ops.daily_returns(t.bars_long))


def _weights(t: Tables):
    return portfolio.top_k(_forecasts(t), SIZES)


def _net(t: Tables):
    return portfolio.net_returns(_weights(t), SLIPPAGE)


@query("topk_portfolio", with_entities(f"""
, {_WEIGHTS} SELECT CAST(K AS INTEGER) AS K, CAST(Date AS VARCHAR) AS Date, Ticker, CAST(rank AS INTEGER) AS rank,
  round(CAST(w AS DOUBLE), 6) AS w FROM weights""", "bars_long"))
def topk_portfolio(t: Tables):
    return _rounded(_weights(t), "w").select("K", "Date", "Ticker", "rank", "w")


@query("weight_audit", with_entities(f"""
, {_WEIGHTS} SELECT CAST(K AS INTEGER) AS K, CAST(Date AS VARCHAR) AS Date, round(CAST(min(w) AS DOUBLE), 6) AS min_w,
  round(CAST(max(w) AS DOUBLE), 6) AS max_w, round(CAST(sum(w) AS DOUBLE), 6) AS sum_w,
  count(*) FILTER (abs(w) > 0.3) AS violations FROM weights GROUP BY K, Date""", "bars_long"))
def weight_audit(t: Tables):
    return _rounded(portfolio.audit_weights(_weights(t)), "min_w", "max_w", "sum_w")


# The sum at every point where a weight meets a bound; between two points it is linear.
@query("weight_project", with_entities(f"""
, {_FORECASTS}, points AS (SELECT Date, unnest([forecast - 0.3, forecast + 0.3]) AS x FROM forecasts),
sums AS (SELECT p.Date, p.x, sum(greatest(-0.3, least(0.3, f.forecast - p.x))) AS s FROM (SELECT DISTINCT Date, x FROM points) p
  JOIN forecasts f ON f.Date = p.Date GROUP BY p.Date, p.x),
around AS (SELECT Date, max(x) FILTER (s >= 1) AS a, min(x) FILTER (s <= 1) AS b, min(s) FILTER (s >= 1) AS sa, max(s) FILTER (s <= 1) AS sb
  FROM sums GROUP BY Date),
shifts AS (SELECT Date, CASE WHEN sa = sb THEN a ELSE a + (sa - 1) * (b - a) / (sa - sb) END AS shift FROM around),
sizes AS (SELECT Date, count(*) BETWEEN 4 AND 1e9 AS feasible FROM forecasts GROUP BY Date)
SELECT CAST(f.Date AS VARCHAR) AS Date, Ticker, round(forecast, 6) AS raw, feasible,
  CASE WHEN feasible THEN round(greatest(-0.3, least(0.3, forecast - shift)), 6) END AS w
FROM forecasts f JOIN sizes z ON z.Date = f.Date LEFT JOIN shifts s ON s.Date = f.Date""", "bars_long"))
def weight_project(t: Tables):
    """Forecasts as weights, moved to the nearest that keep the bounds and sum to 1."""
    raw = _forecasts(t).withColumn("w", F.col("forecast"))
    return _rounded(portfolio.project_weights(raw).withColumn("raw", F.col("forecast")), "w", "raw").select("Date", "Ticker", "raw", "feasible", "w")


@query("portfolio_return", with_entities(f"""
, {_NET} SELECT CAST(K AS INTEGER) AS K, CAST(Date AS VARCHAR) AS Date, round(gross, 6) AS gross, round(cost, 6) AS cost,
  round(net, 6) AS net FROM net""", "bars_long"))
def portfolio_return(t: Tables):
    return _rounded(_net(t), "gross", "cost", "net")


@query("reward_sweep", with_entities(f"""
, {_NET} SELECT CAST(K AS INTEGER) AS K, l AS lambda, round(avg(net) - l * var_pop(net), 4) AS reward
FROM net, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in LAMBDAS)}]) AS l) GROUP BY K, l""", "bars_long"))
def reward_sweep(t: Tables):
    return _rounded(portfolio.reward_sweep(_net(t), LAMBDAS), "reward", digits=4)


@query("risk_metrics", with_entities(f"""
, {_NET}, wealth AS (SELECT *, sum(ln(1 + net)) OVER (PARTITION BY K ORDER BY Date) AS l FROM net),
falls AS (SELECT *, exp(l - greatest(max(l) OVER (PARTITION BY K ORDER BY Date), 0)) - 1 AS fall FROM wealth)
SELECT CAST(K AS INTEGER) AS K, count(*) AS days, round(avg(net) / stddev_pop(net) * sqrt(365), 4) AS sharpe,
  round(avg(net) / sqrt(avg(least(net, 0) ** 2)) * sqrt(365), 4) AS sortino, round(min(fall), 4) AS max_drawdown
FROM falls GROUP BY K""", "bars_long"))
def risk_metrics(t: Tables):
    return _rounded(portfolio.risk_metrics(_net(t)), "sharpe", "sortino", "max_drawdown", digits=4)


LEVELS = [0.9, 0.95, 0.99]
_TAILS = f"""{_NET}, sorted AS (SELECT K, net, row_number() OVER (PARTITION BY K ORDER BY net) AS i, count(*) OVER (PARTITION BY K) AS n FROM net),
marked AS (SELECT *, round(n * (1 - level), 9) AS m FROM sorted, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in LEVELS)}]) AS level)),
tails AS (SELECT K, level, max(n) AS days, -min(net) FILTER (i >= m) AS var, -sum(net * greatest(0, least(1, m - i + 1))) / max(m) AS cvar
  FROM marked GROUP BY K, level)"""


@query("cvar_metrics", with_entities(f"""
, {_TAILS} SELECT CAST(K AS INTEGER) AS K, level, days, round(var, 6) AS var, round(cvar, 6) AS cvar FROM tails""", "bars_long"))
def cvar_metrics(t: Tables):
    return _rounded(portfolio.tail_risk(_net(t), LEVELS), "var", "cvar")


@query("cvar_reward", with_entities(f"""
, {_TAILS} SELECT CAST(t.K AS INTEGER) AS K, l AS lambda, round((SELECT avg(net) FROM net WHERE net.K = t.K) - l * cvar, 6) AS reward
FROM tails t, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in LAMBDAS)}]) AS l) WHERE level = 0.95""", "bars_long"))
def cvar_reward(t: Tables):
    return _rounded(portfolio.tail_reward(_net(t), LAMBDAS), "reward")


@query("wealth_curve", with_entities(f"""
, {_NET}, wealth AS (SELECT *, sum(CASE WHEN net > -1 THEN ln(1 + net) ELSE 0 END) OVER (PARTITION BY K ORDER BY Date) AS l FROM net),
peaks AS (SELECT *, greatest(max(l) OVER (PARTITION BY K ORDER BY Date), 0) AS p FROM wealth)
SELECT CAST(K AS INTEGER) AS K, CAST(Date AS VARCHAR) AS Date, round(exp(l - p) - 1, 6) AS fall FROM peaks""", "bars_long"))
def wealth_curve(t: Tables):
    return _rounded(scan.wealth_curve(_net(t), ranges=16).select("K", "Date", "fall"), "fall")


# -- evaluation -------------------------------------------------------------------------------

REGIMES = [
    ("early", "1995-01-01", "1995-12-31"), ("rise", "1996-01-01", "1997-06-30"),
    ("crash", "1997-07-01", "1998-02-28"), ("rally", "1998-03-01", "1999-09-30"),
    ("contagion", "1999-10-01", "2000-06-30"), ("late", "2000-07-01", "2002-12-31"),
]


@query("forecast_metrics", with_entities(f"""
, {_FORECASTS} SELECT Ticker, count(*) AS n, round(sqrt(avg((r - forecast) ** 2)), 4) AS rmse,
  round(avg(CASE WHEN sign(r) = sign(forecast) THEN 1.0 ELSE 0.0 END), 6) AS direction FROM forecasts GROUP BY Ticker""",
    "bars_long"))
def forecast_metrics(t: Tables):
    return _rounded(_rounded(evaluation.forecast_metrics(_forecasts(t)), "direction"), "rmse", digits=4)


@query("regime_metrics", with_entities(f"""
, {LONG}, regimes AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in REGIMES)}) v(regime, a, b))
SELECT Ticker, regime, count(*) AS days, round(avg(r), 4) AS mean_r, round(avg(r) / nullif(stddev_pop(r), 0) * sqrt(365), 4) AS sharpe
FROM returns JOIN regimes ON Date BETWEEN a AND b GROUP BY Ticker, regime""", "bars_long"))
def regime_metrics(t: Tables):
    out = evaluation.regime_metrics(bars_ops.daily_returns(t.bars_long), REGIMES)
    return _rounded(out, "mean_r", "sharpe", digits=4)


@query("event_study", with_entities(f"""
, {SHORT}, {ARTICLE_TEXTS}, {NEWS_FLAGS}
SELECT f.Ticker, CAST(k AS INTEGER) AS day_offset, count(*) AS n, round(avg(r), 6) AS mean_r
FROM flags f JOIN (SELECT unnest(range(-3, 4)) AS k) ON true JOIN returns x ON x.Ticker = f.Ticker AND x.Date = f.Date + CAST(k AS INTEGER)
WHERE Event_Flag = 1 GROUP BY f.Ticker, k""", "bars", "articles"))
def event_study(t: Tables):
    days = news_ops.daily_events(t.articles, TEST_KEYWORDS).where("Event_Flag = 1")
    return _rounded(evaluation.event_study(bars_ops.daily_returns(t.bars), days), "mean_r")


# Offsets of the estimation window, and days an event needs there; the test bars span one month.
ESTIMATION, LEAST_DAYS = (-20, -4), 6
_ABNORMAL = f"""{SHORT}, {ARTICLE_TEXTS}, {NEWS_FLAGS},
market AS (SELECT Date, avg(r) AS m FROM returns GROUP BY Date),
both_r AS (SELECT Ticker, x.Date, r, m FROM returns x JOIN market USING (Date)),
days AS (SELECT Ticker, Date AS d FROM flags WHERE Event_Flag = 1),
fits AS (SELECT e.Ticker, d, count(*) AS n, regr_slope(r, m) AS beta, regr_intercept(r, m) AS alpha,
  sqrt(greatest(regr_syy(r, m) - regr_slope(r, m) * regr_sxy(r, m), 0) / nullif(count(*) - 2, 0)) AS s
  FROM days e JOIN both_r b ON b.Ticker = e.Ticker AND b.Date - d BETWEEN {ESTIMATION[0]} AND {ESTIMATION[1]}
  GROUP BY e.Ticker, d HAVING count(*) >= {LEAST_DAYS}),
abnormal AS (SELECT b.Ticker, e.d, CAST(b.Date - e.d AS INTEGER) AS k, r - (alpha + beta * m) AS ar, s
  FROM days e JOIN both_r b ON b.Ticker = e.Ticker AND b.Date - e.d BETWEEN -3 AND 3 LEFT JOIN fits f ON f.Ticker = e.Ticker AND f.d = e.d),
cumulated AS (SELECT *, sum(ar) OVER w AS car, count(ar) OVER w AS l FROM abnormal WINDOW w AS (PARTITION BY Ticker, d ORDER BY k))"""


@query("abnormal_returns", with_entities(f"""
, {_ABNORMAL} SELECT Ticker, CAST(d AS VARCHAR) AS event_day, k AS day_offset, round(ar, 6) AS abnormal, round(ar / s, 4) AS t,
  round(car, 6) AS cumulated, round(car / (s * sqrt(l)), 4) AS cumulated_t FROM cumulated""", "bars", "articles"))
def abnormal_returns(t: Tables):
    out = _rounded(_rounded(_abnormal(t), "abnormal", "cumulated"), "t", "cumulated_t", digits=4)
    return out.drop("r", "expected")


@query("average_abnormal", with_entities(f"""
, {_ABNORMAL} SELECT k AS day_offset, count(*) AS events, round(avg(ar), 6) AS mean_abnormal,
  round(avg(ar) * sqrt(count(ar)) / stddev_samp(ar), 4) AS t, round(avg(car), 6) AS mean_cumulated,
  round(avg(car) * sqrt(count(car)) / stddev_samp(car), 4) AS cumulated_t FROM cumulated WHERE ar IS NOT NULL GROUP BY k""", "bars", "articles"))
def average_abnormal(t: Tables):
    out = evaluation.average_abnormal(_abnormal(t))
    return _rounded(_rounded(out, "mean_abnormal", "mean_cumulated"), "t", "cumulated_t", digits=4)


def _abnormal(t: Tables):
    days = news_ops.daily_events(t.articles, TEST_KEYWORDS).where("Event_Flag = 1")
    returns = bars_ops.daily_returns(t.bars)
    return evaluation.abnormal_returns(returns, days, evaluation.market_return(returns), 3, ESTIMATION, LEAST_DAYS)


def _folds_sql(mode: str) -> str:
    start = "test_start - INTERVAL 18 MONTH" if mode == "rolling" else "lo"
    return f"""ends AS (SELECT min(Date) AS lo, max(Date) AS hi FROM bars_long),
tests AS (SELECT lo, i AS fold, CAST(hi - to_months(CAST(3 * (3 - i) AS INTEGER)) AS DATE) AS test_end FROM ends, (SELECT unnest([1, 2, 3]) AS i)),
starts AS (SELECT *, CAST(test_end - INTERVAL 3 MONTH AS DATE) + 1 AS test_start FROM tests),
folds AS (SELECT fold, CAST({start} AS DATE) AS train_start, test_start - 1 AS train_end, test_start, test_end FROM starts)"""


@query("backtest_folds", with_entities(f"""
, {_folds_sql('rolling')} SELECT CAST(f.fold AS INTEGER) AS fold, CASE WHEN Date >= test_start THEN 'test' ELSE 'train' END AS role,
  CAST(train_start AS VARCHAR) AS train_start, CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end,
  count(*) AS bars FROM folds f JOIN bars_long b ON Date BETWEEN train_start AND test_end
GROUP BY ALL""", "bars_long"))
def backtest_folds(t: Tables):
    rows = evaluation.assign_folds(t.bars_long)
    return rows.groupBy("fold", "role", "train_start", "test_start", "test_end").agg(F.count("*").alias("bars"))


@query("fold_membership", with_entities(f"""
, {_folds_sql('expanding')}, spans AS (SELECT Ticker, min(Date) AS a, max(Date) AS b FROM bars_long GROUP BY Ticker)
SELECT Ticker, CAST(fold AS INTEGER) AS fold, CAST(a > train_start AS INTEGER) AS cold_start, CAST(b < test_end AS INTEGER) AS delisted
FROM spans JOIN folds ON a <= test_end AND b >= train_start""", "bars_long"))
def fold_membership(t: Tables):
    return evaluation.fold_membership(t.bars_long, mode="expanding")


@query("fleiss_kappa", with_entities("""
, cells AS (SELECT item, category, count(*) AS n FROM ratings GROUP BY item, category),
items AS (SELECT item, sum(n) AS m, sum(n * n) AS sq FROM cells GROUP BY item),
shares AS (SELECT category, sum(n) / (SELECT sum(n) FROM cells) AS p FROM cells GROUP BY category)
SELECT count(*) AS items, avg(m) AS raters,
  round((avg((sq - m) / (m * (m - 1))) - (SELECT sum(p * p) FROM shares)) / (1 - (SELECT sum(p * p) FROM shares)), 6) AS kappa
FROM items""", "ratings"))
def fleiss_kappa(t: Tables):
    return _rounded(evaluation.fleiss_kappa(t.ratings), "kappa")
