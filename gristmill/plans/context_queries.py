"""Queries of macro pillars, positioning, regimes, signals and source checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import charts as C, context as K, events as E, macro as M, options as O, scoring as S
from ..sources.views import held, oracle, table, view
from .content_queries import _CLS, _UD
from .forecast_queries import _SERF
from .indicator_queries import RET, W, _SWINGS, _full, _rows
from .option_queries import _SCAN
from .rank_queries import _BOARD

#: (pillar, series, feature, centre, scale): what the series say of each pillar.
COMPONENTS = [
    ("A", "1-URGENT", "ma_distance", 0.0, 2.0), ("A", "1-URGENT", "z", 0.0, 0.5), ("B", "2-HIGH", "z", 0.0, -0.5), ("B", "2-HIGH", "change3", 0.0, -1.0), ("C", "3-MEDIUM", "z", 0.0, 0.5), ("C", "3-MEDIUM", "yoy", 0.1, 1.0),
    ("D", "4-NOT SPECIFIED", "z", 0.0, -0.4), ("D", "4-NOT SPECIFIED", "change3", 0.0, 2.0), ("E", "5-LOW", "yoy", 0.0, 1.0), ("E", "5-LOW", "ma_distance", 0.0, 3.0), ("F", "1-URGENT", "yoy", 0.0, 1.0), ("G", "2-HIGH", "yoy", 0.0, 1.0), ("G", "9-NONE", "z", 0.0, 1.0),
]
UP, DOWN = ["the", "la", "der", "en"], ["and", "que", "die", "et"]


def _scores(spark, sf_dir):
    last = M.series_features(view(spark, sf_dir, "series"))
    last = last.groupBy("series_id").agg(F.max_by(F.struct("ma_distance", "change3", "yoy", "z"), "d").alias("b")).select("series_id", "b.*").unpivot("series_id", ["ma_distance", "change3", "yoy", "z"], "feature", "value")
    parts = spark.createDataFrame(COMPONENTS, "pillar string, series_id string, feature string, centre double, scale double")
    return K.pillar_scores(parts.join(last, ["series_id", "feature"], "left").withColumn("component", F.concat_ws(":", "series_id", "feature")))


def dom30_eight_pillars(spark, sf_dir):
    return _scores(spark, sf_dir)


def dat06_event_risk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    cal = o.select("d", F.concat(F.lit("event "), F.col("k").cast("string")).alias("label"), F.when(F.col("k") % 3 == 0, "high").otherwise("medium").alias("impact"))
    today = cal.agg(F.date_sub(F.max("d"), 20).alias("today")).first()["today"]  # one date
    return K.event_risk(cal, F.lit(today))


def dom31_macro_regime(spark, sf_dir):
    level = view(spark, sf_dir, "macro_state").select((F.col("bear_risk") * 40).alias("level"))
    return K.regime(_scores(spark, sf_dir), level)


def dom34_flow(spark, sf_dir):
    c = view(spark, sf_dir, "company")
    c = c.withColumn("short_change", F.when(F.col("short_float") > 0.1, F.col("profit_margin") * 10 - F.col("roa"))).withColumn("upside", F.col("target") / 120 - 1)
    return K.positioning(c)


def dom32_assessment(spark, sf_dir):
    return K.regime_assessment(held(view(spark, sf_dir, "bars")))


def dom12_benchmark_regime(spark, sf_dir):
    rows = S.dashboard(held(view(spark, sf_dir, "bars")), view(spark, sf_dir, "market"))
    return K.benchmark_regime(rows).select("symbol", "regime")


def dom13_monitor(spark, sf_dir):
    bars = held(view(spark, sf_dir, "bars"))
    ends = bars.groupBy("symbol").agg(F.max_by("close", "d").alias("close"), F.min_by("close", "d").alias("ref_price"), F.max("high").alias("target"), F.avg("close").alias("risk_line"))
    n = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    picks = ends.select(F.when(n % 4 == 0, F.concat(F.lit("OLD-"), "symbol")).when(n % 7 == 0, F.concat(F.lit("X-"), "symbol")).otherwise(F.col("symbol")).alias("symbol"), "ref_price", "target", F.round("risk_line", 6).alias("risk_line"), (n * 7 % 70).alias("probability"), F.lit(12.5).alias("move"))
    aliases = ends.where(n % 4 == 0).select(F.concat(F.lit("OLD-"), "symbol").alias("symbol"), F.col("symbol").alias("listed"))
    return K.watchlist_monitor(picks, ends.select("symbol", "close"), aliases, ends.select("symbol", F.length("symbol").cast("double").alias("score")))


def _news(spark, sf_dir):
    return K.news_signals(view(spark, sf_dir, "messages"), UP, DOWN)


def agg21_news(spark, sf_dir):
    return _news(spark, sf_dir)


def _said(spark, sf_dir):
    m = view(spark, sf_dir, "messages").withColumn("t", F.split(F.lower("text"), "[^a-z]+"))
    return K.message_shares(m.select("symbol", "source", X.message_class(F.col("t"), UP, DOWN).alias("cls")))


def agg20_combined_sentiment(spark, sf_dir):
    return _said(spark, sf_dir)


def dom35_event_bundle(spark, sf_dir):
    flow = view(spark, sf_dir, "company").select("symbol", *(F.round(c, 6).alias(c) for c in ("short_float", "institutions", "insiders")))
    shorts = E.short_changes(view(spark, sf_dir, "shorts")).groupBy("symbol").agg(F.round(F.max_by("short_change", "d"), 6).alias("short_change"))
    flow = flow.join(shorts, "symbol", "left")
    said = _said(spark, sf_dir).select("symbol", "messages", "bullish_share", "bearish_share")
    return K.event_bundle(view(spark, sf_dir, "sectors").select("symbol"), _news(spark, sf_dir), flow, said)


def dom38_candidates(spark, sf_dir):
    macro = view(spark, sf_dir, "macro_state")
    got = K.candidate_table(O.spread_scan(view(spark, sf_dir, "chain")).drop("place"), macro, "bullish")
    return got.select("underlying", "place", "kind", "low_strike", F.round("edge", 6).alias("edge"), "macro_tag", "caveat")


def top10_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return K.latest_of(e, "user_id", F.col("event_type") == "error", "event_id")


def fil01_valid_bars(spark, sf_dir):
    b = held(view(spark, sf_dir, "bars")).withColumn("close", F.when(F.dayofmonth("d") % 10 != 3, F.col("close")))
    whole = K.valid_bars(b).groupBy("symbol").agg(F.count("*").alias("whole"))
    return whole.join(K.valid_bars(b, True).groupBy("symbol").agg(F.count("*").alias("trimmed"), F.max("d").alias("end")), "symbol", "left")


def fil02_history_gates(spark, sf_dir):
    return K.history_gates(held(view(spark, sf_dir, "bars")))


def fil09_of_handle(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("https://x.com/User"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "click", "/status/").otherwise("/likes/"), F.col("event_id").cast("string")).alias("url"), F.concat(F.lit("user"), (F.col("event_id") % 7).cast("string")).alias("handle"))
    return K.of_handle(e, F.col("handle")).select("event_id", "url")


def fil10_dated_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("folder"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("2024-13-45")).when(F.col("o_orderkey") % 7 == 0, "notes").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("name"), (F.col("o_orderkey") % 3).alias("size"), "o_orderkey")
    return K.dated_documents(o.groupBy("folder", "name").agg(F.max("size").alias("size"))).select("folder", "name", "place")


def joi18_tickers(spark, sf_dir):
    listing = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cusip"), F.col("p_brand").alias("ticker"))
    return K.with_tickers(view(spark, sf_dir, "holdings"), listing).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


def joi02_sectors(spark, sf_dir):
    known = view(spark, sf_dir, "sectors").where("sector < 8").select("symbol", F.concat(F.lit("ETF"), F.col("sector").cast("string")).alias("etf"), F.concat(F.lit("sector "), F.col("sector").cast("string")).alias("sector_name"))
    return S.with_sector(view(spark, sf_dir, "sectors").select("symbol"), known)


def dom43_probes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, ("apex", "www", "sitemap", "favicon", "page")))
    status = F.array(*map(F.lit, (200, 200, 200, 301, 404, 403, 500, 0)))
    body = F.when(F.col("event_id") % 4 == 0, "id=G-G-AB1").when(F.col("event_id") % 4 == 1, "a Challenge").otherwise("")
    return K.probe_findings(e.select((F.col("user_id") % 50).alias("site"), kinds[(F.col("event_id") % 5).cast("int")].alias("kind"), F.col("event_id").cast("string").alias("url"), status[(F.col("event_id") % 8).cast("int")].alias("status"), body.alias("body")))


def dom18_pattern_states(spark, sf_dir):
    return C.patterns_now(held(view(spark, sf_dir, "bars")))


def dom16_triangle_states(spark, sf_dir):
    return C.triangles(held(view(spark, sf_dir, "bars")))


def dom17_rectangle_states(spark, sf_dir):
    return C.rectangles(held(view(spark, sf_dir, "bars")))


def dom19_flag_states(spark, sf_dir):
    return C.flags(held(view(spark, sf_dir, "bars")))


def dom14_trend_record(spark, sf_dir):
    return C.trend_record(held(view(spark, sf_dir, "bars")))


def _jumpy(spark, sf_dir):
    """Bars whose opens leave the close before on some days."""
    jump = F.when(F.dayofmonth("d") == 7, 1.03).when(F.dayofmonth("d") == 19, 0.97).otherwise(1.0)
    return held(view(spark, sf_dir, "bars")).withColumn("open", F.round(F.col("open") * jump, 4))


def win19_gap_zones(spark, sf_dir):
    return C.gap_zones(_jumpy(spark, sf_dir), 250)


def dom15_sr_levels(spark, sf_dir):
    return C.support_and_resistance(_jumpy(spark, sf_dir))


def dom21_chart_total(spark, sf_dir):
    return C.chart_scores(view(spark, sf_dir, "bars"))


QUERIES = {f.__name__: f for f in (dom14_trend_record, win19_gap_zones, dom15_sr_levels, dom21_chart_total, dom16_triangle_states, dom17_rectangle_states, dom18_pattern_states, dom19_flag_states, dom30_eight_pillars, dat06_event_risk, dom31_macro_regime, dom34_flow, dom32_assessment, dom12_benchmark_regime, dom13_monitor, agg21_news, agg20_combined_sentiment, dom35_event_bundle, dom38_candidates, top10_latest, fil01_valid_bars, fil02_history_gates, fil09_of_handle, fil10_dated_documents, joi18_tickers, joi02_sectors, dom43_probes)}

_V = ", ".join(f"('{p}', '{s}', '{f}', {c!r}, {k!r})" for p, s, f, c, k in COMPONENTS)
_CL = lambda x, lo="-1", hi="1": f"CASE WHEN {x} IS NOT NULL THEN GREATEST(LEAST({x}, {hi}), {lo}) END"
_LASTS = "(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY d DESC) AS n_ FROM sf) q WHERE n_ = 1)"
_PS = _SERF + f""", comps(pillar, series_id, feature, centre, scale) AS (VALUES {_V}), lf AS ({' UNION ALL '.join(f"SELECT series_id, '{f}' AS feature, {f} AS value FROM {_LASTS} z" for f in ('ma_distance', 'change3', 'yoy', 'z'))}),
cx AS (SELECT pillar, c.series_id || ':' || c.feature AS component, {_CL('(value - centre) * scale')} AS x FROM comps c LEFT JOIN lf ON c.series_id = lf.series_id AND c.feature = lf.feature),
p0 AS (SELECT pillar, ROUND(COALESCE(AVG(x), 0), 6) AS score, COUNT(x) AS n, COALESCE(STRING_AGG(DISTINCT CASE WHEN x IS NULL THEN component END, ' ' ORDER BY CASE WHEN x IS NULL THEN component END), '') AS missing FROM cx GROUP BY 1),
ps AS (SELECT pillar, score, CASE WHEN n = 0 THEN 'unavailable' WHEN score > 0.20 THEN 'improving' WHEN score < -0.20 THEN 'deteriorating' ELSE 'neutral' END AS state, CASE WHEN n = 0 THEN 0E0 WHEN missing <> '' THEN 5E-1 ELSE 8E-1 END AS confidence, missing FROM p0)"""
_Z = {n: " + ".join([repr(c), *(f"{w!r} * COALESCE({k}, 0)" for k, w in lin.items()), *(f"{w!r} * ABS(COALESCE({k}, 0))" for k, w in ab.items())]) for n, (lin, ab, c) in K.LOGITS.items()}
_RISK = "o AS (SELECT CAST(o_orderdate AS DATE) AS d, MIN(o_orderkey) AS k FROM orders GROUP BY 1), c AS (SELECT d, 'event ' || CAST(k AS VARCHAR) AS label, k % 3 = 0 AS high, d - (SELECT CAST(MAX(d) - 20 AS DATE) FROM o) AS ahead FROM o), r AS (SELECT COUNT(CASE WHEN ahead BETWEEN 0 AND 7 AND high THEN 1 END) AS high, ARG_MIN(label, (d, label)) FILTER (WHERE ahead >= 0) AS next, CAST(MIN(CASE WHEN ahead >= 0 THEN ahead END) AS INT) AS days_to_next FROM c)"
_P = [f"{k}" for k in K.LOGITS]
_FALLS = "[x FOR x IN [CASE WHEN D IS NOT NULL THEN GREATEST(-D, 0) END, CASE WHEN E IS NOT NULL THEN GREATEST(-E, 0) END, " + _CL("(level - 14) / 20", "0", "1") + "] IF x IS NOT NULL]"
_NEWS = f""", tk AS (SELECT symbol, text, REGEXP_EXTRACT_ALL(LOWER(COALESCE(text, '')), '[a-z]+') AS t FROM messages), ts AS (SELECT symbol, text, LEN([w FOR w IN t IF w IN ({', '.join(f"'{w}'" for w in UP)})]) AS u, LEN([w FOR w IN t IF w IN ({', '.join(f"'{w}'" for w in DOWN)})]) AS dn FROM tk),
news AS (SELECT symbol, COUNT(*) AS news_count, ROUND(AVG(CASE WHEN COALESCE(text, '') <> '' THEN CASE WHEN u + dn > 0 THEN (u - dn) / (u + dn) ELSE 0 END END), 6) AS news_sentiment FROM ts GROUP BY 1)"""
_SHORT = "-0.5 * short_change + COALESCE(short_float, 0) - 0.05"
def _states(top: bool) -> str:
    """The doubles and heads of a side, by looking at all bars between the swings."""
    side, far, flag = ("high", "MIN(b.low)", "is_high") if top else ("low", "MAX(b.high)", "is_low")
    t = "t" if top else "b"
    edge = "GREATEST(p1, p2)" if top else "LEAST(p1, p2)"
    sign = (lambda a, b: f"{a} - {b}") if top else (lambda a, b: f"{b} - {a}")
    broken = f"spot < neck * {1 - C.BREAK}" if top else f"spot > neck * {1 + C.BREAK}"
    fail_d = f"spot > p2 * {1 - C.BREAK}" if top else f"spot < p2 * {1 + C.BREAK}"
    fail_h = f"spot > p3 * {1 + C.BREAK}" if top else f"spot < p3 * {1 - C.BREAK}"
    beyond = "p2 > p1 AND p2 > p3" if top else "p2 < p1 AND p2 < p3"
    names = ("double_top", "head_and_shoulders") if top else ("double_bottom", "inverse_head_and_shoulders")
    k = "1.02" if top else "0.98"
    out = lambda name, failed, stop, depth, src: f"SELECT symbol, '{name}' AS pattern, CASE WHEN {broken} AND loud THEN 'confirmed' WHEN {broken} THEN 'developing' WHEN {failed} THEN 'failed' ELSE 'developing' END AS state, ROUND(neck, 6) AS trigger, ROUND({stop}, 6) AS stop, ROUND(neck {'-' if top else '+'} ({depth}), 6) AS target, ROUND(({depth}) / neck * 100, 6) AS range_pct, loud AS volume_confirmed, CAST(duration AS INT) AS duration FROM {src}"
    return f""", s{t} AS (SELECT symbol, d, rn, {side} AS v FROM sn WHERE {flag}),
d{t} AS (SELECT a.symbol, a.rn AS r1, c.rn AS r2, a.v AS p1, c.v AS p2, c.rn - a.rn AS duration, n, spot, loud FROM (SELECT *, LEAD(rn) OVER (PARTITION BY symbol ORDER BY rn) AS nx FROM s{t}) a JOIN s{t} c ON a.symbol = c.symbol AND c.rn = nx JOIN lst ON lst.symbol = a.symbol WHERE a.rn >= n - {C.DOUBLE_BACK - 1} AND c.rn - a.rn >= {C.DOUBLE_SEPARATION} AND ABS(a.v - c.v) / ((a.v + c.v) / 2) <= {C.DOUBLE_TOLERANCE}),
d1{t} AS (SELECT x.*, (SELECT {far} FROM sn b WHERE b.symbol = x.symbol AND b.rn BETWEEN r1 AND r2) AS neck FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY r2) AS k_ FROM d{t}) x WHERE k_ = 1),
h{t} AS (SELECT a.symbol, a.rn AS r1, e.rn AS r3, a.v AS p1, c.v AS p2, e.v AS p3, e.d - a.d AS duration, n, spot, loud FROM (SELECT *, LEAD(rn) OVER (PARTITION BY symbol ORDER BY rn) AS nx, LEAD(rn, 2) OVER (PARTITION BY symbol ORDER BY rn) AS nx2 FROM s{t}) a JOIN s{t} c ON a.symbol = c.symbol AND c.rn = nx JOIN s{t} e ON a.symbol = e.symbol AND e.rn = nx2 JOIN lst ON lst.symbol = a.symbol WHERE a.rn >= n - {C.HEAD_BACK - 1} AND c.rn - a.rn >= {C.HEAD_SEPARATION} AND e.rn - c.rn >= {C.HEAD_SEPARATION} AND ABS(e.v - a.v) / ((e.v + a.v) / 2) <= {C.HEAD_TOLERANCE} AND e.d - a.d >= {C.HEAD_DAYS} AND ({beyond.replace('p1', 'a.v').replace('p2', 'c.v').replace('p3', 'e.v')})),
h1{t} AS (SELECT x.*, (SELECT {far} FROM sn b WHERE b.symbol = x.symbol AND b.rn BETWEEN r1 AND r3) AS neck FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY r3) AS k_ FROM h{t}) x WHERE k_ = 1),
st{t} AS ({out(names[0], fail_d, f'{edge} * {k}', sign(edge, 'neck'), f'd1{t}')} UNION ALL {out(names[1], fail_h, f'p3 * {k}', sign('p2', 'neck'), f'h1{t}')})"""


_STATES = f", sn AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn FROM {_SWINGS}), lst AS (SELECT symbol, rn AS n, close AS spot, volume / NULLIF(v20, 0) >= {C.VOLUME} AS loud FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age, AVG(volume) {_rows(20)} AS v20 FROM sn) q WHERE age = 1)" + _states(True) + _states(False) + ", states AS (SELECT * FROM stt UNION ALL SELECT * FROM stb)"
def _side(col: str, flag: str, k: str, touches: int) -> str:
    return f"{k}s AS (SELECT symbol, COUNT(*) AS {k}_n, REGR_SLOPE({col}, CAST(rn AS DOUBLE)) AS {k}_slope, MIN(rn) AS {k}_rn, ARG_MIN({col}, rn) AS {k}_first, AVG({col}) AS {k}_mean, MAX({col}) AS {k}_max, MIN({col}) AS {k}_min, MIN(d) AS {k}_d0, MAX(d) AS {k}_d1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY rn DESC) AS i FROM (SELECT sn.* EXCLUDE (n), lst.n FROM sn JOIN lst ON sn.symbol = lst.symbol WHERE rn >= lst.n - 89) w WHERE {flag}) v WHERE i <= {touches + 2} GROUP BY 1 HAVING COUNT(*) >= {touches})"


def _around(touches: int) -> str:
    """Common table expressions with a: both sides' swings, the last bar, and deviations inside and before."""
    return f""", sn AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, close / LAG(close) OVER ({W}) - 1 AS ret, AVG(volume) {_rows(5)} <= 0.7 * AVG(volume) {_rows(20)} AS calm, volume / NULLIF(AVG(volume) {_rows(20)}, 0) AS rvol FROM {_SWINGS}),
lst AS (SELECT symbol, rn AS n, close AS spot, rvol, COALESCE(rvol >= {C.VOLUME}, FALSE) AS loud, calm AS contraction FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM sn) q WHERE age = 1),
{_side('high', 'is_high', 'u', touches)}, {_side('low', 'is_low', 'l', touches)},
rv AS (SELECT sn.symbol, STDDEV_SAMP(CASE WHEN rn >= u_rn THEN ret END) * SQRT(252) AS inside, STDDEV_SAMP(CASE WHEN rn < u_rn THEN ret END) * SQRT(252) AS outside FROM sn JOIN us ON sn.symbol = us.symbol GROUP BY 1),
a AS (SELECT us.*, ls.* EXCLUDE (symbol), n, spot, rvol, loud, contraction, inside, outside FROM us JOIN ls ON us.symbol = ls.symbol JOIN lst ON us.symbol = lst.symbol JOIN rv ON us.symbol = rv.symbol)"""


def _shape(src: str, pattern: str, times: float, failed: str, confirmed: str, width: str, contracting: str) -> str:
    """src has up, trigger, stop, spot and loud."""
    beyond = f"CASE WHEN up THEN spot >= trigger * {1 + C.BREAK} ELSE spot <= trigger * {1 - C.BREAK} END"
    return f"SELECT symbol, {pattern} AS pattern, CASE WHEN up THEN 'up' ELSE 'down' END AS direction, CASE WHEN {failed} THEN 'failed' WHEN {beyond} AND loud THEN 'confirmed' ELSE 'developing' END AS state, ROUND(trigger, 6) AS trigger, ROUND(stop, 6) AS stop, ROUND(CASE WHEN up THEN trigger + (trigger - stop) * {times} ELSE trigger - (stop - trigger) * {times} END, 6) AS target, ROUND({width} * 100, 6) AS range_pct, {confirmed} AS volume_confirmed, CASE WHEN {contracting} THEN 'contracting' ELSE 'stable' END AS volatility FROM {src}"


_TRIANGLES = _around(C.TRIANGLE_TOUCHES) + f""", k AS (SELECT *, u_first + u_slope * (n - u_rn) AS un, l_first + l_slope * (n - l_rn) AS ln, CASE WHEN u_slope < 0 AND l_slope > 0 THEN 'ascending_triangle' WHEN u_slope > 0 AND l_slope < 0 THEN 'descending_triangle' WHEN ABS(u_slope) < ABS(l_slope) * 0.5 AND l_slope > 0 OR ABS(l_slope) < ABS(u_slope) * 0.5 AND u_slope < 0 THEN 'symmetrical_triangle' END AS kind,
 CASE WHEN u_slope < 0 AND l_slope > 0 THEN TRUE WHEN u_slope > 0 AND l_slope < 0 THEN FALSE ELSE ABS(u_slope) < ABS(l_slope) * 0.5 AND l_slope > 0 END AS up, (u_max - l_min) / ((u_max + l_min) / 2) AS width FROM a WHERE u_d1 - u_d0 >= {C.TRIANGLE_DAYS}),
t AS (SELECT *, CASE WHEN up THEN un ELSE ln END AS trigger, CASE WHEN up THEN ln ELSE un END AS stop FROM k WHERE kind IS NOT NULL AND width <= {C.TRIANGLE_RANGE}) """ + _shape("t", "kind", 1.5, f"CASE WHEN up THEN spot < ln * {1 - C.BREAK} ELSE spot > un * {1 + C.BREAK} END", "loud", "width", "COALESCE(inside < outside * 0.85, FALSE)")
_RECTANGLES = _around(C.RECTANGLE_TOUCHES) + f""", k AS (SELECT *, CASE WHEN spot >= u_mean * {1 + C.BREAK} THEN TRUE WHEN spot <= l_mean * {1 - C.BREAK} THEN FALSE ELSE spot > (u_mean + l_mean) / 2 END AS up FROM a WHERE u_d1 - u_d0 >= {C.RECTANGLE_DAYS} AND u_mean > l_mean AND COALESCE(inside, 0) <= {C.RECTANGLE_SD}),
t AS (SELECT *, CASE WHEN up THEN u_mean ELSE l_mean END AS trigger, CASE WHEN up THEN l_mean ELSE u_mean END AS stop FROM k) """ + _shape("t", "'rectangle'", 1.0, "FALSE", f"COALESCE(contraction OR rvol >= {C.VOLUME}, FALSE)", "(u_mean - l_mean) / ((u_mean + l_mean) / 2)", "COALESCE(contraction, FALSE)")
_FLAGS = f""", sn AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, close / LAG(close) OVER ({W}) - 1 AS ret, volume / NULLIF(AVG(volume) {_rows(20)}, 0) AS rvol FROM bars),
lst AS (SELECT symbol, rn AS n, close AS spot, COALESCE(rvol >= {C.VOLUME}, FALSE) AS loud FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM sn) q WHERE age = 1 AND rn >= 30),
se AS (SELECT s.symbol, s.rn AS s, e.rn AS e, e.close / s.close - 1 AS move, n, spot, loud FROM lst JOIN sn s ON s.symbol = lst.symbol AND s.rn BETWEEN n - 29 AND n - 5 JOIN sn e ON e.symbol = s.symbol AND e.rn BETWEEN s.rn + 5 AND s.rn + 10 AND e.rn <= n - 5 WHERE ABS(e.close / s.close - 1) >= {C.FLAG_IMPULSE} AND n - e.rn + 1 BETWEEN 5 AND {C.FLAG_LONGEST}),
sd AS (SELECT se.*, (SELECT STDDEV_SAMP(ret) FROM sn b WHERE b.symbol = se.symbol AND b.rn > e) AS calm, (SELECT STDDEV_SAMP(ret) FROM sn b WHERE b.symbol = se.symbol AND b.rn > s AND b.rn < e) AS wild FROM se),
f0 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY s, e) AS k_ FROM sd WHERE calm < wild * {C.FLAG_CALM}) x WHERE k_ = 1),
f1 AS (SELECT f.symbol, ANY_VALUE(move) AS move, ANY_VALUE(spot) AS spot, ANY_VALUE(loud) AS loud, MAX(b.high) AS hi, MIN(b.low) AS lo, REGR_SLOPE(b.close, CAST(b.rn AS DOUBLE)) AS slope FROM f0 f JOIN sn b ON b.symbol = f.symbol AND b.rn >= f.e GROUP BY 1),
t AS (SELECT *, move > 0 AS up, CASE WHEN move > 0 THEN hi ELSE lo END AS trigger, CASE WHEN move > 0 THEN lo ELSE hi END AS stop FROM f1) """ + _shape("t", "CASE WHEN up THEN 'bull_' ELSE 'bear_' END || CASE WHEN ABS(slope) < (hi - lo) / 2 THEN 'flag' ELSE 'pennant' END", 1.5, "FALSE", "loud", "(hi - lo) / spot", "TRUE")
_TREND = f""", sx AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn FROM {_SWINGS}), sy AS (SELECT *, CAST(rn AS DOUBLE) AS x, MAX(rn) OVER (PARTITION BY symbol) AS last_rn FROM sx),
sl AS (SELECT * FROM (SELECT symbol, d, rn, last_rn, close, {_full('AVG(close) ' + _rows(20), 20)} AS ma20, {_full('AVG(close) ' + _rows(50), 50)} AS ma50, {_full('AVG(close) ' + _rows(200), 200)} AS ma200, {_full('REGR_SLOPE(close, x) ' + _rows(60), 60)} / AVG(close) {_rows(60)} * 100 AS slope, {_full('REGR_R2(close, x) ' + _rows(60), 60)} AS r2 FROM sy) q WHERE rn = last_rn),
sh AS (SELECT symbol, COUNT(CASE WHEN high > p THEN 1 END) AS hh FROM (SELECT symbol, high, LAG(high) OVER ({W}) AS p FROM sy WHERE is_high AND rn > last_rn - 60) q GROUP BY 1), sw AS (SELECT symbol, COUNT(CASE WHEN low > p THEN 1 END) AS hl FROM (SELECT symbol, low, LAG(low) OVER ({W}) AS p FROM sy WHERE is_low AND rn > last_rn - 60) q GROUP BY 1),
sr AS (SELECT sl.symbol, d, close, ma20, ma50, ma200, CAST(COALESCE(hh, 0) + COALESCE(hl, 0) AS INT) AS higher, ROUND(COALESCE(slope, 0), 6) AS slope, ROUND(COALESCE(r2, 0), 6) AS r2, CASE WHEN ma200 IS NOT NULL THEN CASE WHEN close > ma20 AND ma20 > ma50 AND ma50 > ma200 THEN 'bullish_20_50_200' WHEN close < ma20 AND ma20 < ma50 AND ma50 < ma200 THEN 'bearish_20_50_200' WHEN ma20 > ma50 AND ma50 > ma200 THEN 'bullish_partial' WHEN ma20 < ma50 AND ma50 < ma200 THEN 'bearish_partial' ELSE 'mixed' END
 WHEN ma20 > ma50 THEN 'bullish_partial' WHEN ma20 < ma50 THEN 'bearish_partial' ELSE 'mixed' END AS alignment FROM sl LEFT JOIN sh ON sh.symbol = sl.symbol LEFT JOIN sw ON sw.symbol = sl.symbol),
record AS (SELECT symbol, d, CASE WHEN alignment = 'bullish_20_50_200' OR slope > 0.05 AND higher >= 2 THEN 'up' WHEN alignment = 'bearish_20_50_200' OR slope < -0.05 AND higher <= 1 THEN 'down' ELSE 'sideways' END AS direction, alignment, higher, slope, r2, COALESCE(close > ma20, FALSE) AS above_20, COALESCE(close > ma50, FALSE) AS above_50, COALESCE(close > ma200, FALSE) AS above_200 FROM sr)"""
_JUMP = ", jb AS (SELECT * REPLACE (ROUND(open * CASE DAY(d) WHEN 7 THEN 1.03E0 WHEN 19 THEN 0.97E0 ELSE 1E0 END, 4) AS open) FROM bars)"
_ZONES = lambda src, back: f""", gz AS (SELECT symbol, d, open, LAG(close) OVER ({W}) AS before, MIN(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS la, MAX(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ha, CAST(COUNT(*) OVER (PARTITION BY symbol) - ROW_NUMBER() OVER ({W}) AS INT) AS age FROM {src}),
zones AS (SELECT symbol, d, CASE WHEN open > before THEN 'up' ELSE 'down' END AS side, LEAST(open, before) AS lower, GREATEST(open, before) AS upper, age FROM gz WHERE age < {back - 1} AND (open > before * 1.005 AND COALESCE(la > before, TRUE) OR open < before * 0.995 AND COALESCE(ha < before, TRUE)))"""  # noqa: E731
_LEVELS = lambda src: _ZONES(src, 60) + f""", q1 AS (SELECT *, COUNT(*) OVER w AS n, MAX(high) OVER w AS hi, MIN(low) OVER w AS lo FROM {src} WINDOW w AS ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
q2 AS (SELECT *, n = 11 AND high >= hi AS is_high, n = 11 AND low <= lo AS is_low, CAST(ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) - 1 AS INT) AS age, LAG(close) OVER ({W}) AS prior, (high + low + close) / 3 AS tp, {_full('AVG(close) ' + _rows(20), 20)} AS ma20, {_full('AVG(close) ' + _rows(50), 50)} AS ma50, {_full('AVG(close) ' + _rows(200), 200)} AS ma200 FROM q1),
e0 AS (SELECT symbol, close AS spot, ma20, ma50, ma200 FROM q2 WHERE age = 0),
w1 AS (SELECT symbol, 'swing_low' AS source, low AS price, age FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM q2 WHERE is_low) z WHERE i <= 10 AND age <= 180 UNION ALL SELECT symbol, 'swing_high', high, age FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM q2 WHERE is_high) z WHERE i <= 10 AND age <= 180),
an AS (SELECT symbol, 'vwap_low252' AS source, ARG_MIN(d, (low, d)) AS since FROM q2 WHERE age < 252 GROUP BY symbol UNION ALL SELECT symbol, 'vwap_low60', ARG_MIN(d, (low, d)) FROM q2 WHERE age < 60 GROUP BY symbol UNION ALL SELECT symbol, 'vwap_gap', MAX(d) FROM q2 WHERE age < 30 AND open > prior * 1.02 GROUP BY symbol),
av AS (SELECT an.symbol, source, ROUND(SUM(tp * volume) / SUM(volume), 6) AS price, MAX(q2.age) AS age FROM an JOIN q2 ON q2.symbol = an.symbol AND q2.d >= since GROUP BY 1, 2),
vb AS (SELECT *, MIN(low) OVER (PARTITION BY symbol) AS blo, MAX(high) OVER (PARTITION BY symbol) AS bhi, COUNT(*) OVER (PARTITION BY symbol) AS bn FROM q2 WHERE age < {C.NODES_BACK}), vf AS (SELECT symbol, ANY_VALUE(blo) AS blo, ANY_VALUE(bhi) AS bhi, CAST(LEAST(FLOOR((tp - blo) / (bhi - blo) * {C.NODE_BINS}), {C.NODE_BINS - 1}) AS INT) AS bin, SUM(volume) AS v FROM vb WHERE bhi > blo AND bn >= {C.NODES_BACK} GROUP BY symbol, 4),
vg AS (SELECT s.symbol, s.blo, s.bhi, r.bin, COALESCE(vf.v, 0) AS v FROM (SELECT DISTINCT symbol, blo, bhi FROM vf) s CROSS JOIN (SELECT UNNEST(RANGE({C.NODE_BINS})) AS bin) r LEFT JOIN vf ON vf.symbol = s.symbol AND vf.bin = r.bin),
vh AS (SELECT *, v >= 1.5 * AVG(v) OVER (PARTITION BY symbol) AND v >= LAG(v) OVER (PARTITION BY symbol ORDER BY bin) AND v >= LEAD(v) OVER (PARTITION BY symbol ORDER BY bin) AS node FROM vg),
lv AS (SELECT w1.symbol, source, price, ROUND(1 / GREATEST(age / 30, 0.5), 2) AS strength, age FROM w1 JOIN e0 ON w1.symbol = e0.symbol WHERE source = 'swing_low' AND price < spot OR source = 'swing_high' AND price > spot
 UNION ALL SELECT symbol, 'ma_20', ma20, 0.5, 0 FROM e0 WHERE ma20 IS NOT NULL UNION ALL SELECT symbol, 'ma_50', ma50, 0.5, 0 FROM e0 WHERE ma50 IS NOT NULL UNION ALL SELECT symbol, 'ma_200', ma200, 0.5, 0 FROM e0 WHERE ma200 IS NOT NULL UNION ALL SELECT symbol, source, price, 0.6, age FROM av WHERE price > 0
 UNION ALL SELECT symbol, 'volume_node', blo + (bin + 0.5) * (bhi - blo) / {C.NODE_BINS}, 0.7, 0 FROM vh WHERE node UNION ALL SELECT symbol, 'gap_fill', CASE side WHEN 'up' THEN lower ELSE upper END, 0.6, age FROM zones),
lw AS (SELECT lv.symbol, source, ROUND(price, 4) AS price, CAST(strength AS DOUBLE) AS strength, age, CASE WHEN price < spot THEN 'support' ELSE 'resistance' END AS side, ROUND(ABS(spot - price) / spot * 100, 6) AS distance_pct FROM lv JOIN e0 ON lv.symbol = e0.symbol),
sr_levels AS (SELECT symbol, side, place, source, price, strength, age, distance_pct FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY symbol, side ORDER BY distance_pct, source, price, age) AS INT) AS place FROM lw) z WHERE place <= {C.NEAREST})"""  # noqa: E731
_IN = lambda chain, tail: f"(WITH z0 AS (SELECT 1){chain}{tail})"
_B0 = lambda x: f"GREATEST(LEAST({x}, 100), 0)"
_CHART = f""", c1 AS {_IN(_TREND, ' SELECT * FROM record')}, c2 AS {_IN(_LEVELS('bars'), ' SELECT * FROM sr_levels')}, c3 AS (SELECT symbol, state, volume_confirmed, 'stable' AS volatility FROM {_IN(_STATES, ' SELECT * FROM states')} y UNION ALL SELECT symbol, state, volume_confirmed, volatility FROM {_IN(_TRIANGLES, '')} y UNION ALL SELECT symbol, state, volume_confirmed, volatility FROM {_IN(_RECTANGLES, '')} y UNION ALL SELECT symbol, state, volume_confirmed, volatility FROM {_IN(_FLAGS, '')} y),
d1 AS (SELECT symbol, {_B0(_B0("CASE WHEN direction = 'up' AND alignment = 'bullish_20_50_200' THEN 95 WHEN direction = 'up' THEN 75 WHEN direction = 'down' AND alignment = 'bearish_20_50_200' THEN 5 WHEN direction = 'down' THEN 25 ELSE 50 END + (r2 - 0.5) * 20") + ' + LEAST(higher, 4) * 2.5')} AS trend FROM c1),
d2 AS (SELECT symbol, {_B0("50 + COUNT(CASE WHEN distance_pct <= 5 THEN 1 END) * 5 - COUNT(CASE WHEN side = 'support' THEN 1 END) * 2 + CASE WHEN BOOL_OR(side = 'support' AND place = 1 AND distance_pct <= 3 AND strength >= 0.6) THEN 15 ELSE 0 END")} AS levels FROM c2 GROUP BY 1),
v0 AS (SELECT *, SUM(mf) OVER ({W}) AS ad, CAST(ROW_NUMBER() OVER ({W}) AS DOUBLE) AS rn FROM (SELECT *, CASE WHEN high - low > 0 THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END AS mf FROM bars) z),
v1 AS (SELECT symbol, d, volume / GREATEST(AVG(volume) {_rows(20)}, 1) AS rvol, AVG(volume) {_rows(5)} / GREATEST(AVG(volume) {_rows(20)}, 1) <= 0.7 AS contraction, ROUND({_full(f'REGR_SLOPE(ad, rn) {_rows(20)} / AVG(volume) {_rows(20)}', 20)}, 5) AS slope, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM v0),
d3 AS (SELECT symbol, {_B0(f"50 + CASE WHEN rvol >= {C.EXPANSION} THEN 15 ELSE 0 END + CASE WHEN contraction THEN 10 ELSE 0 END + CASE WHEN slope > 0 THEN 15 WHEN slope < 0 THEN -10 ELSE 0 END - CASE WHEN rvol < 0.7 THEN 10 ELSE 0 END")} AS volume FROM v1 WHERE age = 1),
d4 AS (SELECT symbol, BOOL_OR(state = 'confirmed') AS cf, BOOL_OR(state = 'developing') AS dv, BOOL_OR(state = 'failed') AS fl, BOOL_OR(volatility = 'contracting') AS ct, BOOL_OR(volume_confirmed) AS ld FROM c3 GROUP BY 1),
d5 AS (SELECT d1.symbol, trend, COALESCE(levels, 50) AS levels, COALESCE(volume, 50) AS volume, CASE WHEN cf THEN 90 WHEN ct THEN 75 ELSE 40 END AS volatility, CASE WHEN cf THEN 95 WHEN dv THEN 60 ELSE 30 END AS b0, fl, ld FROM d1 LEFT JOIN d2 ON d2.symbol = d1.symbol LEFT JOIN d3 ON d3.symbol = d1.symbol LEFT JOIN d4 ON d4.symbol = d1.symbol),
d6 AS (SELECT *, CASE WHEN ld THEN LEAST(CASE WHEN fl THEN GREATEST(b0 - 20, 10) ELSE b0 END + 10, 100) ELSE CASE WHEN fl THEN GREATEST(b0 - 20, 10) ELSE b0 END END AS breakout FROM d5), d7 AS (SELECT *, ROUND({' + '.join(f'{w} * {k}' for k, w in C.WEIGHTS.items())}, 6) AS total FROM d6)
SELECT symbol, {', '.join(f'ROUND(CAST({k} AS DOUBLE), 6) AS {k}' for k in C.WEIGHTS)}, CAST(total AS DOUBLE) AS total, CASE WHEN total >= 80 THEN 'A+' WHEN total >= 65 THEN 'A' WHEN total >= 50 THEN 'B' WHEN total >= 35 THEN 'C' ELSE 'D' END AS grade FROM d7"""
_SAID = f""", m0 AS (SELECT symbol, source, {_CLS} AS cls FROM (SELECT symbol, source, {_UD} FROM messages) q), m1 AS (SELECT symbol, source, COUNT(*) AS n, COUNT(CASE WHEN cls = 'bullish' THEN 1 END) AS bull, COUNT(CASE WHEN cls = 'bearish' THEN 1 END) AS bear FROM m0 GROUP BY 1, 2),
said AS (SELECT symbol, CAST(SUM(n) AS BIGINT) AS messages, COUNT(*) AS sources, ROUND(SUM(bull) / SUM(n), 6) AS bullish_share, ROUND(SUM(bear) / SUM(n), 6) AS bearish_share, ROUND(AVG(bull / n), 6) AS combined_bullish FROM m1 GROUP BY 1)"""
ORACLE_SQL = {
    "dom14_trend_record": oracle("bars", _TREND + " SELECT * FROM record"),
    "win19_gap_zones": oracle("bars", _JUMP + _ZONES("jb", 250) + " SELECT * FROM zones"),
    "dom15_sr_levels": oracle("bars", _JUMP + _LEVELS("jb") + " SELECT * FROM sr_levels"),
    "dom21_chart_total": oracle("bars", _CHART),
    "dom16_triangle_states": oracle("bars", _TRIANGLES),
    "dom17_rectangle_states": oracle("bars", _RECTANGLES),
    "dom19_flag_states": oracle("bars", _FLAGS),
    "dom18_pattern_states": oracle("bars", _STATES + " SELECT * FROM states"),
    "dom30_eight_pillars": oracle("series", _PS + " SELECT * FROM ps"),
    "dat06_event_risk": f"WITH {_RISK} SELECT ROUND(GREATEST(-0.15 * high, -1), 6) AS score, high, next, days_to_next, CASE WHEN ROUND(GREATEST(-0.15 * high, -1), 6) < -0.05 THEN 'deteriorating' ELSE 'neutral' END AS state FROM r",
    "dom31_macro_regime": oracle("series macro_state", _PS + f""", w AS (SELECT {', '.join(f"MAX(CASE WHEN pillar = '{k}' THEN score END) AS {k}" for k in K.PILLARS)}, COUNT(CASE WHEN state <> 'unavailable' THEN 1 END) AS available FROM ps), v AS (SELECT w.*, bear_risk * 40 AS level FROM w CROSS JOIN macro_state),
e AS (SELECT *, {', '.join(f'EXP({z}) AS {n}' for n, z in _Z.items())} FROM v), q AS (SELECT *, {' + '.join(_P)} AS total_ FROM e),
b AS (SELECT *, CASE GREATEST({', '.join(_P)}) {' '.join(f"WHEN {n} THEN '{n}'" for n in _P)} END AS regime, ROUND(COALESCE(LIST_SUM({_FALLS}) / NULLIF(LEN({_FALLS}), 0), 0), 6) AS bear_risk FROM q)
SELECT regime, {', '.join(f'ROUND({n} / total_, 6) AS p_{n}' for n in _P)}, ROUND(1 + ({' + '.join(f'{n} / total_ * LN({n} / total_)' for n in _P)}) / LN(5E0), 6) AS confidence, ROUND({' + '.join(f'{x} * COALESCE({k}, 0)' for k, x in K.PILLARS.items())}, 6) AS composite, bear_risk,
 CASE WHEN bear_risk < 0.20 THEN 'low' WHEN bear_risk < 0.45 THEN 'moderate' WHEN bear_risk < 0.65 THEN 'elevated' ELSE 'high' END AS bear_level, CONCAT_WS('; ', {', '.join(f"CASE WHEN regime IN ('bear_risk_elevated', 'risk_off') AND COALESCE({k}, 0) > 0.1 THEN '{k} argues risk_on' END" for k in 'DE')}, {', '.join(f"CASE WHEN regime IN ('risk_on', 'fragile_risk_on') AND COALESCE({k}, 0) < -0.2 THEN '{k} deteriorating' END" for k in 'ADB')}) AS against,
 CASE WHEN available = 0 THEN 'insufficient' WHEN available < 8 THEN 'partial' ELSE 'complete' END AS completeness, CASE WHEN available < 6 THEN 'preliminary' ELSE 'calibrating' END AS status FROM b"""),
    "dom34_flow": oracle("company", f""", c AS (SELECT *, CASE WHEN short_float > 0.1 THEN profit_margin * 10 - roa END AS short_change, target / 120 - 1 AS upside FROM company), s AS (SELECT symbol, short_float, institutions, {_CL(_SHORT)} AS s, {_CL('0.5 * short_change + COALESCE(short_float, 0) - 0.05')} AS s2, {_CL('(institutions - 0.5) * 2')} AS o, {_CL('((3.5 - analyst_rating) / 2.5 + upside) * 0.7')} AS a FROM c)
SELECT symbol, CASE WHEN short_float > 0.10 THEN 'heavy_short_pressure' WHEN short_float > 0.05 THEN 'moderate_short' WHEN short_float > 0.02 THEN 'light_short' WHEN short_float IS NOT NULL THEN 'minimal_short' END AS short_class, CASE WHEN institutions > 0.80 THEN 'very_high_inst' WHEN institutions > 0.60 THEN 'high_inst' WHEN institutions > 0.30 THEN 'moderate_inst' WHEN institutions IS NOT NULL THEN 'low_inst' END AS owner_class,
 ROUND(s, 6) AS short_score, ROUND(s2, 6) AS short_score_consistent, ROUND(o, 6) AS owner_score, ROUND(a, 6) AS analyst_score, ROUND((COALESCE(s * -0.3, 0) + COALESCE(o * 0.2, 0) + COALESCE(a * 0.5, 0)) / NULLIF(CASE WHEN s IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN o IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN a IS NOT NULL THEN 0.5 ELSE 0 END, 0), 6) AS flow FROM s"""),
    "dom32_assessment": oracle("bars", RET + f""", v AS (SELECT symbol, d, close, {_full('STDDEV_SAMP(logret) ' + _rows(20), 20, 'logret')} * SQRT(252) AS v20, {_full('STDDEV_SAMP(logret) ' + _rows(60), 60, 'logret')} * SQRT(252) AS v60, {_full('AVG(close) ' + _rows(20), 20)} AS ma20, {_full('AVG(close) ' + _rows(50), 50)} AS ma50, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM ret)
SELECT symbol, d, ROUND(v20, 6) AS v20, ROUND(v60, 6) AS v60, CASE WHEN v20 IS NULL THEN 'n/a' WHEN v20 < 0.15 THEN 'calm' WHEN v20 < 0.25 THEN 'normal' WHEN v20 < 0.40 THEN 'elevated' ELSE 'stressed' END AS band, CASE WHEN ma50 IS NULL THEN NULL WHEN close > ma20 AND ma20 > ma50 THEN 'uptrend' WHEN close < ma20 AND ma20 < ma50 THEN 'downtrend' ELSE 'range-bound' END AS trend,
 CASE WHEN v20 IS NULL THEN 'unknown' WHEN v20 * 100 < 12 THEN 'extremely_low' WHEN v20 * 100 < 18 THEN 'low' WHEN v20 * 100 < 25 THEN 'normal' WHEN v20 * 100 < 35 THEN 'elevated' ELSE 'stressed' END AS index_band, CASE WHEN v20 * 100 >= 35 THEN 'flat_research_only' WHEN v20 * 100 >= 25 THEN 'cautious' END AS mode FROM v WHERE age = 1"""),
    "dom12_benchmark_regime": oracle("bars market", _BOARD + " SELECT symbol, CASE WHEN trend = 'uptrend' AND close > ma50 AND ret20 > 0 THEN 'risk-on' WHEN trend = 'downtrend' AND close <= ma50 AND ret20 < 0 THEN 'risk-off' ELSE 'neutral' END AS regime FROM board"),
    "dom13_monitor": oracle("bars", """, e AS (SELECT symbol, CAST(REGEXP_EXTRACT(symbol, '([0-9]+)$', 1) AS INT) AS n, ARG_MAX(close, d) AS close, ARG_MIN(close, d) AS ref_price, MAX(high) AS target, ROUND(AVG(close), 6) AS risk_line FROM bars GROUP BY 1),
p AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'OLD-' || symbol WHEN n % 7 = 0 THEN 'X-' || symbol ELSE symbol END AS name, n * 7 % 70 AS probability, n % 4 <> 0 AND n % 7 = 0 AS lost FROM e)
SELECT name AS symbol, CASE WHEN lost THEN name ELSE symbol END AS listed, CASE WHEN NOT lost THEN close END AS close, CASE WHEN NOT lost THEN ROUND(CASE WHEN ABS((close / ref_price - 1) * 100) < 0.05 THEN 0 ELSE (close / ref_price - 1) * 100 END, 6) END AS change, ROUND(CASE WHEN lost THEN 12.5 ELSE (target / close - 1) * 100 END, 6) AS upside,
 CASE WHEN probability >= 50 THEN 'good' WHEN probability >= 35 THEN 'middle' ELSE 'low' END AS chance, CASE WHEN lost THEN 'unknown' WHEN (close / risk_line - 1) * 100 < 0 THEN 'broken' WHEN (close / risk_line - 1) * 100 < 3 THEN 'near' ELSE 'clear' END AS risk, CASE WHEN NOT lost THEN CAST(LENGTH(symbol) AS DOUBLE) END AS score FROM p"""),
    "agg21_news": oracle("messages", _NEWS + " SELECT * FROM news"),
    "agg20_combined_sentiment": oracle("messages", _SAID + " SELECT * FROM said"),
    "dom35_event_bundle": oracle("messages sectors company shorts", _NEWS + _SAID + f", si AS (SELECT symbol, d, shares / NULLIF(LAG(CAST(shares AS DOUBLE)) OVER ({W}), 0) - 1 AS c FROM shorts), sl AS (SELECT symbol, ROUND(c, 6) AS short_change FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM si) q WHERE k = 1) SELECT s.symbol, news_count, news_sentiment, ROUND(short_float, 6) AS short_float, ROUND(institutions, 6) AS institutions, ROUND(insiders, 6) AS insiders, short_change, messages, bullish_share, bearish_share FROM sectors s LEFT JOIN news n ON s.symbol = n.symbol LEFT JOIN company c ON c.symbol = s.symbol LEFT JOIN sl ON sl.symbol = s.symbol LEFT JOIN said m ON m.symbol = s.symbol"),
    "dom38_candidates": oracle("chain macro_state", _SCAN + """, tg AS (SELECT CASE WHEN regime IN ('risk_off', 'bear_risk_elevated') THEN 'counter-regime' ELSE 'aligned' END AS macro_tag FROM macro_state), cd AS (SELECT * FROM scan CROSS JOIN tg WHERE macro_tag <> 'counter-regime' OR ROUND(edge, 6) >= 0.15)
SELECT underlying, CAST(ROW_NUMBER() OVER (PARTITION BY underlying ORDER BY ROUND(edge, 6) DESC, ROUND(pop, 6) DESC, kind, low_strike) AS INT) AS place, kind, low_strike, ROUND(edge, 6) AS edge, macro_tag, CASE WHEN macro_tag = 'counter-regime' THEN 'wider risk bands' ELSE '' END AS caveat FROM cd"""),
    "top10_latest": "SELECT user_id, event_type, MAX(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2",
    "fil01_valid_bars": oracle("bars", ", b AS (SELECT symbol, d, DAY(d) % 10 <> 3 AS ok FROM bars), e AS (SELECT symbol, MAX(CASE WHEN ok THEN d END) AS last_ok, COUNT(CASE WHEN ok THEN 1 END) AS whole FROM b GROUP BY 1) SELECT e.symbol, whole, COUNT(b.d) AS trimmed, MAX(b.d) AS \"end\" FROM e JOIN b ON b.symbol = e.symbol AND b.d <= last_ok GROUP BY 1, 2"),
    "fil02_history_gates": oracle("bars", " SELECT symbol, COUNT(*) AS n, " + ", ".join(f"COUNT(*) >= {n} AS {k}" for k, n in K.HISTORY_GATES.items()) + " FROM bars GROUP BY 1"),
    "fil09_of_handle": "SELECT event_id, 'https://x.com/User' || CAST(user_id AS VARCHAR) || '/status/' || CAST(event_id AS VARCHAR) AS url FROM events WHERE event_type = 'click' AND CAST(user_id AS VARCHAR) = CAST(event_id % 7 AS VARCHAR)",
    "fil10_dated_documents": "WITH f AS (SELECT o_custkey % 20 AS folder, STRFTIME(o_orderdate, '%Y-%m-%d') AS name, MAX(o_orderkey % 3) AS size FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 GROUP BY 1, 2) SELECT folder, name, CAST(ROW_NUMBER() OVER (PARTITION BY folder ORDER BY name DESC) AS INT) AS place FROM f WHERE size > 0",
    "joi18_tickers": oracle("holdings", " SELECT p_brand AS ticker, COUNT(*) AS n, CAST(SUM(shares) AS BIGINT) AS shares FROM holdings LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p_partkey = cusip GROUP BY 1"),
    "joi02_sectors": oracle("sectors", " SELECT symbol, CASE WHEN sector < 8 THEN 'ETF' || CAST(sector AS VARCHAR) ELSE 'SPY' END AS etf, CASE WHEN sector < 8 THEN 'sector ' || CAST(sector AS VARCHAR) ELSE 'Other' END AS sector_name FROM sectors"),
    "dom43_probes": """WITH p AS (SELECT user_id % 50 AS site, CASE event_id % 5 WHEN 0 THEN 'apex' WHEN 1 THEN 'www' WHEN 2 THEN 'sitemap' WHEN 3 THEN 'favicon' ELSE 'page' END AS kind, CAST(event_id AS VARCHAR) AS url, CASE event_id % 8 WHEN 3 THEN 301 WHEN 4 THEN 404 WHEN 5 THEN 403 WHEN 6 THEN 500 WHEN 7 THEN 0 ELSE 200 END AS status, event_id % 4 AS b FROM events),
c AS (SELECT *, CASE WHEN kind = 'apex' AND status = 0 THEN 'live_unreachable' WHEN kind = 'apex' AND status <> 200 AND NOT (status = 403 AND b = 1) THEN 'live_non_200' WHEN kind = 'www' AND status NOT IN (0, 200, 301, 302, 308) THEN 'live_non_200' WHEN kind = 'sitemap' AND status NOT IN (0, 200) THEN 'sitemap_unreachable' WHEN kind = 'favicon' AND status NOT IN (0, 200) THEN 'live_favicon_missing' WHEN kind = 'page' AND status = 200 AND b = 0 THEN 'live_ga4_typo' END AS class FROM p WHERE kind = 'apex' OR site NOT IN (SELECT site FROM p WHERE kind = 'apex' AND status = 0))
SELECT site, class, CASE WHEN class IN ('live_unreachable', 'live_ga4_typo') THEN 'critical' WHEN class = 'live_non_200' THEN 'high' ELSE 'medium' END AS severity, url FROM c WHERE class IS NOT NULL""",
}
