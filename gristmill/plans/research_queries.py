"""Queries of events, structure, regimes and ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import indicators as I, research as R, scoring
from ..sources import ledger as L
from ..sources.views import oracle, table, view
from .indicator_queries import RET, W, _SWINGS, _full, _rows


def _bars(spark, sf_dir):
    return view(spark, sf_dir, "bars")


def _events(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("symbol"), F.to_date("ts").alias("d"), "event_id")


def joi14_event_drift(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    # the events' days of year on the bars' calendar
    e = _events(spark, sf_dir, "purchase").select("symbol", F.date_format("d", "MM-dd").alias("md")).distinct()
    days = bars.select("symbol", "d").withColumn("md", F.date_format("d", "MM-dd")).join(e, ["symbol", "md"], "left_semi")
    return R.event_drift(bars, days)


def agg22_net_revisions(spark, sf_dir):
    up = _events(spark, sf_dir, "signup").withColumn("up", F.lit(True)).union(_events(spark, sf_dir, "error").withColumn("up", F.lit(False)))
    return R.net_revisions(up, F.lit("2024-03-01").cast("date"), 3650)


def top09_next_event(spark, sf_dir):
    return R.next_event(_events(spark, sf_dir, "purchase"), F.lit("2000-01-15").cast("date"))


def dom14_trend_structure(spark, sf_dir):
    return R.trend_structure(_bars(spark, sf_dir))


def dom16_triangles(spark, sf_dir):
    return R.triangles(_bars(spark, sf_dir))


def dom17_rectangles(spark, sf_dir):
    return R.rectangles(_bars(spark, sf_dir))


def dom19_flags(spark, sf_dir):
    return R.flags(_bars(spark, sf_dir))


def dom21_chart_scores(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return R.chart_scores(R.trend_structure(bars), I.swing_counts(bars), I.volume_ratios(bars).select("symbol", "d", "v5_20"))


def dom32_volatility_regime(spark, sf_dir):
    return R.volatility_regime(_bars(spark, sf_dir))


def dom13_watchlist(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    ends = bars.groupBy("symbol").agg(F.max_by("close", "d").alias("close"), F.min_by("close", "d").alias("ref_price"), F.max("high").alias("target"), F.min("low").alias("risk_line"))
    return R.watchlist_monitor(ends.select("symbol", "ref_price", "target", "risk_line"), ends.select("symbol", "close"))


def dom08_sector_fit(spark, sf_dir):
    s = view(spark, sf_dir, "sectors")
    return s.select("symbol", "sector", F.round(scoring.sector_fit(F.col("beta_class"), F.lit(0.35)), 6).alias("fit"))


def dom36_deep_report(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return R.deep_report({"trend": R.trend_structure(bars).select("symbol", "trend"), "rect": R.rectangles(bars).select("symbol", "floor"), "tri": R.triangles(bars).select("symbol", "kind")}, view(spark, sf_dir, "sectors"))


def fil02_history_gate(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return b.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where("n >= 230").groupBy("symbol").agg(F.max("n").alias("n"))


def src02_stale_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("fetched"))
    return L.stale_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), o, "k", "fetched", "2000-01-01 00:00:00", 24 * 90)


def set01_universe(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    low, high = p.where("p_retailprice < 1500"), p.where("p_retailprice >= 1500 or p_retailprice is null")
    return L.universe([x.select(F.col("p_brand").alias("symbol")) for x in (low, high)], p.select(F.col("p_type").alias("symbol")))


def set02_first_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return L.first_of(e, ["user_id", "event_type"], ["event_id"])


def set03_newest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    middle = e.agg(F.avg(F.unix_timestamp("ts")).alias("middle"))  # one row: older events are the cache, later ones are new
    e = e.join(F.broadcast(middle)).select("user_id", "event_id", (F.unix_timestamp("ts") < F.col("middle")).alias("older"))
    old, new = (L.first_of(e.where(c), ["user_id"], ["event_id"]).drop("older") for c in ("older", "not older"))
    return L.newest_wins(old, new, "user_id")


def src14_latest_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("user_id").alias("candidate_id")).distinct()
    actions = e.where("event_type <> 'error'").select(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("label"), F.col("event_id").alias("set_at"))
    actuals = e.where("event_type = 'error'").select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("ts"), "value")
    return L.with_changes(records, actions, actuals).select("candidate_id", "user_action", F.coalesce(F.size("actuals"), F.lit(0)).alias("n_actuals"), F.element_at("actuals", -1)["value"].alias("last_actual"))


QUERIES = {f.__name__: f for f in (joi14_event_drift, agg22_net_revisions, top09_next_event, dom14_trend_structure, dom16_triangles, dom17_rectangles, dom19_flags, dom21_chart_scores, dom32_volatility_regime, dom13_watchlist, dom08_sector_fit, dom36_deep_report, fil02_history_gate, src02_stale_keys, set01_universe, set02_first_of, set03_newest_wins, src14_latest_changes)}

_EV = lambda k: f"(SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS d FROM events WHERE event_type = '{k}')"
_STRUCT = f""", a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age, CAST(ROW_NUMBER() OVER ({W}) AS DOUBLE) AS rn, AVG(close) {_rows(20)} AS ma20, AVG(close) {_rows(50)} AS ma50, AVG(close) {_rows(200)} AS ma200 FROM bars),
b AS (SELECT *, ROUND({_full(f'REGR_SLOPE(close, rn) {_rows(60)} / AVG(close) {_rows(60)} * 100', 60)}, 6) AS slope_pct, ROUND({_full(f'REGR_R2(close, rn) {_rows(60)}', 60)}, 6) AS r2 FROM a),
st AS (SELECT symbol, d, close > ma20 AND ma20 > ma50 AS stacked_up, close < ma20 AND ma20 < ma50 AS stacked_down, close > ma200 AS above_200, slope_pct, r2 FROM b WHERE age = 1),
struct AS (SELECT *, CASE WHEN stacked_up AND slope_pct > 0 THEN 'uptrend' WHEN stacked_down AND slope_pct < 0 THEN 'downtrend' WHEN r2 < 0.3 THEN 'range' ELSE 'transitioning' END AS trend FROM st)"""
_RECT = f""", sw AS (SELECT * FROM {_SWINGS}), h AS (SELECT symbol, COUNT(*) AS n, MIN(high) AS lo, MAX(high) AS hi FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM sw WHERE is_high) x WHERE i <= 2 GROUP BY 1),
l AS (SELECT symbol, COUNT(*) AS n, MIN(low) AS lo, MAX(low) AS hi FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM sw WHERE is_low) x WHERE i <= 2 GROUP BY 1),
rect AS (SELECT h.symbol, l.lo AS floor, h.hi AS ceiling FROM h JOIN l ON h.symbol = l.symbol WHERE h.n = 2 AND l.n = 2 AND h.hi / h.lo - 1 <= 0.03 AND l.hi / l.lo - 1 <= 0.03 AND h.lo > l.hi)"""
_TRI = f""", sr AS (SELECT *, CAST(ROW_NUMBER() OVER ({W}) AS DOUBLE) AS rn FROM {_SWINGS}), th AS (SELECT symbol, ROUND(REGR_SLOPE(high, rn) / AVG(high) * 100, 6) AS hs FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM sr WHERE is_high) x WHERE i <= 5 GROUP BY 1),
tl AS (SELECT symbol, ROUND(REGR_SLOPE(low, rn) / AVG(low) * 100, 6) AS ls FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS i FROM sr WHERE is_low) x WHERE i <= 5 GROUP BY 1),
tri AS (SELECT th.symbol, hs AS high_slope, ls AS low_slope, CASE WHEN ABS(hs) <= 0.02 AND ls > 0.02 THEN 'ascending' WHEN ABS(ls) <= 0.02 AND hs < -0.02 THEN 'descending' WHEN hs < 0 AND ls > 0 THEN 'symmetrical' WHEN hs > 0.02 AND ls > 0.02 THEN 'rising' WHEN hs < -0.02 AND ls < -0.02 THEN 'falling' ELSE 'none' END AS kind FROM th JOIN tl ON th.symbol = tl.symbol)"""
_AHEAD = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)"
_EACH = " UNION ALL ".join(f"SELECT symbol, {n} AS step, ROUND(f{n}, 9) AS r FROM fw" for n in (1, 5, 10))
ORACLE_SQL = {
    "joi14_event_drift": oracle("bars", f", e AS (SELECT DISTINCT symbol, STRFTIME(d, '%m-%d') AS md FROM {_EV('purchase')} x), fw0 AS (SELECT symbol, d, " + ", ".join(f"LEAD(close, {n}) OVER ({W}) / close - 1 AS f{n}" for n in (1, 5, 10)) + f" FROM bars), fw AS (SELECT fw0.* FROM fw0 JOIN e ON fw0.symbol = e.symbol AND STRFTIME(fw0.d, '%m-%d') = e.md), x AS (SELECT * FROM ({_EACH}) u WHERE r IS NOT NULL), y AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, step ORDER BY r) AS i, COUNT(*) OVER (PARTITION BY symbol, step) AS n FROM x) SELECT symbol, CAST(step AS INT) AS step, COUNT(*) AS n, ROUND(AVG(r), 7) AS mean, MAX(CASE WHEN i = FLOOR(n / 2) + 1 THEN r END) AS upper_median, ROUND(STDDEV_SAMP(r), 7) AS sd, ROUND(AVG(CASE WHEN r > 0 THEN 1E0 ELSE 0E0 END), 7) AS hit_rate FROM y GROUP BY 1, 2"),
    "agg22_net_revisions": f"WITH u AS (SELECT *, 1 AS s FROM {_EV('signup')} a UNION ALL SELECT *, -1 FROM {_EV('error')} b) SELECT symbol, CAST(SUM(s) AS BIGINT) AS net, COUNT(*) AS n FROM u WHERE d <= DATE '2024-03-01' AND d > DATE '2024-03-01' - 3650 GROUP BY 1",
    "top09_next_event": f"WITH n AS (SELECT symbol, MIN(d) AS next FROM {_EV('purchase')} x WHERE d >= DATE '2000-01-15' GROUP BY 1), k AS (SELECT *, CAST(next - DATE '2000-01-15' AS INT) AS days FROM n) SELECT symbol, next, days, CAST(CASE WHEN days <= 7 THEN 100 WHEN days <= 21 THEN 70 ELSE 30 END AS INT) AS score FROM k",
    "dom14_trend_structure": oracle("bars", _STRUCT + " SELECT * FROM struct"),
    "dom16_triangles": oracle("bars", _TRI + " SELECT * FROM tri"),
    "dom17_rectangles": oracle("bars", _RECT + " SELECT * FROM rect"),
    "dom19_flags": oracle("bars", f", a AS (SELECT *, close / LAG(close, 8) OVER ({W}) - 1 AS move, (high - low) / close AS rng, LEAD(close, 8) OVER ({W}) / close - 1 AS drift FROM bars), b AS (SELECT *, AVG(rng) {_rows(8)} AS before, AVG(rng) {_AHEAD} AS later, COUNT(*) {_AHEAD} AS n FROM a) SELECT symbol, d, CASE WHEN move > 0 THEN 'bull' ELSE 'bear' END AS side, ROUND(move, 6) AS move FROM b WHERE n = 8 AND ABS(move) >= 0.05 AND later <= 0.5 * before AND ABS(drift) <= 0.5 * ABS(move)"),
    "dom21_chart_scores": oracle("bars", _STRUCT + f""", s AS (SELECT *, LAST_VALUE(CASE WHEN is_high THEN high END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, LAST_VALUE(CASE WHEN is_low THEN low END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM {_SWINGS}),
c AS (SELECT symbol, d, SUM(CASE WHEN is_high AND high > ph THEN 1 ELSE 0 END) {_rows(60)} + SUM(CASE WHEN is_low AND low > pl THEN 1 ELSE 0 END) {_rows(60)} AS k, ROUND({_full(f'AVG(volume) {_rows(5)} / AVG(volume) {_rows(20)}', 20)}, 6) AS v FROM s),
x AS (SELECT struct.symbol, 0.4 * CASE trend WHEN 'uptrend' THEN 100 WHEN 'transitioning' THEN 55 WHEN 'range' THEN 45 ELSE 10 END + 0.2 * COALESCE(r2, 0) * 100 + 0.25 * LEAST(100, k * 20) + 0.15 * GREATEST(0, LEAST(100, COALESCE(v, 1) * 50)) AS score FROM struct JOIN c ON struct.symbol = c.symbol AND struct.d = c.d)
SELECT symbol, ROUND(score, 9) AS score, CASE WHEN score >= 75 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 45 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS grade FROM x"""),
    "dom32_volatility_regime": oracle("bars", RET + f", v AS (SELECT symbol, d, close, {_full('STDDEV_SAMP(ret) ' + _rows(20) + ' * SQRT(252)', 20, 'ret')} AS v, {_full('AVG(close) ' + _rows(200), 200)} AS ma FROM ret) SELECT symbol, d, CASE WHEN v IS NULL THEN 'n/a' WHEN v < 0.12 THEN 'calm' WHEN v < 0.2 THEN 'normal' WHEN v < 0.3 THEN 'elevated' ELSE 'stressed' END AS band, CASE WHEN ma IS NULL THEN 'n/a' WHEN close >= ma THEN 'above' ELSE 'below' END AS side FROM v"),
    "dom13_watchlist": oracle("bars", ", e AS (SELECT symbol, ARG_MAX(close, d) AS close, ARG_MIN(close, d) AS ref_price, MAX(high) AS target, MIN(low) AS risk_line FROM bars GROUP BY 1) SELECT symbol, ROUND(close / ref_price - 1, 6) AS change, ROUND(target / close - 1, 6) AS upside, CASE WHEN close / risk_line - 1 < 0 THEN 'broken' WHEN close / risk_line - 1 < 0.03 THEN 'near' ELSE 'clear' END AS risk FROM e"),
    "dom08_sector_fit": oracle("sectors", "SELECT symbol, sector, ROUND(CASE beta_class WHEN 'defensive' THEN 0.35E0 - 0.5 WHEN 'cyclical' THEN 0.5 - 0.35E0 ELSE 0 END, 6) AS fit FROM sectors"),
    "dom36_deep_report": oracle("bars sectors", _STRUCT + _RECT + _TRI + " SELECT s.symbol, struct.trend AS trend_trend, rect.floor AS rect_floor, tri.kind AS tri_kind, CAST((struct.symbol IS NOT NULL)::INT + (rect.symbol IS NOT NULL)::INT + (tri.symbol IS NOT NULL)::INT AS INT) AS layers FROM (SELECT DISTINCT symbol FROM sectors) s LEFT JOIN struct ON s.symbol = struct.symbol LEFT JOIN rect ON s.symbol = rect.symbol LEFT JOIN tri ON s.symbol = tri.symbol"),
    "fil02_history_gate": oracle("bars", "SELECT symbol, COUNT(*) AS n FROM bars GROUP BY 1 HAVING COUNT(*) >= 230"),
    "src02_stale_keys": "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING EPOCH(TIMESTAMP '2000-01-01 00:00:00') - EPOCH(MAX(o_orderdate)) < 24 * 90 * 3600)",
    "set01_universe": "WITH u AS (SELECT DISTINCT p_brand AS symbol FROM part) SELECT symbol, FALSE AS extra FROM u UNION ALL SELECT DISTINCT p_type, TRUE FROM part WHERE p_type NOT IN (SELECT symbol FROM u)",
    "set02_first_of": "SELECT user_id, event_type, MIN(event_id) AS event_id FROM events GROUP BY 1, 2",
    "set03_newest_wins": "WITH m AS (SELECT AVG(FLOOR(EPOCH(ts))) AS m FROM events), a AS (SELECT user_id, MIN(event_id) AS event_id FROM events, m WHERE FLOOR(EPOCH(ts)) < m GROUP BY 1), b AS (SELECT user_id, MIN(event_id) AS event_id FROM events, m WHERE FLOOR(EPOCH(ts)) >= m GROUP BY 1) SELECT user_id, COALESCE(b.event_id, a.event_id) AS event_id FROM a FULL JOIN b USING (user_id)",
    "src14_latest_changes": "SELECT user_id AS candidate_id, ARG_MAX(event_type, event_id) FILTER (WHERE event_type <> 'error') AS user_action, CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS INT) AS n_actuals, ARG_MAX(value, event_id) FILTER (WHERE event_type = 'error') AS last_actual FROM events GROUP BY 1",
}
