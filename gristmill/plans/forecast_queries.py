"""Queries of forecasts, patterns, macro series and positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as P, indicators as I, macro as M, regimes as G
from ..sources.views import held, oracle, table, view
from .indicator_queries import W, _SWINGS, _full, _rows


def _bars(spark, sf_dir):
    return held(view(spark, sf_dir, "bars"))


def dom27_past_forecasts(spark, sf_dir):
    return P.bands(_bars(spark, sf_dir)).drop("rn")


def _outcomes(spark, sf_dir):
    return P.resolved(P.bands(_bars(spark, sf_dir)), _bars(spark, sf_dir))


def dom28_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


def joi13_level_touches(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    levels = bars.withColumn("rn", F.row_number().over(I.in_order())).withColumn("support", F.min("low").over(I.last(20))).withColumn("resistance", F.max("high").over(I.last(20))).where("rn % 21 = 0")
    levels = levels.select("symbol", "d", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("level")) for k in ("support", "resistance")))).alias("x")).select("symbol", "d", "x.*")
    return P.level_touches(levels, bars)


def agg16_calibration(spark, sf_dir):
    return P.calibration(_outcomes(spark, sf_dir))


def agg17_symbol_calibration(spark, sf_dir):
    return P.calibration(_outcomes(spark, sf_dir), "symbol")


def agg17_symbol_status(spark, sf_dir):
    return P.symbol_status(P.calibration(_outcomes(spark, sf_dir), "symbol"))


def dom29_paper_signals(spark, sf_dir):
    return P.paper_signals(P.bands(_bars(spark, sf_dir)), _bars(spark, sf_dir))


def fil11_open_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 == 0, "macro_dashboard").otherwise("forecast").alias("profile"), F.when(F.col("event_type") == "error", "closed").alias("label"), F.when(F.col("user_id") % 3 == 0, F.date_add(F.to_date("ts"), 1)).alias("last_resolved"), "ts")
    records = records.withColumn("as_of", F.date_add(F.to_date("ts"), -(F.col("id") % 800).cast("int")))
    today = e.agg(F.max(F.to_date("ts")).alias("today"))  # one row
    return P.open_records(records.join(F.broadcast(today)), F.col("today")).select("id", "profile", "as_of")


def _due(spark, sf_dir):
    f = P.forecast_rows(_bars(spark, sf_dir)).select("symbol", "d", "spot")
    return f.withColumn("due", P.due_date(F.col("d"), F.lit(21)))


def joi11_forward_as_of(spark, sf_dir):
    return P.as_of(_due(spark, sf_dir), _bars(spark, sf_dir).select("symbol", F.col("d").alias("bar_d"), "close"), "symbol", "due", "bar_d", "close", forward=True)


def joi12_backward_as_of(spark, sf_dir):
    return P.as_of(_due(spark, sf_dir), _bars(spark, sf_dir).select("symbol", F.col("d").alias("bar_d"), "close"), "symbol", "due", "bar_d", "close")


def dom18_patterns(spark, sf_dir):
    return P.patterns(_bars(spark, sf_dir))


def dom15_levels(spark, sf_dir):
    return P.levels(_bars(spark, sf_dir))


def win27_series_features(spark, sf_dir):
    return M.series_features(view(spark, sf_dir, "series"))


def dom30_pillars(spark, sf_dir):
    return M.pillars(M.series_features(view(spark, sf_dir, "series")))


def dom31_regime(spark, sf_dir):
    return M.regime_posterior(M.pillars(M.series_features(view(spark, sf_dir, "series"))))


def dom33_volatility_states(spark, sf_dir):
    return M.transitions(M.volatility_states(_bars(spark, sf_dir)))


def _features(spark, sf_dir):
    return I.regime_features(_bars(spark, sf_dir))


def dom33_regimes_now(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return G.regimes_now(G.smoothed(rows, G.fit_states(held(rows))))


def dom33_model_choice(spark, sf_dir):
    """Likelihood, parameters, AIC and BIC of two to four states."""
    rows = held(_features(spark, sf_dir))
    fitted = [(k, G.fit_states(rows, k=k)) for k in (2, 3, 4)]
    return spark.createDataFrame([(k, s.n, s.parameters, s.log_likelihood, s.aic, s.bic) for k, s in fitted], "k int, n long, parameters int, log_likelihood double, aic double, bic double")


def dom33_tercile_runs(spark, sf_dir):
    return I.run_lengths(G.by_terciles(_features(spark, sf_dir)).select("symbol", "d", "rv", "state"), "state")


def dom33_tercile_transitions(spark, sf_dir):
    return M.transitions(G.by_terciles(_features(spark, sf_dir)))


def dom34_positioning(spark, sf_dir):
    return M.positioning(view(spark, sf_dir, "fundamentals"))


def dom37_position_changes(spark, sf_dir):
    return M.position_changes(view(spark, sf_dir, "holdings"))


def agg23_holdings_summary(spark, sf_dir):
    return M.holdings_summary(view(spark, sf_dir, "holdings"))


def stm04_lockouts(spark, sf_dir):
    from ..streaming.attempts import lockouts

    e = table(spark, sf_dir, "events")
    return lockouts(e.select(F.col("user_id").alias("ip"), "ts", (F.col("event_type") != "error").alias("ok")), failures=2, window_s=86_400 * 30, lock_s=86_400)


def stm01_hourly_bars(spark, sf_dir):
    from ..streaming.ticks import hourly_bars

    e = table(spark, sf_dir, "events")
    return hourly_bars(e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).alias("volume"))).select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "open", "high", "low", "close", "volume")


QUERIES = {f.__name__: f for f in (dom27_past_forecasts, dom28_outcomes, joi13_level_touches, agg16_calibration, agg17_symbol_calibration, agg17_symbol_status, dom29_paper_signals, fil11_open_records, joi11_forward_as_of, joi12_backward_as_of, dom18_patterns, dom15_levels, win27_series_features, dom30_pillars, dom31_regime, dom33_volatility_states, dom33_regimes_now, dom33_model_choice, dom33_tercile_runs, dom33_tercile_transitions, dom34_positioning, dom37_position_changes, agg23_holdings_summary, stm01_hourly_bars, stm04_lockouts)}

_ROWS = f""", lr AS (SELECT *, LN(close) - LN(LAG(close) OVER ({W})) AS logret, CAST(ROW_NUMBER() OVER ({W}) AS INT) AS rn FROM bars),
mm AS (SELECT *, AVG(logret) {_rows(60)} AS mu, STDDEV_SAMP(logret) {_rows(120)} AS sd, STDDEV_SAMP(logret) {_rows(504)} AS sd_all, MAX(rn) OVER (PARTITION BY symbol) AS last_rn FROM lr),
hs AS (""" + " UNION ALL ".join(f"SELECT symbol, rn AS pos, {h} AS horizon, {_full(f'SUM(logret) {_rows(h)}', h, 'logret')} AS s FROM lr" for h in P.HORIZONS) + ")"
_HORIZON = "(SELECT CAST(UNNEST([5, 10, 21, 42, 63]) AS INT) AS horizon)"
_PART = {"lo90": 1, "lo68": 2, "median": 3, "hi68": 4, "hi90": 5}


def _fc(where: str, iv: bool, pattern: bool) -> str:
    """Common table expressions with fr, the forecasts' rows, and fc, their bands."""
    log = {k: f"(0.5 * (mu * horizon + {z} * sd * SQRT(horizon)) + 0.3 * COALESCE({z} * iv / SQRT(252) * SQRT(horizon), 0) + 0.2 * COALESCE(q[{_PART[k]}], 0)) / total" for k, z in P.Z.items()}
    if pattern:
        log["median"] = f"CASE WHEN horizon = 21 AND avg_return IS NOT NULL THEN 0.7 * ({log['median']}) + 0.3 * LN(1 + avg_return) ELSE {log['median']} END"
    method = "'gbm' || CASE WHEN iv IS NOT NULL THEN '+iv' ELSE '' END || CASE WHEN q IS NOT NULL THEN '+history' ELSE '' END" + (" || CASE WHEN horizon = 21 AND avg_return IS NOT NULL THEN '+pattern' ELSE '' END" if pattern else "")
    near = ", ivs AS (SELECT underlying, horizon, iv FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY underlying, horizon ORDER BY ABS(dte - horizon), dte) AS n_ FROM (SELECT underlying, dte, AVG(iv) AS iv FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY underlying, dte, side ORDER BY ABS(strike - spot), strike) AS rn FROM chain) z WHERE rn = 1 GROUP BY 1, 2) z2 CROSS JOIN " + _HORIZON + " hh) z3 WHERE n_ = 1)" if iv else ""
    return _ROWS + near + f""", fr AS (SELECT symbol, d, rn, close AS spot, rn - 1 AS n_ret, mu, sd, sd_all FROM mm WHERE {where} AND rn - 1 >= 20),
hq AS (SELECT fr.symbol, fr.rn, horizon, QUANTILE_CONT(s, [0.05, 0.16, 0.5, 0.84, 0.95]) AS q FROM fr JOIN hs ON fr.symbol = hs.symbol AND pos < fr.rn AND pos > fr.rn - 504 WHERE s IS NOT NULL AND n_ret >= horizon + 60 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 30),
fb AS (SELECT fr.*, h.horizon, q, {'ivs.iv' if iv else 'CAST(NULL AS DOUBLE)'} AS iv, {'avg_return' if pattern else 'NULL'} AS avg_return FROM fr CROSS JOIN {_HORIZON} h LEFT JOIN hq ON hq.symbol = fr.symbol AND hq.rn = fr.rn AND hq.horizon = h.horizon {'LEFT JOIN ivs ON ivs.underlying = fr.symbol AND ivs.horizon = h.horizon' if iv else ''} {'LEFT JOIN (SELECT symbol, avg_return FROM latest WHERE n >= 10 AND avg_return > -1) lp ON lp.symbol = fr.symbol' if pattern else ''}),
ft AS (SELECT *, 0.5 + CASE WHEN iv IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN q IS NOT NULL THEN 0.2 ELSE 0 END AS total FROM fb),
fc AS (SELECT symbol, d, rn, horizon, spot, {', '.join(f'ROUND(spot * EXP({x}), 6) AS {k}' for k, x in log.items())}, ROUND((0.5 * sd * SQRT(252) + 0.3 * COALESCE(iv, 0) + CASE WHEN q IS NOT NULL THEN 0.2 * sd_all * SQRT(252) ELSE 0 END) / total, 6) AS sigma, {method} AS method FROM ft)"""


_PAST = _fc("rn % 21 = 0", False, False)
_SPAN = "CASE horizon " + " ".join(f"WHEN {h} THEN {P.calendar_days(h)}" for h in P.HORIZONS) + " END"
_OUT = _PAST + f""", oc AS (SELECT fc.symbol, fc.d, fc.horizon, ARG_MAX(b.close, b.d) AS actual, MAX(b.close) AS top, MIN(b.close) AS bottom, ANY_VALUE(spot) AS spot, ANY_VALUE(lo68) AS lo68, ANY_VALUE(hi68) AS hi68, ANY_VALUE(lo90) AS lo90, ANY_VALUE(hi90) AS hi90, ANY_VALUE(median) AS median
 FROM fc JOIN (SELECT symbol, MAX(d) AS final FROM bars GROUP BY 1) e ON e.symbol = fc.symbol AND fc.d + {_SPAN} <= final JOIN bars b ON fc.symbol = b.symbol AND b.d BETWEEN fc.d AND fc.d + {_SPAN} GROUP BY 1, 2, 3),
outcomes AS (SELECT symbol, d, horizon, actual, ROUND((top / spot - 1) * 100, 6) AS mfe, ROUND((bottom / spot - 1) * 100, 6) AS mae, actual BETWEEN lo68 AND hi68 AS in68, actual BETWEEN lo90 AND hi90 AS in90, ROUND(ABS(actual / median - 1), 6) AS error FROM oc)"""
_C = lambda k: f"AVG(CAST({k} AS DOUBLE))"
_OK = lambda k, t: f"(ABS({_C(k)} - {t}) <= 0.10 AND COUNT(*) >= 30)"
_CAL = lambda by: f"SELECT {by}horizon, COUNT(*) AS n, ROUND({_C('in68')}, 6) AS cov68, ROUND({_C('in90')}, 6) AS cov90, ROUND(AVG(mfe), 9) AS mfe_mean, ROUND(AVG(mae), 9) AS mae_mean, ROUND(AVG(error), 9) AS error, {_OK('in68', 0.68)} AS calibrated68, {_OK('in90', '0.90')} AS calibrated90, {_OK('in68', 0.68)} AND {_OK('in90', '0.90')} AS calibrated FROM outcomes GROUP BY ALL"
_DUE = _ROWS + ", due AS (SELECT symbol, d, close AS spot, CAST(d + CAST(FLOOR(21 * 365 / 252) AS INT) AS DATE) AS due FROM mm WHERE rn % 21 = 0 AND rn - 1 >= 20)"
_PAPER = """, sg AS (SELECT fc.*, CAST(fc.d + CAST(FLOOR(horizon * 1.4) AS INT) AS DATE) AS due FROM fc), sr AS (SELECT g.*, b.close, b.d AS realized FROM sg g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.due <= b.d),
signals AS (SELECT symbol, d, horizon, due, realized, ROUND(close / spot - 1, 6) AS actual_return, close BETWEEN lo68 AND hi68 AS in68, close BETWEEN lo90 AND hi90 AS in90, CASE WHEN COUNT(close) OVER w = 0 THEN 'logged' WHEN COUNT(close) OVER w < COUNT(*) OVER w THEN 'partially_resolved' ELSE 'fully_resolved' END AS status FROM sr WINDOW w AS (PARTITION BY symbol, d))"""


def _swing_side(side: str, flag: str, double: str, shoulders: str) -> str:
    head = "two > 0 AND one / GREATEST(v, two) - 1 > 0.02" if side == "high" else "two > 0 AND -(one / LEAST(v, two) - 1) > 0.02"
    p = f"(SELECT symbol, d, known, rn, {side} AS v, LAG({side}) OVER ({W}) AS one, LAG(rn) OVER ({W}) AS one_rn, LAG({side}, 2) OVER ({W}) AS two FROM (SELECT * FROM sw WHERE {flag}) f)"
    return f"SELECT symbol, d, known, '{double}' AS pattern FROM {p} a WHERE known IS NOT NULL AND ABS(v / one - 1) <= 0.02 AND rn - one_rn BETWEEN 10 AND 60 UNION ALL SELECT symbol, d, known, '{shoulders}' FROM {p} b WHERE known IS NOT NULL AND {head} AND ABS(v / two - 1) <= 0.03"


_PATTERNS = f", sw AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, LEAD(d, 5) OVER ({W}) AS known FROM {_SWINGS}), pat AS (" + _swing_side("high", "is_high", "double_top", "head_shoulders") + " UNION ALL " + _swing_side("low", "is_low", "double_bottom", "inverse_head_shoulders") + ")"
_SW = "PARTITION BY series_id ORDER BY d"
_SERF = f""", sf AS (SELECT series_id, d, ROUND(value / CASE WHEN COUNT(value) OVER ({_SW} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) = 200 THEN AVG(value) OVER ({_SW} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END - 1, 6) AS ma_distance, ROUND(value / LAG(value, 3) OVER ({_SW}) - 1, 6) AS change3, ROUND(value / LAG(value, 252) OVER ({_SW}) - 1, 6) AS yoy,
 ROUND(GREATEST(LEAST(CASE WHEN STDDEV_POP(value) OVER p > 0 THEN (value - AVG(value) OVER p) / STDDEV_POP(value) OVER p ELSE 0 END, 3), -3), 5) AS z FROM series WINDOW p AS ({_SW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_PILLARS = _SERF + ", lastf AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY d DESC) AS n_ FROM sf) x WHERE n_ = 1), comp AS (" + " UNION ALL ".join(f"SELECT series_id, CASE WHEN {k} IS NOT NULL THEN GREATEST(LEAST({k} / {s}, 1), -1) END AS x FROM lastf" for k, s in (("z", 2.0), ("change3", 0.5), ("yoy", 0.5), ("ma_distance", 0.5))) + "), pil AS (SELECT series_id, ROUND(AVG(x), 6) AS score, COUNT(x) AS n, CAST(COUNT(*) - COUNT(x) AS BIGINT) AS missing FROM comp GROUP BY 1)"
_CLAMP = lambda x: f"GREATEST(LEAST({x}, 1), -1)"
_TERCILES = f""", l1 AS (SELECT *, LN(close) - LN(LAG(close) OVER ({W})) AS logret FROM bars), l2 AS (SELECT symbol, d, ROUND({_full(f'STDDEV_SAMP(logret) {_rows(21)}', 21, 'logret')}, 6) AS rv FROM (SELECT * FROM l1 WHERE logret IS NOT NULL) q),
l3 AS (SELECT * FROM l2 WHERE rv IS NOT NULL), cut AS (SELECT ROUND(QUANTILE_CONT(rv, 1 / 3E0), 6) AS a, ROUND(QUANTILE_CONT(rv, 2 / 3E0), 6) AS b FROM l3), l4 AS (SELECT symbol, d, rv, CAST(CASE WHEN rv <= a THEN 0 WHEN rv <= b THEN 1 ELSE 2 END AS INT) AS state FROM l3 CROSS JOIN cut),
l5 AS (SELECT *, LAG(state) OVER ({W}) AS was FROM l4), tr AS (SELECT *, SUM(CASE WHEN state = was THEN 0 ELSE 1 END) OVER ({W}) AS run FROM l5)"""
ORACLE_SQL = {
    "dom27_past_forecasts": oracle("bars", _PAST + " SELECT symbol, d, horizon, spot, sigma, method, " + ", ".join(P.Z) + " FROM fc"),
    "dom28_outcomes": oracle("bars", _OUT + " SELECT * FROM outcomes"),
    "joi13_level_touches": oracle("bars", f", lv AS (SELECT symbol, d, ROW_NUMBER() OVER ({W}) AS rn, MIN(low) {_rows(20)} AS support, MAX(high) {_rows(20)} AS resistance FROM bars), lx AS (SELECT symbol, d, 'support' AS name, support AS level FROM lv WHERE rn % 21 = 0 UNION ALL SELECT symbol, d, 'resistance', resistance FROM lv WHERE rn % 21 = 0) SELECT lx.symbol, lx.d, name, level, MAX(high) >= level * 1.005 AS over, MIN(low) <= level * 0.995 AS under FROM lx JOIN bars b ON b.symbol = lx.symbol AND b.d BETWEEN lx.d AND lx.d + 21 GROUP BY 1, 2, 3, 4"),
    "agg16_calibration": oracle("bars", _OUT + " " + _CAL("")),
    "agg17_symbol_calibration": oracle("bars", _OUT + " " + _CAL("symbol, ")),
    "agg17_symbol_status": oracle("bars", _OUT + ", cal AS (" + _CAL("symbol, ") + ") SELECT symbol, COUNT(*) AS horizons, CAST(SUM(n) AS BIGINT) AS n, CASE WHEN SUM(n) < 30 THEN 'preliminary' WHEN BOOL_AND(calibrated) THEN 'validated' ELSE 'calibrating' END AS status FROM cal GROUP BY 1"),
    "dom29_paper_signals": oracle("bars", _PAST + _PAPER + " SELECT * FROM signals"),
    "fil11_open_records": "WITH r AS (SELECT event_id AS id, CASE WHEN user_id % 5 = 0 THEN 'macro_dashboard' ELSE 'forecast' END AS profile, event_type = 'error' AS closed, CASE WHEN user_id % 3 = 0 THEN CAST(ts AS DATE) + 1 END AS done, CAST(CAST(ts AS DATE) - CAST(event_id % 800 AS INT) AS DATE) AS as_of, (SELECT MAX(CAST(ts AS DATE)) FROM events) AS today FROM events) SELECT id, profile, as_of FROM r WHERE profile <> 'macro_dashboard' AND NOT closed AND COALESCE(done <> today, TRUE) AND today - as_of <= 400",
    "joi11_forward_as_of": oracle("bars", _DUE + " SELECT u.symbol, u.d, u.spot, u.due, b.close, b.d AS found_bar_d FROM due u ASOF LEFT JOIN bars b ON u.symbol = b.symbol AND u.due <= b.d"),
    "joi12_backward_as_of": oracle("bars", _DUE + " SELECT u.symbol, u.d, u.spot, u.due, b.close, b.d AS found_bar_d FROM due u ASOF LEFT JOIN bars b ON u.symbol = b.symbol AND u.due >= b.d"),
    "dom18_patterns": oracle("bars", _PATTERNS + " SELECT * FROM pat"),
    "dom15_levels": oracle("bars", f""", x AS (SELECT *, {_full('AVG(close) ' + _rows(50), 50)} AS ma50, {_full('AVG(close) ' + _rows(200), 200)} AS ma200, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM {_SWINGS}),
l AS (SELECT symbol, close AS spot, ROUND(ma50, 8) AS ma50, ROUND(ma200, 8) AS ma200 FROM x WHERE age = 1),
e AS (SELECT symbol, 'swing_high' AS source, high AS level FROM x WHERE age <= 120 AND is_high UNION SELECT symbol, 'swing_low', low FROM x WHERE age <= 120 AND is_low UNION SELECT symbol, 'ma50', ma50 FROM l WHERE ma50 IS NOT NULL UNION SELECT symbol, 'ma200', ma200 FROM l WHERE ma200 IS NOT NULL),
s AS (SELECT e.symbol, source, level, spot, CASE WHEN level <= spot THEN 'support' ELSE 'resistance' END AS side FROM e JOIN l ON e.symbol = l.symbol)
SELECT symbol, side, place, source, level, ROUND(level / spot - 1, 6) AS distance FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY symbol, side ORDER BY ABS(level - spot), source, level) AS INT) AS place FROM s) z WHERE place <= 8"""),
    "win27_series_features": oracle("series", _SERF + " SELECT * FROM sf"),
    "dom30_pillars": oracle("series", _PILLARS + " SELECT * FROM pil"),
    "dom31_regime": oracle("series", _PILLARS + ", m AS (SELECT AVG(score) AS m FROM pil), r AS (SELECT regime, EXP(-POW(m - c, 2) * 4) AS e FROM m CROSS JOIN (VALUES ('stress', -0.8E0), ('slowdown', -0.4E0), ('neutral', 0E0), ('recovery', 0.4E0), ('boom', 0.8E0)) v(regime, c)), p AS (SELECT regime, e / SUM(e) OVER () AS p FROM r) SELECT regime, ROUND(p, 6) AS p, ROUND(1 + SUM(p * LN(p)) OVER () / LN(5E0), 6) AS confidence FROM p"),
    "dom33_tercile_runs": oracle("bars", _TERCILES + " SELECT symbol, d, rv, state, CAST(ROW_NUMBER() OVER (PARTITION BY symbol, run ORDER BY d) AS INT) AS duration FROM tr"),
    "dom33_tercile_transitions": oracle("bars", _TERCILES + ' SELECT "from", "to", n, ROUND(n / SUM(n) OVER (PARTITION BY "from"), 6) AS share FROM (SELECT was AS "from", state AS "to", COUNT(*) AS n FROM tr WHERE was IS NOT NULL GROUP BY 1, 2) q'),
    "dom34_positioning": oracle("fundamentals", f""", s AS (SELECT symbol, {_CLAMP('short_float * 2 - 0.5')} AS s, CASE WHEN institutions IS NOT NULL THEN {_CLAMP('institutions * 4 - 1')} END AS o, {_CLAMP('(3 - rating) / 2')} AS a FROM fundamentals)
SELECT symbol, ROUND(s, 6) AS short_score, ROUND(o, 6) AS owner_score, ROUND(a, 6) AS analyst_score, ROUND((s * -0.3 + COALESCE(o * 0.2, 0) + a * 0.5) / (0.3 + CASE WHEN o IS NOT NULL THEN 0.2 ELSE 0 END + 0.5), 6) AS flow FROM s"""),
    "dom37_position_changes": oracle("holdings", ", a AS (SELECT filer, cusip, put_call, CAST(shares AS BIGINT) AS before FROM holdings WHERE period = 1), b AS (SELECT filer, cusip, put_call, CAST(shares AS BIGINT) AS after FROM holdings WHERE period = 2) SELECT filer, cusip, put_call, before, after, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'exit' WHEN after > before THEN 'increase' WHEN after < before THEN 'decrease' ELSE 'same' END AS change FROM a FULL JOIN b USING (filer, cusip, put_call)"),
    "agg23_holdings_summary": oracle("holdings", "SELECT filer, period, CAST(SUM(value_usd) AS BIGINT) AS total, COUNT(CASE WHEN put_call = 'PUT' THEN 1 END) AS n_put, COUNT(CASE WHEN put_call = 'CALL' THEN 1 END) AS n_call, COUNT(CASE WHEN put_call = 'LONG' THEN 1 END) AS n_long, ARG_MAX(cusip, (value_usd, -cusip)) AS top_cusip FROM holdings GROUP BY 1, 2"),
    "stm01_hourly_bars": "SELECT event_type AS symbol, STRFTIME(DATE_TRUNC('hour', ts), '%Y-%m-%d %H:%M') AS start, ARG_MIN(value, ts) AS open, MAX(value) AS high, MIN(value) AS low, ARG_MAX(value, ts) AS close, COUNT(*) AS volume FROM events GROUP BY 1, 2",
}
