"""Queries of the cross-sectional rank and its backtest, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import events as E, indicators as I, rank_spec as R, scoring as S
from ..sources.views import held, oracle, view
from .indicator_queries import RET, W, _ewm_sql, _full, _rows


#: Added before figures are rounded once, so that exact ties go up everywhere; finer than what is kept, coarser than a double's noise.
NUDGE = 1.37e-12


def _prices(spark, sf_dir, last_only=False, digits=9):
    return S.price_features(held(view(spark, sf_dir, "bars")), held(view(spark, sf_dir, "market")), last_only=last_only, digits=digits)


def _event_features(spark, sf_dir, rows):
    return E.event_features(rows, E.spike_drift(held(view(spark, sf_dir, "bars"))), held(view(spark, sf_dir, "reports")), held(view(spark, sf_dir, "shorts")))


def _signals(spark, sf_dir, rows):
    """Event fields of each symbol at the date of its row: news, messages, the next report, drifts, the last surprise, short interest."""
    months = I.month_returns(held(view(spark, sf_dir, "bars"))).select("symbol", "m", F.col("mean").alias("month_drift"))
    days = F.datediff("next_report", "d")
    s = rows.select("symbol", "d").join(view(spark, sf_dir, "signals"), "symbol", "left").withColumn("m", F.month("d")).join(months, ["symbol", "m"], "left")
    s = s.join(_event_features(spark, sf_dir, rows.select("symbol", "d")).drop("d"), "symbol", "left")
    plain = ("month_drift", "revisions", "news_count", "news_sentiment", "bullish_share", "messages", "earnings_drift", "surprise_pct", "short_change", "days_to_cover")
    return s.select("symbol", days.alias("days_to_earnings"), S.event_window(days).alias("event_window"), *(F.round(c, 9).alias(c) for c in plain))


def _today(spark, sf_dir):
    """Every feature of each symbol's last bar."""
    rows = S.company_features(S.latest(_prices(spark, sf_dir, True)), view(spark, sf_dir, "company"))
    rows = S.macro_features(rows, held(view(spark, sf_dir, "sectors")), view(spark, sf_dir, "macro_state"))
    return S.complete(S.with_signals(rows, _signals(spark, sf_dir, rows)))


def _ranked(spark, sf_dir, spec=None):
    return S.rank(_today(spark, sf_dir), S.spec_table(spark) if spec is None else spec, S.setup_table(spark))


def _replayed(spark, sf_dir):
    """Ranks at every rebalance, from prices only: what a later report knows is not used."""
    return S.rank(S.complete(S.rebalance_rows(_prices(spark, sf_dir))), S.spec_table(spark, ("technical", "contrarian")), S.setup_table(spark))


def dom01_features(spark, sf_dir):
    rows = _today(spark, sf_dir)
    return rows.select("symbol", "d", "trend", "setup", *(F.round(c, 6).alias(c) for c in S.FIELDS))


def dom01_price_features(spark, sf_dir):
    return _prices(spark, sf_dir, digits=None).select("symbol", "d", "trend", "setup", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in S.PRICE_FIELDS))


_EVENT_COLUMNS = ("surprise_pct", "report_drift", "earnings_drift", "short_change", "days_to_cover")


def dom01_event_features(spark, sf_dir):
    """At every bar: days since and to reports, the last surprise, drifts and short interest."""
    got = _event_features(spark, sf_dir, held(view(spark, sf_dir, "bars")).select("symbol", "d"))
    return got.select("symbol", "d", "days_since_report", "days_to_report", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in _EVENT_COLUMNS))


#: A day within the landed bars.
_DAY = "1996-05-15"


def dat03_days_to_events(spark, sf_dir):
    stamp = lambda name, kind: view(spark, sf_dir, name).select("symbol", F.lit(kind).alias("kind"), F.unix_seconds(F.col("d").cast("timestamp")).alias("epoch"))
    return E.days_to_next(stamp("reports", "report").union(stamp("shorts", "ex_dividend")), F.lit(_DAY).cast("date"))


def top09_upcoming_events(spark, sf_dir):
    return E.upcoming(held(view(spark, sf_dir, "reports")).select("symbol", "d"), F.lit(_DAY).cast("date"), 60)


def top09_recent_events(spark, sf_dir):
    return E.recent(held(view(spark, sf_dir, "reports")).select("symbol", "d"), F.lit(_DAY).cast("date"), 10)


def joi03_signals(spark, sf_dir):
    rows = S.latest(_prices(spark, sf_dir, True))
    return S.with_signals(rows.select("symbol", "d"), _signals(spark, sf_dir, rows))


def joi04_macro_on_symbols(spark, sf_dir):
    return S.macro_features(S.latest(_prices(spark, sf_dir, True)).select("symbol"), held(view(spark, sf_dir, "sectors")), view(spark, sf_dir, "macro_state"))


def dom04_submetric_scores(spark, sf_dir):
    got = S.submetric_scores(_today(spark, sf_dir), S.spec_table(spark), S.setup_table(spark))
    return got.select("variant", "symbol", "factor", "sub_metric", F.round("score", 6).alias("score"))


def dom05_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("variant", "d", "symbol", "score", "place", "trend", "setup", "label")


def dom05_breakdown(spark, sf_dir):
    return _ranked(spark, sf_dir).select("variant", "symbol", F.explode("factors").alias("factor", "factor_score"))


def dom07_regime_tilt(spark, sf_dir):
    spec = S.tilted(S.spec_table(spark, ("default",)), view(spark, sf_dir, "macro_state"))
    return _ranked(spark, sf_dir, spec).select("symbol", "score", "place", "label")


def dom09_backtest(spark, sf_dir):
    return S.backtest(_replayed(spark, sf_dir))


def agg13_backtest_summary(spark, sf_dir):
    return S.backtest_summary(dom09_backtest(spark, sf_dir))


def agg14_symbol_summary(spark, sf_dir):
    return S.symbol_summary(_replayed(spark, sf_dir))


def top01_by_sector(spark, sf_dir):
    return S.top_by_sector(_ranked(spark, sf_dir), held(view(spark, sf_dir, "sectors")).select("symbol", "sector"))


def agg07_z_scores(spark, sf_dir):
    return S.z_scores(_prices(spark, sf_dir), "rs_1m")


def dom11_dashboard(spark, sf_dir):
    got = S.dashboard(held(view(spark, sf_dir, "bars")), held(view(spark, sf_dir, "market")))
    return got.select("symbol", "d", "close", "trend", "setup", "label", "outlook", *(F.round(c, 6).alias(c) for c in ("support", "resistance", "to_support", "to_resistance", "sd20", "vol_annual", "atr", "range_pctile", "rs", "adv_musd")))


def top06_table_order(spark, sf_dir):
    return S.table_order(S.dashboard(held(view(spark, sf_dir, "bars")), held(view(spark, sf_dir, "market")))).select("place", "symbol", "label", F.round("rs", 6).alias("rs"))


QUERIES = {f.__name__: f for f in (dom11_dashboard, top06_table_order, dom01_features, dom01_price_features, dom01_event_features, dat03_days_to_events, top09_upcoming_events, top09_recent_events, joi03_signals, joi04_macro_on_symbols, dom04_submetric_scores, dom05_rank, dom05_breakdown, dom07_regime_tilt, dom09_backtest, agg13_backtest_summary, agg14_symbol_summary, top01_by_sector, agg07_z_scores)}

_LAGS = (21, 63, 126, 252)
_SRC = f"(SELECT *, CASE WHEN close - LAG(close) OVER ({W}) IS NOT NULL THEN GREATEST(close - LAG(close) OVER ({W}), 0) END AS gain, CASE WHEN close - LAG(close) OVER ({W}) IS NOT NULL THEN GREATEST(LAG(close) OVER ({W}) - close, 0) END AS loss FROM ret)"
_FAST = _ewm_sql(_ewm_sql(_ewm_sql(_ewm_sql(_SRC, "gain", 1 / 14, "up"), "loss", 1 / 14, "down"), "close", 2 / 13, "fast"), "close", 2 / 27, "slow")
_PRICES = RET + f""", mk0 AS (SELECT d, close, close / LAG(close) OVER (ORDER BY d) - 1 AS mret FROM market),
mk AS (SELECT d, {', '.join(f'close / LAG(close, {n}) OVER (ORDER BY d) - 1 AS m{n}' for n in _LAGS)}, STDDEV_SAMP(mret) OVER (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS market_sd FROM mk0),
e0 AS (SELECT *, fast - slow AS macd, CAST(ROW_NUMBER() OVER ({W}) AS INT) AS rn, STDDEV_SAMP(ret) {_rows(20)} AS sd20, GREATEST(high - low, ABS(high - LAG(close) OVER ({W})), ABS(low - LAG(close) OVER ({W}))) AS tr FROM {_FAST}),
e1 AS (SELECT *, ROUND({_full('sd20', 20, 'ret')}, 9) AS sd, CAST(rn AS DOUBLE) AS x FROM {_ewm_sql('e0', 'macd', 2 / 10, 'signal')}),
e2 AS (SELECT symbol, d, close, rn, macd, signal, up, down, sd, {_full('AVG(close) ' + _rows(50), 50)} AS ma50, AVG(close) {_rows(20)} AS ma20, AVG(close) {_rows(200)} AS ma200,
 COALESCE(close / LAG(close, 5) OVER ({W}) - 1, 0) AS ret5, COALESCE(close / LAG(close, 25) OVER ({W}) - 1, 0) AS ret20, MAX(close) {_rows(20)} AS hi20, MIN(low) {_rows(20)} AS support, MAX(high) {_rows(20)} AS resistance,
 AVG(tr) {_rows(20)} AS atr, {', '.join(f'close / LAG(close, {n}) OVER ({W}) - 1 AS r{n}' for n in _LAGS)}, {_full(f'REGR_SLOPE(close, x) {_rows(50)} / AVG(close) {_rows(50)}', 50)} AS slope_50d,
 CASE WHEN rn >= 31 THEN sd20 / NULLIF(STDDEV_SAMP(ret) {_rows(252)}, 0) END AS vol_ratio, CASE WHEN rn >= 60 THEN MIN(close) {_rows(60)} END AS lo60, CASE WHEN rn >= 60 THEN MAX(close) {_rows(60)} END AS hi60,
 CASE WHEN rn >= 60 THEN LIST(close) {_rows(60)} END AS closes, CASE WHEN rn >= 61 THEN LIST(sd) {_rows(252)} END AS seen,
 AVG(volume * close) {_rows(20)} / 1E6 AS adv_musd, AVG(volume) {_rows(5)} AS v5, AVG(volume) {_rows(10)} AS v10, AVG(volume) {_rows(20)} AS v20, LEAD(close, 20) OVER ({W}) / close - 1 AS fwd20 FROM e1),
dd AS (SELECT symbol, rn, MIN(c / peak - 1) AS dd FROM (SELECT symbol, rn, c, MAX(c) OVER (PARTITION BY symbol, rn ORDER BY i) AS peak FROM (SELECT symbol, rn, UNNEST(closes) AS c, GENERATE_SUBSCRIPTS(closes, 1) AS i FROM e2 WHERE closes IS NOT NULL) u) p GROUP BY 1, 2),
prices AS (SELECT e2.symbol, e2.d, e2.rn, close, fwd20,
 CASE WHEN ma50 IS NULL THEN 'n/a' WHEN close > ma50 AND close > ma20 AND ret5 > -0.005 AND ret20 > 0 THEN 'uptrend' WHEN close <= ma50 AND close <= ma20 AND ret5 < 0.005 AND ret20 < 0 THEN 'downtrend' WHEN ABS(ret20) < 0.03 AND ABS(ret5) < 0.01 THEN 'range' ELSE 'transitioning' END AS trend,
 CASE WHEN close >= hi20 AND ret5 > 0 THEN 'breakout' WHEN close > ma50 AND ABS(close / ma50 - 1) < 0.02 THEN 'pullback_retest' WHEN close > ma50 AND close > ma20 AND ret20 > 0 THEN 'continuation' WHEN ABS(close / ma50 - 1) < 0.04 THEN 'range_approach' WHEN close < ma50 AND ret5 > 0 THEN 'reversal' WHEN close < ma50 THEN 'mean_reversion' ELSE 'unavailable' END AS setup,
 ROUND(r21 - m21, 9) AS rs_1m, ROUND(r63 - m63, 9) AS rs_3m, ROUND(r126 - m126, 9) AS rs_6m, ROUND(r252 - m252, 9) AS rs_12m, ROUND(close / ma50 - 1, 9) AS dist_50d, ROUND(close / ma200 - 1, 9) AS dist_200d,
 ROUND(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / NULLIF(down, 0)) END, 9) AS rsi, ROUND(slope_50d, 9) AS slope_50d, ROUND(CASE WHEN e2.rn >= 35 THEN macd - signal END, 9) AS macd_hist, ROUND(vol_ratio, 9) AS vol_ratio, ROUND(atr / close - market_sd, 9) AS atr_less_market,
 ROUND(dd, 9) AS max_dd_60d, ROUND(CASE WHEN LEN([y FOR y IN seen IF y IS NOT NULL]) > 0 THEN LEN([y FOR y IN seen IF y < sd]) / LEN([y FOR y IN seen IF y IS NOT NULL]) END, 9) AS vol_percentile, ROUND((close - support) / NULLIF(resistance - support, 0) * 100, 9) AS range_pctile, ROUND((close - ma50) / NULLIF(atr, 0), 9) AS dist_50d_atr,
 ROUND((resistance - close) / NULLIF(atr, 0), 9) AS room_atr, ROUND((close - lo60) / NULLIF(hi60 - lo60, 0), 9) AS profile_pos, ROUND(adv_musd, 9) AS adv_musd, ROUND(v5 / NULLIF(v20, 0), 9) AS volume_ratio, ROUND(ret5 * COALESCE(v10 / NULLIF(v20, 0), 1) * 100, 9) AS net_flow
 FROM e2 LEFT JOIN mk ON e2.d = mk.d LEFT JOIN dd ON e2.symbol = dd.symbol AND e2.rn = dd.rn WHERE e2.rn >= 25)"""
_LAST = ", last AS (SELECT * REPLACE ((SELECT MAX(d) FROM prices) AS d) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS n_ FROM prices) x WHERE n_ = 1)"
_POSITIVE = ", ".join(f"ROUND(CASE WHEN {c} > 0 THEN {c} END, 9) AS {c}" for c in ("trailing_pe", "forward_pe", "peg_ratio", "price_to_book", "price_to_sales", "ev_to_ebitda"))
_PLAIN = ", ".join(f"ROUND({c}, 9) AS {c}" for c in ("roe", "roa", "operating_margin", "profit_margin", "revenue_growth", "earnings_growth", "analyst_rating", "analyst_coverage", "short_float", "institutions", "insiders"))
_MONTHS = ", months AS (SELECT symbol, m, ROUND(AVG(r), 6) AS month_drift FROM (SELECT symbol, YEAR(d) AS y, MONTH(d) AS m, ARG_MAX(close, d) / ARG_MIN(close, d) - 1 AS r FROM bars GROUP BY 1, 2, 3) q GROUP BY 1, 2)"
_EVENT_PARTS = f""", sp0 AS (SELECT *, {_full(f'volume > {E.SPIKE} * AVG(volume) {_rows(20)}', 20, 'volume')} AS loud, AVG(volume) {_rows(20)} AS v20 FROM bars),
sp1 AS (SELECT *, CASE WHEN LAG(loud, 5) OVER ({W}) THEN close / LAG(close, 5) OVER ({W}) - 1 END AS after FROM sp0),
sp AS (SELECT symbol, d, close, v20, AVG(after) OVER ({W} ROWS BETWEEN 498 PRECEDING AND CURRENT ROW) AS earnings_drift FROM sp1),
rp AS (SELECT r.symbol, r.d, surprise_pct, sp.close AS report_close FROM reports r ASOF LEFT JOIN sp ON r.symbol = sp.symbol AND r.d >= sp.d),
si AS (SELECT *, shares / NULLIF(LAG(CAST(shares AS DOUBLE)) OVER ({W}), 0) - 1 AS short_change FROM shorts)"""


def _event_sql(rows: str) -> str:
    """Common table expressions with ef, the event features of rows(symbol, d)."""
    return _EVENT_PARTS + f""", ef1 AS (SELECT l.symbol, l.d, b.close, b.v20, b.earnings_drift FROM (SELECT symbol, d FROM {rows}) l ASOF LEFT JOIN sp b ON l.symbol = b.symbol AND l.d >= b.d),
ef2 AS (SELECT a.*, r.d AS report_d, surprise_pct, report_close FROM ef1 a ASOF LEFT JOIN rp r ON a.symbol = r.symbol AND a.d >= r.d), ef3 AS (SELECT a.*, r.d AS coming FROM ef2 a ASOF LEFT JOIN rp r ON a.symbol = r.symbol AND a.d < r.d),
ef AS (SELECT a.symbol, a.d, CAST(a.d - report_d AS INT) AS days_since_report, CAST(CASE WHEN a.d = report_d THEN 0 ELSE coming - a.d END AS INT) AS days_to_report, surprise_pct, close / report_close - 1 AS report_drift, earnings_drift, s.short_change, s.shares / NULLIF(v20, 0) AS days_to_cover
 FROM ef3 a ASOF LEFT JOIN si s ON a.symbol = s.symbol AND a.d >= s.d)"""


_SIGNALS = _MONTHS + _event_sql("last") + """, sig AS (SELECT l.symbol, l.d, CAST(next_report - l.d AS DOUBLE) AS days_to_earnings, CASE WHEN next_report - l.d BETWEEN 0 AND 7 THEN 1E2 WHEN next_report - l.d BETWEEN 8 AND 21 THEN 7E1 WHEN next_report - l.d < 0 THEN 8E1 WHEN next_report IS NOT NULL THEN 3E1 END AS event_window,
 ROUND(month_drift, 9) AS month_drift, ROUND(revisions, 9) AS revisions, ROUND(news_count, 9) AS news_count, ROUND(news_sentiment, 9) AS news_sentiment, ROUND(bullish_share, 9) AS bullish_share, ROUND(messages, 9) AS messages,
 ROUND(earnings_drift, 9) AS earnings_drift, ROUND(surprise_pct, 9) AS surprise_pct, ROUND(short_change, 9) AS short_change, ROUND(days_to_cover, 9) AS days_to_cover
 FROM last l LEFT JOIN ef ON ef.symbol = l.symbol LEFT JOIN signals s ON l.symbol = s.symbol LEFT JOIN months ON months.symbol = l.symbol AND months.m = MONTH(l.d))"""
_MACRO = """, mac AS (SELECT l.symbol, ROUND(macro_score, 9) AS macro_score, ROUND(bear_risk, 9) AS bear_risk, ROUND(regime_confidence, 9) AS regime_confidence, ROUND(CASE beta_class WHEN 'defensive' THEN bear_risk - 0.5 WHEN 'cyclical' THEN 0.5 - bear_risk ELSE 0 END, 9) AS sector_fit, ROUND(GREATEST(-credit_score, 0), 9) AS credit_stress
 FROM last l LEFT JOIN sectors s ON l.symbol = s.symbol CROSS JOIN macro_state)"""
_TODAY = _PRICES + _LAST + _SIGNALS + _MACRO + f""", picked AS (SELECT last.*, {_POSITIVE}, ROUND(CASE WHEN eps > 0 THEN eps END / close, 9) AS earnings_yield, ROUND(CASE WHEN market_cap > 0 THEN free_cashflow / market_cap END, 9) AS fcf_yield, {_PLAIN},
 ROUND(debt_to_equity / 100, 9) AS debt_to_equity, ROUND(CASE WHEN net_income > 0 THEN operating_cashflow / net_income END, 9) AS cash_conversion, ROUND(CASE WHEN target <> 0 THEN target / close - 1 END, 9) AS target_upside,
 days_to_earnings, event_window, month_drift, earnings_drift, surprise_pct, revisions, news_count, news_sentiment, bullish_share, messages, short_change, days_to_cover,
 macro_score, bear_risk, regime_confidence, sector_fit, credit_stress FROM last LEFT JOIN company ON last.symbol = company.symbol JOIN sig ON last.symbol = sig.symbol JOIN mac ON last.symbol = mac.symbol)"""
_OTHERS = ", ".join(f"CAST(NULL AS DOUBLE) AS {f}" for f in S.FIELDS if f not in S.PRICE_FIELDS)
_REBALANCE = _PRICES + f", days AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM prices) x), picked AS (SELECT prices.*, {_OTHERS} FROM prices JOIN days ON prices.d = days.d WHERE i > 60 AND (i - 61) % 5 = 0 AND fwd20 IS NOT NULL)"
_LIT = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"'{v}'" if isinstance(v, str) else repr(float(v))


def _spec(names: tuple[str, ...] = ("default", "technical", "contrarian")) -> str:
    rows = ", ".join("(" + ", ".join(map(_LIT, r)) + ")" for r in R.variants() if r[0] in names)
    setups = ", ".join("(" + ", ".join(map(_LIT, r)) + ")" for r in R.setup_scores())
    return f", spec(variant, factor, factor_weight, sub_metric, field, kind, weight, low, high, below, above, floor) AS (VALUES {rows}), setups(variant, setup, setup_score) AS (VALUES {setups})"


_TILT = ", ".join(f"('{k}', '{f}', {x!r})" for k, of in R.TILTS.items() for f, x in of.items())
_TILTED = f""", tilts(kind, factor, plus) AS (VALUES {_TILT}), now AS (SELECT CASE WHEN bear_risk >= 0.4 OR regime IN ('bear_risk_elevated', 'risk_off', 'fragile_risk_on') THEN 'defensive' WHEN bear_risk <= 0.15 AND regime = 'risk_on' THEN 'offensive' END AS kind FROM macro_state),
spec AS (SELECT s.* REPLACE (ROUND(s.factor_weight + COALESCE(t.plus, 0), 4) AS factor_weight) FROM spec0 s LEFT JOIN (SELECT tilts.factor, plus FROM tilts JOIN now ON tilts.kind = now.kind) t ON s.factor = t.factor)"""


def _pct(value: str, by: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN (RANK() OVER (PARTITION BY {by} ORDER BY {value} NULLS LAST) - 1 + (COUNT(*) OVER (PARTITION BY {by}, {value}) - 1) / 2) / GREATEST(COUNT({value}) OVER (PARTITION BY {by}) - 1, 1) * 100 END"


_LONG = " UNION ALL ".join(f"SELECT symbol, d, '{f}' AS field, CAST({f} AS DOUBLE) AS value FROM picked" for f in S.FIELDS)
_SCORES = f""", long AS (SELECT * FROM (SELECT *, COUNT(value) OVER (PARTITION BY d, field) AS known FROM ({_LONG}) l) k WHERE known > 0), pct AS (SELECT *, {_pct('value', 'd, field')} AS pct FROM long),
scored AS (SELECT variant, d, symbol, factor, factor_weight, sub_metric, weight, floor, CASE kind WHEN 'higher' THEN pct WHEN 'lower' THEN 100 - pct ELSE CASE WHEN value IS NULL THEN NULL WHEN value BETWEEN low AND high THEN 100
 WHEN value < low THEN CASE WHEN below IS NULL OR below >= low THEN 50 ELSE GREATEST(100 * (value - below) / (low - below), 0) END ELSE CASE WHEN above IS NULL OR above <= high THEN 50 ELSE GREATEST(100 * (above - value) / (above - high), 0) END END END AS s0 FROM pct JOIN spec ON pct.field = spec.field),
scores AS (SELECT variant, d, symbol, factor, factor_weight, sub_metric, weight, CASE WHEN s0 IS NOT NULL THEN GREATEST(s0, COALESCE(floor, s0)) END AS score FROM scored
 UNION ALL SELECT spec.variant, d, symbol, factor, factor_weight, sub_metric, weight, COALESCE(setup_score, 50) FROM picked JOIN spec ON kind = 'lookup' LEFT JOIN setups ON setups.variant = spec.variant AND setups.setup = picked.setup),
factors AS (SELECT variant, d, symbol, factor, factor_weight, COALESCE(SUM(weight * score) / SUM(CASE WHEN score IS NOT NULL THEN weight END), 50) AS factor_score FROM scores GROUP BY 1, 2, 3, 4, 5),
comp AS (SELECT variant, d, symbol, ROUND(SUM(factor_weight * factor_score) / SUM(factor_weight), 6) AS score FROM factors GROUP BY 1, 2, 3),
ranked AS (SELECT comp.*, trend, setup, fwd20, CAST(ROW_NUMBER() OVER (PARTITION BY variant, comp.d ORDER BY score DESC, comp.symbol) AS INT) AS place, CASE WHEN score >= 70 THEN 'Research candidate' WHEN score <= 30 AND trend = 'downtrend' THEN 'Avoid' ELSE 'Watchlist' END AS label FROM comp JOIN picked ON comp.symbol = picked.symbol AND comp.d = picked.d)"""
_PER = f""", got AS (SELECT variant, d, symbol, ROUND(score, 1) AS score, ROUND(fwd20, 9) AS fwd FROM ranked),
g2 AS (SELECT *, {_pct('score', 'variant, d')} AS rs, {_pct('fwd', 'variant, d')} AS rf, COUNT(*) OVER (PARTITION BY variant, d) AS n, ROW_NUMBER() OVER (PARTITION BY variant, d ORDER BY score DESC, symbol) AS up FROM got),
per0 AS (SELECT variant, d, COUNT(*) AS n, COVAR_POP(rs, rf) / NULLIF(STDDEV_POP(rs) * STDDEV_POP(rf), 0) AS ic, AVG(CASE WHEN up <= GREATEST(n // 4, 1) THEN fwd END) AS top, AVG(CASE WHEN up > n - GREATEST(n // 4, 1) THEN fwd END) AS bottom, AVG(CASE WHEN up <= n // 2 THEN fwd END) AS upper, AVG(CASE WHEN up > n - n // 2 THEN fwd END) AS lower FROM g2 GROUP BY 1, 2),
per AS (SELECT variant, d, n, ROUND(ic, 6) AS ic, ROUND(top, 6) AS top, ROUND(bottom, 6) AS bottom, ROUND(top - bottom, 6) AS spread, ROUND(upper - lower, 6) AS half_spread FROM per0 WHERE n >= 5)"""


def _four(c: str) -> str:
    return f"ROUND(AVG({c}), 5) AS {c}_mean, ROUND(STDDEV_POP({c}), 5) AS {c}_sd, ROUND(AVG({c}) / NULLIF(STDDEV_POP({c}), 0) * SQRT(COUNT({c})), 4) AS {c}_t, ROUND(AVG(CASE WHEN {c} > 0 THEN 1E0 WHEN {c} IS NOT NULL THEN 0E0 END) * 100, 4) AS {c}_win"


_B = "bars market company signals reports shorts sectors macro_state"
_P = "bars market"
_R = ("technical", "contrarian")
_MACRO_COLUMNS = "macro_score, bear_risk, regime_confidence, sector_fit, credit_stress"
_BOARD = RET + f""", mk AS (SELECT d, close / LAG(close, 25) OVER (ORDER BY d) - 1 AS m20 FROM market),
b0 AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age, AVG(close) {_rows(50)} AS ma50, AVG(close) {_rows(20)} AS ma20, MAX(close) {_rows(20)} AS hi20, MIN(low) {_rows(20)} AS support, MAX(high) {_rows(20)} AS resistance, close / LAG(close, 5) OVER ({W}) - 1 AS ret5, close / LAG(close, 25) OVER ({W}) - 1 AS ret20,
 STDDEV_SAMP(ret) {_rows(20)} AS sd20, STDDEV_SAMP(close) OVER (PARTITION BY symbol) AS sd_close, GREATEST(high - low, ABS(high - LAG(close) OVER ({W})), ABS(low - LAG(close) OVER ({W}))) AS tr, AVG(close * volume) {_rows(20)} / 1E6 AS adv_musd FROM ret),
b1 AS (SELECT *, AVG(tr) {_rows(20)} AS atr, ma50 - CASE WHEN rn - 9 >= 50 THEN LAG(ma50, 9) OVER ({W}) ELSE ma50 END AS slope FROM b0),
b2 AS (SELECT b1.*, ret20 - m20 AS rs, (close - support) / NULLIF(resistance - support, 0) * 100 AS range_pctile,
 CASE WHEN close > ma50 AND slope > 0 THEN 'uptrend' WHEN close < ma50 AND slope < 0 THEN 'downtrend' WHEN ABS(slope) < sd_close * 0.001 THEN 'range' ELSE 'transitioning' END AS trend,
 CASE WHEN close >= hi20 AND ret5 > 0 THEN 'breakout' WHEN close > ma50 AND ABS(close / ma50 - 1) < 0.02 THEN 'pullback_retest' WHEN close > ma50 AND close > ma20 AND ret20 > 0 THEN 'continuation' WHEN ABS(close / ma50 - 1) < 0.04 THEN 'range_approach' WHEN close < ma50 AND ret5 > 0 THEN 'reversal' WHEN close < ma50 THEN 'mean_reversion' ELSE 'unavailable' END AS setup
 FROM b1 LEFT JOIN mk ON b1.d = mk.d WHERE age = 1 AND rn >= 50),
board AS (SELECT *, CASE WHEN trend = 'uptrend' AND setup IN ('breakout', 'pullback_retest') AND COALESCE(range_pctile, 30) >= 30 AND COALESCE(rs, 0) >= 0 THEN 'Research candidate' WHEN trend = 'downtrend' AND rs < -0.05 THEN 'Avoid' ELSE 'Watchlist' END AS label,
 CASE trend WHEN 'uptrend' THEN CASE setup WHEN 'breakout' THEN 'trend extension' WHEN 'pullback_retest' THEN 'pullback in an uptrend' WHEN 'continuation' THEN 'trend continuation' ELSE 'uptrend without a trigger' END WHEN 'downtrend' THEN CASE setup WHEN 'reversal' THEN 'bounce in a downtrend' ELSE 'downtrend intact' END WHEN 'range' THEN 'consolidation' ELSE 'transition' END AS outlook FROM b2)"""
ORACLE_SQL = {
    "dom11_dashboard": oracle(_P, _BOARD + " SELECT symbol, d, close, trend, setup, label, outlook, ROUND(support, 6) AS support, ROUND(resistance, 6) AS resistance, ROUND(close / support - 1, 6) AS to_support, ROUND(resistance / close - 1, 6) AS to_resistance, ROUND(sd20, 6) AS sd20, ROUND(sd20 * SQRT(252), 6) AS vol_annual, ROUND(atr, 6) AS atr, ROUND(range_pctile, 6) AS range_pctile, ROUND(rs, 6) AS rs, ROUND(adv_musd, 6) AS adv_musd FROM board"),
    "top06_table_order": oracle(_P, _BOARD + " SELECT CAST(ROW_NUMBER() OVER (ORDER BY CASE label WHEN 'Research candidate' THEN 0 WHEN 'Watchlist' THEN 1 ELSE 2 END, COALESCE(NULLIF(ROUND(rs, 9), 0), -999) DESC, symbol) AS INT) AS place, symbol, label, ROUND(rs, 6) AS rs FROM board"),
    "dom01_features": oracle(_B, _TODAY + " SELECT symbol, d, trend, setup, " + ", ".join(f"ROUND({f}, 6) AS {f}" for f in S.FIELDS) + " FROM picked"),
    "dom01_price_features": oracle(_P, re.sub(rf", 9\) AS ({'|'.join(S.PRICE_FIELDS)})\b", r", 300) AS \1", _PRICES) + " SELECT symbol, d, trend, setup, " + ", ".join(f"ROUND({f} + {NUDGE!r}, 6) AS {f}" for f in S.PRICE_FIELDS) + " FROM prices"),
    "dom01_event_features": oracle("bars reports shorts", _event_sql("bars") + " SELECT symbol, d, days_since_report, days_to_report, " + ", ".join(f"ROUND({f} + {NUDGE!r}, 6) AS {f}" for f in _EVENT_COLUMNS) + " FROM ef"),
    "dat03_days_to_events": oracle("reports shorts", f", e AS (SELECT symbol, 'report' AS kind, d FROM reports UNION ALL SELECT symbol, 'ex_dividend', d FROM shorts) SELECT symbol, kind, MIN(d) AS next, CAST(MIN(d) - DATE '{_DAY}' AS INT) AS days FROM e WHERE d >= DATE '{_DAY}' GROUP BY 1, 2"),
    "top09_upcoming_events": oracle("reports", f"SELECT symbol, d, CAST(d - DATE '{_DAY}' AS INT) AS days FROM reports WHERE d BETWEEN DATE '{_DAY}' AND DATE '{_DAY}' + 60"),
    "top09_recent_events": oracle("reports", f"SELECT symbol, d, CAST(d - DATE '{_DAY}' AS INT) AS days FROM reports WHERE d < DATE '{_DAY}' ORDER BY d DESC, symbol LIMIT 10"),
    "joi03_signals": oracle(_B, _PRICES + _LAST + _SIGNALS + " SELECT * FROM sig"),
    "joi04_macro_on_symbols": oracle(_B, _PRICES + _LAST + _MACRO + f" SELECT symbol, {_MACRO_COLUMNS} FROM mac"),
    "dom04_submetric_scores": oracle(_B, _TODAY + _spec() + _SCORES + " SELECT variant, symbol, factor, sub_metric, ROUND(score, 6) AS score FROM scores"),
    "dom05_rank": oracle(_B, _TODAY + _spec() + _SCORES + " SELECT variant, d, symbol, score, place, trend, setup, label FROM ranked"),
    "dom05_breakdown": oracle(_B, _TODAY + _spec() + _SCORES + " SELECT variant, symbol, factor, ROUND(factor_score, 6) AS factor_score FROM factors"),
    "dom07_regime_tilt": oracle(_B, _TODAY + _spec(("default",)).replace(", spec(", ", spec0(", 1) + _TILTED + _SCORES + " SELECT symbol, score, place, label FROM ranked"),
    "dom09_backtest": oracle(_P, _REBALANCE + _spec(_R) + _SCORES + _PER + " SELECT * FROM per"),
    "agg13_backtest_summary": oracle(_P, _REBALANCE + _spec(_R) + _SCORES + _PER + f" SELECT variant, COUNT(*) AS n, {_four('ic')}, {_four('spread')} FROM per GROUP BY 1"),
    "agg14_symbol_summary": oracle(_P, _REBALANCE + _spec(_R) + _SCORES + " SELECT variant, symbol, COUNT(*) AS n, ROUND(AVG(score), 5) AS score_mean, ROUND(AVG(fwd20), 6) AS fwd_mean, " + ", ".join(f"COUNT(CASE WHEN label = '{x}' THEN 1 END) AS n_{x.split()[0].lower()}" for x in S.LABELS) + " FROM ranked GROUP BY 1, 2"),
    "top01_by_sector": oracle(_B, _TODAY + _spec() + _SCORES + " SELECT * FROM (SELECT variant, sector, ranked.symbol, score, CAST(ROW_NUMBER() OVER (PARTITION BY variant, sector ORDER BY score DESC, ranked.symbol) AS INT) AS in_sector, COUNT(*) OVER (PARTITION BY variant, sector) AS candidates FROM ranked JOIN sectors ON ranked.symbol = sectors.symbol) x WHERE in_sector <= 3"),
    "agg07_z_scores": oracle(_P, _PRICES + " SELECT symbol, d, ROUND(COALESCE(GREATEST(LEAST((rs_1m - AVG(rs_1m) OVER w) / NULLIF(STDDEV_POP(rs_1m) OVER w, 0), 2), CASE WHEN rs_1m IS NOT NULL AND STDDEV_POP(rs_1m) OVER w > 0 THEN -2 END), 0), 5) AS z FROM prices WINDOW w AS (PARTITION BY d)"),
}
