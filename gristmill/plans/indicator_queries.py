"""Queries of single indicators on daily bars, with their SQL."""

from __future__ import annotations

from ..operators import indicators as I
from ..sources.views import oracle, view


def _on(name: str, f, *more: str):
    return lambda spark, sf_dir: f(view(spark, sf_dir, name), *(view(spark, sf_dir, m) for m in more))


def _regimes(bars):
    return I.run_lengths(I.average_slope_regime(bars), "regime")


def _ranks(bars):
    from pyspark.sql import functions as F

    df = I.with_returns(bars)
    return df.select("symbol", "d", F.round("ret", 9).alias("ret")).withColumn("pct_rank", F.round(I.percentile_rank("ret", "d"), 6)).select("symbol", "d", "pct_rank")


QUERIES = {
    "src01_bars": lambda spark, sf_dir: view(spark, sf_dir, "bars"),
    "agg01_weekly_bars": _on("bars", I.weekly),
    "agg02_day_of_week_drift": _on("bars", I.weekday_returns),
    "agg03_month_of_year_drift": _on("bars", I.month_returns),
    "agg05_volume_profile": _on("bars", I.volume_profile),
    "win01_returns": _on("bars", lambda b: I.with_returns(b).select("symbol", "d", I.r6(I.F.col("ret"), "ret"), I.r6(I.F.col("logret"), "logret"))),
    "win02_moving_averages": _on("bars", I.moving_averages),
    "win03_realized_vol": _on("bars", I.realized_volatility),
    "win04_log_vol": _on("bars", I.log_volatility),
    "win05_atr": _on("bars", I.average_true_range),
    "win06_support_resistance": _on("bars", I.support_resistance),
    "win07_rsi14": _on("bars", I.rsi),
    "win08_macd": _on("bars", I.macd),
    "win09_max_drawdown": _on("bars", I.max_drawdown),
    "win10_trend_slope": _on("bars", I.trend_slope),
    "win12_horizon_returns": _on("bars", I.horizon_returns, "market"),
    "win13_vol_percentile": _on("bars", I.volatility_percentile),
    "win14_volume_ratios": _on("bars", I.volume_ratios),
    "win15_accumulation": _on("bars", I.accumulation),
    "win16_swings": _on("bars", lambda b: I.swings(b).where("is_high or is_low").select("symbol", "d", "is_high", "is_low")),
    "win17_swing_counts": _on("bars", I.swing_counts),
    "win18_anchored_vwap": _on("bars", I.anchored_vwap),
    "win19_unfilled_gaps": _on("bars", I.unfilled_gaps),
    "win20_percentile_rank": _on("bars", _ranks),
    "win21_return_quantiles": _on("bars", I.return_quantiles),
    "win22_forward_returns": _on("bars", I.forward_returns),
    "win23_vol_median": _on("bars", I.volatility_median),
    "win24_regime_features": _on("bars", I.regime_features),
    "win25_run_lengths": _on("bars", lambda b: _regimes(b).select("symbol", "d", "regime", "duration")),
    "win28_average_slope": _on("bars", I.average_slope_regime),
}

W = "PARTITION BY symbol ORDER BY d"
RET = f", ret AS (SELECT *, close / LAG(close) OVER ({W}) - 1 AS ret, LN(close) - LN(LAG(close) OVER ({W})) AS logret FROM bars)"


def _rows(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(value: str, n: int, of: str = "close") -> str:
    return f"CASE WHEN COUNT({of}) {_rows(n)} = {n} THEN {value} END"


def _r(value: str, name: str, k: int = 6) -> str:
    return f"ROUND({value}, {k}) AS {name}"


def _ewm_sql(src: str, value: str, alpha: float, out: str) -> str:
    g = 1 / (1 - alpha)
    return f"(SELECT *, CASE WHEN i_{out} > 0 THEN SUM(CASE WHEN {value} IS NOT NULL THEN {value} * (CASE WHEN i_{out} = 1 THEN 1E0 ELSE {alpha!r} * POW({g!r}, i_{out} - 1) END) END) OVER ({W}) / POW({g!r}, i_{out} - 1) END AS {out} FROM (SELECT *, COUNT({value}) OVER ({W}) AS i_{out} FROM {src}) q_{out})"


_STEPS = (5, 21, 63, 126, 252)
_REGIME = f"""(SELECT symbol, d, CASE WHEN ma50 / was - 1 > 0.005 THEN 'rising' WHEN ma50 / was - 1 < -0.005 THEN 'falling' WHEN was IS NOT NULL AND ma50 IS NOT NULL THEN 'flat' ELSE 'n/a' END AS regime
 FROM (SELECT *, LAG(ma50, 9) OVER ({W}) AS was FROM (SELECT *, {_full('AVG(close) ' + _rows(50), 50)} AS ma50 FROM bars) a) b)"""
_SWINGS = f"""(SELECT *, n = 11 AND high >= hi AS is_high, n = 11 AND low <= lo AS is_low FROM (SELECT *, COUNT(*) OVER w AS n, MAX(high) OVER w AS hi, MIN(low) OVER w AS lo FROM bars WINDOW w AS ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) s)"""

ORACLE_SQL = {
    "src01_bars": oracle("bars", "SELECT * FROM bars"),
    "agg01_weekly_bars": oracle("bars", "SELECT symbol, CAST(DATE_TRUNC('week', d) AS DATE) AS wk, ARG_MIN(open, d) AS open, MAX(high) AS high, MIN(low) AS low, ARG_MAX(close, d) AS close, CAST(SUM(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2"),
    "agg02_day_of_week_drift": oracle("bars", RET + " SELECT symbol, CAST(ISODOW(d) - 1 AS INT) AS wd, ROUND(AVG(ret), 6) AS mean, ROUND(STDDEV_SAMP(ret), 6) AS sd, COUNT(*) AS n FROM ret WHERE ret IS NOT NULL GROUP BY 1, 2"),
    "agg03_month_of_year_drift": oracle("bars", "SELECT symbol, m, ROUND(AVG(r), 6) AS mean, ROUND(MEDIAN(r), 6) AS median, COUNT(*) AS n FROM (SELECT symbol, YEAR(d) AS y, CAST(MONTH(d) AS INT) AS m, ARG_MAX(close, d) / ARG_MIN(close, d) - 1 AS r FROM bars GROUP BY 1, 2, 3) x GROUP BY 1, 2"),
    "agg05_volume_profile": oracle("bars", """, x AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM bars) a WHERE age <= 60),
y AS (SELECT *, (high + low + close) / 3 AS tp, MIN(low) OVER (PARTITION BY symbol) AS lo, MAX(high) OVER (PARTITION BY symbol) AS hi FROM x),
f AS (SELECT symbol, CAST(LEAST(FLOOR((tp - lo) / (hi - lo) * 20), 19) AS INT) AS bin, SUM(volume) AS volume FROM y WHERE hi > lo GROUP BY 1, 2),
g AS (SELECT s.symbol, CAST(b.bin AS INT) AS bin, COALESCE(f.volume, 0) AS volume FROM (SELECT DISTINCT symbol FROM f) s CROSS JOIN (SELECT UNNEST(RANGE(20)) AS bin) b LEFT JOIN f ON f.symbol = s.symbol AND f.bin = b.bin)
SELECT symbol, bin, CAST(volume AS BIGINT) AS volume, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) = 1 AS is_poc,
 COALESCE(volume >= 1.5 * AVG(volume) OVER (PARTITION BY symbol) AND volume >= LAG(volume) OVER (PARTITION BY symbol ORDER BY bin) AND volume >= LEAD(volume) OVER (PARTITION BY symbol ORDER BY bin), FALSE) AS is_node FROM g"""),
    "win01_returns": oracle("bars", RET + " SELECT symbol, d, ROUND(ret, 6) AS ret, ROUND(logret, 6) AS logret FROM ret"),
    "win02_moving_averages": oracle("bars", "SELECT symbol, d, " + ", ".join(_r(_full(f"AVG(close) {_rows(n)}", n), f"ma{n}", 8) for n in (20, 50, 200)) + " FROM bars"),
    "win03_realized_vol": oracle("bars", RET + f", v AS (SELECT symbol, d, {_full('STDDEV_SAMP(ret) ' + _rows(20), 20, 'ret')} AS a, {_full('STDDEV_SAMP(ret) ' + _rows(252), 252, 'ret')} AS b FROM ret) SELECT symbol, d, ROUND(a, 6) AS sd_short, ROUND(b, 6) AS sd_long, ROUND(a / b, 6) AS sd_ratio, ROUND(a * SQRT(252), 6) AS vol_annual FROM v"),
    "win04_log_vol": oracle("bars", RET + f", v AS (SELECT symbol, d, CASE WHEN COUNT(logret) {_rows(30)} >= 2 THEN STDDEV_SAMP(logret) {_rows(30)} * SQRT(252) END AS v FROM ret) SELECT symbol, d, ROUND(CASE WHEN v <= 5 THEN v END, 6) AS vol FROM v"),
    "win05_atr": oracle("bars", f", t AS (SELECT *, GREATEST(high - low, ABS(high - LAG(close) OVER ({W})), ABS(low - LAG(close) OVER ({W}))) AS tr FROM bars) SELECT symbol, d, ROUND(tr, 6) AS tr, " + ", ".join(_r(_full(f"AVG(tr) {_rows(n)}", n), f"atr{n}") for n in (14, 20)) + " FROM t"),
    "win06_support_resistance": oracle("bars", f", t AS (SELECT symbol, d, close, COUNT(close) {_rows(20)} AS n, MIN(low) {_rows(20)} AS lo, MAX(high) {_rows(20)} AS hi FROM bars) SELECT symbol, d, CASE WHEN n = 20 THEN lo END AS support, CASE WHEN n = 20 THEN hi END AS resistance, ROUND(CASE WHEN n = 20 AND hi > lo THEN (close - lo) / (hi - lo) * 100 END, 6) AS range_pct FROM t"),
    "win07_rsi14": oracle("bars", f", c AS (SELECT symbol, d, close - LAG(close) OVER ({W}) AS chg, ROW_NUMBER() OVER ({W}) AS rn FROM bars), gl AS (SELECT *, CASE WHEN chg IS NOT NULL THEN GREATEST(chg, 0) END AS gain, CASE WHEN chg IS NOT NULL THEN GREATEST(-chg, 0) END AS loss FROM c) SELECT symbol, d, ROUND(CASE WHEN rn > 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 4) AS rsi FROM {_ewm_sql(_ewm_sql('gl', 'gain', 1 / 14, 'g'), 'loss', 1 / 14, 'l')}"),
    "win08_macd": oracle("bars", f", e AS (SELECT symbol, d, fast - slow AS macd FROM {_ewm_sql(_ewm_sql('bars', 'close', 2 / 13, 'fast'), 'close', 2 / 27, 'slow')}) SELECT symbol, d, " + ", ".join(f"ROUND(CASE WHEN rn >= 35 THEN {x} END, 5) AS {y}" for x, y in (("macd", "macd"), ("signal", "signal"), ("macd - signal", "hist"))) + f" FROM (SELECT *, ROW_NUMBER() OVER ({W}) AS rn FROM {_ewm_sql('e', 'macd', 2 / 10, 'signal')})"),
    "win09_max_drawdown": oracle("bars", f", b AS (SELECT *, ROW_NUMBER() OVER ({W}) AS rn FROM bars), p AS (SELECT x.symbol, x.d, x.rn, y.close / MAX(y.close) OVER (PARTITION BY x.symbol, x.rn ORDER BY y.rn) - 1 AS dd FROM b x JOIN b y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - 59 AND x.rn) SELECT symbol, d, ROUND(CASE WHEN rn >= 60 THEN MIN(dd) END, 6) AS drawdown FROM p GROUP BY symbol, d, rn"),
    "win10_trend_slope": oracle("bars", f", b AS (SELECT *, CAST(ROW_NUMBER() OVER ({W}) AS DOUBLE) AS rn FROM bars) SELECT symbol, d, " + _r(_full(f"REGR_SLOPE(close, rn) {_rows(50)} / AVG(close) {_rows(50)}", 50), "slope") + ", " + _r(_full(f"REGR_SLOPE(close, rn) {_rows(60)} / AVG(close) {_rows(60)} * 100", 60), "slope_pct") + ", " + _r(_full(f"REGR_R2(close, rn) {_rows(60)}", 60), "r2") + " FROM b"),
    "win12_horizon_returns": oracle("bars market", ", m AS (SELECT d, " + ", ".join(f"close / LAG(close, {n}) OVER (ORDER BY d) - 1 AS m{n}" for n in _STEPS) + " FROM market), b AS (SELECT symbol, d, close / LAG(close, 25) OVER (" + W + ") - 1 AS ret_25b, " + ", ".join(f"close / LAG(close, {n}) OVER ({W}) - 1 AS r{n}" for n in _STEPS) + " FROM bars) SELECT symbol, b.d, ROUND(ret_25b, 6) AS ret_25b, " + ", ".join(_r(f"r{n}", f"r{n}") for n in _STEPS) + ", " + ", ".join(_r(f"r{n} - m{n}", f"rs{n}") for n in _STEPS[1:]) + " FROM b LEFT JOIN m ON b.d = m.d"),
    "win13_vol_percentile": oracle("bars", RET + f", v AS (SELECT symbol, d, ROW_NUMBER() OVER ({W}) AS rn, ROUND({_full('STDDEV_SAMP(ret) ' + _rows(20), 20, 'ret')}, 9) AS v FROM ret) SELECT x.symbol, x.d, ROUND(CASE WHEN COUNT(y.v) > 0 AND MAX(x.v) IS NOT NULL THEN COUNT(CASE WHEN y.v < x.v THEN 1 END) / COUNT(y.v) * 100 WHEN COUNT(y.v) > 0 THEN 0 END, 6) AS vol_pctile FROM v x JOIN v y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - 251 AND x.rn GROUP BY x.symbol, x.d"),
    "win14_volume_ratios": oracle("bars", "SELECT symbol, d, " + _r(_full(f"AVG(volume) {_rows(5)} / AVG(volume) {_rows(20)}", 20), "v5_20") + ", " + _r(_full(f"AVG(volume) {_rows(10)} / AVG(volume) {_rows(20)}", 20), "v10_20") + ", " + _r(_full(f"volume / AVG(volume) {_rows(20)}", 20), "v1_20") + ", " + _r(_full(f"AVG(close * volume) {_rows(20)} / 1E6", 20), "adv_musd") + " FROM bars"),
    "win15_accumulation": oracle("bars", f", a AS (SELECT *, CASE WHEN high - low > 0 THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END AS mf FROM bars), b AS (SELECT *, SUM(mf) OVER ({W}) AS ad, CAST(ROW_NUMBER() OVER ({W}) AS DOUBLE) AS rn FROM a) SELECT symbol, d, " + _r(_full(f"REGR_SLOPE(ad, rn) {_rows(20)} / AVG(volume) {_rows(20)}", 20), "ad_slope", 5) + f", {_full(f'AVG(volume) {_rows(5)} / AVG(volume) {_rows(20)} > 1.2', 20)} AS expansion, {_full(f'AVG(volume) {_rows(5)} / AVG(volume) {_rows(20)} < 0.8', 20)} AS contraction FROM b"),
    "win16_swings": oracle("bars", f"SELECT symbol, d, is_high, is_low FROM {_SWINGS} WHERE is_high OR is_low"),
    "win17_swing_counts": oracle("bars", f", s AS (SELECT *, LAST_VALUE(CASE WHEN is_high THEN high END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, LAST_VALUE(CASE WHEN is_low THEN low END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM {_SWINGS}) SELECT symbol, d, CAST(SUM(CASE WHEN is_high AND high > ph THEN 1 ELSE 0 END) {_rows(60)} AS BIGINT) AS higher_highs, CAST(SUM(CASE WHEN is_low AND low > pl THEN 1 ELSE 0 END) {_rows(60)} AS BIGINT) AS higher_lows FROM s"),
    "win18_anchored_vwap": oracle("bars", f""", b AS (SELECT *, LAG(close) OVER ({W}) AS prior, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) - 1 AS age, (high + low + close) / 3 AS tp FROM bars),
k AS (SELECT symbol, 'low252' AS anchor, ARG_MIN(d, (low, d)) AS since FROM b WHERE age < 252 GROUP BY symbol UNION ALL SELECT symbol, 'low60', ARG_MIN(d, (low, d)) FROM b WHERE age < 60 GROUP BY symbol UNION ALL SELECT symbol, 'gap', MAX(d) FROM b WHERE age < 30 AND open > prior * 1.02 GROUP BY symbol)
SELECT k.symbol, anchor, since, ROUND(SUM(tp * volume) / SUM(volume), 6) AS vwap FROM b JOIN k ON b.symbol = k.symbol AND b.d >= k.since GROUP BY 1, 2, 3"""),
    "win19_unfilled_gaps": oracle("bars", f""", g AS (SELECT symbol, d, low, high, LAG(high) OVER ({W}) AS ph, LAG(low) OVER ({W}) AS pl, MIN(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fl, MAX(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fh, CAST(COUNT(*) OVER (PARTITION BY symbol) - ROW_NUMBER() OVER ({W}) AS INT) AS age FROM bars),
u AS (SELECT *, low > ph * 1.005 AND COALESCE(fl, low) > ph AS up, high < pl * 0.995 AND COALESCE(fh, high) < pl AS down FROM g)
SELECT symbol, d, CASE WHEN up THEN 'up' ELSE 'down' END AS side, CASE WHEN up THEN ph ELSE pl END AS edge, age FROM u WHERE age < 60 AND (up OR down)"""),
    "win20_percentile_rank": oracle("bars", RET + ", x AS (SELECT symbol, d, ROUND(ret, 9) AS ret FROM ret) SELECT symbol, d, ROUND(CASE WHEN ret IS NOT NULL THEN (RANK() OVER (PARTITION BY d ORDER BY ret NULLS LAST) - 1 + (COUNT(*) OVER (PARTITION BY d, ret) - 1) / 2) / GREATEST(COUNT(ret) OVER (PARTITION BY d) - 1, 1) * 100 END, 6) AS pct_rank FROM x"),
    "win21_return_quantiles": oracle("bars", RET + f", s AS (SELECT symbol, {_full('SUM(logret) ' + _rows(10), 10, 'logret')} AS s FROM ret) SELECT symbol, COUNT(*) AS n, " + ", ".join(f"ROUND(QUANTILE_CONT(s, {q}), 6) AS q{int(q * 100)}" for q in (0.05, 0.16, 0.5, 0.84, 0.95)) + " FROM s WHERE s IS NOT NULL GROUP BY 1"),
    "win22_forward_returns": oracle("bars", "SELECT symbol, d, " + ", ".join(_r(f"LEAD(close, {n}) OVER ({W}) / close - 1", f"fwd{n}") for n in (5, 10, 20)) + " FROM bars"),
    "win23_vol_median": oracle("bars", RET + f", v AS (SELECT symbol, {_full('STDDEV_SAMP(logret) ' + _rows(5), 5, 'logret')} AS v FROM ret) SELECT symbol, ROUND(MEDIAN(v), 6) AS vol_median, COUNT(v) AS n FROM v GROUP BY 1"),
    "win24_regime_features": oracle("bars", RET + f", x AS (SELECT symbol, d, ROUND({_full('STDDEV_SAMP(logret) ' + _rows(21), 21, 'logret')}, 6) AS rv, ROUND({_full('SUM(logret) ' + _rows(21), 21, 'logret')}, 6) AS cum, ROUND({_full('SUM(ABS(logret)) ' + _rows(21), 21, 'logret')}, 6) AS moved FROM ret WHERE logret IS NOT NULL) SELECT * FROM x WHERE rv IS NOT NULL"),
    "win25_run_lengths": oracle("bars", f", g AS (SELECT *, SUM(c) OVER ({W}) AS run FROM (SELECT *, CASE WHEN regime = LAG(regime) OVER ({W}) THEN 0 ELSE 1 END AS c FROM {_REGIME}) a) SELECT symbol, d, regime, CAST(ROW_NUMBER() OVER (PARTITION BY symbol, run ORDER BY d) AS INT) AS duration FROM g"),
    "win28_average_slope": oracle("bars", f"SELECT * FROM {_REGIME}"),
}
