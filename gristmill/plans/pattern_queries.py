"""Queries of chart patterns walked forward, their statistics, and what rests on them, with their SQL.

The SQL cuts each symbol's bars off at every as-of bar and runs the detectors
on what is left, so it knows nothing of how the operators find the patterns
that are in sight.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C, forecast as P, options as O, research as R
from ..sources.views import SQL, held, oracle, view
from . import context_queries as X
from .context_queries import _FLAGS, _IN, _RECTANGLES, _STATES, _TRIANGLES
from .forecast_queries import _OUT, _PAPER, _PAST, _fc
from .indicator_queries import W
from .option_queries import ORACLE_SQL as OPTION_SQL, QUERIES as Q


def _bars(spark, sf_dir):
    return held(view(spark, sf_dir, "bars"))


def _detections(bars):
    f = held(C.frame(bars))
    return C.detections(f, C.walk(f))


def _stats(bars):
    return C.pattern_statistics(_detections(bars))


def _at_forecasts(bars):
    """The first live pattern at each bar from which a forecast is made."""
    f = held(C.frame(bars))
    ends = C.as_of_bars(f, F.col("rn") % P.EVERY == 0)
    return C.top_pattern(C.patterns_at(f, ends)).join(ends.select("symbol", "n", F.col("as_of").alias("d")), ["symbol", "n"]).select("symbol", "d", "pattern")


def dom22_detections(spark, sf_dir):
    return _detections(_bars(spark, sf_dir))


def dom22_pattern_backtest(spark, sf_dir):
    return _stats(_bars(spark, sf_dir))


def agg15_pattern_stats(spark, sf_dir):
    """The statistics that the gate and the forecast ask for."""
    return _stats(_bars(spark, sf_dir)).select("symbol", "pattern", "n", "hit_rate", F.col("avg_return_4w").alias("avg_return"))


def top08_top_pattern(spark, sf_dir):
    f = held(C.frame(_bars(spark, sf_dir)))
    return C.top_pattern(C.patterns_at(f, C.at_last(f))).select("symbol", "pattern", "state")


def _latest(bars):
    f = held(C.frame(bars))
    stats = C.pattern_statistics(C.detections(f, C.walk(f))).select("symbol", "pattern", "n", "hit_rate", F.col("avg_return_4w").alias("avg_return"))
    return C.top_pattern(C.patterns_at(f, C.at_last(f))).select("symbol", "pattern", "state", "trigger").join(stats, ["symbol", "pattern"], "left")


def joi16_latest_pattern(spark, sf_dir):
    return _latest(_bars(spark, sf_dir))


def dom27_forecast(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    surface = O.at_the_money(view(spark, sf_dir, "chain")).groupBy("underlying", "dte").agg(F.avg("iv").alias("iv"))
    return P.bands(bars, surface, _latest(bars), latest=True).drop("rn")


def agg16_pattern_calibration(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    known = _stats(bars).where("n >= 10").select("symbol", "pattern")
    named = _at_forecasts(bars).join(known, ["symbol", "pattern"], "left_semi").select("symbol", "d", F.lit(True).alias("used"))
    outcomes = P.resolved(P.bands(bars), bars).join(named, ["symbol", "d"], "left")
    return P.pattern_calibration(outcomes.withColumn("pattern_used", F.coalesce("used", F.lit(False))))


def agg18_gate(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    signals = P.paper_signals(P.bands(bars), bars).join(_at_forecasts(bars), ["symbol", "d"])
    return P.validation(signals, agg15_pattern_stats(spark, sf_dir))


def dom36_deep_layers(spark, sf_dir):
    """Nine layers of each symbol from the operators that stand by themselves, with a line for each, as flat columns."""
    bars = _bars(spark, sf_dir)
    levels = X.dom15_sr_levels(spark, sf_dir).where("place = 1").groupBy("symbol").agg(*(F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{k}_{c}") for k in ("support", "resistance") for c in ("price", "distance_pct")))
    gaps = X.win19_gap_zones(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("open"), F.min("age").alias("latest"))
    moves = Q["dom25_expected_moves"](spark, sf_dir).withColumnRenamed("underlying", "symbol")
    moves = moves.groupBy("symbol").agg(F.min_by(F.struct("dte", "consensus", "recommendation"), "dte").alias("m")).select("symbol", "m.*")
    month = P.bands(bars, None, _latest(bars), latest=True).where("horizon = 21").select("symbol", "median", "lo68", "hi68", "method")
    said = lambda *parts: F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    c = F.col
    layers = {
        "trend": (C.trend_record(bars).select("symbol", "direction", "alignment", "higher"), said(c("direction"), c("alignment"))),
        "levels": (levels, said("between", F.when(c("support_price").isNull(), "none").otherwise("support"), "and", F.when(c("resistance_price").isNull(), "none").otherwise("resistance"))),
        "pattern": (top08_top_pattern(spark, sf_dir), said(c("pattern"), c("state"))),
        "chart": (C.chart_scores(bars).select("symbol", "total", "grade"), said("grade", c("grade"))),
        "gaps": (gaps, said(c("open"), "open")),
        "moves": (moves, said(c("dte"), "days", c("recommendation"))),
        "forecast": (month, said("month by", c("method"))),
        "flow": (X.dom34_flow(spark, sf_dir).select("symbol", "short_class", "flow"), said(F.coalesce("short_class", F.lit("unknown")))),
        "events": (X.dom35_event_bundle(spark, sf_dir).select("symbol", "news_count", "news_sentiment", "short_change", "bullish_share"), said(F.coalesce(c("news_count"), F.lit(0)), "news")),
    }
    return R.flattened(R.layered(view(spark, sf_dir, "sectors"), layers))


QUERIES = {f.__name__: f for f in (dom22_detections, dom22_pattern_backtest, agg15_pattern_stats, top08_top_pattern, joi16_latest_pattern, dom27_forecast, agg16_pattern_calibration, agg18_gate, dom36_deep_layers)}

_WALK = f"rn >= {C.WALK_FROM} AND (rn - {C.WALK_FROM}) % {C.WALK_EVERY} = 0 AND rn < bars_n - {C.WALK_SHORT}"


def _cut_off(when: str) -> str:
    """Common table expressions with ends, the as-of bars, and found, the patterns of the bars up to each of them."""
    found = " UNION ALL ".join(
        f"SELECT symbol AS key, pattern, state, trigger FROM {_IN(chain, tail)} y"
        for chain, tail in ((_STATES, " SELECT * FROM states"), (_TRIANGLES, ""), (_RECTANGLES, ""), (_FLAGS, ""))
    )
    return f"""whole AS ({SQL["bars"]}),
num AS MATERIALIZED (SELECT *, CAST(ROW_NUMBER() OVER ({W}) AS INT) AS rn, COUNT(*) OVER (PARTITION BY symbol) AS bars_n, LEAD(close, 5) OVER ({W}) AS c5, LEAD(close, 10) OVER ({W}) AS c10, LEAD(close, 20) OVER ({W}) AS c20 FROM whole),
ends AS MATERIALIZED (SELECT symbol || '@' || rn AS key, symbol, rn AS n, d AS as_of, close AS spot, c5 / close - 1 AS fwd_1w, c10 / close - 1 AS fwd_2w, c20 / close - 1 AS fwd_4w FROM num WHERE {when}),
bars AS MATERIALIZED (SELECT key AS symbol, d, open, high, low, close, volume FROM ends JOIN num ON num.symbol = ends.symbol AND num.rn <= ends.n),
found AS MATERIALIZED ({found})"""


def _names(names: tuple[str, ...]) -> str:
    return "pattern IN (" + ", ".join(f"'{n}'" for n in names) + ")"


_DETECTIONS = f"""WITH {_cut_off(_WALK)},
det AS MATERIALIZED (SELECT symbol, n, as_of, pattern, state, trigger, spot, fwd_1w, fwd_2w, fwd_4w,
  CASE WHEN fwd_4w IS NULL THEN NULL WHEN {_names(C.BULLISH)} OR (NOT {_names(C.BULLISH)} AND NOT {_names(C.BEARISH)} AND state = 'confirmed' AND trigger > spot) THEN fwd_4w >= {C.HIT_MOVE} ELSE fwd_4w <= -{C.HIT_MOVE} END AS hit
  FROM found JOIN ends USING (key))"""
_STATISTICS = f"""{_DETECTIONS},
late AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY symbol, pattern) AS n_total, ROW_NUMBER() OVER (PARTITION BY symbol, pattern ORDER BY n) AS i FROM det) q WHERE n_total >= 10 AND i > FLOOR(n_total * 0.5)),
stats AS (SELECT symbol, pattern, COUNT(*) AS n, MAX(n_total) AS n_total, ROUND(AVG(CAST(hit AS DOUBLE)), 6) AS hit_rate, ROUND(AVG(fwd_1w), 9) AS avg_return_1w, ROUND(AVG(fwd_2w), 9) AS avg_return_2w, ROUND(AVG(fwd_4w), 9) AS avg_return_4w,
  ROUND(MEDIAN(fwd_4w), 9) AS median_return_4w, ROUND(AVG(CAST(ABS(fwd_4w) >= 0.01 AS DOUBLE)), 6) AS win_rate_1pct FROM late GROUP BY 1, 2)"""
_PLAIN_STATS = f"({_STATISTICS} SELECT symbol, pattern, n, hit_rate, avg_return_4w AS avg_return FROM stats)"
_PLACE = "CASE pattern " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(C.ORDER)) + " END"


def _top(when: str) -> str:
    """The first live pattern at each as-of bar."""
    return f"(WITH {_cut_off(when)} SELECT symbol, n, as_of AS d, pattern, state, trigger FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY CASE state WHEN 'confirmed' THEN 0 ELSE 1 END, {_PLACE}) AS k_ FROM found JOIN ends USING (key) WHERE state <> 'failed') x WHERE k_ = 1)"


_LATEST = f", stats AS MATERIALIZED {_PLAIN_STATS}, latest AS (SELECT t.symbol, t.pattern, t.state, t.trigger, s.n, s.hit_rate, s.avg_return FROM {_top('rn = bars_n')} t LEFT JOIN stats s ON s.symbol = t.symbol AND s.pattern = t.pattern)"
_NAMED = f", stats AS MATERIALIZED {_PLAIN_STATS}, named AS MATERIALIZED (SELECT symbol, d, pattern FROM {_top(f'rn % {P.EVERY} = 0')} q)"

_MEANS = ", ".join(
    f"COUNT(CASE WHEN {c} THEN 1 END) AS n_{k}, AVG(CASE WHEN {c} THEN CAST(in68 AS DOUBLE) END) AS cov68_{k}, AVG(CASE WHEN {c} THEN CAST(in90 AS DOUBLE) END) AS cov90_{k}, ROUND(AVG(CASE WHEN {c} THEN error END), 9) AS error_{k}"
    for k, c in (("with", "used"), ("without", "NOT used"))
)
ORACLE_SQL = {
    "dom22_detections": f"{_DETECTIONS} SELECT * FROM det",
    "dom22_pattern_backtest": f"{_STATISTICS} SELECT * FROM stats",
    "agg15_pattern_stats": f"SELECT * FROM {_PLAIN_STATS} q",
    "top08_top_pattern": f"SELECT symbol, pattern, state FROM {_top('rn = bars_n')} q",
    "joi16_latest_pattern": oracle("bars", _LATEST + " SELECT * FROM latest"),
    "dom27_forecast": oracle("bars chain", _LATEST + _fc("rn = last_rn", True, True) + " SELECT symbol, d, horizon, spot, sigma, method, " + ", ".join(P.Z) + " FROM fc"),
    "agg16_pattern_calibration": oracle("bars", _NAMED + _OUT + f""", u AS (SELECT o.*, k.symbol IS NOT NULL AS used FROM outcomes o LEFT JOIN (SELECT named.symbol, d FROM named JOIN stats s ON s.symbol = named.symbol AND s.pattern = named.pattern AND s.n >= 10) k ON o.symbol = k.symbol AND o.d = k.d),
g AS (SELECT horizon, {_MEANS} FROM u GROUP BY 1)
SELECT horizon, n_with, ROUND(cov68_with, 6) AS cov68_with, ROUND(cov90_with, 6) AS cov90_with, error_with, n_without, ROUND(cov68_without, 6) AS cov68_without, ROUND(cov90_without, 6) AS cov90_without, error_without, ROUND(ABS(cov68_with - 0.68) - ABS(cov68_without - 0.68), 6) AS improve68, ROUND(ABS(cov90_with - 0.90) - ABS(cov90_without - 0.90), 6) AS improve90, CASE WHEN n_with + n_without < 10 THEN 'insufficient_data' WHEN n_with + n_without < 30 THEN 'preliminary' ELSE 'mature' END AS status FROM g"""),
    "agg18_gate": oracle("bars", _NAMED + _PAST + _PAPER + """, nm AS (SELECT s.*, k.pattern FROM signals s JOIN named k ON s.symbol = k.symbol AND s.d = k.d),
fwd AS (SELECT symbol, pattern, COUNT(CASE WHEN horizon = 21 AND actual_return IS NOT NULL THEN 1 END) AS forward_n, AVG(CASE WHEN horizon = 21 AND actual_return IS NOT NULL THEN CAST(in68 AS DOUBLE) END) AS hit, AVG(CASE WHEN horizon = 21 THEN actual_return END) AS mean, AVG(CAST(in68 AS DOUBLE)) AS cov68, AVG(CAST(in90 AS DOUBLE)) AS cov90 FROM nm GROUP BY 1, 2),
v AS (SELECT s.symbol, s.pattern, n, COALESCE(forward_n, 0) AS forward_n, hit, mean, cov68, cov90, COALESCE(CAST(hit_rate >= 0.4 AS INT), 0) + COALESCE(CAST(hit >= 0.5 * hit_rate AS INT), 0) + COALESCE(CAST(mean >= 0.5 * avg_return AS INT), 0) + COALESCE(CAST(ABS(cov68 - 0.68) <= 0.10 AND ABS(cov90 - 0.90) <= 0.10 AS INT), 0) AS passed FROM stats s LEFT JOIN fwd f ON s.symbol = f.symbol AND s.pattern = f.pattern)
SELECT symbol, pattern, n, forward_n, ROUND(hit, 9) AS hit, ROUND(mean, 9) AS mean, ROUND(cov68, 9) AS cov68, ROUND(cov90, 9) AS cov90, passed, CASE WHEN n < 10 THEN 'OOS-conditional' WHEN forward_n < 21 THEN 'validating' WHEN passed = 4 THEN 'validated' WHEN passed >= 2 THEN 'validating' ELSE 'failed_validation' END AS status FROM v"""),
}

_MONTH = oracle("bars", _LATEST + _fc("rn = last_rn", False, True) + " SELECT symbol, horizon, median, lo68, hi68, method FROM fc")
#: name, its rows by symbol, their columns, the line
_LAYERS = [
    ("trend", X.ORACLE_SQL["dom14_trend_record"], "direction alignment higher", "direction || ' ' || alignment"),
    ("levels", "SELECT symbol, " + ", ".join(f"MAX(CASE WHEN side = '{k}' THEN {c} END) AS {k}_{c}" for k in ("support", "resistance") for c in ("price", "distance_pct")) + f" FROM ({X.ORACLE_SQL['dom15_sr_levels']}) q WHERE place = 1 GROUP BY 1",
     "support_price support_distance_pct resistance_price resistance_distance_pct", "'between ' || CASE WHEN support_price IS NULL THEN 'none' ELSE 'support' END || ' and ' || CASE WHEN resistance_price IS NULL THEN 'none' ELSE 'resistance' END"),
    ("pattern", ORACLE_SQL["top08_top_pattern"], "pattern state", "pattern || ' ' || state"),
    ("chart", X.ORACLE_SQL["dom21_chart_total"], "total grade", "'grade ' || grade"),
    ("gaps", f"SELECT symbol, COUNT(*) AS open, MIN(age) AS latest FROM ({X.ORACLE_SQL['win19_gap_zones']}) q GROUP BY 1", "open latest", "CAST(open AS VARCHAR) || ' open'"),
    ("moves", f"SELECT underlying AS symbol, MIN(dte) AS dte, ARG_MIN(consensus, dte) AS consensus, ARG_MIN(recommendation, dte) AS recommendation FROM ({OPTION_SQL['dom25_expected_moves']}) q GROUP BY 1", "dte consensus recommendation", "CAST(dte AS VARCHAR) || ' days ' || recommendation"),
    ("forecast", f"SELECT * FROM ({_MONTH}) q WHERE horizon = 21", "median lo68 hi68 method", "'month by ' || method"),
    ("flow", X.ORACLE_SQL["dom34_flow"], "short_class flow", "COALESCE(short_class, 'unknown')"),
    ("events", X.ORACLE_SQL["dom35_event_bundle"], "news_count news_sentiment short_change bullish_share", "CAST(COALESCE(news_count, 0) AS VARCHAR) || ' news'"),
]
_COLUMNS = ", ".join(", ".join(f"{n}.{c} AS {n}_{c}" for c in columns.split()) + f", COALESCE({n}.said_, 'n/a') AS {n}_summary" for n, _, columns, _ in _LAYERS)
_COUNTED = " + ".join(f"CAST({n}.symbol IS NOT NULL AS INT)" for n, *_ in _LAYERS)
ORACLE_SQL["dom36_deep_layers"] = oracle("sectors", f"SELECT s.symbol, {_COLUMNS}, CAST({_COUNTED} AS INT) AS layers FROM (SELECT DISTINCT symbol FROM sectors) s " + " ".join(f"LEFT JOIN (SELECT *, {line} AS said_ FROM ({sql}) z) {n} ON {n}.symbol = s.symbol" for n, sql, _, line in _LAYERS))
