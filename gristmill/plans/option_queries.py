"""Queries on option chains, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import indicators as I, options as O
from ..sources.views import held, oracle, view
from .indicator_queries import W


def _chain(spark, sf_dir):
    return held(view(spark, sf_dir, "chain"))


def _rounded(df, *names, k=6):
    return df.select(*(F.round(c, k).alias(c) if c in names else F.col(c) for c in df.columns))


def fil04_liquid(spark, sf_dir):
    return _rounded(_chain(spark, sf_dir).where(O.liquid()).select("underlying", "dte", "side", "strike", "bid", "ask", "oi", "vol"), "bid", "ask")


def fil06_first_expiry(spark, sf_dir):
    return O.first_expiry(_chain(spark, sf_dir))


def fil05_surface_pairs(spark, sf_dir):
    return _rounded(O.fit_for_surface(O.paired(_chain(spark, sf_dir))).select("underlying", "dte", "strike", "call_mid", "put_mid"), "call_mid", "put_mid")


def joi06_atm(spark, sf_dir):
    return _rounded(O.at_the_money(_chain(spark, sf_dir)), "mid", "iv")


def joi07_verticals(spark, sf_dir):
    return _rounded(O.verticals(_chain(spark, sf_dir)).drop("spot"), "premium", "width", "max_loss", "max_gain", "breakeven", "pop", "edge")


_FLY_COLUMNS = ("underlying", "dte", "side", "lo", "centre", "upper", "debit", "max_gain", "pop", "edge")


def joi08_butterflies(spark, sf_dir):
    return _rounded(O.butterflies(_chain(spark, sf_dir)).select(*_FLY_COLUMNS), "debit", "max_gain", "pop", "edge")


def _targets(spark, sf_dir):
    """The 20-bar average of each symbol's last bar."""
    df = view(spark, sf_dir, "bars").withColumn("target", F.avg("close").over(I.last(20)))
    return df.groupBy(F.col("symbol").alias("underlying")).agg(F.max_by("target", "d").alias("target"))


def joi09_butterfly_at_target(spark, sf_dir):
    return _rounded(O.butterfly_at_target(_chain(spark, sf_dir), _targets(spark, sf_dir)).select(*_FLY_COLUMNS, "wing", "target"), "debit", "max_gain", "pop", "edge", "target")


def agg31_survivors(spark, sf_dir):
    return O.survivors(_chain(spark, sf_dir))


def agg25_scan_summary(spark, sf_dir):
    return O.scan_summary(_chain(spark, sf_dir))


def top04_nearest_expiries(spark, sf_dir):
    return O.nearest_expiries(_chain(spark, sf_dir))


def joi10_term_structure(spark, sf_dir):
    return O.term_structure(_chain(spark, sf_dir))


def mth04_implied_vol(spark, sf_dir):
    c = _chain(spark, sf_dir).where("mid > 0.01 and strike > 0")
    t = O.years(F.col("dte"))
    return c.select("underlying", "dte", "side", "strike", F.round(O.implied_volatility(F.col("mid"), F.col("spot"), F.col("strike"), t, F.col("side")), 5).alias("implied"))


def mth04_greeks(spark, sf_dir):
    return O.greeks(_chain(spark, sf_dir))


def mth08_sigma_bands(spark, sf_dir):
    return O.sigma_bands(_chain(spark, sf_dir))


def mth09_payoff(spark, sf_dir):
    return _rounded(O.payoff_grid(O.butterflies(_chain(spark, sf_dir)).drop("pop")).groupBy("underlying", "dte", "side", "lo", "centre").agg(F.min("result").alias("worst"), F.max("result").alias("best"), F.count("*").alias("n")), "worst", "best")


def _real(spark, sf_dir):
    return O.realized(held(view(spark, sf_dir, "bars")))


def dom23_smiles(spark, sf_dir):
    return O.smiles(_chain(spark, sf_dir), _real(spark, sf_dir))


def dom25_expected_moves(spark, sf_dir):
    return O.expected_moves(_chain(spark, sf_dir), _real(spark, sf_dir))


def dom26_spread_scan(spark, sf_dir):
    columns = ("underlying", "dte", "kind", "low_strike", "high_strike", "max_loss", "edge", "pop", "contracts", "total_loss", "total_gain", "ev", "place")
    return _rounded(O.spread_scan(_chain(spark, sf_dir)).select(*columns), "max_loss", "edge", "pop")


def dom26_fly_scan(spark, sf_dir):
    columns = ("underlying", "dte", "side", "lo", "centre", "upper", "max_loss", "edge", "pop", "contracts", "total_loss", "total_gain", "ev", "place")
    return _rounded(O.fly_scan(_chain(spark, sf_dir), min_pop=0.1).select(*columns), "max_loss", "edge", "pop")


QUERIES = {f.__name__: f for f in (fil04_liquid, fil05_surface_pairs, fil06_first_expiry, joi06_atm, joi07_verticals, joi08_butterflies, joi09_butterfly_at_target, joi10_term_structure, mth04_implied_vol, mth04_greeks, mth08_sigma_bands, mth09_payoff, agg25_scan_summary, agg31_survivors, top04_nearest_expiries, dom23_smiles, dom25_expected_moves, dom26_spread_scan, dom26_fly_scan)}

_LIQUID = "oi >= CASE tier WHEN 'index' THEN 500 WHEN 'etf' THEN 500 ELSE 100 END AND vol >= 50 AND bid > 0 AND bid < ask AND ROUND((ask - bid) / mid, 9) <= 0.07"
_D1 = "((LN(spot / strike) + iv * iv / 2 * (GREATEST(dte, 1) / 365E0)) / (iv * SQRT(GREATEST(dte, 1) / 365E0)))"
_PDF = f"(EXP(-{_D1} * {_D1} / 2) / SQRT(2E0 * 3.141592653589793E0))"
_T = "(GREATEST(dte, 1) / 365E0)"
_ATM = ", atm AS (SELECT * FROM (SELECT underlying, dte, side, strike, mid, iv, spot, ROW_NUMBER() OVER (PARTITION BY underlying, dte, side ORDER BY ABS(strike - spot), strike) AS rn FROM chain) x WHERE rn = 1)"
_PAIR = ", pair AS (SELECT c.underlying, c.dte, c.strike, c.spot, c.mid AS call_mid, p.mid AS put_mid, c.iv AS call_iv, p.iv AS put_iv FROM chain c JOIN chain p ON c.underlying = p.underlying AND c.dte = p.dte AND c.strike = p.strike AND c.side = 'C' AND p.side = 'P' WHERE c.mid > 0 AND p.mid > 0 AND (c.ask - c.bid) / c.mid <= 0.3 AND (p.ask - p.bid) / p.mid <= 0.3 AND (c.oi >= 10 OR p.oi >= 10) AND c.dte BETWEEN 5 AND 60)"


def _vert(src: str) -> str:
    return f"""v0 AS (SELECT *, LEAD(strike) OVER w AS hs, LEAD(bid) OVER w AS hb, LEAD(ask) OVER w AS ha, LEAD(dl) OVER w AS hd, LEAD(oi) OVER w AS ho FROM (SELECT *, ABS(CASE WHEN side = 'C' THEN {normal.cdf_sql('d1')} ELSE {normal.cdf_sql('d1')} - 1 END) AS dl FROM (SELECT *, {_D1} AS d1 FROM {src}) q1) q WINDOW w AS (PARTITION BY underlying, dte, side ORDER BY strike)),
v1 AS (SELECT *, hs - strike AS width FROM v0 WHERE hs IS NOT NULL),
v2 AS (SELECT *, 'bull_call' AS kind, ask - hb AS premium, ask - hb AS max_loss, width - (ask - hb) AS max_gain, strike + (ask - hb) AS breakeven, dl AS p0 FROM v1 WHERE side = 'C'
 UNION ALL SELECT *, 'call_credit', bid - ha, width - (bid - ha), bid - ha, strike + (bid - ha), 1 - dl FROM v1 WHERE side = 'C'
 UNION ALL SELECT *, 'bear_put', ha - bid, ha - bid, width - (ha - bid), hs - (ha - bid), hd FROM v1 WHERE side = 'P'
 UNION ALL SELECT *, 'put_credit', hb - ask, width - (hb - ask), hb - ask, hs - (hb - ask), 1 - hd FROM v1 WHERE side = 'P'),
vert AS (SELECT underlying, dte, spot, side, strike AS low_strike, hs AS high_strike, width, oi + ho AS oi, kind, premium, max_loss, max_gain, breakeven, LEAST(GREATEST(p0, 0), 1) AS pop, CASE WHEN max_loss > 0 THEN max_gain / max_loss END AS edge FROM v2)"""


def _flies(wings: str, more: str = "") -> str:
    """wings: a relation of underlying, dte, side, centre, wing and more columns."""
    return f"""fly1 AS (SELECT w.*, w.centre - w.wing AS lo, w.centre + w.wing AS upper, b.spot, b.iv, b.bid AS body FROM {wings} w JOIN chain b ON b.underlying = w.underlying AND b.dte = w.dte AND b.side = w.side AND b.strike = w.centre),
fly2 AS (SELECT f.*, l.ask + h.ask - 2 * body AS debit FROM fly1 f JOIN chain l ON l.underlying = f.underlying AND l.dte = f.dte AND l.side = f.side AND l.strike = f.lo JOIN chain h ON h.underlying = f.underlying AND h.dte = f.dte AND h.side = f.side AND h.strike = f.upper),
fly3 AS (SELECT *, wing - debit AS max_gain, (LN(GREATEST(upper - debit, 1E-9) / spot) + iv * iv / 2 * {_T}) / (iv * SQRT({_T})) AS zh, (LN(GREATEST(lo + debit, 1E-9) / spot) + iv * iv / 2 * {_T}) / (iv * SQRT({_T})) AS zl FROM fly2 WHERE debit > 0 AND wing - debit > 0),
fly AS (SELECT underlying, dte, side, lo, centre, upper, wing{more}, debit, debit AS max_loss, max_gain, ROUND(GREATEST({normal.cdf_sql('zh')} - {normal.cdf_sql('zl')}, 0), 6) AS pop, max_gain / debit AS edge FROM fly3)"""


_FLY = ", wings AS (SELECT underlying, dte, side, strike AS centre, GREATEST(1, ROUND(spot * 0.05 / 2)) AS wing FROM chain WHERE CASE WHEN side = 'C' THEN strike >= spot * 0.998 ELSE strike <= spot * 1.002 END), " + _flies("wings") + ", cand AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY underlying, dte, side ORDER BY centre) AS nth FROM fly) x WHERE nth <= 3)"
_TARGET = f""", tg AS (SELECT symbol, ARG_MAX(t, d) AS target FROM (SELECT symbol, d, AVG(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS t FROM bars) q GROUP BY 1),
pin AS (SELECT underlying, dte, side, strike AS centre, target, GREATEST(1, ROUND(spot * 0.05 / 2)) AS first FROM (SELECT chain.*, target, ROW_NUMBER() OVER (PARTITION BY underlying, dte, side ORDER BY ABS(strike - target), strike) AS rn FROM chain JOIN tg ON underlying = symbol) q WHERE rn = 1),
att AS (SELECT *, GREATEST(1, FLOOR(first / POW(2E0, attempt))) AS wing FROM pin CROSS JOIN (SELECT UNNEST(RANGE(11)) AS attempt) r),
wings AS (SELECT a.underlying, a.dte, a.side, a.centre, a.target, ARG_MIN(a.wing, attempt) AS wing FROM att a JOIN chain l ON l.underlying = a.underlying AND l.dte = a.dte AND l.side = a.side AND l.strike = a.centre - a.wing JOIN chain h ON h.underlying = a.underlying AND h.dte = a.dte AND h.side = a.side AND h.strike = a.centre + a.wing GROUP BY 1, 2, 3, 4, 5), """ + _flies("wings", ", target")
_FIRST = "(SELECT underlying, MIN(dte) AS dte FROM chain WHERE dte BETWEEN 20 AND 60 GROUP BY 1)"
_SIZED = "CAST(GREATEST(LEAST(FLOOR(1000.0 / (max_loss * 100)), 50), 1) AS INT) AS contracts"
_SCAN = f", one AS (SELECT chain.* FROM chain JOIN {_FIRST} f ON chain.underlying = f.underlying AND chain.dte = f.dte), liq AS (SELECT * FROM one WHERE {_LIQUID}), " + _vert("liq") + f""",
best AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY underlying ORDER BY ROUND(edge, 4) DESC, oi DESC, kind, low_strike) AS INT) AS place FROM vert WHERE width <= spot * 0.05 AND ROUND(pop, 4) >= 0.55 AND ROUND(edge, 6) >= 0.10),
fit AS (SELECT *, {_SIZED} FROM best WHERE place <= 3 AND max_loss >= 0.1 AND max_loss * 100 <= 1000),
scan AS (SELECT *, ROUND(max_loss * 100 * contracts, 4) AS total_loss, ROUND(max_gain * 100 * contracts, 4) AS total_gain, ROUND((pop * max_gain - (1 - pop) * max_loss) * 100 * contracts, 4) AS ev FROM fit)"""


def _fly_scan(least: float) -> str:
    return _FLY + f""", fbest AS (SELECT cand.*, CAST(ROW_NUMBER() OVER (PARTITION BY cand.underlying ORDER BY ROUND(pop * max_gain - (1 - pop) * max_loss, 6) DESC, side, centre) AS INT) AS place FROM cand JOIN {_FIRST} f ON cand.underlying = f.underlying AND cand.dte = f.dte WHERE pop >= {least} AND ROUND(edge, 6) >= 0.10),
ffit AS (SELECT *, {_SIZED} FROM fbest WHERE place <= 2 AND max_loss >= 0.5 AND max_loss * 100 <= 1000),
fscan AS (SELECT *, ROUND(max_loss * 100 * contracts, 4) AS total_loss, ROUND(max_gain * 100 * contracts, 4) AS total_gain, ROUND((pop * max_gain - (1 - pop) * max_loss) * 100 * contracts, 4) AS ev FROM ffit)"""


def _implied(src: str, keys: str, target: str, side: str, out: str, r: float = 0.0, steps: int = 40) -> str:
    """Common table expressions with {out}({keys}, implied): bisection, a row of recursion for each step."""
    call = lambda v: f"(spot * {normal.cdf_sql(f'd_{v}')} - strike * EXP(-{r!r} * t) * {normal.cdf_sql(f'(d_{v} - {v} * SQRT(t))')})"
    price = lambda v: f"(CASE WHEN side = 'C' THEN {call(v)} ELSE {call(v)} - spot + strike * EXP(-{r!r} * t) END)"
    d = lambda v: f"(LN(spot / strike) + ({r!r} + {v} * {v} / 2) * t) / ({v} * SQRT(t)) AS d_{v}"
    base = f"SELECT {keys}, {target} AS target, {side} AS side_, spot, strike, {_T} AS t FROM {src}"
    return f"""{out}_in AS (SELECT * FROM (SELECT *, side_ AS side, 1E-4 AS lov, 5E0 AS hiv FROM ({base}) q0) q1),
{out}_ok AS (SELECT * FROM (SELECT *, {d('lov')}, {d('hiv')} FROM {out}_in) q2 WHERE {price('lov')} <= target AND {price('hiv')} >= target),
{out}_b AS (SELECT {keys}, target, side_, side, spot, strike, t, 0 AS k, lov AS a, hiv AS b FROM {out}_ok
 UNION ALL SELECT {keys}, target, side_, side, spot, strike, t, k + 1, CASE WHEN over THEN a ELSE m END, CASE WHEN over THEN m ELSE b END FROM (SELECT *, {price('m')} > target AS over FROM (SELECT *, {d('m')} FROM (SELECT *, (a + b) / 2 AS m FROM {out}_b WHERE k < {steps}) q3) q4) q5),
{out} AS (SELECT {keys}, side_, strike, (a + b) / 2 AS implied FROM {out}_b WHERE k = {steps})"""


def _det(a, b, c, d, e, f, g, h, i):
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_N = "NULLIF(" + _det("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4") + ", 0)"
_L5 = "OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_SD = lambda n: f"CASE WHEN COUNT(lr) {_L5.format(n=n - 1)} = {n} THEN STDDEV_SAMP(lr) {_L5.format(n=n - 1)} END"
_REAL = f""", lr0 AS (SELECT symbol, d, LN(close) - LN(LAG(close) OVER ({W})) AS lr, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM bars),
lr1 AS (SELECT *, {_SD(21)} AS rv21, {_SD(60)} AS rv60, {_SD(5)} AS v5 FROM lr0),
rl AS (SELECT symbol, MAX(CASE WHEN age = 1 THEN rv21 END) * SQRT(252) AS rv21, MAX(CASE WHEN age = 1 THEN rv60 END) * SQRT(252) AS rv60, CASE WHEN COUNT(lr) >= 30 THEN VAR_SAMP(lr) END AS variance, MAX(CASE WHEN age = 1 THEN lr END) AS last_ret, CASE WHEN COUNT(*) >= 60 THEN MEDIAN(v5) END * SQRT(252) AS vol5 FROM lr1 WHERE age <= 504 GROUP BY 1)"""
_NEAR = "(SELECT underlying, dte FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY underlying ORDER BY dte) AS nth FROM (SELECT DISTINCT underlying, dte FROM chain WHERE dte BETWEEN 5 AND 60) q) q2 WHERE nth <= 3)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_FLY_OUT = "ROUND(debit, 6) AS debit, ROUND(max_gain, 6) AS max_gain, ROUND(pop, 6) AS pop, ROUND(edge, 6) AS edge"
ORACLE_SQL = {
    "fil04_liquid": oracle("chain", f"SELECT underlying, dte, side, strike, ROUND(bid, 6) AS bid, ROUND(ask, 6) AS ask, oi, vol FROM chain WHERE {_LIQUID}"),
    "fil05_surface_pairs": oracle("chain", _PAIR + " SELECT underlying, dte, strike, ROUND(call_mid, 6) AS call_mid, ROUND(put_mid, 6) AS put_mid FROM pair"),
    "fil06_first_expiry": oracle("chain", f"SELECT * FROM {_FIRST} x"),
    "joi06_atm": oracle("chain", _ATM + " SELECT underlying, dte, side, strike, ROUND(mid, 6) AS mid, ROUND(iv, 6) AS iv, spot FROM atm"),
    "joi07_verticals": oracle("chain", ", " + _vert("chain") + " SELECT underlying, dte, side, low_strike, high_strike, kind, oi, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("premium", "width", "max_loss", "max_gain", "breakeven", "pop", "edge")) + " FROM vert"),
    "joi08_butterflies": oracle("chain", _FLY + f" SELECT underlying, dte, side, lo, centre, upper, {_FLY_OUT} FROM cand"),
    "joi09_butterfly_at_target": oracle("chain", _TARGET + f" SELECT underlying, dte, side, lo, centre, upper, wing, ROUND(target, 6) AS target, {_FLY_OUT} FROM fly"),
    "joi10_term_structure": oracle("chain", _ATM + ", a AS (SELECT underlying, dte, AVG(iv) AS iv FROM atm GROUP BY 1, 2) SELECT underlying, horizon, dte, ROUND(iv, 6) AS iv FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY underlying, horizon ORDER BY ABS(dte - horizon), dte) AS rn FROM a CROSS JOIN (SELECT CAST(UNNEST([5, 10, 21, 42, 63]) AS INT) AS horizon) h) x WHERE rn = 1"),
    "mth04_implied_vol": recursive(oracle("chain", ", " + _implied("(SELECT * FROM chain WHERE mid > 0.01) c", "underlying, dte", "mid", "side", "im") + " SELECT c.underlying, c.dte, c.side, c.strike, ROUND(implied, 5) AS implied FROM (SELECT * FROM chain WHERE mid > 0.01) c LEFT JOIN im ON im.underlying = c.underlying AND im.dte = c.dte AND im.side_ = c.side AND im.strike = c.strike")),
    "mth04_greeks": oracle("chain", f"SELECT underlying, dte, side, strike, ROUND(CASE WHEN side = 'C' THEN {normal.cdf_sql(_D1)} ELSE {normal.cdf_sql(_D1)} - 1 END, 6) AS delta, ROUND({_PDF} / (spot * iv * SQRT({_T})), 6) AS gamma, ROUND(spot * {_PDF} * SQRT({_T}) / 100, 6) AS vega FROM chain"),
    "mth08_sigma_bands": oracle("chain", _ATM + ", b AS (SELECT underlying, ARG_MIN(spot, dte) AS spot, ARG_MIN(iv, dte) AS iv FROM atm WHERE side = 'C' GROUP BY 1) SELECT underlying, tenor, k, ROUND(spot - spot * iv * SQRT(tenor / 252E0) * k, 5) AS lo, ROUND(spot + spot * iv * SQRT(tenor / 252E0) * k, 5) AS hi FROM b CROSS JOIN (SELECT CAST(UNNEST([5, 10, 21, 63]) AS INT) AS tenor) t CROSS JOIN (SELECT CAST(UNNEST([1, 2]) AS INT) AS k) s"),
    "mth09_payoff": oracle("chain", _FLY + ", g AS (SELECT *, lo - (centre - lo) / 2 + (upper - lo) * 1.5 * i / 200 AS price FROM cand CROSS JOIN (SELECT UNNEST(RANGE(201)) AS i) r) SELECT underlying, dte, side, lo, centre, ROUND(MIN(GREATEST(centre - lo - ABS(price - centre), 0) - debit), 6) AS worst, ROUND(MAX(GREATEST(centre - lo - ABS(price - centre), 0) - debit), 6) AS best, COUNT(*) AS n FROM g GROUP BY 1, 2, 3, 4, 5"),
    "agg31_survivors": oracle("chain", f" SELECT c.underlying, c.dte, side, COUNT(*) AS contracts, COUNT(CASE WHEN {_LIQUID} THEN 1 END) AS liquid FROM chain c JOIN {_FIRST} f ON c.underlying = f.underlying AND c.dte = f.dte GROUP BY 1, 2, 3"),
    "top04_nearest_expiries": oracle("chain", f"SELECT * FROM {_NEAR} x"),
    "agg25_scan_summary": oracle("chain", _SCAN + _fly_scan(0.55) + " SELECT symbols, ok, symbols - ok AS skipped, spreads, positive_spreads, flies, positive_flies FROM (SELECT COUNT(DISTINCT underlying) AS symbols FROM chain) a CROSS JOIN (SELECT COUNT(*) AS ok FROM " + _FIRST + " q) b CROSS JOIN (SELECT COUNT(*) AS spreads, COUNT(CASE WHEN ev > 0 THEN 1 END) AS positive_spreads FROM scan) c CROSS JOIN (SELECT COUNT(*) AS flies, COUNT(CASE WHEN ev > 0 THEN 1 END) AS positive_flies FROM fscan) d"),
    "dom23_smiles": recursive(oracle("chain", _PAIR + ", " + _implied("pair", "underlying, dte", "call_mid", "'C'", "ic", O.RATE) + ", " + _implied("pair", "underlying, dte", "put_mid", "'P'", "ip", O.RATE) + _ATM + _REAL + f""", y0 AS (SELECT p.underlying, p.dte, p.strike, p.spot, COALESCE((ic.implied + ip.implied) / 2, ic.implied, ip.implied) AS y FROM pair p LEFT JOIN ic ON ic.underlying = p.underlying AND ic.dte = p.dte AND ic.strike = p.strike LEFT JOIN ip ON ip.underlying = p.underlying AND ip.dte = p.dte AND ip.strike = p.strike),
gap AS (SELECT underlying, dte, SUM(CASE WHEN side = 'C' THEN mid ELSE -mid END) AS gap FROM atm GROUP BY 1, 2),
xy AS (SELECT *, LN(strike / forward) AS x FROM (SELECT y0.*, spot + gap * EXP(0.045 * (GREATEST(y0.dte, 1) / 365E0)) AS forward FROM y0 JOIN gap ON y0.underlying = gap.underlying AND y0.dte = gap.dte WHERE y IS NOT NULL) q WHERE forward > 0),
m AS (SELECT underlying, dte, forward, COUNT(*) AS n, SUM(x) AS s1, SUM(POW(x, 2)) AS s2, SUM(POW(x, 3)) AS s3, SUM(POW(x, 4)) AS s4, SUM(y) AS t0, SUM(y * x) AS t1, SUM(y * POW(x, 2)) AS t2, SUM(y * y) AS yy FROM xy GROUP BY 1, 2, 3),
f AS (SELECT *, {_det('t0', 's1', 's2', 't1', 's2', 's3', 't2', 's3', 's4')} / {_N} AS a, {_det('n', 't0', 's2', 's1', 't1', 's3', 's2', 't2', 's4')} / {_N} AS b, {_det('n', 's1', 't0', 's1', 's2', 't1', 's2', 's3', 't2')} / {_N} AS c, ROW_NUMBER() OVER (PARTITION BY underlying ORDER BY dte) AS nth FROM m WHERE n >= 5),
g AS (SELECT *, {-O.Z25!r} * a * SQRT({_T}) - a * a * {_T} / 2 AS xp, {O.Z25!r} * a * SQRT({_T}) - a * a * {_T} / 2 AS xc FROM f WHERE nth <= 4),
h AS (SELECT *, a + b * xp + c * xp * xp AS vp, a + b * xc + c * xc * xc AS vc FROM g)
SELECT underlying, dte, n, ROUND(forward, 6) AS forward, ROUND(a, 5) AS level, ROUND(b, 4) AS slope, ROUND(c, 3) AS curve, ROUND(SQRT(GREATEST(yy - a * t0 - b * t1 - c * t2, 0) / n), 4) AS rmse, ROUND(vp - vc, 5) AS risk_reversal, ROUND((vp + vc) / 2 - a, 5) AS butterfly, ROUND(a - rv21, 5) AS iv_less_rv FROM h LEFT JOIN rl ON underlying = symbol""")),
    "dom25_expected_moves": oracle("chain", _ATM + _REAL + f""", s AS (SELECT atm.underlying, atm.dte, SUM(mid) AS straddle, MIN(spot) AS spot FROM atm JOIN {_NEAR} k ON atm.underlying = k.underlying AND atm.dte = k.dte GROUP BY 1, 2),
m0 AS (SELECT *, straddle / (spot * SQRT(2 * {_T} / PI())) AS iv FROM s JOIN rl ON underlying = symbol WHERE straddle > 0),
m AS (SELECT *, [z FOR z IN [straddle * SQRT(PI() / 2), spot * iv * SQRT({_T}), spot * rv21 * SQRT({_T}), spot * rv60 * SQRT({_T}), spot * SQRT((0.05 * variance + 0.10 * last_ret * last_ret + 0.85 * variance) * 252) * SQRT({_T})] IF z IS NOT NULL] AS ms FROM m0),
k AS (SELECT *, LIST_SUM(ms) / LEN(ms) AS consensus, (LIST_MAX(ms) - LIST_MIN(ms)) / (LIST_SUM(ms) / LEN(ms)) AS dispersion, iv - rv21 AS iv_less_rv FROM m)
SELECT underlying, dte, CAST(LEN(ms) AS INT) AS n, ROUND(straddle, 5) AS straddle, ROUND(consensus, 5) AS consensus, ROUND(dispersion, 5) AS dispersion, ROUND(iv_less_rv, 5) AS iv_less_rv, ROUND(vol5 * spot * SQRT(dte / 365E0), 5) AS event_move, CASE WHEN dispersion > 0.20 THEN 'high_dispersion_vol_trade' WHEN iv_less_rv > 0.10 THEN 'iv_rich_sell_premium' ELSE 'iv_fair' END AS recommendation FROM k"""),
    "dom26_spread_scan": oracle("chain", _SCAN + " SELECT underlying, dte, kind, low_strike, high_strike, ROUND(max_loss, 6) AS max_loss, ROUND(edge, 6) AS edge, ROUND(pop, 6) AS pop, contracts, total_loss, total_gain, ev, place FROM scan"),
    "dom26_fly_scan": oracle("chain", _fly_scan(0.1) + " SELECT underlying, dte, side, lo, centre, upper, ROUND(max_loss, 6) AS max_loss, ROUND(edge, 6) AS edge, ROUND(pop, 6) AS pop, contracts, total_loss, total_gain, ev, place FROM fscan"),
}
