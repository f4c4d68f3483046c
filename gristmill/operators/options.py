"""Option chains: liquidity, at-the-money, spreads, expected moves, implied volatility and smiles.

A chain is flat: underlying, spot, as_of, dte, side (C or P), strike, bid, ask,
mid, oi, vol, iv.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import indicators as I
from ..functions import normal
from ..functions.ieee import ratio

KEY = ["underlying", "dte"]


def years(dte: Column) -> Column:
    """DAT1: time to expiry, one day at least, in years of 365 days."""
    return F.greatest(dte, F.lit(1)) / 365.0


#: The least open interest by tier, and of other tiers.
FLOORS, FLOOR = {"index": 500, "etf": 500, "stock": 100}, 100


def liquid(min_volume: int = 50, max_spread: float = 0.07) -> Column:
    """FIL4: open interest over the tier's floor, enough volume, a bid below the ask and a narrow spread."""
    floor = F.lit(FLOOR)
    for tier, n in FLOORS.items():
        floor = F.when(F.col("tier") == tier, n).otherwise(floor)
    return (F.col("oi") >= floor) & (F.col("vol") >= min_volume) & (F.col("bid") > 0) & (F.col("bid") < F.col("ask")) & (F.round(F.try_divide(F.col("ask") - F.col("bid"), F.col("mid")), 9) <= max_spread)


def first_expiry(chain: DataFrame, low: int = 20, high: int = 60) -> DataFrame:
    """FIL6: the nearest expiry of each underlying inside a window of days."""
    return chain.where(F.col("dte").between(low, high)).groupBy("underlying").agg(F.min("dte").alias("dte"))


def at_the_money(chain: DataFrame) -> DataFrame:
    """JOI6: the strike nearest to spot on each side of every expiry; the lower one of equals."""
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")
    best = chain.groupBy(*KEY, "side").agg(F.min_by(F.struct("strike", "mid", "iv", "spot"), near).alias("b"))
    return best.select(*KEY, "side", "b.*")


def paired(chain: DataFrame) -> DataFrame:
    """JOI5: calls with puts of the same expiry and strike."""
    c = chain.where("side = 'C'").select(*KEY, "strike", "spot", F.col("mid").alias("call_mid"), F.col("iv").alias("call_iv"), F.col("oi").alias("call_oi"), F.try_divide(F.col("ask") - F.col("bid"), F.col("mid")).alias("call_spread"))
    p = chain.where("side = 'P'").select(*KEY, "strike", F.col("mid").alias("put_mid"), F.col("iv").alias("put_iv"), F.col("oi").alias("put_oi"), F.try_divide(F.col("ask") - F.col("bid"), F.col("mid")).alias("put_spread"))
    return c.join(p, [*KEY, "strike"])


def fit_for_surface(pairs: DataFrame) -> DataFrame:
    """FIL5: pairs with both prices, spreads of 30 % at most, open interest of 10 on one side, and 5 to 60 days left."""
    return pairs.where("call_mid > 0 and put_mid > 0 and call_spread <= 0.3 and put_spread <= 0.3 and (call_oi >= 10 or put_oi >= 10) and dte between 5 and 60")


def delta(spot: Column, strike: Column, t: Column, vol: Column, side: Column, r: float = 0.0) -> Column:
    d1 = (F.log(F.try_divide(spot, strike)) + (r + vol * vol / 2) * t) / (vol * F.sqrt(t))
    return F.when(side == "C", normal.cdf(d1)).otherwise(normal.cdf(d1) - 1)


def price(spot: Column, strike: Column, t: Column, vol: Column, side: Column, r: float = 0.0) -> Column:
    """MTH4: the Black-Scholes price."""
    sd = vol * F.sqrt(t)
    d1 = (F.log(F.try_divide(spot, strike)) + (r + vol * vol / 2) * t) / sd
    k = strike * F.exp(-r * t)
    call = spot * normal.cdf(d1) - k * normal.cdf(d1 - sd)
    return F.when(side == "C", call).otherwise(call - spot + k)


def _prices(spot: np.ndarray, strike: np.ndarray, t: np.ndarray, vol: np.ndarray, call: np.ndarray, r: float) -> np.ndarray:
    """price() on arrays."""
    sd = vol * np.sqrt(t)
    d1 = (np.log(spot / strike) + (r + vol * vol / 2) * t) / sd
    k = strike * np.exp(-r * t)
    value = spot * normal.cdf_of(d1) - k * normal.cdf_of(d1 - sd)
    return np.where(call, value, value - spot + k)


def bracketed(target: np.ndarray, value_at: Callable[[np.ndarray], np.ndarray], low: float, high: float, steps: int) -> np.ndarray:
    """Where the increasing value_at meets each target between low and high, all halved together; nan where it doesn't."""
    a, b = np.full(len(target), low), np.full(len(target), high)
    with np.errstate(all="ignore"):
        inside = (value_at(a) <= target) & (value_at(b) >= target)
        for _ in range(steps):
            m = (a + b) / 2
            above = value_at(m) > target
            a, b = np.where(above, a, m), np.where(above, m, b)
    return np.where(inside, (a + b) / 2, np.nan)


def implied_volatility(target: Column, spot: Column, strike: Column, t: Column, side: Column, steps: int = 40, low: float = 1e-4, high: float = 5.0, r: float = 0.0) -> Column:
    """MTH4: the volatility between low and high that gives the price, found for whole Arrow batches at once; null where none does.

    The root is found once a row, however often the column is used after it.
    """

    def solve(target: pd.Series, spot: pd.Series, strike: pd.Series, t: pd.Series, side: pd.Series) -> pd.Series:
        s, k, years_, call = spot.to_numpy(float), strike.to_numpy(float), t.to_numpy(float), (side == "C").to_numpy(bool)
        with np.errstate(all="ignore"):
            found = bracketed(target.to_numpy(float), lambda v: _prices(s, k, years_, v, call, r), low, high, steps)
        return pd.Series(found).where((k > 0) & (s > 0) & (years_ > 0) & side.notna().to_numpy() & np.isfinite(found), None)

    once = F.pandas_udf(solve, "double").asNondeterministic()  # so that no filter is pushed below it and solves again
    return once(target.cast("double"), spot.cast("double"), strike.cast("double"), t.cast("double"), side)


def greeks(chain: DataFrame) -> DataFrame:
    """Delta, gamma and vega (for a volatility point) of every contract."""
    t, s, v = years(F.col("dte")), F.col("spot"), F.col("iv")
    d1 = (F.log(F.try_divide(s, F.col("strike"))) + v * v / 2 * t) / (v * F.sqrt(t))
    return chain.select(*KEY, "side", "strike", F.round(delta(s, F.col("strike"), t, v, F.col("side")), 6).alias("delta"), F.round(normal.pdf(d1) / (s * v * F.sqrt(t)), 6).alias("gamma"), F.round(s * normal.pdf(d1) * F.sqrt(t) / 100, 6).alias("vega"))


KINDS = ("bull_call", "call_credit", "bear_put", "put_credit")


def verticals(chain: DataFrame) -> DataFrame:
    """JOI7, MTH11: the four spreads of each two neighbouring strikes, bought at the ask and sold at the bid.

    A bull call buys the lower call and a bear put the higher put (debits, chance
    of profit: the long leg's delta); a call credit sells the lower call and a
    put credit the higher put (one less the short leg's delta).  edge: gain over
    loss, null without a loss.
    """
    by = Window.partitionBy(*KEY, "side").orderBy("strike")
    t = years(F.col("dte"))
    df = chain.where("strike > 0").withColumn("dl", F.abs(delta(F.col("spot"), F.col("strike"), t, F.col("iv"), F.col("side"))))
    df = df.withColumn("hi", F.lead(F.struct("strike", "bid", "ask", "dl", "oi")).over(by)).where("hi is not null")
    width, lo, hi = F.col("hi.strike") - F.col("strike"), F.col("strike"), F.col("hi.strike")
    price = {"bull_call": F.col("ask") - F.col("hi.bid"), "call_credit": F.col("bid") - F.col("hi.ask"), "bear_put": F.col("hi.ask") - F.col("bid"), "put_credit": F.col("hi.bid") - F.col("ask")}

    def row(kind: str) -> Column:
        debit, call, p = kind in ("bull_call", "bear_put"), kind.endswith("call") or kind == "call_credit", price[kind]
        near = F.col("dl") if call else F.col("hi.dl")
        return F.struct(
            F.lit(kind).alias("kind"), p.alias("premium"), (p if debit else width - p).alias("max_loss"), (width - p if debit else p).alias("max_gain"),
            (lo + p if call else hi - p).alias("breakeven"), F.least(F.greatest(near if debit else 1 - near, F.lit(0.0)), F.lit(1.0)).alias("pop"),
        )

    calls, puts = (F.array(*map(row, KINDS[i : i + 2])) for i in (0, 2))
    df = df.select(*KEY, "spot", "side", lo.alias("low_strike"), hi.alias("high_strike"), width.alias("width"), (F.col("oi") + F.col("hi.oi")).alias("oi"), F.explode(F.when(F.col("side") == "C", calls).otherwise(puts)).alias("s"))
    edge = F.when(F.col("s.max_loss") > 0, F.try_divide("s.max_gain", "s.max_loss"))
    return df.select(*KEY, "spot", "side", "low_strike", "high_strike", "width", "oi", "s.*", edge.alias("edge"))


def affordable(spreads: DataFrame, budget: float = 1000.0, least: float = 0.10) -> DataFrame:
    """FIL7, PRJ2: spreads whose loss fits the budget and is no less than least, with the number of contracts (1 to 50), totals and expected value."""
    lot = F.col("max_loss") * 100
    n = F.greatest(F.least(F.floor(F.try_divide(F.lit(budget), lot)), F.lit(50)), F.lit(1))
    ev = F.col("pop") * F.col("max_gain") - (1 - F.col("pop")) * F.col("max_loss")
    return (
        spreads.where((F.col("max_loss") >= least) & (lot <= budget))
        .withColumn("contracts", n.cast("int"))
        .withColumn("total_loss", F.round(lot * F.col("contracts"), 4))
        .withColumn("total_gain", F.round(F.col("max_gain") * 100 * F.col("contracts"), 4))
        .withColumn("ev", F.round(ev * 100 * F.col("contracts"), 4))
    )


def wing_of(spot: Column, share: float = 0.05) -> Column:
    """Half a fly's width, in whole units: the share of spot, halved."""
    return F.greatest(F.lit(1.0), F.round(spot * share / 2))


def flies(chain: DataFrame, wings: DataFrame) -> DataFrame:
    """Long flies of wings(underlying, dte, side, centre, wing, ...): wings at the ask, twice the body at the bid, by equi-joins on the computed strikes.

    Flies that cost nothing or can't gain are left out.  pop: the lognormal
    chance of an end between the breakevens, at the body's volatility.
    """
    legs = chain.where("strike > 0").select(*KEY, "side", "strike", "bid", "ask", "iv", "spot")
    on = [*KEY, "side"]
    body = legs.select(*on, F.col("strike").alias("centre"), F.col("bid").alias("body"), "iv", "spot")
    low = legs.select(*on, F.col("strike").alias("lo"), F.col("ask").alias("low_ask"))
    high = legs.select(*on, F.col("strike").alias("upper"), F.col("ask").alias("high_ask"))
    df = wings.withColumn("lo", F.col("centre") - F.col("wing")).withColumn("upper", F.col("centre") + F.col("wing"))
    df = df.join(body, [*on, "centre"]).join(low, [*on, "lo"]).join(high, [*on, "upper"])
    df = df.withColumn("debit", F.col("low_ask") + F.col("high_ask") - 2 * F.col("body")).withColumn("max_gain", F.col("wing") - F.col("debit")).where("debit > 0 and max_gain > 0")
    pop = chance_between(F.col("spot"), F.col("lo") + F.col("debit"), F.col("upper") - F.col("debit"), F.col("iv"), years(F.col("dte")))
    return df.select(*wings.columns, "lo", "upper", "spot", "debit", F.col("debit").alias("max_loss"), "max_gain", F.round(pop, 6).alias("pop"), F.try_divide("max_gain", "debit").alias("edge"))


def butterflies(chain: DataFrame, per_side: int = 3) -> DataFrame:
    """JOI8: for each expiry and side the first flies by strike, calls with the body at spot or above, puts at spot or below."""
    near = F.when(F.col("side") == "C", F.col("strike") >= F.col("spot") * 0.998).otherwise(F.col("strike") <= F.col("spot") * 1.002)
    wings = chain.where(near).select(*KEY, "side", F.col("strike").alias("centre"), wing_of(F.col("spot")).alias("wing"))
    got = flies(chain, wings)
    return got.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY, "side").orderBy("centre"))).where(F.col("nth") <= per_side)


def butterfly_at_target(chain: DataFrame, targets: DataFrame, tries: int = 10) -> DataFrame:
    """JOI9: the fly around the strike nearest to targets(underlying, target); the wing is halved, down to one unit, until all its strikes are there."""
    df = chain.where("strike > 0").join(targets, "underlying")
    pin = df.groupBy(*KEY, "side").agg(F.min_by(F.struct("strike", "spot", "target"), F.struct(F.abs(F.col("strike") - F.col("target")), "strike")).alias("p"))
    pin = pin.select(*KEY, "side", F.col("p.strike").alias("centre"), F.col("p.target").alias("target"), wing_of(F.col("p.spot")).alias("first"))
    each = pin.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries)))).withColumn("wing", F.greatest(F.lit(1.0), F.floor(F.col("first") / F.pow(F.lit(2.0), F.col("attempt"))).cast("double")))
    strikes = chain.where("strike > 0").select(*KEY, "side", "strike")
    on = [*KEY, "side"]
    there = each.withColumn("lo", F.col("centre") - F.col("wing")).withColumn("upper", F.col("centre") + F.col("wing"))
    there = there.join(strikes.withColumnRenamed("strike", "lo"), [*on, "lo"]).join(strikes.withColumnRenamed("strike", "upper"), [*on, "upper"])
    first = there.groupBy(*on, "centre", "target").agg(F.min_by("wing", "attempt").alias("wing"))
    return flies(chain, first)


def chance_between(spot: Column, low: Column, high: Column, vol: Column, t: Column) -> Column:
    """MTH3: the lognormal chance that the price ends between low and high."""
    sd = vol * F.sqrt(t)
    z = lambda k: (F.log(F.greatest(k, F.lit(1e-9)) / spot) + vol * vol / 2 * t) / sd
    return F.greatest(normal.cdf(z(high)) - normal.cdf(z(low)), F.lit(0.0))


MIN_POP, MIN_EDGE = 0.55, 0.10


def survivors(chain: DataFrame) -> DataFrame:
    """AGG31: contracts of each underlying's first expiry in the window, by side: all, and those that are liquid."""
    one = chain.join(first_expiry(chain), KEY)
    return one.groupBy(*KEY, "side").agg(F.count("*").alias("contracts"), F.count_if(liquid()).alias("liquid"))


def spread_scan(chain: DataFrame, top: int = 3) -> DataFrame:
    """DOM26, TOP2: of each underlying's first expiry in the window the best spreads of liquid neighbours, by edge, that fit the budget.

    Widths up to 5 % of spot, chance of profit from MIN_POP and edge from
    MIN_EDGE on; the budget is tested after the choice of the best.
    """
    one = chain.join(first_expiry(chain), KEY).where(liquid())
    got = verticals(one).where((F.col("width") <= F.col("spot") * 0.05) & (F.round("pop", 4) >= MIN_POP) & (F.round("edge", 6) >= MIN_EDGE))
    order = Window.partitionBy("underlying").orderBy(F.desc(F.round("edge", 4)), F.desc("oi"), "kind", "low_strike")
    return affordable(got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top))


def fly_scan(chain: DataFrame, top: int = 2, min_pop: float = MIN_POP, min_edge: float = MIN_EDGE) -> DataFrame:
    """DOM26, TOP2: the best flies of each underlying's first expiry by expected value, within the budget, from a loss of 0.50 on."""
    got = butterflies(chain.join(first_expiry(chain), KEY)).where((F.col("pop") >= min_pop) & (F.round("edge", 6) >= min_edge))
    ev = F.round(F.col("pop") * F.col("max_gain") - (1 - F.col("pop")) * F.col("max_loss"), 6)
    order = Window.partitionBy("underlying").orderBy(ev.desc(), "side", "centre")
    return affordable(got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top), least=0.50)


def scan_summary(chain: DataFrame) -> DataFrame:
    """AGG25: the scan in one row: underlyings with and without an expiry in the window, candidates, and how many of them have a positive expected value."""
    all_ = chain.select("underlying").distinct().agg(F.count("*").alias("symbols"))
    ok = first_expiry(chain).agg(F.count("*").alias("ok"))
    spreads = spread_scan(chain).agg(F.count("*").alias("spreads"), F.count_if(F.col("ev") > 0).alias("positive_spreads"))
    flies_ = fly_scan(chain).agg(F.count("*").alias("flies"), F.count_if(F.col("ev") > 0).alias("positive_flies"))
    # four rows, one from each aggregate
    return all_.join(F.broadcast(ok)).join(F.broadcast(spreads)).join(F.broadcast(flies_)).select("symbols", "ok", (F.col("symbols") - F.col("ok")).alias("skipped"), "spreads", "positive_spreads", "flies", "positive_flies")


def term_structure(chain: DataFrame, horizons: tuple[int, ...] = (5, 10, 21, 42, 63)) -> DataFrame:
    """DOM24, JOI10: at-the-money volatility by expiry, and for each horizon that of the nearest expiry (the earlier of equals)."""
    atm = at_the_money(chain).groupBy(*KEY).agg(F.avg("iv").alias("iv"))
    h = F.explode(F.array(*map(F.lit, horizons)))
    return atm.withColumn("horizon", h).groupBy("underlying", "horizon").agg(F.min_by(F.struct("dte", "iv"), F.struct(F.abs(F.col("dte") - F.col("horizon")), "dte")).alias("b")).select("underlying", "horizon", F.col("b.dte").alias("dte"), F.round("b.iv", 6).alias("iv"))


def nearest_expiries(chain: DataFrame, n: int = 3, low: int = 5, high: int = 60) -> DataFrame:
    """TOP4: the n nearest expiries of each underlying inside a window of days."""
    dates = chain.where(F.col("dte").between(low, high)).select(*KEY).distinct()
    return dates.withColumn("nth", F.row_number().over(Window.partitionBy("underlying").orderBy("dte"))).where(F.col("nth") <= n).select(*KEY)


def realized(bars: DataFrame, history: int = 504, median_from: int = 60) -> DataFrame:
    """(underlying, rv21, rv60, variance, last_ret, vol5): of each symbol's log returns over the last bars, yearly but for the variance and the last return."""
    df = I.with_returns(bars).withColumn("n", F.row_number().over(I.in_order()))
    sd = lambda n: I.full(F.stddev_samp("logret").over(I.last(n)), n, "logret")
    df = df.withColumn("rv21", sd(21)).withColumn("rv60", sd(60)).withColumn("v5", sd(5)).withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))))
    year = F.sqrt(F.lit(252.0))
    df = df.where(F.col("age") <= history).groupBy(F.col("symbol").alias("underlying")).agg(
        (F.max_by("rv21", "d") * year).alias("rv21"), (F.max_by("rv60", "d") * year).alias("rv60"), F.var_samp("logret").alias("variance"), F.max_by("logret", "d").alias("last_ret"),
        F.count("logret").alias("n_ret"), (F.when(F.count("*") >= median_from, F.median("v5")) * year).alias("vol5"),
    )
    return df.withColumn("variance", F.when(F.col("n_ret") >= 30, F.col("variance"))).drop("n_ret")


def expected_moves(chain: DataFrame, real: DataFrame) -> DataFrame:
    """DOM25, MTH6, MTH7, AGG19: one-sigma moves of each of the nearest expiries by five methods, their mean, dispersion and a recommendation.

    Methods: the straddle at the money times sqrt(pi / 2), the volatility that
    it implies, realised volatility of 21 and 60 returns, and a variance
    recursion (0.10, 0.85); real is that of realized().  The median of five-day
    volatilities stands for moves around reports, beside the consensus.
    """
    near = chain.where("strike > 0").join(nearest_expiries(chain), KEY)
    s = at_the_money(near).groupBy(*KEY).agg(F.sum("mid").alias("straddle"), F.first("spot").alias("spot"))
    s = s.where("straddle > 0").join(real, "underlying")
    t, spot = years(F.col("dte")), F.col("spot")
    iv = ratio("straddle", spot * F.sqrt(2 * t / F.lit(math.pi)))
    ahead = 0.05 * F.col("variance") + 0.10 * F.col("last_ret") * F.col("last_ret") + 0.85 * F.col("variance")
    moves = F.array(F.col("straddle") * F.sqrt(F.lit(math.pi / 2)), spot * iv * F.sqrt(t), spot * F.col("rv21") * F.sqrt(t), spot * F.col("rv60") * F.sqrt(t), spot * F.sqrt(ahead * 252.0) * F.sqrt(t))
    known = F.filter(moves, lambda m: m.isNotNull())
    s = s.withColumn("m", known).withColumn("consensus", F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / F.size("m"))
    s = s.withColumn("dispersion", (F.array_max("m") - F.array_min("m")) / F.col("consensus")).withColumn("iv_less_rv", iv - F.col("rv21"))
    advice = F.when(F.col("dispersion") > 0.20, "high_dispersion_vol_trade").when(F.col("iv_less_rv") > 0.10, "iv_rich_sell_premium").otherwise("iv_fair")
    event = F.col("vol5") * spot * F.sqrt(F.col("dte") / 365.0)
    return s.select(*KEY, F.size("m").alias("n"), *(F.round(c, 5).alias(c) for c in ("straddle", "consensus", "dispersion", "iv_less_rv")), F.round(event, 5).alias("event_move"), advice.alias("recommendation"))


RATE = 0.045
#: The normal quantile of 0.25.
Z25 = -0.6744897501960817


def smiles(chain: DataFrame, real: DataFrame, n: int = 4) -> DataFrame:
    """DOM23, MTH5: a quadratic of implied volatility in log-moneyness to the forward for each expiry, with 25-delta risk reversal and butterfly.

    Volatilities are implied from mids of calls and puts and averaged; the fit
    takes moment sums and Cramer's rule, from five strikes on; iv_less_rv
    compares with the realised volatility of 21 returns, real(underlying, rv21).
    """
    t = years(F.col("dte"))
    good = fit_for_surface(paired(chain.where("strike > 0")))
    iv_of = lambda side: implied_volatility(F.col(f"{side}_mid"), F.col("spot"), F.col("strike"), t, F.lit("C" if side == "call" else "P"), r=RATE)
    good = good.withColumn("ci", iv_of("call")).withColumn("pi", iv_of("put"))
    good = good.withColumn("y", F.coalesce((F.col("ci") + F.col("pi")) / 2, "ci", "pi")).where("y is not null")
    atm = at_the_money(chain).groupBy(*KEY).agg(F.sum(F.when(F.col("side") == "C", F.col("mid")).otherwise(-F.col("mid"))).alias("gap"))
    p = good.join(atm, KEY).withColumn("forward", F.col("spot") + F.col("gap") * F.exp(RATE * t)).where("forward > 0").withColumn("x", F.log(F.col("strike") / F.col("forward")))
    x, y = F.col("x"), F.col("y")
    m = p.groupBy(*KEY, "forward").agg(F.count("*").alias("n"), *(F.sum(F.pow(x, k)).alias(f"s{k}") for k in range(1, 5)), *(F.sum(y * F.pow(x, k)).alias(f"t{k}") for k in range(3)), F.sum(y * y).alias("yy"))
    c = {k: F.col(k) for k in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det(*names: str) -> Column:
        a, b, d, e, f, g, h, i, j = (c[k] for k in names)
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    whole = F.nullif(det("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"), F.lit(0.0))
    m = m.where("n >= 5").withColumn("level", F.try_divide(det("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"), whole))
    m = m.withColumn("slope", F.try_divide(det("n", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"), whole)).withColumn("curve", F.try_divide(det("n", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2"), whole))
    rss = F.col("yy") - F.col("level") * c["t0"] - F.col("slope") * c["t1"] - F.col("curve") * c["t2"]
    sd = F.col("level") * F.sqrt(t)
    at = lambda z: F.col("level") + F.col("slope") * z + F.col("curve") * z * z
    m = m.withColumn("iv25_put", at(-Z25 * sd - sd * sd / 2)).withColumn("iv25_call", at(Z25 * sd - sd * sd / 2))
    m = m.withColumn("nth", F.row_number().over(Window.partitionBy("underlying").orderBy("dte"))).where(F.col("nth") <= n).join(real.select("underlying", "rv21"), "underlying", "left")
    out = {"level": (F.col("level"), 5), "slope": (F.col("slope"), 4), "curve": (F.col("curve"), 3), "rmse": (F.sqrt(F.greatest(rss, F.lit(0.0)) / c["n"]), 4), "risk_reversal": (F.col("iv25_put") - F.col("iv25_call"), 5), "butterfly": ((F.col("iv25_put") + F.col("iv25_call")) / 2 - F.col("level"), 5), "iv_less_rv": (F.col("level") - F.col("rv21"), 5)}
    return m.select(*KEY, "n", F.round("forward", 6).alias("forward"), *(F.round(v, k).alias(name) for name, (v, k) in out.items()))


def sigma_bands(chain: DataFrame, tenors: tuple[int, ...] = (5, 10, 21, 63)) -> DataFrame:
    """MTH8: one- and two-sigma price bands at each tenor in trading days, from the nearest at-the-money volatility."""
    spot = at_the_money(chain).where("side = 'C'").groupBy("underlying").agg(F.min_by(F.struct("spot", "iv"), "dte").alias("b")).select("underlying", "b.*")
    df = spot.withColumn("tenor", F.explode(F.array(*map(F.lit, tenors)))).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    move = F.col("spot") * F.col("iv") * F.sqrt(F.col("tenor") / F.lit(252.0)) * F.col("k")
    return df.select("underlying", "tenor", "k", F.round(F.col("spot") - move, 5).alias("lo"), F.round(F.col("spot") + move, 5).alias("hi"))


def payoff_grid(flies: DataFrame, points: int = 201) -> DataFrame:
    """MTH9: a fly's result at expiry on an even grid half a fly beyond its wings."""
    low, span = F.col("lo") - (F.col("centre") - F.col("lo")) / 2, (F.col("upper") - F.col("lo")) * 1.5
    df = flies.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("price", low + span * F.col("i") / (points - 1))
    wing = F.col("centre") - F.col("lo")
    return df.withColumn("result", F.greatest(wing - F.abs(F.col("price") - F.col("centre")), F.lit(0.0)) - F.col("debit"))
