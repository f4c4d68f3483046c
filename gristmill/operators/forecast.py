"""Forecast bands, their resolution against later bars, calibration, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import indicators as I
from ..functions.ieee import ratio

HORIZONS = (5, 10, 21, 42, 63)
Z = {"lo90": -1.645, "lo68": -1.0, "median": 0.0, "hi68": 1.0, "hi90": 1.645}


WEIGHTS = {"gbm": 0.5, "iv": 0.3, "history": 0.2}
#: Bars that a forecast looks back on for its historical windows, and bars between two forecasts.
HISTORY, EVERY = 504, 21


def forecast_rows(bars: DataFrame, every: int = EVERY, latest: bool = False) -> DataFrame:
    """(symbol, d, rn, k, spot, n_ret, mu, sd, sd_all): every 21st bar of each symbol, or its last one, with drift (60 returns) and volatility (120) so far.

    Log returns; shorter histories are taken as they are, from 20 returns on.
    k numbers the forecasts of a symbol.
    """
    df = I.with_returns(bars).withColumn("rn", F.row_number().over(I.in_order()))
    last = F.max("rn").over(Window.partitionBy("symbol"))
    df = df.withColumn("n_ret", F.col("rn") - 1).withColumn("mu", F.avg("logret").over(I.last(60))).withColumn("sd", F.stddev_samp("logret").over(I.last(120))).withColumn("sd_all", F.stddev_samp("logret").over(I.last(HISTORY)))
    df = df.withColumn("end", last).where((F.col("rn") == F.col("end")) if latest else (F.col("rn") % every == 0)).where("n_ret >= 20")
    return df.select("symbol", "d", "rn", F.ceil(F.col("rn") / every).cast("int").alias("k"), F.col("close").alias("spot"), "n_ret", "mu", "sd", "sd_all")


QUANTILES = (0.05, 0.16, 0.5, 0.84, 0.95)


def _quantiles(values: Column) -> Column:
    """The quantiles of an array, between neighbours in proportion."""
    ordered = F.array_sort(values)
    out = []
    for q in QUANTILES:
        at = (F.size(ordered) - 1) * q
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        out.append(F.when(low == high, F.get(ordered, low)).otherwise((high - at) * F.get(ordered, low) + (at - low) * F.get(ordered, high)))
    return F.array(*out)


def historical_quantiles(rows: DataFrame, bars: DataFrame, every: int = EVERY) -> DataFrame:
    """WIN21: (symbol, rn, horizon, q): quantiles .05, .16, .5, .84, .95 of the sums of h log returns in the windows before each forecast, from 60 more returns than h on.

    Windows are packed into a row for each block of bars; a forecast asks for
    the blocks that it looks back on, a fixed number, by equal keys, and takes
    its quantiles from the arrays.
    """
    df = I.with_returns(bars).withColumn("at", F.row_number().over(I.in_order()))
    sums = [I.full(F.sum("logret").over(I.last(h)), h, "logret").alias(f"s{h}") for h in HORIZONS]
    packed = df.select("symbol", "at", *sums).groupBy("symbol", F.floor(F.col("at") / every).alias("block")).agg(F.collect_list(F.struct("at", *(f"s{h}" for h in HORIZONS))).alias("w"))
    block = lambda at: F.floor(at / every)
    asked = rows.select("symbol", "rn", "n_ret", F.explode(F.sequence(block(F.greatest(F.col("rn") - HISTORY + 1, F.lit(0))), block(F.col("rn") - 1))).alias("block"))
    got = asked.join(packed, ["symbol", "block"]).groupBy("symbol", "rn", "n_ret").agg(F.flatten(F.collect_list("w")).alias("w"))
    got = got.withColumn("w", F.filter("w", lambda x: (x["at"] < F.col("rn")) & (x["at"] > F.col("rn") - HISTORY)))
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.array_compact(F.col("w")[f"s{h}"]).alias("s")) for h in HORIZONS))
    got = got.select("symbol", "rn", "n_ret", F.explode(each).alias("x")).select("symbol", "rn", "n_ret", "x.*")
    got = got.where((F.size("s") >= 30) & (F.col("n_ret") >= F.col("horizon") + 60))
    return got.select("symbol", "rn", "horizon", _quantiles(F.col("s")).alias("q"), F.size("s").cast("long").alias("n"))


def bands(bars: DataFrame, surface: DataFrame | None = None, pattern: DataFrame | None = None, latest: bool = False) -> DataFrame:
    """DOM27: price bands of each forecast and horizon, blended in log space from three components.

    Half drift and volatility of past returns, 0.3 the at-the-money volatility
    of the expiry nearest to the horizon (surface: underlying, dte, iv; the
    earlier of equals), 0.2 quantiles of past windows; a component that is not
    there leaves its weight to the others.  At 21 days a pattern(symbol,
    avg_return, n) of ten and more cases moves the median by 0.3 to its own.
    Only bars up to the forecast's own are used.
    """
    rows = forecast_rows(bars, latest=latest)
    df = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS)))).join(historical_quantiles(rows, bars), ["symbol", "rn", "horizon"], "left")
    if surface is not None:
        near = F.struct(F.abs(F.col("dte") - F.col("horizon")), "dte")
        iv = surface.where("iv > 0").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS)))).groupBy(F.col("underlying").alias("symbol"), "horizon").agg(F.min_by("iv", near).alias("iv"))
        df = df.join(iv, ["symbol", "horizon"], "left")
    else:
        df = df.withColumn("iv", F.lit(None).cast("double"))
    h = F.col("horizon").cast("double")
    has_iv, has_history = F.col("iv").isNotNull(), F.col("q").isNotNull()
    total = WEIGHTS["gbm"] + F.when(has_iv, WEIGHTS["iv"]).otherwise(0.0) + F.when(has_history, WEIGHTS["history"]).otherwise(0.0)
    index = {"lo90": 0, "lo68": 1, "median": 2, "hi68": 3, "hi90": 4}
    for name, z in Z.items():
        gbm = F.col("mu") * h + z * F.col("sd") * F.sqrt(h)
        iv_part = F.coalesce(z * F.col("iv") / F.sqrt(F.lit(252.0)) * F.sqrt(h), F.lit(0.0))
        past = F.coalesce(F.col("q")[index[name]], F.lit(0.0))
        df = df.withColumn(f"l_{name}", (WEIGHTS["gbm"] * gbm + WEIGHTS["iv"] * iv_part + WEIGHTS["history"] * past) / total)
    year = F.sqrt(F.lit(252.0))
    sigma = (WEIGHTS["gbm"] * F.col("sd") * year + WEIGHTS["iv"] * F.coalesce("iv", F.lit(0.0)) + F.when(has_history, WEIGHTS["history"] * F.col("sd_all") * year).otherwise(0.0)) / total
    method = F.concat_ws("+", F.lit("gbm"), F.when(has_iv, "iv"), F.when(has_history, "history"))
    if pattern is not None:
        known = pattern.where("n >= 10 and avg_return > -1").select("symbol", "avg_return")
        df = df.join(known, "symbol", "left")
        use = (F.col("horizon") == 21) & F.col("avg_return").isNotNull()
        df = df.withColumn("l_median", F.when(use, 0.7 * F.col("l_median") + 0.3 * F.log1p("avg_return")).otherwise(F.col("l_median")))
        method = F.concat_ws("+", method, F.when(use, "pattern"))
    return df.select("symbol", "d", "rn", "horizon", "spot", *(F.round(F.col("spot") * F.exp(f"l_{k}"), 6).alias(k) for k in Z), F.round(sigma, 6).alias("sigma"), method.alias("method"))


def calendar_days(horizon: int) -> int:
    """DAT2: trading days as calendar days, rounded down."""
    return horizon * 365 // 252


def resolved(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """DOM28, JOI13: each forecast whose horizon has passed: the last close within its calendar days, best and worst close on the way in %, and whether the bands held.

    Windows by day number give every bar the outcome of all horizons; the
    forecasts then meet them on (symbol, bar), so no range join is needed.
    """
    day = F.unix_date("d")
    df = bars.withColumn("rn", F.row_number().over(I.in_order())).withColumn("day", day)
    span = Window.partitionBy("symbol").orderBy("day")
    out = []
    for h in HORIZONS:
        ahead = span.rangeBetween(0, calendar_days(h))
        out.append(F.struct(F.lit(h).alias("horizon"), F.last("close").over(ahead).alias("actual"), F.max("close").over(ahead).alias("top"), F.min("close").over(ahead).alias("bottom"), (F.col("day") + calendar_days(h)).alias("due")))
    end = F.max("day").over(Window.partitionBy("symbol"))
    df = df.select("symbol", "rn", "close", end.alias("end"), F.array(*out).alias("o")).select("symbol", "rn", "close", "end", F.explode("o").alias("o")).select("symbol", "rn", "close", "end", "o.*")
    got = forecasts.join(df.where("due <= end"), ["symbol", "rn", "horizon"])
    inside = lambda lo, hi: F.col("actual").between(F.col(lo), F.col(hi))
    anchor = F.col("close")
    return got.select(
        "symbol", "d", "horizon", "actual", F.round((ratio(F.col("top"), anchor) - 1) * 100, 6).alias("mfe"), F.round((ratio(F.col("bottom"), anchor) - 1) * 100, 6).alias("mae"),
        inside("lo68", "hi68").alias("in68"), inside("lo90", "hi90").alias("in90"), F.round(F.abs(ratio(F.col("actual"), F.col("median")) - 1), 6).alias("error"),
    )


def level_touches(levels_: DataFrame, bars: DataFrame, days: int = 21, tolerance: float = 0.005) -> DataFrame:
    """JOI13: levels(symbol, d, name, level) with whether a high passed over and a low under the level, by half a percent, within the days after."""
    ahead = Window.partitionBy("symbol").orderBy("day").rangeBetween(0, days)
    df = bars.withColumn("day", F.unix_date("d")).select("symbol", "d", F.max("high").over(ahead).alias("top"), F.min("low").over(ahead).alias("bottom"))
    got = levels_.join(df, ["symbol", "d"])
    return got.select(*levels_.columns, (F.col("top") >= F.col("level") * (1 + tolerance)).alias("over"), (F.col("bottom") <= F.col("level") * (1 - tolerance)).alias("under"))


def open_records(records: DataFrame, today: Column, oldest: int = 400) -> DataFrame:
    """FIL11: records(profile, label, last_resolved, as_of) that are to be resolved today: no macro ones, none closed or rejected, none done today, none beyond their horizon."""
    closed = F.coalesce(F.col("label").isin("closed", "rejected", "outcome_unavailable"), F.lit(False))
    done = F.coalesce(F.to_date("last_resolved") == today, F.lit(False))
    return records.where((F.col("profile") != "macro_dashboard") & ~closed & ~done & (F.datediff(today, F.to_date("as_of")) <= oldest))


def calibration(outcomes: DataFrame, *by: str, least: int = 30, within: float = 0.10) -> DataFrame:
    """AGG17: how often the bands held by horizon (and more columns), mean excursions and error, and which coverages are near enough on enough outcomes."""
    c = lambda k: F.avg(F.col(k).cast("double"))
    enough = F.count("*") >= least
    ok68, ok90 = (F.abs(c("in68") - 0.68) <= within) & enough, (F.abs(c("in90") - 0.90) <= within) & enough
    return outcomes.groupBy(*by, "horizon").agg(
        F.count("*").alias("n"), F.round(c("in68"), 6).alias("cov68"), F.round(c("in90"), 6).alias("cov90"), F.round(F.avg("mfe"), 9).alias("mfe_mean"), F.round(F.avg("mae"), 9).alias("mae_mean"),
        F.round(F.avg("error"), 9).alias("error"), ok68.alias("calibrated68"), ok90.alias("calibrated90"), (ok68 & ok90).alias("calibrated"),
    )


def symbol_status(cal: DataFrame, least: int = 30) -> DataFrame:
    """AGG17: preliminary below 30 outcomes in all, validated when every horizon is calibrated, else calibrating."""
    status = F.when(F.sum("n") < least, "preliminary").when(F.bool_and("calibrated"), "validated").otherwise("calibrating")
    return cal.groupBy("symbol").agg(F.count("*").alias("horizons"), F.sum("n").alias("n"), status.alias("status"))


def pattern_calibration(outcomes: DataFrame) -> DataFrame:
    """AGG16: outcomes(horizon, pattern_used, in68, in90, error) by horizon with and without a pattern: coverages, mean errors, how much
    nearer to theory the pattern brings them (below 0: nearer), and the status by the number of both (10, 30)."""
    def of(flag: bool, name: str) -> list[Column]:
        own = F.col("pattern_used") == flag
        mean = lambda c: F.avg(F.when(own, c))
        return [F.count_if(own).alias(f"n_{name}"), mean(F.col("in68").cast("double")).alias(f"cov68_{name}"), mean(F.col("in90").cast("double")).alias(f"cov90_{name}"), F.round(mean(F.col("error")), 9).alias(f"error_{name}")]

    got = outcomes.groupBy("horizon").agg(*of(True, "with"), *of(False, "without"))
    gain = lambda k, theory: F.round(F.abs(F.col(f"{k}_with") - theory) - F.abs(F.col(f"{k}_without") - theory), 6)
    n = F.col("n_with") + F.col("n_without")
    status = F.when(n < 10, "insufficient_data").when(n < 30, "preliminary").otherwise("mature")
    got = got.withColumn("improve68", gain("cov68", 0.68)).withColumn("improve90", gain("cov90", 0.90)).withColumn("status", status)
    return got.select("horizon", *(F.round(c, 6).alias(c) if c.startswith("cov") else F.col(c) for c in got.columns if c != "horizon"))


def paper_signals(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """DOM29: each forecast's horizons (id, horizon) with the first close int(1.4 h) days after it or later, its return, whether the bands held, and the signal's status.

    A signal is logged, partially_resolved or fully_resolved by how many of its
    horizons have a close.
    """
    f = forecasts.withColumn("due", F.date_add("d", F.floor(F.col("horizon") * 1.4).cast("int")))
    got = as_of(f, bars.select("symbol", F.col("d").alias("bar_d"), "close"), "symbol", "due", "bar_d", "close", forward=True)
    inside = lambda lo, hi: F.col("close").between(F.col(lo), F.col(hi))
    by = Window.partitionBy("symbol", "d")
    done, all_ = F.count("close").over(by), F.count("*").over(by)
    status = F.when(done == 0, "logged").when(done < all_, "partially_resolved").otherwise("fully_resolved")
    return got.select("symbol", "d", "horizon", "due", F.col("found_bar_d").alias("realized"), F.round(ratio(F.col("close"), F.col("spot")) - 1, 6).alias("actual_return"), inside("lo68", "hi68").alias("in68"), inside("lo90", "hi90").alias("in90"), status.alias("status"))


def validation(forward: DataFrame, oos: DataFrame) -> DataFrame:
    """AGG18: forward(symbol, pattern, horizon, actual_return, in68, in90) against oos(symbol, pattern, n, hit_rate, avg_return): the four checks and the status.

    OOS-conditional below ten cases; validating below 21 forward ones; then
    validated with all checks, validating with two or three, else failed:
    a hit rate of 0.4 out of sample, forward hits at least half of it, a forward mean at least
    half of its mean, and coverages within a tenth of theory.
    """
    at21 = (F.col("horizon") == 21) & F.col("actual_return").isNotNull()
    c = lambda k, cond: F.avg(F.when(cond, F.col(k).cast("double")))
    got = forward.groupBy("symbol", "pattern").agg(F.count_if(at21).alias("forward_n"), c("in68", at21).alias("hit"), c("actual_return", at21).alias("mean"), c("in68", F.lit(True)).alias("cov68"), c("in90", F.lit(True)).alias("cov90"))
    df = oos.join(got, ["symbol", "pattern"], "left").withColumn("forward_n", F.coalesce("forward_n", F.lit(0)))
    checks = [F.col("hit_rate") >= 0.4, F.col("hit") >= 0.5 * F.col("hit_rate"), F.col("mean") >= 0.5 * F.col("avg_return"), (F.abs(F.col("cov68") - 0.68) <= 0.10) & (F.abs(F.col("cov90") - 0.90) <= 0.10)]
    passed = F.lit(0)
    for x in checks:
        passed = passed + F.coalesce(x.cast("int"), F.lit(0))
    df = df.withColumn("passed", passed)
    status = F.when(F.col("n") < 10, "OOS-conditional").when(F.col("forward_n") < 21, "validating").when(F.col("passed") == 4, "validated").when(F.col("passed") >= 2, "validating").otherwise("failed_validation")
    return df.select("symbol", "pattern", "n", "forward_n", *(F.round(k, 9).alias(k) for k in ("hit", "mean", "cov68", "cov90")), "passed", status.alias("status"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, forward: bool = False) -> DataFrame:
    """JOI11, JOI12: left with the value of the latest row of right at or before its time (forward: the first at or after).

    Both sides are put in one order by key and time and the value is carried
    along, so it costs one shuffle and one sort and no row meets more than its
    neighbours.
    """
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_time].dataType).alias("_vt"))
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(right_time).alias("_vt"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.desc("_t"), F.asc("_side")] if forward else [F.asc("_t"), F.asc("_side")]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("found", F.last(F.when(F.col("_v").isNotNull(), F.struct("_v", "_vt")), True).over(w)).where("_side = 1")
    return got.withColumn(value, F.col("found._v")).withColumn("found_" + right_time, F.col("found._vt")).drop("_t", "_side", "_v", "_vt", "found")


def due_date(start: Column, horizon: Column) -> Column:
    """DAT2: trading days as calendar days, rounded down."""
    return F.date_add(start, F.floor(horizon * 365 / 252).cast("int"))


def patterns(bars: DataFrame) -> DataFrame:
    """DOM18, DOM20: double tops and bottoms and head-and-shoulders among neighbouring swings of a side.

    Double: two neighbouring swings within 2 %, 10 to 60 bars apart.  Head and
    shoulders: the middle one of three beyond both others by 2 % and those
    within 3 % of each other.  A pattern counts from the bar that completes its last swing.
    """
    df = I.swings(bars).withColumn("rn", F.row_number().over(I.in_order())).withColumn("known", F.lead("d", 5).over(I.in_order()))
    out = None
    for side, flag, sign, double, shoulders in (("high", "is_high", 1, "double_top", "head_shoulders"), ("low", "is_low", -1, "double_bottom", "inverse_head_shoulders")):
        p = df.where(F.col(flag)).select("symbol", "d", "rn", "known", F.col(side).alias("v"))
        one, two = F.lag(F.struct("v", "rn"), 1).over(I.in_order()), F.lag(F.struct("v", "rn"), 2).over(I.in_order())
        p = p.withColumn("one", one).withColumn("two", two)
        is_double = (F.abs(ratio(F.col("v"), F.col("one.v")) - 1) <= 0.02) & (F.col("rn") - F.col("one.rn")).between(10, 60)
        head = sign * (ratio(F.col("one.v"), F.greatest("v", "two.v")) - 1) > 0.02 if sign > 0 else sign * (ratio(F.col("one.v"), F.least("v", "two.v")) - 1) > 0.02
        is_head = head & (F.abs(ratio(F.col("v"), F.col("two.v")) - 1) <= 0.03)
        kinds = F.array_compact(F.array(F.when(is_double, F.lit(double)), F.when(is_head, F.lit(shoulders))))
        got = p.where("known is not null").select("symbol", "d", "known", F.explode(kinds).alias("pattern"))
        out = got if out is None else out.union(got)
    return out


def levels(bars: DataFrame, nearest: int = 8) -> DataFrame:
    """DOM15, TOP3: supports and resistances of each symbol at its last bar from swings, averages and the range, the nearest of each side."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    df = I.swings(bars).withColumn("ma50", I.full(F.avg("close").over(I.last(50)), 50)).withColumn("ma200", I.full(F.avg("close").over(I.last(200)), 200)).withColumn("age", F.row_number().over(down))
    last = df.where("age = 1").select("symbol", F.col("close").alias("spot"), F.round("ma50", 8).alias("ma50"), F.round("ma200", 8).alias("ma200"))
    near = df.where("age <= 120")
    parts = [near.where("is_high").select("symbol", F.lit("swing_high").alias("source"), F.col("high").alias("level")), near.where("is_low").select("symbol", F.lit("swing_low").alias("source"), F.col("low").alias("level")), *(last.where(f"{m} is not null").select("symbol", F.lit(m).alias("source"), F.col(m).alias("level")) for m in ("ma50", "ma200"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.distinct().join(last.select("symbol", "spot"), "symbol").withColumn("side", F.when(F.col("level") <= F.col("spot"), "support").otherwise("resistance"))
    place = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.abs(F.col("level") - F.col("spot")), "source", "level"))
    return got.withColumn("place", place).where(F.col("place") <= nearest).select("symbol", "side", "place", "source", "level", F.round(ratio(F.col("level"), F.col("spot")) - 1, 6).alias("distance"))
