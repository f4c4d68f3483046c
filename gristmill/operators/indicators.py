"""Indicators at every date of every symbol, as window expressions.

All windows are partitioned by symbol and ordered by date, so one exchange and
one sort serve every indicator that a query combines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.ieee import ln, ratio


def in_order() -> WindowSpec:
    """The bars of each symbol by date."""
    return Window.partitionBy("symbol").orderBy("d")


def last(n: int):
    """The frame of the current and the n - 1 bars before it."""
    return in_order().rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, of: str = "close") -> Column:
    """value, where the frame of n bars is complete."""
    return F.when(F.count(of).over(last(n)) == n, value)


def back(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(in_order())


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def with_returns(bars: DataFrame) -> DataFrame:
    """WIN1: simple and log returns against the bar before."""
    return bars.withColumn("ret", ratio(F.col("close"), back("close")) - 1).withColumn("logret", ln("close") - ln(back("close")))


def moving_averages(bars: DataFrame, lengths: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """WIN2: averages of the close over full frames; null before."""
    return bars.select("symbol", "d", *(F.round(full(F.avg("close").over(last(n)), n), 8).alias(f"ma{n}") for n in lengths))


def realized_volatility(bars: DataFrame, short: int = 20, long: int = 252) -> DataFrame:
    """WIN3: sample deviation of returns over two frames, their ratio, and the short one a year (x sqrt 252)."""
    df = with_returns(bars)
    a, b = (full(F.stddev_samp("ret").over(last(n)), n, "ret") for n in (short, long))
    return df.select("symbol", "d", r6(a, "sd_short"), r6(b, "sd_long"), r6(ratio(a, b), "sd_ratio"), r6(a * F.sqrt(F.lit(252.0)), "vol_annual"))


def log_volatility(bars: DataFrame, n: int = 30) -> DataFrame:
    """WIN4: annualised deviation of log returns; null for fewer than two returns or above 500 %."""
    df = with_returns(bars)
    v = F.stddev_samp("logret").over(last(n)) * F.sqrt(F.lit(252.0))
    return df.withColumn("v", F.when(F.count("logret").over(last(n)) >= 2, v)).select("symbol", "d", r6(F.when(F.col("v") <= 5.0, F.col("v")), "vol"))


def true_range() -> Column:
    c = back("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def average_true_range(bars: DataFrame) -> DataFrame:
    """WIN5: true range and its averages over 14 and 20 bars."""
    df = bars.withColumn("tr", true_range())
    return df.select("symbol", "d", r6(F.col("tr"), "tr"), *(r6(full(F.avg("tr").over(last(n)), n), f"atr{n}") for n in (14, 20)))


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    """WIN6: least low and greatest high of n bars, and where the close stands between them, 0 to 100."""
    lo, hi = F.min("low").over(last(n)), F.max("high").over(last(n))
    return bars.select("symbol", "d", full(lo, n).alias("support"), full(hi, n).alias("resistance"), r6(full(F.when(hi > lo, (F.col("close") - lo) / (hi - lo) * 100), n), "range_pct"))


#: Chunks of e**-40 that take the largest double (e**709.8) below the smallest (e**-744.5).
CHUNKS = 37


def with_ewm(df: DataFrame, value: str, alpha: float, out: str) -> DataFrame:
    """df with out: the exponential average y[t] = (1 - alpha) y[t - 1] + alpha x[t] of the non-null values so far, from the first on.

    The recursion unfolds to a running sum with weights that grow by
    1 / (1 - alpha) a bar.  Weights start anew in chunks, so that they stay in
    range on any history; a chunk takes over those before it by their ends.
    From one end to the next a value falls by e**40 or more, so that behind
    CHUNKS of them the largest double is 0.
    """
    chunk = math.ceil(40 / -math.log1p(-alpha))
    i = F.sum(F.when(F.col(value).isNotNull(), 1).otherwise(0)).over(in_order()) - 1
    df = df.withColumn("_i", i).withColumn("_at", F.pmod("_i", F.lit(chunk))).withColumn("_chunk", F.floor(F.col("_i") / chunk))
    growth = F.pow(F.lit(1 / (1 - alpha)), F.col("_at"))
    weighted = F.col(value) * F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * growth
    df = df.withColumn("_own", F.sum(weighted).over(Window.partitionBy("symbol", "_chunk").orderBy("d")) / growth)
    end = F.when((F.col("_at") == chunk - 1) & F.col(value).isNotNull(), F.col("_own"))
    df = df.withColumn("_before", F.collect_list(end).over(Window.partitionBy("symbol").orderBy("_chunk").rangeBetween(-CHUNKS, -1)))
    taken = F.aggregate("_before", F.lit(0.0), lambda a, x: a * F.lit((1 - alpha) ** chunk) + x) * F.pow(F.lit(1 - alpha), F.col("_at") + 1)
    df = df.withColumn(out, F.when(F.col("_i") >= 0, F.col("_own") + taken))
    return df.drop("_i", "_at", "_chunk", "_own", "_before")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """WIN7: relative strength of exponential gains and losses (alpha 1 / n); 100 without losses."""
    df = bars.withColumn("chg", F.col("close") - back("close"))
    df = df.withColumn("gain", F.greatest("chg", F.lit(0.0))).withColumn("loss", F.greatest(-F.col("chg"), F.lit(0.0)))
    df = df.withColumn("gain", F.when(F.col("chg").isNotNull(), F.col("gain"))).withColumn("loss", F.when(F.col("chg").isNotNull(), F.col("loss")))
    df = with_ewm(with_ewm(df, "gain", 1 / n, "g"), "loss", 1 / n, "l")
    value = F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("g") / F.col("l")))
    return df.select("symbol", "d", F.round(F.when(F.row_number().over(in_order()) > n, value), 4).alias("rsi"))


def macd(bars: DataFrame) -> DataFrame:
    """WIN8: exponential averages of 12 and 26 bars, their gap, its average of 9, and the histogram from bar 35 on."""
    df = with_ewm(with_ewm(bars, "close", 2 / 13, "fast"), "close", 2 / 27, "slow").withColumn("macd", F.col("fast") - F.col("slow"))
    df = with_ewm(df, "macd", 2 / 10, "signal")
    on = F.row_number().over(in_order()) >= 35
    return df.select("symbol", "d", *(F.round(F.when(on, F.col(c)), 5).alias(c) for c in ("macd", "signal")), F.round(F.when(on, F.col("macd") - F.col("signal")), 5).alias("hist"))


def max_drawdown(bars: DataFrame, n: int = 60) -> DataFrame:
    """WIN9: the deepest fall below the running peak inside the last n bars."""
    closes = F.collect_list("close").over(last(n))
    fold = F.aggregate(closes, F.struct(F.lit(0.0).alias("peak"), F.lit(None).cast("double").alias("dd")), lambda a, x: F.struct(F.greatest(a["peak"], x).alias("peak"), F.least(a["dd"], ratio(x, F.greatest(a["peak"], x)) - 1).alias("dd")), lambda a: a["dd"])
    return bars.withColumn("dd", fold).select("symbol", "d", r6(full(F.col("dd"), n), "drawdown"))


def trend_slope(bars: DataFrame, n: int = 50, fit: int = 60) -> DataFrame:
    """WIN10, WIN11: least-squares slope over n bars by their mean; slope in % a day and fit (R2) over another frame."""
    df = bars.withColumn("rn", F.row_number().over(in_order()).cast("double"))
    slope = lambda k: F.regr_slope("close", "rn").over(last(k))
    return df.select("symbol", "d", r6(full(ratio(slope(n), F.avg("close").over(last(n))), n), "slope"), r6(full(ratio(slope(fit), F.avg("close").over(last(fit))) * 100, fit), "slope_pct"), r6(full(F.regr_r2("close", "rn").over(last(fit)), fit), "r2"))


def horizon_returns(bars: DataFrame, market: DataFrame) -> DataFrame:
    """WIN12, JOI1: returns over 5, 21, 63, 126 and 252 bars and "20 day" returns (25 bars), and strength against the market's by date."""
    steps = (5, 21, 63, 126, 252)
    m = market.select("d", *((ratio(F.col("close"), F.lag("close", n).over(Window.partitionBy("symbol").orderBy("d"))) - 1).alias(f"m{n}") for n in steps))
    df = bars.select("symbol", "d", (ratio(F.col("close"), back("close", 25)) - 1).alias("ret_25b"), *((ratio(F.col("close"), back("close", n)) - 1).alias(f"r{n}") for n in steps))
    df = df.join(m, "d", "left")
    return df.select("symbol", "d", r6(F.col("ret_25b"), "ret_25b"), *(r6(F.col(f"r{n}"), f"r{n}") for n in steps), *(r6(F.col(f"r{n}") - F.col(f"m{n}"), f"rs{n}") for n in steps[1:]))


def volatility_percentile(bars: DataFrame, window: int = 252) -> DataFrame:
    """WIN13: the share of the trailing window's 20-bar volatilities below the latest one, in %."""
    df = with_returns(bars).withColumn("v", F.round(full(F.stddev_samp("ret").over(last(20)), 20, "ret"), 9))
    seen = F.collect_list("v").over(last(window))  # nulls are left out
    return df.withColumn("seen", seen).select("symbol", "d", r6(F.when(F.size("seen") > 0, F.size(F.filter("seen", lambda x: x < F.col("v"))) / F.size("seen") * 100), "vol_pctile"))


def volume_ratios(bars: DataFrame) -> DataFrame:
    """WIN14: volume of 5, 10 and 1 bars against 20, and the traded value of 20 bars in millions."""
    avg = lambda n: F.avg("volume").over(last(n))
    return bars.select("symbol", "d", r6(full(avg(5) / avg(20), 20), "v5_20"), r6(full(avg(10) / avg(20), 20), "v10_20"), r6(full(F.col("volume") / avg(20), 20), "v1_20"), r6(full(F.avg(F.col("close") * F.col("volume")).over(last(20)) / 1e6, 20), "adv_musd"))


def accumulation(bars: DataFrame, n: int = 20) -> DataFrame:
    """WIN15: close location x volume summed over n bars, with expansion (5 over 20 bars above 1.2) and contraction (below 0.8)."""
    span = F.col("high") - F.col("low")
    df = bars.withColumn("mf", F.when(span > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span * F.col("volume")).otherwise(0.0))
    df = df.withColumn("ad", F.sum("mf").over(in_order())).withColumn("rn", F.row_number().over(in_order()).cast("double"))
    ratio = F.avg("volume").over(last(5)) / F.avg("volume").over(last(n))
    return df.select("symbol", "d", F.round(full(F.regr_slope("ad", "rn").over(last(n)) / F.avg("volume").over(last(n)), n), 5).alias("ad_slope"), full(ratio > 1.2, n).alias("expansion"), full(ratio < 0.8, n).alias("contraction"))


def swings(bars: DataFrame, k: int = 5) -> DataFrame:
    """WIN16: swing highs and lows: not below (above) any of the k bars on either side."""
    around = in_order().rowsBetween(-k, k)
    whole = F.count("*").over(around) == 2 * k + 1
    return bars.withColumn("is_high", whole & (F.col("high") >= F.max("high").over(around))).withColumn("is_low", whole & (F.col("low") <= F.min("low").over(around)))


def swing_counts(bars: DataFrame, n: int = 60) -> DataFrame:
    """WIN17: higher swing highs and higher swing lows among the last n bars."""
    df = swings(bars)
    for side, of in (("high", "is_high"), ("low", "is_low")):
        prior = F.last(F.when(F.col(of), F.col(side)), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn(f"_{side}", F.when(F.col(of) & (F.col(side) > prior), 1).otherwise(0))
    return df.select("symbol", "d", F.sum("_high").over(last(n)).alias("higher_highs"), F.sum("_low").over(last(n)).alias("higher_lows"))


def anchored_vwap(bars: DataFrame) -> DataFrame:
    """WIN18: at each symbol's last bar, the volume-weighted price since the 252-bar low, the 60-bar low and the latest gap up over 2 % within 30 bars."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    df = bars.withColumn("prior", back("close")).withColumn("age", F.row_number().over(down) - 1)
    df = df.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    at = df.groupBy("symbol").agg(
        F.min_by("d", F.when(F.col("age") < 252, F.struct("low", "d"))).alias("low252"),
        F.min_by("d", F.when(F.col("age") < 60, F.struct("low", "d"))).alias("low60"),
        F.max(F.when((F.col("age") < 30) & (F.col("open") > F.col("prior") * 1.02), F.col("d"))).alias("gap"),
    )
    kinds = at.select("symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("anchor"), F.col(k).alias("since")) for k in ("low252", "low60", "gap")))).alias("a")).select("symbol", "a.*").where("since is not null")
    got = df.join(kinds, "symbol").where(F.col("d") >= F.col("since")).groupBy("symbol", "anchor", "since")
    return got.agg(r6(F.sum(F.col("tp") * F.col("volume")) / F.sum("volume"), "vwap"))


def unfilled_gaps(bars: DataFrame, n: int = 60) -> DataFrame:
    """WIN19: gaps of 0.5 % or more within the last n bars that no later bar has closed, with their age in bars."""
    after = in_order().rowsBetween(1, Window.unboundedFollowing)
    df = bars.select("symbol", "d", "low", "high", back("high").alias("ph"), back("low").alias("pl"), F.min("low").over(after).alias("fl"), F.max("high").over(after).alias("fh"), (F.count("*").over(Window.partitionBy("symbol")) - F.row_number().over(in_order())).cast("int").alias("age"))
    up = (F.col("low") > F.col("ph") * 1.005) & (F.coalesce("fl", "low") > F.col("ph"))
    down = (F.col("high") < F.col("pl") * 0.995) & (F.coalesce("fh", "high") < F.col("pl"))
    return df.where((F.col("age") < n) & (up | down)).select("symbol", "d", F.when(up, "up").otherwise("down").alias("side"), F.when(up, F.col("ph")).otherwise(F.col("pl")).alias("edge"), "age")


def percentile_rank(value: str | Column, *by: str) -> Column:
    """WIN20: average-tie rank of non-null values within by, 0 to 100; a single value ranks 0."""
    value = F.col(value) if isinstance(value, str) else value
    group = Window.partitionBy(*by)
    n = F.count(value).over(group)
    rank = F.rank().over(group.orderBy(value.asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), (rank - 1 + (ties - 1) / 2) / F.greatest(n - 1, F.lit(1)) * 100)


def return_quantiles(bars: DataFrame, h: int = 10) -> DataFrame:
    """WIN21: quantiles of each symbol's sums of h log returns."""
    df = with_returns(bars).withColumn("s", full(F.sum("logret").over(last(h)), h, "logret")).where("s is not null")
    qs = (0.05, 0.16, 0.5, 0.84, 0.95)
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.percentile("s", list(qs)).alias("q")).select("symbol", "n", *(r6(F.col("q")[i], f"q{int(q * 100)}") for i, q in enumerate(qs)))


def forward_returns(bars: DataFrame, steps: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """WIN22: returns to the bars some steps ahead; null where they are not there yet."""
    return bars.select("symbol", "d", *(r6(ratio(F.lead("close", n).over(in_order()), F.col("close")) - 1, f"fwd{n}") for n in steps))


def volatility_median(bars: DataFrame, n: int = 5) -> DataFrame:
    """WIN23: the median of each symbol's rolling deviations of n log returns."""
    df = with_returns(bars).withColumn("v", full(F.stddev_samp("logret").over(last(n)), n, "logret"))
    return df.groupBy("symbol").agg(r6(F.median("v"), "vol_median"), F.count("v").alias("n"))


def regime_features(bars: DataFrame, n: int = 21) -> DataFrame:
    """WIN24: annualised volatility, summed return and summed absolute return of n bars."""
    df = with_returns(bars)
    frame = last(n)
    return df.where("logret is not null").select("symbol", "d", *(r6(full(c.over(frame), n, "logret"), k) for c, k in ((F.stddev_samp("logret"), "rv"), (F.sum("logret"), "cum"), (F.sum(F.abs("logret")), "moved")))).where("rv is not null")


def run_lengths(df: DataFrame, state: str) -> DataFrame:
    """WIN25: rows of (symbol, d, state) with the number of bars that the state has lasted, this one included."""
    change = F.when(F.col(state).eqNullSafe(back(state)), 0).otherwise(1)
    df = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(in_order()))
    return df.withColumn("duration", F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("d"))).drop("_c", "_run")


def average_slope_regime(bars: DataFrame) -> DataFrame:
    """WIN28: rising, falling or flat: the 50-bar average against itself 9 bars ago (0.5 % apart)."""
    df = bars.withColumn("ma50", full(F.avg("close").over(last(50)), 50)).withColumn("was", back("ma50", 9))
    change = ratio(F.col("ma50"), F.col("was")) - 1
    return df.select("symbol", "d", F.when(change > 0.005, "rising").when(change < -0.005, "falling").when(change.isNotNull(), "flat").otherwise("n/a").alias("regime"))


def weekly(bars: DataFrame) -> DataFrame:
    """AGG1: bars by calendar week (Monday to Sunday): first open, highest, lowest, last close, summed volume."""
    return bars.groupBy("symbol", F.to_date(F.date_trunc("week", "d")).alias("wk")).agg(F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"))


def weekday_returns(bars: DataFrame) -> DataFrame:
    """AGG2: mean, deviation and number of returns by weekday, Monday 0."""
    return with_returns(bars).where("ret is not null").groupBy("symbol", F.weekday("d").alias("wd")).agg(r6(F.avg("ret"), "mean"), r6(F.stddev_samp("ret"), "sd"), F.count("*").alias("n"))


def month_returns(bars: DataFrame) -> DataFrame:
    """AGG3: returns inside each calendar month, then their mean, median and number by month of year."""
    months = bars.groupBy("symbol", F.year("d").alias("y"), F.month("d").alias("m")).agg((ratio(F.max_by("close", "d"), F.min_by("close", "d")) - 1).alias("r"))
    return months.groupBy("symbol", "m").agg(r6(F.avg("r"), "mean"), r6(F.median("r"), "median"), F.count("*").alias("n"))


def volume_profile(bars: DataFrame, n: int = 60, bins: int = 20) -> DataFrame:
    """AGG5, AGG6: volume by price bin over each symbol's last n bars; the fullest bin (first of equals) and high-volume nodes."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    df = bars.withColumn("age", F.row_number().over(down)).where(F.col("age") <= n)
    whole = Window.partitionBy("symbol")
    df = df.withColumn("lo", F.min("low").over(whole)).withColumn("hi", F.max("high").over(whole)).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    at = F.least(F.floor((F.col("tp") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    filled = df.where("hi > lo").groupBy("symbol", at.cast("int").alias("bin")).agg(F.sum("volume").alias("volume"))
    grid = filled.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full_bins = grid.join(filled, ["symbol", "bin"], "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    by = Window.partitionBy("symbol").orderBy("bin")
    best = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "bin")) == 1
    node = (F.col("volume") >= 1.5 * F.avg("volume").over(whole)) & (F.col("volume") >= F.lag("volume").over(by)) & (F.col("volume") >= F.lead("volume").over(by))
    return full_bins.select("symbol", "bin", "volume", best.alias("is_poc"), F.coalesce(node, F.lit(False)).alias("is_node"))
