"""Features, the cross-sectional rank from a specification table, and its walk-forward backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import indicators as I, rank_spec as R
from ..functions.ieee import ratio

SPEC_SCHEMA = "variant string, factor string, factor_weight double, sub_metric string, field string, kind string, weight double, low double, high double, below double, above double, floor double"

#: Features from bars and the market's bars.
PRICE_FIELDS = (
    "rs_1m", "rs_3m", "rs_6m", "rs_12m", "dist_50d", "dist_200d", "rsi", "slope_50d", "macd_hist", "vol_ratio", "atr_less_market", "max_dd_60d", "vol_percentile",
    "range_pctile", "dist_50d_atr", "room_atr", "profile_pos", "adv_musd", "volume_ratio", "net_flow",
)
#: Features from fundamentals, estimates and positions.
COMPANY_FIELDS = (
    "trailing_pe", "forward_pe", "peg_ratio", "price_to_book", "price_to_sales", "ev_to_ebitda", "earnings_yield", "fcf_yield", "roe", "roa", "operating_margin", "profit_margin",
    "revenue_growth", "earnings_growth", "debt_to_equity", "cash_conversion", "target_upside", "analyst_rating", "analyst_coverage", "short_float", "institutions", "insiders",
)
EVENT_FIELDS = ("days_to_earnings", "event_window", "month_drift", "earnings_drift", "surprise_pct", "revisions", "news_count", "news_sentiment", "bullish_share", "messages", "short_change", "days_to_cover")
MACRO_FIELDS = ("macro_score", "bear_risk", "regime_confidence", "sector_fit", "credit_stress")
FIELDS = (*PRICE_FIELDS, *COMPANY_FIELDS, *EVENT_FIELDS, *MACRO_FIELDS)


def spec_table(spark: SparkSession, variants: tuple[str, ...] = ("default", "technical", "contrarian")) -> DataFrame:
    """DOM10: the specification of each variant, a row for each sub-metric."""
    return spark.createDataFrame([r for r in R.variants() if r[0] in variants], SPEC_SCHEMA)


def setup_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.setup_scores(), "variant string, setup string, setup_score double")


def tilt_kind(bear_risk: Column, regime: Column) -> Column:
    """DOM7: defensive from a bear risk of 0.4 or in a regime of risk aversion, offensive up to 0.15 in risk_on."""
    averse = regime.isin("bear_risk_elevated", "risk_off", "fragile_risk_on")
    return F.when((bear_risk >= 0.4) | averse, "defensive").when((bear_risk <= 0.15) & (regime == "risk_on"), "offensive")


def tilted(spec: DataFrame, macro: DataFrame) -> DataFrame:
    """DOM7: factor weights with the tilt of the macro state, a table of one row (bear_risk, regime)."""
    rows = [(kind, f, x) for kind, of in R.TILTS.items() for f, x in of.items()]
    tilts = spec.sparkSession.createDataFrame(rows, "kind string, factor string, plus double")
    now = macro.select(tilt_kind(F.col("bear_risk"), F.col("regime")).alias("kind"))
    tilts = tilts.join(F.broadcast(now), "kind").select("factor", "plus")
    return spec.join(F.broadcast(tilts), "factor", "left").withColumn("factor_weight", F.round(F.col("factor_weight") + F.coalesce("plus", F.lit(0.0)), 4)).drop("plus")


def trend_class(close: Column, ma20: Column, ma50: Column, ret5: Column, ret20: Column) -> Column:
    """DOM2: where the close stands to the 20- and 50-bar averages, with 5- and 20-day returns; n/a before 50 bars."""
    return (
        F.when(ma50.isNull(), "n/a")
        .when((close > ma50) & (close > ma20) & (ret5 > -0.005) & (ret20 > 0), "uptrend")
        .when((close <= ma50) & (close <= ma20) & (ret5 < 0.005) & (ret20 < 0), "downtrend")
        .when((F.abs(ret20) < 0.03) & (F.abs(ret5) < 0.01), "range")
        .otherwise("transitioning")
    )


def setup_class(close: Column, ma20: Column, ma50: Column, hi20: Column, ret5: Column, ret20: Column) -> Column:
    """DOM3: the first that fits; unavailable before 50 bars, unless the bar is a breakout."""
    off = ratio(close, ma50) - 1
    return (
        F.when((close >= hi20) & (ret5 > 0), "breakout")
        .when((close > ma50) & (F.abs(off) < 0.02), "pullback_retest")
        .when((close > ma50) & (close > ma20) & (ret20 > 0), "continuation")
        .when(F.abs(off) < 0.04, "range_approach")
        .when((close < ma50) & (ret5 > 0), "reversal")
        .when(close < ma50, "mean_reversion")
        .otherwise("unavailable")
    )


def sector_fit(beta_class: Column, bear_risk: Column) -> Column:
    """DOM8: defensive sectors fit a bearish regime, cyclical ones the opposite, others neither."""
    return F.when(beta_class == "defensive", bear_risk - 0.5).when(beta_class == "cyclical", 0.5 - bear_risk).otherwise(0.0)


def event_window(days: Column) -> Column:
    """DAT5: how near the next report is: 100 within a week, 70 within three, 30 later, 80 after it; null when unknown."""
    return F.when(days.between(0, 7), 100.0).when(days.between(8, 21), 70.0).when(days < 0, 80.0).when(days.isNotNull(), 30.0)


#: Bars that decide a symbol's features but for its exponential averages, which take all: more than the longest frames one upon another.
ENOUGH_BARS = 640


def price_features(bars: DataFrame, market: DataFrame, least: int = 25, last_only: bool = False, digits: int | None = 9) -> DataFrame:
    """DOM1, first part: the price features of every symbol at every date with a history of least bars.

    Point in time: every frame ends at the row's own bar.  All windows are by
    symbol and date, so one exchange serves them; the market's returns are
    joined by date.  last_only gives each symbol's last bar only: exponential
    averages of all its bars, the rest of its last ENOUGH_BARS.  Features are rounded to digits, unless None.
    """
    w = I.in_order()
    by_day = Window.partitionBy("symbol").orderBy("d")
    m = market.withColumn("mret", ratio(F.col("close"), F.lag("close").over(by_day)) - 1)
    m = m.select(
        "d",
        *((ratio(F.col("close"), F.lag("close", n).over(by_day)) - 1).alias(f"m{n}") for n in (21, 63, 126, 252)),
        F.stddev_samp("mret").over(by_day.rowsBetween(-19, 0)).alias("market_sd"),
    )
    df = I.with_returns(bars).withColumn("rn", F.row_number().over(w))
    prior = I.back("close")
    df = df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior)))
    df = I.with_ewm(I.with_ewm(df, "close", 2 / 13, "fast"), "close", 2 / 27, "slow").withColumn("macd", F.col("fast") - F.col("slow"))
    df = I.with_ewm(df, "macd", 2 / 10, "signal")
    change = F.col("close") - prior
    df = df.withColumn("gain", F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))).withColumn("loss", F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))))
    df = I.with_ewm(I.with_ewm(df, "gain", 1 / 14, "up"), "loss", 1 / 14, "down")
    if last_only:
        df = df.withColumn("end", F.max("rn").over(Window.partitionBy("symbol"))).where(F.col("rn") > F.col("end") - ENOUGH_BARS)
    df = df.withColumn("x", F.col("rn").cast("double")).withColumn("sd20", F.stddev_samp("ret").over(I.last(20)))
    df = df.withColumn("sd", F.round(I.full(F.col("sd20"), 20, "ret"), 9))
    avg = lambda c, n: F.avg(c).over(I.last(n))
    df = df.select(
        "symbol", "d", "close", "rn", "macd", "signal", "up", "down", "sd", *(["end"] if last_only else []),
        I.full(avg("close", 50), 50).alias("ma50"), avg("close", 20).alias("ma20"), avg("close", 200).alias("ma200"),
        F.coalesce(ratio(F.col("close"), I.back("close", 5)) - 1, F.lit(0.0)).alias("ret5"),
        F.coalesce(ratio(F.col("close"), I.back("close", 25)) - 1, F.lit(0.0)).alias("ret20"),
        F.max("close").over(I.last(20)).alias("hi20"),
        F.min("low").over(I.last(20)).alias("support"), F.max("high").over(I.last(20)).alias("resistance"),
        avg("tr", 20).alias("atr"),
        *((ratio(F.col("close"), I.back("close", n)) - 1).alias(f"r{n}") for n in (21, 63, 126, 252)),
        I.full(ratio(F.regr_slope("close", "x").over(I.last(50)), avg("close", 50)), 50).alias("slope_50d"),
        F.when(F.col("rn") >= 31, F.try_divide(F.col("sd20"), F.nullif(F.stddev_samp("ret").over(I.last(252)), F.lit(0.0)))).alias("vol_ratio"),
        F.when(F.col("rn") >= 60, F.collect_list("close").over(I.last(60))).alias("closes"),
        F.when(F.col("rn") >= 61, F.collect_list("sd").over(I.last(252))).alias("seen"),
        F.when(F.col("rn") >= 60, F.min("close").over(I.last(60))).alias("lo60"), F.when(F.col("rn") >= 60, F.max("close").over(I.last(60))).alias("hi60"),
        (F.avg(F.col("volume") * F.col("close")).over(I.last(20)) / 1e6).alias("adv_musd"),
        avg("volume", 5).alias("v5"), avg("volume", 10).alias("v10"), avg("volume", 20).alias("v20"),
        F.lead("close", 20).over(w).alias("ahead"),
    )
    df = df.where((F.col("rn") >= least) & ((F.col("rn") == F.col("end")) if last_only else F.lit(True))).join(m, "d", "left")
    close, atr = F.col("close"), F.col("atr")
    peak = F.struct(F.lit(0.0).alias("peak"), F.lit(None).cast("double").alias("dd"))
    drawdown = F.aggregate("closes", peak, lambda a, c: F.struct(F.greatest(a["peak"], c).alias("peak"), F.least(a["dd"], ratio(c, F.greatest(a["peak"], c)) - 1).alias("dd")), lambda a: a["dd"])
    got = {
        **{f"rs_{k}m": F.col(f"r{n}") - F.col(f"m{n}") for k, n in ((1, 21), (3, 63), (6, 126), (12, 252))},
        "dist_50d": ratio(close, F.col("ma50")) - 1,
        "dist_200d": ratio(close, F.col("ma200")) - 1,
        "rsi": F.when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("up", "down"))),
        "slope_50d": F.col("slope_50d"),
        "macd_hist": F.when(F.col("rn") >= 35, F.col("macd") - F.col("signal")),
        "vol_ratio": F.col("vol_ratio"),
        "atr_less_market": ratio(atr, close) - F.col("market_sd"),
        "max_dd_60d": drawdown,
        "vol_percentile": F.when(F.size("seen") > 0, F.size(F.filter("seen", lambda x: x < F.col("sd"))) / F.size("seen")),
        "range_pctile": F.try_divide(close - F.col("support"), F.nullif(F.col("resistance") - F.col("support"), F.lit(0.0))) * 100,
        "dist_50d_atr": F.try_divide(close - F.col("ma50"), F.nullif(atr, F.lit(0.0))),
        "room_atr": F.try_divide(F.col("resistance") - close, F.nullif(atr, F.lit(0.0))),
        "profile_pos": F.try_divide(close - F.col("lo60"), F.nullif(F.col("hi60") - F.col("lo60"), F.lit(0.0))),
        "adv_musd": F.col("adv_musd"),
        "volume_ratio": F.try_divide(F.col("v5").cast("double"), F.nullif(F.col("v20"), F.lit(0.0))),
        "net_flow": F.col("ret5") * F.coalesce(F.try_divide(F.col("v10"), F.nullif(F.col("v20"), F.lit(0.0))), F.lit(1.0)) * 100,
    }
    return df.select(
        "symbol", "d", "rn", "close", (ratio(F.col("ahead"), close) - 1).alias("fwd20"),
        trend_class(close, F.col("ma20"), F.col("ma50"), F.col("ret5"), F.col("ret20")).alias("trend"),
        setup_class(close, F.col("ma20"), F.col("ma50"), F.col("hi20"), F.col("ret5"), F.col("ret20")).alias("setup"),
        *((got[f] if digits is None else F.round(got[f], digits)).alias(f) for f in PRICE_FIELDS),
    )


def company_features(rows: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """DOM1, second part: rows(symbol, close, ...) with ratios, estimates and positions; multiples that are not positive are missing."""
    f = fundamentals
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    f = f.select(
        "symbol", *(positive(c).alias(c) for c in ("trailing_pe", "forward_pe", "peg_ratio", "price_to_book", "price_to_sales", "ev_to_ebitda")),
        "roe", "roa", "operating_margin", "profit_margin", "revenue_growth", "earnings_growth",
        (F.col("debt_to_equity") / 100).alias("debt_to_equity"),
        F.when(F.col("net_income") > 0, F.try_divide("operating_cashflow", "net_income")).alias("cash_conversion"),
        F.when(F.col("market_cap") > 0, F.try_divide("free_cashflow", "market_cap")).alias("fcf_yield"),
        positive("eps").alias("_eps"), F.col("target").alias("_target"),
        "analyst_rating", "analyst_coverage", "short_float", "institutions", "insiders",
    )
    df = rows.join(f, "symbol", "left")
    df = df.withColumn("earnings_yield", ratio(F.col("_eps"), F.col("close"))).withColumn("target_upside", F.when(F.col("_target") != 0, ratio(F.col("_target"), F.col("close")) - 1))
    return df.select(*rows.columns, *(F.round(F.col(c).cast("double"), 9).alias(c) for c in COMPANY_FIELDS))


def macro_features(rows: DataFrame, sectors: DataFrame, macro: DataFrame) -> DataFrame:
    """JOI4: rows with the one macro state (macro_score, bear_risk, regime_confidence, credit_score) and the fit of each symbol's sector(symbol, beta_class)."""
    df = rows.join(sectors.select("symbol", "beta_class"), "symbol", "left").join(F.broadcast(macro))  # macro has one row
    fit = sector_fit(F.coalesce("beta_class", F.lit("neutral")), F.col("bear_risk"))
    stress = F.greatest(F.lit(0.0), -F.col("credit_score"))
    return df.select(*rows.columns, *(F.round(c, 9).alias(n) for c, n in ((F.col("macro_score"), "macro_score"), (F.col("bear_risk"), "bear_risk"), (F.col("regime_confidence"), "regime_confidence"), (fit, "sector_fit"), (stress, "credit_stress"))))


def with_signals(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """JOI3: rows with what signals(symbol, ...) knows of the event fields; a field without a signal stays as it is, others are ignored."""
    known = [c for c in signals.columns if c in EVENT_FIELDS]
    s = signals.select("symbol", *(F.col(c).cast("double").alias(f"_{c}") for c in known))
    df = rows.join(s, "symbol", "left")
    for c in known:
        df = df.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c) if c in rows.columns else F.lit(None).cast("double")))
    return df.drop(*(f"_{c}" for c in known))


def complete(rows: DataFrame) -> DataFrame:
    """rows with every field of the rank; those that are not there are null."""
    return rows.select("symbol", "d", "rn", "close", "fwd20", "trend", "setup", *(F.col(f).cast("double").alias(f) if f in rows.columns else F.lit(None).cast("double").alias(f) for f in FIELDS))


def submetric_scores(rows: DataFrame, spec: DataFrame, setups: DataFrame, legacy_missing: bool = False) -> DataFrame:
    """DOM4: (variant, d, symbol, factor, factor_weight, sub_metric, weight, score) for each specification row.

    Features are turned into rows and meet the broadcast specification; ranks
    are taken inside a date over the values that are there.  A missing value
    has no score and counts neither for nor against (with legacy_missing it is
    ranked as 0); a sub-metric that no symbol of a date has is left out.
    """
    # trend, setup and return go along, so that the features are made once
    ids = ["symbol", "d", "trend", "setup", "fwd20"]
    long = rows.select(*ids, *FIELDS, F.lit(1.0).alias("setup_")).unpivot(ids, [*FIELDS, "setup_"], "field", "value")
    long = long.withColumn("field", F.when(F.col("field") == "setup_", "setup").otherwise(F.col("field")))
    cross = Window.partitionBy("d", "field")
    long = long.withColumn("known", F.count("value").over(cross)).where("known > 0")
    if legacy_missing:
        long = long.withColumn("up", F.coalesce("value", F.lit(0.0)))
    else:
        long = long.withColumn("up", F.col("value"))
    long = long.withColumn("pct", I.percentile_rank("up", "d", "field")).withColumn("pct_down", 100 - F.col("pct"))
    v, low, high, below, above = (F.col(c) for c in ("value", "low", "high", "below", "above"))
    under = F.when(below.isNull() | (below >= low), 50.0).otherwise(F.greatest(100 * F.try_divide(v - below, low - below), F.lit(0.0)))
    over = F.when(above.isNull() | (above <= high), 50.0).otherwise(F.greatest(100 * F.try_divide(above - v, above - high), F.lit(0.0)))
    sweet = F.when(v.isNull(), None).when(v.between(low, high), 100.0).when(v < low, under).otherwise(over)
    kind = F.col("kind")
    score = F.when(kind == "higher", F.col("pct")).when(kind == "lower", F.col("pct_down")).when(kind == "sweet", sweet)
    out = long.join(F.broadcast(spec), "field").join(F.broadcast(setups), ["variant", "setup"], "left")  # the setup is a name: its score is looked up
    score = F.when(kind == "lookup", F.coalesce("setup_score", F.lit(50.0))).otherwise(score)
    out = out.withColumn("score", F.when(score.isNotNull(), F.greatest(score, F.coalesce("floor", score))))
    return out.select("variant", *ids, "factor", "factor_weight", "sub_metric", "weight", "score")


def factor_scores(scores: DataFrame) -> DataFrame:
    """AGG9: the weighted mean of a factor's scores that are there; 50 if none is."""
    there = F.when(F.col("score").isNotNull(), F.col("weight"))
    mean = F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum(there)), F.lit(50.0))
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "factor", "sub_metric").alias("k"), F.round("score", 6).alias("s")))))
    return scores.groupBy("variant", "d", "symbol", "trend", "setup", "fwd20", "factor", "factor_weight").agg(mean.alias("factor_score"), parts.alias("parts"))


def composite(factors: DataFrame) -> DataFrame:
    """AGG10: the weighted mean of the factors, with the map of what went into it."""
    return factors.groupBy("variant", "d", "symbol", "trend", "setup", "fwd20").agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.col("factor_weight") * F.col("factor_score")), F.sum("factor_weight")), F.lit(50.0)), 6).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", F.round("factor_score", 6).alias("s"))))).alias("factors"),
        F.aggregate(F.collect_list("parts"), F.expr("cast(map() as map<string,double>)"), lambda a, x: F.map_concat(a, x)).alias("breakdown"),
    )


def label(score: Column, trend: Column, setup: Column, need_trend: str = "any", need_setups: tuple[str, ...] = ()) -> Column:
    """DOM6: Research candidate from 70 (in the trend and setups asked for, if any), Avoid up to 30 in a downtrend, else Watchlist."""
    fits = (F.lit(True) if need_trend == "any" else trend == need_trend) & (setup.isin(*need_setups) if need_setups else F.lit(True))
    return F.when((score >= R.CANDIDATE_MIN) & fits, "Research candidate").when((score <= R.AVOID_MAX) & (trend == "downtrend"), "Avoid").otherwise("Watchlist")


def rank(rows: DataFrame, spec: DataFrame, setups: DataFrame) -> DataFrame:
    """DOM5: score, place and label of every symbol in each cross-section (variant, d) of complete feature rows."""
    got = composite(factor_scores(submetric_scores(rows, spec, setups)))
    place = F.row_number().over(Window.partitionBy("variant", "d").orderBy(F.desc("score"), "symbol"))
    return got.withColumn("place", place).withColumn("label", label(F.col("score"), F.col("trend"), F.col("setup")))


def latest(rows: DataFrame) -> DataFrame:
    """Each symbol's last bar, all set to the latest date of any, as one cross-section."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    last = rows.withColumn("_n", F.row_number().over(down)).where("_n = 1").drop("_n")
    return last.join(F.broadcast(last.agg(F.max("d").alias("_d")))).withColumn("d", F.col("_d")).drop("_d")


def rebalance_rows(rows: DataFrame, start: int = 60, step: int = 5) -> DataFrame:
    """Feature rows at every step-th date behind the first start, where the forward return is known."""
    days = rows.groupBy("d").agg(F.count("*").alias("n"))
    # dates are few (a row a day), so one ordered pass over them is small
    order = days.withColumn("i", F.row_number().over(Window.orderBy("d"))).where((F.col("i") > start) & ((F.col("i") - 1 - start) % step == 0)).select("d")
    return rows.join(F.broadcast(order), "d").where("fwd20 is not null")


def backtest(ranked: DataFrame, least: int = 5) -> DataFrame:
    """DOM9, JOI15, AGG11, AGG12: for each rebalance and variant of ranked rows the Spearman IC of score and forward return, quartile and half means and their spreads.

    All dates at once: ranks are windows inside a date, not a loop over dates;
    a date with fewer than least pairs is left out.
    """
    got = ranked.select("variant", "d", "symbol", F.round("score", 1).alias("score"), F.round("fwd20", 9).alias("fwd")).where("fwd is not null")
    cross = Window.partitionBy("variant", "d")
    got = got.withColumn("rs", I.percentile_rank("score", "variant", "d")).withColumn("rf", I.percentile_rank("fwd", "variant", "d"))
    got = got.withColumn("n", F.count("*").over(cross)).withColumn("up", F.row_number().over(cross.orderBy(F.desc("score"), "symbol")))
    q, half = F.greatest(F.floor(F.col("n") / 4), F.lit(1)), F.floor(F.col("n") / 2)
    mean = lambda cond: F.avg(F.when(cond, F.col("fwd")))
    per = got.groupBy("variant", "d").agg(
        F.count("*").alias("n"),
        F.try_divide(F.covar_pop("rs", "rf"), F.nullif(F.stddev_pop("rs") * F.stddev_pop("rf"), F.lit(0.0))).alias("ic"),
        mean(F.col("up") <= q).alias("top"),
        mean(F.col("up") > F.col("n") - q).alias("bottom"),
        mean(F.col("up") <= half).alias("upper"),
        mean(F.col("up") > F.col("n") - half).alias("lower"),
    )
    per = per.where(F.col("n") >= least)
    cols = {"ic": F.col("ic"), "top": F.col("top"), "bottom": F.col("bottom"), "spread": F.col("top") - F.col("bottom"), "half_spread": F.col("upper") - F.col("lower")}
    return per.select("variant", "d", "n", *(F.round(c, 6).alias(k) for k, c in cols.items()))


def backtest_summary(per: DataFrame) -> DataFrame:
    """AGG13: mean, deviation, t value and share of positive values of IC and spread by variant."""
    def four(c: str) -> list[Column]:
        mean, sd, n = F.avg(c), F.stddev_pop(c), F.count(c)
        t = F.try_divide(mean, F.nullif(sd, F.lit(0.0))) * F.sqrt(n)
        return [F.round(mean, 5).alias(f"{c}_mean"), F.round(sd, 5).alias(f"{c}_sd"), F.round(t, 4).alias(f"{c}_t"), F.round(F.avg(F.when(F.col(c) > 0, 1.0).when(F.col(c).isNotNull(), 0.0)) * 100, 4).alias(f"{c}_win")]

    return per.groupBy("variant").agg(F.count("*").alias("n"), *four("ic"), *four("spread"))


LABELS = ("Research candidate", "Watchlist", "Avoid")


def symbol_summary(ranked: DataFrame) -> DataFrame:
    """AGG14: mean score and forward return of each symbol, with counts by label."""
    counts = [F.count_if(F.col("label") == x).alias(f"n_{x.split()[0].lower()}") for x in LABELS]
    return ranked.groupBy("variant", "symbol").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("score_mean"), F.round(F.avg("fwd20"), 6).alias("fwd_mean"), *counts)


def top_by_sector(ranked: DataFrame, sectors: DataFrame, n: int = 3) -> DataFrame:
    """TOP1, JOI24: the n best of each sector with place and number of candidates."""
    got = ranked.join(F.broadcast(sectors), "symbol")
    by = Window.partitionBy("variant", "sector")
    return got.withColumn("in_sector", F.row_number().over(by.orderBy(F.desc("score"), "symbol"))).withColumn("candidates", F.count("*").over(by)).where(F.col("in_sector") <= n).select("variant", "sector", "symbol", "score", "in_sector", "candidates")


def with_sector(rows: DataFrame, sectors: DataFrame, fallback: tuple[str, str] = ("SPY", "Other")) -> DataFrame:
    """JOI2: rows with etf and sector of sectors(symbol, etf, sector_name); unknown symbols have the fallback."""
    return rows.join(sectors.select("symbol", "etf", "sector_name"), "symbol", "left").withColumn("etf", F.coalesce("etf", F.lit(fallback[0]))).withColumn("sector_name", F.coalesce("sector_name", F.lit(fallback[1])))


def z_scores(rows: DataFrame, field: str, clip: float = 2.0) -> DataFrame:
    """AGG7: z score of a field inside each date, clipped; 0 where it is missing or all are alike."""
    by = Window.partitionBy("d")
    sd = F.stddev_pop(field).over(by)
    z = F.try_divide(F.col(field) - F.avg(field).over(by), F.nullif(sd, F.lit(0.0)))
    return rows.select("symbol", "d", F.round(F.coalesce(F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)), F.lit(0.0)), 5).alias("z"))


def outlook(trend: Column, setup: Column) -> Column:
    """What the trend and the setup say together."""
    up = F.when(setup == "breakout", "trend extension").when(setup == "pullback_retest", "pullback in an uptrend").when(setup == "continuation", "trend continuation").otherwise("uptrend without a trigger")
    down = F.when(setup == "reversal", "bounce in a downtrend").otherwise("downtrend intact")
    return F.when(trend == "uptrend", up).when(trend == "downtrend", down).when(trend == "range", "consolidation").otherwise("transition")


def dashboard(bars: DataFrame, market: DataFrame, least: int = 50) -> DataFrame:
    """DOM11: the metric table of each symbol's last bar with trend by the 50-bar average's slope, setup, label and outlook; symbols with fewer than least bars are left out."""
    w = I.in_order()
    df = I.with_returns(bars).withColumn("rn", F.row_number().over(w)).withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))))
    prior = I.back("close")
    df = df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior)))
    df = df.withColumn("ma50", F.avg("close").over(I.last(50))).withColumn("was", F.when(F.col("rn") - 9 >= 50, I.back("ma50", 9)).otherwise(F.col("ma50")))
    df = df.select(
        "symbol", "d", "close", "rn", "age", "ma50", (F.col("ma50") - F.col("was")).alias("slope"), F.avg("close").over(I.last(20)).alias("ma20"), F.max("close").over(I.last(20)).alias("hi20"),
        F.min("low").over(I.last(20)).alias("support"), F.max("high").over(I.last(20)).alias("resistance"), (ratio(F.col("close"), I.back("close", 5)) - 1).alias("ret5"), (ratio(F.col("close"), I.back("close", 25)) - 1).alias("ret20"),
        F.stddev_samp("ret").over(I.last(20)).alias("sd20"), F.stddev_samp("close").over(Window.partitionBy("symbol")).alias("sd_close"), F.avg("tr").over(I.last(20)).alias("atr"),
        (F.avg(F.col("close") * F.col("volume")).over(I.last(20)) / 1e6).alias("adv_musd"),
    ).where((F.col("age") == 1) & (F.col("rn") >= least))
    m = market.select("d", (ratio(F.col("close"), F.lag("close", 25).over(Window.partitionBy("symbol").orderBy("d"))) - 1).alias("m20"))
    df = df.join(m, "d", "left").withColumn("rs", F.col("ret20") - F.col("m20"))
    close, slope = F.col("close"), F.col("slope")
    trend = F.when((close > F.col("ma50")) & (slope > 0), "uptrend").when((close < F.col("ma50")) & (slope < 0), "downtrend").when(F.abs(slope) < F.col("sd_close") * 0.001, "range").otherwise("transitioning")
    df = df.withColumn("trend", trend).withColumn("setup", setup_class(close, F.col("ma20"), F.col("ma50"), F.col("hi20"), F.col("ret5"), F.col("ret20")))
    df = df.withColumn("range_pctile", F.try_divide(close - F.col("support"), F.nullif(F.col("resistance") - F.col("support"), F.lit(0.0))) * 100)
    good = (F.col("trend") == "uptrend") & F.col("setup").isin("breakout", "pullback_retest") & (F.coalesce("range_pctile", F.lit(30.0)) >= 30) & (F.coalesce("rs", F.lit(0.0)) >= 0)
    df = df.withColumn("label", F.when(good, LABELS[0]).when((F.col("trend") == "downtrend") & (F.col("rs") < -0.05), LABELS[2]).otherwise(LABELS[1]))
    return df.select("*", (ratio(close, F.col("support")) - 1).alias("to_support"), (ratio(F.col("resistance"), close) - 1).alias("to_resistance"), (F.col("sd20") * F.sqrt(F.lit(252.0))).alias("vol_annual"), outlook(F.col("trend"), F.col("setup")).alias("outlook"))


def table_order(board: DataFrame) -> DataFrame:
    """TOP6: place in the report's table: candidates first, then by strength against the market (unknown or none last). The table has a row a symbol."""
    first = F.when(F.col("label") == LABELS[0], 0).when(F.col("label") == LABELS[1], 1).otherwise(2)
    strength = F.coalesce(F.nullif(F.round("rs", 9), F.lit(0.0)), F.lit(-999.0))
    return board.withColumn("place", F.row_number().over(Window.orderBy(first, strength.desc(), "symbol")))
