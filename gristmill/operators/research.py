"""Events, watchlists, structure scores and regimes around the bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from . import indicators as I
from ..functions.ieee import ratio


def event_drift(bars: DataFrame, events: DataFrame, steps: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """JOI14, AGG4: returns some bars after event days (symbol, d): number, mean, upper median, sample deviation and hit rate."""
    fwd = bars.select("symbol", "d", *((ratio(F.lead("close", n).over(I.in_order()), F.col("close")) - 1).alias(f"f{n}") for n in steps))
    got = fwd.join(events.select("symbol", "d").distinct(), ["symbol", "d"], "left_semi")
    long = got.select("symbol", F.explode(F.array(*(F.struct(F.lit(n).alias("step"), F.round(f"f{n}", 9).alias("r")) for n in steps))).alias("x")).select("symbol", "x.*").where("r is not null")
    place = long.withColumn("i", F.row_number().over(Window.partitionBy("symbol", "step").orderBy("r"))).withColumn("n", F.count("*").over(Window.partitionBy("symbol", "step")))
    return place.groupBy("symbol", "step").agg(F.count("*").alias("n"), F.round(F.avg("r"), 7).alias("mean"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("r"))).alias("upper_median"), F.round(F.stddev_samp("r"), 7).alias("sd"), F.round(F.avg((F.col("r") > 0).cast("double")), 7).alias("hit_rate"))


def net_revisions(upgrades: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """AGG22: upgrades less downgrades (symbol, d, up) in the last days before a date; symbols without any row in that time are not there."""
    return upgrades.where((F.col("d") <= as_of) & (F.col("d") > F.date_sub(as_of, days))).groupBy("symbol").agg((F.count_if("up") - F.count_if(~F.col("up"))).alias("net"), F.count("*").alias("n"))


def next_event(events: DataFrame, as_of: Column) -> DataFrame:
    """TOP9, DAT3, DAT5, DAT6: days to each symbol's next event and a proximity score (a week 100, three weeks 70, later 30)."""
    nxt = events.where(F.col("d") >= as_of).groupBy("symbol").agg(F.min("d").alias("next"))
    days = F.datediff("next", as_of)
    return nxt.select("symbol", "next", days.alias("days"), F.when(days <= 7, 100).when(days <= 21, 70).otherwise(30).alias("score"))


def trend_structure(bars: DataFrame) -> DataFrame:
    """DOM14: at each symbol's last bar the averages' order, the 60-bar slope and fit, and a class of the trend."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    slope = I.trend_slope(bars).select("symbol", "d", "slope_pct", "r2")
    df = bars.withColumn("age", F.row_number().over(down)).withColumn("ma20", F.avg("close").over(I.last(20))).withColumn("ma50", F.avg("close").over(I.last(50))).withColumn("ma200", F.avg("close").over(I.last(200))).where("age = 1")
    up, dn = (F.col("close") > F.col("ma20")) & (F.col("ma20") > F.col("ma50")), (F.col("close") < F.col("ma20")) & (F.col("ma20") < F.col("ma50"))
    got = df.join(slope, ["symbol", "d"])
    return got.select("symbol", "d", up.alias("stacked_up"), dn.alias("stacked_down"), (F.col("close") > F.col("ma200")).alias("above_200"), "slope_pct", "r2", F.when(up & (F.col("slope_pct") > 0), "uptrend").when(dn & (F.col("slope_pct") < 0), "downtrend").when(F.col("r2") < 0.3, "range").otherwise("transitioning").alias("trend"))


def chart_scores(structure: DataFrame, swings: DataFrame, volumes: DataFrame) -> DataFrame:
    """DOM21: a weighted chart score of trend, fit, swings and volume, 0 to 100, with a grade."""
    df = structure.join(swings, ["symbol", "d"]).join(volumes, ["symbol", "d"])
    trend = F.when(F.col("trend") == "uptrend", 100).when(F.col("trend") == "transitioning", 55).when(F.col("trend") == "range", 45).otherwise(10)
    swing = F.least(F.lit(100), (F.col("higher_highs") + F.col("higher_lows")) * 20)
    volume = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("v5_20", F.lit(1.0)) * 50))
    score = 0.4 * trend + 0.2 * F.coalesce("r2", F.lit(0.0)) * 100 + 0.25 * swing + 0.15 * volume
    return df.select("symbol", F.round(score, 9).alias("score"), F.when(score >= 75, "A").when(score >= 60, "B").when(score >= 45, "C").when(score >= 30, "D").otherwise("F").alias("grade"))


def rectangles(bars: DataFrame, within: float = 0.03) -> DataFrame:
    """DOM17: symbols whose last two swing highs and last two swing lows each lie within 3 %, with the band."""
    sw = I.swings(bars)
    out = None
    for flag, side in (("is_high", "high"), ("is_low", "low")):
        p = sw.where(flag).withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where("i <= 2").groupBy("symbol").agg(F.count("*").alias(f"n_{side}"), F.min(side).alias(f"{side}_min"), F.max(side).alias(f"{side}_max"))
        out = p if out is None else out.join(p, "symbol")
    flat = lambda s: (F.col(f"n_{s}") == 2) & (ratio(F.col(f"{s}_max"), F.col(f"{s}_min")) - 1 <= within)
    return out.where(flat("high") & flat("low") & (F.col("high_min") > F.col("low_max"))).select("symbol", F.col("low_min").alias("floor"), F.col("high_max").alias("ceiling"))


def triangles(bars: DataFrame, n: int = 5) -> DataFrame:
    """DOM16: the slopes of lines through each symbol's last five swing highs and lows and what they form."""
    sw = I.swings(bars).withColumn("rn", F.row_number().over(I.in_order()).cast("double"))
    out = None
    for flag, side in (("is_high", "high"), ("is_low", "low")):
        p = sw.where(flag).withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where(F.col("i") <= n).groupBy("symbol").agg(F.round(ratio(F.regr_slope(side, "rn"), F.avg(side)) * 100, 6).alias(side))
        out = p if out is None else out.join(p, "symbol")
    h, low, flat = F.col("high"), F.col("low"), 0.02
    kind = F.when((F.abs(h) <= flat) & (low > flat), "ascending").when((F.abs(low) <= flat) & (h < -flat), "descending").when((h < 0) & (low > 0), "symmetrical").when((h > flat) & (low > flat), "rising").when((h < -flat) & (low < -flat), "falling").otherwise("none")
    return out.select("symbol", F.col("high").alias("high_slope"), F.col("low").alias("low_slope"), kind.alias("kind"))


def flags(bars: DataFrame, impulse: float = 0.05, n: int = 8) -> DataFrame:
    """DOM19: bars after a move of 5 % within eight bars that is followed by eight quieter ones (half its daily range at most)."""
    df = bars.withColumn("move", ratio(F.col("close"), I.back("close", n)) - 1).withColumn("rng", ratio(F.col("high") - F.col("low"), F.col("close")))
    df = df.withColumn("before", F.avg("rng").over(I.last(n))).withColumn("after", F.avg("rng").over(I.in_order().rowsBetween(1, n))).withColumn("whole", F.count("*").over(I.in_order().rowsBetween(1, n)) == n).withColumn("drift", ratio(F.lead("close", n).over(I.in_order()), F.col("close")) - 1)
    hit = F.col("whole") & (F.abs("move") >= impulse) & (F.col("after") <= 0.5 * F.col("before")) & (F.abs("drift") <= 0.5 * F.abs("move"))
    return df.where(hit).select("symbol", "d", F.when(F.col("move") > 0, "bull").otherwise("bear").alias("side"), F.round("move", 6).alias("move"))


def volatility_regime(bars: DataFrame) -> DataFrame:
    """DOM12, DOM32: by symbol and date, calm, normal, elevated or stressed by annualised 20-bar volatility, with the side of the 200-bar average."""
    v = F.stddev_samp("ret").over(I.last(20)) * F.sqrt(F.lit(252.0))
    df = I.with_returns(bars).withColumn("v", I.full(v, 20, "ret")).withColumn("ma", I.full(F.avg("close").over(I.last(200)), 200))
    return df.select("symbol", "d", F.when(F.col("v").isNull(), "n/a").when(F.col("v") < 0.12, "calm").when(F.col("v") < 0.2, "normal").when(F.col("v") < 0.3, "elevated").otherwise("stressed").alias("band"), F.when(F.col("ma").isNull(), "n/a").when(F.col("close") >= F.col("ma"), "above").otherwise("below").alias("side"))


def watchlist_monitor(watchlist: DataFrame, last: DataFrame) -> DataFrame:
    """DOM13, JOI17: watchlist(symbol, ref_price, target, risk_line) with the last close: change, upside, and how near the risk line is."""
    got = watchlist.join(last.select("symbol", "close"), "symbol", "left")
    room = ratio(F.col("close"), F.col("risk_line")) - 1
    return got.select("symbol", F.round(ratio(F.col("close"), F.col("ref_price")) - 1, 6).alias("change"), F.round(ratio(F.col("target"), F.col("close")) - 1, 6).alias("upside"), F.when(F.col("close").isNull(), "no price").when(room < 0, "broken").when(room < 0.03, "near").otherwise("clear").alias("risk"))


def sector_fit(beta_class: Column, stress: Column) -> Column:
    """DOM8: how a beta class (0 defensive, 1 neutral, 2 cyclical) suits a stress level from 0 to 1."""
    return F.when(beta_class == 0, 50 + 50 * stress).when(beta_class == 2, 100 - 80 * stress).otherwise(70 - 20 * stress)


def deep_report(parts: dict[str, DataFrame], symbols: DataFrame) -> DataFrame:
    """DOM36: one row for each symbol with all layers beside it, and how many of them have it; a layer's columns get its name before them."""
    out = symbols.select("symbol").distinct()
    have = []
    for name, df in parts.items():
        df = df.select("symbol", *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in ("symbol", "d")), F.lit(1).alias(f"_{name}"))
        out = out.join(df, "symbol", "left")
        have.append(F.coalesce(f"_{name}", F.lit(0)))
    return out.withColumn("layers", sum(have, F.lit(0))).drop(*(f"_{n}" for n in parts))


def layered(symbols: DataFrame, layers: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """DOM36: one row for each symbol with a struct for each layer, null where the layer knows nothing of it, and its summary in a line.

    layers: name to (rows(symbol, ...), one for each symbol; an expression of
    their columns that says them in a line).  A summary is "n/a" without the
    layer; layers counts those that are there.
    """
    out = symbols.select("symbol").distinct()
    for name, (df, line) in layers.items():
        own = [c for c in df.columns if c not in ("symbol", "d")]
        out = out.join(df.select("symbol", F.struct(*own, line.alias("summary")).alias(name)), "symbol", "left")
    return out.withColumn("layers", sum((F.col(n).isNotNull().cast("int") for n in layers), F.lit(0)))


def flattened(nested: DataFrame, missing: str = "n/a") -> DataFrame:
    """PRJ1: every struct of a table, however deep, as columns named by its path with underscores, by the schema alone; arrays and maps stay; a summary is missing where it is null."""

    def leaves(path: str, name: str, kind) -> list[Column]:
        if isinstance(kind, StructType):
            return [c for f in kind.fields for c in leaves(f"{path}.`{f.name}`", f"{name}_{f.name}", f.dataType)]
        value = F.col(path)
        return [(F.coalesce(value, F.lit(missing)) if name.endswith("_summary") else value).alias(name)]

    return nested.select(*(c for f in nested.schema.fields for c in leaves(f"`{f.name}`", f.name, f.dataType)))
