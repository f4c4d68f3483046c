"""Macro series, pillars and the regime posterior; positions and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from . import indicators as I


def series_order() -> WindowSpec:
    """The rows of each series by date."""
    return Window.partitionBy("series_id").orderBy("d")


def series_features(series: DataFrame) -> DataFrame:
    """WIN27, AGG8: distance from the 200-row average, change over 3 rows and a year back by rows (252), and the z score in the series' history so far, clipped to 3."""
    v = F.col("value")
    frame = series_order().rowsBetween(-199, 0)
    past = series_order().rowsBetween(Window.unboundedPreceding, 0)
    z = F.when(F.stddev_pop("value").over(past) > 0, (v - F.avg("value").over(past)) / F.stddev_pop("value").over(past)).otherwise(0.0)
    ma = F.when(F.count("value").over(frame) == 200, F.avg("value").over(frame))
    return series.select("series_id", "d", F.round(v / ma - 1, 6).alias("ma_distance"), F.round(v / F.lag("value", 3).over(series_order()) - 1, 6).alias("change3"), F.round(v / F.lag("value", 252).over(series_order()) - 1, 6).alias("yoy"), F.round(F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0)), 5).alias("z"))


def arrow(delta: F.Column, scale: float) -> F.Column:
    """MTH1: five steps from strongly down to strongly up."""
    x = delta / scale
    return F.when(x >= 1, "++").when(x >= 0.3, "+").when(x > -0.3, "=").when(x > -1, "-").otherwise("--")


def pillars(features: DataFrame) -> DataFrame:
    """DOM30: by series (a pillar each) the mean of its components, each clamped to -1..1, at its last row; missing components are left out."""
    down = Window.partitionBy("series_id").orderBy(F.desc("d"))
    last = features.withColumn("_n", F.row_number().over(down)).where("_n = 1")
    parts = {"z": 2.0, "change3": 0.5, "yoy": 0.5, "ma_distance": 0.5}
    long = last.select("series_id", F.explode(F.array(*(F.struct(F.lit(k).alias("component"), F.greatest(F.least(F.col(k) / s, F.lit(1.0)), F.lit(-1.0)).alias("x")) for k, s in parts.items()))).alias("c")).select("series_id", "c.*")
    return long.groupBy("series_id").agg(F.round(F.avg("x"), 6).alias("score"), F.count("x").alias("n"), F.sum(F.col("x").isNull().cast("int")).alias("missing"))


def regime_posterior(scores: DataFrame) -> DataFrame:
    """DOM31, MTH10: softmax over five regimes of the pillars' mean, with the confidence (1 - entropy over its largest)."""
    centres = {"stress": -0.8, "slowdown": -0.4, "neutral": 0.0, "recovery": 0.4, "boom": 0.8}
    mean = scores.agg(F.avg("score").alias("m"))
    rows = mean.select("m", F.explode(F.array(*(F.struct(F.lit(k).alias("regime"), F.lit(c).alias("c")) for k, c in centres.items()))).alias("r")).select("m", "r.*")
    rows = rows.withColumn("e", F.exp(-F.pow(F.col("m") - F.col("c"), 2) * 4))
    # five rows: the window has no more
    rows = rows.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("m")))
    h = -F.sum(F.col("p") * F.log("p")).over(Window.partitionBy("m")) / F.log(F.lit(5.0))
    return rows.select("regime", F.round("p", 6).alias("p"), F.round(1 - h, 6).alias("confidence"))


def position_changes(holdings: DataFrame) -> DataFrame:
    """DOM37: positions of two neighbouring periods side by side: new, increased, decreased, kept or exited."""
    a = holdings.where("period = 1").select("filer", "cusip", "put_call", F.col("shares").alias("before"))
    b = holdings.where("period = 2").select("filer", "cusip", "put_call", F.col("shares").alias("after"))
    got = a.join(b, ["filer", "cusip", "put_call"], "full")
    x, y = F.col("before"), F.col("after")
    return got.withColumn("change", F.when(x.isNull(), "new").when(y.isNull(), "exit").when(y > x, "increase").when(y < x, "decrease").otherwise("same"))


def holdings_summary(holdings: DataFrame) -> DataFrame:
    """AGG23: by filer and period the total, counts by kind and the largest position (the smallest cusip of equals)."""
    return holdings.groupBy("filer", "period").agg(F.sum("value_usd").alias("total"), *(F.count_if(F.col("put_call") == k).alias(f"n_{k.lower()}") for k in ("PUT", "CALL", "LONG")), F.max_by("cusip", F.struct("value_usd", (-F.col("cusip")).alias("c"))).alias("top_cusip"))


def positioning(fundamentals: DataFrame) -> DataFrame:
    """DOM34: short interest, ownership and analyst scores with classes, and their weighted sum (-0.3, 0.2, 0.5) over those that are there."""
    s = F.when(F.col("short_float").isNotNull(), F.greatest(F.least(F.col("short_float") * 2 - 0.5, F.lit(1.0)), F.lit(-1.0)))
    o = F.when(F.col("institutions").isNotNull(), F.greatest(F.least(F.col("institutions") * 4 - 1, F.lit(1.0)), F.lit(-1.0)))
    a = F.when(F.col("rating").isNotNull(), F.greatest(F.least((3 - F.col("rating")) / 2, F.lit(1.0)), F.lit(-1.0)))
    weight = sum((F.when(x.isNotNull(), F.lit(abs(w))).otherwise(0.0) for x, w in ((s, 0.3), (o, 0.2), (a, 0.5))), F.lit(0.0))
    total = F.coalesce(s * -0.3, F.lit(0.0)) + F.coalesce(o * 0.2, F.lit(0.0)) + F.coalesce(a * 0.5, F.lit(0.0))
    return fundamentals.select("symbol", F.round(s, 6).alias("short_score"), F.round(o, 6).alias("owner_score"), F.round(a, 6).alias("analyst_score"), F.round(F.when(weight > 0, total / weight), 6).alias("flow"))


def volatility_states(bars: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """DOM33: Gaussian mixture states of regime features, numbered by mean volatility, with how long the state has lasted.

    A mixture, not a hidden Markov chain: transitions are counted afterwards.  A
    bar whose window has an infinite or undefined return, as around a close of
    0, has no volatility: it stays, but takes no part in the fit and has no state.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    columns = ["rv", "moved"]
    known = F.lit(True)
    for c in columns:
        known = known & (F.abs(c) < float("inf"))  # NaN is above all numbers
    rows = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep").transform(I.regime_features(bars))
    rows = StandardScaler(inputCol="raw", outputCol="features").fit(rows.where(known)).transform(rows)
    got = GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows.where(known)).transform(rows)
    order = got.where(known).groupBy("prediction").agg(F.avg("rv").alias("mean_rv")).withColumn("state", F.row_number().over(Window.orderBy("mean_rv")) - 1)  # k rows
    return I.run_lengths(got.join(F.broadcast(order), "prediction", "left").select("symbol", "d", "rv", F.when(known, F.col("state")).alias("state")), "state")


def transitions(states: DataFrame) -> DataFrame:
    """The transition shares between states of neighbouring bars of a symbol that have one."""
    pairs = states.select(F.lag("state").over(I.in_order()).alias("from"), F.col("state").alias("to")).where("`from` is not null and `to` is not null")
    n = pairs.groupBy("from", "to").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from")), 6))
