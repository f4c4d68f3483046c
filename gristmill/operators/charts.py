"""Chart patterns with their state at each symbol's last bar: neckline, trigger, stop, target and volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import indicators as I
from ..functions.ieee import ratio

# Separations (bars, days), tolerances and factors of the detectors.
DOUBLE_SEPARATION, DOUBLE_TOLERANCE, DOUBLE_BACK = 10, 0.03, 120
HEAD_SEPARATION, HEAD_TOLERANCE, HEAD_DAYS, HEAD_BACK = 10, 0.05, 30, 180
BREAK, VOLUME = 0.005, 1.2
#: Bars ahead of an as-of bar over which returns are taken: one, two and four weeks.
AHEAD = (5, 10, 20)


#: Bars on either side of a swing, so that it is known as many bars later.
KNOWN_AFTER = 5
#: Bars in a block, by which patterns meet the as-of bars at which they are in sight.
SIGHT_BLOCK = 64


def frame(bars: DataFrame) -> DataFrame:
    """Every bar with what the detectors ask of it: number, swings, volume ratios, deviations of returns, and its last bars.

    All windows are partitioned by symbol and ordered by date: one exchange and
    one sort, whatever a detector takes of it.
    """
    so_far = I.in_order().rowsBetween(Window.unboundedPreceding, 0)
    v5, v20 = F.avg("volume").over(I.last(5)), F.avg("volume").over(I.last(20))
    df = I.with_returns(I.swings(bars, KNOWN_AFTER)).withColumn("rn", F.row_number().over(I.in_order()))
    return df.select(
        "*",
        F.count("*").over(Window.partitionBy("symbol")).alias("bars"),
        F.try_divide(F.col("volume").cast("double"), F.nullif(v20, F.lit(0.0))).alias("rvol"),
        (v5 <= 0.7 * v20).alias("calm"),
        F.stddev_samp("ret").over(I.in_order().rowsBetween(Window.unboundedPreceding, -1)).alias("wild_before"),
        F.collect_list("ret").over(I.last(CHART_BACK)).alias("rets"),
        F.sum(F.col("is_high").cast("int")).over(so_far).alias("stretch_high"),
        F.sum(F.col("is_low").cast("int")).over(so_far).alias("stretch_low"),
        F.array(*(F.stddev_samp("ret").over(I.last(k)) for k in FLAG_BARS)).alias("calms"),
        F.collect_list(F.struct("rn", "close", "high", "low", "ret")).over(I.last(31)).alias("recent"),
        *(F.lead("close", k).over(I.in_order()).alias(f"close_{k}") for k in AHEAD),
    )


def at_last(f: DataFrame) -> DataFrame:
    """The as-of bars of a frame: the last one of each symbol."""
    return as_of_bars(f, F.col("rn") == F.col("bars"))


def as_of_bars(f: DataFrame, when: Column) -> DataFrame:
    """The bars of a frame at which patterns are looked for, as if no later bar were known."""
    return f.where(when).select("symbol", F.col("rn").alias("n"), F.col("d").alias("as_of"), F.col("close").alias("spot"), "rvol", F.col("calm").alias("contraction"), "rets", "calms", "recent", *(f"close_{k}" for k in AHEAD))


def _in_sight(found: DataFrame, ends: DataFrame, first: Column, last: Column) -> DataFrame:
    """found, once for each as-of bar n of its symbol with first <= n <= last.

    Both sides meet by symbol and block of bars, so what is multiplied is
    patterns or swings, a few for each block, and not bars; a long history is
    many blocks.
    """
    a = found.withColumn("_from", first).withColumn("_to", last).where("_from <= _to")
    a = a.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / SIGHT_BLOCK), F.floor(F.col("_to") / SIGHT_BLOCK))))
    b = ends.select("symbol", "n", F.floor(F.col("n") / SIGHT_BLOCK).alias("_block"))
    return a.join(b, ["symbol", "_block"]).where("n between _from and _to").drop("_from", "_to", "_block")


def _swing_chain(f: DataFrame, top: bool) -> DataFrame:
    """Swings of a side in order, each with the one and the two before it and the far side's extreme between neighbours.

    A bar's number of swings so far names its stretch, so the extremes between
    two swings are a group's, not a range join's.
    """
    side, other, flag = ("high", "low", "is_high") if top else ("low", "high", "is_low")
    df = f.withColumn("stretch", F.col("stretch_high" if top else "stretch_low"))
    far = F.min(other) if top else F.max(other)
    between = df.where("stretch > 0").groupBy("symbol", "stretch").agg(far.alias("far"))
    s = df.where(F.col(flag)).select("symbol", "stretch", "d", "rn", F.col(side).alias("v"), F.col(other).alias("own"))
    s = s.join(between.withColumn("stretch", F.col("stretch") + 1), ["symbol", "stretch"], "left")
    s = s.withColumn("far", F.least("far", "own") if top else F.greatest("far", "own"))
    by = Window.partitionBy("symbol").orderBy("rn")
    return s.withColumn("one", F.lag(F.struct("d", "rn", "v", "far")).over(by)).withColumn("two", F.lag(F.struct("d", "rn", "v"), 2).over(by))


def _stated(found: DataFrame, ends: DataFrame, first: Column, last: Column, top: bool, failed: Column, stop: Column, depth: Column) -> DataFrame:
    """The first pattern in sight of each as-of bar, with state, trigger (the neckline), stop, target (as far beyond as the pattern is deep) and range in %."""
    seen = _in_sight(found, ends, first, last)
    kept = [c for c in found.columns if c != "symbol"]
    one = seen.groupBy("symbol", "n").agg(F.min_by(F.struct(*kept), "rn").alias("p")).select("symbol", "n", "p.*")
    one = one.join(ends.select("symbol", "n", "spot", "rvol"), ["symbol", "n"])
    neck, spot = F.col("neckline"), F.col("spot")
    broken = spot < neck * (1 - BREAK) if top else spot > neck * (1 + BREAK)
    loud = F.coalesce(F.col("rvol") >= VOLUME, F.lit(False))
    state = F.when(broken & loud, "confirmed").when(broken, "developing").when(failed, "failed").otherwise("developing")
    target = neck - depth if top else neck + depth
    return one.select(
        "symbol", "n", "pattern", F.lit("down" if top else "up").alias("direction"), state.alias("state"), F.round(neck, 6).alias("trigger"), F.round(stop, 6).alias("stop"), F.round(target, 6).alias("target"),
        F.round(ratio(depth, neck) * 100, 6).alias("range_pct"), loud.alias("volume_confirmed"), F.lit("stable").alias("volatility"), F.col("duration").cast("int").alias("duration"),
    )


def doubles_at(f: DataFrame, ends: DataFrame, top: bool) -> DataFrame:
    """DOM18: at each as-of bar the first double top (bottom) among the swings of its last 120 bars: neighbours far enough apart and near enough in price."""
    p1, p2 = F.col("one.v"), F.col("v")
    ok = (F.col("rn") - F.col("one.rn") >= DOUBLE_SEPARATION) & (ratio(F.abs(p1 - p2), (p1 + p2) / 2) <= DOUBLE_TOLERANCE)
    s = _swing_chain(f, top).where(ok).withColumn("neckline", F.col("far")).withColumn("pattern", F.lit("double_top" if top else "double_bottom")).withColumn("duration", F.col("rn") - F.col("one.rn"))
    sight = F.col("rn") + KNOWN_AFTER, F.col("one.rn") + DOUBLE_BACK - 1
    if top:
        edge = F.greatest(p1, p2)
        return _stated(s, ends, *sight, True, F.col("spot") > p2 * (1 - BREAK), edge * 1.02, edge - F.col("neckline"))
    edge = F.least(p1, p2)
    return _stated(s, ends, *sight, False, F.col("spot") < p2 * (1 + BREAK), edge * 0.98, F.col("neckline") - edge)


def head_and_shoulders_at(f: DataFrame, ends: DataFrame, top: bool) -> DataFrame:
    """DOM20: at each as-of bar the first head and shoulders (inverse) among the swings of its last 180 bars: the middle of three beyond both others, those alike, far enough apart and long enough."""
    left, head, right = F.col("two.v"), F.col("one.v"), F.col("v")
    beyond = (head > left) & (head > right) if top else (head < left) & (head < right)
    apart = (F.col("one.rn") - F.col("two.rn") >= HEAD_SEPARATION) & (F.col("rn") - F.col("one.rn") >= HEAD_SEPARATION)
    days = F.datediff("d", F.col("two.d"))
    ok = beyond & apart & (ratio(F.abs(right - left), (right + left) / 2) <= HEAD_TOLERANCE) & (days >= HEAD_DAYS)
    neck = F.least("far", F.col("one.far")) if top else F.greatest("far", F.col("one.far"))
    s = _swing_chain(f, top).where(ok).withColumn("neckline", neck).withColumn("pattern", F.lit("head_and_shoulders" if top else "inverse_head_and_shoulders")).withColumn("duration", days)
    failed = F.col("spot") > right * (1 + BREAK) if top else F.col("spot") < right * (1 - BREAK)
    sight = F.col("rn") + KNOWN_AFTER, F.col("two.rn") + HEAD_BACK - 1
    return _stated(s, ends, *sight, top, failed, right * (1.02 if top else 0.98), head - F.col("neckline") if top else F.col("neckline") - head)


# The detectors' order, from which the first live pattern is taken; flags by direction and form.
ORDER = (
    "ascending_triangle", "descending_triangle", "symmetrical_triangle", "rectangle", "double_top", "double_bottom",
    "bull_flag", "bull_pennant", "bear_flag", "bear_pennant", "head_and_shoulders", "inverse_head_and_shoulders",
)
# Which way a pattern points; the others point as their trigger lies.
BULLISH = ("ascending_triangle", "bull_flag", "bull_pennant", "double_bottom", "inverse_head_and_shoulders")
BEARISH = ("descending_triangle", "bear_flag", "bear_pennant", "double_top", "head_and_shoulders")

PATTERN_COLUMNS = ["symbol", "n", "pattern", "direction", "state", "trigger", "stop", "target", "range_pct", "volume_confirmed", "volatility"]


def patterns_at(f: DataFrame, ends: DataFrame) -> DataFrame:
    """DOM16 to DOM20: the patterns of all seven detectors at each as-of bar, from the bars up to it alone."""
    out = triangles_at(f, ends)
    for found in (rectangles_at(f, ends), *(doubles_at(f, ends, top) for top in (True, False)), flags_at(f, ends), *(head_and_shoulders_at(f, ends, top) for top in (True, False))):
        out = out.unionByName(found.select(PATTERN_COLUMNS))
    return out


def patterns_now(bars: DataFrame) -> DataFrame:
    """DOM18, DOM20: doubles and heads with shoulders of each symbol at its last bar."""
    f = frame(bars)
    ends = at_last(f)
    found = doubles_at(f, ends, True).unionByName(doubles_at(f, ends, False)).unionByName(head_and_shoulders_at(f, ends, True)).unionByName(head_and_shoulders_at(f, ends, False))
    return found.drop("n", "direction", "volatility")


def top_pattern(found: DataFrame) -> DataFrame:
    """TOP8: the first confirmed pattern, else the first developing one, in the detectors' order, of each symbol (and as-of bar n, where found has it)."""
    place = F.lit(len(ORDER))
    for i, name in reversed(list(enumerate(ORDER))):
        place = F.when(F.col("pattern") == name, i).otherwise(place)
    by = [c for c in ("symbol", "n") if c in found.columns]
    live = found.where("state in ('confirmed', 'developing')")
    first = F.struct(F.when(F.col("state") == "confirmed", 0).otherwise(1), place)
    rest = [c for c in found.columns if c not in by]
    return live.groupBy(*by).agg(F.min_by(F.struct(*rest), first).alias("p")).select(*by, "p.*")


CHART_BACK, TRIANGLE_TOUCHES, TRIANGLE_DAYS, TRIANGLE_RANGE = 90, 3, 14, 0.30
RECTANGLE_TOUCHES, RECTANGLE_DAYS, RECTANGLE_SD = 2, 10, 0.35
FLAG_IMPULSE, FLAG_LONGEST, FLAG_CALM = 0.05, 20, 0.6
#: Bars from an impulse's end to the as-of bar.
FLAG_BARS = range(5, FLAG_LONGEST)


def _sd(xs: Column) -> Column:
    """Sample deviation a year of an array, in one pass by its running mean; null for fewer than two."""
    def step(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (x - a["mean"]) * (x - mean)).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(xs, start, step, lambda a: F.when(a["n"] >= 2, F.sqrt(a["m2"] / (a["n"] - 1)) * F.sqrt(F.lit(252.0))))


def _sides(f: DataFrame, ends: DataFrame, touches: int) -> DataFrame:
    """At each as-of bar the last touches + 2 swings of each side known within its last 90 bars, as slope, first point, mean, extreme and dates,
    with the yearly deviation of returns since the first upper swing and before it; bars with fewer than touches on a side are left out.

    Deviations are of the returns themselves: differences of running sums would
    lose a calm chart behind a steep move.
    """
    out = None
    for side, flag, k in (("high", "is_high", "u"), ("low", "is_low", "l")):
        s = f.where(F.col(flag)).select("symbol", "rn", "d", F.col(side).alias("v"), F.col("rn").cast("double").alias("x"), "wild_before")
        s = _in_sight(s, ends, F.col("rn") + KNOWN_AFTER, F.col("rn") + CHART_BACK - 1)
        s = s.withColumn("i", F.row_number().over(Window.partitionBy("symbol", "n").orderBy(F.desc("rn")))).where(F.col("i") <= touches + 2).groupBy("symbol", "n").agg(
            F.count("*").alias(f"{k}_n"), F.regr_slope("v", "x").alias(f"{k}_slope"), F.min("rn").alias(f"{k}_rn"), F.min_by("v", "rn").alias(f"{k}_first"), F.avg("v").alias(f"{k}_mean"),
            F.max("v").alias(f"{k}_max"), F.min("v").alias(f"{k}_min"), F.min("d").alias(f"{k}_d0"), F.max("d").alias(f"{k}_d1"), F.min_by("wild_before", "rn").alias(f"{k}_before"),
        ).where(F.col(f"{k}_n") >= touches)
        out = s if out is None else out.join(s.drop("l_before"), ["symbol", "n"])
    out = out.join(ends.select("symbol", "n", "spot", "rvol", "contraction", "rets"), ["symbol", "n"])
    since = F.col("n") - F.col("u_rn") + 1  # at most CHART_BACK, and no bar without a return: a swing has bars before it
    out = out.withColumn("inside", _sd(F.slice("rets", F.size("rets") - since + 1, since))).drop("rets")
    return out.withColumn("outside", F.when(F.col("u_rn") > 6, F.col("u_before") * F.sqrt(F.lit(252.0))).otherwise(F.col("inside")))


def _out(df: DataFrame, pattern: Column, up: Column, trigger: Column, stop: Column, times: float, failed: Column, confirmed_by: Column, range_pct: Column, contracting: Column) -> DataFrame:
    beyond = F.when(up, F.col("spot") >= trigger * (1 + BREAK)).otherwise(F.col("spot") <= trigger * (1 - BREAK))
    loud = F.coalesce(F.col("rvol") >= VOLUME, F.lit(False))
    state = F.when(failed, "failed").when(beyond & loud, "confirmed").otherwise("developing")
    target = F.when(up, trigger + (trigger - stop) * times).otherwise(trigger - (stop - trigger) * times)
    return df.select("symbol", "n", pattern.alias("pattern"), F.when(up, "up").otherwise("down").alias("direction"), state.alias("state"), F.round(trigger, 6).alias("trigger"), F.round(stop, 6).alias("stop"), F.round(target, 6).alias("target"), F.round(range_pct * 100, 6).alias("range_pct"), confirmed_by.alias("volume_confirmed"), F.when(contracting, "contracting").otherwise("stable").alias("volatility"))


def triangles_at(f: DataFrame, ends: DataFrame) -> DataFrame:
    """DOM16: trendlines through the last swings of each side that close in on each other, with their values at the as-of bar as trigger and stop.

    The names are those of the source material: both closing in is ascending.
    """
    df = _sides(f, ends, TRIANGLE_TOUCHES)
    up_now, low_now = (F.col(f"{k}_first") + F.col(f"{k}_slope") * (F.col("n") - F.col(f"{k}_rn")) for k in "ul")
    us, ls = F.col("u_slope"), F.col("l_slope")
    flat_top, flat_floor = (F.abs(us) < F.abs(ls) * 0.5) & (ls > 0), (F.abs(ls) < F.abs(us) * 0.5) & (us < 0)
    kind = F.when((us < 0) & (ls > 0), "ascending_triangle").when((us > 0) & (ls < 0), "descending_triangle").when(flat_top | flat_floor, "symmetrical_triangle")
    up = F.when((us < 0) & (ls > 0), True).when((us > 0) & (ls < 0), False).otherwise(flat_top)
    width = ratio(F.col("u_max") - F.col("l_min"), (F.col("u_max") + F.col("l_min")) / 2)
    df = df.withColumn("up_now", up_now).withColumn("low_now", low_now).withColumn("kind", kind).withColumn("up", up).withColumn("width", width)
    df = df.where("kind is not null").where((F.datediff("u_d1", "u_d0") >= TRIANGLE_DAYS) & (F.col("width") <= TRIANGLE_RANGE))
    up, trigger, stop = F.col("up"), F.when(F.col("up"), F.col("up_now")).otherwise(F.col("low_now")), F.when(F.col("up"), F.col("low_now")).otherwise(F.col("up_now"))
    failed = F.when(up, F.col("spot") < F.col("low_now") * (1 - BREAK)).otherwise(F.col("spot") > F.col("up_now") * (1 + BREAK))
    loud = F.coalesce(F.col("rvol") >= VOLUME, F.lit(False))
    return _out(df, F.col("kind"), up, trigger, stop, 1.5, failed, loud, F.col("width"), F.coalesce(F.col("inside") < F.col("outside") * 0.85, F.lit(False)))


def rectangles_at(f: DataFrame, ends: DataFrame) -> DataFrame:
    """DOM17: the means of the last swings of each side as ceiling and floor, where returns between them are calm; up or down by the as-of close."""
    df = _sides(f, ends, RECTANGLE_TOUCHES)
    top, floor, spot = F.col("u_mean"), F.col("l_mean"), F.col("spot")
    df = df.where((F.datediff("u_d1", "u_d0") >= RECTANGLE_DAYS) & (top > floor) & ~F.coalesce(F.col("inside") > RECTANGLE_SD, F.lit(False)))
    up = F.when(spot >= top * (1 + BREAK), True).when(spot <= floor * (1 - BREAK), False).otherwise(spot > (top + floor) / 2)
    trigger, stop = F.when(up, top).otherwise(floor), F.when(up, floor).otherwise(top)
    loud = F.coalesce(F.col("contraction") | (F.col("rvol") >= VOLUME), F.lit(False))
    return _out(df, F.lit("rectangle"), up, trigger, stop, 1.0, F.lit(False), loud, ratio(top - floor, (top + floor) / 2), F.coalesce("contraction", F.lit(False)))


def impulses(f: DataFrame) -> DataFrame:
    """Moves of 5 % and more within 5 to 10 bars: (symbol, s, e, move, wild) with the first and last bar and the yearly deviation of the returns between them."""
    by = I.in_order()
    year = F.sqrt(F.lit(252.0))
    each = [F.struct(F.lit(k).alias("k"), (ratio(F.col("close"), F.lag("close", k).over(by)) - 1).alias("move"), (F.stddev_samp("ret").over(by.rowsBetween(-(k - 1), -1)) * year).alias("wild")) for k in range(5, 11)]
    df = f.select("symbol", F.col("rn").alias("e"), F.array(*each).alias("each"))
    df = df.select("symbol", "e", F.explode("each").alias("x")).where(F.abs(F.col("x.move")) >= FLAG_IMPULSE)
    return df.select("symbol", (F.col("e") - F.col("x.k")).alias("s"), "e", "x.move", "x.wild")


def flags_at(f: DataFrame, ends: DataFrame) -> DataFrame:
    """DOM19: an impulse of 5 % within 5 to 10 bars of the last 30, then 5 to 20 bars up to the as-of bar with at most 0.6 of its deviation; the first start, then the first end that fits.

    Impulses are found once a symbol and meet the as-of bars that they are in
    sight of; deviations are of the as-of bar's own frames, since running sums
    would lose a calm behind a steep move, and only the flag that is found
    takes the last bars' array.
    """
    seen = _in_sight(impulses(f), ends.where("n >= 30"), F.col("e") + 5, F.least(F.col("e") + FLAG_LONGEST - 1, F.col("s") + 29))
    seen = seen.join(ends.select("symbol", "n", "calms"), ["symbol", "n"])
    calm = F.get("calms", (F.col("n") - F.col("e") - FLAG_BARS[0]).cast("int")) * F.sqrt(F.lit(252.0))
    seen = seen.where(calm < F.col("wild") * FLAG_CALM)
    first = seen.groupBy("symbol", "n").agg(F.min_by(F.struct("move", "e"), F.struct("s", "e")).alias("p")).select("symbol", "n", "p.*")
    first = first.join(ends.select("symbol", "n", "spot", "rvol", "recent"), ["symbol", "n"])
    first = first.withColumn("rest", F.slice("recent", F.size("recent") - (F.col("n") - F.col("e")), F.col("n") - F.col("e") + 1))
    hi, lo = F.array_max(F.transform("rest", lambda x: x["high"])), F.array_min(F.transform("rest", lambda x: x["low"]))
    m = F.size("rest")
    mx, my = (m - 1) / 2, F.aggregate("rest", F.lit(0.0), lambda a, x: a + x["close"]) / m
    cov = F.aggregate(F.transform("rest", lambda x, i: (i - mx) * (x["close"] - my)), F.lit(0.0), lambda a, x: a + x)
    var = F.aggregate(F.transform("rest", lambda x, i: (i - mx) * (i - mx)), F.lit(0.0), lambda a, x: a + x)
    first = first.withColumn("hi", hi).withColumn("lo", lo).withColumn("slope", cov / var)
    up = F.col("move") > 0
    form = F.when(F.abs("slope") < (F.col("hi") - F.col("lo")) / 2, "flag").otherwise("pennant")
    trigger, stop = F.when(up, F.col("hi")).otherwise(F.col("lo")), F.when(up, F.col("lo")).otherwise(F.col("hi"))
    loud = F.coalesce(F.col("rvol") >= VOLUME, F.lit(False))
    return _out(first, F.concat(F.when(up, "bull_").otherwise("bear_"), form), up, trigger, stop, 1.5, F.lit(False), loud, ratio(F.col("hi") - F.col("lo"), F.col("spot")), F.lit(True))


def triangles(bars: DataFrame) -> DataFrame:
    """DOM16 at each symbol's last bar."""
    f = frame(bars)
    return triangles_at(f, at_last(f)).drop("n")


def rectangles(bars: DataFrame) -> DataFrame:
    """DOM17 at each symbol's last bar."""
    f = frame(bars)
    return rectangles_at(f, at_last(f)).drop("n")


def flags(bars: DataFrame) -> DataFrame:
    """DOM19 at each symbol's last bar."""
    f = frame(bars)
    return flags_at(f, at_last(f)).drop("n")


WALK_FROM, WALK_EVERY, WALK_SHORT = 120, 5, 25
HIT_MOVE = 0.005


def walk(f: DataFrame) -> DataFrame:
    """The as-of bars of a walk: every fifth from the 120th on, up to 25 before the last."""
    return as_of_bars(f, (F.col("rn") >= WALK_FROM) & ((F.col("rn") - WALK_FROM) % WALK_EVERY == 0) & (F.col("rn") < F.col("bars") - WALK_SHORT))


def detections(f: DataFrame, ends: DataFrame) -> DataFrame:
    """DOM22: (symbol, n, as_of, pattern, state, trigger, spot, fwd_1w, fwd_2w, fwd_4w, hit) of all seven detectors at each as-of bar.

    Returns are over the 5, 10 and 20 bars after it.  A pattern points up or
    down by its name; rectangles and symmetrical triangles point up where they
    are confirmed with the trigger above the close, else down.  It hits when the
    20-bar return goes its way by half a percent or more; null without one.
    """
    fwd = [(ratio(F.col(f"close_{k}"), F.col("spot")) - 1).alias(name) for k, name in zip(AHEAD, ("fwd_1w", "fwd_2w", "fwd_4w"), strict=True)]
    df = patterns_at(f, ends).join(ends.select("symbol", "n", "as_of", "spot", *fwd), ["symbol", "n"])
    other = ~F.col("pattern").isin(*BULLISH, *BEARISH)
    up = F.col("pattern").isin(*BULLISH) | (other & (F.col("state") == "confirmed") & (F.col("trigger") > F.col("spot")))
    hit = F.when(F.col("fwd_4w").isNotNull(), F.when(up, F.col("fwd_4w") >= HIT_MOVE).otherwise(F.col("fwd_4w") <= -HIT_MOVE))
    return df.select("symbol", "n", "as_of", "pattern", "state", "trigger", "spot", "fwd_1w", "fwd_2w", "fwd_4w", hit.alias("hit"))


def pattern_statistics(found: DataFrame, least: int = 10, held_out: float = 0.5) -> DataFrame:
    """DOM22, AGG15: the later part of each symbol's detections of a pattern, from least of them on: counts, hit rate, mean returns, median, and how often the 20-bar return is 1 % either way."""
    by = Window.partitionBy("symbol", "pattern")
    df = found.withColumn("n_total", F.count("*").over(by)).withColumn("i", F.row_number().over(by.orderBy("n")))
    df = df.where((F.col("n_total") >= least) & (F.col("i") > F.floor(F.col("n_total") * (1 - held_out))))
    big = F.when(F.col("fwd_4w").isNotNull(), (F.abs("fwd_4w") >= 0.01).cast("double"))
    return df.groupBy("symbol", "pattern").agg(
        F.count("*").alias("n"), F.max("n_total").alias("n_total"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg("fwd_1w"), 9).alias("avg_return_1w"),
        F.round(F.avg("fwd_2w"), 9).alias("avg_return_2w"), F.round(F.avg("fwd_4w"), 9).alias("avg_return_4w"), F.round(F.median("fwd_4w"), 9).alias("median_return_4w"), F.round(F.avg(big), 6).alias("win_rate_1pct"),
    )


NODES_BACK, NODE_BINS = 60, 50
NEAREST = 8


def trend_record(bars: DataFrame) -> DataFrame:
    """DOM14: each symbol at its last bar: the order of averages, higher swings of the last 60 bars, the regression's slope (% a day) and fit, and the direction."""
    df = I.swings(bars).withColumn("rn", F.row_number().over(I.in_order())).withColumn("x", F.col("rn").cast("double"))
    slope, fit = I.full(F.regr_slope("close", "x").over(I.last(60)), 60), I.full(F.regr_r2("close", "x").over(I.last(60)), 60)
    df = df.withColumn("n", F.max("rn").over(Window.partitionBy("symbol")))
    last = df.select("symbol", "d", "rn", "n", "close", *(I.full(F.avg("close").over(I.last(k)), k).alias(f"ma{k}") for k in (20, 50, 200)), (ratio(slope, F.avg("close").over(I.last(60))) * 100).alias("slope"), fit.alias("r2")).where("rn = n")
    counts = None
    for side, flag, name in (("high", "is_high", "hh"), ("low", "is_low", "hl")):
        s = df.where(F.col(flag) & (F.col("rn") > F.col("n") - 60)).withColumn("before", F.lag(side).over(I.in_order()))
        s = s.groupBy("symbol").agg(F.count_if(F.col(side) > F.col("before")).alias(name))
        counts = s if counts is None else counts.join(s, "symbol", "full")
    df = last.join(counts, "symbol", "left").withColumn("higher", (F.coalesce("hh", F.lit(0)) + F.coalesce("hl", F.lit(0))).cast("int"))
    c, a, b, e = (F.col(k) for k in ("close", "ma20", "ma50", "ma200"))
    whole = F.when((c > a) & (a > b) & (b > e), "bullish_20_50_200").when((c < a) & (a < b) & (b < e), "bearish_20_50_200").when((a > b) & (b > e), "bullish_partial").when((a < b) & (b < e), "bearish_partial").otherwise("mixed")
    part = F.when(a > b, "bullish_partial").when(a < b, "bearish_partial").otherwise("mixed")
    df = df.withColumn("alignment", F.when(e.isNotNull(), whole).otherwise(part)).withColumn("slope", F.round(F.coalesce("slope", F.lit(0.0)), 6)).withColumn("r2", F.round(F.coalesce("r2", F.lit(0.0)), 6))
    up = (F.col("alignment") == "bullish_20_50_200") | (F.col("slope") > 0.05) & (F.col("higher") >= 2)
    down = (F.col("alignment") == "bearish_20_50_200") | (F.col("slope") < -0.05) & (F.col("higher") <= 1)
    return df.select("symbol", "d", F.when(up, "up").when(down, "down").otherwise("sideways").alias("direction"), "alignment", "higher", "slope", "r2", *((F.coalesce(c > m, F.lit(False))).alias(f"above_{k}") for m, k in ((a, 20), (b, 50), (e, 200))))


def gap_zones(bars: DataFrame, back: int = 60) -> DataFrame:
    """WIN19: opens half a percent or more beyond the close before, within the last 60 bars, that no later bar has come back through: (symbol, d, side, lower, upper, age)."""
    after = I.in_order().rowsBetween(1, Window.unboundedFollowing)
    df = bars.select("symbol", "d", "open", I.back("close").alias("before"), F.min("low").over(after).alias("low_after"), F.max("high").over(after).alias("high_after"), (F.count("*").over(Window.partitionBy("symbol")) - F.row_number().over(I.in_order())).cast("int").alias("age"))
    up = (F.col("open") > F.col("before") * 1.005) & F.coalesce(F.col("low_after") > F.col("before"), F.lit(True))
    down = (F.col("open") < F.col("before") * 0.995) & F.coalesce(F.col("high_after") < F.col("before"), F.lit(True))
    return df.where((F.col("age") < back - 1) & (up | down)).select("symbol", "d", F.when(up, "up").otherwise("down").alias("side"), F.least("open", "before").alias("lower"), F.greatest("open", "before").alias("upper"), "age")


def volume_nodes(bars: DataFrame, back: int = NODES_BACK, bins: int = NODE_BINS) -> DataFrame:
    """AGG6: the middle prices of each symbol's high-volume bins over its last bars."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    span = bars.withColumn("age", F.row_number().over(down)).where(F.col("age") <= back).groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count("*").alias("k")).where((F.col("k") >= back) & (F.col("hi") > F.col("lo")))
    return I.volume_profile(bars, back, bins).where("is_node").join(span, "symbol").select("symbol", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("price"))


def support_and_resistance(bars: DataFrame) -> DataFrame:
    """DOM15, TOP3: the eight nearest levels of each side of each symbol's last close, from swings, averages, anchored prices, volume nodes and gaps, with strength, age and distance in %."""
    down = Window.partitionBy("symbol").orderBy(F.desc("d"))
    df = I.swings(bars).withColumn("age", F.row_number().over(down) - 1)
    for k in (20, 50, 200):
        df = df.withColumn(f"ma{k}", I.full(F.avg("close").over(I.last(k)), k))
    last = df.where("age = 0").select("symbol", F.col("d").alias("end"), F.col("close").alias("spot"), "ma20", "ma50", "ma200")
    ages = df.select("symbol", F.col("d").alias("since"), "age")
    parts = []
    for side, flag, name, cond in (("low", "is_low", "swing_low", "price < spot"), ("high", "is_high", "swing_high", "price > spot")):
        s = df.where(F.col(flag)).withColumn("i", F.row_number().over(down)).where("i <= 10 and age <= 180").select("symbol", F.lit(name).alias("source"), F.col(side).alias("price"), F.round(1 / F.greatest(F.col("age") / 30, F.lit(0.5)), 2).alias("strength"), "age")
        parts.append(s.join(last.select("symbol", "spot"), "symbol").where(cond).drop("spot"))
    own = F.explode(F.array(*(F.struct(F.lit(f"ma_{k}").alias("source"), F.col(f"ma{k}").alias("price")) for k in (20, 50, 200))))
    parts.append(last.select("symbol", own.alias("m")).where("m.price is not null").select("symbol", "m.source", "m.price", F.lit(0.5).alias("strength"), F.lit(0).alias("age")))
    vwap = I.anchored_vwap(bars).join(ages, ["symbol", "since"])
    parts.append(vwap.where("vwap > 0").select("symbol", F.concat(F.lit("vwap_"), "anchor").alias("source"), F.col("vwap").alias("price"), F.lit(0.6).alias("strength"), "age"))
    parts.append(volume_nodes(bars).select("symbol", F.lit("volume_node").alias("source"), "price", F.lit(0.7).alias("strength"), F.lit(0).alias("age")))
    gaps = gap_zones(bars)
    parts.append(gaps.select("symbol", F.lit("gap_fill").alias("source"), F.when(F.col("side") == "up", F.col("lower")).otherwise(F.col("upper")).alias("price"), F.lit(0.6).alias("strength"), "age"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.join(last.select("symbol", "spot"), "symbol").withColumn("side", F.when(F.col("price") < F.col("spot"), "support").otherwise("resistance"))
    got = got.withColumn("distance_pct", F.round(ratio(F.abs(F.col("spot") - F.col("price")), F.col("spot")) * 100, 6)).withColumn("price", F.round("price", 4))
    place = F.row_number().over(Window.partitionBy("symbol", "side").orderBy("distance_pct", "source", "price", "age"))
    return got.withColumn("place", place).where(F.col("place") <= NEAREST).select("symbol", "side", "place", "source", "price", "strength", "age", "distance_pct")


EXPANSION = 1.5
WEIGHTS = {"trend": 0.25, "levels": 0.20, "volume": 0.20, "volatility": 0.15, "breakout": 0.20}


def chart_scores(bars: DataFrame) -> DataFrame:
    """DOM21: five scores of 0 to 100 of each symbol's chart, their weighted total and grade (A+ from 80, A 65, B 50, C 35, else D)."""
    bound = lambda x: F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))
    t = trend_record(bars)
    base = F.when((F.col("direction") == "up") & (F.col("alignment") == "bullish_20_50_200"), 95.0).when(F.col("direction") == "up", 75.0).when((F.col("direction") == "down") & (F.col("alignment") == "bearish_20_50_200"), 5.0).when(F.col("direction") == "down", 25.0).otherwise(50.0)
    t = t.select("symbol", bound(bound(base + (F.col("r2") - 0.5) * 20) + F.least("higher", F.lit(4)) * 2.5).alias("trend"))
    levels = support_and_resistance(bars).groupBy("symbol").agg(F.count_if(F.col("distance_pct") <= 5).alias("near"), F.count_if(F.col("side") == "support").alias("supports"), F.max(F.when((F.col("side") == "support") & (F.col("place") == 1), (F.col("distance_pct") <= 3) & (F.col("strength") >= 0.6))).alias("firm"))
    levels = levels.select("symbol", bound(50.0 + F.col("near") * 5 - F.col("supports") * 2 + F.when(F.col("firm"), 15).otherwise(0)).alias("levels"))
    a = I.accumulation(bars).groupBy("symbol").agg(F.max_by("ad_slope", "d").alias("ad"))
    df = bars.withColumn("rn", F.row_number().over(I.in_order()))
    v5, v20 = F.avg("volume").over(I.last(5)), F.greatest(F.avg("volume").over(I.last(20)), F.lit(1.0))
    v = df.select("symbol", "rn", (F.col("volume") / v20).alias("rvol"), (v5 / v20 <= 0.7).alias("contraction")).groupBy("symbol").agg(F.max_by("rvol", "rn").alias("rvol"), F.max_by("contraction", "rn").alias("contraction")).join(a, "symbol")
    volume = 50.0 + F.when(F.col("rvol") >= EXPANSION, 15).otherwise(0) + F.when(F.col("contraction"), 10).otherwise(0) + F.when(F.col("ad") > 0, 15).when(F.col("ad") < 0, -10).otherwise(0) - F.when(F.col("rvol") < 0.7, 10).otherwise(0)
    v = v.select("symbol", bound(volume).alias("volume"))
    f = frame(bars)
    every = patterns_at(f, at_last(f))
    has = lambda c: F.max(c.cast("int")) == 1
    p = every.groupBy("symbol").agg(has(F.col("state") == "confirmed").alias("confirmed"), has(F.col("state") == "developing").alias("developing"), has(F.col("state") == "failed").alias("failed"), has(F.col("volatility") == "contracting").alias("contracting"), has(F.col("volume_confirmed")).alias("loud"))
    got = t.join(levels, "symbol", "left").join(v, "symbol", "left").join(p, "symbol", "left")
    volatility = F.when(F.col("confirmed"), 90.0).when(F.col("contracting"), 75.0).otherwise(40.0)
    breakout = F.when(F.col("confirmed"), 95.0).when(F.col("developing"), 60.0).otherwise(30.0)
    breakout = F.when(F.col("failed"), F.greatest(breakout - 20, F.lit(10.0))).otherwise(breakout)
    breakout = F.when(F.col("loud"), F.least(breakout + 10, F.lit(100.0))).otherwise(breakout)
    got = got.select("symbol", "trend", F.coalesce("levels", F.lit(50.0)).alias("levels"), F.coalesce("volume", F.lit(50.0)).alias("volume"), volatility.alias("volatility"), breakout.alias("breakout"))
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * F.col(k)
    got = got.withColumn("total", F.round(total, 6))
    grade = F.when(F.col("total") >= 80, "A+").when(F.col("total") >= 65, "A").when(F.col("total") >= 50, "B").when(F.col("total") >= 35, "C").otherwise("D")
    return got.select("symbol", *(F.round(k, 6).alias(k) for k in WEIGHTS), "total", grade.alias("grade"))
