"""Reports, dividends and short interest around every bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import indicators as I
from ..functions.ieee import ratio

DRIFT_BARS, DRIFT_BACK, SPIKE = 5, 504, 2.0


def around(left: DataFrame, events: DataFrame, key: str, left_time: str, event_time: str, values: Sequence[str] = ()) -> DataFrame:
    """left with the event before it and the event after it: structs previous and next of event_time and values, null where there is none.

    previous is the last event at or before left's time, next the first one
    after it; of events at one time the one with the largest values counts.
    Both sides are put into one order by key and time and carried along it in
    either direction: one exchange and two sorts for both, no range join.
    Events without a time are ignored; left rows without one have neither.
    """
    whole = F.struct(F.col(event_time).alias(event_time), *values)
    rows = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_key"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"))
    marks = events.where(F.col(event_time).isNotNull()).select(F.col(key).alias("_key"), F.col(event_time).alias("_t"), F.lit(0).alias("_side"), whole.alias("_event"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    by = Window.partitionBy("_key")
    so_far = lambda *order: by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("previous", F.last("_event", True).over(so_far("_t", "_side", "_event")))
    both = both.withColumn("next", F.last("_event", True).over(so_far(F.desc("_t"), F.desc("_side"), "_event")))
    timed = F.col("_t").isNotNull()
    return both.where("_side = 1").select("_row.*", F.when(timed, F.col("previous")).alias("previous"), F.when(timed, F.col("next")).alias("next"))


def spike_drift(bars: DataFrame) -> DataFrame:
    """DOM1: (symbol, d, close, v20, earnings_drift): the mean 5-bar return after bars of more than twice the mean volume of 20, among those of the last 504 bars that are over by now."""
    by = I.in_order()
    loud = I.full(F.col("volume") > SPIKE * F.avg("volume").over(I.last(20)), 20, "volume")
    df = bars.select("symbol", "d", "close", F.avg("volume").over(I.last(20)).alias("v20"), loud.alias("loud"))
    df = df.withColumn("after", F.when(F.lag("loud", DRIFT_BARS).over(by), ratio(F.col("close"), F.lag("close", DRIFT_BARS).over(by)) - 1))
    return df.select("symbol", "d", "close", "v20", F.avg("after").over(by.rowsBetween(-(DRIFT_BACK - DRIFT_BARS - 1), 0)).alias("earnings_drift"))


def short_changes(shorts: DataFrame) -> DataFrame:
    """shorts(symbol, d, shares) with short_change, against the row before; null for the first one and after none."""
    before = F.lag("shares").over(Window.partitionBy("symbol").orderBy("d"))
    return shorts.withColumn("short_change", F.try_divide(F.col("shares").cast("double"), F.nullif(before, F.lit(0))) - 1)


def event_features(rows: DataFrame, drift: DataFrame, reports: DataFrame, shorts: DataFrame) -> DataFrame:
    """DOM1, DAT3: for rows(symbol, d) the reports(symbol, d, surprise_pct) on either side, drift and short interest, all known at d.

    (symbol, d, days_since_report, days_to_report, surprise_pct,
    report_drift, earnings_drift, short_change, days_to_cover).  A report of the
    day itself is 0 days away both ways.  drift is spike_drift() of the bars;
    rows between two bars have the drift, close and volume of the bar before.
    report_drift is the return since the bar at or before the last report.
    """
    has = around(rows.select("symbol", "d"), drift.select("symbol", F.col("d").alias("bar_d"), "close", "v20", "earnings_drift"), "symbol", "d", "bar_d", ("close", "v20", "earnings_drift"))
    has = has.select("symbol", "d", F.col("previous").alias("bar"))
    known = around(reports.select("symbol", F.col("d").alias("report_d"), "surprise_pct"), drift.select("symbol", F.col("d").alias("bar_d"), "close"), "symbol", "report_d", "bar_d", ("close",))
    known = known.select("symbol", "report_d", "surprise_pct", F.col("previous.close").alias("report_close"))
    has = around(has, known, "symbol", "d", "report_d", ("surprise_pct", "report_close")).withColumnsRenamed({"previous": "reported", "next": "coming"})
    has = around(has, short_changes(shorts).select("symbol", F.col("d").alias("short_d"), "shares", "short_change"), "symbol", "d", "short_d", ("shares", "short_change"))
    since = F.datediff("d", "reported.report_d")
    return has.select(
        "symbol", "d", since.alias("days_since_report"), F.when(since == 0, 0).otherwise(F.datediff("coming.report_d", "d")).alias("days_to_report"), F.col("reported.surprise_pct").alias("surprise_pct"),
        (ratio(F.col("bar.close"), F.col("reported.report_close")) - 1).alias("report_drift"), F.col("bar.earnings_drift").alias("earnings_drift"), F.col("previous.short_change").alias("short_change"),
        F.try_divide(F.col("previous.shares").cast("double"), F.nullif(F.col("bar.v20"), F.lit(0.0))).alias("days_to_cover"),
    )


def days_to_next(stamps: DataFrame, as_of: Column) -> DataFrame:
    """DAT3: (symbol, kind, next, days) of stamps(symbol, kind, epoch): the first day on or after as_of among epoch seconds; symbols and kinds without one are not there."""
    days = stamps.select("symbol", "kind", F.to_date(F.timestamp_seconds("epoch")).alias("next")).where(F.col("next") >= as_of)
    return days.groupBy("symbol", "kind").agg(F.min("next").alias("next")).withColumn("days", F.datediff("next", as_of))


def upcoming(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    """TOP9: events(symbol, d) from as_of on, within so many days, the nearest first."""
    return events.where(F.col("d").between(as_of, F.date_add(as_of, days))).withColumn("days", F.datediff("d", as_of)).orderBy("d", "symbol")


def recent(events: DataFrame, as_of: Column, n: int) -> DataFrame:
    """TOP9: the n latest events(symbol, d) before as_of, the latest first, ties by symbol."""
    return events.where(F.col("d") < as_of).withColumn("days", F.datediff("d", as_of)).orderBy(F.desc("d"), "symbol").limit(n)
