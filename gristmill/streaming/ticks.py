"""Streaming bars and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly_bars(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """STM1: (symbol, start, open, high, low, close, volume) of ticks(symbol, ts, price, volume), batch or stream.

    A stream drops ticks later than the watermark and emits an hour once it is closed.
    """
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    got = ticks.groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    return got.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def once_a_day(records: DataFrame, key: str = "candidate_id", ts: str = "ts") -> DataFrame:
    """STM2: the first record of an id within a day; later repeats inside the watermark are dropped."""
    return records.withWatermark(ts, "1 day").dropDuplicatesWithinWatermark([key])
