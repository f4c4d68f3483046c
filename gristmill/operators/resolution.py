"""DOM28, SRC5: outcomes and records that are appended once, whatever is run again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .forecast import HORIZONS, calendar_days, open_records, resolved


def stored(spark: SparkSession, path: str, columns: list[str], schema: str) -> DataFrame:
    """What the table at path has; an empty one if there is none yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).select(*columns)
    return spark.read.parquet(path).select(*columns)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def due_outcomes(records: DataFrame, forecasts: DataFrame, bars: DataFrame, done: DataFrame, today: dt.date) -> DataFrame:
    """DOM28, FIL11: (id, horizon, ...) of the open records' horizons that are due by today and that done(id, horizon) lacks.

    records(id, profile, label, last_resolved, as_of) are filtered as open
    first; forecasts are the bands of bands() with the record's id.  Only bars
    up to today are used, and a horizon is due when its calendar days have
    passed in the symbol's bars.
    """
    day = F.lit(today).cast("date")
    live = open_records(records, day).select("id")
    days = F.create_map(*(x for h in HORIZONS for x in (F.lit(h), F.lit(calendar_days(h)))))
    wanted = forecasts.join(live, "id", "left_semi").where(F.date_add("d", days[F.col("horizon")]) <= day).join(done.select("id", "horizon"), ["id", "horizon"], "left_anti")
    got = resolved(wanted, bars.where(F.col("d") <= day))
    return wanted.select("id", "symbol", "d", "horizon").join(got, ["symbol", "d", "horizon"]).select("id", "horizon", "symbol", "d", "actual", "mfe", "mae", "in68", "in90", "error")


OUTCOMES = "id string, horizon int, symbol string, d date, actual double, mfe double, mae double, in68 boolean, in90 boolean, error double"


def resolve_night(records: DataFrame, forecasts: DataFrame, bars: DataFrame, path: str, today: dt.date) -> None:
    """Writes the night's outcomes to path/resolved_on=today; what other nights have written stays out, and the same night writes the same again.

    A night that broke off, or that is run twice, replaces its own partition
    only, so no outcome is there twice and none is missing.
    """
    spark = bars.sparkSession
    done = stored(spark, path, ["id", "horizon", "resolved_on"], f"{OUTCOMES}, resolved_on date")
    done = done.where(F.col("resolved_on") != F.lit(today).cast("date"))
    due_outcomes(records, forecasts, bars, done, today).write.mode("overwrite").parquet(f"{path}/resolved_on={today.isoformat()}")


def append_once(rows: DataFrame, path: str, key: str, order: str, checkpoint: str) -> DataStreamWriter:
    """SRC5, STM2: a stream's rows whose key the ledger at path lacks, the first by order of each key in a batch.

    Batch n is written to path/batch=n and nowhere else, after what the other
    batches hold has been taken out, so a batch that is replayed after a loss
    replaces itself: each key is there once.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        first = batch.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
        if _exists(spark, path):
            known = spark.read.parquet(path).where(F.col("batch") != n).select(key)
            first = first.join(known, key, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
