"""Ledgers, caches and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def stale_keys(wanted: DataFrame, cache: DataFrame, key: str, fetched: str, now: str, ttl_hours: float) -> DataFrame:
    """SRC2: the wanted keys that the cache lacks or holds for longer than ttl_hours."""
    fresh = cache.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(fetched) < ttl_hours * 3600)
    return wanted.select(key).distinct().join(fresh.select(key).distinct(), key, "left_anti")


def read_series(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """SRC3: (d, value) of a CSV of dates and values, newest first; "", ".", NA and bad dates are left out."""
    raw = spark.read.option("header", True).schema("d string, value string").csv(path)
    got = raw.select(F.expr("try_cast(d AS date)").alias("d"), F.expr("try_cast(value AS double)").alias("value")).where("d is not null and value is not null")
    return (got.where(F.col("d") >= F.lit(since).cast("date")) if since else got).orderBy(F.desc("d"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC4: JSON lines by a fixed schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_records(records: DataFrame, path: str, key: str = "candidate_id") -> None:
    """SRC5: appends the records whose id the ledger at path lacks, one for each id, by month; a second run adds nothing."""
    spark = records.sparkSession
    first = records.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("as_of_ts"))).where("_n = 1").drop("_n")
    try:
        known = spark.read.parquet(path).select(key).distinct()
        first = first.join(known, key, "left_anti")
    except Exception as e:  # noqa: BLE001  the first run has no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    first.withColumn("ym", F.date_format("as_of_ts", "yyyy-MM")).write.mode("append").partitionBy("ym").parquet(path)


def with_changes(records: DataFrame, actions: DataFrame, actuals: DataFrame, key: str = "candidate_id") -> DataFrame:
    """SRC14: records with the latest action (key, label, set_at) and all actuals (key, ts, value) in order; changes are appended rows, no file is rewritten."""
    a = actions.groupBy(key).agg(F.max_by("label", "set_at").alias("user_action"))
    b = actuals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("actuals"))
    return records.join(a, key, "left").join(b, key, "left")


def runs(bundles: DataFrame, run_type: str | None = None, limit: int = 20) -> DataFrame:
    """SRC6: the latest runs (run_id, run_type, modified, ...), of one type if given."""
    got = bundles.where(F.col("run_type") == run_type) if run_type else bundles
    return got.orderBy(F.desc("modified"), "run_id").limit(limit)


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: positions of an XML information table, largest first."""
    schema = "nameOfIssuer string, cusip string, value long, shrsOrPrnAmt struct<sshPrnamt: long>, putCall string"
    got = spark.read.format("xml").option("rowTag", "infoTable").schema(schema).load(path)
    return got.select(F.col("nameOfIssuer").alias("issuer"), "cusip", F.col("value").alias("value_usd"), F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"), F.upper(F.coalesce("putCall", F.lit("LONG"))).alias("put_call")).orderBy(F.desc("value_usd"), "cusip")


def embedded_legs(pages: DataFrame, schema: str = "legs array<struct<symbol: string, quantity: int, basis: double>>") -> DataFrame:
    """SRC10: the option legs in each page's embedded JSON script, a row each."""
    body = F.regexp_extract("html", r'<script id="__NEXT_DATA__"[^>]*>([\s\S]*?)</script>', 1)
    return pages.select("page_id", F.explode(F.from_json(body, schema)["legs"]).alias("leg")).select("page_id", "leg.*")


def net_cash_flow(legs: DataFrame, by: str = "page_id") -> DataFrame:
    """AGG30: signed quantity x basis x 100, summed."""
    return legs.groupBy(by).agg(F.round(F.sum(F.col("quantity") * F.col("basis") * 100), 4).alias("net"), F.count("*").alias("legs"))


def newest_wins(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """SET3: both together, one row for each key, the new one where both have it.

    Of several rows of a side the last in order counts (by default in the order
    of all other columns, so that the choice is the same each time).
    """
    both = new.withColumn("_p", F.lit(0)).unionByName(old.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    later = [F.desc(c) for c in (order or [c for c in both.columns if c not in (key, "_p")])]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p", *later))).where("_n = 1").drop("_n", "_p")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SET2: the first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def universe(lists: list[DataFrame], extras: DataFrame, key: str = "symbol") -> DataFrame:
    """SET1: all symbols of the lists once, and those extras that are not among them, marked."""
    every = lists[0].select(key)
    for x in lists[1:]:
        every = every.union(x.select(key))
    every = every.distinct()
    return every.withColumn("extra", F.lit(False)).union(extras.select(key).distinct().join(every, key, "left_anti").withColumn("extra", F.lit(True)))


BARS = "d date, open double, high double, low double, close double, volume double"


def read_bars(spark: SparkSession, folder: str, symbols: list[str] | None = None) -> DataFrame:
    """SRC1: daily bars of a folder with a Parquet file for each symbol (SYMBOL.parquet); missing, empty and broken files are skipped."""
    df = spark.read.schema(BARS).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.parquet").parquet(folder)
    df = df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.parquet$", 1))
    return df if symbols is None else df.where(F.col("symbol").isin(*symbols))


def read_recent(records: DataFrame, limit: int, profile: str | None = None, months: list[str] | None = None, ts: str = "as_of_ts") -> DataFrame:
    """SRC4: the latest records by ts, of a profile if one is given; months (the partition ym) keep other folders unread."""
    if months is not None:
        records = records.where(F.col("ym").isin(*months))
    if profile is not None:
        records = records.where(F.col("profile") == profile)
    return records.orderBy(F.desc(ts), *(c for c in ("candidate_id",) if c in records.columns)).limit(limit)


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str, params: dict[str, str]) -> None:
    """SRC6: a run's tables (signals, trades, results, notes ...) and its parameters, each in a folder partitioned by run_id; a run is written once."""
    spark = next(iter(tables.values())).sparkSession
    every = {"params": spark.createDataFrame([(str(k), str(v)) for k, v in params.items()], "name string, value string"), **tables}
    for name, df in every.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}/run_id={run_id}")


def load_run(spark: SparkSession, folder: str, run_id: str, names: list[str]) -> dict[str, DataFrame]:
    """SRC6: the named tables of one run; only its partition is read."""
    return {n: spark.read.option("basePath", f"{folder}/{n}").parquet(f"{folder}/{n}/run_id={run_id}") for n in names}


def read_pages(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ("archive", "node_modules", "_template")) -> DataFrame:
    """SRC7: (path, html) of all HTML files below a folder but those in excluded folders and search engines' verification files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    path = F.col("path")
    skip = path.rlike("/(" + "|".join(excluded) + ")(/|$)") | path.rlike(r"/google[0-9a-f]+\.html$")
    return files.where(~skip).select("path", F.decode("content", "UTF-8").alias("html"))


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """SRC8: (name, text, d) of the Markdown files of a folder that are not blank; d is the date that the name begins with, for newest first."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.md$", 1).alias("name"), F.col("value").alias("text"))
    return files.where(F.length(F.trim("text")) > 0).withColumn("d", F.try_to_date(F.substring("name", 1, 10), "yyyy-MM-dd"))


def write_report(rows: DataFrame, folder: str, title: str, most: int = 1000) -> str:
    """SRC11: all rows as JSON lines in folder/json, and the first of them (a report, most rows at most) as a Markdown table in folder/md, returned too."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    head = rows.limit(most).collect()  # a report for reading
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in head)]
    text = "\n".join(lines)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/md")
    return text
