"""Landed provider files, nightly resolution and appends that are run again."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from gristmill.operators import forecast as P, options as O, resolution as N
from gristmill.sources import landed as L

DAY = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_chains_with_drift_and_faults(spark, tmp_path):
    call = lambda k, **more: {"strike": k, "bid": 1.0, "ask": 1.05, "volume": 50, "open_interest": 900, **more}
    docs = [
        {"symbol": "A", "expiration": "2020-02-01", "calls": [call(100), call("105.5", extra=[1])], "puts": [call(95, bid="x")]},
        {"symbol": "B", "expiry": "2020-02-01", "calls": [{"strike": 10, "bid": 2, "ask": 2.2, "vol": "60", "openInterest": "700"}], "new_field": {"a": 1}},
        {"symbol": "C", "expiration": "2020-02-01", "calls": [], "puts": []},
        {"symbol": "D", "expiration": "2020-02-01"},
        {"symbol": "E", "calls": [call(1)]},
        {"symbol": "F", "expiration": "2020-02-01", "calls": [{"bid": 1}]},
    ]
    (tmp_path / "c.jsonl").write_text("\n".join([*map(json.dumps, docs), '{"symbol": "G", "calls": [', "", "7"]))
    rows = L.read_landed(spark, str(tmp_path / "c.jsonl"), "chain").collect()
    good = {(r.underlying, r.side, r.strike): r for r in rows if r.fault is None}
    assert set(good) == {("A", "C", 100.0), ("A", "C", 105.5), ("A", "P", 95.0), ("B", "C", 10.0)}
    assert good["A", "P", 95.0].bid is None and (good["B", "C", 10.0].vol, good["B", "C", 10.0].oi) == (60, 700)
    bad = {(r.underlying, r.fault): r.rescued for r in rows if r.fault}
    assert set(bad) == {("D", "no list"), ("E", "missing expiration"), ("F", "missing strike"), (None, "malformed"), (None, "no list")}
    assert json.loads(bad["F", "missing strike"]) == {"bid": 1} and bad[None, "malformed"].startswith('{"symbol": "G"')
    quotes = L.parsed(spark.createDataFrame([(json.dumps({"ticker": s, "regularMarketPrice": "101.5", "timestamp": "2020-01-05T10:00:00Z"}),) for s in "ABD"], "value string"), "quote")
    chain = L.option_chain(L.read_landed(spark, str(tmp_path / "c.jsonl"), "chain"), quotes)
    assert {(r.underlying, r.dte, r.spot) for r in chain.collect()} == {("A", 27, 101.5), ("B", 27, 101.5)}
    assert chain.where(O.liquid()).count() >= 1


def test_other_kinds(spark):
    of = lambda kind, *docs: L.parsed(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"), kind).collect()
    (f,) = of("fundamentals", {"symbol": "A", "trailingPE": "n/a", "sharesShort": 12.0, "earningsTimestamp": 1577836800})
    assert (f.fault, f.trailing_pe, f.report_epoch) == (None, None, 1577836800)
    n = of("news", {"ticker": "A", "headline": "up", "pubDate": "2020-01-05T00:00:00Z"}, {"ticker": "A"}, {"symbol": None, "title": "x"})
    assert [r.fault for r in n] == [None, "missing text", "missing symbol"] and n[1].rescued
    p = of("probe", {"host": "s", "class": "apex", "status_code": "403", "text": "a challenge"}, {"site": "s", "kind": "www", "status": "down"})
    assert (p[0].site, p[0].kind, p[0].status, p[1].fault) == ("s", "apex", 403, "missing status")


def market(spark, n=200):
    rnd = np.random.default_rng(5)
    rows = [(s, DAY(i), *[float(c)] * 4, 100) for s in "ab" for i, c in enumerate(100 * np.exp(np.cumsum(rnd.normal(0, 0.01, n)))) if DAY(i).weekday() < 5]
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume long").cache()


def test_nights_resolve_each_horizon_once(spark, tmp_path):
    bars = market(spark)
    bands = P.bands(bars).withColumn("id", F.concat_ws("-", "symbol", "d")).coalesce(2).cache()
    bands.count()
    records = bands.select("id", F.lit("forecast").alias("profile"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("date").alias("last_resolved"), F.col("d").alias("as_of")).distinct()
    path = str(tmp_path / "outcomes")
    nights = [DAY(90), DAY(140), DAY(199)]
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("id", "horizon", "actual", "mfe", "mae", "in68", "in90", "error").collect())
    for night in nights:
        N.resolve_night(records, bands, bars, path, night)
    once = read()
    for night in nights[1:2]:  # a night that is run again adds nothing
        N.resolve_night(records, bands, bars, path, night)
    assert read() == once and len({r[:2] for r in once}) == len(once)
    whole = P.resolved(bands, bars).join(bands.select("symbol", "d", "horizon", "id"), ["symbol", "d", "horizon"])
    assert once == sorted(tuple(r) for r in whole.select("id", "horizon", "actual", "mfe", "mae", "in68", "in90", "error").collect())
    closed = records.withColumn("label", F.when(F.col("id").startswith("a"), "closed"))
    due = N.due_outcomes(closed, bands, bars, spark.createDataFrame([], "id string, horizon int"), DAY(199))
    assert {r.symbol for r in due.select("symbol").distinct().collect()} == {"b"}


def test_streams_append_each_id_once(spark, tmp_path):
    schema = "id string, ts timestamp, v int"
    at = dt.datetime(2024, 1, 1)
    for k, rows in enumerate([[("x", at, 1), ("x", at, 1), ("y", at, 2), (None, at, 0)], [("y", at, 3), ("z", at, 4)], [("x", at, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    out = str(tmp_path / "ledger")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        N.append_once(stream, out, "id", "ts", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.v) for r in spark.read.parquet(out).collect())

    assert run("ck") == [("x", 1), ("y", 2), ("z", 4)]
    assert run("ck") == [("x", 1), ("y", 2), ("z", 4)]
    assert run("lost") == [("x", 1), ("y", 2), ("z", 4)]  # every batch is replayed
