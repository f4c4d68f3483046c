"""Landed files and ledgers."""

from __future__ import annotations

import datetime as dt
import json

from gristmill.sources import ledger as L


def test_series_file_drops_what_is_no_value(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,X\n2024-01-01,1.5\n2024-01-02,.\n2024-01-03,\nbad,3\n2024-01-05,NA\n2024-01-06,2\n")
    got = [tuple(r) for r in L.read_series(spark, str(tmp_path / "s.csv")).collect()]
    assert got == [(dt.date(2024, 1, 6), 2.0), (dt.date(2024, 1, 1), 1.5)]
    assert L.read_series(spark, str(tmp_path / "s.csv"), "2024-01-02").count() == 1


def test_malformed_lines_are_dropped(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(json.dumps({"id": "a", "n": 1}) + "\n{broken\n" + json.dumps({"id": "b", "n": 2}) + "\n")
    assert {r.id for r in L.read_records(spark, str(tmp_path / "l.jsonl"), "id string, n int").collect()} == {"a", "b"}


def test_appends_are_idempotent(spark, tmp_path):
    rows = [("x", dt.datetime(2024, 1, 5), 1), ("x", dt.datetime(2024, 1, 6), 2), ("y", dt.datetime(2024, 2, 1), 3)]
    df = spark.createDataFrame(rows, "candidate_id string, as_of_ts timestamp, n int")
    for _ in range(2):
        L.append_records(df, str(tmp_path / "ledger"))
    got = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted((r.candidate_id, r.n, r.ym) for r in got.collect()) == [("x", 1, "2024-01"), ("y", 3, "2024-02")]


def test_holdings_from_xml(spark, tmp_path):
    item = "<infoTable><nameOfIssuer>{}</nameOfIssuer><cusip>{}</cusip><value>{}</value><shrsOrPrnAmt><sshPrnamt>{}</sshPrnamt></shrsOrPrnAmt>{}</infoTable>"
    body = item.format("A", "1", 10, 2, "") + item.format("B", "2", 30, 5, "<putCall>Put</putCall>")
    (tmp_path / "t.xml").write_text(f"<informationTable>{body}</informationTable>")
    got = [tuple(r) for r in L.read_holdings(spark, str(tmp_path / "t.xml")).collect()]
    assert got == [("B", "2", 30, 5, "PUT"), ("A", "1", 10, 2, "LONG")]


def test_legs_in_a_page(spark):
    body = json.dumps({"legs": [{"symbol": "A", "quantity": 1, "basis": 3.5}, {"symbol": "B", "quantity": -2, "basis": 1.0}]})
    pages = spark.createDataFrame([(7, f'<html><script id="__NEXT_DATA__" type="application/json">{body}</script></html>'), (8, "<html></html>")], "page_id long, html string")
    assert [tuple(r) for r in L.net_cash_flow(L.embedded_legs(pages)).collect()] == [(7, 150.0, 2)]


def test_runs_newest_first(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("c", "x", 2)], "run_id string, run_type string, modified long")
    assert [r.run_id for r in L.runs(df, "x").collect()] == ["c", "a"] and [r.run_id for r in L.runs(df, limit=1).collect()] == ["b"]


def test_bars_by_symbol_skip_broken_files(spark, tmp_path):
    import pandas as pd

    for s in ("AAA", "BBB"):
        pd.DataFrame({"d": [dt.date(2024, 1, 2)], "open": [1.0], "high": [2.0], "low": [0.5], "close": [1.5], "volume": [10.0]}).to_parquet(tmp_path / f"{s}.parquet")
    (tmp_path / "CCC.parquet").write_bytes(b"broken")
    (tmp_path / "notes.txt").write_text("x")
    got = L.read_bars(spark, str(tmp_path))
    assert {r.symbol for r in got.collect()} == {"AAA", "BBB"} and L.read_bars(spark, str(tmp_path), ["BBB"]).count() == 1


def test_runs_recent_records_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "forecast", dt.datetime(2024, 1, 2), "2024-01"), ("b", "forecast", dt.datetime(2024, 2, 2), "2024-02"), ("c", "macro", dt.datetime(2024, 3, 2), "2024-03")], "candidate_id string, profile string, as_of_ts timestamp, ym string")
    assert [r.candidate_id for r in L.read_recent(df, 1, "forecast").collect()] == ["b"] and L.read_recent(df, 5, months=["2024-01"]).count() == 1
    L.write_run({"signals": df, "trades": df.limit(0)}, str(tmp_path / "runs"), "r1", {"step": 5})
    L.write_run({"signals": df.limit(1)}, str(tmp_path / "runs"), "r2", {"step": 6})
    got = L.load_run(spark, str(tmp_path / "runs"), "r1", ["signals", "params"])
    assert got["signals"].count() == 3 and {tuple(r)[:2] for r in got["params"].collect()} == {("step", "5")}
    text = L.write_report(df.select("candidate_id", "profile").where("candidate_id = 'a'"), str(tmp_path / "report"), "T")
    assert text == "# T\n\n| candidate_id | profile |\n|---|---|\n| a | forecast |" and spark.read.json(str(tmp_path / "report/json")).count() == 1


def test_corpus_files(spark, tmp_path):
    for name, text in (("a/index.html", "<p>é</p>"), ("archive/b.html", "x"), ("google0123abc.html", "x"), ("c.txt", "x"), ("2024-02-03-x.md", "# t"), ("empty.md", " \n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert [r.html for r in L.read_pages(spark, str(tmp_path)).collect()] == ["<p>é</p>"]
    assert [(r.name, r.d) for r in L.read_articles(spark, str(tmp_path)).collect()] == [("2024-02-03-x", dt.date(2024, 2, 3))]
