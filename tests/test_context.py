"""Source checks, feeds, pillars and pages' sources: worked examples."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gristmill.operators import audit as A, context as K


def test_source_checks(spark):
    # Wednesday 2024-01-10, 15:30 in New York
    now = F.lit(dt.datetime(2024, 1, 10, 20, 30)).cast("timestamp")
    jobs = [("late", "mon-fri", 9, 0, 60), ("open", "wed", 15, 0, 60), ("other", "sat-sun", 9, 0, 60), ("none", "mon-fri", 9, 0, 60), ("fresh", "mon-fri", 9, 0, 60)]
    schedule = spark.createDataFrame(jobs, "job string, dow string, hour int, minute int, window_minutes int")
    assert {r.job for r in K.run_window(schedule, now).where("closed").collect()} == {"late", "none", "fresh"}
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    files = spark.createDataFrame([("late", "2024-01-09", 5, day(9, 9)), ("late", "empty", 0, day(8, 9)), ("open", "2024-01-09", 5, day(9, 9)), ("other", "x", 5, day(1, 9)), ("fresh", "2024-01-10", 7, day(10, 10))], "job string, stem string, size long, modified timestamp")
    pages = spark.createDataFrame([("late", "2024-01-09"), ("fresh", "2024-01-10")], "job string, stem string")
    got = {(r.job, r["class"], r.n) for r in K.integrity(files, schedule, pages, now).collect()}
    assert got == {("late", "cron_source_zero_byte", 1), ("late", "cron_source_stale", 24 * 60), ("none", "cron_source_missing", 0), ("open", "cron_source_no_html", 1)}


def test_feed_sections(spark):
    text = "intro\n## 2024-01-02 Day\nBig news\n### Signal:\n- one\n* two\n**Related:**\nx\n## 2024-01-03\nNext\n"
    got = [tuple(r) for r in K.feed_sections(spark.createDataFrame([("f", text), ("g", None)], "feed string, text string")).orderBy("d", "at").select("d", "section", "line").collect()]
    a, b = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    assert got == [(a, "headline", "Big news"), (a, "signal", "one"), (a, "signal", "two"), (a, "related", "x"), (b, "headline", "Next")]


def test_pillars_and_regime(spark):
    rows = [("A", "x", 2.0, 0.0, 1.0), ("A", "y", -0.5, 0.0, 1.0), ("A", "z", float("nan"), 0.0, 1.0), ("D", "x", -0.6, 0.0, 1.0), ("E", "x", None, 0.0, 1.0)]
    scores = K.pillar_scores(spark.createDataFrame(rows, "pillar string, component string, value double, centre double, scale double"))
    got = {r.pillar: r for r in scores.collect()}
    assert (got["A"].score, got["A"].state, got["A"].confidence, got["A"].missing) == (0.25, "improving", 0.5, "z")
    assert (got["D"].state, got["E"].state, got["E"].score) == ("deteriorating", "unavailable", 0.0)
    r = K.regime(scores, spark.createDataFrame([(24.0,)], "level double")).first()
    # logits: risk_on 0.4 - 0.54, fragile 0.2 + 0.3, transition -0.2 - 0.255, risk_off -0.25 + 0.6, bear -0.325 + 0.78
    assert r.regime == "fragile_risk_on" and r.bear_risk == pytest.approx((0.6 + 0 + 0.5) / 3, abs=1e-6) and r.bear_level == "moderate"
    assert r.against == "D deteriorating" and (r.completeness, r.status) == ("partial", "preliminary") and r.composite == pytest.approx(0.18 * 0.25 - 0.18 * 0.6, abs=1e-6)


def test_life_cycle_and_sources(spark):
    today = spark.createDataFrame([("s", "live_non_200", "high"), ("s", "missing_favicon", "medium"), ("s", "fresh", "low")], "site string, class string, severity string")
    carried = spark.createDataFrame([("s", "live_unreachable", 2), ("s", "missing_favicon", 1), ("s", "gone", 4)], "site string, class string, nights int")
    got = {r["class"]: (r.nights, r.stage, r.auto_fix) for r in A.classified(today, carried).collect()}
    assert got == {"live_non_200": (3, "escalated", False), "missing_favicon": (2, "carried", True), "fresh": (1, "new", False), "gone": (4, "resolved", False)}
    pages = spark.createDataFrame([(1, "s", "/a/2024-01-02.html"), (2, "s", "/about/"), (3, "s", "/x/")], "page_id long, site string, path string")
    md = spark.createDataFrame([("s", "2024-01-02"), ("s", "2024-01-03")], "site string, stem string")
    inline = spark.createDataFrame([("s", "/about/index.html")], "site string, path string")
    assert {(r.page_id, r.source) for r in A.source_of_truth(pages, md, inline).collect()} == {(1, "md"), (2, "inline"), (3, "hand"), (None, "orphan")}
