"""Two-sided as-of joins and event features against plain loops."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from gristmill.operators import events as E

DAY = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_the_events_before_and_after(spark):
    rnd = random.Random(6)
    left = [(rnd.choice("abc"), DAY(rnd.randrange(40)), i) for i in range(120)] + [("a", None, 900), (None, DAY(3), 901), ("z", DAY(3), 902)]
    events = [(rnd.choice("ab"), DAY(rnd.randrange(40)), rnd.randrange(3)) for _ in range(25)] + [("a", None, 1), (None, DAY(1), 7)]
    got = E.around(spark.createDataFrame(left, "k string, t date, i int"), spark.createDataFrame(events, "k string, at date, v int"), "k", "t", "at", ("v",))
    rows = {r.i: (tuple(r.previous) if r.previous else None, tuple(r.next) if r.next else None) for r in got.collect()}
    assert len(rows) == len(left)
    for k, t, i in left:
        own = [(at, v) for key, at, v in events if key == k and at and t]
        before, after = [x for x in own if x[0] <= t], [x for x in own if x[0] > t]
        first = min((x[0] for x in after), default=None)
        assert rows[i] == (max(before, default=None), max((x for x in after if x[0] == first), default=None)), (k, t)


def test_reports_of_the_day_are_no_days_away(spark):
    rows = spark.createDataFrame([("a", DAY(n)) for n in (0, 5, 7)], "symbol string, d date")
    bars = spark.createDataFrame([("a", DAY(n), 10.0 + n, 100) for n in range(8)], "symbol string, d date, close double, volume long")
    reports = spark.createDataFrame([("a", DAY(5), 2.5), ("a", DAY(9), None)], "symbol string, d date, surprise_pct double")
    shorts = spark.createDataFrame([("a", DAY(1), 300), ("a", DAY(6), 450)], "symbol string, d date, shares long")
    got = {r.d: r for r in E.event_features(rows, E.spike_drift(bars), reports, shorts).collect()}
    assert (got[DAY(0)].days_since_report, got[DAY(0)].days_to_report, got[DAY(0)].days_to_cover) == (None, 5, None)
    assert (got[DAY(5)].days_since_report, got[DAY(5)].days_to_report, got[DAY(5)].surprise_pct, got[DAY(5)].days_to_cover) == (0, 0, 2.5, 3.0)
    assert (got[DAY(7)].days_since_report, got[DAY(7)].days_to_report, got[DAY(7)].short_change) == (2, 2, 0.5)
    assert abs(got[DAY(7)].report_drift - (17 / 15 - 1)) < 1e-12


def test_drift_takes_only_spikes_whose_bars_are_over(spark):
    rnd = random.Random(3)
    bars = [(i, 100 + rnd.random(), 100 if i % 13 else 1000) for i in range(90)]
    df = spark.createDataFrame([("a", DAY(i), c, v) for i, c, v in bars], "symbol string, d date, close double, volume long")
    got = {r.d: r.earnings_drift for r in E.spike_drift(df).collect()}
    for t in range(90):
        moves = [bars[i + 5][1] / bars[i][1] - 1 for i in range(19, t - 4) if bars[i][2] > 2 * sum(b[2] for b in bars[i - 19 : i + 1]) / 20]
        want = sum(moves) / len(moves) if moves else None
        assert (got[DAY(t)] is None) == (want is None) and (want is None or abs(got[DAY(t)] - want) < 1e-12)


def test_upcoming_and_recent(spark):
    events = spark.createDataFrame([("a", DAY(1)), ("b", DAY(1)), ("a", DAY(5)), ("b", DAY(9)), ("c", DAY(30))], "symbol string, d date")
    today = F.lit(DAY(5))
    assert [(r.symbol, r.days) for r in E.upcoming(events, today, 10).collect()] == [("a", 0), ("b", 4)]
    assert [(r.symbol, r.days) for r in E.recent(events, today, 1).collect()] == [("a", -4)]
