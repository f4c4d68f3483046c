"""Queries on walks that fall to a price of 0 and rise beyond a BIGINT of ticks, as repeated tables give them, against their SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pytest

from gristmill.operators import charts as C, indicators as I, macro as M, scoring as S
from gristmill.plans.registry import ORACLE_SQL, QUERIES
from gristmill.sources import views as V

from .test_queries import SF, plain

#: Steps so many times as large, as from so many copies of the tables: at 70 closes reach 0 and 1.4E18 ticks, and the SQL still runs; at 600 it doesn't.
STEEP, STEEPEST = 70, 600


def walk(folder, k: int) -> tuple[str, duckdb.DuckDBPyConnection]:
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(p)
        if name == "lineitem.parquet":
            con.execute(f"COPY (SELECT * REPLACE ((5 + {k} * (ROUND(l_discount * 100) - 5)) / 100 AS l_discount) FROM '{p}') TO '{folder}/{name}' (FORMAT parquet)")
        else:
            os.symlink(p, folder / name)
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return str(folder), con


@pytest.fixture(scope="module")
def steep(tmp_path_factory):
    return walk(tmp_path_factory.mktemp("steep"), STEEP)


@pytest.fixture(scope="module")
def steepest(tmp_path_factory):
    return walk(tmp_path_factory.mktemp("steepest"), STEEPEST)


def assert_same(spark, name: str, sf_dir: str, con, sql: str) -> None:
    got = QUERIES[name](spark, sf_dir).toPandas()
    spark.catalog.clearCache()
    a, b = plain(got), plain(con.execute(sql).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c].astype(float), rtol=2e-6, atol=2e-6, equal_nan=True, err_msg=c)
        else:
            assert (a[c] == b[c]).all(), c


@pytest.mark.parametrize("name", [
    "agg01_weekly_bars",
    "agg05_volume_profile",
    "agg02_day_of_week_drift",
    "agg03_month_of_year_drift",
    "agg07_z_scores",
    "agg25_scan_summary",
    "agg31_survivors",
    "agg16_calibration",
    "agg17_symbol_status",
    "agg17_symbol_calibration",
    "dom01_event_features",
    "dom01_price_features",
    "dom01_features",
    "top01_by_sector",
    "dom04_submetric_scores",
    "dom05_breakdown",
    "dom05_rank",
    "agg13_backtest_summary",
    "agg14_symbol_summary",
    "dom27_forecast",
    "agg15_pattern_stats",
    "agg16_pattern_calibration",
    "agg18_gate",
    "dom25_expected_moves",
    "dom36_deep_layers",
])
def test_closes_of_zero(spark, steep, name):
    assert_same(spark, name, *steep, ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["agg01_weekly_bars", "agg05_volume_profile"])
def test_ticks_beyond_bigint(spark, steepest, name):
    sql = ORACLE_SQL[name]
    with pytest.raises(duckdb.ConversionException):
        steepest[1].execute(sql)
    wide = V.SQL["bars"].replace("CAST(ROUND(1E6", "(ROUND(1E6").replace(" AS BIGINT) AS ct", ") AS ct").replace("CAST(FLOOR", "(FLOOR").replace("(n*1E3)) AS BIGINT)", "(n*1E3)))")
    assert_same(spark, name, *steepest, sql.replace(V.SQL["bars"], wide))


def daily(spark, closes, symbol="A"):
    day = np.datetime64("2000-01-01")
    return spark.createDataFrame([(symbol, (day + i).item(), *[float(c)] * 4, 1000) for i, c in enumerate(closes)], "symbol string, d date, open double, high double, low double, close double, volume bigint")


def fall(n: int) -> np.ndarray:
    """Closes that fall steeply from 1E80, faster than averages forget, and end level."""
    return np.maximum(1e80 * 0.5 ** np.arange(n), 1.0) + np.arange(n) % 3


@pytest.mark.parametrize("alpha", [2 / 10, 2 / 13, 1 / 14])
def test_averages_remember_a_steep_fall(spark, alpha):
    x = fall(1400)
    got = I.with_ewm(daily(spark, x), "close", alpha, "y").orderBy("d").toPandas()["y"]
    want = [x[0]]
    for v in x[1:]:
        want.append((1 - alpha) * want[-1] + alpha * v)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_last_features_remember_a_steep_fall(spark):
    bars = daily(spark, fall(1000))
    every, last = (S.price_features(bars, bars, last_only=x).orderBy("d").toPandas().iloc[-1] for x in (False, True))
    np.testing.assert_allclose(last[list(S.PRICE_FIELDS)].astype(float), every[list(S.PRICE_FIELDS)].astype(float), rtol=1e-9)


def test_drawdown_of_closes_of_zero(spark):
    bars = daily(spark, [1.0] * 5 + [0.0] * 70)
    got = I.max_drawdown(bars).orderBy("d").toPandas()["drawdown"]
    want = duckdb.sql("SELECT i, MIN(c / peak - 1) AS dd FROM (SELECT i, c, MAX(c) OVER (PARTITION BY i ORDER BY j) AS peak FROM (SELECT i, j, CASE WHEN j < 5 THEN 1E0 ELSE 0E0 END AS c FROM range(59, 75) a(i), range(75) b(j) WHERE j BETWEEN i - 59 AND i) x) y GROUP BY 1 ORDER BY 1").df()["dd"]
    np.testing.assert_array_equal(got[59:], want)
    feature = S.price_features(bars, daily(spark, [1.0] * 75, "MKT")).orderBy("d").toPandas()
    np.testing.assert_array_equal(feature.set_index("rn").loc[60:, "max_dd_60d"], want)


def test_flag_behind_a_steep_move(spark):
    level = [1.0, 1e-9, 1.0] + [1.0 + 0.001 * (i % 2) for i in range(60)]  # a return of 1E9 long before
    pole = [1.0 + 0.02 * i for i in range(1, 9)]
    calm = [1.16 + 0.0005 * (i % 2) for i in range(8)]
    bars = daily(spark, level + pole + calm)
    got = C.flags(bars).toPandas()
    assert list(got["pattern"]) == ["bull_flag"]
    near = C.flags(daily(spark, level[3:] + pole + calm)).toPandas()
    assert got.drop(columns="symbol").equals(near.drop(columns="symbol"))


@pytest.mark.parametrize("steep, size, found", [([1.0, 0.0], 0.01, ["rectangle"]), ([1.0, 1e-9], 0.4, [])], ids=["calm", "wild"])
def test_chart_behind_a_steep_move(spark, steep, size, found):
    level = [1.0 + size * abs((i % 16) - 8) / 8 for i in range(120)]  # swings every 16 bars, below and above the deviation of a rectangle
    got = C.rectangles(daily(spark, steep + level)).toPandas()
    assert list(got["pattern"]) == found
    near = C.rectangles(daily(spark, [1.0, 1.5] + level)).toPandas()  # as many bars, without a steep move
    assert got.equals(near)


def test_states_around_closes_of_zero(spark):
    rnd = np.random.default_rng(3)
    walk_of = lambda n: 100 * np.exp(np.cumsum(rnd.normal(0, np.repeat([0.01, 0.03, 0.09], n // 3))))
    closes = np.concatenate([walk_of(120), np.zeros(5), walk_of(150)])
    bars = daily(spark, closes).union(daily(spark, walk_of(240), "B"))
    got = M.volatility_states(bars).orderBy("symbol", "d").toPandas()
    assert got["symbol"].value_counts().to_dict() == {"A": 275 - 21, "B": 240 - 21}  # no bar with 21 returns is lost
    returns = np.arange(1, 275)
    bad = (returns >= 120) & (returns <= 125)  # into, within and out of the closes of 0
    undefined = np.array([bad[i - 20 : i + 1].any() for i in range(20, 274)])
    assert 0 < undefined.sum() < len(undefined)
    np.testing.assert_array_equal(got.loc[got["symbol"] == "A", "state"].isna(), undefined)
    known = got.dropna(subset="state")
    assert set(known["state"]) == {0, 1, 2} and known.groupby("state")["rv"].mean().is_monotonic_increasing
    moves = M.transitions(spark.createDataFrame(got[["symbol", "d", "state"]].astype({"state": object}).where(got.notna(), None), "symbol string, d date, state double")).toPandas()
    pairs = int((~undefined[1:] & ~undefined[:-1]).sum()) + 240 - 22  # none across the gap
    assert moves["n"].sum() == pairs and moves.notna().all().all()
    np.testing.assert_allclose(moves.groupby("from")["share"].sum(), 1, atol=1e-5)
