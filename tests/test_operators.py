"""Operators that SQL can't express, worked examples and invariants."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.functions import normal, text as X
from gristmill.operators import audit as D, content as C, forecast as P, indicators as I, macro as M, options as O, scoring as S
from gristmill.streaming import attempts as A, horizons as H, ticks as K


@pytest.fixture(scope="module")
def bars(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for s in "ab":
        close = 100 * np.exp(np.cumsum(rnd.normal(0, 0.01, 330)))
        for i, c in enumerate(close):
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(c * 0.999), float(c * 1.01), float(c * 0.99), float(c), int(rnd.integers(100, 1000))))
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume long").cache()


def series(df, symbol="a"):
    return df.where(F.col("symbol") == symbol).orderBy("d").toPandas()


def test_exponential_averages_equal_the_recursion(bars):
    close = series(bars)["close"]
    macd = close.ewm(alpha=2 / 13, adjust=False).mean() - close.ewm(alpha=2 / 27, adjust=False).mean()
    signal = macd.ewm(alpha=0.2, adjust=False).mean()
    got = series(I.macd(bars))
    np.testing.assert_allclose(got["hist"][34:], (macd - signal)[34:], atol=1e-5)
    assert got["hist"][:34].isna().all()
    change = close.diff()
    gain, loss = (x.clip(lower=0)[1:].ewm(alpha=1 / 14, adjust=False).mean() for x in (change, -change))
    np.testing.assert_allclose(series(I.rsi(bars))["rsi"][20:], (100 - 100 / (1 + gain / loss))[19:], atol=1e-4)


def test_no_indicator_looks_ahead(bars):
    cut = dt.date(2020, 9, 1)
    for f in (I.moving_averages, I.rsi, I.macd, I.max_drawdown, I.trend_slope, I.accumulation, I.volatility_percentile, I.average_true_range):
        whole = f(bars).where(F.col("d") <= F.lit(cut))
        assert whole.exceptAll(f(bars.where(F.col("d") <= F.lit(cut)))).count() == 0


def test_percentile_ranks_share_ties_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0), (4, None), (5, 3.0)], "k int, v double").withColumn("g", F.lit(1))
    got = {r.k: r.p for r in df.select("k", I.percentile_rank("v", "g").alias("p")).collect()}
    assert got.pop(4) is None and got == pytest.approx({1: 100 / 6, 2: 100 / 6, 3: 100.0, 5: 200 / 3})


def test_normal_integral(spark):
    xs = [-4.0, -1.5, -0.1, 0.0, 0.3, 1.0, 2.5, 5.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.cdf(F.col("x")).alias("p")).collect()]
    assert max(abs(g - 0.5 * (1 + math.erf(x / math.sqrt(2)))) for g, x in zip(got, xs, strict=True)) < 7.6e-8


def test_implied_volatility_inverts_the_price(spark):
    df = spark.createDataFrame([(100.0, k, 0.25, v, s) for k in (80.0, 100.0, 125.0) for v in (0.1, 0.4, 1.2) for s in "CP"], "spot double, strike double, t double, v double, side string")
    cols = F.col("spot"), F.col("strike"), F.col("t")
    got = df.withColumn("p", O.price(*cols, F.col("v"), F.col("side"))).withColumn("iv", O.implied_volatility(F.col("p"), *cols, F.col("side"))).where("p > 0.01").collect()
    assert len(got) > 10 and all(abs(r.iv - r.v) < 1e-3 for r in got)
    assert df.select(O.implied_volatility(F.lit(500.0), *cols, F.col("side")).alias("x")).where("x is not null").count() == 0


def test_spread_algebra(spark):
    """Without a gap between bid and ask both sides of a trade mirror each other."""
    rows = [("X", 30, "C", 100.0, 4.0, 100.0, 0.3, 500), ("X", 30, "C", 105.0, 2.0, 100.0, 0.3, 400), ("X", 30, "P", 95.0, 1.5, 100.0, 0.3, 300), ("X", 30, "P", 100.0, 3.5, 100.0, 0.3, 200)]
    chain = spark.createDataFrame(rows, "underlying string, dte int, side string, strike double, mid double, spot double, iv double, oi long").withColumn("bid", F.col("mid")).withColumn("ask", F.col("mid"))
    got = {r.kind: r for r in O.verticals(chain).collect()}
    assert (got["bull_call"].max_loss, got["bull_call"].max_gain, got["bull_call"].breakeven) == (2.0, 3.0, 102.0)
    assert (got["call_credit"].max_loss, got["call_credit"].max_gain, got["call_credit"].breakeven) == (3.0, 2.0, 102.0)
    assert (got["put_credit"].max_gain, got["put_credit"].breakeven, got["bear_put"].breakeven) == (2.0, 98.0, 98.0)
    assert all(0 <= r.pop <= 1 for r in got.values())


def test_forecast_bands_are_ordered_and_point_in_time(bars):
    got = P.bands(bars)
    assert got.where("not (lo90 <= lo68 and lo68 <= median and median <= hi68 and hi68 <= hi90)").count() == 0
    cut = F.lit(dt.date(2020, 8, 1))
    assert got.where(F.col("d") <= cut).exceptAll(P.bands(bars.where(F.col("d") <= cut))).count() == 0


def test_as_of_joins_against_pandas(spark):
    rnd = random.Random(1)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    left = spark.createDataFrame([(rnd.choice("ab"), day(rnd.randrange(100))) for _ in range(60)], "k string, t date").distinct()
    right = spark.createDataFrame([(k, day(n), float(n)) for k in "ab" for n in rnd.sample(range(100), 30)], "k string, rt date, v double")
    a, b = left.toPandas(), right.toPandas()
    for forward in (False, True):
        got = P.as_of(left, right, "k", "t", "rt", "v", forward).toPandas()
        for _, r in got.iterrows():
            near = b[(b.k == r.k) & ((b.rt >= r.t) if forward else (b.rt <= r.t))].sort_values("rt")
            want = (near.iloc[0] if forward else near.iloc[-1]).v if len(near) else None
            assert (pd.isna(r.v) and want is None) or r.v == want
        assert len(got) == len(a)


def test_text_functions(spark):
    df = spark.createDataFrame([("<p>Hi <b>you</b>&amp;</p><script>x<y</script><!-- c -->", "buy $AAPL and $msft $AAPL", "AAPL  240119C00187500", "---\ntitle: A b\ntags: x, y\n---\nbody")], "html string, msg string, osi string, md string")
    r = df.select(X.visible_text(F.col("html")).alias("t"), X.cashtags(F.col("msg")).alias("c"), X.option_symbol(F.col("osi")).alias("o"), X.front_matter(F.col("md")).alias("m"), X.slug(F.lit(" Hello, World! ")).alias("s"), X.source_tier(F.lit("x.gov")).alias("tier")).first()
    assert (r.t, r.c, r.m, r.s, r.tier) == ("Hi you", ["AAPL", "MSFT"], {"title": "A b", "tags": "x, y"}, "hello-world", 1)
    assert (r.o.root, r.o.expiry, r.o.side, r.o.strike) == ("AAPL", dt.date(2024, 1, 19), "C", 187.5)


def test_findings_and_decisions(spark):
    good = '<html><head><link rel="canonical" href="/a"><title>T</title></head><body><h1>x</h1>' + "word " * 400 + "</body></html>"
    bad = "<html><h1>x</h1><h1>y</h1><!-- ad 1 --><!-- ad 1 -->"
    pages = spark.createDataFrame([(1, "http://a.b/x", good), (2, "http://a.b/y?q", bad), (3, "http://a.b/z", None)], "page_id long, url string, html string")
    got = {(r.page_id, r["class"]) for r in C.findings(pages).collect()}
    assert not any(p == 1 for p, _ in got) and {c for p, c in got if p == 2} == {"unclosed_document", "no_canonical", "h1_count", "duplicate_ad", "thin_page", "query_url"}
    checked = spark.createDataFrame([(True,), (True,), (False,)], "verified boolean")
    assert C.claim_decision(checked).first().decision == "needs_revision" and C.claim_decision(checked, False).first().decision == "reject"


def slug_pairs(sets: dict) -> dict:
    got = {}
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and round(len(x & y) / len(x | y), 6) >= 0.5:
            got[a, b] = round(len(x & y) / len(x | y), 6)
    return got


def test_similar_slugs_of_frequent_words(spark):
    sets = {i: {"common", "often", f"a{i}", f"b{i}", f"c{i}"} for i in range(1010)} | {1010: {"common", "often"}, 1011: {"often", "common"}}
    got = C.similar_slugs(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "slug long, words array<string>")).collect()
    assert len(got) == 1 and tuple(got[0]) == (1010, 1011, 1.0)


@pytest.mark.parametrize("block", [3, 1000])
def test_similar_slugs_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rnd = random.Random(2)
    sets = {i: {f"w{int(rnd.random() ** 2 * 12)}" for _ in range(rnd.randrange(7))} for i in range(150)}
    got = C.similar_slugs(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "slug long, words array<string>")).collect()
    assert len(got) == len(slug_pairs(sets)) and {(r.slug, r.other): r.jaccard for r in got} == slug_pairs(sets)


def test_lockouts_batch_and_stream_agree(spark, tmp_path):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(4), base + dt.timedelta(seconds=i * 40), rnd.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "ip long, ts timestamp, ok boolean")
    want = []
    for ip in range(4):
        state = (0, 0.0, 0.0)
        for _, ts, ok in (r for r in rows if r[0] == ip):
            state, lock = A.step(state, ts.replace(tzinfo=dt.timezone.utc).timestamp(), ok, 3, 600, 900)
            if lock:
                want.append((ip, lock[0]))
    as_rows = lambda d: sorted((r.ip, r.locked_at.replace(tzinfo=dt.timezone.utc).timestamp()) for r in d.collect())
    assert as_rows(A.lockouts(df, 3)) == sorted(want) and want
    for i in range(2):
        spark.createDataFrame(rows[i * 200 : (i + 1) * 200], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = A.streaming_lockouts(stream, 3).writeStream.format("memory").queryName("locks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert as_rows(spark.table("locks")) == sorted(want)


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("s", base + dt.timedelta(minutes=7 * i), float((i * 37) % 11), 1) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = K.hourly_bars(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {r.start: tuple(r) for r in spark.table("hours").collect()}
    want = {r.start: tuple(r) for r in K.hourly_bars(df).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 3


def test_rank_worked_example(spark):
    """Three symbols with three fields: the scores by hand."""
    known = {"trailing_pe": [22.0, 41.0, 5.0], "roe": [0.1, None, 0.3], "range_pctile": [50.0, 80.0, 5.0]}
    rows = [(s, dt.date(2024, 1, 2), 300, 10.0, None, t, u, *(float(known[f][i]) if f in known and known[f][i] is not None else None for f in S.FIELDS)) for i, (s, t, u) in enumerate((("a", "uptrend", "breakout"), ("b", "range", "reversal"), ("c", "downtrend", "unknown")))]
    schema = "symbol string, d date, rn int, close double, fwd20 double, trend string, setup string, " + ", ".join(f"{f} double" for f in S.FIELDS)
    df, spec, setups = spark.createDataFrame(rows, schema), S.spec_table(spark, ("default",)), S.setup_table(spark)
    got = {(r.symbol, r.sub_metric): r.score for r in S.submetric_scores(df, spec, setups).collect()}
    assert got["a", "trailing_pe"] == 100 and got["b", "trailing_pe"] == pytest.approx(100 * (60 - 41) / (60 - 22)) and got["c", "trailing_pe"] == pytest.approx(100 * (5 - 3) / (8 - 3))
    assert (got["a", "roe"], got["b", "roe"], got["c", "roe"]) == (0, None, 100) and got["b", "range_percentile"] == pytest.approx(50) and got["c", "range_percentile"] == 0
    assert (got["a", "setup_type"], got["b", "setup_type"], got["c", "setup_type"]) == (100, 50, 50) and ("a", "forward_pe") not in got
    legacy = {(r.symbol, r.sub_metric): r.score for r in S.submetric_scores(df, spec, setups, legacy_missing=True).collect()}
    assert (legacy["b", "roe"], legacy["a", "roe"], legacy["c", "roe"]) == (0, 50, 100)
    ranked = {r.symbol: r for r in S.rank(df, spec, setups).collect()}
    # a: valuation 100, quality_growth 0, setup_quality (0.4 * 100 + 0.2 * 100) / 0.6
    assert ranked["a"].score == pytest.approx((0.12 * 100 + 0.12 * 0 + 0.10 * 100) / 0.34, abs=1e-6)
    assert ranked["b"].score == pytest.approx((0.12 * 50 + 0.12 * 50 + 0.10 * 50) / 0.34, abs=1e-6) and ranked["b"].label == "Watchlist"


def test_rank_labels_and_classes(spark):
    df = spark.createDataFrame([(70.0, "range", "reversal"), (69.9, "uptrend", "breakout"), (30.0, "downtrend", "x"), (30.0, "range", "x")], "score double, trend string, setup string")
    label = S.label(F.col("score"), F.col("trend"), F.col("setup"))
    assert [r[0] for r in df.select(label).collect()] == ["Research candidate", "Watchlist", "Avoid", "Watchlist"]
    strict = S.label(F.col("score"), F.col("trend"), F.col("setup"), "uptrend", ("breakout",))
    assert df.select(strict).first()[0] == "Watchlist"
    cases = [(105.0, 102.0, 100.0, 105.0, 0.01, 0.02, "uptrend", "breakout"), (101.0, 102.0, 100.0, 105.0, 0.005, 0.02, "range", "pullback_retest"), (90.0, 95.0, 100.0, 99.0, -0.01, -0.05, "downtrend", "mean_reversion"), (97.0, 98.0, 100.0, 99.0, 0.02, 0.05, "transitioning", "range_approach"), (100.0, 99.0, None, 105.0, 0.0, 0.0, "n/a", "unavailable")]
    df = spark.createDataFrame([c[:6] for c in cases], "c double, a double, b double, h double, r5 double, r20 double")
    c, a, b, h, r5, r20 = (F.col(x) for x in df.columns)
    assert [tuple(r) for r in df.select(S.trend_class(c, a, b, r5, r20), S.setup_class(c, a, b, h, r5, r20)).collect()] == [c[6:] for c in cases]
    macro = spark.createDataFrame([(0.5, "risk_on")], "bear_risk double, regime string")
    w = {r.factor: r.factor_weight for r in S.tilted(S.spec_table(spark, ("default",)), macro).collect()}
    assert w["valuation"] == 0.17 and w["technical_momentum"] == 0.08 and w["setup_quality"] == 0.10


def test_averages_on_long_histories(spark):
    rnd = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rnd.normal(0, 0.01, 10_000)))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "d": pd.date_range("1990-01-01", periods=10_000).date, "close": close}))
    got = df.transform(lambda x: I.macd(x)).orderBy("d").toPandas()
    x = pd.Series(close)
    macd = x.ewm(alpha=2 / 13, adjust=False).mean() - x.ewm(alpha=2 / 27, adjust=False).mean()
    np.testing.assert_allclose(got["hist"][34:], (macd - macd.ewm(alpha=0.2, adjust=False).mean())[34:], atol=1.1e-5)


def test_unfilled_gaps(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    bars = [(0, 10.0, 9.0), (1, 12.0, 11.0), (2, 12.5, 11.5), (3, 9.9, 9.0), (4, 7.0, 6.0), (5, 7.5, 6.5)]
    df = spark.createDataFrame([("a", day(i), lo, hi, lo, lo, 1) for i, hi, lo in bars], "symbol string, d date, open double, high double, low double, close double, volume long")
    assert {(r.d, r.side, r.edge, r.age) for r in I.unfilled_gaps(df).collect()} == {(day(3), "down", 11.5, 2), (day(4), "down", 9.0, 1)}


def test_spreads_at_bid_and_ask(spark):
    rows = [("x", "stock", 100.0, 30, "C", 100.0, 2.0, 2.2, 2.1, 500, 90, 0.2), ("x", "stock", 100.0, 30, "C", 105.0, 0.8, 0.9, 0.85, 300, 90, 0.2), ("x", "stock", 100.0, 30, "C", 110.0, 0.2, 0.3, 0.25, 300, 90, 0.2), ("x", "stock", 100.0, 30, "C", -5.0, 105.0, 106.0, 105.5, 300, 90, 0.2)]
    chain = spark.createDataFrame(rows, "underlying string, tier string, spot double, dte int, side string, strike double, bid double, ask double, mid double, oi long, vol long, iv double")
    got = {(r.low_strike, r.kind): r for r in O.verticals(chain).collect()}
    bull, credit = got[100.0, "bull_call"], got[100.0, "call_credit"]
    assert (round(bull.premium, 6), round(bull.max_gain, 6), round(bull.breakeven, 6)) == (1.4, 3.6, 101.4) and bull.edge == pytest.approx(3.6 / 1.4)
    assert (round(credit.max_gain, 6), round(credit.max_loss, 6), round(credit.breakeven, 6)) == (1.1, 3.9, 101.1) and credit.pop == pytest.approx(1 - bull.pop)
    fly = O.flies(chain, spark.createDataFrame([("x", 30, "C", 105.0, 5.0)], "underlying string, dte int, side string, centre double, wing double")).first()
    assert round(fly.debit, 6) == round(2.2 + 0.3 - 2 * 0.8, 6) and round(fly.max_gain, 6) == 4.1
    pinned = O.butterfly_at_target(chain, spark.createDataFrame([("x", 104.0)], "underlying string, target double"))
    assert pinned.count() == 0  # wings of 2 and 1 have no strikes


def test_blocks_and_repairs(spark):
    box = '<div class="eeat-block"><div>a<div>b</div></div><p>c</p></div>'
    tag = lambda s: f'<ins class="adsbygoogle" data-ad-slot="{s}"></ins>'
    pair = "<p><em>Sources: a</em></p>\n<p><em>Disclaimer: b</em></p>"
    html = f"<body><div>x</div>{box}<div>y</div>{tag(1)}t{tag(2)}u{tag(1)}v<ins class=\"adsbygoogle\"></ins>id=G-G-AB1 {pair}<hr>{pair}\n<hr/>{pair}end</body>"
    df = spark.createDataFrame([(html,), ("<p>none</p>",)], "h string")
    h = F.col("h")
    r, plain = df.select(D.block(h).alias("box"), D.without_double_slots(h).alias("slots"), D.repaired_ids(h).alias("ids"), D.without_double_footer(h).alias("foot")).collect()
    assert r.box == box and plain.box is None and plain.foot == "<p>none</p>" == plain.slots
    assert r.slots.count('slot="1"') == 1 and r.slots.count('slot="2"') == 1 and r.slots.count("<ins") == 3 and "u" + "v" in r.slots
    assert "id=G-AB1" in r.ids and "G-G-" not in r.ids and r.foot.count("Sources:") == 1 and r.foot.endswith("end</body>") and "<hr" not in r.foot
    links = spark.createDataFrame([("/articles1/",), ("/news/3_x",), ("/plain/",)], "t string").select(D.link_candidates(F.col("t"))).collect()
    assert [x[0] for x in links] == [["/articles/1/", "/articles/"], ["/news/3/"], []]
    kinds = spark.createDataFrame([("about/index.html",), ("/articles/2/",), ("/articles/a-b.html",), ("/reviews/",), ("/x/tax",), ("/stories/x/",)], "p string").select(D.page_type(F.col("p"))).collect()
    assert [x[0] for x in kinds] == ["legal_umbrella", "other", "content_article", "other", "other", "content_article"]
    lines = spark.createDataFrame([("s", 1, "/a /b 301"), ("s", 2, "/lonely"), ("s", 3, "# c"), ("s", 4, " ")], "site string, line int, text string")
    assert [r.line for r in D.redirect_findings(lines).collect()] == [2]


def test_markdown_and_document_parts(spark):
    md = "| a | b |\n|---|---|\n| 1 | 2 |\ntext"
    df = spark.createDataFrame([("<h2>T</h2><p>a <b>b</b> <a href=\"/x\">y</a></p><ul><li>i</li></ul>", md, "one\n___\ntwo\n_____\n", "a **b** <c> `d` [e](/f)", ".AAPL240119C187.5", "long MSFT, bought TSLA calls, $AAPL")], "h string, t string, s string, m string, o string, c string")
    r = df.select(X.to_markdown(F.col("h")).alias("h"), X.table_rows(F.col("t")).alias("t"), X.sections(F.col("s")).alias("s"), X.from_markdown_inline(F.col("m")).alias("m"), X.short_option_symbol(F.col("o")).alias("o"), X.contextual_tickers(F.col("c")).alias("c"), X.long_date(F.lit(dt.date(2026, 9, 7))).alias("d"),
                  X.topic_line(F.lit("Macro"), F.array(F.lit("rates"), F.lit("macro")), F.array(F.lit("SPY")), F.lit("The Fed cuts again")).alias("l")).first()
    assert r.h == "## T\n\na **b** [y](/x)\n\n- i" and r.t == [["a", "b"], ["1", "2"]] and r.s == ["one", "two"]
    assert r.m == 'a <strong>b</strong> &lt;c&gt; <code>d</code> <a href="/f">e</a>' and r.o.strike == 187.5 and r.o.root == "AAPL"
    assert r.c == ["AAPL", "TSLA", "MSFT"] and r.d == "September 7, 2026" and r.l == "macro rates SPY cuts again"


def test_streams_of_findings_prices_and_records(spark, tmp_path):
    def run(df, schema, build, name, mode="append"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
        q.awaitTermination()
        return spark.table(name).collect()

    def land(name, batches, schema):
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    night = lambda n: dt.datetime(2024, 1, 1, 3) + dt.timedelta(days=n)
    schema = "site string, class string, ts timestamp"
    land("nights", [[("s", "a", night(n))] + [("s", "b", night(0))] * (n == 0) for n in range(6)], schema)
    got = {(r["class"], r.stage, r.nights) for r in run(None, schema, A.streaming_life_cycle, "nights")}
    assert {("a", "new", 1), ("a", "carried", 2), ("a", "escalated", 6), ("b", "new", 1), ("b", "resolved", 1)} <= got
    schema = "candidate_id string, ts timestamp, v int"
    land("records", [[("x", night(0), 1), ("x", night(0), 2), ("y", night(0), 3)], [("x", night(0), 4)]], schema)
    assert sorted(r.candidate_id for r in run(None, schema, K.once_a_day, "records")) == ["x", "y"]


def test_open_horizons_resolve_alike_in_streams_and_tables(spark, tmp_path):
    """Shuffled and late input, weekends without prices, horizons that come after their price, equal times."""
    rnd = random.Random(4)
    day = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)
    prices = [(s, day(n, h), float(rnd.randrange(1000))) for s in "abc" for n in range(60) if day(n).weekday() < 5 for h in (10, 16)]
    prices += [("a", day(3, 10), 1.0), ("a", day(3, 10), 2.0)]
    horizons = [(s, f"{s}{n}-{h}", day(n + h)) for s in "abcd" for n in range(0, 50, 3) for h in (0, 5, 7, 12)]
    # a batch holds what is known by a day, with some rows up to two days late
    arrives = lambda at: max(0, (at - day(0)).days) + rnd.choice((0, 0, 1, 2))
    batches: dict[int, tuple[list, list]] = {}
    for p in prices:
        batches.setdefault(arrives(p[1]), ([], []))[0].append(p)
    for h in horizons:
        batches.setdefault(max(0, arrives(h[2]) - rnd.choice((0, 3, 9))), ([], []))[1].append(h)
    late = "3 days"
    ph, pp = "symbol string, id string, due timestamp", "symbol string, ts timestamp, price double"
    ends = [([("z", day(200 + k), 1.0)], [("z", None, day(200 + k))]) for k in range(3)]  # only to move the watermark on
    for k, (p, h) in enumerate([*(batches[k] for k in sorted(batches)), *ends]):
        rnd.shuffle(p)
        rnd.shuffle(h)
        for name, rows, schema in (("p", p, pp), ("h", h or [("z", None, day(0))], ph)):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"b={k:03d}"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    q = H.resolved_horizons(read("h", ph), read("p", pp), late).writeStream.format("memory").queryName("horizons").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("horizons").collect() if r.symbol != "z")
    table = H.resolved_horizons(spark.createDataFrame(horizons, ph), spark.createDataFrame(prices, pp))
    assert got == sorted(tuple(r) for r in table.collect())
    first = {i: min(((t, p) for s2, t, p in prices if s2 == s and t >= due), default=None) for s, i, due in horizons}
    assert {(r[1], r[4], r[3]) for r in got} == {(i, *x) for i, x in first.items() if x}
    assert any(r[4].date() > r[2].date() for r in got)  # a weekend was passed over
    with pytest.raises(ValueError):
        H.resolved_horizons(spark.createDataFrame(horizons, ph), read("p", pp))


def test_horizons_of_any_order(spark):
    """The state's step, for random orders of arrival, against the first price at or after each due time."""
    rnd = random.Random(8)
    for _ in range(200):
        prices = [(rnd.randrange(50), float(rnd.randrange(9))) for _ in range(20)]
        due = [(str(i), rnd.randrange(60)) for i in range(8)]
        held, done = {}, []
        todo = [("p", x) for x in prices] + [("d", x) for x in due]
        rnd.shuffle(todo)
        for k in range(0, len(todo), 5):
            some = todo[k : k + 5]
            held, out = H.advance(json.loads(json.dumps(held)), [x for s, x in some if s == "d"], [x for s, x in some if s == "p"], 0)
            done += out
        held, out = H.advance(held, [], [], 1000)
        done += out
        want = {i: min((p for p in prices if p[0] >= at), default=None) for i, at in due}
        assert {i: (ts, price) for i, _, price, ts in done} == {i: w for i, w in want.items() if w}


def test_position_changes(spark):
    df = spark.createDataFrame([(1, 1, 1, "LONG", 5), (1, 2, 1, "LONG", 9), (1, 1, 2, "PUT", 3), (1, 2, 3, "CALL", 2)], "filer long, period int, cusip long, put_call string, shares long")
    assert {(r.cusip, r.change) for r in M.position_changes(df).collect()} == {(1, "increase"), (2, "exit"), (3, "new")}


def test_patterns_at_as_of_bars_equal_those_of_cut_off_bars(spark, bars):
    """Detectors at many as-of bars against the same detectors run on the bars up to each."""
    from gristmill.operators import charts as C

    at = (131, 200, 270, 330)
    f = C.frame(bars)
    ends = C.as_of_bars(f, F.col("rn").isin(*at))
    got = {tuple(r) for r in C.patterns_at(f, ends).collect()}
    numbered = bars.withColumn("rn", F.row_number().over(I.in_order()))
    want = set()
    for n in at:
        cut = numbered.where(F.col("rn") <= n).drop("rn")
        g = C.frame(cut)
        want |= {tuple(r) for r in C.patterns_at(g, C.at_last(g)).where(F.col("n") == n).collect()}
    assert got == want and len({r[2] for r in got}) >= 4


def test_hits_need_half_a_percent(spark):
    from gristmill.operators import charts as C

    rows = [("a", i, "double_bottom", r >= 0.005, r) for i, r in enumerate([0.004, 0.006, -0.02, 0.01] * 3)]
    found = spark.createDataFrame([(s, n, p, h, r, r, r) for s, n, p, h, r in rows], "symbol string, n int, pattern string, hit boolean, fwd_1w double, fwd_2w double, fwd_4w double")
    (r,) = C.pattern_statistics(found).collect()
    assert (r.n, r.n_total, r.hit_rate, r.win_rate_1pct) == (6, 12, round(3 / 6, 6), round(4 / 6, 6))
    assert C.pattern_statistics(found.limit(9)).count() == 0


def test_roots_are_found_for_whole_batches(spark):
    """Against the price that a known volatility gives, with what has no root, and once a row in the plan."""
    rnd = random.Random(12)
    rows = [(rnd.choice("CP"), rnd.uniform(50, 150), rnd.uniform(60, 140), rnd.uniform(0.05, 2), rnd.uniform(0.1, 1.5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "side string, spot double, strike double, t double, vol double")
    df = df.withColumn("target", O.price(F.col("spot"), F.col("strike"), F.col("t"), F.col("vol"), F.col("side"), O.RATE))
    solved = df.withColumn("iv", O.implied_volatility(F.col("target"), F.col("spot"), F.col("strike"), F.col("t"), F.col("side"), r=O.RATE))
    back = solved.withColumn("again", O.price(F.col("spot"), F.col("strike"), F.col("t"), F.col("iv"), F.col("side"), O.RATE)).toPandas()
    assert np.allclose(back["again"], back["target"], atol=1e-6)
    firm = back[np.abs(np.log(back["spot"] / back["strike"])) < back["vol"] * np.sqrt(back["t"])]
    assert len(firm) > 200
    assert np.allclose(firm["iv"], firm["vol"], atol=1e-5)
    odd = [("C", 100.0, 100.0, 1.0, 500.0), ("C", 100.0, 50.0, 1.0, 1.0), ("C", 100.0, 0.0, 1.0, 5.0), (None, 100.0, 100.0, 1.0, 5.0), ("C", 100.0, 100.0, None, 5.0), ("C", 100.0, 100.0, 0.0, 5.0), ("C", 100.0, 100.0, 1.0, None)]
    none = spark.createDataFrame(odd, "side string, spot double, strike double, t double, target double")
    none = none.withColumn("iv", O.implied_volatility(F.col("target"), F.col("spot"), F.col("strike"), F.col("t"), F.col("side")))
    assert none.where("iv is not null").count() == 0
    plan = solved.where("iv > 0").select(F.col("iv") * 2, F.coalesce("iv", F.lit(0.0)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_the_gravest_severity_counts(spark):
    today = spark.createDataFrame([("s", "word_count_low", x) for x in ("high", "critical", "medium", "low")] + [("s", "b", "low"), ("s", "b", "medium"), ("s", "c", None)], "site string, class string, severity string")
    carried = spark.createDataFrame([], "site string, class string, nights int")
    got = {r["class"]: r.severity for r in D.classified(today, carried).collect()}
    assert got == {"word_count_low": "critical", "b": "medium", "c": None}


def test_of_two_new_rows_the_same_one_wins(spark):
    from gristmill.sources import ledger as L

    old = spark.createDataFrame([("a", 9), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 5), ("a", 3)], "k string, v int").repartition(3)
    assert sorted(tuple(r) for r in L.newest_wins(old, new, "k").collect()) == [("a", 5), ("b", 1)]


def test_best_sets_against_all_pairs(spark):
    """Prefix keys for sizes of both sets lose no best match, with words that nearly all sets have."""
    rnd = random.Random(5)
    draw = lambda: tuple(sorted({"story", *rnd.choices("abcdefgh", k=rnd.randrange(5))} if rnd.random() < 0.8 else set(rnd.choices("abcdefgh", k=2))))
    left, right = {draw() for _ in range(60)}, {draw() for _ in range(60)}
    to = {v: f"/p/{i}" for i, v in enumerate(sorted(right))}
    for least in (0.5, 0.75):
        got = D._best_sets(spark.createDataFrame([("s", list(w)) for w in left], "site string, w array<string>"), spark.createDataFrame([("s", list(v), p) for v, p in to.items()], "site string, v array<string>, to string"), ["site"], least)
        found = {tuple(r.w): (round(r.score, 6), r.to) for r in got.collect()}
        want = {w: max((len(set(w) & set(v)) / len(set(w) | set(v)), p) for v, p in to.items()) for w in left}
        assert found == {w: (round(s, 6), p) for w, (s, p) in want.items() if s >= least}
