"""Macro pillars and the regime, positioning, volatility bands, watchlists, event signals, and checks of landed sources and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import indicators as I
from ..functions.ieee import ratio

# Weights of the eight pillars, and the five regimes' coefficients on their scores
# (abs: on the absolute score) with a constant.
PILLARS = {"A": 0.18, "B": 0.14, "C": 0.14, "D": 0.18, "E": 0.12, "F": 0.10, "G": 0.10, "H": 0.04}
LOGITS = {
    "risk_on": ({"A": 1.6, "D": 0.9, "E": 0.8, "G": 0.5, "B": 0.4}, {}, 0.0),
    "fragile_risk_on": ({"A": 0.8, "D": -0.5, "F": -0.5, "E": 0.3, "G": -0.2}, {}, 0.0),
    "transition": ({"H": 0.4}, {"A": -0.3, "D": -0.3}, -0.2),
    "risk_off": ({"A": -1.0, "D": -1.0, "B": -0.7, "G": -0.5}, {}, 0.0),
    "bear_risk_elevated": ({"A": -1.3, "D": -1.3, "B": -1.0, "E": -0.8, "G": -0.5}, {}, 0.0),
}
BEAR_BANDS = ((0.20, "low"), (0.45, "moderate"), (0.65, "elevated"))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """MTH1: x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def finite(x: Column) -> Column:
    """x, or null where it is not a number or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def pillar_scores(components: DataFrame) -> DataFrame:
    """DOM30: components(pillar, component, value, centre, scale) to each pillar's score (the mean of (value - centre) / scale, clamped to
    -1..1), state, confidence and missing components; a pillar without any value is unavailable and scores 0."""
    x = clamp((finite(F.col("value")) - F.col("centre")) * F.col("scale"))
    got = components.withColumn("x", x).groupBy("pillar").agg(
        F.round(F.coalesce(F.avg("x"), F.lit(0.0)), 6).alias("score"), F.count("x").alias("n"),
        F.concat_ws(" ", F.array_sort(F.collect_set(F.when(F.col("x").isNull(), F.col("component"))))).alias("missing"),
    )
    state = F.when(F.col("n") == 0, "unavailable").when(F.col("score") > 0.20, "improving").when(F.col("score") < -0.20, "deteriorating").otherwise("neutral")
    confidence = F.when(F.col("n") == 0, 0.0).when(F.col("missing") != "", 0.5).otherwise(0.8)
    return got.select("pillar", "score", state.alias("state"), confidence.alias("confidence"), "missing")


def event_risk(calendar: DataFrame, today: Column) -> DataFrame:
    """DAT6: pillar H in the form of pillar_scores: -0.15 for each event(d, label, impact) of high impact within seven days, with the next event's label as missing is for others."""
    ahead = F.datediff(F.col("d"), today)
    hits = F.count_if(ahead.between(0, 7) & (F.col("impact") == "high"))
    got = calendar.agg(hits.alias("high"), F.min_by("label", F.when(ahead >= 0, F.struct("d", "label"))).alias("next"), F.min(F.when(ahead >= 0, ahead)).alias("days_to_next"))
    score = F.round(F.greatest(-0.15 * F.col("high"), F.lit(-1.0)), 6)
    return got.select(score.alias("score"), "high", "next", "days_to_next", F.when(score < -0.05, "deteriorating").otherwise("neutral").alias("state"))


def regime(scores: DataFrame, vix: DataFrame | None = None) -> DataFrame:
    """DOM31, MTH10: one row from pillar_scores: the regime with its posterior, confidence, composite, bear risk with its level, what speaks against it, and completeness.

    The posterior is a softmax over five linear logits; confidence is one less
    its entropy over the largest; bear risk is the mean of the falls of D and E
    and of vix(level), a table of one row, between 14 and 34.
    """
    s = scores.groupBy().pivot("pillar", list(PILLARS)).agg(F.first("score"))
    have = scores.agg(F.count_if(F.col("state") != "unavailable").alias("available"), F.concat_ws(" ", F.array_sort(F.collect_set(F.when(F.col("state") != "unavailable", F.col("pillar"))))).alias("have"))
    s = s.join(F.broadcast(have))  # both have one row
    s = s.join(F.broadcast(vix.select("level"))) if vix is not None else s.withColumn("level", F.lit(None).cast("double"))
    score = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in PILLARS}
    total = F.lit(0.0)
    for k, w in PILLARS.items():
        total = total + w * score[k]
    for name, (linear, absolute, constant) in LOGITS.items():
        z = F.lit(constant)
        for k, w in linear.items():
            z = z + w * score[k]
        for k, w in absolute.items():
            z = z + w * F.abs(score[k])
        s = s.withColumn(f"e_{name}", F.exp(z))
    whole = F.lit(0.0)
    for name in LOGITS:
        whole = whole + F.col(f"e_{name}")
    s = s.withColumn("p", F.array(*(F.struct((F.col(f"e_{n}") / whole).alias("p"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(LOGITS))))
    s = s.withColumn("regime", F.array_max("p")["name"]).withColumn("entropy", F.aggregate("p", F.lit(0.0), lambda a, x: a - x["p"] * F.log(x["p"])) / F.log(F.lit(float(len(LOGITS)))))
    falls = F.filter(F.array(F.when(F.col("D").isNotNull(), F.greatest(-F.col("D"), F.lit(0.0))), F.when(F.col("E").isNotNull(), F.greatest(-F.col("E"), F.lit(0.0))), clamp((F.col("level") - 14) / 20, 0.0, 1.0)), lambda x: x.isNotNull())
    bear = F.round(F.coalesce(F.try_divide(F.aggregate(falls, F.lit(0.0), lambda a, x: a + x), F.size(falls)), F.lit(0.0)), 6)
    s = s.withColumn("bear_risk", bear)
    level = F.lit("high")
    for top, name in reversed(BEAR_BANDS):
        level = F.when(F.col("bear_risk") < top, name).otherwise(level)
    averse = F.col("regime").isin("bear_risk_elevated", "risk_off")
    seeking = F.col("regime").isin("risk_on", "fragile_risk_on")
    against = [F.when(averse & (score[k] > 0.1), F.lit(f"{k} argues risk_on")) for k in ("D", "E")] + [F.when(seeking & (score[k] < -0.2), F.lit(f"{k} deteriorating")) for k in ("A", "D", "B")]
    completeness = F.when(F.col("available") == 0, "insufficient").when(F.col("available") < len(PILLARS), "partial").otherwise("complete")
    return s.select(
        "regime", *(F.round(F.col("p")[i]["p"], 6).alias(f"p_{n}") for i, n in enumerate(LOGITS)), F.round(1 - F.col("entropy"), 6).alias("confidence"), F.round(total, 6).alias("composite"),
        "bear_risk", level.alias("bear_level"), F.concat_ws("; ", *against).alias("against"), completeness.alias("completeness"), F.when(F.col("available") < 6, "preliminary").otherwise("calibrating").alias("status"),
    )


def short_class(share: Column) -> Column:
    return F.when(share > 0.10, "heavy_short_pressure").when(share > 0.05, "moderate_short").when(share > 0.02, "light_short").when(share.isNotNull(), "minimal_short")


def owner_class(share: Column) -> Column:
    return F.when(share > 0.80, "very_high_inst").when(share > 0.60, "high_inst").when(share > 0.30, "moderate_inst").when(share.isNotNull(), "low_inst")


def positioning(company: DataFrame) -> DataFrame:
    """DOM34: company(symbol, short_change, short_float, institutions, analyst_rating, upside): classes, scores and their mean weighted -0.3, 0.2, 0.5 over those that are there.

    The short score falls with the change and rises with the share, as it is
    published; consistent has both signs alike.
    """
    short = clamp(-0.5 * F.col("short_change") + F.coalesce("short_float", F.lit(0.0)) - 0.05)
    same = clamp(0.5 * F.col("short_change") + F.coalesce("short_float", F.lit(0.0)) - 0.05)
    owner = clamp((F.col("institutions") - 0.5) * 2)
    analyst = clamp(((3.5 - F.col("analyst_rating")) / 2.5 + F.col("upside")) * 0.7)
    parts = ((short, -0.3), (owner, 0.2), (analyst, 0.5))
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), abs(w)).otherwise(0.0) for x, w in parts), F.lit(0.0))
    cols = {"short_score": short, "short_score_consistent": same, "owner_score": owner, "analyst_score": analyst, "flow": F.when(weight > 0, F.try_divide(total, weight))}
    return company.select("symbol", short_class(F.col("short_float")).alias("short_class"), owner_class(F.col("institutions")).alias("owner_class"), *(F.round(c, 6).alias(k) for k, c in cols.items()))


def volatility_band(v: Column) -> Column:
    """DOM32: calm below 15 %, normal below 25, elevated below 40, else stressed."""
    return F.when(v.isNull(), "n/a").when(v < 0.15, "calm").when(v < 0.25, "normal").when(v < 0.40, "elevated").otherwise("stressed")


def vix_band(v: Column) -> Column:
    """DOM32: the band of an implied-volatility index in points."""
    return F.when(v.isNull(), "unknown").when(v < 12, "extremely_low").when(v < 18, "low").when(v < 25, "normal").when(v < 35, "elevated").otherwise("stressed")


def vix_mode(v: Column) -> Column:
    """What the band suggests: cautious from 25, flat_research_only from 35, else null."""
    return F.when(v >= 35, "flat_research_only").when(v >= 25, "cautious")


def regime_assessment(bars: DataFrame) -> DataFrame:
    """DOM32: each symbol at its last bar: realised volatility of 20 and 60 log returns a year, its band, and the trend by the 20- and 50-bar averages."""
    sd = lambda n: I.full(F.stddev_samp("logret").over(I.last(n)), n, "logret") * F.sqrt(F.lit(252.0))
    df = I.with_returns(bars).withColumn("v20", sd(20)).withColumn("v60", sd(60)).withColumn("ma20", I.full(F.avg("close").over(I.last(20)), 20)).withColumn("ma50", I.full(F.avg("close").over(I.last(50)), 50))
    last = df.groupBy("symbol").agg(F.max_by(F.struct("d", "close", "v20", "v60", "ma20", "ma50"), "d").alias("b")).select("symbol", "b.*")
    trend = F.when(F.col("ma50").isNull(), None).when((F.col("close") > F.col("ma20")) & (F.col("ma20") > F.col("ma50")), "uptrend").when((F.col("close") < F.col("ma20")) & (F.col("ma20") < F.col("ma50")), "downtrend").otherwise("range-bound")
    return last.select("symbol", "d", F.round("v20", 6).alias("v20"), F.round("v60", 6).alias("v60"), volatility_band(F.col("v20")).alias("band"), trend.alias("trend"), vix_band(F.col("v20") * 100).alias("index_band"), vix_mode(F.col("v20") * 100).alias("mode"))


def benchmark_regime(rows: DataFrame) -> DataFrame:
    """DOM12: rows(symbol, trend, close, ma50, ret20) with the benchmark's regime: risk-on, risk-off or neutral."""
    up = (F.col("trend") == "uptrend") & (F.col("close") > F.col("ma50")) & (F.col("ret20") > 0)
    down = (F.col("trend") == "downtrend") & (F.col("close") <= F.col("ma50")) & (F.col("ret20") < 0)
    return rows.withColumn("regime", F.when(up, "risk-on").when(down, "risk-off").otherwise("neutral"))


def watchlist_monitor(watchlist: DataFrame, last: DataFrame, aliases: DataFrame, scores: DataFrame) -> DataFrame:
    """DOM13, JOI17: watchlist(symbol, ref_price, target, risk_line, probability, move) with the last close of the symbol or its alias(symbol, listed) and its score.

    change against the reference (0 within 0.05 %), what is left to the target
    (else the planned move), the probability's band and how near the risk line is.
    """
    w = watchlist.join(aliases, "symbol", "left").withColumn("listed", F.coalesce("listed", "symbol"))
    got = w.join(last.select(F.col("symbol").alias("listed"), "close"), "listed", "left").join(scores.select(F.col("symbol").alias("listed"), "score"), "listed", "left")
    change = (ratio(F.col("close"), F.col("ref_price")) - 1) * 100
    room = (ratio(F.col("close"), F.col("risk_line")) - 1) * 100
    return got.select(
        "symbol", "listed", "close", F.round(F.when(F.abs(change) < 0.05, 0.0).otherwise(change), 6).alias("change"), F.round(F.coalesce((ratio(F.col("target"), F.col("close")) - 1) * 100, "move"), 6).alias("upside"),
        F.when(F.col("probability") >= 50, "good").when(F.col("probability") >= 35, "middle").otherwise("low").alias("chance"),
        F.when(F.col("close").isNull() | F.col("risk_line").isNull(), "unknown").when(room < 0, "broken").when(room < 3, "near").otherwise("clear").alias("risk"), F.round("score", 6).alias("score"),
    )


def news_signals(news: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """AGG21: news(symbol, text) to the number of items and the mean of their keyword scores, 0 for texts without keywords."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"))
    u, d = F.size(F.filter(tokens, lambda t: t.isin(*up))), F.size(F.filter(tokens, lambda t: t.isin(*down)))
    score = F.when(u + d > 0, (u - d) / (u + d)).otherwise(0.0)
    return news.groupBy("symbol").agg(F.count("*").alias("news_count"), F.round(F.avg(F.when(F.coalesce("text", F.lit("")) != "", score)), 6).alias("news_sentiment"))


def message_shares(classified: DataFrame) -> DataFrame:
    """AGG20: classified(symbol, source, cls) to each symbol's messages, shares of bullish and bearish ones, and the mean of its sources' bullish shares, each source counting alike."""
    by_source = classified.groupBy("symbol", "source").agg(F.count("*").alias("n"), *(F.count_if(F.col("cls") == c).alias(c) for c in ("bullish", "bearish")))
    n = F.sum("n")
    return by_source.groupBy("symbol").agg(
        n.alias("messages"), F.count("*").alias("sources"), *(F.round(F.sum(c) / n, 6).alias(f"{c}_share") for c in ("bullish", "bearish")), F.round(F.avg(F.col("bullish") / F.col("n")), 6).alias("combined_bullish"),
    )


def event_bundle(symbols: DataFrame, news: DataFrame, flow: DataFrame, messages: DataFrame) -> DataFrame:
    """DOM35: each symbol with what is known of its news, of its positions flow(symbol, ...) and of its messages (message_shares()); the rest is null."""
    return symbols.join(news, "symbol", "left").join(flow, "symbol", "left").join(messages, "symbol", "left")


def candidate_table(candidates: DataFrame, macro: DataFrame, view: str = "neutral", counter_edge: float = 0.15) -> DataFrame:
    """DOM38: candidates(kind, edge, pop, ...) with the latest macro row's tag, best edge first; a counter-regime raises the least edge and is named as a caveat."""
    tag = F.when(F.col("regime").isin("risk_off", "bear_risk_elevated") & F.lit(view == "bullish") | (F.col("regime") == "risk_on") & F.lit(view == "bearish"), "counter-regime").otherwise("aligned")
    df = candidates.join(F.broadcast(macro.select(tag.alias("macro_tag"))))  # one row
    df = df.where((F.col("macro_tag") != "counter-regime") | (F.round("edge", 6) >= counter_edge))
    place = F.row_number().over(Window.partitionBy("underlying").orderBy(F.desc(F.round("edge", 6)), F.desc(F.round("pop", 6)), "kind", "low_strike"))
    return df.withColumn("place", place).withColumn("caveat", F.when(F.col("macro_tag") == "counter-regime", "wider risk bands").otherwise(""))


def latest_of(rows: DataFrame, key: str, kind: Column, order: str) -> DataFrame:
    """TOP10: of the rows of a kind the latest of each key."""
    return rows.where(kind).groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(order, *(c for c in rows.columns if c not in (key, order)))).alias("r")).select(key, "r.*")


def valid_bars(bars: DataFrame, trailing_only: bool = False) -> DataFrame:
    """FIL1: bars with all prices; trailing_only cuts only the incomplete ones behind a symbol's last whole bar."""
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    if not trailing_only:
        return bars.where(whole)
    return bars.withColumn("_end", F.max(F.when(whole, F.col("d"))).over(Window.partitionBy("symbol"))).where("d <= _end").drop("_end")


HISTORY_GATES = {"partial": 25, "dashboard": 50, "structure": 60, "backtest": 120}


def history_gates(bars: DataFrame) -> DataFrame:
    """FIL2: by symbol, how many bars it has and which of the four gates it passes."""
    got = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    return got.select("symbol", "n", *((F.col("n") >= least).alias(name) for name, least in HISTORY_GATES.items()))


def of_handle(urls: DataFrame, handle: Column) -> DataFrame:
    """FIL9: urls that are a status of the handle."""
    name = F.lower(F.regexp_extract("url", r"(?i)^https?://[^/]+/([^/?#]+)/status/\d+", 1))
    return urls.where((name != "") & (name == F.lower(handle)))


def dated_documents(files: DataFrame) -> DataFrame:
    """FIL10, SRC8: files(name, size) that are called by a valid date and not empty, newest first by place."""
    d = F.when(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("name", "yyyy-MM-dd"))
    got = files.withColumn("d", d).where("d is not null and size > 0")
    return got.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("d"), "name")))


def with_tickers(holdings: DataFrame, listing: DataFrame) -> DataFrame:
    """JOI18: holdings with the ticker of listing(cusip, ticker), null where unknown."""
    return holdings.join(listing, "cusip", "left")


def probe_findings(probes: DataFrame) -> DataFrame:
    """DOM43: probes(site, kind, url, status, body) of the apex, www, sitemap, favicons and pages to findings (site, class, severity, url).

    An apex that can't be reached hides all else of its site; a challenge (403)
    is none; of the others an unreachable one is none.
    """
    kind, status = F.col("kind"), F.col("status")
    challenge = (status == 403) & F.lower(F.coalesce("body", F.lit(""))).contains("challenge")
    cls = (
        F.when((kind == "apex") & (status == 0), "live_unreachable")
        .when((kind == "apex") & (status != 200) & ~challenge, "live_non_200")
        .when((kind == "www") & ~status.isin(0, 200, 301, 302, 308), "live_non_200")
        .when((kind == "sitemap") & ~status.isin(0, 200), "sitemap_unreachable")
        .when((kind == "favicon") & ~status.isin(0, 200), "live_favicon_missing")
        .when((kind == "page") & (status == 200) & F.coalesce("body", F.lit("")).rlike(r"\bG-G-[A-Z0-9]+\b"), "live_ga4_typo")
    )
    dead = probes.where("kind = 'apex' and status = 0").select("site").distinct().withColumn("dead", F.lit(True))
    df = probes.join(dead, "site", "left").where("dead is null or kind = 'apex'").withColumn("class", cls).where("class is not null")
    severity = F.when(F.col("class").isin("live_unreachable", "live_ga4_typo"), "critical").when(F.col("class") == "live_non_200", "high").otherwise("medium")
    return df.select("site", "class", severity.alias("severity"), "url")


DAYS = {"mon": (0,), "tue": (1,), "wed": (2,), "thu": (3,), "fri": (4,), "sat": (5,), "sun": (6,), "mon-fri": (0, 1, 2, 3, 4), "mon-sat": (0, 1, 2, 3, 4, 5), "sat-sun": (5, 6)}


def run_window(schedule: DataFrame, now: Column, zone: str = "America/New_York") -> DataFrame:
    """DAT4: schedule(job, dow, hour, minute, window_minutes) with today's expected start in the zone's clock and whether its window has closed at now (UTC); never on other days."""
    local = F.from_utc_timestamp(now, zone)
    days = F.lit(True)
    for name, of in DAYS.items():
        days = F.when(F.col("dow") == name, F.weekday(local).isin(*of)).otherwise(days)
    start = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", local)) + F.col("hour") * 3600 + F.col("minute") * 60)
    closed = days & (F.unix_timestamp(local) > F.unix_timestamp(start) + F.col("window_minutes") * 60)
    return schedule.withColumn("expected", start).withColumn("closed", closed)


def integrity(files: DataFrame, schedule: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """DOM41: files(job, stem, size, modified) against the schedule and pages(job, stem): (job, class, severity, n) of empty files, none after the window, a stale newest one, and dated ones without a page."""
    s = run_window(schedule, now)
    per = files.groupBy("job").agg(F.count_if(F.col("size") == 0).alias("empty"), F.max("modified").alias("newest"))
    df = s.join(per, "job", "left")
    faults = F.array(
        F.when(F.col("empty") > 0, F.struct(F.lit("cron_source_zero_byte").alias("class"), F.lit("high").alias("severity"), F.col("empty").alias("n"))),
        F.when(F.col("closed") & F.col("newest").isNull(), F.struct(F.lit("cron_source_missing").alias("class"), F.lit("high").alias("severity"), F.lit(0).cast("long").alias("n"))),
        F.when(F.col("closed") & (F.col("newest") < F.col("expected")), F.struct(F.lit("cron_source_stale").alias("class"), F.lit("high").alias("severity"), F.floor((F.unix_timestamp("expected") - F.unix_timestamp("newest")) / 60).alias("n"))),
    )
    jobs = df.select("job", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("f")).select("job", "f.*")
    dated = files.where(F.col("stem").rlike(r"^.{4}-.{2}-") & (F.col("size") > 0)).join(pages, ["job", "stem"], "left_anti").groupBy("job").agg(F.count("*").alias("n"))
    return jobs.unionByName(dated.select("job", F.lit("cron_source_no_html").alias("class"), F.lit("low").alias("severity"), "n"))


def feed_sections(feeds: DataFrame) -> DataFrame:
    """STR-K: feeds(feed, text) cut at dated headings (## yyyy-mm-dd): each line (feed, d, section, at, line), under the last heading (### name or **name:**) before it; headline until one stands."""
    parts = feeds.select("feed", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?m)(?=^## \d{4}-\d{2}-\d{2})")).alias("part", "body"))
    parts = parts.withColumn("d", F.try_to_date(F.regexp_extract("body", r"^## (\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")).where("d is not null")
    lines = parts.select("feed", "part", "d", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).where("at > 0").withColumn("line", F.trim("line"))
    name = F.lower(F.coalesce(F.nullif(F.regexp_extract("line", r"^###\s+(.+?):?$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\*\*([^*]+?):?\*\*:?$", 1), F.lit(""))))
    by = Window.partitionBy("feed", "part").orderBy("at")
    lines = lines.withColumn("head", name).withColumn("section", F.coalesce(F.last("head", True).over(by), F.lit("headline")))
    return lines.where("head is null and line <> ''").select("feed", "d", "section", "at", F.regexp_replace("line", r"^[-*]\s+", "").alias("line"))
