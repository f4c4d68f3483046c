"""Queries of readers and text forms: the landed tables are written out as the texts that the readers take, and read back, with SQL on the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as K
from ..sources import landed as L, ledger as G
from ..sources.views import oracle, table, view


def src13_landed_chain(spark, sf_dir):
    """Chains as a provider's JSON: other names for some, numbers as text for others, one expiry without its date."""
    c = view(spark, sf_dir, "chain")
    plain = F.struct("strike", "bid", "ask", F.col("vol").alias("volume"), F.col("oi").alias("open_interest"))
    other = F.struct(F.col("strike").cast("string").alias("strike"), "bid", "ask", F.col("vol").cast("string").alias("vol"), F.col("oi").alias("openInterest"))
    side = lambda s, of: F.collect_list(F.when(F.col("side") == s, of))
    by = ["underlying", "dte", "as_of"]
    lists = c.groupBy(*by).agg(*(side(s, of).alias(f"{s}_{name}") for s in "CP" for name, of in (("a", plain), ("b", other))))
    date = F.date_format(F.date_add("as_of", F.col("dte")), "yyyy-MM-dd")
    doc = lambda name, exp: F.to_json(F.struct(F.col("underlying").alias("symbol"), exp.alias("expiration"), F.col(f"C_{name}").alias("calls"), F.col(f"P_{name}").alias("puts")))
    lines = lists.select(F.when(F.col("dte") == 23, doc("b", date)).otherwise(doc("a", F.when(F.col("dte") != 65, date))).alias("value"))
    got = L.parsed(lines, "chain")
    return got.select("underlying", "expiration", "side", "strike", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"), "vol", "oi", "fault", F.col("rescued").isNotNull().alias("kept"))


def src13_landed_probes(spark, sf_dir):
    """Probe results as JSON lines into the findings of the probes; every seventh line is cut off."""
    e = table(spark, sf_dir, "events")
    status = F.array(*map(F.lit, (200, 301, 404, 403, 500, 0)))[(F.col("event_id") % 6).cast("int")]
    kind = F.array(*map(F.lit, ("apex", "www", "sitemap", "favicon", "page")))[(F.col("event_id") % 5).cast("int")]
    doc = F.to_json(F.struct(F.concat(F.lit("s"), F.col("user_id") % 90).alias("host"), kind.alias("kind"), F.col("event_id").cast("string").alias("url"), status.cast("string").alias("status_code"), F.lit("id=G-G-AB1").alias("body")))
    lines = e.select(F.when(F.col("event_id") % 7 == 0, F.substring(doc, 1, 30)).otherwise(doc).alias("value"))
    got = L.parsed(lines, "probe").where("fault is null")
    return K.probe_findings(got)


def agg30_net_cash_flow(spark, sf_dir):
    """Legs of each order in a page's embedded JSON."""
    li = table(spark, sf_dir, "lineitem")
    leg = F.struct(F.col("l_partkey").cast("string").alias("symbol"), F.when(F.col("l_returnflag") == "R", -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).alias("quantity"), F.col("l_extendedprice").alias("basis"))
    pages = li.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_list(leg).alias("legs"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct("legs")), F.lit("</script></html>"))
    return G.net_cash_flow(G.embedded_legs(pages.select("page_id", html.alias("html"))))


def str_j_front_matter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    head = F.concat(F.lit("---\ntitle: Order "), F.col("o_orderkey").cast("string"), F.lit("\nstatus:  "), F.col("o_orderstatus"), F.lit("\nno colon here\n---\n"))
    rows = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.col("o_orderpriority"), F.lit(" | "), F.col("o_custkey").cast("string"), F.lit(" |\n"))
    body = F.concat(F.lit("first part\n____\n"), rows, F.lit("\n_____\n\n"))
    m, cells = X.front_matter(F.concat(head, body)), X.table_rows(F.element_at(X.sections(body), 2))
    return o.select("o_orderkey", m["title"].alias("title"), m["status"].alias("status"), F.size(m).alias("n_keys"), F.size(X.sections(body)).alias("n_sections"), F.size(cells).alias("n_rows"), F.element_at(cells, 2)[0].alias("priority"), F.element_at(cells, 2)[1].alias("customer"))


def str_k_feed_sections(spark, sf_dir):
    """A feed for each user: a dated part for each event with its kind as the heading."""
    e = table(spark, sf_dir, "events")
    part = F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd"), F.lit("\n### "), F.col("event_type"), F.lit(":\n- event "), F.col("event_id").cast("string"), F.lit("\n"))
    feeds = e.groupBy(F.col("user_id").alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", part.alias("part")))), lambda x: x["part"]), "").alias("text"))
    return K.feed_sections(feeds)


def str_l_topic_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = X.topic_line(F.col("p_brand"), F.split(F.lower("p_type"), " "), F.array(F.concat(F.lit("T"), F.col("p_size").cast("string"))), F.col("p_type"))
    return p.select("p_partkey", line.alias("line"))


def str_p_tickers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tag = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    said = F.concat(F.lit("they bought "), tag, F.lit("X today, $"), F.lower(tag), F.lit(" and $"), tag, F.lit("; ZZ"), tag, F.lit(" calls, $toolong, $5"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(X.cashtags(said), " ").alias("tags"), F.array_join(X.contextual_tickers(said), " ").alias("tickers"))


def str_q_option_symbols(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    root, side = F.concat(F.col("l_returnflag"), F.col("l_linestatus")), F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P")
    strike = F.col("l_quantity") / 2
    day = F.date_format("l_shipdate", "yyMMdd")
    osi = F.concat(F.rpad(root, 6, " "), day, side, F.lpad((strike * 1000).cast("long").cast("string"), 8, "0"))
    short = F.concat(F.lit("."), root, day, side, F.regexp_replace(strike.cast("string"), r"\.0$", ""))
    a, b = X.option_symbol(osi), X.short_option_symbol(short)
    return li.select("l_orderkey", "l_linenumber", a["root"].alias("root"), a["expiry"].alias("expiry"), a["side"].alias("side"), a["strike"].alias("strike"), (a == b).alias("alike"), X.option_symbol(short).isNull().alias("other"))


def dat07_long_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.long_date(F.col("o_orderdate")).alias("written"))


_JOBS = ("mon", "fri", "mon-fri", "mon-sat", "sat-sun")


def dat04_run_windows(spark, sf_dir):
    """A job of each user's, asked for its window at each of their events."""
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("job"), F.array(*map(F.lit, _JOBS))[(F.col("user_id") % 5).cast("int")].alias("dow"), (F.col("user_id") % 24).cast("int").alias("hour"), (F.col("user_id") % 60).cast("int").alias("minute"), F.lit(30).alias("window_minutes"), "ts")
    return K.run_window(jobs, F.col("ts")).select("job", F.date_format("expected", "yyyy-MM-dd HH:mm").alias("expected"), "closed")


QUERIES = {f.__name__: f for f in (src13_landed_chain, src13_landed_probes, agg30_net_cash_flow, str_j_front_matter, str_k_feed_sections, str_l_topic_lines, str_p_tickers, str_q_option_symbols, dat07_long_dates, dat04_run_windows)}

_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
_OPEN_DAYS = "CASE user_id % 5 WHEN 0 THEN wd = 0 WHEN 1 THEN wd = 4 WHEN 2 THEN wd <= 4 WHEN 3 THEN wd <= 5 ELSE wd >= 5 END"
_TAG = "l_returnflag || l_linestatus"
_KIND = "['apex', 'www', 'sitemap', 'favicon', 'page'][event_id % 5 + 1]"
_STATUS = "[200, 301, 404, 403, 500, 0][event_id % 6 + 1]"
_WORDS = "[x FOR x IN STRING_SPLIT(REGEXP_REPLACE(LOWER(p_type), '[^a-z ]', '', 'g'), ' ') IF LENGTH(x) >= 4]"
ORACLE_SQL = {
    "src13_landed_chain": oracle("chain", "SELECT underlying, CASE WHEN dte <> 65 THEN CAST(as_of + CAST(dte AS INT) AS DATE) END AS expiration, side, strike, ROUND(bid, 6) AS bid, ROUND(ask, 6) AS ask, vol, oi, CASE WHEN dte = 65 THEN 'missing expiration' END AS fault, dte = 65 AS kept FROM chain"),
    "src13_landed_probes": f"""WITH p AS (SELECT 's' || CAST(user_id % 90 AS VARCHAR) AS site, {_KIND} AS kind, CAST(event_id AS VARCHAR) AS url, {_STATUS} AS status FROM events WHERE event_id % 7 <> 0),
dead AS (SELECT DISTINCT site FROM p WHERE kind = 'apex' AND status = 0),
c AS (SELECT p.*, CASE WHEN kind = 'apex' AND status = 0 THEN 'live_unreachable' WHEN kind = 'apex' AND status <> 200 THEN 'live_non_200' WHEN kind = 'www' AND status NOT IN (0, 200, 301, 302, 308) THEN 'live_non_200' WHEN kind = 'sitemap' AND status NOT IN (0, 200) THEN 'sitemap_unreachable' WHEN kind = 'favicon' AND status NOT IN (0, 200) THEN 'live_favicon_missing' WHEN kind = 'page' AND status = 200 THEN 'live_ga4_typo' END AS class FROM p LEFT JOIN dead ON dead.site = p.site WHERE dead.site IS NULL OR kind = 'apex')
SELECT site, class, CASE WHEN class IN ('live_unreachable', 'live_ga4_typo') THEN 'critical' WHEN class = 'live_non_200' THEN 'high' ELSE 'medium' END AS severity, url FROM c WHERE class IS NOT NULL""",
    "agg30_net_cash_flow": "SELECT l_orderkey AS page_id, ROUND(SUM(CASE WHEN l_returnflag = 'R' THEN -l_linenumber ELSE l_linenumber END * l_extendedprice * 100), 4) AS net, COUNT(*) AS legs FROM lineitem GROUP BY 1",
    "str_j_front_matter": "SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, o_orderstatus AS status, CAST(2 AS INT) AS n_keys, CAST(2 AS INT) AS n_sections, CAST(2 AS INT) AS n_rows, TRIM(o_orderpriority) AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders",
    "str_k_feed_sections": "SELECT user_id AS feed, CAST(ts AS DATE) AS d, LOWER(event_type) AS section, CAST(2 AS INT) AS at, 'event ' || CAST(event_id AS VARCHAR) AS line FROM events",
    "str_l_topic_lines": f"SELECT p_partkey, ARRAY_TO_STRING([x FOR x, i IN every IF LIST_POSITION(every, x) = i][1:8], ' ') AS line FROM (SELECT p_partkey, [LOWER(p_brand)] || STRING_SPLIT(LOWER(p_type), ' ')[1:4] || ['T' || CAST(p_size AS VARCHAR)] || ({_WORDS})[1:3] AS every FROM part) q",
    "str_p_tickers": f"SELECT l_orderkey, l_linenumber, {_TAG} AS tags, {_TAG} || ' ZZ' || {_TAG} || ' ' || {_TAG} || 'X' AS tickers FROM lineitem",
    "str_q_option_symbols": f"SELECT l_orderkey, l_linenumber, {_TAG} AS root, MAKE_DATE(2000 + YEAR(l_shipdate) % 100, MONTH(l_shipdate), DAY(l_shipdate)) AS expiry, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS side, l_quantity / 2 AS strike, TRUE AS alike, TRUE AS other FROM lineitem",
    "dat07_long_dates": "SELECT o_orderkey, STRFTIME(o_orderdate, '%B %-d, %Y') AS written FROM orders",
    "dat04_run_windows": f"""WITH e AS (SELECT event_id, user_id, {_LOCAL} AS clock FROM events), f AS (SELECT *, (ISODOW(clock) - 1) AS wd, DATE_TRUNC('day', clock) + TO_HOURS(user_id % 24) + TO_MINUTES(user_id % 60) AS expected FROM e)
SELECT event_id AS job, STRFTIME(expected, '%Y-%m-%d %H:%M') AS expected, {_OPEN_DAYS} AND FLOOR(EPOCH(clock)) > EPOCH(expected) + 30 * 60 AS closed FROM f""",
}
