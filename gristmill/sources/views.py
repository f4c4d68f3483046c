"""Typed inputs derived from the landed tables.

The SQL of a view runs in Spark and in ANSI engines alike.  Prices are built in
integer ticks, so that both give the same bits.  Spark holds these ticks as
whole doubles: a long walk outgrows a BIGINT, and one symbol's walk must not
fail the others' bars.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table; Spark reads only the columns and row groups that a query needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame) -> DataFrame:
    """df, kept in memory and on the executors' disks while several parts of a query read it; lost parts are made again, spark.catalog.clearCache() lets it go."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _double(x: str) -> str:
    """x, which is whole, as a double; from 2**53 on every double is whole, and FLOOR would end at the largest BIGINT."""
    if inner := re.fullmatch(r"FLOOR\((.*)\)", x):
        return f"CASE WHEN {inner[1]} < 9007199254740992 THEN CAST({x} AS DOUBLE) ELSE {inner[1]} END"
    return x


def _bars(key: str, scale: str, whole: Callable[[str], str] = _bigint) -> str:
    of = f"{key} AS symbol"
    return f"""
  SELECT symbol, d, ot/1E4 AS open,
         (GREATEST(ot,ct) + {whole("FLOOR(GREATEST(ot,ct)*tx/(n*1E3))")})/1E4 AS high,
         (LEAST(ot,ct) - {whole("FLOOR(LEAST(ot,ct)*tx/(n*1E3))")})/1E4 AS low,
         ct/1E4 AS close, volume
  FROM (SELECT *, COALESCE(LAG(ct) OVER (PARTITION BY symbol ORDER BY d), 1000000) AS ot
        FROM (SELECT *, {whole(f"ROUND(1E6*EXP({scale}*SUM(st) OVER (PARTITION BY symbol ORDER BY d)))")} AS ct
              FROM (SELECT {of}, CAST(l_shipdate AS DATE) AS d,
                           SUM(CAST(ROUND(l_discount*100) AS BIGINT)) - 5*COUNT(*) AS st,
                           SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS tx, COUNT(*) AS n,
                           CAST(SUM(l_quantity) AS BIGINT) AS volume
                    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) steps) b0) b1"""


#: Daily bars by brand; the same for the whole market.
BARS = _bars("p_brand", "4E-3")
MARKET = _bars("'MKT'", "8E-4")
_IN_SPARK = {"bars": _bars("p_brand", "4E-3", _double), "market": _bars("'MKT'", "8E-4", _double)}

SECTORS = """
  SELECT DISTINCT p_brand AS symbol, CAST(SUBSTR(p_brand, 7) AS INT) % 11 AS sector, CASE CAST(SUBSTR(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'defensive' WHEN 1 THEN 'cyclical' ELSE 'neutral' END AS beta_class FROM part"""

#: One row for each brand; every seventh lacks some ratios.
FUNDAMENTALS = """
  SELECT p_brand AS symbol, CAST(SUBSTR(p_brand, 7) AS INT) AS k,
         CASE WHEN CAST(SUBSTR(p_brand, 7) AS INT) % 7 <> 0 THEN AVG(p_retailprice) / AVG(p_size) END AS pe,
         SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / SUM(l_quantity) AS short_float,
         CASE WHEN CAST(SUBSTR(p_brand, 7) AS INT) % 7 <> 3 THEN SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / SUM(l_quantity) END AS institutions,
         AVG(l_discount) * 10 AS growth, AVG(l_tax) * 10 AS margin,
         1 + 4 * AVG(l_discount) AS rating
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""

#: Ratios, estimates and positions of each brand under a provider's names; every fifth reports no multiples.
COMPANY = """
  SELECT symbol, CASE WHEN k % 5 <> 0 THEN price / (1 + 2E1 * a / n) END AS trailing_pe, price / (2 + 2E1 * a / n) AS forward_pe, CASE WHEN k % 5 <> 1 THEN 3E0 * r / n END AS peg_ratio,
         8E0 * r / n AS price_to_book, 6E0 * a / n AS price_to_sales, CASE WHEN k % 3 = 0 THEN -1E0 ELSE 4E1 * r / n END AS ev_to_ebitda,
         1E0 * a / n - 1E-1 AS roe, 5E-1 * r / n - 5E-2 AS roa, 1E-2 * disc / n AS operating_margin, 1E-2 * tax / n AS profit_margin, 1E0 * a / n - 1E0 * r / n AS revenue_growth,
         CASE WHEN k % 7 <> 0 THEN 2E0 * r / n - 3E-1 END AS earnings_growth, 1E2 * tax / (disc + 1) AS debt_to_equity, CAST(disc AS DOUBLE) AS operating_cashflow, CAST(tax - disc / 2 AS DOUBLE) AS net_income,
         CAST(disc - tax AS DOUBLE) AS free_cashflow, CAST(qty AS DOUBLE) AS market_cap, CASE WHEN k % 4 = 0 THEN -1E0 ELSE 1E1 * a / n END AS eps, CASE WHEN k % 6 <> 0 THEN 1E2 + 1E1 * k END AS target,
         1 + 4E0 * r / n AS analyst_rating, CAST(k % 30 AS DOUBLE) AS analyst_coverage, 5E-1 * r / n AS short_float, CASE WHEN k % 7 <> 3 THEN 2E0 * a / n END AS institutions, 1E-1 * tax / n AS insiders
  FROM (SELECT p_brand AS symbol, CAST(SUBSTR(p_brand, 7) AS INT) AS k, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS qty,
               SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
               SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS disc, SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS tax, SUM(CAST(ROUND(p_retailprice) AS BIGINT)) / (1E1 * COUNT(*)) AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) c0"""

#: The next report of each brand, and what is known of its news and messages.
SIGNALS = """
  SELECT p_brand AS symbol, CAST(MAX(l_shipdate) AS DATE) + CAST(CAST(SUBSTR(p_brand, 7) AS INT) % 50 - 5 AS INT) AS next_report, CAST(COUNT(DISTINCT l_suppkey) % 17 AS DOUBLE) AS news_count, (SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) - SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)) / (1E0 * COUNT(*)) AS news_sentiment,
         SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / (1E0 * COUNT(*)) AS bullish_share, CAST(COUNT(*) % 700 AS DOUBLE) AS messages, CAST(COUNT(DISTINCT l_suppkey) % 9 AS DOUBLE) - 4 AS revisions
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""

#: A report of each brand at the end of each quarter's trade; some without a surprise.
REPORTS = """
  SELECT symbol, d, CASE WHEN n % 9 <> 0 THEN 1E2 * (disc - tax) / (tax + 1) END AS surprise_pct
  FROM (SELECT p_brand AS symbol, CAST(MAX(l_shipdate) AS DATE) AS d, COUNT(*) AS n, SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS disc, SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS tax
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, YEAR(l_shipdate), FLOOR((MONTH(l_shipdate) - 1) / 3)) r0"""

#: Shares of each brand that are sold short, at the end of each month's trade.
SHORTS = """
  SELECT p_brand AS symbol, CAST(MAX(l_shipdate) AS DATE) AS d, CAST(SUM(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS shares
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, YEAR(l_shipdate), MONTH(l_shipdate)"""

#: One row: the state of the orders' series as a macro regime.
MACRO_STATE = """
  SELECT (up - down) / (1E0 * (up + down)) AS macro_score, down / (1E0 * (up + down)) AS bear_risk, ABS(up - down) / (1E0 * (up + down)) AS regime_confidence, (up - down) / (2E0 * (up + down)) AS credit_score,
         CASE WHEN up > 2 * down THEN 'risk_on' WHEN up >= down THEN 'fragile_risk_on' ELSE 'risk_off' END AS regime
  FROM (SELECT SUM(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS up, SUM(CASE WHEN o_orderpriority < '3' THEN 0 ELSE 1 END) AS down FROM orders) m0"""

#: An option chain around the last close of each symbol.
CHAIN = """
  SELECT underlying, tier, spot, d AS as_of, dte, side, strike, mid * (1 - sp) AS bid, mid * (1 + sp) AS ask, mid, oi, vol, iv
  FROM (SELECT *, (CASE WHEN side = 'C' THEN GREATEST(spot - strike, 0) ELSE GREATEST(strike - spot, 0) END)
                  + spot * iv * 4E-1 * SQRT(dte / 365E0) * EXP(-8E0 * POWER((strike - spot) / spot, 2)) AS mid
        FROM (SELECT b.symbol AS underlying, CASE CAST(SUBSTR(b.symbol, 7) AS INT) % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'etf' ELSE 'stock' END AS tier, b.close AS spot, b.d AS d, e.dte AS dte, s.side AS side, k.k AS k,
                     ROUND(b.close) + k.k * GREATEST(ROUND(b.close * 1E-2), 1) AS strike,
                     2E-1 + 1E-3 * k.k * k.k + 1E-4 * e.dte AS iv,
                     CAST((CAST(SUBSTR(b.symbol, 7) AS INT) * 37 + k.k * k.k * 11 + e.dte * 7) % 1500 AS BIGINT) AS oi,
                     CAST((CAST(SUBSTR(b.symbol, 7) AS INT) * 13 + k.k * k.k * 5 + e.dte * 3) % 400 AS BIGINT) AS vol,
                     2E-3 + 4E-3 * ((CAST(SUBSTR(b.symbol, 7) AS INT) + k.k * k.k + e.dte) % 9) AS sp
              FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn FROM bars) x WHERE rn = 1) b
              CROSS JOIN (SELECT 9 AS dte UNION ALL SELECT 23 UNION ALL SELECT 44 UNION ALL SELECT 65) e
              CROSS JOIN (SELECT 'C' AS side UNION ALL SELECT 'P') s
              CROSS JOIN (SELECT -6 AS k UNION ALL SELECT -5 UNION ALL SELECT -4 UNION ALL SELECT -3 UNION ALL SELECT -2 UNION ALL SELECT -1 UNION ALL SELECT 0
                          UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) k) q
        WHERE strike > 0) r"""

#: Daily sums of orders by priority, as macro series.
SERIES = """
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d, CAST(SUM(CAST(ROUND(o_totalprice) AS BIGINT)) AS DOUBLE) AS value FROM orders GROUP BY 1, 2"""

MESSAGES = """
  SELECT CAST(conv_id AS BIGINT) * 100 + turn AS id, 'Brand#' || CAST(11 + 10 * (conv_id % 5) + (conv_id % 4) AS STRING) AS symbol, role AS source, text FROM conversations"""

#: Positions of each supplier in two periods.
HOLDINGS = """
  SELECT l_suppkey AS filer, CASE WHEN YEAR(l_shipdate) < 1995 THEN 1 ELSE 2 END AS period, l_partkey AS cusip,
         CASE l_partkey % 5 WHEN 0 THEN 'PUT' WHEN 1 THEN 'CALL' ELSE 'LONG' END AS put_call,
         SUM(CAST(ROUND(l_extendedprice) AS BIGINT)) AS value_usd, SUM(CAST(l_quantity AS BIGINT)) AS shares
  FROM lineitem GROUP BY 1, 2, 3, 4"""

_PAIR = "<p><em>Sources: a</em></p><p><em>Disclaimer: b</em></p>"
_TAG = '<ins class="adsbygoogle" data-ad-slot="7"></ins>'
#: The pages as sites of four publishers: paths by kind, head links, analytics ids, ad tags, boxes and footers, some with faults.
SITE = f"""
  SELECT page_id, site, path, CASE WHEN page_id % 97 <> 0 THEN REPLACE(REPLACE(REPLACE(REPLACE(html, '</head>', head || '</head>'), '<!-- ad ', ad_open), ' -->', ad_close), '<footer>', foot || '<footer>') END AS html
  FROM (SELECT page_id, html, 'site' || CAST(page_id % 4 AS STRING) AS site,
               CASE page_id % 9 WHEN 0 THEN '/s' || CAST(page_id AS STRING) || '/about/' WHEN 1 THEN '/s' || CAST(page_id AS STRING) || '/privacy' WHEN 2 THEN '/articles/story-' || CAST(page_id AS STRING) || '.html' WHEN 3 THEN '/news/' || CAST(page_id AS STRING) || '/'
                                WHEN 4 THEN '/s' || CAST(page_id AS STRING) || '/reviews/index.html' WHEN 5 THEN '/stories/long-story-' || CAST(page_id AS STRING) || '/' WHEN 6 THEN '/archive/articles/x-' || CAST(page_id AS STRING) || '/' WHEN 7 THEN COALESCE('/' || NULLIF(REGEXP_EXTRACT(html, 'href="/([^"]*)"', 1), ''), '/')
                                ELSE '/part/' || CAST(page_id % 20 AS STRING) || '/' END AS path,
               CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<link rel="canonical" href="https://x/">' ELSE '<link rel="canonical" href="https://x/"><link rel="icon" href="/i.ico">' END || CASE WHEN page_id % 6 = 0 THEN '<script src="https://t/js?id=G-G-AB12CD34EF"></script>' ELSE '<script src="https://t/js?id=G-AB12CD34EF"></script>' END AS head,
               CASE WHEN page_id % 3 = 0 THEN '<!-- no ad ' ELSE '<ins class="adsbygoogle" data-ad-slot="' END AS ad_open,
               CASE WHEN page_id % 3 = 0 THEN ' -->' ELSE '"></ins>' || CASE WHEN page_id % 4 = 1 THEN '{_TAG}{_TAG}' ELSE '' END END AS ad_close,
               CASE page_id % 11 WHEN 0 THEN '<section class="eeat-block">The editor is known. custody. launched in 2020. editorial process. corrections policy. disclosure.</section>' WHEN 1 THEN '<section class="eeat-block">custody</section>' WHEN 2 THEN '<p>custody, launched in 2020, disclosure</p>' ELSE '' END
               || CASE WHEN page_id % 10 = 3 THEN '<a href="/part4/">x</a>' ELSE '' END || CASE page_id % 7 WHEN 0 THEN '{_PAIR}<hr>{_PAIR}' WHEN 1 THEN '{_PAIR}' ELSE '' END AS foot
        FROM pages) s0"""

#: What was found on earlier nights: the nights so far of each site and class.
CARRIED = """
  SELECT 'site' || CAST(page_id % 4 AS STRING) AS site, CASE page_id % 5 WHEN 0 THEN 'ga4_typo' WHEN 1 THEN 'missing_canonical' WHEN 2 THEN 'live_unreachable' WHEN 3 THEN 'stale_page' ELSE 'word_count_low' END AS class, CAST(MIN(page_id % 12) % 3 + 1 AS INT) AS nights
  FROM pages WHERE page_id % 20 < 13 GROUP BY 1, 2"""

#: Markdown files of the sites; some have no page.
MARKDOWN = """
  SELECT DISTINCT 'site' || CAST(page_id % 4 AS STRING) AS site, CASE WHEN page_id % 50 = 0 THEN 'lost-' ELSE 'story-' END || CAST(page_id AS STRING) AS stem FROM pages WHERE page_id % 9 = 2 AND page_id % 2 = 0 OR page_id % 50 = 0"""

#: Spark's / raises on a close of 0, where the SQL has an infinity; no strike above 0 is a close of 0.
_IN_SPARK["chain"] = CHAIN.replace("(strike - spot) / spot", "CASE WHEN spot = 0 THEN CAST('Infinity' AS DOUBLE) ELSE (strike - spot) / spot END")

SQL = {"site": SITE, "carried": CARRIED, "markdown": MARKDOWN, "bars": BARS, "market": MARKET, "sectors": SECTORS, "fundamentals": FUNDAMENTALS, "company": COMPANY, "signals": SIGNALS, "reports": REPORTS, "shorts": SHORTS, "macro_state": MACRO_STATE, "chain": CHAIN, "series": SERIES, "messages": MESSAGES, "holdings": HOLDINGS}
_NEEDS = {"site": ["pages"], "carried": ["pages"], "markdown": ["pages"], "bars": ["lineitem", "part"], "market": ["lineitem", "part"], "sectors": ["part"], "fundamentals": ["lineitem", "part"], "company": ["lineitem", "part"], "signals": ["lineitem", "part"], "reports": ["lineitem", "part"], "shorts": ["lineitem", "part"], "macro_state": ["orders"], "series": ["orders"], "messages": ["conversations"], "holdings": ["lineitem"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    inputs = {"bars": held(view(spark, sf_dir, "bars"))} if name == "chain" else {t: table(spark, sf_dir, t) for t in _NEEDS[name]}
    sql = _IN_SPARK.get(name, SQL[name])
    for t in inputs:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **inputs)


def oracle(names: str, query: str) -> str:
    """query with the named views before it, for an engine that has the landed tables."""
    wanted = []
    for n in names.split():
        wanted += [x for x in (["bars", n] if n == "chain" else [n]) if x not in wanted]
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted).replace("AS STRING", "AS VARCHAR")
    return f"WITH {views}\n{query}" if not query.lstrip().startswith(",") else f"WITH {views}{query}"
