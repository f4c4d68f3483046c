"""Queries on pages, messages and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import content as C
from ..sources.views import oracle, table, view

#: Frequent words of the synthetic corpus stand in for the keyword lists.
UP, DOWN = ["the", "la", "der", "en"], ["and", "que", "die", "et"]


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def str_a_visible_text(spark, sf_dir):
    return C.parsed(_pages(spark, sf_dir)).select("page_id", "host", "path", "title", "n_words", F.md5("text").alias("text_md5"), X.long_words(F.col("text")).alias("n_long"), C.page_type(F.col("path")).alias("page_type"))


def dom39_page_audit(spark, sf_dir):
    return C.findings(_pages(spark, sf_dir))


def agg24_finding_counts(spark, sf_dir):
    return C.finding_counts(C.findings(_pages(spark, sf_dir)))


def joi19_broken_links(spark, sf_dir):
    return C.broken_links(_pages(spark, sf_dir))


def joi20_similar_slugs(spark, sf_dir):
    words = F.filter(F.split(F.regexp_replace(F.lower("title"), "[^a-z ]", ""), " "), lambda w: F.char_length(w) > 3)
    titles = C.parsed(_pages(spark, sf_dir)).select(F.col("page_id").alias("slug"), words.alias("words"))
    return C.similar_slugs(titles)


def agg28_site_rollup(spark, sf_dir):
    bad = C.findings(_pages(spark, sf_dir)).where("severity = 'high'").select("page_id").distinct().withColumn("bad", F.lit(1))
    df = C.parsed(_pages(spark, sf_dir)).select("page_id", "host").join(bad, "page_id", "left")
    return df.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("failed"))


def src12_sitemap(spark, sf_dir):
    return C.sitemap(_pages(spark, sf_dir))


def top05_worklist(spark, sf_dir):
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    found = C.findings(_pages(spark, sf_dir)).join(C.parsed(_pages(spark, sf_dir)).select("page_id", "n_words"), "page_id")
    place = F.row_number().over(Window.partitionBy("host").orderBy(order, F.col("n_words").asc_nulls_last(), "page_id", "class"))
    return found.withColumn("place", place).where("place <= 5").select("host", "place", "page_id", "class", "severity", "n_words")


def _nightly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("site"), F.col("user_id") % 7).alias("site"), F.col("event_type").alias("class"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("night"))


def win26_life_cycle(spark, sf_dir):
    return C.life_cycle(_nightly(spark, sf_dir))


def dom42_job_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return C.consecutive_errors(e.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok")), 1).select("job", "errors")


def agg20_message_sentiment(spark, sf_dir):
    m = view(spark, sf_dir, "messages").withColumn("t", F.split(F.lower("text"), "[^a-z]+"))
    m = m.withColumn("cls", X.message_class(F.col("t"), UP, DOWN)).withColumn("score", X.keyword_score(F.col("t"), UP, DOWN))
    return m.groupBy("symbol", "source").agg(F.count("*").alias("n"), *(F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in ("bullish", "bearish", "neutral")), F.round(F.avg("score"), 6).alias("score"))


def str_n_keyword_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), "[^a-z]+").alias("t"))
    return d.select("doc_id", F.round(X.keyword_score(F.col("t"), UP, DOWN), 6).alias("score"), X.message_class(F.col("t"), UP, DOWN).alias("cls"))


def str_x_hash_ids(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("id", X.short_hash("symbol", "source", F.col("id").cast("string")).alias("candidate_id"), X.slug(F.substring("text", 1, 80)).alias("slug"))


def str_s_fact_sentences(spark, sf_dir):
    return C.fact_sentences(table(spark, sf_dir, "documents"))


def _claims(spark, sf_dir):
    """Every benchmark text as a claim against one of all documents; a few cite beyond the last."""
    docs = table(spark, sf_dir, "documents")
    end = docs.agg((F.max("doc_id") + 7).alias("end"))  # one row
    claims = table(spark, sf_dir, "benchmark").join(F.broadcast(end)).select(F.col("item_id").alias("claim_id"), (F.col("item_id") * 37 % F.col("end")).alias("citation"), "text")
    return C.claim_support(claims, docs.select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 4 + 1).cast("int").alias("tier"), "text"))


def str_w_draft_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = F.array(*map(F.lit, C.REQUIRED))[(F.col("doc_id") % 5).cast("int")]
    drafts = docs.groupBy(F.floor(F.col("doc_id") / 5).alias("draft_id")).agg(F.map_from_entries(F.collect_list(F.struct(part.alias("k"), F.col("text").alias("v")))).alias("sections"))
    return C.draft_gate(drafts)


def dom48_topics(spark, sf_dir):
    p = C.parsed(_pages(spark, sf_dir)).select(X.source_tier(F.col("host")).cast("string").alias("site"), F.regexp_extract(F.lower("title"), "^([a-z]+)", 1).alias("topic"), F.col("title").alias("text"))
    return C.topics(p.where("topic <> ''"), ["th", "an", "er"], "re").select("site", "topic", "n", "recent", "score", "place")


def dom49_review_gate(spark, sf_dir):
    a = _claims(spark, sf_dir).groupBy(F.concat(F.lit("site"), F.col("claim_id") % 5).alias("site")).agg(F.round(F.avg(F.col("verified").cast("double")) + 0.3, 6).alias("share"), F.min(F.coalesce("tier", F.lit(4))).alias("worst_tier"))
    return C.review_gate(a, ["site0"])


def str_m_markdown(spark, sf_dir):
    return _pages(spark, sf_dir).where("html is not null").select("page_id", F.md5(X.to_markdown(F.col("html"))).alias("markdown"))


def dom50_claims(spark, sf_dir):
    return _claims(spark, sf_dir)


def agg27_claim_decision(spark, sf_dir):
    return C.claim_decision(_claims(spark, sf_dir))


def agg26_source_tiers(spark, sf_dir):
    p = _pages(spark, sf_dir).select(X.host(F.col("url")).alias("host"), F.regexp_extract(X.path(F.col("url")), "^/([a-z]+)", 1).alias("topic"), "page_id")
    named = F.array(*map(F.lit, ("www.sec.gov", "www.nature.com", "edition.cnn.com", "cs.x.edu")))
    p = p.withColumn("host", F.when(F.col("page_id") % 5 < 4, named[(F.col("page_id") % 5).cast("int")]).otherwise(F.col("host")))
    return p.withColumn("tier", X.source_tier(F.col("host"))).groupBy("topic").agg(*(F.count_if(F.col("tier") == k).alias(f"tier{k}") for k in (1, 2, 3, 4)))


QUERIES = {f.__name__: f for f in (str_a_visible_text, dom39_page_audit, agg24_finding_counts, joi19_broken_links, joi20_similar_slugs, agg28_site_rollup, src12_sitemap, top05_worklist, win26_life_cycle, dom42_job_health, agg20_message_sentiment, str_n_keyword_scores, str_x_hash_ids, str_s_fact_sentences, dom50_claims, agg27_claim_decision, str_w_draft_gate, dom48_topics, dom49_review_gate, str_m_markdown, agg26_source_tiers)}

_PARSED = f"parsed AS (SELECT page_id, url, {X.HOST_SQL} AS host, {X.PATH_SQL} AS path, COALESCE(html, '') AS html, {X.visible_text_sql('html')} AS text, REGEXP_EXTRACT(COALESCE(html, ''), '<title>([^<]*)</title>', 1) AS title FROM pages), words AS (SELECT *, CAST(CASE WHEN text = '' THEN 0 ELSE LEN(STRING_SPLIT(text, ' ')) END AS INT) AS n_words FROM parsed)"
_SEV = "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEVERITY.items()) + " END"
_FOUND = "WITH " + _PARSED + f""", raw AS (
 SELECT page_id, host, 'unclosed_document' AS class FROM words WHERE NOT ENDS_WITH(html, '</html>')
 UNION ALL SELECT page_id, host, 'no_canonical' FROM words WHERE NOT CONTAINS(html, 'rel="canonical"')
 UNION ALL SELECT page_id, host, 'h1_count' FROM words WHERE LEN(REGEXP_EXTRACT_ALL(html, '<h1>')) <> 1
 UNION ALL SELECT page_id, host, 'duplicate_ad' FROM words WHERE LEN(REGEXP_EXTRACT_ALL(html, '<!-- ad [0-9]+ -->')) > LEN(LIST_DISTINCT(REGEXP_EXTRACT_ALL(html, '<!-- ad [0-9]+ -->')))
 UNION ALL SELECT page_id, host, 'thin_page' FROM words WHERE n_words < {C.THIN_WORDS}
 UNION ALL SELECT page_id, host, 'query_url' FROM words WHERE CONTAINS(url, '?')
 UNION ALL SELECT page_id, host, 'duplicate_title' FROM words WHERE title IN (SELECT title FROM words WHERE title <> '' GROUP BY 1 HAVING COUNT(*) > 1)),
found AS (SELECT *, {_SEV} AS severity FROM raw)"""
_TOK = "LIST_FILTER(STRING_SPLIT_REGEX(LOWER(text), '[^a-z]+'), lambda x: x IN ({}))"
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_UD = f"LEN({_TOK.format(_IN(UP))}) AS u, LEN({_TOK.format(_IN(DOWN))}) AS dn"
_CLS = "CASE WHEN u - dn > 1 THEN 'bullish' WHEN dn - u > 1 THEN 'bearish' ELSE 'neutral' END"
_KEYS = "LIST_DISTINCT([w FOR w IN LIST_CONCAT([REGEXP_REPLACE(LOWER(x), '[,.]+$', '') FOR x IN REGEXP_EXTRACT_ALL(text, '[\\p{L}\\p{N}_][\\p{L}\\p{N}_,.]*') IF REGEXP_MATCHES(x, '^[0-9][0-9,.]*$')], LIST_CONCAT([LOWER(x) FOR x IN REGEXP_EXTRACT_ALL(text, '\\$[A-Za-z0-9]+')], [LOWER(x) FOR x IN REGEXP_EXTRACT_ALL(text, '[\\p{L}\\p{N}_]+') IF REGEXP_MATCHES(x, '^([A-Z][a-z]+|USD|EUR|GBP)$')])) IF LENGTH(w) >= 3])".replace("\\\\", "\\")
_CHECKED = f"""k0 AS (SELECT item_id AS claim_id, item_id * 37 % (SELECT MAX(doc_id) + 7 FROM documents) AS citation, text, {_KEYS} AS k FROM benchmark),
key AS (SELECT claim_id, citation, CASE WHEN LEN(k) > 0 THEN k ELSE LIST_DISTINCT([w FOR w IN STRING_SPLIT_REGEX(LOWER(text), '[^a-z0-9_]+') IF LENGTH(w) >= 4]) END AS key FROM k0),
s0 AS (SELECT claim_id, citation, doc_id, LOWER(text) AS source, CAST(doc_id % 4 + 1 AS INT) AS tier, ROUND(CASE WHEN COALESCE(text, '') <> '' AND LEN(key) > 0 THEN LEN([w FOR w IN key IF CONTAINS(LOWER(text), w)]) / LEN(key) ELSE 0 END, 6) AS score FROM key LEFT JOIN documents ON citation = doc_id),
sc AS (SELECT claim_id, citation, tier, score, CASE WHEN doc_id IS NULL THEN 'citation out of range' WHEN COALESCE(source, '') = '' THEN 'source without text' ELSE '' END AS reason FROM s0),
checked AS (SELECT *, reason = '' AND score >= CASE COALESCE(tier, 4) WHEN 1 THEN 0.15 WHEN 2 THEN 0.20 WHEN 3 THEN 0.30 ELSE 0.45 END AS verified FROM sc)"""
_WORDN = lambda k: f"LEN(REGEXP_EXTRACT_ALL(COALESCE(MAX(CASE WHEN doc_id % 5 = {k} THEN text END), ''), '[A-Za-z0-9_]+(?:[-''][A-Za-z0-9_]+)*'))"
_SHARE = "COALESCE(AVG(CASE WHEN verified THEN 1E0 ELSE 0E0 END), 0)"
ORACLE_SQL = {
    "str_a_visible_text": f"WITH {_PARSED} SELECT page_id, host, path, title, n_words, MD5(text) AS text_md5, CAST(LEN(LIST_FILTER(REGEXP_EXTRACT_ALL(text, '[A-Za-z0-9_''-]+'), lambda w: LENGTH(w) >= 2)) AS INT) AS n_long, CASE WHEN REGEXP_MATCHES(path, '(privacy|terms|legal|imprint)') THEN 'legal' WHEN REGEXP_MATCHES(path, '^/([a-z]{{2}}/?)?$') THEN 'listing' ELSE 'article' END AS page_type FROM words",
    "dom39_page_audit": _FOUND + " SELECT page_id, host, class, severity FROM found",
    "agg24_finding_counts": _FOUND + " SELECT severity, class, COUNT(*) AS n, COUNT(DISTINCT page_id) AS pages FROM found GROUP BY ROLLUP (severity, class)",
    "joi19_broken_links": f"SELECT page_id, target FROM (SELECT DISTINCT page_id, UNNEST(REGEXP_EXTRACT_ALL(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) l WHERE target LIKE '/%' AND target NOT IN (SELECT {X.PATH_SQL} FROM pages)",
    "joi20_similar_slugs": f"WITH {_PARSED}, w AS (SELECT DISTINCT page_id AS slug, UNNEST(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(LOWER(title), '[^a-z ]', '', 'g'), ' '), lambda x: LENGTH(x) > 3)) AS w FROM words), n AS (SELECT slug, COUNT(*) AS n FROM w GROUP BY 1), k AS (SELECT a.slug, b.slug AS other, COUNT(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.slug < b.slug GROUP BY 1, 2) SELECT k.slug, other, ROUND(k / (x.n + y.n - k), 6) AS jaccard FROM k JOIN n x ON k.slug = x.slug JOIN n y ON k.other = y.slug WHERE ROUND(k / (x.n + y.n - k), 6) >= 0.5",
    "agg28_site_rollup": _FOUND + " SELECT w.host, COUNT(*) AS pages, COUNT(b.page_id) AS failed FROM words w LEFT JOIN (SELECT DISTINCT page_id FROM found WHERE severity = 'high') b ON w.page_id = b.page_id GROUP BY 1",
    "src12_sitemap": "SELECT DISTINCT loc, ROUND(GREATEST(1.0 - 0.2 * LEN(LIST_FILTER(STRING_SPLIT(REGEXP_EXTRACT(loc, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')), 0.3), 1)::DOUBLE AS priority FROM (SELECT REGEXP_REPLACE(url, '[?#].*$', '') AS loc FROM pages WHERE url IS NOT NULL) x",
    "top05_worklist": _FOUND + " SELECT host, place, page_id, class, severity, n_words FROM (SELECT f.host, f.page_id, class, severity, n_words, CAST(ROW_NUMBER() OVER (PARTITION BY f.host ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n_words, f.page_id, class) AS INT) AS place FROM found f JOIN words w ON f.page_id = w.page_id) x WHERE place <= 5",
    "win26_life_cycle": """WITH o AS (SELECT DISTINCT 'site' || CAST(user_id % 7 AS VARCHAR) AS site, event_type AS class, CAST(DATE_DIFF('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS night FROM events),
r AS (SELECT *, night - ROW_NUMBER() OVER (PARTITION BY site, class ORDER BY night) AS run FROM o), c AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY site, class, run ORDER BY night) AS INT) AS nights FROM r)
SELECT site, class, night, nights, CASE nights WHEN 1 THEN 'new' WHEN 2 THEN 'carried' ELSE 'escalated' END AS stage FROM c
UNION ALL SELECT site, class, CAST(MAX(night) + 1 AS INT), MAX(nights), 'resolved' FROM c GROUP BY site, class, run HAVING MAX(night) < (SELECT MAX(night) FROM o)""",
    "dom42_job_health": "WITH g AS (SELECT user_id AS job, event_type <> 'error' AS ok, SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS good FROM events) SELECT job, COUNT(*) AS errors FROM (SELECT *, MAX(good) OVER (PARTITION BY job) AS top FROM g) x WHERE good = top AND NOT ok GROUP BY 1",
    "agg20_message_sentiment": oracle("messages", f", t AS (SELECT symbol, source, {_UD} FROM messages) SELECT symbol, source, COUNT(*) AS n, " + ", ".join(f"COUNT(CASE WHEN {_CLS} = '{c}' THEN 1 END) AS n_{c}" for c in ("bullish", "bearish", "neutral")) + ", ROUND(AVG(CASE WHEN u + dn > 0 THEN (u - dn) / (u + dn) END), 6) AS score FROM t GROUP BY 1, 2"),
    "str_n_keyword_scores": f"WITH t AS (SELECT doc_id, {_UD} FROM documents) SELECT doc_id, ROUND(CASE WHEN u + dn > 0 THEN (u - dn) / (u + dn) END, 6) AS score, {_CLS} AS cls FROM t",
    "str_x_hash_ids": oracle("messages", "SELECT id, SUBSTR(SHA256(symbol || '|' || source || '|' || CAST(id AS VARCHAR)), 1, 16) AS candidate_id, SUBSTR(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(SUBSTR(text, 1, 80)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug FROM messages"),
    "str_s_fact_sentences": rf"""WITH p AS (SELECT doc_id, STRING_SPLIT(REGEXP_REPLACE(REGEXP_REPLACE(text, '[ \t\r\n]+', ' ', 'g'), '([.!?]) ([A-Z])', '\1' || CHR(1) || '\2', 'g'), CHR(1)) AS p FROM documents), e AS (SELECT doc_id, TRIM(UNNEST(p)) AS s, UNNEST(RANGE(LEN(p))) AS pos FROM p),
k AS (SELECT doc_id, LOWER(SUBSTR(s, 1, 80)) AS k, MIN(pos) AS pos, ARG_MIN(s, pos) AS s FROM e WHERE LENGTH(s) BETWEEN 40 AND 350 AND NOT REGEXP_MATCHES(LOWER(s), '{C.BOILERPLATE}') AND (REGEXP_MATCHES(s, '{C.NUMBER}') OR REGEXP_MATCHES(s, '{C.DEFINES}')) GROUP BY 1, 2)
SELECT doc_id, place, s AS sentence FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS place FROM k) x WHERE place <= 8""",
    "str_w_draft_gate": "WITH d AS (SELECT doc_id // 5 AS draft_id, " + ", ".join(f"{_WORDN(i)} AS n{i}" for i in range(5)) + " FROM documents GROUP BY 1), t AS (SELECT *, CAST(n0 + n1 + n2 + n3 + n4 AS INT) AS total, CONCAT_WS(' ', " + ", ".join(f"CASE WHEN n{i} = 0 THEN '{k}' END" for i, k in enumerate(C.REQUIRED)) + ") AS missing, CONCAT_WS(' ', " + ", ".join(f"CASE WHEN n{i} BETWEEN 1 AND 119 THEN '{k}' END" for i, k in enumerate(C.REQUIRED)) + ") AS short FROM d), l AS (SELECT *, CASE WHEN total < 400 THEN 'fail' WHEN total < 800 THEN 'warn' WHEN total < 1200 THEN 'below preferred' ELSE 'good' END AS level FROM t) SELECT draft_id, total, missing, short, level, missing = '' AND short = '' AND level <> 'fail' AS ok FROM l",
    "dom48_topics": f"WITH {_PARSED}, r AS (SELECT CAST({X.source_tier_sql('host')} AS VARCHAR) AS site, REGEXP_EXTRACT(LOWER(title), '^([a-z]+)', 1) AS topic, title AS text FROM words), g AS (SELECT site, topic, COUNT(text) AS n, COUNT(CASE WHEN CONTAINS(text, 're') THEN 1 END) AS recent FROM r WHERE topic <> '' GROUP BY 1, 2), s AS (SELECT *, ROUND(0.4 * LEAST(n / 5, 1) + 0.4 * LEAST((CASE WHEN CONTAINS(topic, 'th') THEN 1 ELSE 0 END + CASE WHEN CONTAINS(topic, 'an') THEN 1 ELSE 0 END + CASE WHEN CONTAINS(topic, 'er') THEN 1 ELSE 0 END) / 2, 1) + 0.2 * LEAST(recent / 2, 1), 3) AS score FROM g) SELECT * FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY site ORDER BY score DESC, topic) AS INT) AS place FROM s) x WHERE place <= 5",
    "dom49_review_gate": f"WITH {_CHECKED}, a AS (SELECT 'site' || CAST(claim_id % 5 AS VARCHAR) AS site, ROUND(AVG(CASE WHEN verified THEN 1E0 ELSE 0E0 END) + 0.3, 6) AS share, MIN(COALESCE(tier, 4)) AS worst_tier FROM checked GROUP BY 1), b AS (SELECT *, CASE WHEN site = 'site0' THEN 'mandatory' WHEN share < 0.85 THEN 'few claims verified' WHEN worst_tier >= 4 THEN 'unranked sources' ELSE '' END AS reason FROM a) SELECT *, reason <> '' AS review FROM b",
    "dom50_claims": f"WITH {_CHECKED} SELECT claim_id, citation, tier, score, verified, reason FROM checked",
    "agg27_claim_decision": f"WITH {_CHECKED} SELECT COUNT(*) AS n, ROUND({_SHARE}, 6) AS share, CASE WHEN {_SHARE} >= 0.85 THEN 'pass' WHEN {_SHARE} >= 0.5 THEN 'needs_revision' ELSE 'reject' END AS decision FROM checked",
    "agg26_source_tiers": f"WITH p AS (SELECT CASE page_id % 5 WHEN 0 THEN 'www.sec.gov' WHEN 1 THEN 'www.nature.com' WHEN 2 THEN 'edition.cnn.com' WHEN 3 THEN 'cs.x.edu' ELSE {X.HOST_SQL} END AS host, REGEXP_EXTRACT({X.PATH_SQL}, '^/([a-z]+)', 1) AS topic FROM pages), t AS (SELECT topic, {X.source_tier_sql('host')} AS tier FROM p) SELECT topic, " + ", ".join(f"COUNT(CASE WHEN tier = {k} THEN 1 END) AS tier{k}" for k in (1, 2, 3, 4)) + " FROM t GROUP BY 1",
}
