"""Queries of the site audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A, edits as E
from ..sources.views import oracle, view


def _site(spark, sf_dir):
    return view(spark, sf_dir, "site")


def str_c_page_types(spark, sf_dir):
    return A.parsed(_site(spark, sf_dir)).select("page_id", "page_type", "n_words", "n_ads", "n_slots", "n_h1", "n_sources", "n_disclaimers", F.size("typos").alias("n_typos"))


def str_d_missing_sections(spark, sf_dir):
    return A.parsed(_site(spark, sf_dir)).select("page_id", F.array_join(A.missing_sections(F.col("text")), " ").alias("missing"))


def str_g_double_footers(spark, sf_dir):
    once = _site(spark, sf_dir).where("html is not null").withColumn("once", A.without_double_footer(F.col("html")))
    return once.select("page_id", F.md5("once").alias("after"), (A.without_double_footer(F.col("once")) == F.col("once")).alias("stable"))


def str_h_repairs(spark, sf_dir):
    return _site(spark, sf_dir).where("html is not null").select("page_id", F.md5(A.repaired_ids(F.col("html"))).alias("ids"), F.md5(A.without_double_slots(F.col("html"))).alias("slots"))


def str_i_link_candidates(spark, sf_dir):
    return A.broken_links(_site(spark, sf_dir)).select("target").distinct().select("target", F.array_join(A.link_candidates(F.col("target")), " ").alias("candidates"))


def str_f_blocks(spark, sf_dir):
    return _site(spark, sf_dir).where("html is not null").select("page_id", A.block(F.col("html")).alias("box")).where("box is not null")


def dom39_site_audit(spark, sf_dir):
    return A.findings(_site(spark, sf_dir))


def dom40_gate(spark, sf_dir):
    return A.gate(_site(spark, sf_dir))


def agg28_gate_rollup(spark, sf_dir):
    return A.site_rollup(A.gate(_site(spark, sf_dir)))


def agg24_site_counts(spark, sf_dir):
    return A.counts(A.findings(_site(spark, sf_dir)))


def dom47_upgrade_worklist(spark, sf_dir):
    site = _site(spark, sf_dir)
    return A.worklist(A.findings(site), site)


def joi19_site_links(spark, sf_dir):
    return A.broken_links(_site(spark, sf_dir))


def joi20_link_repairs(spark, sf_dir):
    return A.link_repairs(_site(spark, sf_dir))


def dom45_repairs(spark, sf_dir):
    return A.repairs(_site(spark, sf_dir)).groupBy("site", "fix").agg(F.count("*").alias("n"))


def dom45_edit_spans(spark, sf_dir):
    """The pages that applying the edits of identifiers, slots and footers gives."""
    site = _site(spark, sf_dir)
    spans = E.edit_spans(site).where("fix in ('ga4_typo', 'dedup_ad_slots', 'dedup_footer')")
    return E.repaired_pages(site, spans).select("page_id", "fix", F.md5("html").alias("after"))


def _staged(spark, sf_dir):
    found = A.findings(_site(spark, sf_dir)).select("site", "class", "severity")
    live = _site(spark, sf_dir).where("site <> 'site0'").select("site", F.lit("live_non_200").alias("class"), F.lit("high").alias("severity")).distinct()
    return A.classified(found.union(live), view(spark, sf_dir, "carried"))


def joi23_classified(spark, sf_dir):
    return _staged(spark, sf_dir)


def dom44_escalations(spark, sf_dir):
    return A.escalations(_staged(spark, sf_dir))


def joi22_orphans(spark, sf_dir):
    return A.orphans(view(spark, sf_dir, "markdown"), _site(spark, sf_dir))


def dom46_source_of_truth(spark, sf_dir):
    site = _site(spark, sf_dir)
    return A.source_of_truth(site, view(spark, sf_dir, "markdown"), site.where("page_id % 9 = 0").select("site", "path"))


def src12_site_map(spark, sf_dir):
    return A.sitemap(_site(spark, sf_dir)).drop("lastmod")


QUERIES = {f.__name__: f for f in (str_c_page_types, str_d_missing_sections, str_f_blocks, str_g_double_footers, str_h_repairs, str_i_link_candidates, dom39_site_audit, dom40_gate, agg28_gate_rollup, agg24_site_counts, dom47_upgrade_worklist, joi19_site_links, joi20_link_repairs, dom45_repairs, dom45_edit_spans, joi23_classified, dom44_escalations, joi22_orphans, dom46_source_of_truth, src12_site_map)}

_N = lambda p: f"REGEXP_REPLACE('/' || REPLACE(REPLACE({p}, 'index.html', ''), '.html', '') || '/', '/+', '/', 'g')"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LISTED = ", ".join(map(_Q, A.COLLECTIONS))
_TYPE = f"CASE WHEN REGEXP_MATCHES(np, '/({'|'.join(A.LEGAL)})/$') THEN 'legal_umbrella' WHEN REGEXP_MATCHES(np, '/({'|'.join(A.CONTENT)})/') AND NOT REGEXP_MATCHES(last, '^[0-9]+$') AND last NOT IN ({_LISTED}) THEN 'content_article' ELSE 'other' END"
_PARSED = f""", p0 AS (SELECT *, LOWER({_N('path')}) AS np, REGEXP_EXTRACT(LOWER({_N('path')}), '([^/]*)/$', 1) AS last, COALESCE(html, '') AS h, {X.visible_text_sql('html')} AS text FROM site WHERE NOT REGEXP_MATCHES(path, '/archived?/')),
p1 AS (SELECT page_id, site, path, html IS NULL AS unread, {_TYPE} AS page_type, CASE WHEN text = '' THEN 0 ELSE LEN(STRING_SPLIT(text, ' ')) END AS n_words, text, LEN(REGEXP_EXTRACT_ALL(h, '(?i)<ins\\s+class="adsbygoogle"')) AS n_ads, LEN(LIST_DISTINCT(REGEXP_EXTRACT_ALL(h, 'data-ad-slot="([0-9]+)"', 1))) AS n_slots,
 LEN(REGEXP_EXTRACT_ALL(h, '\\bG-G-[A-Z0-9]+\\b')) AS n_typos, LEN(REGEXP_EXTRACT_ALL(h, '(?i)<h1\\b')) AS n_h1, REGEXP_MATCHES(h, '<link\\s+rel="(icon|shortcut icon|apple-touch-icon)"') AS has_icon, REGEXP_MATCHES(h, '<link\\s+rel="canonical"\\s+href="[^"]+"') AS has_canonical,
 LEN(REGEXP_EXTRACT_ALL(h, '(?i)<em>\\s*Sources:')) AS n_sources, LEN(REGEXP_EXTRACT_ALL(h, '(?i)<em>\\s*Disclaimer:')) AS n_disclaimers, REGEXP_EXTRACT_ALL(h, 'href="(/[^"#?]*)"', 1) AS links FROM p0)"""
_LINKS = f""", l0 AS (SELECT page_id, site, UNNEST(links) AS target FROM p1), l1 AS (SELECT * FROM l0 WHERE NOT STARTS_WITH(target, '//') AND NOT STARTS_WITH(target, '/_') AND (NOT CONTAINS(REGEXP_EXTRACT(target, '([^/]*)$', 1), '.') OR ENDS_WITH(target, '.html'))),
broken AS (SELECT l1.* FROM l1 WHERE (site, {_N('target')}) NOT IN (SELECT (site, {_N('path')}) FROM site))"""
_MISSING = "CONCAT_WS(' ', " + ", ".join(f"CASE WHEN NOT REGEXP_MATCHES(LOWER(text), {_Q(p)}) THEN '{k}' END" for k, p in A.SECTIONS.items()) + ")"
_SEV = "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.SEVERITY.items()) + " END"
_LOW = f"page_type <> 'other' AND n_words < {A.LEAST_WORDS}"
_RULES = {
    "html_read_error": "unread", "missing_favicon": "NOT unread AND NOT has_icon", "missing_canonical": "NOT unread AND NOT has_canonical", "duplicate_h1": "n_h1 > 1", "duplicate_ad_slot": "n_ads > 0 AND n_ads > n_slots",
    "word_count_low": f"NOT unread AND {_LOW}", "thin_with_ads": f"{_LOW} AND n_ads > 0", "missing_eeat_sections": f"page_type = 'legal_umbrella' AND n_words >= {A.SECTION_WORDS} AND {_MISSING} <> ''", "missing_ad_unit": f"page_type <> 'other' AND n_ads = 0 AND n_words >= {A.AD_WORDS}",
}
_FOUND = _PARSED + _LINKS + ", f0 AS (" + " UNION ALL ".join(f"SELECT page_id, site, n_words, n_ads, '{k}' AS class FROM p1 WHERE {c}" for k, c in _RULES.items()) + f""" UNION ALL SELECT page_id, site, n_words, n_ads, 'ga4_typo' FROM p1 CROSS JOIN RANGE(100) r(i) WHERE r.i < n_typos UNION ALL SELECT page_id, site, NULL, NULL, 'broken_internal_link' FROM broken),
found AS (SELECT page_id, site, class, CASE WHEN class = 'word_count_low' AND n_ads > 0 THEN 'critical' ELSE {_SEV} END AS severity, class IN ({', '.join(map(_Q, A.FIXABLE))}) AS fixable, CAST(n_words AS INT) AS n_words FROM f0)"""
_BOX = "NULLIF(REGEXP_EXTRACT(h, '(?s)<section class=\"eeat-block\">.*?</section>'), '')"
_SCOPE = f"COALESCE({_BOX}, h)"
_LACK = "[x FOR x IN [" + ", ".join(f"CASE WHEN NOT REGEXP_MATCHES(scope, {_Q(p)}) THEN '{k}' END" for k, p in A.RECIPE.items()) + "] IF x IS NOT NULL]"
_PLAIN = "REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(h, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g')"
_GATE = f""", g0 AS (SELECT page_id, site, COALESCE(html, '') AS h FROM site),
g1 AS (SELECT *, LEN([w FOR w IN REGEXP_EXTRACT_ALL({_PLAIN}, '[A-Za-z0-9_''-]+') IF LENGTH(w) >= 2]) AS n_words, {_BOX} IS NOT NULL AS boxed, {_SCOPE} AS scope FROM g0), g2 AS (SELECT *, {_LACK} AS lacking FROM g1),
g3 AS (SELECT page_id, site, CAST(n_words AS INT) AS n_words, [x FOR x IN [CASE WHEN n_words < {A.GATE_FAIL} THEN 'words' END, CASE WHEN NOT REGEXP_MATCHES(h, '(?i)<ins\\s+class="adsbygoogle"|data-ad-client|ca-pub-|googletagmanager\\.com') THEN 'no_ads' END, CASE WHEN NOT boxed AND LEN(lacking) <= {len(A.RECIPE) - 3} THEN 'unboxed_sections' END,
 CASE WHEN boxed AND LEN(lacking) > 0 THEN 'box_lacks ' || ARRAY_TO_STRING(lacking, ' ') END, CASE WHEN LEN(REGEXP_EXTRACT_ALL(h, '(?i)<em>\\s*Sources:')) > 1 OR LEN(REGEXP_EXTRACT_ALL(h, '(?i)<em>\\s*Disclaimer:')) > 1 THEN 'double_footer' END] IF x IS NOT NULL] AS f,
 [x FOR x IN [CASE WHEN n_words BETWEEN {A.GATE_FAIL} AND {A.GATE_WARN - 1} THEN 'few_words' END, CASE WHEN NOT REGEXP_MATCHES(h, '(?i)<link[^>]+rel="canonical"[^>]*href="[^"]+"') THEN 'no_canonical' END, CASE WHEN NOT boxed THEN 'no_box' END] IF x IS NOT NULL] AS w FROM g2),
gated AS (SELECT page_id, site, n_words, ARRAY_TO_STRING(f, '; ') AS failures, ARRAY_TO_STRING(w, '; ') AS warnings, LEN(f) = 0 AS ok FROM g3)"""
_FAMILY = lambda c: f"CASE WHEN STARTS_WITH({c}, 'live_') THEN 'live_' ELSE {c} END"
_STAGED = f""", t0 AS (SELECT site, class, severity FROM found UNION ALL SELECT DISTINCT site, 'live_non_200', 'high' FROM site WHERE site <> 'site0'), t AS (SELECT site, class, ARG_MAX(severity, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS severity, {_FAMILY('class')} AS family FROM t0 GROUP BY 1, 2),
c AS (SELECT *, {_FAMILY('class')} AS family FROM carried), kin AS (SELECT site, family, ARG_MIN(nights, class) AS kin FROM c GROUP BY 1, 2),
j AS (SELECT t.*, COALESCE(c.nights, kin.kin) AS before FROM t LEFT JOIN c ON t.site = c.site AND t.class = c.class LEFT JOIN kin ON t.site = kin.site AND t.family = kin.family),
staged AS (SELECT site, class, severity, CAST(COALESCE(before + 1, 1) AS INT) AS nights, CASE WHEN before IS NULL THEN 'new' WHEN before + 1 >= 3 THEN 'escalated' ELSE 'carried' END AS stage, class IN ({', '.join(map(_Q, A.AUTO_FIX))}) AND severity <> 'critical' AS auto_fix FROM j
 UNION ALL SELECT c.site, c.class, NULL, CAST(nights AS INT), 'resolved', FALSE FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.site = c.site AND t.family = c.family))"""
_STEM = f"REGEXP_EXTRACT(REGEXP_REPLACE({_N('path')}, '/$', ''), '([^/]*)$', 1)"
_CAND = """CASE WHEN REGEXP_MATCHES(target, '(?i)^/[a-z][a-z0-9-]*[0-9]+/?$') THEN '/' || REGEXP_EXTRACT(target, '(?i)^/([a-z][a-z0-9-]*?)([0-9]+)/?$', 1) || '/' || REGEXP_EXTRACT(target, '(?i)^/([a-z][a-z0-9-]*?)([0-9]+)/?$', 2) || '/ /' || REGEXP_EXTRACT(target, '(?i)^/([a-z][a-z0-9-]*?)([0-9]+)/?$', 1) || '/'
 WHEN REGEXP_MATCHES(target, '(?i)^/[a-z][a-z0-9-]*/[0-9]+_') THEN '/' || REGEXP_EXTRACT(target, '(?i)^/([a-z][a-z0-9-]*)/([0-9]+)_', 1) || '/' || REGEXP_EXTRACT(target, '(?i)^/([a-z][a-z0-9-]*)/([0-9]+)_', 2) || '/' ELSE '' END"""
_WORDS = lambda p: f"LIST_DISTINCT(REGEXP_EXTRACT_ALL(REGEXP_EXTRACT(LOWER(REGEXP_REPLACE({p}, '/+$', '')), '([^/]*)$', 1), '[a-z]+'))"
_PARENT = lambda p: f"REGEXP_EXTRACT(REGEXP_REPLACE({p}, '/+$', ''), '^(.*/)[^/]*$', 1)"
_REPAIR = f""", b AS (SELECT DISTINCT * FROM broken), k AS (SELECT DISTINCT site, {_N('path')} AS dest FROM site), cd AS (SELECT *, STRING_SPLIT({_CAND}, ' ') AS cs FROM b), ce AS (SELECT page_id, site, target, UNNEST(cs) AS cand, UNNEST(RANGE(LEN(cs))) AS nth FROM cd),
direct AS (SELECT page_id, ce.site, target, ARG_MIN(dest, nth) AS dest, 1E0 AS score FROM ce JOIN k ON k.site = ce.site AND k.dest = cand GROUP BY 1, 2, 3),
near AS (SELECT page_id, b.site, target, dest, ROUND(LEN(LIST_INTERSECT({_WORDS('target')}, {_WORDS('dest')})) / LEN(LIST_DISTINCT(LIST_CONCAT({_WORDS('target')}, {_WORDS('dest')}))), 6) AS score FROM b JOIN k ON k.site = b.site AND {_PARENT('dest')} = {_PARENT(_N('target'))} WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.page_id = b.page_id AND d.target = b.target)),
fixes AS (SELECT * FROM direct UNION ALL SELECT page_id, site, target, dest, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, site, target ORDER BY score DESC, dest DESC) AS rn FROM near WHERE score >= 0.5) x WHERE rn = 1)"""
_P2, _T2 = "<p><em>Sources: a</em></p><p><em>Disclaimer: b</em></p>", '<ins class="adsbygoogle" data-ad-slot="7"></ins>'
_ONE_FOOT = f"REPLACE(html, '{_P2}<hr>{_P2}', '{_P2}')"
_ONE_SLOT = f"REPLACE(CASE WHEN CONTAINS(html, 'data-ad-slot=\"7\"></ins>{_T2}{_T2}') THEN REPLACE(html, 'data-ad-slot=\"7\"></ins>{_T2}{_T2}', 'data-ad-slot=\"7\"></ins>') ELSE html END, '{_T2}{_T2}', '{_T2}')"
_ID = "REPLACE(html, 'G-G-AB12CD34EF', 'G-AB12CD34EF')"
ORACLE_SQL = {
    "str_c_page_types": oracle("site", _PARSED + " SELECT page_id, page_type, CAST(n_words AS INT) AS n_words, n_ads, n_slots, n_h1, n_sources, n_disclaimers, n_typos FROM p1"),
    "str_d_missing_sections": oracle("site", _PARSED + f" SELECT page_id, {_MISSING} AS missing FROM p1"),
    "str_f_blocks": oracle("site", f", q AS (SELECT page_id, COALESCE(html, '') AS h FROM site) SELECT page_id, {_BOX} AS box FROM q WHERE {_BOX} IS NOT NULL"),
    "str_g_double_footers": oracle("site", f" SELECT page_id, MD5({_ONE_FOOT}) AS after, TRUE AS stable FROM site WHERE html IS NOT NULL"),
    "dom45_edit_spans": oracle("site", f" SELECT page_id, fix, MD5(after) AS after FROM (SELECT page_id, html, 'ga4_typo' AS fix, {_ID} AS after FROM site UNION ALL SELECT page_id, html, 'dedup_ad_slots', {_ONE_SLOT} FROM site UNION ALL SELECT page_id, html, 'dedup_footer', {_ONE_FOOT} FROM site) q WHERE html <> after"),
    "str_h_repairs": oracle("site", f" SELECT page_id, MD5({_ID}) AS ids, MD5({_ONE_SLOT}) AS slots FROM site WHERE html IS NOT NULL"),
    "str_i_link_candidates": oracle("site", _PARSED + _LINKS + f" SELECT DISTINCT target, {_CAND} AS candidates FROM broken"),
    "dom39_site_audit": oracle("site", _FOUND + " SELECT * FROM found"),
    "dom40_gate": oracle("site", _GATE + " SELECT * FROM gated"),
    "agg28_gate_rollup": oracle("site", _GATE + " SELECT site, COUNT(*) AS pages, COUNT(CASE WHEN ok THEN 1 END) AS passed, COUNT(CASE WHEN NOT ok THEN 1 END) AS failed FROM gated GROUP BY 1"),
    "agg24_site_counts": oracle("site", _FOUND + " SELECT site, severity, class, COUNT(*) AS n, COUNT(DISTINCT page_id) AS pages FROM found GROUP BY ROLLUP (site, severity, class)"),
    "dom47_upgrade_worklist": oracle("site", _FOUND + f""" SELECT f.site, CAST(ROW_NUMBER() OVER (PARTITION BY f.site ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, COALESCE(f.n_words, 9999), f.page_id, class) AS INT) AS place, f.page_id, class, severity, f.n_words,
 CASE page_type WHEN 'legal_umbrella' THEN CASE class WHEN 'missing_eeat_sections' THEN 'legal_umbrella_about' ELSE 'legal_umbrella_legal' END WHEN 'content_article' THEN 'content_article' ELSE 'thin_content_article' END AS recipe FROM found f JOIN p1 ON f.page_id = p1.page_id WHERE class IN ({', '.join(map(_Q, A.AD_CLASSES))})"""),
    "joi19_site_links": oracle("site", _PARSED + _LINKS + " SELECT page_id, site, target FROM broken"),
    "joi20_link_repairs": oracle("site", _PARSED + _LINKS + _REPAIR + ' SELECT page_id, site, target, dest AS "to", score FROM fixes'),
    "dom45_repairs": oracle("site", _PARSED + _LINKS + _REPAIR + f""" SELECT site, fix, COUNT(*) AS n FROM (SELECT site, 'ga4_typo' AS fix FROM site WHERE {_ID} <> html UNION ALL SELECT site, 'dedup_ad_slots' FROM site WHERE {_ONE_SLOT} <> html UNION ALL SELECT site, 'dedup_footer' FROM site WHERE {_ONE_FOOT} <> html UNION ALL SELECT site, 'broken_internal_link' FROM (SELECT DISTINCT page_id, site FROM fixes) z) x GROUP BY 1, 2"""),
    "joi23_classified": oracle("site carried", _FOUND + _STAGED + " SELECT * FROM staged"),
    "dom44_escalations": oracle("site carried", _FOUND + _STAGED + " SELECT site, COUNT(*) AS n, MAX(nights) AS longest, STRING_AGG(DISTINCT class, ' ' ORDER BY class) AS classes FROM staged WHERE stage = 'escalated' GROUP BY 1"),
    "joi22_orphans": oracle("site markdown", f" SELECT * FROM markdown WHERE (site, stem) NOT IN (SELECT (site, {_STEM}) FROM site)"),
    "dom46_source_of_truth": oracle("site markdown", f", q AS (SELECT page_id, site, {_N('path')} AS np, {_STEM} AS stem FROM site) SELECT page_id, site, stem, CASE WHEN (site, stem) IN (SELECT (site, stem) FROM markdown) THEN 'md' WHEN (site, np) IN (SELECT (site, {_N('path')}) FROM site WHERE page_id % 9 = 0) THEN 'inline' ELSE 'hand' END AS source FROM q UNION ALL SELECT NULL, site, stem, 'orphan' FROM markdown WHERE (site, stem) NOT IN (SELECT (site, stem) FROM q)"),
    "src12_site_map": oracle("site", f" SELECT DISTINCT site, {_N('path')} AS loc, CASE WHEN {_N('path')} = '/' THEN 1E0 WHEN LENGTH({_N('path')}) - LENGTH(REPLACE({_N('path')}, '/', '')) = 2 THEN 8E-1 ELSE 7E-1 END AS priority FROM site"),
}
