"""Page audits, their findings' life cycle, and claims against sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

SEVERITY = {"unclosed_document": "high", "no_canonical": "medium", "h1_count": "medium", "duplicate_ad": "low", "thin_page": "high", "duplicate_title": "medium", "query_url": "low"}
THIN_WORDS = 300
#: Sets that share a word, or slugs that share a set, that one join key holds at most.
BLOCK = 1000


def parsed(pages: DataFrame) -> DataFrame:
    """One projection of everything the detectors need; each page is read once."""
    html = F.coalesce("html", F.lit(""))
    text = X.visible_text(F.col("html"))
    df = pages.select("page_id", "url", X.host(F.col("url")).alias("host"), X.path(F.col("url")).alias("path"), "html", text.alias("text"), F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"))
    return df.withColumn("n_words", X.space_words(F.col("text")))


def page_type(path: Column) -> Column:
    """STR-C: legal, listing or article, from the path."""
    return F.when(path.rlike(r"(privacy|terms|legal|imprint)"), "legal").when(path.rlike(r"^/([a-z]{2}/?)?$"), "listing").otherwise("article")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*)"'))


def findings(pages: DataFrame) -> DataFrame:
    """DOM39, SET6: (page_id, host, class, severity) for every fault of every page.

    Page-local detectors are one array that is exploded; duplicate titles are a
    count by host and title, pre-aggregated before its shuffle.
    """
    df = parsed(pages)
    html = F.coalesce("html", F.lit(""))
    slots = F.regexp_extract_all(html, F.lit(r"<!-- (ad \d+) -->"))
    faults = F.array(
        F.when(~html.endswith("</html>"), F.lit("unclosed_document")),
        F.when(~html.contains('rel="canonical"'), F.lit("no_canonical")),
        F.when(F.regexp_count(html, F.lit("<h1>")) != 1, F.lit("h1_count")),
        F.when(F.size(slots) > F.size(F.array_distinct(slots)), F.lit("duplicate_ad")),
        F.when(F.col("n_words") < THIN_WORDS, F.lit("thin_page")),
        F.when(F.col("url").contains("?"), F.lit("query_url")),
    )
    local = df.select("page_id", "host", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("class"))
    titles = df.where("title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")
    twice = df.join(titles, "title", "left_semi").select("page_id", "host", F.lit("duplicate_title").alias("class"))
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return local.unionByName(twice).withColumn("severity", severity[F.col("class")])


def finding_counts(found: DataFrame) -> DataFrame:
    """AGG24: counts by severity and class, with totals (null)."""
    return found.rollup("severity", "class").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def broken_links(pages: DataFrame) -> DataFrame:
    """JOI19: internal links whose target is no known path, by anti-join."""
    df = pages.select("page_id", "html", X.path(F.col("url")).alias("path"))
    links = df.select("page_id", F.explode(F.array_distinct(hrefs(F.col("html")))).alias("target")).where("target like '/%'")
    known = df.select(F.col("path").alias("target")).distinct()
    return links.join(known, "target", "left_anti")


def similar_slugs(paths: DataFrame, least: float = 0.5) -> DataFrame:
    """JOI20: for each (slug, words), other slugs that share at least half of all their words.

    Equal word sets are one set.  Each set's words are ordered from rare to
    frequent; two similar sets' first common word is among the first
    n - ceil(n / 2) + 1 words of both, so sets are joined on these alone and a
    pair is taken at that word.  Words and sets with many members are cut into
    blocks, and each pair of blocks is a join key of its own.
    """
    low = least - 5e-7  # what still rounds to it
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("words"))))
    slugs = paths.groupBy("slug").agg(words.alias("words")).where("size(words) > 0").withColumn("name", F.sha2(F.to_json("words"), 256))
    sets = slugs.groupBy("name").agg(F.first("words").alias("words"), F.count("*").alias("members"))
    w = sets.select("name", F.explode("words").alias("w"))
    ordered = w.join(w.groupBy("w").agg(F.count("*").alias("c")), "w").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"]).alias("words"))
    prefix = F.slice("words", 1, (F.size("words") - F.ceil(low * F.size("words")) + 1).cast("int"))
    rare = ordered.select("name", "words", F.explode(prefix).alias("w"))
    hot = rare.groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    rare = rare.join(hot, "w", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("c") / BLOCK), F.lit(1)))
    rare = rare.withColumn("own", F.pmod(F.xxhash64("name"), "blocks"))
    one = rare.select("w", F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"), F.col("name").alias("a"), F.col("words").alias("wa"))
    two = rare.select("w", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("x"), F.col("own").alias("y"), F.col("name").alias("b"), F.col("words").alias("wb"))
    n, m, k = F.size("wa"), F.size("wb"), F.size("common")
    pairs = one.join(two, ["w", "x", "y"]).where("x < y or a < b").where((n >= low * m) & (m >= low * n)).withColumn("common", F.array_intersect("wa", "wb"))
    pairs = pairs.where(F.get("common", F.lit(0)) == F.col("w")).withColumn("jaccard", F.round(k / (n + m - k), 6)).where(F.col("jaccard") >= least).select("a", "b", "jaccard")
    pairs = pairs.union(sets.where("members > 1").select("name", "name", F.lit(1.0)))
    blocks = sets.select(F.col("name").alias("b"), F.ceil(F.col("members") / BLOCK).alias("blocks"))
    others = slugs.select(F.col("name").alias("b"), F.col("slug").alias("other")).join(blocks, "b").select("b", F.pmod(F.xxhash64("other"), "blocks").alias("block"), "other")
    out = pairs.join(slugs.select(F.col("name").alias("a"), "slug"), "a").join(blocks, "b").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    out = out.join(others, ["b", "block"]).where("a <> b or slug < other")
    return out.select(F.least("slug", "other").alias("slug"), F.greatest("slug", "other").alias("other"), "jaccard")


def life_cycle(nightly: DataFrame) -> DataFrame:
    """WIN26, DOM44, SET5: rows (site, class, night) of open findings to their nights in a row and stage: new, carried (2) or escalated (3 and more);
    and a resolved row for the night after a run ends, if there is a later night."""
    by = Window.partitionBy("site", "class").orderBy("night")
    df = nightly.select("site", "class", "night").distinct()
    df = df.withColumn("run", F.col("night") - F.row_number().over(by))
    df = df.withColumn("nights", F.row_number().over(Window.partitionBy("site", "class", "run").orderBy("night")))
    last = df.agg(F.max("night").alias("end"))
    ended = df.groupBy("site", "class", "run").agg(F.max("night").alias("night"), F.max("nights").alias("nights")).join(F.broadcast(last)).where("night < end")
    opened = df.select("site", "class", "night", "nights", F.when(F.col("nights") == 1, "new").when(F.col("nights") == 2, "carried").otherwise("escalated").alias("stage"))
    return opened.unionByName(ended.select("site", "class", (F.col("night") + 1).alias("night"), "nights", F.lit("resolved").alias("stage")))


def sitemap(pages: DataFrame) -> DataFrame:
    """SRC12: distinct URLs without query and fragment, with a priority that falls by depth."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    depth = F.size(F.filter(F.split(X.path(url), "/"), lambda p: p != ""))
    return pages.where("url is not null").select(url.alias("loc"), F.round(F.greatest(F.lit(1.0) - 0.2 * depth, F.lit(0.3)), 1).alias("priority")).distinct()


def consecutive_errors(runs: DataFrame, least: int = 2) -> DataFrame:
    """DOM42: jobs whose last run failed, with the number of failures in a row, where that is at least two; rows (job, ts, id, ok)."""
    by = Window.partitionBy("job").orderBy("ts", "id")
    df = runs.withColumn("good", F.sum(F.col("ok").cast("int")).over(by))
    end = df.groupBy("job").agg(F.max("good").alias("good"))
    tail = df.join(end, ["job", "good"]).where("not ok").groupBy("job").agg(F.count("*").alias("errors"), F.max("ts").alias("last_ts"))
    return tail.where(F.col("errors") >= least)


#: The least score of a verified claim by the tier of its source; the better the source, the less.
TIER_LEAST = {1: 0.15, 2: 0.20, 3: 0.30, 4: 0.45}


def claim_support(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """JOI21, STR-T, DOM50: rows (claim_id, citation, text) to the share of their key tokens that the cited source (idx, tier, text) has.

    A claim without key tokens goes by its words of four and more letters.
    Verified from its source's tier's least score on; an unknown source or one
    without text is kept with its reason.
    """
    key = X.key_tokens(F.col("text"))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda w: F.char_length(w) >= 4))
    got = claims.withColumn("key", F.when(F.size(key) > 0, key).otherwise(words))
    got = got.join(sources.select(F.col("idx").alias("citation"), "tier", F.lower("text").alias("source"), F.lit(True).alias("there")), "citation", "left")
    hits = F.size(F.filter("key", lambda w: F.col("source").contains(w)))
    score = F.when((F.coalesce("source", F.lit("")) != "") & (F.size("key") > 0), hits / F.size("key")).otherwise(0.0)
    least = F.create_map(*(F.lit(x) for kv in TIER_LEAST.items() for x in kv))[F.coalesce("tier", F.lit(4))]
    reason = F.when(F.col("there").isNull(), "citation out of range").when(F.coalesce("source", F.lit("")) == "", "source without text").otherwise("")
    got = got.withColumn("score", F.round(score, 6)).withColumn("reason", reason)
    return got.select("claim_id", "citation", "tier", "score", ((F.col("reason") == "") & (F.col("score") >= least)).alias("verified"), "reason")


def claim_decision(checked: DataFrame, quality_ok: bool = True) -> DataFrame:
    """AGG27: pass from a share of 0.85 verified claims, needs_revision from 0.5, else reject; reject without the draft's quality."""
    share = F.coalesce(F.avg(F.col("verified").cast("double")), F.lit(0.0))
    decision = F.when(~F.lit(quality_ok), "reject").when(share >= 0.85, "pass").when(share >= 0.5, "needs_revision").otherwise("reject")
    return checked.agg(F.count("*").alias("n"), F.round(share, 6).alias("share"), decision.alias("decision"))


def review_gate(articles: DataFrame, mandatory: list[str]) -> DataFrame:
    """DOM49: rows (site, share, worst_tier) with review and its reason: mandatory sites, too few verified claims, or unranked sources only."""
    reason = F.when(F.col("site").isin(*mandatory), "mandatory").when(F.col("share") < 0.85, "few claims verified").when(F.col("worst_tier") >= 4, "unranked sources").otherwise("")
    return articles.withColumn("reason", reason).withColumn("review", F.col("reason") != "")


NUMBER = r"(^|[^0-9A-Za-z_])([0-9]{4}|[0-9]+%|\$[0-9,.]+|[0-9]+\.[0-9]+)($|[^0-9A-Za-z_])"
DEFINES = r"^[A-Z][A-Za-z0-9_ -]+ (is|was|founded|published|developed|created|designed|introduced|released)"
BOILERPLATE = r"privacy policy|terms of use|cookie policy|navigation menu|search results"


def fact_sentences(docs: DataFrame, most: int = 8) -> DataFrame:
    """STR-S: the first distinct sentences of 40 to 350 characters with a year, share, sum or decimal, or that define something, eight a document at most."""
    marked = F.regexp_replace(F.regexp_replace("text", r"[ \t\r\n]+", " "), r"([.!?]) ([A-Z])", "$1\u0001$2")
    parts = docs.select("doc_id", F.posexplode_outer(F.split(marked, "\u0001")).alias("at", "s"))
    kept = parts.withColumn("s", F.trim("s")).where(F.char_length("s").between(40, 350) & ~F.lower("s").rlike(BOILERPLATE) & (F.col("s").rlike(NUMBER) | F.col("s").rlike(DEFINES)))
    once = kept.groupBy("doc_id", F.lower(F.substring("s", 1, 80)).alias("k")).agg(F.min("at").alias("at"), F.min_by("s", "at").alias("s"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("doc_id", "place", F.col("s").alias("sentence"))


REQUIRED = ("intro", "worked_example", "common_mistakes", "decision_checklist", "when_doesnt_apply")


def draft_gate(drafts: DataFrame, section: int = 120, fail: int = 400, warn: int = 800, prefer: int = 1200) -> DataFrame:
    """STR-W: drafts(draft_id, sections map<string, string>): words in all, sections that are missing or short, the level of the total, and ok."""
    words = lambda t: F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)*"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), words(F.try_element_at("sections", F.lit(k))).alias("n")) for k in REQUIRED))
    df = drafts.withColumn("_e", each).withColumn("total", F.aggregate("_e", F.lit(0), lambda a, x: a + x["n"]))
    names = lambda f: F.array_join(F.transform(F.filter("_e", f), lambda x: x["k"]), " ")
    level = F.when(F.col("total") < fail, "fail").when(F.col("total") < warn, "warn").when(F.col("total") < prefer, "below preferred").otherwise("good")
    df = df.withColumn("missing", names(lambda x: x["n"] == 0)).withColumn("short", names(lambda x: (x["n"] > 0) & (x["n"] < section))).withColumn("level", level)
    return df.select("draft_id", "total", "missing", "short", "level", ((F.col("missing") == "") & (F.col("short") == "") & (F.col("level") != "fail")).alias("ok"))


def topics(results: DataFrame, niche: list[str], year: str, per_site: int = 5) -> DataFrame:
    """STR-U, DOM48, TOP7: results(site, topic, text) to each site's best topics by 0.4 volume, 0.4 niche terms in the topic and 0.2 results that name the year."""
    share = lambda c, full: F.least(c / full, F.lit(1.0))
    hits = F.lit(0)
    for t in niche:
        hits = hits + F.lower("topic").contains(t).cast("int")
    got = results.groupBy("site", "topic").agg(F.count("text").alias("n"), F.count_if(F.col("text").contains(year)).alias("recent"))
    score = F.when(F.col("n") == 0, 0.4).otherwise(F.round(0.4 * share(F.col("n"), 5.0) + 0.4 * share(hits, 2.0) + 0.2 * share(F.col("recent"), 2.0), 3))
    got = got.withColumn("score", score)
    return got.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "topic"))).where(F.col("place") <= per_site)
