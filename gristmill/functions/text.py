"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLOCKS = r"<script[^>]*>[\s\S]*?</script>|<style[^>]*>[\s\S]*?</style>|<svg[^>]*>[\s\S]*?</svg>|<!--[\s\S]*?-->"
TAG = r"<[^>]*>"
ENTITY = r"&[a-zA-Z#0-9]+;"
GAPS = r"[ \t\r\n]+"


def visible_text(html: Column) -> Column:
    """STR-A: the text a reader sees: no scripts, styles, drawings, comments, tags or entities; single spaces."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), BLOCKS, " "), TAG, " "), ENTITY, " ")
    return F.trim(F.regexp_replace(text, GAPS, " "))


def visible_text_sql(html: str) -> str:
    return f"TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(COALESCE({html}, ''), '{BLOCKS}', ' ', 'g'), '{TAG}', ' ', 'g'), '{ENTITY}', ' ', 'g'), '{GAPS}', ' ', 'g'))"


def space_words(text: Column) -> Column:
    """Words between single spaces."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def long_words(text: Column, least: int = 2) -> Column:
    """STR-B: runs of ASCII letters, digits, apostrophes and hyphens of at least two characters."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_'-]+)")), lambda w: F.char_length(w) >= least))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path without query and fragment; / if there is none."""
    p = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


HOST_SQL = "LOWER(REGEXP_EXTRACT(COALESCE(url, ''), '^[a-zA-Z]+://([^/?#]*)', 1))"
PATH_SQL = "COALESCE(NULLIF(REGEXP_EXTRACT(COALESCE(url, ''), '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def slug(text: Column) -> Column:
    """STR-V: lower-case letters and digits with single hyphens, 60 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def short_hash(*columns: Column | str, n: int = 16) -> Column:
    """STR-X: the first hex digits of SHA-256 over the fields with | between."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, n)


def keyword_score(tokens: Column, up: list[str], down: list[str]) -> Column:
    """STR-N: (ups - downs) / (ups + downs); null without any."""
    u = F.size(F.filter(tokens, lambda t: t.isin(up)))
    d = F.size(F.filter(tokens, lambda t: t.isin(down)))
    return F.when(u + d > 0, (u - d) / (u + d))


def message_class(tokens: Column, up: list[str], down: list[str]) -> Column:
    """STR-O: bullish or bearish where one side leads by more than one hit, else neutral."""
    u = F.size(F.filter(tokens, lambda t: t.isin(up)))
    d = F.size(F.filter(tokens, lambda t: t.isin(down)))
    return F.when(u - d > 1, "bullish").when(d - u > 1, "bearish").otherwise("neutral")


def cashtags(text: Column, most: int = 5) -> Column:
    """STR-P: distinct $ABC tickers of two to five letters, the first five."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\$([A-Za-z]{2,5})\b")), lambda t: F.upper(t))), 1, most)


def contextual_tickers(text: Column, most: int = 5) -> Column:
    """STR-P: distinct tickers that words such as shares, stock, calls or puts follow, or that long, short, bought or sold precede."""
    after = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,5})\s+(?:shares|stock|calls|puts)\b"))
    before = F.regexp_extract_all(text, F.lit(r"\b(?:long|short|bought|sold|buy|sell)\s+([A-Z]{2,5})\b"))
    return F.slice(F.array_distinct(F.concat(cashtags(text, 50), after, before)), 1, most)


def option_symbol(s: Column) -> Column:
    """STR-Q: root, expiry, side and strike of an OSI symbol (ROOTyymmddC00000000); null if it isn't one."""
    part = lambda i: F.regexp_extract(s, r"^([A-Z]{1,6}) *(\d{6})([CP])(\d{8})$", i)
    return F.when(s.rlike(r"^[A-Z]{1,6} *\d{6}[CP]\d{8}$"), F.struct(part(1).alias("root"), F.to_date(part(2), "yyMMdd").alias("expiry"), part(3).alias("side"), (part(4).cast("double") / 1000).alias("strike")))


# Hosts by authority; all others are of tier 4.
TIERS = {
    1: (".gov", ".edu", "irs.gov", "sec.gov", "federalreserve.gov", "bls.gov", "census.gov", "uspto.gov", "copyright.gov", "congress.gov"),
    2: ("reuters.com", "ap.org", "bloomberg.com", "wsj.com", "ft.com", "nytimes.com", "nature.com", "sciencemag.org", "nejm.org", "thelancet.com", "wikipedia.org"),
    3: ("forbes.com", "cnbc.com", "cnn.com", "bbc.com", "theguardian.com", "npr.org", "washingtonpost.com", "investopedia.com", "kiplinger.com"),
}


def source_tier(name: Column) -> Column:
    """STR-R: the authority of a host, 1 to 4: the first tier with a name that the host holds."""
    out = F.lit(4)
    for tier in reversed(TIERS):
        held = F.lit(False)
        for x in TIERS[tier]:
            held = held | F.lower(name).contains(x)
        out = F.when(held, tier).otherwise(out)
    return out


def source_tier_sql(name: str) -> str:
    return "CASE " + " ".join(f"WHEN " + " OR ".join(f"CONTAINS(LOWER({name}), '{x}')" for x in hosts) + f" THEN {tier}" for tier, hosts in TIERS.items()) + " ELSE 4 END"


def key_tokens(claim: Column) -> Column:
    """STR-T: what a claim stands on, lower-case and distinct: numbers, currencies and capitalised words of three and more characters."""
    words = F.regexp_extract_all(claim, F.lit(r"([\p{L}\p{N}_]+)"))
    names = F.filter(words, lambda w: w.rlike("^([A-Z][a-z]+|USD|EUR|GBP)$"))
    numbers = F.filter(F.regexp_extract_all(claim, F.lit(r"([\p{L}\p{N}_][\p{L}\p{N}_,.]*)")), lambda w: w.rlike("^[0-9][0-9,.]*$"))
    numbers = F.transform(numbers, lambda w: F.regexp_replace(w, "[,.]+$", ""))
    every = F.concat(numbers, F.regexp_extract_all(claim, F.lit(r"(\$[A-Za-z0-9]+)")), names)
    return F.array_distinct(F.filter(F.transform(every, F.lower), lambda w: F.char_length(w) >= 3))


def front_matter(text: Column) -> Column:
    """STR-J: the key: value lines between the first two --- lines, as a map; empty without such a block."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\w+:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1).alias("k"), F.trim(F.regexp_replace(x, r"^\w+:", "")).alias("v"))))


def short_option_symbol(s: Column) -> Column:
    """STR-Q: the other convention (.ROOTyymmddC123.5): root, expiry, side and strike; null if it isn't one."""
    pattern = r"^\.?([A-Z]{1,6})(\d{6})([CP])(\d+(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    return F.when(s.rlike(pattern), F.struct(part(1).alias("root"), F.to_date(part(2), "yyMMdd").alias("expiry"), part(3).alias("side"), part(4).cast("double").alias("strike")))


def table_rows(block: Column) -> Column:
    """STR-J: the cells of a pipe table, a row each, without the rule below its head."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def sections(body: Column) -> Column:
    """STR-J: a document's parts between rules of three or more underscores, in order, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"(?m)^_{3,}\s*$"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda x: x != "")


def topic_line(category: Column, tags: Column, tickers: Column, title: Column, most: int = 8) -> Column:
    """STR-L: category, four tags, four tickers and three words of the title (four and more letters), distinct, eight at most."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z ]", ""), " +"), lambda w: F.char_length(w) >= 4)
    none = F.expr("cast(array() as array<string>)")
    every = F.concat(F.array(F.lower(F.coalesce(category, F.lit("")))), F.slice(F.coalesce(tags, none), 1, 4), F.slice(F.coalesce(tickers, none), 1, 4), F.slice(words, 1, 3))
    return F.array_join(F.slice(F.array_distinct(F.filter(every, lambda x: x != "")), 1, most), " ")


def to_markdown(html: Column) -> Column:
    """STR-M: headings, emphasis, links, list items, breaks and paragraphs as Markdown; other tags are dropped, common entities decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "\n\n" + "#" * n + " $1\n\n")
    for tags, mark in (("strong|b", "**"), ("em|i", "*"), ("code", "`")):
        out = F.regexp_replace(out, rf"(?is)<({tags})\b[^>]*>(.*?)</\1>", f"{mark}$2{mark}")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<li\b[^>]*>(.*?)</li>", "\n- $1"), r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</?p\b[^>]*>", "\n\n"), r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def from_markdown_inline(text: Column) -> Column:
    """STR-M: bold, italic, code and links of a line of Markdown as HTML; markup characters are escaped first."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    return F.regexp_replace(F.regexp_replace(out, r"`(.+?)`", "<code>$1</code>"), r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')


def long_date(d: Column) -> Column:
    """DAT7: a date as September 7, 2026."""
    return F.date_format(d, "MMMM d, yyyy")
