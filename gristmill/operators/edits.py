"""DOM45, STR-H: repairs as spans: where a page's text changes, from what, to what, and what comes of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import audit as A

EDIT = "array<struct<at: int, old: string, new: string>>"
# The ad tag that is put in, and before which closing tags it goes, the first that is there.
AD_UNIT = '<ins class="adsbygoogle" style="display:block" data-ad-client="{client}" data-ad-slot="0000000000" data-ad-format="auto" data-full-width-responsive="true"></ins>\n<script>(adsbygoogle = window.adsbygoogle || []).push({});</script>'
BEFORE = ("</article>", "</main>", "</section>")


def _none() -> Column:
    return F.expr(f"cast(array() as {EDIT})")


def _walk(parts: Column, changed: Callable[[Column, Column], Column], base: Column | int = 0) -> Column:
    """Edits of a text that is cut into parts: changed(part, number) is what a part becomes, null where it stays.

    One walk along the parts carries the offset, so that each edit is where its part is.
    """
    base = F.lit(base) if isinstance(base, int) else base
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), changed(p, i).alias("new")))
    start = F.struct(base.cast("int").alias("at"), _none().alias("out"))

    def step(a: Column, x: Column) -> Column:
        edit = F.array(F.struct(a["at"].alias("at"), x["p"].alias("old"), x["new"].alias("new")))
        return F.struct((a["at"] + F.char_length(x["p"])).alias("at"), F.when(x["new"].isNull(), a["out"]).otherwise(F.concat(a["out"], edit)).alias("out"))

    return F.aggregate(numbered, start, step, lambda a: a["out"])


def _between(text: Column, pattern: str) -> Column:
    """text cut into what lies between the matches of pattern and the matches, by turns."""
    rest, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.flatten(F.transform(rest, lambda r, i: F.array_compact(F.array(r, F.get(found, i)))))


def id_edits(html: Column) -> Column:
    """Doubled prefixes of analytics ids made single."""
    return _walk(_between(html, r"\bG-(?:G-)+[A-Z0-9]+\b"), lambda p, i: F.when(i % 2 == 1, A.repaired_ids(p)))


def slot_edits(html: Column) -> Column:
    """The second and later ad tags of a slot taken out."""
    tag = r"(?i)<ins\s+class=\"adsbygoogle\""
    parts = F.split(html, rf"(?i)(?=<ins\s+class=\"adsbygoogle\")|(?<=</ins>)")
    slots = F.transform(parts, lambda p: F.when(p.rlike("^" + tag) | p.rlike(r"(?i)^<ins\s+class=\"adsbygoogle\""), F.nullif(F.regexp_extract(p, A.AD_SLOT, 1), F.lit(""))))
    return _walk(parts, lambda p, i: F.when(F.get(slots, i).isNotNull() & (F.array_position(slots, F.get(slots, i)) <= i), F.lit("")))


def footer_edits(html: Column) -> Column:
    """The second and later pairs of sources and disclaimer lines taken out, with rules before them."""
    pair = r"<p><em>\s*Sources:(?:(?!</p>).)*</p>\s*<p><em>\s*Disclaimer:(?:(?!</p>).)*</p>"
    first = F.regexp_extract(html, f"(?is){pair}", 0)
    to = F.instr(html, first) - 1 + F.char_length(first)
    rest = _between(F.substr(html, to + 1), rf"(?is)\s*(?:<hr\s*/?>\s*)?{pair}")
    return F.when(first != "", _walk(rest, lambda p, i: F.when(i % 2 == 1, F.lit("")), to)).otherwise(_none())


def unit_edit(html: Column, client: Column) -> Column:
    """One ad tag put in before the end of the article, the main part or a section, else after the second paragraph below the first heading, else before the end of the body; nothing where an ad is.  Its client is the page's own, else client."""
    low = F.lower(html)
    at = F.lit(None).cast("int")
    body = F.when(F.instr(low, "</body>") > 0, F.char_length(html) - F.char_length(F.element_at(F.split(low, "</body>"), -1)) - len("</body>"))
    head = F.greatest(F.instr(low, "<h1"), F.instr(low, "<h2"))
    below = F.split(F.substr(low, head), "(?<=</p>)")
    second = F.when((head > 1) & (F.size(below) > 2), head - 1 + F.char_length(F.concat(below[0], below[1])))
    for tag in reversed(BEFORE):
        at = F.when(F.instr(low, tag) > 1, F.instr(low, tag) - 1).otherwise(at)
    at = F.coalesce(at, second, body)
    own = F.coalesce(F.nullif(F.regexp_extract(html, "ca-pub-[A-Za-z0-9]+", 0), F.lit("")), client)
    new = F.concat(F.lit("\n" + AD_UNIT.split("{client}")[0]), own, F.lit(AD_UNIT.split("{client}")[1] + "\n"))
    return F.when(at.isNotNull() & ~html.rlike(A.AD_TAG), F.array(F.struct(at.cast("int").alias("at"), F.lit("").alias("old"), new.alias("new")))).otherwise(_none())


def edit_spans(pages: DataFrame, client: str = "ca-pub-0000000000000000") -> DataFrame:
    """(page_id, site, fix, nth, at, old, new) of pages(page_id, site, path, html): the edits that each repair makes, in order; nothing is written.

    at counts code points from 0 in the page as it is; a null html counts as
    empty.  Links are replaced in their href attributes, as link_repairs()
    proposes, but for scores of NaN, which share no word; the ad tag is put in
    only where findings() misses one.
    """
    html = F.coalesce("html", F.lit(""))
    local = F.array(*(F.struct(F.lit(k).alias("fix"), edits(html).alias("edits")) for k, edits in (("ga4_typo", id_edits), ("dedup_ad_slots", slot_edits), ("dedup_footer", footer_edits))))
    own = pages.select("page_id", "site", F.explode(local).alias("x")).select("page_id", "site", "x.fix", F.posexplode("x.edits").alias("nth", "e"))
    bare = A.findings(pages).where("class = 'missing_ad_unit'").select("page_id").distinct()
    units = pages.join(bare, "page_id", "left_semi").select("page_id", "site", F.lit("missing_ad_unit").alias("fix"), F.posexplode(unit_edit(html, F.lit(client))).alias("nth", "e"))
    # a link is looked for by its whole attribute, so targets that begin alike are not confused
    links = A.link_repairs(pages).where(~F.isnan("score")).join(pages.select("page_id", html.alias("html")), "page_id")
    quoted = F.concat(F.lit('href="'), F.col("target"), F.lit('"'))
    pieces = F.split(F.col("html"), F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)|(?<=\\Q"), quoted, F.lit("\\E)")))
    found = links.select("page_id", "site", F.explode(_walk(pieces, lambda p, i: F.when(p == quoted, F.concat(F.lit('href="'), F.col("to"), F.lit('"'))))).alias("e"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("e.at")) - 1
    found = found.select("page_id", "site", F.lit("broken_internal_link").alias("fix"), nth.alias("nth"), "e")
    return own.unionByName(units).unionByName(found).select("page_id", "site", "fix", "nth", "e.at", "e.old", "e.new")


def applied(html: Column, edits: Column) -> Column:
    """html after edits, an array of (at, old, new) in any order; of edits that overlap the earlier one counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, e: Column) -> Column:
        done = F.struct((e["at"] + F.char_length(e["old"])).alias("at"), F.concat(a["out"], F.substr(html, a["at"] + 1, e["at"] - a["at"]), e["new"]).alias("out"))
        return F.when(e["at"] >= a["at"], done).otherwise(a)

    return F.aggregate(F.array_sort(edits), start, step, lambda a: F.concat(a["out"], F.substr(html, a["at"] + 1)))


def repaired_pages(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """(page_id, site, fix, html) of each page and repair that spans(page_id, fix, at, old, new) has edits of."""
    edits = spans.groupBy("page_id", "fix").agg(F.collect_list(F.struct("at", "old", "new")).alias("edits"))
    return pages.select("page_id", "site", F.coalesce("html", F.lit("")).alias("html")).join(edits, "page_id").select("page_id", "site", "fix", applied(F.col("html"), F.col("edits")).alias("html"))
