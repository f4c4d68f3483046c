"""Edit spans: applying them gives what the repairs give."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gristmill.operators import audit as A, edits as E

PAGE = "page_id long, site string, path string, html string"


def pages(spark):
    rnd = random.Random(3)
    pair = "<p><em>Sources: a</em></p><p><em>Disclaimer: b</em></p>"
    slot = lambda n: f'<ins class="adsbygoogle" data-ad-slot="{n}"></ins>'
    bits = ["<p>é text</p>", "😀", pair, f"<hr>{pair}", slot(7), slot(7), slot(8), '<ins class="adsbygoogle"></ins>', "id=G-G-AB12", "G-AB12", "G-G-G-X1 ", "xG-G-Y", "<br>", '<a href="/part4/">x</a>', '<a href="/part4/more">y</a>', '<a href="/part4/">again</a>']
    rows = [(i, "s", f"/articles/p{i}/", "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))) for i in range(120)]
    long = "<p>" + "word " * 1600 + "</p>"
    rows += [
        (900, "s", "/articles/a/", f"<h1>t</h1><article>{long}</ARTICLE><main></main>"), (901, "s", "/articles/b/", f" <h1>t</h1>{long}<p>two</p><p>three</p></body>"), (902, "s", "/articles/c/", f"<!-- ca-pub-77x -->{long}</body></body>"),
        (903, "s", "/articles/d/", long), (904, "s", "/articles/e/", f"<article>{long}{slot(3)}</article>"), (905, "s", "/part/4/", "target"), (906, "s", "/articles/f/", None), (907, "s", "/articles/g/", ""),
    ]
    return spark.createDataFrame(rows, PAGE).cache()


def test_applied_spans_equal_the_repairs(spark):
    df = pages(spark)
    spans = E.edit_spans(df).cache()
    got = {(r.fix, r.page_id): r.html for r in E.repaired_pages(df, spans).collect()}
    html = F.coalesce("html", F.lit(""))
    want = {}
    for fix, f in (("ga4_typo", A.repaired_ids), ("dedup_ad_slots", A.without_double_slots), ("dedup_footer", A.without_double_footer)):
        for r in df.select("page_id", html.alias("was"), f(html).alias("after")).where("was <> after").collect():
            want[fix, r.page_id] = r.after
    local = {k: v for k, v in got.items() if k[0] in ("ga4_typo", "dedup_ad_slots", "dedup_footer")}
    assert local == want and {k[0] for k in want} == {"ga4_typo", "dedup_ad_slots", "dedup_footer"}
    text = {r.page_id: r.html or "" for r in df.collect()}
    for r in spans.collect():
        assert text[r.page_id][r.at : r.at + len(r.old)] == r.old and r.old != r.new
    linked = {k[1]: v for k, v in got.items() if k[0] == "broken_internal_link"}
    assert linked == {i: t.replace('href="/part4/"', 'href="/part/4/"') for i, t in text.items() if 'href="/part4/"' in t}


def test_an_ad_tag_goes_where_one_is_missing(spark):
    df = pages(spark)
    got = {r.page_id: r for r in E.edit_spans(df, "ca-pub-1").where("fix = 'missing_ad_unit'").collect()}
    text = {r.page_id: r.html for r in df.collect()}
    assert set(got) == {900, 901, 902}
    assert got[900].at == text[900].lower().index("</article>") and got[902].at == text[902].rindex("</body>")
    assert text[901][: got[901].at].endswith("<p>two</p>")
    assert all(r.old == "" and r.new.startswith("\n<ins") and r.new.endswith("</script>\n") for r in got.values())
    assert {i: 'data-ad-client="ca-pub-1"' in r.new for i, r in got.items()} == {900: True, 901: True, 902: False} and 'data-ad-client="ca-pub-77x"' in got[902].new


def test_of_overlapping_edits_the_earlier_counts(spark):
    df = spark.createDataFrame([("abcdef", [(3, "de", "X"), (0, "ab", ""), (1, "b", "Y"), (6, "", "!")])], f"html string, edits {E.EDIT}")
    assert df.select(E.applied(F.col("html"), F.col("edits")).alias("x")).first().x == "cXf!"
