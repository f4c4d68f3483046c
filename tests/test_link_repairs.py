"""Repairs of links whose last part has no words, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from gristmill.operators import edits as E
from gristmill.plans.registry import ORACLE_SQL
from gristmill.sources import views as V

from .test_long_walks import assert_same


@pytest.fixture(scope="module")
def numbered(tmp_path_factory):
    """Pages 8, 44, 80, ... of one site are /part/N/, 7 and 43 are /é/ and /the/; the others link to pages that aren't there."""
    folder = tmp_path_factory.mktemp("numbered")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT page_id, 'http://x/' AS url, '<html><head></head><body>' || CASE page_id WHEN 7 THEN '<a href="/é">a</a>' WHEN 43 THEN '<a href="/the">a</a>' ELSE '' END
                             || CASE WHEN page_id % 9 < 7 THEN '<a href="/part/' || page_id + 100 || '">a</a><a href="/ñ">b</a><a href="/the-other">c</a><a href="/un">d</a><a href="/articles/7">e</a>' ELSE '' END || '<footer></footer></body></html>' AS html
                           FROM RANGE(120) t(page_id)) TO '{folder}/pages.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["joi20_link_repairs", "dom45_repairs"])
def test_links_without_words(spark, numbered, name):
    assert_same(spark, name, *numbered, ORACLE_SQL[name])


def test_what_is_proposed(numbered):
    """The cases that the pages above are meant for are there: /part/N and /ñ meet pages without words, /the-other one with half its words, others none."""
    got = set(numbered[1].execute(f"SELECT DISTINCT REGEXP_REPLACE(target, '[0-9]+', 'N'), ISNAN(score) FROM ({ORACLE_SQL['joi20_link_repairs']}) q").fetchall())
    assert got == {("/part/N", True), ("/ñ", True), ("/the-other", False)}


def test_edits_need_a_word_in_common(spark, numbered):
    spans = E.edit_spans(V.view(spark, numbered[0], "site")).where("fix = 'broken_internal_link'").toPandas()
    assert set(spans["old"]) == {'href="/the-other"'} and set(spans["new"]) == {'href="/the/"'}
