"""Every stage of the corpus pipeline against a brute-force version, on its own input."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gristmill.llm import byte_bpe, decontaminate, pii, queries, toxicity  # noqa: E402

from .test_text_operators import components, infix  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        where = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF).write.parquet(where)
        out.append(spark.read.parquet(where))
    return out


def ids(df) -> set:
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_schema_and_rows(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert after.exceptAll(before).count() == 0


def test_toxic_documents_go(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages[1]) == ids(toxicity.scored(stages[0], model).where("predicted = 0"))
    assert len(ids(stages[1])) > 150


def test_one_of_each_group_stays(stages):
    groups = components({r.doc_id: r.text or "" for r in stages[1].collect()})
    assert ids(stages[2]) == {d for d, (n, c) in groups.items() if n == 0 or d == c}


def test_texts_that_share_a_doc_id_are_judged_apart(spark):
    x, y, z, w = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyzw")
    rows = [(3, y), (5, y + " more"), (5, x), (7, z), (7, w), (7, w), (7, w.upper()), (8, z), (9, " "), (9, "\t"), (10, x + " more")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string").repartition(4)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates_out(spark, docs, SF).collect())
    assert got == sorted([(3, y), (5, x), (7, z), (7, w.upper()), (9, " "), (9, "\t")])


def test_contaminated_documents_go(spark, stages):
    import re

    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode())
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for r in stages[2].collect():
        w = words(r.text or "")
        own = set(w)
        for i in items:
            # an item within its allowed distance shares most of its words
            if i and sum(x in own for x in i) >= 0.8 * len(i) - 1 and infix(i, w) <= decontaminate.allowed(len(i)):
                bad.add(r.doc_id)
    assert bad and ids(stages[3]) == ids(stages[2]) - bad


def test_personal_data_is_masked(spark, stages):
    after = {r.doc_id: r for r in stages[4].collect()}
    spans = {r.doc_id: r.spans for r in pii.found(stages[3], pii.default_crf()).collect()}
    changed = 0
    for r in stages[3].collect():
        if spans[r.doc_id]:
            changed += 1
            assert "<" in after[r.doc_id].text and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert after[r.doc_id] == r
    assert changed and len(after) == stages[3].count()


def test_token_ids(stages):
    enc = byte_bpe.encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.pattern())
    got = {r.doc_id: r.n_tokens for r in stages[5].collect()}
    assert got == {r.doc_id: len(enc.encode_ordinary(r.text)) for r in stages[4].collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars int, _text string, _n string, length_before string, p string, node string"


def odd_rows() -> list[tuple]:
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    texts = [(1, a), (1, b), (1, a), (None, a), (None, b), (None, None), (2, None), (2, ""), (3, " \n\t"), (4, "mail a.b@c.example.com now"), (5, "0" * 5000 + ".1.1.1"), (6, "word " * 50_000)]
    return [(d, t, None, "s", None if t is None else len(t), "keep", "n", "l", "p", "x") for d, t in texts]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stage_on_odd_rows_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    got = stage(spark, docs, SF).collect()
    assert all(tuple(r)[5:] == ("keep", "n", "l", "p", "x") for r in got)
    key = lambda r: (str(r[0]), str(r[1]))
    if name == "ngram_jaccard_join":
        assert len(got) == len(odd_rows()) - 1  # the one row that repeats another
    else:
        assert len(got) == len(odd_rows())
    if name != "pii":
        assert {key(r) for r in got} == {key(r) for r in odd_rows()}
    else:
        assert {r.text for r in got if r.doc_id == 4} == {"mail <email> now"} and {r.n_chars for r in got if r.doc_id == 4} == {len("mail <email> now")}
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_last_stage_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    got = corpus_pipeline.token_ids(spark, docs, SF)
    assert got.count() == len(odd_rows()) and got.where("n_tokens = 0").count() == 3
    assert corpus_pipeline.token_ids(spark, docs.limit(0), SF).count() == 0
