"""Chat formatting, centroid clustering and token alignment against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import centroids, chat_format, queries, token_alignment
from gristmill.llm.chat_format import MARKED, Template

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, seq string, piece string"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# ---------------------------------------------------------------- chat format


def talks() -> list[tuple]:
    rnd = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "/s>", "INST]", "\n", "é", "😀", " ", "ok", "</s>\n", "<s>user[INST]"]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, None), (None, 0, "assistant", "x"), (2, 5, "a<s>\n[INST]", ""), (3, 0, "assistant", None)]
    for c in range(10, 40):
        rows += [(c, i, rnd.choice(["user", "assistant", "system", "<s>"]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))) for i in range(rnd.randrange(1, 50))]
    rows += [(50, i, "assistant" if i % 2 else "user", "long " * (40_000 if i == 3 else 3)) for i in range(200)]
    return [(*r, "clash", "clash") for r in rows]


def expected_digests(rows: list[tuple]) -> dict:
    by = collections.defaultdict(list)
    low = lambda x: (x is not None, x or 0)
    text = lambda x: (x is not None, x or "")
    for c, t, role, said, *_ in rows:
        by[c].append((low(t), text(role), text(said)))
    out = {}
    for c, turns in by.items():
        turns = [(r[1], s[1]) for _, r, s in sorted(turns)]
        loss = "".join(s for r, s in turns if r == "assistant")
        whole = MARKED.render(turns, 0)
        out[c] = (len(turns), sha("".join(f"{r}\n{s}\n" for r, s in turns)), len(loss), sha(loss), len(whole))
    return out


def test_chat_digests_are_read_from_the_output(spark):
    df = spark.createDataFrame(talks(), TALK).repartition(5)
    pieces = chat_format.formatted(df)
    for in_order in (True, False):
        got = {r[0]: tuple(r[1:]) for r in chat_format.read_back(pieces, in_order=in_order).collect()}
        assert got == expected_digests(talks())
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0
    assert chat_format.rewritten(pieces).count() == 0


def test_spans_equal_those_of_whole_prefixes(spark):
    got = collections.defaultdict(list)
    for r in chat_format.formatted(spark.createDataFrame(talks(), TALK)).orderBy("conv_id", "seq").collect():
        got[r.conv_id].append(r)
    for rows in got.values():
        output = ""
        turns = []
        for r in rows:
            assert r.start == len(output) and r.rewrote == 0
            output += r.piece
            (_, text, a, b), *more = MARKED.read(r.piece)
            assert not more
            turns.append((r.role, text))
            assert (r.loss_start, r.loss_end) == ((a, b) if r.role == "assistant" else (None, None))
        assert output == MARKED.render(turns, 0)
        assert [(r, t) for r, t, _, _ in MARKED.read(output)] == turns


def test_escaping_is_reversible():
    rnd = random.Random(1)
    for _ in range(3000):
        s = "".join(rnd.choice(["<", "[", "\\", "/", "s>", "INST]", "s", ">", "x"]) for _ in range(rnd.randrange(14)))
        assert chat_format.unescape(chat_format.escape(s)) == s
        assert not [c for c in ("<s>", "</s>", "[INST]", "[/INST]") if c in chat_format.escape(s)]


def forgetful(turns, before):
    """Drops the thoughts of all assistant turns but the last one: rewrites history."""
    last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
    return "".join(f"<{r}>{t if i == last or '|' not in t else t.split('|')[1]}\n" for i, (r, t) in enumerate(turns))


def counting(turns, before):
    """Numbers its turns: append-only, and resumable as it is told how many turns precede."""
    return "".join(f"{before + i}:{r}={t};" for i, (r, t) in enumerate(turns))


def summing(turns, before):
    """Needs all of the past for each turn, so it can't be resumed."""
    return "".join(f"{sum(len(t) for _, t in turns[: i + 1])}:{t};" for i, (r, t) in enumerate(turns))


def stripping(turns, before):
    return "".join(f"[{t.strip()}]" for _, t in turns)


@pytest.mark.parametrize("render", [forgetful, counting, summing])
def test_any_template_is_rendered_as_its_prefixes(spark, render):
    rnd = random.Random(2)
    turns = [("assistant" if i % 2 else "user", "".join(rnd.choice("abc|;:=") for _ in range(rnd.randrange(30)))) for i in range(60)]
    rows = [(c, i, r, t, "", "") for c in range(3) for i, (r, t) in enumerate(turns[: 20 * (c + 1)])]
    template = Template(render, lambda x: [], lambda x: x)
    pieces = chat_format.formatted(spark.createDataFrame(rows, TALK), template)
    output = collections.defaultdict(str)
    for r in pieces.orderBy("conv_id", "seq").collect():
        was = output[r.conv_id]
        assert len(was) - r.start == r.rewrote
        output[r.conv_id] = was[: r.start] + r.piece
        assert output[r.conv_id] == render(turns[: r.seq + 1], 0)
        if r.role == "assistant" and render is not forgetful and r.loss_start is not None:
            assert r.piece[r.loss_start : r.loss_end] == turns[r.seq][1]
    assert (chat_format.rewritten(pieces).count() > 0) == (render is forgetful)
    whole = chat_format.read_back(pieces, template).collect()
    assert len(whole) == 3 and all(r.turns_sha256 is None for r in whole)


def test_a_changed_text_is_not_taken_for_the_text():
    p = chat_format.Prefixes(Template(stripping, lambda x: [], lambda x: x))
    assert p.add("assistant", "plain") == chat_format.Span(0, "[plain]", 1, 6, 0)
    assert p.add("assistant", "  cut ").piece == "[cut]"


# ------------------------------------------------------------------ centroids


def brute_clusters(rows: list[tuple], k: int, rounds: int, d: int, salt: str = "2:") -> dict:
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (sha(salt + str(r[0])), r[1]))
    cents = [v for _, v in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for i, own in groups.items():
            cents[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = [(i, *near(v)) for i, v in kept]
    by = collections.Counter()
    for _, dist, c in best:
        by[c] += dist
    return collections.Counter((i, c, dist, by[c], sum(by.values()), sha(",".join(map(str, cents[c])))) for i, dist, c in best)


def test_clusters_equal_the_plain_rounds(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rnd.normal(0, 0.2, 4)]) for i in range(300)]
    rows += [(500 + i, [0.25, -0.25, 0.5, 1.0]) for i in range(200)]  # one large group of equal vectors
    rows += [(7, rows[9][1]), (7, rows[7][1]), (900, None), (901, [1.0]), (902, [None, 1.0, 1.0, 1.0]), (903, [float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0, 1.0]), (905, []), (906, [-0.001, 0.0039, 0.00390625, -0.00390625])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    got = collections.Counter(tuple(r) for r in centroids.clustered(df, k=6, rounds=4, dimension=4).collect())
    assert got == brute_clusters(rows, 6, 4, 4)


def test_clusters_of_few_no_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [3e38, -3e38])]
    got = centroids.clustered(spark.createDataFrame(few, schema), k=40, rounds=5, dimension=2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert centroids.clustered(spark.createDataFrame([], schema), dimension=2).count() == 0
    assert centroids.clustered(spark.createDataFrame([(1, [1.0])], schema), dimension=2).count() == 0


def test_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([([0],)], "v array<long>")
    r = df.select(centroids.nearest("v", [[5], [3], [-3]]).alias("x")).first().x
    assert (r.distance, r.cluster) == (9, 1)


def test_clustering_runs_in_the_engine(spark):
    plan = centroids.assigned(centroids.whole_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), 64, 256), [[1] * 64])
    assert "Python" not in plan._jdf.queryExecution().toString()


# ------------------------------------------------------------------ alignment


@pytest.fixture(scope="module")
def paths():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


def brute_alignment(texts: list[str | None], paths) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(paths[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    from_a = {v: k for k, v in one.get_vocab().items()}
    names = json.load(open(paths[0]))["model"]["vocab"]
    assert len(names) >= 50_000
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in chars}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in chars)}

    def b_bytes(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    out, links = [], []
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        ab, bb = [bytes(back[c] for c in from_a[i]) for i in a], [b_bytes(i) for i in b]
        if not t or b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, own, i, j = [], [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x, y = ea.index(e, i), eb.index(e, j)
            own.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        out.append((len(a), len(b), len(groups), sha(";".join(groups))))
        links.append(own)
    n = collections.Counter(p for own in links for p in own)
    most = collections.defaultdict(int)
    for (_, y), c in n.items():
        most[y] = max(most[y], c)
    return [(*o[:3], len(own), sum(n[p] == most[p[1]] for p in own), sum(n[p] for p in own), o[3]) for o, own in zip(out, links, strict=True)]


def alignment_texts() -> list[str | None]:
    rnd = random.Random(9)
    bits = ["word", " ", "  ", "   ", "\n", "\t", "▁", "é", "中文", "😀", "don't", "</s>", "<|endoftext|>", "<0x41>", "123456", "...", " ", "　", "ﬁ", "\x00", "antidisestablishmentarianism", "Straße", "x" * 40]
    plain = [b for b in bits if b != "▁"]
    return [None, "", " ", "  ", "▁", "a▁b", "ends ", " starts", "the the", "the the", "\n\n", "word " * 3000, "x" * 20_000, *["".join(rnd.choice(plain if i % 4 else bits) for _ in range(rnd.randrange(1, 60))) for i in range(150)]]


def test_alignment_equals_the_libraries(spark, paths):
    texts = alignment_texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, pairs string").repartition(5)
    want = brute_alignment(texts, paths)
    for sent in (token_alignment.SENT_PAIRS, 0):
        got = {r[0]: tuple(r[1:]) for r in token_alignment.aligned(df, *paths, sent_pairs=sent).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert token_alignment.aligned(df.limit(0), *paths).count() == 0
    blank = df.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(4)
    assert token_alignment.aligned(blank.union(blank), *paths).count() == 8


def test_alignment_of_a_table_equals_the_libraries(spark, paths):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r[0]: tuple(r[1:]) for r in queries.op13_token_alignment(spark, SF).collect()}
    assert [got[r.doc_id] for r in rows] == brute_alignment([r.text for r in rows], paths)


def test_groups_cut_the_text(spark, paths):
    texts = alignment_texts()[6:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = token_alignment.byte_level(paths[0])[1]
    for r in token_alignment.token_groups(df, *paths).collect():
        whole = (" " + texts[r.doc_id]).encode()
        for g in r.groups:
            assert b"".join(table[i] for i in g.a) == whole[g.start : g.end]
        assert not r.groups or r.groups[-1].end == len(whole)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_the_merge_path(piece):
    rnd = random.Random(piece)
    for _ in range(200):
        top = rnd.randrange(1, 60)
        a, b = (np.array(sorted(rnd.sample(range(60), rnd.randrange(0, top + 1))), np.int64) for _ in range(2))
        i, j = token_alignment.merge_path(a, b, piece)
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for d, (x, y) in zip([*range(0, len(merged), piece), len(merged)], zip(i.tolist(), j.tolist(), strict=True), strict=True):
            assert x == sum(s == 0 for _, s in merged[:d]) and y == d - x
        p, q = token_alignment.overlaps(a, b, piece)
        assert a[p].tolist() == b[q].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
