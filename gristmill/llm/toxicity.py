"""Toxicity scores from subword-bag embeddings and a linear softmax (operator 8).

A word is the mean of the vectors of its hashed character n-grams, so a
misspelling shares most of them; a window of words is the mean of its words;
a linear softmax on the window gives its logits, and a text counts as its most
toxic window, so that a long text is no dilution.  Embeddings and softmax are
trained together, in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._units import UnitCache

BUCKETS = 1 << 15
DIM = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 50, 25
#: A window with fewer different words counts as if it had so many.
FEWEST = 12
#: Rounds of choosing each text's window, and steps between them.
ROUNDS, STEPS = 12, 8
#: Labelled rows that a model learns from, at most, and the longest text among them (code points).
SAMPLE, LONGEST = 3000, 20_000

#: How far a score moves from the sample's share of toxic rows to that of all labelled rows, in log odds.
PRIOR = 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 0x27]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = T.byte_table(lower=True, seed=17)


def bags_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sizes): for each word, A-Z lower-cased, the buckets of it and of its n-grams, its bounds marked."""
    marked = [b"<" + w + b">" for w in words]
    buf = _LOWER[np.frombuffer(b"".join(marked), np.uint8)].astype(np.uint64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(length) - length
    every, owner = [], []
    for n in GRAMS:
        count = np.maximum(length - n + 1, 0)
        at = T.ragged(start, count)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + buf[at + j]
        every.append(T.mix(h))
        owner.append(np.repeat(np.arange(len(words)), count))
    every.append(T.span_hashes(T.mix(buf + np.uint64(1)), start, start + length))
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(every)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


def fresh(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1 where a word did not occur among the last WINDOW words of its text, else 0: repetition adds nothing to a bag."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((text, hashes))
    out = np.ones(len(hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1]) & (np.diff(order) < WINDOW)
    out[order[1:][same]] = 0
    return out


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds) of the words of each text; digits belong to words, as in misspellings."""
    starts, ends = T.runs(_WORD[buf], off)
    return starts, ends, T.span_hashes(_BYTE[buf], starts, ends), np.searchsorted(starts, off)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, texts) of the windows: every STRIDE words, the last one flush with the end; a text has one at least."""
    n = np.diff(bounds)
    count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = T.ragged(np.zeros(len(n), np.int64), count)
    start = np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return bounds[text] + start, bounds[text] + np.minimum(start + WINDOW, n[text]), text


@dataclass
class Model:
    """bias and, for each bucket, the difference of the two classes' logits."""

    buckets: np.ndarray
    bias: float
    name: str

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        flat, size = bags_of(words)
        return np.add.reduceat(self.buckets[flat], np.cumsum(size) - size) / size

    def cache(self) -> UnitCache:
        return _cache(self.name, self)


_caches: dict[str, UnitCache] = {}


def _cache(name: str, model: Model) -> UnitCache:
    if name not in _caches:
        _caches.clear()
        _caches[name] = UnitCache(lambda units: model.word_scores(units)[:, None].tolist(), dtype=np.float64, limit=1_500_000)
    return _caches[name]


def logits(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The logit of the most toxic window of each text; the bias for a text without words."""
    starts, ends, hashes, bounds = words_of(buf, off)
    cache = model.cache()
    rows = cache.rows_of(hashes, lambda i: buf[starts[i] : ends[i]].tobytes())
    new = fresh(hashes, bounds)
    total = np.concatenate([[0.0], np.cumsum(cache.flat[cache.begin[rows]] * new)])
    count = np.concatenate([[0.0], np.cumsum(new)])
    a, b, text = windows(bounds)
    mean = (total[b] - total[a]) / np.maximum(count[b] - count[a], FEWEST)
    return np.maximum.reduceat(mean, np.searchsorted(text, np.arange(len(off) - 1))) + model.bias if len(off) > 1 else np.zeros(0)


def fit(texts: list[str], labels: np.ndarray, shift: float = 0.0, seed: int = 1) -> Model:
    """Trains on whole texts with labels 0 and 1; with one class only, scores say that class.  shift is added to all logits."""
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 4.0 if len(labels) and labels[0] else -4.0, f"constant{labels[:1].tolist()}")
    buf = np.frombuffer(b"".join(raw), np.uint8)
    cuts = np.unique(np.concatenate([np.searchsorted(off, np.arange(0, len(buf), T.CHUNK)), [len(raw)]]))  # texts are hashed a few at a time
    some = [(off[a], words_of(buf[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    starts, ends, hashes = (np.concatenate([w[i] + (at if i < 2 else np.uint64(0)) for at, w in some]) for i in range(3))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w[3]) for _, w in some]))])
    del some
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    parts = [bags_of([buf[starts[i] : ends[i]].tobytes() for i in some.tolist()]) for some in np.array_split(first, -(-len(first) // 20_000))]
    flat, size = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    at = np.cumsum(size) - size
    new = fresh(hashes, bounds)
    seen = np.concatenate([[0.0], np.cumsum(new)])
    a, b, text = windows(bounds)
    head = np.searchsorted(text, np.arange(len(texts)))
    width = np.maximum(seen[b] - seen[a], FEWEST)
    rng = np.random.default_rng(seed)
    E, U, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    y = labels.astype(int)
    weight = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0) ** 0.5
    weight /= weight.sum()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, U, bias)]
    step = 0
    for _ in range(ROUNDS):
        # the most toxic window of each text so far, the first of equal ones
        score = np.add.reduceat((E @ (U[:, 1] - U[:, 0]).astype(np.float32))[flat], at) / size
        total = np.concatenate([[0.0], np.cumsum(score[word] * new)])
        gap = (total[b] - total[a]) / width
        is_top = np.flatnonzero(gap == np.maximum.reduceat(gap, head)[text])
        pick = is_top[np.unique(text[is_top], return_index=True)[1]]
        inside = T.ragged(a[pick], (b - a)[pick])
        owner = np.repeat(np.arange(len(pick)), (b - a)[pick])
        owner, inside = owner[new[inside] > 0], inside[new[inside] > 0]
        used, index = np.unique(word[inside], return_inverse=True)
        own_size = size[used][:, None]
        own = flat[T.ragged(at[used], size[used])]
        of_word = np.repeat(np.arange(len(used), dtype=np.int32), size[used])
        begin = np.cumsum(size[used]) - size[used]
        for _ in range(STEPS):
            step += 1
            vector = np.add.reduceat(E[own], begin) / own_size if len(used) else np.zeros((0, DIM))
            mean = np.stack([np.bincount(owner, vector[index, d], len(pick)) for d in range(DIM)], 1) / width[pick][:, None]
            out = mean @ U + bias
            p = 1 / (1 + np.exp(np.clip(out[:, 0] - out[:, 1], -50, 50)))
            error = weight * (p - y)
            g_out = np.stack([-error, error], 1)
            g_mean = g_out @ U.T / width[pick][:, None]
            g_word = np.stack([np.bincount(index, g_mean[owner, d], len(used)) for d in range(DIM)], 1) / own_size
            g_E = np.stack([np.bincount(own, g_word[of_word, d], BUCKETS).astype(np.float32) for d in range(DIM)], 1) + np.float32(1e-6) * E
            for param, grad, (m, v) in ((E, g_E, state[0]), (U, mean.T @ g_out, state[1]), (bias, g_out.sum(0), state[2])):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                param -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    buckets = E.astype(float) @ (U[:, 1] - U[:, 0])
    import hashlib

    return Model(buckets, float(bias[1] - bias[0]) + shift, hashlib.sha256(buckets.tobytes()).hexdigest())


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows that are not held out: at most sample of them, in the
    order of a hash of their ids, half of them toxic if there are so many; texts of
    at most LONGEST code points.  Null labels, ids and texts are left out.  The
    sample has more toxic rows than the labels do, so logits are moved part of
    the way back.  The sample, whose size is a parameter, is one group and fits
    in a task; the driver gets the model only.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]  # a fixed choice
    picked = known.where("toxic = 1").orderBy(*order).limit(sample // 2).union(known.where("toxic = 0").orderBy(*order).limit(sample // 2))
    rows = docs.join(F.broadcast(picked), "doc_id").where(f"text is not null and char_length(text) <= {LONGEST}")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of the rows of one doc_id the first by text
    prior = dict(known.groupBy("toxic").count().collect())  # two rows

    def work(table: pa.Table) -> pa.Table:
        rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in table.to_pylist())
        y = np.array([r[2] for r in rows])
        own = (y == 1).sum(), (y == 0).sum()
        shift = float(np.log(prior[1] / prior[0]) - np.log(own[0] / own[1])) if min(own) > 0 else 0.0
        got = fit([r[1] for r in rows], y, PRIOR * shift)
        return pa.table({"buckets": [got.buckets.tobytes()], "bias": [got.bias], "name": [got.name]})

    models = rows.groupBy(F.lit(True)).applyInArrow(work, "buckets binary, bias double, name string").collect()  # one row, none without a sample
    return Model(np.frombuffer(models[0]["buckets"]), models[0]["bias"], models[0]["name"]) if models else fit([], np.zeros(0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); no shuffle.

    score: 0 to 1; a null, empty or wordless text has the model's bias.  Only
    the text goes into a score.  A null doc_id is not held out.
    """
    spark = docs.sparkSession
    T.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            z = logits(shared.value, *T.buffer(T.column(batch, "text")))
            yield pa.record_batch([T.column_raw(batch, "doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns kept, whose text scores below 0.5; no shuffle."""
    spark = docs.sparkSession
    T.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            yield batch.filter(pa.array(logits(shared.value, *T.buffer(T.column(batch, "text"))) < 0))

    return docs.mapInArrow(work, docs.schema)
