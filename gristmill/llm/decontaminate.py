"""Benchmark decontamination (operator 10).

Texts are sequences of words (runs of ASCII letters, digits and non-ASCII
characters, A-Z lower-cased).  A CGK random walk copies a sequence into a
longer one, each step moving on by a random bit of the symbol it stands on;
sequences at small edit distance fall into step again and agree in most places
of their walks.  Each repetition samples a few places of the walk as an LSH
key, for the benchmark items from an anchor inside them and for every word
position of every text.  Equal keys are candidates; the item-sized window
around each one is verified by exact edit distance.

Repetitions use anchors in different parts of an item, each at the word of that
part that the benchmark uses least, so that few positions of a text pass the
first sampled place.  The tests measure what share of items at the largest
allowed distance they find.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T

#: Word edits allowed for each word of an item.
EDIT_SHARE = 0.2
#: Shorter items must stand word for word.
SHORTEST = 10
#: The sampled places of the walk of each repetition.  The first one is the anchor word itself.
REPEATS = [(0, 2, 5), (0, 3, 6), (0, 2, 6), (0, 3, 5)] * 2
_PAD = 8
#: Bytes of items' texts that one pass over the texts takes.
BLOCK_BYTES = 32 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = T.byte_table(lower=True, seed=11)
_MULT = np.random.default_rng(23).integers(0, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_KEY = np.random.default_rng(29).integers(0, 1 << 63, 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the words of each text; no hash is 0."""
    starts, ends = T.runs(_WORD[buf], off)
    return T.span_hashes(_BYTE[buf], starts, ends) | np.uint64(1), np.searchsorted(starts, off)


def allowed(n_words: int) -> int:
    return int(EDIT_SHARE * n_words) if n_words >= SHORTEST else 0


def infix_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): the least edit distance of the item to a stretch of text, and where the first such one ends.

    Bit-parallel, one step for each word of text.
    """
    m = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, w in enumerate(text, 1):
        eq = places.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diag | up)), up & diag
        if score < best:
            best, end = score, at
    return best, end


@dataclass
class Items:
    """Benchmark items with their LSH keys."""

    ids: np.ndarray
    words: list[np.ndarray]

    def __post_init__(self):
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.keys: list[tuple] = []
        short = [i for i, w in enumerate(self.words) if 0 < len(w) < SHORTEST]
        for n in sorted({len(self.words[i]) for i in short}):
            own = np.array([i for i in short if len(self.words[i]) == n])
            key = _window_keys(np.stack([self.words[i] for i in own]))
            order = np.argsort(key)
            self.exact[n] = (key[order], own[order])
        long = np.array([i for i, w in enumerate(self.words) if len(w) >= SHORTEST], np.int64)
        count: dict[int, int] = {}
        for w in self.words:
            for x in set(w.tolist()):
                count[x] = count.get(x, 0) + 1
        for r, places in enumerate(REPEATS):
            offset = np.array([_anchor(self.words[i].tolist(), r, count) for i in long], np.int64)
            padded = [np.zeros(0, np.uint64)]
            starts, n = [], 0
            for i, o in zip(long.tolist(), offset.tolist(), strict=True):
                padded += [self.words[i][o:], np.zeros(_PAD, np.uint64)]
                starts.append(n)
                n += len(self.words[i]) - o + _PAD
            seen = walk_symbols(np.concatenate(padded), np.array(starts, np.int64), r, places)
            tables = []
            for symbols in seen:
                table = np.zeros(1 << 18, bool)
                table[(symbols >> np.uint64(46)).astype(np.int64)] = True
                tables.append(table)
            key = _window_keys(np.stack(seen, 1)) if len(long) else np.zeros(0, np.uint64)
            order = np.argsort(key)
            self.keys.append((places, tables, key[order], long[order], offset[order]))


def _anchor(words: list[int], repeat: int, count: dict[int, int]) -> int:
    """The place of the rarest word in the item's part for this repetition; the last five words are no anchors."""
    room = len(words) - 5
    low = repeat * room // len(REPEATS)
    return min(range(low, max(low + 1, (repeat + 1) * room // len(REPEATS))), key=lambda i: (count[words[i]], i))


def _window_keys(symbols: np.ndarray) -> np.ndarray:
    key = np.zeros(len(symbols), np.uint64)
    for j in range(symbols.shape[1]):
        key = T.mix(key * _KEY[0] + symbols[:, j])
    return key


def walk_symbols(words: np.ndarray, at: np.ndarray, repeat: int, places: tuple[int, ...]) -> list[np.ndarray]:
    """The symbols at the given places of the walks that start at the given positions."""
    bits = words * _MULT[repeat]
    out, at = [], at.copy()
    for step in range(places[-1] + 1):
        if step in places:
            out.append(words[at])
        at += ((bits[at] >> np.uint64(63 - step)) & np.uint64(1)).astype(np.int64)
    return out


def _pairs(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with keys[j] == wanted[i]; keys are sorted."""
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    return np.repeat(np.arange(len(wanted)), high - low), T.ragged(low, high - low)


def candidates(items: Items, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) where a text may hold an item from that word on.

    words: those of all texts, _PAD zeros after each; starts: the positions of words.
    """
    found = []
    short = (words >> np.uint64(46)).astype(np.int32)
    for repeat, (places, tables, keys, own, offset) in enumerate(items.keys):
        if not len(keys):
            continue
        base = np.flatnonzero(tables[0][short])
        base = base[words[base] != 0]
        at, symbols = base.copy(), []
        for step in range(places[-1] + 1):
            if step in places:
                now = words[at]
                keep = np.flatnonzero(tables[len(symbols)][short[at]])
                base, at, symbols = base[keep], at[keep], [s[keep] for s in symbols] + [now[keep]]
            at += ((words[at] * _MULT[repeat] >> np.uint64(63 - step)) & np.uint64(1)).astype(np.int64)
        i, j = _pairs(keys, _window_keys(np.stack(symbols, 1)))
        found.append((base[i] - offset[j], own[j]))
    for n, (keys, own) in items.exact.items():
        ok = starts[starts + n <= len(words)]
        i, j = _pairs(keys, _window_keys(np.stack([words[ok + k] for k in range(n)], 1)))
        found.append((ok[i], own[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1), axis=0)
    return both[:, 0], both[:, 1]


def find(items: Items, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, first word) for each item that a text holds within the allowed distance."""
    hashes, bounds = word_hashes(buf, off)
    n = np.diff(bounds)
    begin = bounds[:-1] + _PAD * np.arange(len(n))
    words = np.zeros(len(hashes) + _PAD * len(n), np.uint64)
    starts = T.ragged(begin, n)
    words[starts] = hashes
    at, item = candidates(items, words, starts)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tested: dict[tuple[int, int], int] = {}
    for p, i in sorted(zip(at.tolist(), item.tolist(), strict=True), key=lambda x: (x[1], x[0])):
        k = allowed(len(items.words[i]))
        doc = int(np.searchsorted(begin, min(max(p + k, 0), len(words) - 1), "right")) - 1
        before = tested.get((doc, i))
        if before is not None and p <= before + k // 2:
            continue
        tested[doc, i] = p
        first, last = int(begin[doc]), int(begin[doc] + n[doc])
        low = max(first, p - 2 * k)
        part = words[low : min(last, p + len(items.words[i]) + 2 * k)].tolist()
        distance, end = infix_distance(items.words[i].tolist(), part)
        if distance <= k:
            got = (distance, max(0, low - first + end - len(items.words[i])))
            best[doc, i] = min(best.get((doc, i), got), got)
    return [(d, i, *got) for (d, i), got in best.items()]


FOUND = "doc_id long, item_id long, distance int, item_words int, first_word long"


def _item_blocks(benchmark: DataFrame) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, words) of the items, in blocks of about BLOCK_BYTES of text: counted first, so that what goes to the tasks is bounded."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]  # one number
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a block of bounded size
        raw = [r["text"].encode() for r in rows]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
        hashes, at = word_hashes(np.frombuffer(b"".join(raw), np.uint8), off)
        yield np.array([r["item_id"] for r in rows], np.int64), [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word): each pair of docs(doc_id, text) and
    benchmark(item_id, text) where the text holds the item within int(0.2 * words) word edits.

    Items of fewer than ten words count when they stand word for word; an item
    without words is never found, nor anything in a null or empty text.  first_word
    is about where the closest place begins.  Rows with the same doc_id give one
    pair at the least distance.  The items are taken in blocks of a counted size,
    so what is sent to the tasks is bounded; each text is searched at every word.
    """
    spark = docs.sparkSession
    T.small_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = None
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in T.chunks(batches):
                got = find(items, *T.buffer(T.column(batch, "text")))
                if got:
                    d, i, distance, first = (np.array(c, np.int64) for c in zip(*got, strict=True))
                    n = np.array([len(items.words[k]) for k in i.tolist()], np.int32)
                    yield pa.record_batch([T.column_raw(batch, "doc_id").take(pa.array(d)), pa.array(items.ids[i]), pa.array(distance.astype(np.int32)), pa.array(n), pa.array(first)], names=["doc_id", "item_id", "distance", "item_words", "first_word"])

        found = docs.mapInArrow(work, FOUND)
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "first_word", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.distance", "b.item_words", "b.first_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, whose text holds no item, as in contaminated(); nothing is shuffled."""
    spark = docs.sparkSession
    T.small_batches(spark)
    out = docs
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in T.chunks(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in find(items, *T.buffer(T.column(batch, "text")))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(work, docs.schema)
    return out
