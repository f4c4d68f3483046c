"""Alignment of two tokenizers' tokens by merge-path partitioning (operator 13).

Both token sequences of a batch are increasing byte offsets at which tokens
end.  Diagonals through the merge of the two, a fixed number of steps apart,
are placed by binary search; the pieces between them hold equally many ends
and are merged independently of each other.  A piece emits the offsets where
both tokenizers' tokens end; an end that the cut parted from its equal is
joined when pieces are stitched, and groups run on across pieces.

Documents' links are written once to the shared folder; the counts of id pairs
are summed over all of them and looked up, from a table that is sent to the
tasks up to a checked size and joined by a shuffle beyond it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._units import UnitCache, codepoints, point_values, pretokens

#: Merge steps (ends of either side) in a piece.
PIECE = 1 << 15
#: Id pairs that are sent to every task (12 bytes each); more are joined by a shuffle.
SENT_PAIRS = 4_000_000
#: Distinct id pairs that a task gathers before it hands them on.
GATHERED = 1 << 20
_UNITS = 300_000
_BYTE = T.byte_table(lower=False)
_SPACE = "▁"


@functools.cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def byte_level(path: str):
    """(encode a list of texts, bytes of each id) of a tokenizers file with byte-level BPE; special strings are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    table = [b""] * made.get_vocab_size()
    byte_of = _byte_of()
    for token, i in made.get_vocab().items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return (lambda texts: [x.ids for x in made.encode_batch(texts, add_special_tokens=False)]), table


@functools.cache
def pieces_model(path: str):
    """(encode a list of units that begin with a space, bytes of each id) of a sentencepiece file; U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    n = made.get_piece_size()
    table = [bytes([int(made.id_to_piece(i)[3:5], 16)]) if made.is_byte(i) else made.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]
    alone = [made.piece_to_id(_SPACE)]

    def encode(units: list[str]) -> list[list[int]]:
        # the model puts a space before what it encodes, so a unit's first space is left to it
        return [ids if u != " " else alone for u, ids in zip(units, made.encode([u[1:] for u in units], num_threads=1), strict=True)]

    return encode, table


@functools.cache
def _a_cache(path: str) -> UnitCache:
    return UnitCache(byte_level(path)[0], limit=_UNITS)


@functools.cache
def _b_cache(path: str) -> UnitCache:
    """Units of spaces and what follows up to the next space; no piece has a space after another character, so units are encoded apart.

    A unit whose pieces don't give its bytes back is [-1].
    """
    encode, table = pieces_model(path)

    def make(units: list[str]) -> list[list[int]]:
        return [ids if b"".join([table[i] for i in ids]) == u.encode("utf-8", "replace") else [-1] for u, ids in zip(units, encode(units), strict=True)]

    return UnitCache(make, limit=_UNITS)


def _spaced(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, each with a space before it; an empty text stays empty.  Malformed bytes become U+FFFD."""
    buf, off = T.buffer(col)
    try:
        buf.tobytes().decode()
    except UnicodeDecodeError:
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:], strict=True)]
        buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    full = np.diff(off) > 0
    return np.insert(buf, off[:-1][full], 0x20), off + np.concatenate([[0], np.cumsum(full)])


def _ids(cache: UnitCache, rows: np.ndarray, starts: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = cache.length[rows].astype(np.int64)
    return cache.flat[T.ragged(cache.begin[rows], length)], np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, off)]


def both_tokens(col: pa.Array, a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets by text) of space and text by A, then by B; none for empty texts and those that B doesn't give back."""
    buf, off = _spaced(col)
    cps, at = codepoints(buf, off)
    starts, ends = pretokens(cps, at)
    cache = _a_cache(a_path)
    rows = cache.rows_of(T.span_hashes(point_values(cps), starts, ends), lambda i: cps[starts[i] : ends[i]].tobytes().decode("utf-32-le", "replace"))
    a, a_at = _ids(cache, rows, starts, at)
    begins = buf == 0x20
    begins[1:] &= buf[:-1] != 0x20
    begins[off[:-1][np.diff(off) > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(buf))
    cache = _b_cache(b_path)
    rows = cache.rows_of(T.span_hashes(_BYTE[buf], starts, ends), lambda i: buf[starts[i] : ends[i]].tobytes().decode())
    b, b_at = _ids(cache, rows, starts, off)
    if len(b) and b.min() < 0:
        good = np.add.reduceat(np.append(b < 0, False).astype(np.int64), np.minimum(b_at[:-1], len(b))) * (np.diff(b_at) > 0) == 0
        for k in range(2):
            ids, bounds = (a, a_at) if k == 0 else (b, b_at)
            n = np.diff(bounds)
            ids, bounds = ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(n * good)])
            a, a_at, b, b_at = (ids, bounds, b, b_at) if k == 0 else (a, a_at, ids, bounds)
    return a, a_at, b, b_at


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the diagonals 0, piece, 2 piece, ... of the merge of the increasing a and b cross it: so many of a, so many of b; equal ends of a come first.

    All diagonals are searched at once, each by halving.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2
        j = d - i - 1
        goes = open_.copy()  # a[i] comes before b[j], so the diagonal takes more of a
        goes[open_] = a[i[open_]] <= b[j[open_]]
        low = np.where(goes, i + 1, low)
        high = np.where(open_ & ~goes, i, high)
    return low, d - low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b of the ends that both have, for strictly increasing a and b.

    Each piece of the merge path is merged alone; where a cut parts an end of a
    from its equal in b, the two are joined afterwards.
    """
    at_a, at_b = merge_path(a, b, piece)
    found_a, found_b = [], []
    for i, i2, j, j2 in zip(at_a[:-1].tolist(), at_a[1:].tolist(), at_b[:-1].tolist(), at_b[1:].tolist(), strict=True):
        if i < i2 and j < j2:
            place = np.minimum(np.searchsorted(b[j:j2], a[i:i2]), j2 - j - 1)
            hit = np.flatnonzero(b[j:j2][place] == a[i:i2])
            found_a.append(i + hit)
            found_b.append(j + place[hit])
        if i2 and j2 < len(b) and a[i2 - 1] == b[j2] and i2 > i:
            found_a.append(np.array([i2 - 1]))
            found_b.append(np.array([j2]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


@functools.cache
def _lengths(path: str, side: str) -> np.ndarray:
    return np.array([len(t) for t in (byte_level if side == "a" else pieces_model)(path)[1]], np.int64)


@functools.cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, left-aligned with one place more, and how many there are."""
    each = [str(i).encode() for i in range(n)]
    size = np.array([len(x) for x in each], np.int64)
    table = np.zeros((n, int(size.max()) + 1), np.uint8)
    for i, x in enumerate(each):
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
    return table, size


class Aligned:
    """The tokens of a batch of texts and the ends that both sides have."""

    def __init__(self, col: pa.Array, a_path: str, b_path: str, piece: int = PIECE):
        self.a, self.a_at, self.b, self.b_at = both_tokens(col, a_path, b_path)
        self.a_ends = np.cumsum(_lengths(a_path, "a")[self.a])
        self.b_ends = np.cumsum(_lengths(b_path, "b")[self.b])
        self.in_a, self.in_b = overlaps(self.a_ends, self.b_ends, piece)
        self.groups_at = np.searchsorted(self.in_a, self.a_at)
        self.kinds = len(_lengths(a_path, "a")), len(_lengths(b_path, "b"))

    def pairs(self) -> np.ndarray:
        """A's id times B's number of ids plus B's id, of each link."""
        return self.a[self.in_a].astype(np.int64) * self.kinds[1] + self.b[self.in_b]

    def written(self) -> list[bytes]:
        """a1,a2|b1;a3|b2 of each text: decimal ids of its groups."""
        group_a = np.searchsorted(self.in_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.in_b, np.arange(len(self.b)))
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.in_b + 1])[group_a]
        place_b = np.arange(len(self.b)) + (self.in_a + 1)[group_b]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.in_a]] = ord("|")
        mark[place_b[self.in_b]] = ord(";")
        table, size = _digits(max(self.kinds))
        out = table[ids]
        out[np.arange(len(ids)), size[ids]] = mark
        raw = out[out != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[ids] + 1)])[self.a_at + self.b_at].tolist()
        return [raw[x : y - 1] if y > x else b"" for x, y in zip(ends[:-1], ends[1:], strict=True)]


LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary"


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, pairs) of docs(doc_id, text).

    n_a and n_b count the tokens of space and text by A (a tokenizers file with
    byte-level BPE) and of text by B (a sentencepiece file, which adds the
    space), n_groups the byte offsets where both end; pairs has the id pair of
    each link, eight bytes little-endian.  Texts that are null or empty, or
    that B's pieces don't give back byte by byte, have no tokens and no digest
    ('').  Rows stay apart; other columns are ignored.
    """
    T.small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            got = Aligned(T.column(batch, "text"), a_path, b_path)
            raw = got.pairs().astype("<i8").tobytes()
            at = (8 * got.groups_at).tolist()
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in got.written()]
            cells = [T.column_raw(batch, "doc_id"), pa.array(np.diff(got.a_at)), pa.array(np.diff(got.b_at)), pa.array(np.diff(got.groups_at)), pa.array(digests), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())]
            yield pa.record_batch(cells, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(work, LINKED.removeprefix("row long, "))


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups): of each group the byte range in space and text, and both sides' ids, array<struct<start, end, a, b>>; texts as in linked()."""
    T.small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in T.chunks(batches):
            got = Aligned(T.column(batch, "text"), a_path, b_path)
            ends = got.a_ends[got.in_a]
            rows = []
            for k, (g, g2) in enumerate(zip(got.groups_at[:-1].tolist(), got.groups_at[1:].tolist(), strict=True)):
                zero = int(got.a_ends[got.a_at[k] - 1]) if got.a_at[k] else 0
                cut_a, cut_b = [int(got.a_at[k]), *(got.in_a[g:g2] + 1).tolist()], [int(got.b_at[k]), *(got.in_b[g:g2] + 1).tolist()]
                to = [0, *(ends[g:g2] - zero).tolist()]
                rows.append([{"start": to[i], "end": to[i + 1], "a": got.a[cut_a[i] : cut_a[i + 1]].tolist(), "b": got.b[cut_b[i] : cut_b[i + 1]].tolist()} for i in range(g2 - g)])
            yield pa.record_batch([T.column_raw(batch, "doc_id"), pa.array(rows, kind)], names=["doc_id", "groups"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(work, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def _counted(pairs: np.ndarray, into: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(pairs, return_counts=True)
    every = np.concatenate([into[0], keys])
    keys, back = np.unique(every, return_inverse=True)
    return keys, np.bincount(back, np.concatenate([into[1], n])).astype(np.int64)


def pair_counts(links: DataFrame, b_kinds: int) -> DataFrame:
    """(pair, b_id, n, best): how many links hold each id pair, and whether no pair of its B id has more.

    Each task sums its pairs before they are shuffled; the largest n of a B id
    is taken over sums, at most one for each A id.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size, total = [], 0, none

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(total[0]), pa.array(total[1])], names=["pair", "n"])

        for batch in batches:
            for blob in batch.column(0):
                held.append(np.frombuffer(blob.as_buffer() or b"", "<i8"))
                size += len(held[-1])
                if size >= GATHERED:
                    total, held, size = _counted(np.concatenate(held), total), [], 0
                    if len(total[0]) >= GATHERED:
                        yield out()
                        total = none
        if held:
            total = _counted(np.concatenate(held), total)
        yield out()

    sums = links.select("pairs").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("b_id", F.col("pair") % b_kinds)
    most = sums.groupBy("b_id").agg(F.max("n").alias("most"))
    return sums.join(most, "b_id").select("pair", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(links: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of links with n_best and count_sum, by a table sent to the tasks."""
    table = counts.select("pair", "n", "best").toArrow()
    pair, n, best = (np.asarray(table.column(c)) for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    shared = links.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            *cells, blobs = batch.columns
            sums, hits = [], []
            for blob in blobs:
                at = np.searchsorted(pair, np.frombuffer(blob.as_buffer() or b"", "<i8"))
                sums.append(int(n[at].sum()))
                hits.append(int(best[at].sum()))
            yield pa.record_batch([*cells[1:], pa.array(hits, pa.int64()), pa.array(sums, pa.int64())], names=[*batch.schema.names[1:-1], "n_best", "count_sum"])

    return links.mapInArrow(work, LINKED.removeprefix("row long, ").removesuffix(", pairs binary") + ", n_best long, count_sum long")


def _joined(links: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffle: each document's distinct pairs with how often they occur, joined with the counts and summed by row."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, times = np.unique(np.frombuffer(blob.as_buffer() or b"", "<i8"), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(keys), row)), pa.array(keys), pa.array(times)], names=["row", "pair", "times"])

    each = links.select("row", "pairs").mapInArrow(work, "row long, pair long, times long").join(counts, "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return links.drop("pairs").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])


def aligned(docs: DataFrame, a_path: str, b_path: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs(doc_id, text).

    A link is an A and a B token whose byte ranges end together; a group is
    what lies between two such ends, so groups and links are equally many.  A
    link's count is the number of links in all docs with its two ids; n_best
    counts the links whose count is the highest of their B id, ties included;
    count_sum sums the counts.  Texts without tokens (see linked) have zeros
    and ''.  Rows stay apart, repeated ones too; an empty table gives no rows.

    sent_pairs: distinct id pairs up to which their counts are sent to the
    tasks; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    T.checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/links-{uuid.uuid4().hex}"
    linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()).select("row", *[c.split()[0] for c in LINKED.split(", ")[1:]]).write.option("compression", "zstd").parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    pair_counts(links, len(_lengths(b_path, "b"))).write.parquet(f"{folder}/pairs")
    counts = spark.read.parquet(f"{folder}/pairs")
    out = (_looked_up if counts.count() <= sent_pairs else _joined)(links, counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
