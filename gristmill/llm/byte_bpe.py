"""Byte-level BPE by a global shuffle of distinct words (operator 3).

Pre-tokens are exploded with their positions and dictionary-coded in blocks of
whole documents: a block has one row with the word number at each position,
and its distinct words in rows by word hash.  Those rows are shuffled, so all
blocks' copies of a word meet in one hash bucket and it is encoded once there;
the ids go back to the blocks by a second shuffle and are set in by position.
What is moved is the distinct words of the blocks, not a row for each
pre-token, and a frequent word costs one entry a block, so no key is hot.  The
texts are read twice, for words and for positions, so that positions are moved
once only; docs must therefore be stable, like a file or a checkpoint.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _text as T
from ._units import codepoints, load_ranks, point_values, pretokens

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 6 << 20
SHUFFLED = "bucket int, block string, part int, payload binary, doc_ids binary, known binary, counts binary"


@functools.cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(parts), 3)


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], np.int64))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "part", "payload", "doc_ids", "known", "counts"])


def _explode(n_buckets: int, words_wanted: bool):
    """Documents to blocks: their distinct words by hash bucket, or else the word number at each position."""

    def block_rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # held: the code points, offsets, ids of slices of documents
        hashes, texts, spans = [], [], []
        for cps, at, _ in held:
            starts, ends = pretokens(cps, at)
            h = T.span_hashes(point_values(cps), starts, ends)
            hashes.append(h)
            texts.append((cps, starts, ends))
            spans.append(np.diff(np.searchsorted(starts, at)))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        distinct, first, back, count = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
        slot = np.empty(len(distinct), np.int64)
        slot[np.argsort(-count, kind="stable")] = np.arange(len(distinct))  # frequent words get small numbers
        order = np.argsort(slot)
        distinct, first = distinct[order], first[order]
        starts_of = np.cumsum([0, *map(len, hashes)])
        bucket = (distinct >> np.uint64(40)).astype(np.int64) % n_buckets
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        where = np.searchsorted(starts_of, first, "right") - 1
        out = []
        ids = pa.concat_arrays([i for _, _, i in held])
        # the name tells the contents, so words never meet another block's positions, and equal blocks may share them
        inside = np.array([T.mix(every + np.arange(len(every), dtype=np.uint64)).sum(), len(every)], np.uint64)
        name = hashlib.sha256(b"".join([inside.tobytes(), np.concatenate(spans).tobytes(), np.asarray(ids.fill_null(0)).tobytes(), np.asarray(ids.is_valid()).tobytes()])).hexdigest()
        for k in np.flatnonzero(np.diff(cut)) if words_wanted else ():
            got = []
            for i in by[cut[k] : cut[k + 1]].tolist():
                cps, s, e = texts[where[i]]
                j = int(first[i] - starts_of[where[i]])
                got.append(cps[s[j] : e[j]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"))
            lengths = np.fromiter(map(len, got), np.uint32, len(got))
            out.append((int(k), name, int(k), _pack(b"".join(got), lengths), None, None, None))
            if len(out) >= 64:
                yield _rows(out)
                out = []
        if words_wanted:
            if out:
                yield _rows(out)
            return
        kind = np.uint16 if len(distinct) < 1 << 16 else np.uint32
        known = np.asarray(ids.is_valid())
        out.append((-1, name, -1, _pack(slot[back].astype(kind), bucket.astype(np.uint32), np.array([kind().itemsize])), np.asarray(ids.fill_null(0)).tobytes(), known.tobytes(), np.concatenate(spans).astype(np.int64).tobytes()))
        yield _rows(out)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in T.chunks(batches):
            buf, off = T.buffer(T.column(batch, "text"))
            held.append((*codepoints(buf, off), T.column_raw(batch, "doc_id")))
            size += int(off[-1])
            if size >= BLOCK:
                yield from block_rows(held)
                held, size = [], 0
        if held:
            yield from block_rows(held)

    return work


def _encode(path: str, pattern: str):
    """Rows sorted by bucket: each distinct word of a bucket is encoded once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        known: dict[bytes, np.ndarray] = {}
        now = None
        for batch in batches:
            out = []
            for bucket, block, part, payload, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if bucket != now:
                    known.clear()
                    now = bucket
                text, lengths = _unpack(payload)
                ends = np.cumsum(np.frombuffer(lengths, np.uint32)).tolist()
                ids = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    word = text[a:b]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = np.array(encode(word.decode()), np.uint32).tobytes()
                    ids.append(got)
                payload = _pack(b"".join(ids), np.fromiter(map(len, ids), np.uint32, len(ids)) // 4)
                out.append((bucket, block, part, payload, *rest))
            yield _rows(out)

    return work


def _assemble(path: str, digest: bool):
    """Rows sorted by (block, part): the ids of each document by position, and what they decode to."""

    def finish(texts: list[tuple], coded: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        if not texts:
            raise ValueError("a block lost its positions: the input must be the same each time it is read")
        for one in texts:  # more than one only if blocks are equal
            yield from document_rows(one, [coded[k] for k in sorted(coded)])

    def document_rows(text: tuple, coded: list[bytes]) -> Iterator[pa.RecordBatch]:
        payload, doc_ids, known, counts = text
        raw, bucket, size = _unpack(payload)
        slots = np.frombuffer(raw, np.uint16 if np.frombuffer(size, np.int64)[0] == 2 else np.uint32).astype(np.int64)
        order = np.argsort(np.frombuffer(bucket, np.uint32), kind="stable")
        flat = [np.zeros(0, np.uint32)]
        lengths = [np.zeros(0, np.int64)]
        for blob in coded:
            ids, n = _unpack(blob)
            flat.append(np.frombuffer(ids, np.uint32))
            lengths.append(np.frombuffer(n, np.uint32).astype(np.int64))
        flat, lengths = np.concatenate(flat), np.concatenate(lengths)
        if len(lengths) != len(order):
            raise ValueError("a block lost words: the input must be the same each time it is read")
        begin = np.empty(len(order), np.int64)
        length = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(lengths) - lengths
        length[order] = lengths
        at = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int64))])
        ids = pa.array(np.frombuffer(doc_ids, np.int64), mask=~np.frombuffer(known, bool))
        if not digest:
            own = length[slots]
            ends = np.concatenate([[0], np.cumsum(own)])[at]
            values = flat[T.ragged(begin[slots], own)].astype(np.int32)
            for i in range(0, len(ids), 500):
                a, b = i, min(i + 500, len(ids))
                yield pa.record_batch([ids[a:b], pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.array(values[ends[a] : ends[b]]))], names=["doc_id", "ids"])
            return
        table = token_bytes(path)
        decimal, plain = [], []
        for b, n in zip(begin.tolist(), length.tolist(), strict=True):
            own = flat[b : b + n].tolist()
            decimal.append(" ".join(map(str, own)).encode())
            plain.append(b"".join([table[i] for i in own]))
        n_tokens = np.add.reduceat(np.append(length[slots], 0), np.minimum(at[:-1], len(slots))) * (np.diff(at) > 0)
        one, two = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = slots[a:b].tolist()
            one.append(hashlib.sha256(b" ".join([decimal[i] for i in own])).hexdigest())
            two.append(hashlib.sha256(b"".join([plain[i] for i in own])).hexdigest())
        yield pa.record_batch([ids, pa.array(n_tokens.astype(np.int64)), pa.array(one), pa.array(two)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, coded = None, [], {}
        for batch in batches:
            for _, block, part, payload, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if block != now:
                    if now is not None:
                        yield from finish(texts, coded)
                    now, texts, coded = block, [], {}
                if part < 0:
                    texts.append((payload, *rest))
                else:
                    coded[part] = payload
        if now is not None:
            yield from finish(texts, coded)

    return work


def _encoded(docs: DataFrame, path: str, pattern: str, digest: bool, schema: str) -> DataFrame:
    spark = docs.sparkSession
    T.small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    words = docs.mapInArrow(_explode(3 * parts, True), SHUFFLED).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode(path, pattern), SHUFFLED)
    rows = words.union(docs.mapInArrow(_explode(3 * parts, False), SHUFFLED))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(_assemble(path, digest), schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text): ordinary tokens, no special ones.

    path: a .tiktoken file; pattern: what cuts a text into pre-tokens (the
    byte-level BPE pattern).  A null or empty text has an empty array.  Rows
    stay apart, repeated ones too; other columns are ignored.
    """
    return _encoded(docs, path, pattern, False, "doc_id long, ids array<int>")


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes): the vocabulary; its size is that of the file."""
    return spark.createDataFrame([(i, bytes(b)) for i, b in enumerate(token_bytes(path))], "id int, bytes binary")


def decode(ids: DataFrame, path: str, ids_column: str | Column = "ids", piece: int = 4096) -> DataFrame:
    """The rows of ids, (doc_id, ids array), with decoded binary: their tokens' bytes, one after another.

    Ids are exploded with their positions, joined with the token-byte table
    (broadcast: as large as the vocabulary) and put together by position, in
    pieces of a row first.  An empty or null array gives no bytes.  An unknown
    id raises an error when the result is read.
    """
    spark = ids.sparkSession
    rows = ids.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", F.posexplode(ids_column).alias("_at", "id")).join(F.broadcast(token_table(spark, path)), "id", "left")
    each = each.withColumn("_hex", F.coalesce(F.hex("bytes"), F.raise_error(F.concat(F.lit("unknown token id "), F.col("id").cast("string")))))
    pieces = each.groupBy("_row", (F.col("_at") / piece).cast("int").alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("_at", "_hex"))).alias("_x"))
    pieces = pieces.select("_row", "_piece", F.concat_ws("", F.col("_x._hex")).alias("_text"))
    whole = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_piece", "_text"))).alias("_x")).select("_row", F.unhex(F.concat_ws("", F.col("_x._text"))).alias("decoded"))
    return rows.join(whole, "_row", "left").drop("_row").withColumn("decoded", F.coalesce("decoded", F.lit(b"")))


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text).

    ids_sha256: of the decimal ids, one space between; decoded_sha256: of the
    bytes that the ids stand for in the token-byte table.  A null or empty text
    has no ids and the digests of nothing; rows stay apart, repeated ones and
    those without doc_id too; other columns are ignored; an empty table gives
    no rows.
    """
    return _encoded(docs, path, pattern, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
