"""Token-id files in byte-aligned variable-length coding (operator 4).

Ids are replaced by their rank by frequency in the corpus.  A rank takes one to
four bytes; a separate control stream holds two bits of length for each rank,
four to a byte, and a table of the 256 control bytes lets numpy decode whole
blocks.  A file is a Parquet part with one row for each block of documents:
their ids, token counts, control bytes and data bytes.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._units import UnitCache

#: Ids in a block of the file.
BLOCK = 1 << 20

# Where a text may be cut without a change of its tokens: at white space, and
# between ASCII letters or digits and this punctuation.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[ord(c) for c in '.,;:!?()[]{}"*#$%&-_/=+@~^`\\']] = 2

_LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)


@functools.cache
def _cache(path: str) -> UnitCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return UnitCache(lambda units: [x.ids for x in made.encode_batch(units, add_special_tokens=False)], limit=800_000)


_BYTE = T.byte_table(lower=False)


def encode_texts(buf: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of UTF-8 texts, as the tokenizers library encodes each one.

    For a vocabulary that drops white space and splits ASCII letters and digits
    from punctuation: the units between such cuts are encoded once each.
    """
    kind = _KIND[buf]
    cut = np.zeros(len(buf), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (((kind[1:] == 1) & (kind[:-1] == 2)) | ((kind[1:] == 2) & (kind[:-1] == 1)))
    bounds = np.unique(np.concatenate([off, np.flatnonzero(cut)]))
    starts, ends = T.runs(kind > 0, bounds)
    cache = _cache(path)
    rows = cache.rows_of(T.span_hashes(_BYTE[buf], starts, ends), lambda i: buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"))
    length = cache.length[rows].astype(np.int64)
    ids = cache.flat[T.ragged(cache.begin[rows], length)]
    return ids, np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, off)]


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary): little-endian unsigned 32-bit ids of each whole text with end_id after them."""
    T.small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            ids, at = encode_texts(*T.buffer(T.column(batch, "text")), path)
            out = np.insert(ids.astype(np.uint32), at[1:], end_id)
            at = at + np.arange(len(at))
            narrow = out.astype(np.uint16) if len(out) == 0 or out.max() < 1 << 16 else out
            raw = narrow.tobytes()
            w = narrow.itemsize
            yield pa.record_batch([T.column_raw(batch, "doc_id"), pa.array(np.full(batch.num_rows, w, np.int32)), pa.array([raw[w * a : w * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "width", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, "doc_id long, width int, ids binary")


def _wide(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if width == 2 else np.uint32)


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in the whole corpus."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width in (2, 4):
                blob = b"".join(b for b, w in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if w == width)
                own = np.bincount(_wide(blob, width))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["id", "n"])

    return ids.select("width", "ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: lengths by table lookup on the control bytes, then one gather for each byte place."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for place in range(1, int(size.max()) if n else 1):
        more = size > place
        out[more] |= raw[at[more] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


FILES = "part int, block long, doc_ids binary, known binary, counts binary, n_ids long, control binary, data binary"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order (nulls first, equal ids by their tokens).

    folder/ids has the blocks, in partitions by doc_id range; folder/ranks the
    ids by frequency, ties by id, as many rows as the vocabulary at most.  A
    null or empty text has only end_id.  The folder must be shared.
    """
    spark = docs.sparkSession
    encoded(docs, tokenizer, end_id).write.parquet(f"{folder}/plain")
    plain = spark.read.parquet(f"{folder}/plain")
    counts = id_counts(plain).orderBy(F.desc("n"), "id").collect()  # at most a row for each id of the vocabulary
    order = np.array([r["id"] for r in counts], np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        ids, known, parts, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            values = shared.value[np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
            control, data = pack_ranks(values)
            cells = [part, block, np.array(ids, np.int64).tobytes(), np.array(known, bool).tobytes(), np.array([len(p) for p in parts], np.int64).tobytes(), len(values), control, data]
            return pa.record_batch([pa.array([c], k) for c, k in zip(cells, [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["part", "block", "doc_ids", "known", "counts", "n_ids", "control", "data"])

        for batch in batches:
            for doc_id, width, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                parts.append(_wide(blob, width))
                n += len(parts[-1])
                if n >= BLOCK:
                    yield row()
                    block += 1
                    ids, known, parts, n = [], [], [], 0
        if ids:
            yield row()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(work, FILES).write.parquet(f"{folder}/ids")
    shared.unpersist()


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files; start counts the ids of all documents before.

    A document that was null or empty has its end id alone; repeated rows and
    rows without doc_id come back apart, each with its own start; files of an
    empty table give no rows.
    """
    T.small_batches(spark)
    blocks = spark.read.parquet(f"{folder}/ids")
    order = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(order)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, ids, known, counts, n, control, data = (batch.column(j)[i].as_py() for j in range(8))
                values = shared.value[unpack_ranks(control, data, n)].astype("<u4").tobytes()
                ends = np.cumsum(np.frombuffer(counts, np.int64))
                counts = np.frombuffer(counts, np.int64)
                crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                rows = len(counts)
                yield pa.record_batch([pa.array(np.full(rows, part, np.int32)), pa.array(np.full(rows, block)), pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(known, bool)), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    from pyspark.sql import Window

    # totals: a row for each block of a million ids, then for each part; both orders are by numbers written in the file
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = blocks.select("part", "block", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # a row for each part file, so that one ordered pass over them is small
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = at.join(before, "part").select("part", "block", (F.col("in_part") + F.col("before")).alias("at"))
    rows = blocks.mapInArrow(work, "part int, block long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "block"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def shared_folder(spark) -> str:
    """A new folder under the checkpoint directory."""
    T.checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
