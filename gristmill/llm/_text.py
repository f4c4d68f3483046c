"""Array helpers on Arrow text batches.

Every helper works on the UTF-8 buffer of a whole Arrow string column, so no
Python string is made per row.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is taken alone.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, _BASE_INV if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 8 * CHUNK:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(lower: bool, seed: int = 7) -> np.ndarray:
    """A random 64-bit number for each byte; lower gives A-Z those of a-z."""
    table = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(got, "") if got.null_count else got


def column_raw(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off * 0
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text and 4,095 rows at most."""
    for batch in batches:
        _, off = buffer(column(batch, text))
        at, rows = 0, batch.num_rows
        while at < rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), rows, at + 4095)
            yield batch.slice(at, to - at)
            at = to


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run never crosses a document's bounds."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    inner = off[(off > 0) & (off < len(mask))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every span, by prefix sums of a polynomial.

    values: a 64-bit number for each byte or character.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(len(values)), out=total[1:])
    got = (total[ends] - total[starts]) * powers(len(values), inverse=True)[starts]
    return mix(got + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def small_batches(spark, rows: int = 2000) -> None:
    """Python workers get batches of few rows, since texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception:  # noqa: BLE001  older sessions have no such setting
        pass


def checkpoint_dir(spark) -> None:
    """Checkpoints go where spark.checkpoint.dir says; unset (as in tests), to a folder of this machine."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"):
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir"))
        return
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
