"""Token counts at every prefix by dynamic programming (operator 2).

For byte-level BPE the last token of a prefix is the only vocabulary entry that
ends there and fits the last token of the prefix before it.  One pass over a
pre-token gives the exact token count of each of its prefixes, and sums of
whole pre-tokens carry it over the text.  Truncation and budget questions are
then lookups; nothing is encoded again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._units import UnitCache, codepoints, load_ranks, point_values, pretokens

#: Contractions that are one match only when complete.
_SPLIT = {"'re", "'ve", "'ll"}


class PrefixCounter:
    """Exact token counts of the prefixes of a pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.fit: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether BPE leaves the two tokens side by side; before may be empty."""
        key = (before, token)
        got = self.fit.get(key)
        if got is None:
            if len(self.fit) > 500_000:
                self.fit.clear()
            got = self.fit[key] = self.merged(before + token) == ([before, token] if before else [token])
        return got

    def bytes_counts(self, piece: bytes) -> list[int]:
        """The token count of piece[:i] for i from 0."""
        ranks, fit = self.ranks, self.fit
        last, count = [b""], [0]
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - self.longest), i):
                token = piece[j:i]
                if token in ranks:
                    got = fit.get((last[j], token))
                    if got or (got is None and self.fits(last[j], token)):
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def char_counts(self, unit: str) -> list[int]:
        """The token count of unit[:i] for i from 1, for a whole pre-token."""
        if unit in _SPLIT:
            return [*self.char_counts("'"), self.char_counts("'")[0] + self.char_counts(unit[1])[0], self.bytes_counts(unit.encode())[-1]]
        count = self.bytes_counts(unit.encode())
        if len(count) == len(unit) + 1:
            return count[1:]
        ends = np.cumsum([len(c.encode()) for c in unit])
        return [count[i] for i in ends]


@functools.cache
def _cache(path: str) -> UnitCache:
    counter = PrefixCounter(load_ranks(path))
    return UnitCache(lambda units: [counter.char_counts(u) for u in units], limit=600_000)


def prefix_counts(cps: np.ndarray, off: np.ndarray, path: str) -> np.ndarray:
    """For each code point the token count of its text up to and with it (no special tokens)."""
    if not len(cps):
        return np.zeros(0, np.int64)
    cache, values = _cache(path), point_values(cps)

    def tables(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = cache.rows_of(T.span_hashes(values, starts, ends), lambda i: cps[starts[i] : ends[i]].tobytes().decode("utf-32-le", "surrogatepass"))
        begin, length = cache.begin[rows], cache.length[rows].astype(np.int64)
        return cache.flat[T.ragged(begin, length)].astype(np.int64), cache.flat[begin + length - 1].astype(np.int64)

    starts, ends = pretokens(cps, off)
    table, whole = tables(starts, ends)
    before = np.cumsum(whole) - whole
    at = np.searchsorted(starts, off[:-1])
    base = np.where(at < len(starts), before[np.minimum(at, len(before) - 1)], 0)
    before = before - np.repeat(base, np.diff(np.append(at, len(starts))))
    out = table + np.repeat(before, ends - starts)
    # a prefix that ends inside white space keeps that white space in one piece
    from ._units import _PLANES, SPACE, char_classes

    a, b = T.runs(char_classes()[np.minimum(cps, _PLANES - 1)] == SPACE, off)
    long = b - a > 1
    a, b = a[long], b[long]
    if len(a):
        inner, _ = tables(a, b)
        out[T.ragged(a, b - a)] = inner + np.repeat(before[np.searchsorted(starts, a)], b - a)
    return out


def _with_special(text: str, special: Sequence[str], path: str) -> np.ndarray:
    """The same for a text that holds strings of special tokens: each complete one is one token."""
    out, base = [], 0
    while True:
        found = min(((text.find(s), -len(s), s) for s in special if s in text), default=None)
        part = text if found is None else text[: found[0]] + found[2]
        cps = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        counts = prefix_counts(cps, np.array([0, len(cps)]), path) + base
        if found is None:
            return np.concatenate([*out, counts])
        base = (int(counts[found[0] - 1]) if found[0] else base) + 1
        counts[-1] = base
        out.append(counts)
        text = text[len(part) :]


def document_prefix_counts(buf: np.ndarray, off: np.ndarray, path: str, special: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, offsets): the token count at every prefix of each text."""
    cps, at = codepoints(buf, off)
    counts = prefix_counts(cps, at, path)
    raw = buf.tobytes()
    if any(s.encode() in raw for s in special):
        counts = counts.copy()
        for i in range(len(off) - 1):
            one = raw[off[i] : off[i + 1]]
            if any(s.encode() in one for s in special):
                counts[at[i] : at[i + 1]] = _with_special(cps[at[i] : at[i + 1]].tobytes().decode("utf-32-le", "surrogatepass"), special, path)
    return counts, at


def prefix_token_counts(docs: DataFrame, path: str, special: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """(doc_id, counts array<int>) for docs(doc_id, text): counts[i - 1] tokens in the first i code points.

    A null or empty text has an empty array.  path: ranks in a .tiktoken file.
    special: strings that are one token each.  Rows stay apart, in any number
    and order; other columns are ignored.  No shuffle.
    """
    T.small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            counts, at = document_prefix_counts(*T.buffer(T.column(batch, "text")), path, special)
            yield pa.record_batch([T.column_raw(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(counts.astype(np.int32)))], names=["doc_id", "counts"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, "doc_id long, counts array<int>")


def token_budget(docs: DataFrame, path: str, limit: int, special: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, keep_chars) from the prefix counts of each whole text.

    n_tokens: the last prefix count.  keep_chars: the code points of the longest
    prefix of at most limit tokens.  A null or empty text has 0 of each.
    """
    T.small_batches(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            buf, off = T.buffer(T.column(batch, "text"))
            counts, at = document_prefix_counts(buf, off, path, special)
            total = np.where(np.diff(at) > 0, np.append(counts, 0)[at[1:] - 1], 0)
            within = np.flatnonzero(counts <= limit)
            last = np.searchsorted(within, at[1:]) - 1
            end = np.where(last >= 0, np.append(within, -1)[last] + 1, 0)
            keep = np.maximum(end - at[:-1], 0)
            yield pa.record_batch([T.column_raw(batch, "doc_id"), pa.array(np.diff(off)), pa.array(total.astype(np.int64)), pa.array(total > limit), pa.array(keep.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long")
