"""Pre-tokens of byte-level BPE on whole batches, and a cache of what they give."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Sequence

import numpy as np

from . import _text as T

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: No letter, number or white space is assigned from here on.
_PLANES = 0x40000


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point, by the Unicode tables of the regex library."""
    import regex

    out = np.zeros(_PLANES, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, _PLANES)])
    text = points.astype(np.uint32).tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    out[WHITE_SPACE] = SPACE
    return out


def codepoints(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of UTF-8 texts; malformed bytes become U+FFFD."""
    raw = buf.tobytes()
    cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    if first[-1] != len(cps):
        texts = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint32), np.concatenate([[0], np.cumsum([len(t) // 4 for t in texts], dtype=np.int64)])
    return cps, first[off]


def pretokens(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the matches of the byte-level BPE pattern, texts apart.

    The same cuts as the pattern makes one after another: a run of letters, of
    numbers or of other characters takes one U+0020 before it; white space
    before a visible character leaves its last one out; an apostrophe that
    begins a match takes s, t, m, d, re, ve or ll.
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = char_classes()
    cls = table[np.minimum(cps, _PLANES - 1)]
    bound = np.zeros(n + 1, bool)
    bound[off] = True
    start = bound[:-1].copy()
    start[1:] |= cls[1:] != cls[:-1]
    a, b = T.runs(cls == SPACE, off)
    inner = ~bound[b]
    b = b[inner]
    start[b[cps[b - 1] == 0x20]] = False
    start[b - 1] = True
    q = np.flatnonzero(cps == 0x27)
    q = q[(q + 1 < n)]
    q = q[start[q] & ~bound[q + 1] & (cls[np.minimum(q + 1, n - 1)] == LETTER)]
    if len(q):
        one = cps[q + 1]
        more = (q + 2 < n) & ~bound[np.minimum(q + 2, n)]
        two = np.where(more, cps[np.minimum(q + 2, n - 1)], 0)
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            length[(one == ord(x)) & (two == ord(y))] = 3
        q, length = q[length > 0], length[length > 0]
        start[q + 1] = False
        to = q + length
        to = to[to < n]
        start[to[cls[to] == LETTER]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def point_values(cps: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each code point."""
    x = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    return x * np.uint64(0xD6E8FEB86659FD93)


class UnitCache:
    """A list of small integers for each distinct text unit, made once while it is kept.

    make: from texts to lists of integers.  Units are known by a 64-bit hash.
    Beyond limit units the cache starts anew, so its memory is bounded.
    """

    def __init__(self, make: Callable[[list], Sequence[Sequence[int]]], dtype=np.int32, limit: int = 1_000_000):
        self.make, self.dtype, self.limit = make, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.empty(1 << 16, self.dtype), 0
        self.begin, self.length, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0
        self.keys, self.rows = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int64)] * 2

    def _add(self, lists: Sequence[Sequence[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total, n = int(sizes.sum()), len(lists)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + total, self.dtype)])
        while self.n + n > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, self.begin]), np.concatenate([self.length, self.length])
        self.flat[self.used : self.used + total] = np.fromiter((x for one in lists for x in one), self.dtype, total)
        rows = np.arange(self.n, self.n + n)
        self.begin[rows] = self.used + np.cumsum(sizes) - sizes
        self.length[rows] = sizes
        self.used += total
        self.n += n
        return rows

    def rows_of(self, hashes: np.ndarray, text_of: Callable[[int], object]) -> np.ndarray:
        """For each unit its row in begin and length; text_of(i) gives the text of unit i."""
        if self.n > self.limit:
            self.clear()
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        rows = np.full(len(distinct), -1, np.int64)
        for keys, own in zip(self.keys, self.rows, strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[at] == distinct
                rows[hit] = own[at[hit]]
        new = np.flatnonzero(rows < 0)
        if len(new):
            made = [self._add(self.make([text_of(i) for i in first[part].tolist()])) for part in np.array_split(new, -(-len(new) // 5000))]
            rows[new] = np.concatenate(made)
            level = 1
            self._merge(level, distinct[new], rows[new])
            if len(self.keys[1]) > 100_000:
                self._merge(0, self.keys[1], self.rows[1])
                self.keys[1], self.rows[1] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return rows[back]

    def _merge(self, level: int, keys: np.ndarray, rows: np.ndarray) -> None:
        keys, rows = np.concatenate([self.keys[level], keys]), np.concatenate([self.rows[level], rows])
        order = np.argsort(keys, kind="stable")
        self.keys[level], self.rows[level] = keys[order], rows[order]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
