"""Personal data: fixed patterns and a linear-chain CRF over word shapes (operator 5).

The patterns give the base spans.  A conditional random field, trained from a
small labelled table, tags words by their shape and their neighbours' shapes
and finds data in forms that the patterns don't know, such as a phone number
without a plus.  It is decoded by Viterbi for many sequences at once in numpy.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text as T

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
SHAPES = 1 << 11
DIGIT_CLASSES = 8
#: Words after which a line is cut: in training at once, in decoding behind one of the next WINDOW words that is surely no data.
SEQUENCE = 128
WINDOW = 16

DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGITS, _ALNUM = "0123456789", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IN_EMAIL, _IN_IP, _IN_PHONE, _DIGIT = _set(_ALNUM + "._%+-@"), _set(_DIGITS + "."), _set(_DIGITS + " ().-"), _set(_DIGITS)
_SPACE = _set(" \t\n\r\x0b\x0c")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _regions(buf: np.ndarray, off: np.ndarray, inside: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of inside bytes, texts apart, that hold one of the given positions."""
    if not len(at):
        return []
    breaks = np.flatnonzero(~inside[buf])
    text = np.searchsorted(off, at, "right") - 1
    k = np.searchsorted(breaks, at)
    low = np.where(k > 0, np.append(breaks, 0)[k - 1] + 1, 0)
    high = np.where(k < len(breaks), np.append(breaks, len(buf))[np.minimum(k, len(breaks))], len(buf))
    low, high = np.maximum(low, off[text]), np.minimum(high, off[text + 1])
    return sorted(set(zip(low.tolist(), high.tolist(), strict=True)))


def emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """The email spans of a run of email characters, one step for each @: what stands before it belongs to its local part."""
    free = 0  # behind the last @ and the last span
    at = raw.find(b"@")
    while at >= 0:
        after = raw.find(b"@", at + 1)
        m = DOMAIN.match(raw, at + 1, after if after >= 0 else len(raw)) if at > free else None
        if m:
            yield free, m.end()
        free = m.end() if m else at + 1
        at = after


def addresses(raw: bytes) -> Iterator[tuple[int, int]]:
    """The ip spans of a run of digits and dots: each four groups of a chain, left to right, parts at most 255."""
    for chain in DOTTED.finditer(raw):
        groups = chain.group().split(b".")
        ends = (np.cumsum([len(g) + 1 for g in groups]) - 1 + chain.start()).tolist()
        for i in range(0, len(groups) - 3, 4):
            if all(len(g.lstrip(b"0")) <= 3 and int(g.lstrip(b"0") or b"0") <= 255 for g in groups[i : i + 4]):
                yield ends[i] - len(groups[i]), ends[i + 3]


def base_spans(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of every base span."""
    raw = buf.tobytes()
    out = []
    for low, high in _regions(buf, off, _IN_EMAIL, np.flatnonzero(buf == 0x40)):
        out += [(0, low + a, low + b) for a, b in emails(raw[low:high])]
    digit = _DIGIT[buf]
    dots = np.flatnonzero((buf[1:-1] == 0x2E) & digit[:-2] & digit[2:]) + 1
    for low, high in _regions(buf, off, _IN_IP, dots):
        out += [(1, low + a, low + b) for a, b in addresses(raw[low:high])]
    at = np.flatnonzero(digit)
    if len(at):
        gap = np.diff(at)
        between = buf[np.minimum(at[:-1] + 1, len(buf) - 1)]
        text = np.searchsorted(off, at, "right")
        joined = ((gap == 1) | ((gap == 2) & ((between == 0x20) | (between == 0x2D)))) & (text[1:] == text[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        size = np.diff(np.append(first, len(at)))
        for f, n in zip(first[(size >= 14) & (size <= 19)].tolist(), size[(size >= 14) & (size <= 19)].tolist(), strict=True):
            if luhn(buf[at[f : f + n]].tobytes().decode()):
                out.append((2, int(at[f]), int(at[f + n - 1]) + 1))
    plus = np.flatnonzero((buf[:-1] == 0x2B) & digit[1:])
    for p in plus.tolist():
        end = int(off[np.searchsorted(off, p, "right")])
        stop = p + 1
        while stop < end and _IN_PHONE[buf[stop]]:
            stop += 1
        m = PHONE.match(raw[p:stop])
        if m and 10 <= sum(48 <= c <= 57 for c in m.group()) <= 15:
            out.append((3, p, p + m.end()))
    return out


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shape, digits): the words, the hashed shape of each and the class of its number of digits.

    A shape has one sign for a run of capitals, of other letters or of digits,
    and every other character as it is.
    """
    starts, ends = T.runs(~_SPACE[buf], off)
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sign = buf.copy()
    sign[_DIGIT[buf]] = ord("9")
    sign[(buf >= 65) & (buf <= 90)] = ord("X")
    sign[((buf >= 97) & (buf <= 122)) | (buf >= 128)] = ord("x")
    new = np.ones(len(buf), bool)
    run = (sign == ord("9")) | (sign == ord("X")) | (sign == ord("x"))
    new[1:] = (sign[1:] != sign[:-1]) | ~run[1:]
    new[starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    shape = T.span_hashes(_BYTE[sign[new]], place[starts], place[ends]) % np.uint64(SHAPES)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
    n = digits[ends] - digits[starts]
    return starts, ends, shape.astype(np.int64), np.searchsorted([1, 3, 4, 6, 9, 13, 16], n, "right")


_BYTE = T.byte_table(lower=False, seed=31)


def lines(buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bounds of the lines of all texts in the list of words."""
    ends = np.flatnonzero(buf == 0x0A)
    return np.unique(np.concatenate([[0], np.searchsorted(starts, off), np.searchsorted(starts, ends), [len(starts)]]))


def sequences(buf: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bounds of the sequences to train on in the list of words."""
    cuts = lines(buf, off, starts)
    sizes = np.diff(cuts)
    pieces = -(-sizes // SEQUENCE)
    return np.append(np.repeat(cuts[:-1], pieces) + SEQUENCE * T.ragged(np.zeros(len(sizes), np.int64), pieces), len(starts))


class CRF:
    """Weights of a linear-chain CRF: of a word's shape, its neighbours' shapes, its digits, and of label pairs."""

    def __init__(self) -> None:
        self.own = np.zeros((SHAPES, LABELS))
        self.left = np.zeros((SHAPES + 1, LABELS))  # the last row: no neighbour
        self.right = np.zeros((SHAPES + 1, LABELS))
        self.digits = np.zeros((DIGIT_CLASSES, LABELS))
        self.pairs = np.zeros((LABELS, LABELS))
        self.first = np.zeros(LABELS)

    @staticmethod
    def neighbours(shape: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.append(SHAPES, shape[:-1]), np.append(shape[1:], SHAPES)
        left[bounds[:-1]] = SHAPES
        right[bounds[1:] - 1] = SHAPES
        return left, right

    def emissions(self, shape: np.ndarray, digits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        left, right = self.neighbours(shape, bounds)
        return self.own[shape] + self.left[left] + self.right[right] + self.digits[digits]

    def train(self, shape: np.ndarray, digits: np.ndarray, bounds: np.ndarray, gold: np.ndarray, steps: int = 120, rate: float = 0.2, decay: float = 2e-4) -> None:
        """Maximum likelihood by Adam, with forward and backward sums over padded sequences."""
        n = np.diff(bounds)
        count, longest = len(n), int(n.max())
        row = np.repeat(np.arange(count), n)
        col = T.ragged(np.zeros(count, np.int64), n)
        left, right = self.neighbours(shape, bounds)
        params = [self.own, self.left, self.right, self.digits, self.pairs, self.first]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        inner = col > 0
        for step in range(1, steps + 1):
            emit = self.emissions(shape, digits, bounds)
            E = np.zeros((count, longest, LABELS))
            E[row, col] = emit
            alpha = np.empty_like(E)
            alpha[:, 0] = E[:, 0] + self.first
            for t in range(1, longest):
                x = alpha[:, t - 1, :, None] + self.pairs
                top = x.max(1)
                alpha[:, t] = E[:, t] + top + np.log(np.exp(x - top[:, None]).sum(1))
            last = alpha[np.arange(count), n - 1]
            top = last.max(1)
            whole = top + np.log(np.exp(last - top[:, None]).sum(1))
            beta = np.zeros_like(E)
            for t in range(longest - 2, -1, -1):
                x = self.pairs + (E[:, t + 1] + beta[:, t + 1])[:, None]
                top = x.max(2)
                got = top + np.log(np.exp(x - top[:, :, None]).sum(2))
                beta[:, t] = np.where((t < n - 1)[:, None], got, 0)
            p = np.exp(alpha[row, col] + beta[row, col] - whole[row, None])
            error = p.copy()
            error[np.arange(len(gold)), gold] -= 1
            g_pairs = np.zeros_like(self.pairs)
            r, c = row[inner], col[inner]
            joint = np.exp(alpha[r, c - 1][:, :, None] + self.pairs + (E[r, c] + beta[r, c])[:, None] - whole[r, None, None])
            g_pairs += joint.sum(0)
            np.subtract.at(g_pairs, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
            grads = []
            for param, index in ((self.own, shape), (self.left, left), (self.right, right), (self.digits, digits)):
                g = np.zeros_like(param)
                np.add.at(g, index, error)
                grads.append(g)
            grads += [g_pairs, error[col == 0].sum(0)]
            for param, g, (m, v) in zip(params, grads, state, strict=True):
                g = g / count + decay * param
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def pieces(self, emit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The bounds with further ones in long sequences, each behind a word whose best label is none whatever the labels outside its window are.

        Such a word parts the best labels before it from those after it, so
        that pieces decode to the same labels as whole sequences.  Where a
        window has no such word, the piece goes on to the next window.
        """
        n = np.diff(bounds)
        windows = np.maximum(n - WINDOW, 0) // SEQUENCE
        at = np.repeat(bounds[:-1], windows) + SEQUENCE * (1 + T.ragged(np.zeros(len(n), np.int64), windows))
        if not len(at):
            return bounds
        pairs, none = self.pairs.astype(np.float32), np.where(np.eye(LABELS), 0, -1e9).astype(np.float32)
        near = emit[at[:, None] + np.arange(WINDOW)].astype(np.float32)
        gap = np.zeros((len(at), WINDOW, LABELS), np.float32)  # what none is ahead of each label by, at least
        best = np.repeat(none[None], len(at), 0)  # [window, first label, label]
        for j in range(1, WINDOW):
            best = (best[:, :, :, None] + pairs).max(2) + near[:, j, None]
            gap[:, j] += (best[:, :, :1] - best).min(1)
        best = np.repeat(none[None], len(at), 0)  # [window, label, last label]
        for j in range(WINDOW - 2, 0, -1):
            best = (pairs[:, :, None] + (near[:, j + 1, :, None] + best)[:, None]).max(2)
            gap[:, j] += (best[:, :1] - best).min(2)
        least = gap[:, 1:-1, 1:].min(2)
        word = least.argmax(1)
        sure = least[np.arange(len(at)), word] > 1e-2
        return np.union1d(bounds, (at + word + 2)[sure])

    def viterbi(self, emit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every word, for all sequences at once."""
        cuts = self.pieces(emit, bounds)
        n = np.diff(cuts)
        order = np.argsort(-n, kind="stable")
        n, begin = n[order], cuts[:-1][order]
        emit = emit.astype(np.float32)
        pairs = self.pairs.T.astype(np.float32)  # [to, from]
        inner = ~np.isin(begin, bounds)[:, None]  # behind a word without data
        back, score = [], emit[begin] + np.where(inner, self.pairs[0], self.first).astype(np.float32)
        final = np.zeros(len(n), np.int64)
        active = len(n)
        for t in range(1, int(n[0]) if len(n) else 0):
            now = int(np.searchsorted(-n, -t, "left"))  # sequences longer than t
            if now < active:
                final[now:active] = score[now:active].argmax(1)
            active = now
            x = score[:active, None, :] + pairs
            best = x.argmax(2)
            back.append(best.astype(np.int8))
            score = np.take_along_axis(x, best[:, :, None], 2)[:, :, 0] + emit[begin[:active] + t]
        final[:active] = score[:active].argmax(1)
        out = np.zeros(len(emit), np.int8)
        state = final.copy()
        out[begin + n - 1] = final
        for t in range(len(back), 0, -1):
            now = len(back[t - 1])
            state[:now] = back[t - 1][np.arange(now), state[:now]]
            out[begin[:now] + t - 1] = state[:now]
        return out


_SHORT = "the of and see call or at from is with for mail to la de und der en el".split()


def labelled_rows(seed: int = 5, n: int = 700) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: made-up lines with personal data in many forms, and look-alikes without."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: pick(*_SHORT) if rng.random() < 0.5 else "".join(pick(*"aeiouthnrsdl") for _ in range(int(rng.integers(2, 9))))
    hexa = lambda k: "".join(pick(*"0123456789abcdef") for _ in range(k))
    forms = {
        "email": [lambda: f"{word()}.{d(2)}@{word()}.com", lambda: f"{word()}@{word()}{d(1)}.example.org", lambda: f"{word()}_{word()}@{word()}.net", lambda: f"{word()} (at) {word()} (dot) com", lambda: f"{word()}[at]{word()}.com"],
        "ip": [lambda: ".".join(str(int(rng.integers(1, 256))) for _ in range(4)), lambda: ".".join(str(int(rng.integers(1, 256))) for _ in range(4)) + f":{d(4)}"],
        "card": [lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(4)} {d(6)} {d(5)}"],
        "phone": [lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
    }
    other = [lambda: f"version {d(1)}.{d(1)}.", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: d(int(rng.integers(1, 8))), lambda: f"{d(1)},{d(3)}", lambda: f"{d(2)}%", lambda: f'token = "{d(2)}a{d(3)}bc{d(4)}ef"', lambda: f"{d(1)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{word()}={hexa(18)}", lambda: hexa(40), lambda: f'"{hexa(32)}"', lambda: f"{word().upper()}-{d(3)}", lambda: f"({word()})", lambda: f"v{d(1)}.{d(1)}.{d(2)}"]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(3, 14))):
            x = rng.random()
            if x < 0.18:
                kind = pick(*KINDS)
                got = pick(*forms[kind])()
                spans.append((kind, len(text), len(text) + len(got)))
                text += got + pick("", "", "", ".", ",", "!!", "***")
            elif x < 0.36:
                text += pick(*other)()
            else:
                got = word()
                text += (got.capitalize() if rng.random() < 0.15 else got.upper() if rng.random() < 0.05 else got) + pick("", "", "", "", ".", ",", "!!", "###", " |")
            text += " "
        rows.append((text.rstrip(), spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """(text, spans array<struct<kind, start, end>>): the labelled table that the query's CRF learns from."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


def train(labelled: DataFrame) -> CRF:
    """A CRF from labelled(text, spans), a small table that is gathered whole; spans are code points, end exclusive."""
    return fit([(r["text"], [tuple(s) for s in r["spans"] or []]) for r in labelled.collect() if r["text"]])


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> CRF:
    raw = [t.encode() for t, _ in rows]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, shape, digits = word_features(buf, off)
    bounds = sequences(buf, off, starts)
    gold = np.zeros(len(starts), np.int64)
    for i, (text, spans) in enumerate(rows):
        for kind, a, b in spans:
            low = int(off[i]) + len(text[:a].encode())
            high = int(off[i]) + len(text[:b].encode())
            own = np.flatnonzero((starts < high) & (ends > low))
            gold[own] = 2 + 2 * KINDS.index(kind)
            gold[own[:1]] -= 1
    out = CRF()
    if len(starts):
        out.train(shape, digits, bounds, gold)
    return out


@functools.cache
def default_crf() -> CRF:
    return fit(labelled_rows())


_LETTERS = _set(_ALNUM[10:])
_LETTERS[128:] = True
_EDGE = _set(_ALNUM + "+(")
_TAIL = _set(_ALNUM + ")")


def crf_spans(crf: CRF, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the spans that the CRF tags, punctuation at their ends left out.

    A tagged stretch counts when it holds what such data holds: for an email an
    @ or "at", else no letters and as many digits as the kind has at least.
    """
    starts, ends, shape, digits = word_features(buf, off)
    if not len(starts):
        return []
    bounds = lines(buf, off, starts)
    label = crf.viterbi(crf.emissions(shape, digits, bounds), bounds)
    tagged = np.flatnonzero(label > 0)
    if not len(tagged):
        return []
    kind = (label[tagged] - 1) // 2
    begins = (label[tagged] % 2 == 1) | np.concatenate([[True], (np.diff(tagged) > 1) | (np.diff(kind) != 0)])
    begins |= np.isin(tagged, bounds)
    first = np.flatnonzero(begins)
    out = []
    for a, b in zip(first.tolist(), np.append(first[1:], len(tagged)).tolist(), strict=True):
        low, high, k = int(starts[tagged[a]]), int(ends[tagged[b - 1]]), int(kind[a])
        while low < high and not _EDGE[buf[low]]:
            low += 1
        while high > low and not _TAIL[buf[high - 1]]:
            high -= 1
        text = buf[low:high]
        n = int(_DIGIT[text].sum())
        raw = text.tobytes().lower()
        letters = int(_LETTERS[text].sum())
        if (b"@" in raw or b"at" in raw) if k == 0 else letters == 0 and n >= (4, 13, 7)[k - 1]:
            out.append((k, low, high))
    return out


def all_spans(crf: CRF, buf: np.ndarray, off: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, added): the base spans, and the CRF's that touch none of them; in bytes, by start and kind."""
    base = sorted(base_spans(buf, off), key=lambda s: (s[1], s[0]))
    covered = np.zeros(len(buf) + 1, np.int32)
    for _, a, b in base:
        covered[a:b] = 1
    covered = np.concatenate([[0], np.cumsum(covered)])
    added = [s for s in crf_spans(crf, buf, off) if covered[s[1]] == covered[s[2]]]
    return base, added


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def found(docs: DataFrame, crf: CRF) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs(doc_id, text); no shuffle.

    Counts and hash are of the base spans; spans has the CRF's too, as
    kind:start:end in code points.  A null or empty text has none.
    """
    import hashlib

    T.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            buf, off = T.buffer(T.column(batch, "text"))
            base, added = all_spans(shared.value, buf, off)
            point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            own: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            more: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for spans, to in ((base, own), (added, more)):
                for k, a, b in spans:
                    i = int(np.searchsorted(off, a, "right")) - 1
                    to[i].append((k, int(point[a] - point[off[i]]), int(point[b] - point[off[i]])))
            text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))
            yield pa.record_batch(
                [
                    T.column_raw(batch, "doc_id"),
                    *(pa.array([sum(s[0] == k for s in spans) for spans in own], pa.int64()) for k in range(4)),
                    pa.array([hashlib.sha256(text(spans).encode()).hexdigest() for spans in own], pa.string()),
                    pa.array([text(a + b) for a, b in zip(own, more, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, SPANS)


def masked(docs: DataFrame, crf: CRF) -> DataFrame:
    """The rows of docs, all columns kept, with each span in column text replaced by <kind>; a null text stays null.

    Spans that overlap are replaced as one, by the first one's kind.  A text
    without personal data stays as it is.
    """
    T.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            buf, off = T.buffer(T.column(batch, "text"))
            base, added = all_spans(shared.value, buf, off)
            spans = sorted(base + added, key=lambda s: (s[1], s[0]))
            raw = buf.tobytes()
            was = T.column_raw(batch, "text")
            texts: list[str | None] = was.to_pylist() if spans else []
            by: dict[int, list[tuple[int, int, int]]] = {}
            for s in spans:
                by.setdefault(int(np.searchsorted(off, s[1], "right")) - 1, []).append(s)
            for i, own in by.items():
                out, at = [], int(off[i])
                for k, a, b in own:
                    if a >= at:
                        out += [raw[at:a], f"<{KINDS[k]}>".encode()]
                    at = max(at, b)
                texts[i] = b"".join([*out, raw[at : off[i + 1]]]).decode("utf-8", "replace")
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type) if spans else was)

    return docs.mapInArrow(work, docs.schema)
