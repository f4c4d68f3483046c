"""Chat formatting by incremental black-box rendering (operator 11).

A template is a function from turns to one string.  Nothing is known of its
insides: the turns of a conversation are rendered as successive prefixes, and
the output of each prefix is compared with the one before.  What a turn adds
is its span.  Where an output does not begin with the one before, the template
rewrites history; the span then begins at the first character that changed.
The place of a turn's text inside its span is found by rendering the turn once
more with a probe for its text.

Rows are dealt by conversation and streamed in turn order, so memory is
bounded by a window of turns, not by a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T

Turn = tuple[str, str]
#: Stands for a turn's text while its place is looked for: private-use characters, which no template should treat in a special way.
PROBE = "\ue000\ue001\ue000"
#: Turns and characters that are rendered again for each new turn, at most, unless one turn is longer or the template rewrites history.
WINDOW, WINDOW_CHARS = 16, 1 << 16
_OUT = 1 << 20


@dataclass(frozen=True)
class Template:
    """render(turns, before): the output for turns, which `before` others precede.

    read(output): (role, text, start, end) of each turn in an output that
    begins and ends between turns; start and end bound the text as written.
    plain(written): a text as it was before it was written.
    """

    render: Callable[[Sequence[Turn], int], str]
    read: Callable[[str], Iterable[tuple[str, str, int, int]]]
    plain: Callable[[str], str]


# A control string inside a text gets one more backslash after its first character than it had; reading takes one away.
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _render(turns: Sequence[Turn], before: int) -> str:
    return "".join([f"<s>{escape(role)}[INST]{escape(text)}[/INST]</s>\n" for role, text in turns])


def _read(output: str) -> Iterator[tuple[str, str, int, int]]:
    for m in _TURN.finditer(output):
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


#: One marked block a turn, whatever its role; control strings inside roles and texts are escaped reversibly.
MARKED = Template(_render, _read, unescape)


@dataclass(frozen=True)
class Span:
    """What a turn adds: output[:start] stays and piece follows; text is at piece[text_start:text_end], None if it can't be located."""

    start: int
    piece: str
    text_start: int | None
    text_end: int | None
    rewrote: int


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Prefixes:
    """Renders one conversation's prefixes, one turn after another.

    Turns that lie further back than the window are cut off when the output of
    the last turn alone is the end of the output so far; a template that needs
    more of the past, or has rewritten it, keeps the whole conversation.
    """

    def __init__(self, template: Template, window: int = WINDOW, chars: int = WINDOW_CHARS):
        self.render, self.window, self.chars = template.render, window, chars
        self.held: list[Turn] = []
        self.before, self.base, self.output, self.may_cut = 0, 0, "", True

    def add(self, role: str, text: str, locate: bool = True) -> Span:
        held = self.held
        held.append((role, text))
        output = self.render(held, self.before)
        keep = len(self.output) if output.startswith(self.output) else _common(self.output, output)
        rewrote = len(self.output) - keep
        span = Span(self.base + keep, output[keep:], *(self._text(output, keep) if locate else (None, None)), rewrote)
        self.output = output
        self.may_cut = self.may_cut and not rewrote
        if self.may_cut and len(held) > 1 and (len(held) >= self.window or len(output) > self.chars):
            tail = self.render(held[-1:], self.before + len(held) - 1)
            if output.endswith(tail):
                self.before += len(held) - 1
                self.base += len(output) - len(tail)
                self.held, self.output = held[-1:], tail
            else:
                self.may_cut = False
        return span

    def _text(self, output: str, keep: int) -> tuple[int | None, int | None]:
        probed = self.render([*self.held[:-1], (self.held[-1][0], PROBE)], self.before)
        at = probed.find(PROBE, keep)
        if at < 0:
            return None, None
        tail = len(probed) - at - len(PROBE)
        if len(output) - tail < at or output[:at] != probed[:at] or (tail and output[-tail:] != probed[-tail:]):
            return None, None
        return at - keep, len(output) - tail - keep


FORMATTED = "conv_id long, seq long, turn long, role string, start long, piece string, loss_start int, loss_end int, rewrote long"
_TYPES = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("rewrote", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def formatted(conversations: DataFrame, template: Template = MARKED, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """A row for each row of conversations(conv_id, turn, role, text): what its turn adds to the conversation's output.

    seq counts a conversation's turns from 0 in the order of turn, role, text
    (nulls first), so ties and repeated rows have a place too.  output[:start]
    stays and piece follows it; rewrote counts the characters of the earlier
    output that the turn took away (0 for an append-only template).  The loss
    mask covers piece[loss_start:loss_end], in code points: the whole text of a
    turn of loss_roles and nothing else; null for other turns, and where a
    template changes the text so that its place can't be told.  Null roles and
    texts count as empty; rows with a null conv_id form one conversation; an
    empty table gives no rows; other columns are ignored.

    A conversation is streamed through one task in turn order, with a window of
    it in memory.
    """
    spark = conversations.sparkSession
    T.small_batches(spark)
    wanted = frozenset(loss_roles)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        prefixes, seq = Prefixes(template), 0
        rows, size = [], 0
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv,) != now:
                    now, prefixes, seq = (conv,), Prefixes(template), 0
                role, text = role or "", text or ""
                span = prefixes.add(role, text, role in wanted)
                rows.append((conv, seq, turn, role, span.start, span.piece, span.text_start, span.text_end, span.rewrote))
                seq += 1
                size += len(span.piece)
                if size > _OUT or len(rows) >= 4000:
                    yield _batch(rows, _TYPES)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, _TYPES)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    return turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(work, FORMATTED)


def rewritten(pieces: DataFrame) -> DataFrame:
    """(conv_id, first_seq, characters): conversations whose template rewrote history, the first turn that did so, and how much was taken away."""
    return pieces.where("rewrote > 0").groupBy("conv_id").agg(F.min("seq").alias("first_seq"), F.sum("rewrote").alias("characters"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame, template: Template = MARKED, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from the pieces of formatted().

    Roles and texts come from the output alone, by the template's reader: the
    digest of role, line feed, text, line feed of each turn, and that of the
    texts under the loss mask.  A conversation whose history was rewritten, or
    whose turns the reader doesn't find, has null digests.  in_order: the rows
    come as formatted() made them; else they are dealt and sorted again.
    """
    spark = pieces.sparkSession

    def row(conv, n, found, turns, loss_chars, loss, chars) -> tuple:
        whole = found == n
        return conv, n, turns.hexdigest() if whole else None, loss_chars, loss.hexdigest() if whole else None, chars

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple = ()
        n = found = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows = []
            for conv, _, start, piece, a, b in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (conv,) != now:
                    if now:
                        rows.append(row(*now, n, found, turns, loss_chars, loss, chars))
                    now = (conv,)
                    n = found = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                n += 1
                if start == chars:
                    got = list(template.read(piece))
                    found += len(got)
                    for role, text, _, _ in got:
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                else:  # what was read before is no longer so
                    found = -1 << 62
                if a is not None:
                    text = template.plain(piece[a:b])
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "replace"))
                chars = start + len(piece)
            if rows:
                yield _batch(rows, _READ_TYPES)
        if now:
            yield _batch([row(*now, n, found, turns, loss_chars, loss, chars)], _READ_TYPES)

    rows = pieces.select("conv_id", "seq", "start", "piece", "loss_start", "loss_end")
    if not in_order:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(work, READ)
