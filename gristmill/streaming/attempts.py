"""STM3, STM4: keyed state: carried findings and locked-out sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOCKED = "ip long, locked_at timestamp, until timestamp"


def step(state: tuple, at: float, ok: bool, failures: int, window_s: float, lock_s: float) -> tuple[tuple, tuple | None]:
    """(state, lock) after one attempt; state: failures so far, time of the first one, locked until.

    Failures count in a window that starts with the first one; a success clears
    them; attempts while locked change nothing.
    """
    n, first, until = state
    if at < until:
        return state, None
    if ok:
        return (0, 0.0, 0.0), None
    if n == 0 or at - first > window_s:
        n, first = 0, at
    n += 1
    if n >= failures:
        return (0, 0.0, at + lock_s), (at, at + lock_s)
    return (n, first, 0.0), None


def _run(rows: pd.DataFrame, state: tuple, failures: int, window_s: float, lock_s: float) -> tuple[tuple, list]:
    locks = []
    for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
        at = ts.value / 1e9
        state, lock = step(state, at, bool(ok), failures, window_s, lock_s)
        if lock:
            locks.append((pd.Timestamp(lock[0], unit="s"), pd.Timestamp(lock[1], unit="s")))
    return state, locks


def lockouts(attempts: DataFrame, failures: int = 5, window_s: float = 600, lock_s: float = 900) -> DataFrame:
    """STM4 over a table attempts(ip, ts, ok): (ip, locked_at, until); ties by ok, failures first.

    Rows are sorted by source and time inside partitions and read as a stream,
    so a source with very many attempts needs no more memory than one.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, state = None, (0, 0.0, 0.0)
        for batch in batches:
            out = []
            for key, rows in batch.groupby("ip", sort=False):
                if key != ip:
                    ip, state = key, (0, 0.0, 0.0)
                state, locks = _run(rows, state, failures, window_s, lock_s)
                out += [(key, a, b) for a, b in locks]
            yield pd.DataFrame(out, columns=["ip", "locked_at", "until"]).astype({"ip": "int64", "locked_at": "datetime64[us]", "until": "datetime64[us]"})

    rows = attempts.where("ip is not null and ts is not null")
    return rows.repartition("ip").sortWithinPartitions("ip", "ts", "ok").mapInPandas(work, LOCKED)


def streaming_lockouts(attempts: DataFrame, failures: int = 5, window_s: float = 600, lock_s: float = 900) -> DataFrame:
    """STM4 over a stream: the same state for each source between micro-batches."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "ok"])
        now, locks = _run(rows, tuple(now), failures, window_s, lock_s)
        state.update(now)
        yield pd.DataFrame([(key[0], a, b) for a, b in locks], columns=["ip", "locked_at", "until"])

    return attempts.groupBy("ip").applyInPandasWithState(work, LOCKED, "n int, first double, until double", "append", GroupStateTimeout.NoTimeout)


CARRIED = "site string, class string, night long, nights int, stage string"


def streaming_life_cycle(nightly: DataFrame, absent_days: int = 1) -> DataFrame:
    """STM3 over a stream of rows (site, class, ts), a night or more a batch: nights in a row and stage; a gap starts anew.

    night is the day number of ts.  When the stream's time has passed
    absent_days without the finding, a resolved row is emitted for the night
    after its last one and its state is dropped.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["site", "class", "night", "nights", "stage"]
        if state.hasTimedOut:
            last, nights = state.get
            state.remove()
            yield pd.DataFrame([(*key, last + 1, nights, "resolved")], columns=columns)
            return
        last, nights = state.get if state.exists else (-10, 0)
        out = []
        for night in sorted(set(pd.concat(list(batches))["night"])):
            if night <= last:
                continue
            if out and night > last + 1 + absent_days or not out and last >= 0 and night > last + 1 + absent_days:
                out.append((*key, last + 1, nights, "resolved"))
            nights = nights + 1 if night == last + 1 else 1
            last = int(night)
            out.append((*key, last, nights, "new" if nights == 1 else "carried" if nights == 2 else "escalated"))
        state.update((last, nights))
        state.setTimeoutTimestamp(max((last + 1 + absent_days) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    rows = nightly.withWatermark("ts", "0 seconds").withColumn("night", F.unix_date(F.to_date("ts")).cast("long"))
    return rows.groupBy("site", "class").applyInPandasWithState(work, CARRIED, "last long, nights int", "append", GroupStateTimeout.EventTimeTimeout)
