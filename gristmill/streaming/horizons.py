"""STM5: open horizons that resolve at the first price on or after their due date, as prices arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.forecast import as_of

RESOLVED = "symbol string, id string, due timestamp, price double, ts timestamp"
_STATE = "held string"


def advance(held: dict, due: list[tuple[str, int]], prices: list[tuple[int, float]], watermark: int) -> tuple[dict, list[tuple]]:
    """(what stays open, resolved (id, due, price, ts)) of one symbol; times are whole microseconds.

    held: open, [id, due, ts, price] with the earliest price so far on or after
    due, null where there is none; recent, prices that a horizon which has yet
    to arrive may need.  A horizon resolves when the watermark has passed its
    price, so that no earlier one can come; of prices at the same time the
    smallest counts.  Prices behind the watermark are let go: a horizon that is
    not late is due after them.
    """
    recent = {int(k): v for k, v in held.get("recent", {}).items()}
    fresh: dict[int, float] = {}
    for at, price in prices:
        fresh[at] = min(price, fresh.get(at, price))
    for at, price in fresh.items():
        recent[at] = min(price, recent.get(at, price))
    open_, done = [], []
    rows = [(one, fresh) for one in held.get("open", [])] + [([i, at, None, None], recent) for i, at in due]
    for (i, at, ts, price), among in rows:
        for t, p in among.items():
            if t >= at and (ts is None or (t, p) < (ts, price)):
                ts, price = t, p
        if ts is not None and ts < watermark:
            done.append((i, at, price, ts))
        else:
            open_.append([i, at, ts, price])
    return {"open": open_, "recent": {k: v for k, v in recent.items() if k >= watermark}}, done


def _micros(column: pd.Series) -> list[int]:
    return column.astype("datetime64[us]").astype("int64").tolist()


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {}
    watermark = max(state.getCurrentWatermarkMs(), 0) * 1000
    due, prices = [], []
    for rows in batches:
        is_price = rows["price"].notna()
        prices += zip(_micros(rows.loc[is_price, "ts"]), rows.loc[is_price, "price"].tolist(), strict=True)
        named = rows.loc[~is_price & rows["id"].notna()]
        due += zip(named["id"].tolist(), _micros(named["ts"]), strict=True)
    held, done = advance(held, due, prices, watermark)
    if held["open"] or held["recent"]:
        state.update((json.dumps(held),))
        waits = [one[2] for one in held["open"] if one[2] is not None] + [int(t) for t in held["recent"]]
        if waits:
            state.setTimeoutTimestamp(max(min(waits), watermark) // 1000 + 1)
    elif state.exists:
        state.remove()
    if done:
        out = pd.DataFrame(done, columns=["id", "due", "price", "ts"])
        out.insert(0, "symbol", key[0])
        yield out.assign(due=pd.to_datetime(out["due"], unit="us"), ts=pd.to_datetime(out["ts"], unit="us"))


def resolved_horizons(horizons: DataFrame, prices: DataFrame, late: str = "1 day") -> DataFrame:
    """STM5: (symbol, id, due, price, ts): each of horizons(symbol, id, due) with the first of prices(symbol, ts, price) at or after due.

    Both are tables, or both are streams.  Tables: one as-of join; horizons
    without such a price are left out.  Streams: horizons wait in state keyed
    by symbol until the watermark, the slower of the two streams', has passed
    their price, so shuffled input and input that is late within `late` give
    what the tables give.  A horizon belongs to the event time at which it is
    due; one without id only moves the watermark on.  State holds a symbol's
    open horizons and the prices that the watermark hasn't passed.  Prices and
    due times that are null are ignored.
    """
    h = horizons.select("symbol", F.col("id").cast("string").alias("id"), F.col("due").cast("timestamp").alias("due")).where("due is not null")
    p = prices.select("symbol", "ts", F.col("price").cast("double").alias("price")).where("ts is not null and price is not null")
    if not horizons.isStreaming and not prices.isStreaming:
        first = p.groupBy("symbol", "ts").agg(F.min("price").alias("price"))
        got = as_of(h.where("id is not null"), first, "symbol", "due", "ts", "price", forward=True)
        return got.where("price is not null").select("symbol", "id", "due", "price", F.col("found_ts").alias("ts"))
    if not (horizons.isStreaming and prices.isStreaming):
        raise ValueError("horizons and prices must both be tables or both be streams")
    h = h.select("symbol", "id", F.col("due").alias("ts"), F.lit(None).cast("double").alias("price")).withWatermark("ts", late)
    p = p.select("symbol", F.lit(None).cast("string").alias("id"), "ts", "price").withWatermark("ts", late)
    return h.union(p).groupBy("symbol").applyInPandasWithState(_step, RESOLVED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
