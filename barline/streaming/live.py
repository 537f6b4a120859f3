"""Streams of ticks to bars, merged bars with retractions, and multi-sink batches.

State is kept by key (symbol, exchange): the open minute bar for ticks, and for merged bars the stack of merged bars,
of which a new bar can only change the tail. Each change names the first row that it replaces, so a sink deletes rows
from there on and inserts the new ones.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.operators import cores

TICK = "symbol string, exchange string, datetime timestamp, event_id long, last_price double, volume double, turnover double, open_interest double"
_M1 = "symbol string, exchange string, timeframe string, id long, datetime timestamp, open_price double, high_price double, low_price double, close_price double, volume double, open_interest double, turnover double"
_OPEN = "id long, minute timestamp, open_price double, high_price double, low_price double, close_price double, bar_volume double, open_interest double, bar_turnover double, last_volume double, last_turnover double"


class OpenBar:
    """The open minute bar of a series with the last cumulative volume and turnover."""

    def __init__(self, state: tuple | None = None):
        self.state = list(state) if state else None

    def push(self, minute, price: float, volume: float, turnover: float, oi: float) -> tuple | None:
        """Takes a tick; the bar that it closes, if the minute changed."""
        s = self.state
        dv, dt = (0.0, 0.0) if s is None else (volume - s[9] if volume >= s[9] else 0.0, turnover - s[10] if turnover >= s[10] else 0.0)
        if s is not None and s[1] == minute:
            s[3], s[4], s[5] = max(s[3], price), min(s[4], price), price
            s[6], s[7], s[8], s[9], s[10] = s[6] + dv, oi, s[8] + dt, volume, turnover
            return None
        closed = self.bar()
        self.state = [1 if s is None else s[0] + 1, minute, price, price, price, price, dv, oi, dt, volume, turnover]
        return closed

    def bar(self) -> tuple | None:
        return None if self.state is None else tuple(self.state[:9])


def _minute_bars(flush: bool):
    def run(key, frames, state: GroupState):
        bar, out = OpenBar(state.get if state.exists else None), []
        rows = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame()
        if len(rows):
            rows = rows.sort_values(["datetime", "event_id"], kind="stable")
            rows = rows[rows["last_price"].notna()]
            minutes = rows["datetime"].dt.floor("min")
            for m, p, v, t, oi in zip(minutes, rows["last_price"], rows["volume"], rows["turnover"], rows["open_interest"]):
                if closed := bar.push(m.to_pydatetime(), p, v, t, oi):
                    out.append(closed)
        elif flush and state.hasTimedOut and bar.state:
            out.append(bar.bar())
        if bar.state is not None and not state.hasTimedOut:
            state.update(tuple(bar.state))
            if flush:
                state.setTimeoutDuration(60_000)
        elif state.hasTimedOut:
            state.remove()
        cols = [x.split()[0] for x in _M1.split(", ")]
        yield pd.DataFrame([(*key, "m1", *b) for b in out], columns=cols)

    return run


def minute_bars(ticks: DataFrame, flush: bool = False) -> DataFrame:
    """Closed minute bars of a stream of ticks, in order of arrival between batches and of time within one.

    A tick of an older minute than the open one, in a later batch, opens a second bar of that minute, as in the batch
    operator. flush: a bar that saw no tick for a minute of processing time is closed and its series starts anew.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush else GroupStateTimeout.NoTimeout
    return ticks.groupBy("symbol", "exchange").applyInPandasWithState(_minute_bars(flush), _M1, _OPEN, "append", timeout)


def clock_minute_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Minute bars by event time: ticks later than the watermark are dropped, which the operator above doesn't do."""
    order = F.struct("datetime", "event_id")
    groups = ticks.withWatermark("datetime", late).groupBy("symbol", "exchange", F.window("datetime", "1 minute"))
    bars = groups.agg(F.min_by("last_price", order).alias("open_price"), F.max("last_price").alias("high_price"), F.min("last_price").alias("low_price"), F.max_by("last_price", order).alias("close_price"), F.count("*").alias("n_ticks"))
    return bars.select("symbol", "exchange", F.col("window.start").alias("datetime"), "open_price", "high_price", "low_price", "close_price", "n_ticks")


_CBAR_STATE = "n long, starts array<long>, ends array<long>, highs array<double>, lows array<double>"
_CBAR_CHANGE = "symbol string, exchange string, timeframe string, backtrack_id long, id long, sbar_start_id long, sbar_end_id long, high_price double, low_price double"


def _cbar_changes(key, frames, state: GroupState):
    n, rows = 0, []
    if state.exists:
        n, starts, ends, highs, lows = state.get
        rows = [list(r) for r in zip(starts, ends, highs, lows)]
    stack, first = cores.CbarStack(rows), None
    for f in frames:
        for h, l in f.sort_values(["datetime", "id"], kind="stable")[["high_price", "low_price"]].itertuples(index=False):
            n += 1
            kept = stack.push(n, h, l)
            first = kept if first is None else min(first, kept)
    state.update((n, *[list(c) for c in zip(*stack.rows)]))
    out = [(*key, first + 1, i + 1, *stack.rows[i]) for i in range(first, len(stack.rows))] if first is not None else []
    yield pd.DataFrame(out, columns=[x.split()[0] for x in _CBAR_CHANGE.split(", ")])


def cbar_changes(bars: DataFrame) -> DataFrame:
    """Changes of merged bars: all rows from backtrack_id on take the place of what was there.

    Bars of a series must not arrive before those of an earlier batch.
    """
    groups = bars.groupBy("symbol", "exchange", "timeframe")
    return groups.applyInPandasWithState(_cbar_changes, _CBAR_CHANGE, _CBAR_STATE, "append", GroupStateTimeout.NoTimeout)


def replay_changes(changes: DataFrame, batch: str) -> DataFrame:
    """The merged bars that a log of changes, with a batch number, leads to: of each row the last batch that didn't cut it."""
    keys = ["symbol", "exchange", "timeframe"]
    cuts = changes.groupBy(*keys, batch).agg(F.min("backtrack_id").alias("_from"))
    later = W.partitionBy(*keys).orderBy(F.desc(batch)).rowsBetween(W.unboundedPreceding, -1)
    cuts = cuts.select(*keys, batch, F.min("_from").over(later).alias("_from"))
    return changes.join(cuts, [*keys, batch]).where("_from is null or id < _from").drop(batch, "backtrack_id", "_from")


def to_sinks(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True):
    """A query that hands each micro-batch, read once, to all sinks; progress is in the checkpoint folder."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
