"""Sessions with state of their own: event-time timers, list, value and map state, initial state, and state that expires."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SESSION = "user_id long, start_us long, last_us long, n long, total long, before string"


class Sessions(StatefulProcessor):
    """Emits a user's session when the watermark passes its end: the last event and a gap later, by a timer. Events may come
    in any order and join sessions that were apart. State of a user: the open sessions and the sizes of the latest closed ones
    (lists), and how many events there were in all (a value, which may start from elsewhere).

    Each access to state is a call to the executor's JVM, so open sessions are read and written together, and a user has one
    timer: for the open session that ends first, and when that has ended for the next.

    Once the watermark has passed a session, nothing can join it: later rows of that time are late and don't arrive here."""

    def __init__(self, gap_us: int, latest: int = 3):
        self.gap, self.latest = gap_us, latest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start_us long, last_us long, n long")
        self.sizes = handle.getListState("sizes", "n long")
        self.total = handle.getValueState("total", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.total.update((int(initialState["total"].iloc[0]),))

    def _first_end(self, open_) -> int:
        """The time in ms when the first of some sessions has ended."""
        return (min(last for _, last, _ in open_) + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        times = sorted(int(t) for frame in rows for t in frame["us"])
        known = [tuple(x) for x in self.open.get()]
        merged = []
        for start, last, n in sorted([*known, *((t, t, 1) for t in times)]):
            if merged and start < merged[-1][1] + self.gap:
                a, b, m = merged[-1]
                merged[-1] = (a, max(b, last), m + n)
            else:
                merged.append((start, last, n))
        if merged and merged != known:
            self.open.put(merged)
            if not known or self._first_end(merged) < self._first_end(known):  # else a timer comes no later
                self.handle.registerTimer(self._first_end(merged))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = sorted(tuple(x) for x in self.open.get())
        ended, left = [x for x in known if x[1] + self.gap < passed], [x for x in known if x[1] + self.gap >= passed]
        if left:
            self.handle.registerTimer(self._first_end(left))
        if not ended:
            return
        sizes, total = [x[0] for x in self.sizes.get()], (self.total.get() or (0,))[0]
        out = []
        for start, last, n in ended:
            total += n
            out.append((key[0], start, last, n, total, ",".join(map(str, sizes))))
            sizes = [*sizes, n][-self.latest :]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        self.sizes.put([(x,) for x in sizes])
        self.total.update((total,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SESSION.split(", ")])

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour", totals: DataFrame | None = None) -> DataFrame:
    """user_id, start, ended, n, total (events so far), before (sizes of the three sessions before) of each session of a stream
    (user_id, ts) that has ended. totals: user_id, total, a table of how many events of a user came before the stream."""
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    timed = rows.select("user_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late).groupBy("user_id")
    first = totals.groupBy("user_id") if totals is not None else None
    out = timed.transformWithStateInPandas(Sessions(gap_us), SESSION, "Append", "EventTime", initialState=first)
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("user_id", at("start_us").alias("start"), at("last_us").alias("ended"), "n", "total", "before")


class Fresh(StatefulProcessor):
    """Lets a kind of event of a user through if there was none for a while; the memory of it expires by itself."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_type string", "n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for kind in frame["event_type"].unique():
                if not self.seen.containsKey((kind,)):
                    self.seen.updateValue((kind,), (1,))
                    yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind]})

    def close(self) -> None:
        pass


def fresh(rows: DataFrame, ttl: str = "1 day") -> DataFrame:
    """user_id, event_type of a stream, each once in a time of processing."""
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return rows.groupBy("user_id").transformWithStateInPandas(Fresh(ms), "user_id long, event_type string", "Append", "ProcessingTime")
