"""Sessions by timers, over restarts, and state that expires."""

import datetime as dt
import time

import pandas as pd
from pyspark.sql import functions as F

from graniteql.streaming import events, sessions


def stream(spark, path):
    return spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(path)


def put(spark, path, rows):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(i, u, k, at(m)) for i, u, k, m in rows], "event_id long, user_id long, event_type string, ts timestamp").repartition(2).write.mode("append").parquet(path)


def minutes(rows):
    return sorted((r["user_id"], *((r[c] - dt.datetime(2024, 1, 1)).total_seconds() / 60 for c in ("start", "ended")), r["n"], r["total"], r["before"]) for r in rows)


def test_sessions_over_a_restart(spark, tmp_path):
    """What is open when the stream stops goes on from the checkpoint; rows out of order join sessions; late rows are lost."""
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    totals = spark.createDataFrame([(1, 100)], "user_id long, total long")

    def run():
        return minutes(events.result(sessions.sessions(stream(spark, path), totals=totals), "append", store="rocksdb", checkpoint=checkpoint).collect())

    put(spark, path, [(1, 1, "a", 0), (2, 1, "a", 20), (3, 1, "a", 200), (4, 2, "a", 255), (5, 1, "a", 300), (6, 1, "b", 340)])
    assert run() == [(1, 0, 20, 2, 102, ""), (1, 200, 200, 1, 103, "2")]  # the watermark is at 280 minutes
    # 320 joins 300 and 340; 100 is late; the others move the watermark on
    put(spark, path, [(7, 1, "a", 320), (8, 1, "a", 100), (9, 2, "a", 600), (10, 1, "a", 590)])
    assert run() == [(1, 300, 340, 3, 106, "2,1"), (2, 255, 255, 1, 1, "")]
    put(spark, path, [(11, 3, "a", 2000)])
    assert run() == [(1, 590, 590, 1, 107, "2,1,3"), (2, 600, 600, 1, 2, "1")]


class Handle:
    """State of one user in memory, which counts the calls to it: each is one to the executor's JVM."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def state(self, name, kind):
        self.held[name], handle = kind(), self

        class State:
            def __getattr__(self, what):
                def call(*x):
                    handle.calls += 1
                    held = handle.held[name]
                    if what in ("put", "update"):
                        handle.held[name] = x[0]
                    elif what == "clear":
                        handle.held[name] = kind()
                    elif what == "updateValue":
                        held[x[0]] = x[1]
                    elif what == "removeKey":
                        del held[x[0]]
                    return {"get": iter(held) if kind is list else held, "iterator": iter(dict(held).items()) if kind is dict else None, "exists": held is not None}.get(what)

                return call

        return State()

    def getMapState(self, name, *_):
        return self.state(name, dict)

    def getListState(self, name, *_):
        return self.state(name, list)

    def getValueState(self, name, *_):
        return self.state(name, lambda: None)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_user_has_few_calls_to_state():
    """200 sessions of two events that end at once, one timer and a few calls; one more ends later, by a timer of its own."""
    hour, gap = 3_600_000_000, 1_800_000_000
    handle, processor = Handle(), sessions.Sessions(gap)
    processor.init(handle)
    times = [t for i in range(200) for t in (i * hour, i * hour + 1000)] + [1000 * hour]
    list(processor.handleInputRows((1,), iter([pd.DataFrame({"us": times[::-1]})]), None))
    got = []
    for watermark in (300 * hour // 1000, 1001 * hour // 1000):
        while due := sorted(t for t in handle.timers if t <= watermark):
            handle.timers.remove(due[0])
            got += [tuple(r) for frame in processor.handleExpiredTimer((1,), Now(watermark), None) for r in frame.itertuples(index=False)]
    assert [r[1:5] for r in got] == [(i * hour, i * hour + 1000, 2, 2 * i + 2) for i in range(200)] + [(1000 * hour, 1000 * hour, 1, 401)]
    assert [r[5] for r in got[:5]] == ["", "2", "2,2", "2,2,2", "2,2,2"] and not handle.timers
    assert handle.calls < 30


def test_what_is_remembered_expires(spark, tmp_path):
    path = str(tmp_path / "in")

    def run(ttl, name):
        out = events.result(sessions.fresh(stream(spark, path), ttl), "append", store="rocksdb", checkpoint=str(tmp_path / name), once=True)
        return sorted(map(tuple, out.collect()))

    put(spark, path, [(1, 1, "a", 0), (2, 1, "a", 1), (3, 1, "b", 2), (4, 2, "a", 3)])
    assert run("1 day", "long") == run("1 ms", "short") == [(1, "a"), (1, "b"), (2, "a")]
    time.sleep(0.1)
    put(spark, path, [(5, 1, "a", 5), (6, 1, "c", 6)])
    assert run("1 day", "long") == [(1, "c")]
    assert run("1 ms", "short") == [(1, "a"), (1, "c")]


def test_no_rows(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(1, 1, "a", 0)])
    none = stream(spark, str(tmp_path / "in")).where(F.lit(False))
    assert events.result(sessions.sessions(none), "append", store="rocksdb").count() == 0
