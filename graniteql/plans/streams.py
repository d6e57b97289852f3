"""Event-time queries, run as streams over the event files to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteql.plans.registry import Registry
from graniteql.session import table
from graniteql.streaming import events, sessions

query = Registry()


@query("st2_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY 1, 2")
def st2(spark: SparkSession, d: str) -> DataFrame:
    w = events.stream(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return events.result(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "complete")


@query("st1_watermark", "SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st1(spark: SparkSession, d: str) -> DataFrame:
    """Append mode: only windows that the watermark has closed."""
    w = events.stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return events.result(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "append")


@query("st3_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def st3(spark: SparkSession, d: str) -> DataFrame:
    w = events.stream(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return events.result(w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query(
    "st4_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def st4(spark: SparkSession, d: str) -> DataFrame:
    w = events.stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return events.result(w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "append")


@query("st5_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st5(spark: SparkSession, d: str) -> DataFrame:
    w = events.stream(spark, d).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return events.result(w.select("user_id", "event_type"), "append")


@query("st6_stream_join", "SELECT p.event_id AS purchase, v.event_id AS viewed FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts WHERE p.event_type = 'purchase' AND v.event_type = 'view'")
def st6(spark: SparkSession, d: str) -> DataFrame:
    p = events.stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("pu"), F.col("ts").alias("pt")).withWatermark("pt", "1 hour")
    v = events.stream(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("viewed"), F.col("user_id").alias("vu"), F.col("ts").alias("vt")).withWatermark("vt", "1 hour")
    both = p.join(v, F.expr("pu = vu AND vt BETWEEN pt - INTERVAL 1 HOUR AND pt"))
    return events.result(both.select("purchase", "viewed"), "append")


@query(
    "st6_outer_join",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
       settled AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM v)) - INTERVAL 1 HOUR AS fixed_before),
       pairs AS (SELECT p.event_id AS purchase, p.ts, v.event_id AS viewed FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts)
       SELECT purchase, viewed FROM pairs, settled WHERE viewed IS NOT NULL OR ts < fixed_before""",
)
def st6o(spark: SparkSession, d: str) -> DataFrame:
    """A purchase without a view in the hour before comes out once no such view can come any more: both watermarks have passed
    it, and its state goes."""
    p = events.stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("pu"), F.col("ts").alias("pt")).withWatermark("pt", "1 hour")
    v = events.stream(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("viewed"), F.col("user_id").alias("vu"), F.col("ts").alias("vt")).withWatermark("vt", "1 hour")
    both = p.join(v, F.expr("pu = vu AND vt BETWEEN pt - INTERVAL 1 HOUR AND pt"), "left_outer")
    return events.result(both.select("purchase", "viewed"), "append")


@query("st7_state", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def st7(spark: SparkSession, d: str) -> DataFrame:
    """State of our own for each user: number and largest value so far; the last row of each user counts."""
    return events.result(events.running(events.stream(spark, d)), "update", keep="n")


@query("st8_processor", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def st8(spark: SparkSession, d: str) -> DataFrame:
    return events.result(events.counted(events.stream(spark, d)), "update", keep="n", store="rocksdb")


@query(
    "st8_timers",
    """WITH x AS (SELECT max(ts) AS top, (min(event_id) + max(event_id)) // 2 AS middle FROM events),
       e AS (SELECT events.* FROM events, x WHERE event_id > middle),
       f AS (SELECT user_id, count(*) AS total FROM events, x WHERE event_id <= middle GROUP BY user_id),
       g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e)),
       h AS (SELECT user_id, min(ts) AS start, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, s),
       i AS (SELECT h.*, CAST(coalesce(f.total, 0) + sum(n) OVER w AS BIGINT) AS total, coalesce(array_to_string(list(n) OVER (PARTITION BY h.user_id ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM h LEFT JOIN f ON h.user_id = f.user_id WINDOW w AS (PARTITION BY h.user_id ORDER BY start))
       SELECT i.* FROM i, x WHERE ended + INTERVAL 30 MINUTE < top - INTERVAL 1 HOUR""",
)
def st8t(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that a timer closes, over the later half of the events; the earlier half is the state to start from."""
    rows = table(spark, d, "events")
    least, most = rows.agg(F.min("event_id"), F.max("event_id")).first()
    middle = ((least or 0) + (most or 0)) // 2
    totals = rows.where(F.col("event_id") <= middle).groupBy("user_id").agg(F.count("*").alias("total"))
    return events.result(sessions.sessions(events.stream(spark, d).where(F.col("event_id") > middle), totals=totals), "append", store="rocksdb")


@query("st8_expiry", "SELECT DISTINCT user_id, event_type FROM events")
def st8e(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of event of a user once; what is remembered expires after a day of processing."""
    return events.result(sessions.fresh(events.stream(spark, d)), "append", store="rocksdb", once=True)


@query(
    "st9_late_data",
    """WITH x AS (SELECT max(ts) AS top, (min(event_id) + max(event_id)) // 2 AS middle FROM events)
       SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events, x WHERE event_id > middle GROUP BY 1, top HAVING start + INTERVAL 1 HOUR <= top - INTERVAL 1 HOUR""",
)
def st9(spark: SparkSession, d: str) -> DataFrame:
    """Files in two batches, the second with rows older than the watermark: those are dropped from their windows."""
    return events.late(spark, d)
