"""Streams over the event files: reading, keyed state, late rows, and running a stream to its end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graniteql.session import table
from graniteql.shared import fresh_path


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream. Its time is without zone, which watermarks don't take; the session's zone is UTC."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A stream reads a folder; a table that is one file is linked as a glob that only it matches."""
    return f"{sf_dir}/events.parque[t]"


def result(rows: DataFrame, mode: str, keep: str | None = None, store: str | None = None, checkpoint: str | None = None, once: bool = False) -> DataFrame:
    """Runs a stream until all input is read, and returns what it wrote to the shared folder. keep: of rows with the same first column the
    one with the largest value of this column counts (update mode). checkpoint: of a stream that goes on where it was left; the
    result has what was written since. once: one batch, for state timed by processing, for which there would always be another."""
    spark = rows.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if store == "rocksdb":
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        path, batches = fresh_path(spark, "sink"), []

        def put(df: DataFrame, i: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/batch={i}")  # a repeated batch overwrites its folder, so that its rows come once
            batches.append(i)

        run = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint or fresh_path(spark, "stream")).trigger(**({"once": True} if once else {"availableNow": True})).start()
        run.awaitTermination()
    finally:
        if store:
            spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    if not batches:
        return spark.createDataFrame([], rows.schema)
    # in complete mode a batch has the whole result
    out = spark.read.schema(rows.schema).parquet(f"{path}/batch={max(batches)}" if mode == "complete" else path).select(*rows.columns)
    if keep:
        key, *rest = rows.columns
        out = out.groupBy(key).agg(F.max_by(F.struct(*rest), keep).alias("r")).select(key, "r.*")
    return out


def running(rows: DataFrame) -> DataFrame:
    """user_id, n, top after each batch, from state kept in pandas functions."""

    def step(key, frames, state):
        n, top = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, top = n + len(f), max(top, float(f["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, top double", "n long, top double", "update", "NoTimeout")


class _Counter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        n += sum(len(f) for f in rows)
        self.count.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def counted(rows: DataFrame) -> DataFrame:
    """user_id, n by a stateful processor; needs the RocksDB state store."""
    return rows.groupBy("user_id").transformWithStateInPandas(_Counter(), "user_id long, n long", "Update", "None")


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream of two batches: the later half of the events, then the earlier half. Once the
    watermark has passed the earlier half's windows, its rows are dropped."""
    rows = table(spark, sf_dir, "events")
    least, most = rows.agg(F.min("event_id"), F.max("event_id")).first()
    middle = ((least or 0) + (most or 0)) // 2
    path = fresh_path(spark, "late")
    rows.where(F.col("event_id") > middle).write.parquet(path)
    counts = spark.readStream.schema(rows.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    out, checkpoint = fresh_path(spark, "sink"), fresh_path(spark, "stream")
    counts = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
    for part in (None, rows.where(F.col("event_id") <= middle)):
        if part is not None:
            part.write.mode("append").parquet(path)
        counts.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp_ntz, n long").parquet(out).select("start", "n")
