"""Session and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: What the engine relies on, whatever the cluster's defaults are.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names take `__` for the dots of a setting."""
    builder = SparkSession.builder.master(master).appName("graniteql")
    for k, v in (CONF | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Makes temporary views of the tables, for SQL text."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def text_batches(spark: SparkSession, most: str = "512k") -> None:
    """Bounds the bytes of the batches that go to Python, unless someone has set that. Spark counts rows alone, and 10,000
    whole texts may be any size; a worker's memory then follows the files, not the batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, most)
