"""File formats by one pair of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_WRITE = {"csv": {"header": "true"}, "xml": {"rowTag": "row"}}
_READ = {"csv": {"header": "true"}, "xml": {"rowTag": "row"}}
#: Formats that need a module which a plain Spark lacks.
EXTERNAL = {"avro": "org.apache.spark:spark-avro"}


def available(spark: SparkSession, kind: str) -> bool:
    """Whether this session has a data source of that name."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(kind, spark._jsparkSession.sessionState().conf())
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find" in str(e) or "not found" in str(e).lower():
            return False
        raise
    return True


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", **options: str) -> None:
    df.write.format(kind).options(**_WRITE.get(kind, {}) | options).mode(mode).save(path)


def read(spark: SparkSession, kind: str, path: str, schema: StructType | None = None, **options: str) -> DataFrame:
    """Reads files; with a schema no pass over the data is made to infer one."""
    reader = spark.read.format(kind).options(**_READ.get(kind, {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)
