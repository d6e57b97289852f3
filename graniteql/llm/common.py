"""What the training-data operators share: batches of texts, samples, sending the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteql.shared import forget, fresh_path, shared_dir, written  # noqa: F401  for the operators

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, for clusters on which it is not installed. Also makes
    the batches that go to Python smaller than Spark's default, as rows here hold whole texts, unless someone has set
    their size."""
    sc = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(batch):
        spark.conf.set(batch, "1000")
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = tempfile.mkdtemp(prefix="graniteql-package-")  # executors fetch it from the driver, at any time
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    stage = os.path.join(at, "stage")
    shutil.copytree(top, os.path.join(stage, os.path.basename(top)), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(os.path.join(at, "graniteql_shipped"), "zip", stage))
    _shipped.add(sc.applicationId)


def some(df: DataFrame, key: str, k: int) -> DataFrame:
    """The first k rows by a hash of a column, all if there are no more; the same in each run. Of a large table only
    rows whose hash is small are sorted, twice k of them by expectation, so that each task sends the driver a few; more
    if that are too few, as can be where rows share a key."""
    place, n = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40)), df.count()
    most = 2 * k
    while most < n / 2:
        few = df.where(place < int((1 << 40) * most / n))
        if few.limit(k).count() == k:
            return few.orderBy(place, key).limit(k)
        most *= 4
    return df.orderBy(place, key).limit(k)


def about_chars(docs: DataFrame) -> int:
    """About how many characters the column text has, for the number of parts. Of files Spark knows the compressed size,
    taken twice; other tables are measured."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() == "Project":
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        return 2 * int(str(plan.stats().sizeInBytes()))
    return docs.agg(F.sum(F.length("text"))).first()[0] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plainly(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """docs with plain names for all columns but these, so that no name of theirs meets one that an operator uses inside; and
    the names that toDF gives back."""
    return docs.toDF(*(c if c in own else f"c{i}" for i, c in enumerate(docs.columns))), docs.columns


def groups(texts: pa.Array, chars: int = 1 << 21) -> Iterator[list[str]]:
    """Lists of texts of about so many characters; null is empty."""
    part, n = [], 0
    for x in texts:
        part.append(x.as_py() or "")
        n += len(part[-1])
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part
