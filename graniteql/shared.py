"""Folders that the driver and all executors see, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: `spark.checkpoint.dir`. Only where that is unset and driver and
    executors are one process, as in local tests, a folder of this process is made and removed when it ends."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="graniteql-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has, in a folder of this application; the folder goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/graniteql-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders[app])
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back. A lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _no_shuffle_files_left(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _no_shuffle_files_left(spark: SparkSession):
    """While this lasts, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame, least: int = 64 << 20) -> DataFrame:
    """A small table, of fewer bytes than `least`, dealt over all cores: a file of one row group is read by one task, and work
    that costs much more than reading would stay there. Larger tables come as they are."""
    spark = df.sparkSession
    few = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if int(str(few)) < least else df


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/graniteql-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
