"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# shuffle files of a write go with it; otherwise they stay until the driver collects garbage
_SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def local_session(
    cores: int | str = "*", memory: str = "8g", app: str = "cartwright", **settings: str
) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own.

    Further ``settings`` are given with ``_`` for ``.`` (``spark_sql_ansi_enabled="true"``).
    """
    n = "8" if cores == "*" else str(cores)
    builder = SparkSession.builder
    for name, value in settings.items():
        builder = builder.config(name.replace("_", "."), value)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder lineage cuts are written to: the one the cluster names.

    Only a local session without that setting gets a temporary folder; on a cluster a
    machine-local folder would vanish with its executor, so a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cartwright-"))
    return context.getCheckpointDir()


def _app_folder(spark: SparkSession) -> str:
    """Where this application keeps its copies; deleted when its JVM ends, if not before."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/{app}"
    if app not in _announced:
        _announced.add(app)
        path, system = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


def _path(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_announced: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete every copy this application has written; frames that read them are void."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    path, system = _path(spark, folder)
    system.delete(path, True)
    _announced.discard(spark.sparkContext.applicationId)


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where a result feeds several passes. Unlike a row checkpoint the copy is columnar, so
    later passes read only their columns and the planner knows its true size.
    """
    spark = df.sparkSession
    path = f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with with_settings(spark, _SHORT_SHUFFLES):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
