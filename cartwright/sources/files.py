"""Small files in shared storage, by whatever file system the path names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What the file holds; None if there is none."""
    at, system = located(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def replace_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write the file beside its place and rename it there: readers see the old one or the new one."""
    place, system = located(spark, path)
    draft, _ = located(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    uri = place.toUri() if place.isAbsolute() and place.toUri().getScheme() else system.makeQualified(place).toUri()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        uri, spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(system.makeQualified(draft), system.makeQualified(place), options)


def delete(spark: SparkSession, path: str) -> None:
    at, system = located(spark, path)
    system.delete(at, True)
