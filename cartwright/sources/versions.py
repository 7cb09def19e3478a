"""Tables that are replaced without a gap: a folder per version, and a pointer to the one that counts.

A new version is written beside the old ones, and the pointer is renamed into place only when it
is complete. Readers keep the version they began with, a write that fails leaves the old one, and there is no
moment without a table. The versions before the newest ``keep`` are deleted; unfinished ones go with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartwright.sources import files

POINTER = "current.json"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)

    def _pointer(self) -> dict:
        return files.read_json(self.spark, f"{self.path}/{POINTER}") or {"versions": []}

    def versions(self) -> list[str]:
        """Names of the complete versions that are kept, the newest first."""
        return self._pointer()["versions"]

    def read(self) -> DataFrame | None:
        """The newest complete version; None if there is none yet."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{found[0]}") if found else None

    def replace(self, df: DataFrame) -> DataFrame:
        """Write a version and make it the one that counts. ``df`` may read the old one."""
        name = f"v{len(self.versions()):04d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        known = [name, *self.versions()][: self.keep]
        files.replace_json(self.spark, f"{self.path}/{POINTER}", {"versions": known})
        self._tidy(known)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _tidy(self, known: list[str]) -> None:
        at, system = files.located(self.spark, self.path)
        for status in system.listStatus(at):
            name = status.getPath().getName()
            if status.isDirectory() and name not in known:
                system.delete(status.getPath(), True)

    def read_or_build(self, build) -> DataFrame:
        held = self.read()
        return self.replace(build()) if held is None else held

    def publish(self, name: str) -> None:
        """(Re-)point an external table of the catalogue at the newest version: one change of
        metadata, after which queries by that name read it."""
        location = f"{self.path}/{self.versions()[0]}"
        if self.spark.catalog.tableExists(name):
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        else:
            self.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{location}'")
        self.spark.catalog.refreshTable(name)
