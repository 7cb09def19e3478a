"""Results that later calls use again while their inputs stay as they are, for a limited time.

An entry is a folder in the shared storage: the result as a table, and a manifest that is written
last. Its name is a hash of the caller's name, the plan of the source and the name, size and
time of every file the source reads, so changed inputs or a changed plan make another entry and
never meet an old result. The manifest says until when the entry holds; expired entries are deleted
when their name is asked for again or :func:`sweep` is called, and :func:`release` deletes all.

An entry without a manifest is unfinished and is not used. Two sessions that build the same entry
write to folders of their own; the manifest names the folder, and the later one stands.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwright.session import shared_folder
from cartwright.sources import files

LIFETIME = 300  # fixed value: seconds that a result is reused by default
MANIFEST = "manifest.json"


class Store:
    """The reused results of a session's shared folder. ``now`` is the clock, in seconds."""

    def __init__(self, spark: SparkSession, folder: str | None = None, now: Callable[[], float] = time.time):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/reused"
        self.now = now

    def _inputs(self, source: DataFrame) -> list[tuple[str, int, int]]:
        """Name, size and time of every file the source reads; folders are listed once each."""
        names = set(source.inputFiles())
        folders = {name.rsplit("/", 1)[0] for name in names}
        found = {}
        for folder in sorted(folders):
            path, system = files.located(self.spark, folder)
            for status in system.listStatus(path):
                found[status.getPath().getName(), folder] = (status.getLen(), status.getModificationTime())
        out = []
        for name in sorted(names):
            folder, last = name.rsplit("/", 1)
            plain = files.located(self.spark, name)[0].getName()
            out.append((name, *found.get((plain, folder), found.get((last, folder), (-1, -1)))))
        return out

    def name_of(self, label: str, source: DataFrame) -> str:
        """The entry of a result made from ``source``."""
        parts = json.dumps([label, source.semanticHash(), self._inputs(source)])
        return f"{label}-{hashlib.sha256(parts.encode()).hexdigest()[:32]}"

    def _manifest(self, entry: str) -> dict | None:
        return files.read_json(self.spark, f"{self.folder}/{entry}/{MANIFEST}")

    def _delete(self, path: str) -> None:
        files.delete(self.spark, path)

    def get(
        self, label: str, source: DataFrame, build: Callable[[], DataFrame], lifetime: float = LIFETIME
    ) -> DataFrame:
        """The stored result of ``build`` for this source; built now if there is none that holds."""
        entry = self.name_of(label, source)
        manifest = self._manifest(entry)
        if manifest is None or manifest["until"] <= self.now():
            if manifest is not None:
                self._delete(f"{self.folder}/{entry}")
            made = build()
            part = uuid.uuid4().hex
            made.write.parquet(f"{self.folder}/{entry}/{part}")
            manifest = {"part": part, "until": self.now() + lifetime, "schema": made.schema.json()}
            files.replace_json(self.spark, f"{self.folder}/{entry}/{MANIFEST}", manifest)
        return self.spark.read.parquet(f"{self.folder}/{entry}/{manifest['part']}")

    def entries(self) -> dict[str, float]:
        """Finished entries, and until when they hold."""
        path, system = files.located(self.spark, self.folder)
        if not system.exists(path):
            return {}
        names = [s.getPath().getName() for s in system.listStatus(path)]
        found = {name: self._manifest(name) for name in names}
        return {name: m["until"] for name, m in found.items() if m}

    def sweep(self) -> list[str]:
        """Delete expired entries; their names."""
        gone = [name for name, until in self.entries().items() if until <= self.now()]
        for name in gone:
            self._delete(f"{self.folder}/{name}")
        return sorted(gone)

    def release(self) -> None:
        """Delete all entries; frames that read them are void."""
        self._delete(self.folder)
