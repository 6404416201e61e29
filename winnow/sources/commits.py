"""Numbered commits of a stored table: data first, then one file that makes it visible.

A writer claims a number, writes under it and commits it. Both are a file that can be created once only, so two
writers never share a number, and readers, who look at committed numbers alone, see all of a write or nothing of it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.place).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        folder = self._paths(f"{self.place}/_{kind}")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder))

    def _create(self, kind: str, number: int) -> bool:
        path = self._paths(f"{self.place}/_{kind}/{number}")
        try:
            self._files.create(path, False).close()
        except Exception:
            # The same error whichever file system says so: the file is there, another writer was first.
            if self._files.exists(path):
                return False
            raise
        return True

    def claim(self) -> int:
        """A number that no other writer has or will get."""
        number = max(self._numbers("claims"), default=-1) + 1
        while not self._create("claims", number):
            number += 1
        return number

    def commit(self, number: int) -> None:
        if not self._create("commits", number):
            raise ValueError(f"version {number} is committed already")

    def committed(self) -> list[int]:
        return self._numbers("commits")

    def latest(self) -> int | None:
        return max(self.committed(), default=None)

    def remove(self, number: int, *folders: str) -> None:
        """Take back what an unfinished write has left; committed data is never touched."""
        if number in self.committed():
            raise ValueError(f"version {number} is committed")
        for folder in folders:
            self._files.delete(self._paths(folder), True)
