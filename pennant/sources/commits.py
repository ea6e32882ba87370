"""Commits: small documents of which the latest counts, each there as a whole or not at all.

A commit is written to a file that nobody reads and then renamed to the next number, which stores
do in one step and refuse if the number is taken. So whoever fails before the rename has changed
nothing, of two that commit at once one fails, and readers see the former commit or the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Commits that stay: the latest, and the one that readers may still hold.
KEPT = 2


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self.store = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.root, name)

    def _numbers(self) -> list[int]:
        if not self.store.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.store.listStatus(self.root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> tuple[int, dict] | None:
        """Number and document of the latest commit."""
        numbers = self._numbers()
        if not numbers:
            return None
        stream = self.store.open(self._file(f"{numbers[-1]:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def commit(self, document: dict, after: int | None = None) -> int:
        """Makes the document the latest, as the one after commit number after (the latest as it is now)."""
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) + 1 if after is None else after + 1
        self.store.mkdirs(self.root)
        hidden, name = self._file(f".{uuid.uuid4().hex}"), self._file(f"{number:012d}.json")
        out = self.store.create(hidden, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        if self.store.exists(name) or not self.store.rename(hidden, name):
            self.store.delete(hidden, False)
            raise RuntimeError(f"commit {number} of {self.path} is there already")
        for n in self._numbers()[:-KEPT]:
            self.store.delete(self._file(f"{n:012d}.json"), False)
        return number

    def remove(self, *names: str) -> None:
        """Deletes folders beside the commits' folder that no commit names any more."""
        for n in names:
            self.store.delete(self._jvm.org.apache.hadoop.fs.Path(self.root.getParent(), n), True)

    def beside(self, folder: str) -> list[str]:
        """Names below a folder beside the commits' folder."""
        at = self._jvm.org.apache.hadoop.fs.Path(self.root.getParent(), folder)
        return sorted(s.getPath().getName() for s in self.store.listStatus(at)) if self.store.exists(at) else []
