"""ST4: of recomputations that are asked for one after another only the last one counts.

A new request cancels the running jobs of those before it, by their tag, and a request commits its
result only if none came after it. So a superseded request stops soon, and never replaces what a
later one wrote, whichever ends first.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pennant.sources.commits import Commits


class Latest:
    """A table at path that recomputations replace as a whole, the latest request winning. For one driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path, Commits(spark, f"{path}/commits")
        self._lock, self._asked, self._name = threading.Lock(), 0, uuid.uuid4().hex

    def _tag(self, number: int) -> str:
        return f"latest-{self._name}-{number}"

    def run(self, make: Callable[[], DataFrame]) -> bool:
        """Computes and stores make(); False if a later request came in between. Other failures are raised."""
        context = self.spark.sparkContext
        with self._lock:
            self._asked += 1
            mine = self._asked
            for n in range(max(1, mine - 8), mine):  # those that may still run
                context.cancelJobsWithTag(self._tag(n))
        version = f"versions/{uuid.uuid4().hex}"
        context.addJobTag(self._tag(mine))
        try:
            make().write.parquet(f"{self.path}/{version}")
        except Exception:
            if mine != self._asked:
                self.commits.remove(version)
                return False
            raise
        finally:
            context.removeJobTag(self._tag(mine))
        with self._lock:
            if mine != self._asked:
                self.commits.remove(version)
                return False
            before = self.commits.current()
            self.commits.commit({"version": version, "before": before[1]["version"] if before else None})
            if before and before[1]["before"]:
                self.commits.remove(before[1]["before"])
        return True

    def read(self, schema: str | StructType) -> DataFrame:
        """The table as of the last commit; empty before the first."""
        latest = self.commits.current()
        if latest is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{latest[1]['version']}")
