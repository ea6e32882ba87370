"""Written intermediate tables: they cut the lineage of relations that many queries share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_shared: dict[tuple, DataFrame] = {}


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _forget(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended, and its folders with it
        where, files = _file_system(spark, path)
        files.delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; it goes when the driver's Python ends in order.

    Where the setting is unset, local sessions get a temporary folder; on a cluster that is an
    error, since executors would each write to their own disk.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if app not in _roots:
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        _roots[app] = f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/league-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return f"{_roots[app]}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def derived(spark: SparkSession, sources: list[str], name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written once in an application for the state that the source tables are in, and read from then on."""
    state = []
    for s in sources:
        where, files = _file_system(spark, s)
        state.append((s, files.getFileStatus(where).getModificationTime(), files.getContentSummary(where).getLength()))
    key = (spark.sparkContext.applicationId, name, *state)
    if key not in _shared:
        _shared[key] = written(make())
    return _shared[key]


def forget() -> None:
    """Lets the next queries derive their tables anew."""
    _shared.clear()
