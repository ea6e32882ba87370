"""Shared helpers: written cut points, Arrow streams of whole groups, word shingles, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Shingles are this many consecutive words; a shorter text with words is one shingle.
SHINGLE = 5
#: Rows of a small table that a task writes at least, where their number is known.
FILE_ROWS = 100_000
#: Rows and bytes of one Arrow batch: texts can be very long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

_roots: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended, and its folders with it
        _delete(spark, path)


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
        _roots[app] = f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/pennant-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _roots[app])
    return f"{_roots[app]}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator's call; they go when the with block ends, or before by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, shared_dir(spark), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _forget(self.spark, self.path)

    def table(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, written; rows: about how many it has, so that few rows don't make many files."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        out = written(df, path)
        self.tables[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _forget(self.spark, self.tables.pop(id(t))[1])


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def replaced(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those that an operator's results of these names replace."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def arrow_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by rows and by bytes: the same for all operators, and never above the session's own bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def deal(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Hash-partitions df for a grouped pass over sorted runs of the columns.

    The number of partitions is fixed on purpose: the groups are bounded, and what they cost is
    pairs, not bytes, so merging small partitions would leave cores idle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def in_blocks(members: DataFrame, group: str, by: str, blocks: str) -> DataFrame:
    """members once for each pair of blocks they belong to: lo <= hi, and block, the row's own."""
    m = members.withColumn("block", F.pmod(F.xxhash64(by), F.col(blocks)).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    m = m.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", blocks)
    return deal(m, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4000, nbytes: int = 16 << 20) -> Iterator[pa.Table]:
    """Regroups a stream sorted by keys into tables that end where a group ends.

    A table holds at least rows rows or nbytes bytes (but for the last) plus the group that crosses the bound.
    """
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        if n < rows and size < nbytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        start = int(np.flatnonzero(starts(table, keys))[-1])
        if start:
            yield table.slice(0, start)
            table = table.slice(start)
        held = table.combine_chunks().to_batches()
        n, size = table.num_rows, table.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True for each row that begins a new run of equal keys (integer columns without nulls)."""
    first = np.zeros(table.num_rows, bool)
    first[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        first[1:] |= v[1:] != v[:-1]
    return first


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, by element."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of five words; empty without words."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out + h[i : i + n]) * _A[i]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b: the smallest node reachable from each."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for undirected edges a, b of longs; no row for isolated nodes.

    Alternates two star contractions: every node hands its larger, then its smaller
    neighbours to its smallest neighbour, until the edges form one star per component.
    Neither step makes more than twice its edges. The smallest neighbours are partial
    aggregates; they are written before they are joined to the edges, so that both sides of
    the join are plain shuffles and Spark splits the partition of a hub of any degree.
    """
    with Scratch(edges.sparkSession) as tmp:
        n = edges.count()
        e = tmp.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n)
        state = None
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = tmp.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), n)
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = tmp.table(large, n)
            tmp.drop(e, low)
            low = tmp.table(large.groupBy("u").agg(F.min("v").alias("m")), n)
            small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
            e = tmp.table(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct(), n)
            tmp.drop(large, low)
            row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(row) == state:
                break
            state = tuple(row)
        leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return written(leaves.unionByName(roots))
