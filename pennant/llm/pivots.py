"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the ordered list of its nearest pivots (reference vectors, spread over a
bounded sample so that none is close to another before all regions have one). Inverted lists are
kept for sets of pivots: a vector stands in the list of each three, two or one of the first pivots of
its order of which at least one is in the first half. Two vectors that share enough pivots meet in a
list, and there they are linked if their cosine in double precision reaches the threshold.

How many pivots there are, how many of the order are used, and how many have to be shared, is fitted
and always measured: on the sample's own links, where it has some, and on copies of sample vectors
moved away by exactly the threshold, half of them in any direction and half towards another vector
of the sample. Such pairs exist for any table, and are the hardest to find. Of the settings that
retrieve RECALL of the links and HARDEST of the copies the one with the fewest comparisons in the
whole table is taken. Pivots grow with the square root of the table as far as the sample has them;
from there on more of them have to be shared, so that lists stay short. The last resort, a single
list, compares everything. Equal vectors are one node before the index is built. Lists of any size
are cut into blocks, each pair of blocks a group of its own, a pair is linked only in the smallest
list that both share, and a group returns counts and a star of edges, never its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
do vectors of different lengths. Rows that repeat a vec_id with another vector are other vectors;
repeated rows are copies. A component is named by its smallest vec_id, by null if it has none.
Columns other than vec_id and embedding are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, arrow_batches, connected_components, in_blocks, local_components, starts, whole_groups, written

THRESHOLD = 0.9
#: Bounds of the sample that the index is fitted on, in vectors and in bytes of doubles.
SAMPLE_ROWS, SAMPLE_BYTES = 16384, 64 << 20
#: Pivots grow with the square root of the number of vectors, up to this many; then more of them have to be shared.
MOST_PIVOTS = 4096
#: What is tried: shares of the pivots, pivots of the order that are used, and pivots that have to be shared.
SHARES, FIRST, SHARED = (1, 4, 16), (4, 6, 8, 12, 16), (3, 2, 1)
#: A setting brings a vector to at most so many lists.
MOST_LISTS = 128
#: The setting of a single pivot, which compares everything.
EVERYTHING = (1, 1)
#: The share of the sample's links, and of copies at the threshold, that a setting has to retrieve.
RECALL, HARDEST = 0.98, 0.95
#: The links from which on they are measured, and the links and copies that are looked at.
FEW, MOST_LINKS = 100, 3000
#: Comparisons that cost as much as bringing a vector to one more list.
LIST_COST = 50
BLOCK = 512


def usable(v: Column) -> Column:
    """True for vectors that have a direction."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """The unit vector in double precision; scaled first so that squares can't over- or underflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def stacked(units: list[np.ndarray]) -> np.ndarray:
    """The vectors as rows, padded with zeros."""
    if len({len(u) for u in units}) == 1:
        return np.array(units)
    out = np.zeros((len(units), max(map(len, units))))
    for row, u in zip(out, units, strict=True):
        row[: len(u)] = u
    return out


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Numbers of at most that many sample rows, each the farthest from those before; equal directions once."""
    nearest, out = sample @ sample[0], [0]
    while len(out) < most:
        i = int(nearest.argmin())
        if nearest[i] > 1 - 1e-9:
            break
        out.append(i)
        np.maximum(nearest, sample @ sample[i], out=nearest)
    return np.array(out)


def orders(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each row, nearest first."""
    m = min(m, len(pivots))
    width = min(x.shape[1], pivots.shape[1])
    out = np.empty((len(x), m), np.int64)
    for at in range(0, len(x), 1024):
        near = -(x[at : at + 1024, :width] @ pivots[:, :width].T)
        top = np.argpartition(near, m - 1, axis=1)[:, :m]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def sets_of(m: int, shared: int) -> list[tuple[int, ...]]:
    """Which places of an order make a list: at least one in the first half."""
    return [c for c in combinations(range(m), min(shared, m)) if c[0] < max(1, (m + 1) // 2)]


def list_keys(order: np.ndarray, shared: int) -> np.ndarray:
    """The lists that each row stands in: sets of shared pivots of its order."""
    picked = np.sort(order[:, sets_of(order.shape[1], shared)], axis=2).astype(np.int64)
    key = picked[:, :, 0]
    for i in range(1, picked.shape[2]):
        key = key * (MOST_PIVOTS + 1) + picked[:, :, i] + 1
    return np.sort(key, axis=1)


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of a and b, keys of lists, share one."""
    out, step = np.zeros(len(a), bool), max(1, (1 << 23) // (a.shape[1] * b.shape[1]))
    for at in range(0, len(a), step):
        out[at : at + step] = (a[at : at + step, :, None] == b[at : at + step, None, :]).any((1, 2))
    return out


def moved(x: np.ndarray, towards: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of exactly the threshold's cosine: rows of x, and rows turned from them towards others; where that is possible."""
    side = towards - (x * towards).sum(1, keepdims=True) * x
    size = np.linalg.norm(side, axis=1)
    some = size > 1e-6
    x, side = x[some], side[some] / size[some, None]
    return x, threshold * x + (1 - threshold**2) ** 0.5 * side


def fit(rows: list, n: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, tuple[int, int]]:
    """Pivots and setting for n vectors, from a sample of them."""
    r = np.random.default_rng(5)
    x = stacked([unit(v) for v in rows])
    chosen = spread(x, int(min(MOST_PIVOTS, max(32, 8 * n**0.5))))
    pivots = x[chosen]
    rest = np.delete(x, chosen, axis=0)
    rest = rest if len(rest) > len(x) // 4 else x
    a, b = [], []
    for at in range(0, len(rest), 128):
        i, j = np.nonzero(rest[at : at + 128] @ rest.T >= threshold)
        a.append(i[j > i + at] + at)
        b.append(j[j > i + at])
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = []
    if len(a) >= FEW:
        pick = r.permutation(len(a))[:MOST_LINKS]
        pairs.append((RECALL, rest[a[pick]], rest[b[pick]]))
    some = rest[r.permutation(len(rest))[:MOST_LINKS]]
    used = np.abs(some).sum(0) > 0
    for towards in (r.normal(size=some.shape) * used, rest[r.integers(0, len(rest), len(some))]):
        copies = moved(some, towards, threshold)
        if len(copies[0]):
            pairs.append((HARDEST, *copies))
    best = (n * n / 2, pivots[:1], EVERYTHING)
    for share in SHARES:
        near = pivots[: max(1, len(pivots) // share)]
        full = orders(rest, near, max(FIRST))
        ends = [(least, orders(u, near, max(FIRST)), orders(v, near, max(FIRST))) for least, u, v in pairs]
        for m, shared in ((m, s) for m in FIRST for s in SHARED if s < m <= len(near) and len(sets_of(m, s)) <= MOST_LISTS):
            if n * len(sets_of(m, shared)) * LIST_COST >= best[0] or any(met(list_keys(u[:, :m], shared), list_keys(v[:, :m], shared)).mean() < least for least, u, v in ends):
                continue
            keys = list_keys(full[:, :m], shared)
            count = np.unique(keys, return_counts=True)[1].astype(float)
            cost = n * keys.shape[1] * LIST_COST + (count * (count - 1)).sum() / 2 * (n / len(rest)) ** 2
            if cost < best[0]:
                best = (cost, near, (m, shared))
    return best[1:]


def _described(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, (m, shared) = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("embedding")
            flat, at = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            raw = [flat[i:j] for i, j in zip(at, at[1:], strict=False)]
            keys = list_keys(orders(stacked([unit(r) for r in raw]), pivots, m), shared)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "copies", "raw", "keys"])

    return run


def _earlier(ok: np.ndarray, keys: np.ndarray, key: int) -> None:
    """Clears pairs that stand together in a smaller list too: they are linked there."""
    a, b = np.nonzero(ok)
    step = max(64, (1 << 24) // keys.shape[1] ** 2)
    for at in range(0, len(a), step):
        i, j = a[at : at + step], b[at : at + step]
        both = (keys[i][:, :, None] == keys[j][:, None, :]).any(2)
        gone = (both & (keys[i] < key)).any(1)
        ok[i[gone], j[gone]] = False


def _linked(threshold: float, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "lo", "hi"]):
            bounds = [*np.flatnonzero(starts(table, ["key", "lo", "hi"])), table.num_rows]
            node, copies, block, key = (table[c].to_numpy() for c in ("node", "copies", "block", "key"))
            inner = table["lo"].to_numpy() == table["hi"].to_numpy()
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            units = [unit(np.frombuffer(r, kind)) for r in table["raw"].to_pylist()]
            out: list[list[np.ndarray]] = [[], [], []]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s < 2:
                    continue
                size = np.array([len(u) for u in units[s:e]])
                x = stacked(units[s:e])
                ok = (x @ x.T >= threshold) & (size[:, None] == size[None, :])
                if inner[s]:
                    np.fill_diagonal(ok, False)
                else:
                    ok &= block[s:e, None] != block[None, s:e]
                _earlier(ok, keys[s:e], key[s])
                weight = ok @ copies[s:e]
                label = local_components(e - s, *np.nonzero(np.triu(ok)))
                at = np.flatnonzero(weight)
                for o, v in zip(out, (node[s:e][at], weight[at], node[s:e][label[at]]), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["node", "n_links", "star"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept (vec_id = component_id): one row for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    with Scratch(spark) as tmp:
        good = rows.where(usable(F.col("embedding"))).groupBy(F.xxhash64("embedding").alias("h"), "embedding")
        good = good.agg(F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id")).alias("first"), F.count("*").alias("copies"))
        good = tmp.table(good.select(F.monotonically_increasing_id().alias("node"), "h", "embedding", "first", "copies"))
        n, width = good.agg(F.count("*"), F.max(F.size("embedding"))).first()
        if not n:
            return written(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
        # a bounded sample: those with the lowest hashes
        sample = good.select("embedding").orderBy(F.xxhash64("h"), "h").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))).toPandas()["embedding"]
        fitted = spark.sparkContext.broadcast(fit(list(sample), n, threshold))
        index = tmp.table(good.select("node", "copies", "embedding").mapInArrow(_described(fitted), "node long, copies long, raw binary, keys array<long>"))
        lists = index.select("node", F.explode("keys").alias("key"))
        sizes = tmp.table(lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")))
        members = lists.join(sizes, "key").join(index, "node")
        found = tmp.table(in_blocks(members, "key", "node", "blocks").mapInArrow(_linked(threshold, np.float32 if kind == "float" else np.float64), "node long, n_links long, star long"))
        parts = connected_components(found.select(F.col("node").alias("a"), F.col("star").alias("b")))
        links = found.groupBy("node").agg(F.sum("n_links").alias("far"))
        own = good.select("node", "h", "embedding", "first", "copies").join(links, "node", "left").join(parts, "node", "left")
        own = tmp.table(own.select("h", F.col("embedding").alias("e"), "first", F.coalesce("component", "node").alias("component"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        best = tmp.table(own.groupBy("component").agg(F.min("first").alias("best")))
        own = own.join(best, "component").select("h", "e", "n_links", F.col("best.vec_id").alias("component_id"))
        out = rows.join(own, (F.xxhash64("embedding") == F.col("h")) & (F.col("embedding") == F.col("e")), "left")
        component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        return written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())))
