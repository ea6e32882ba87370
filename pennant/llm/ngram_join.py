"""N-gram Jaccard join: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Exact copies (equal shingle sets) are one node, whatever their ids. MinHash bands bring nodes
together; within a band's bucket MinHash values are compared in rounds, and a pair is dropped as
soon as the posterior probability that its similarity reaches the threshold falls below a
tolerance (Beta prior, uniform). The pairs that survive, and only those, are verified on the full
shingle sets. Buckets of any size are cut into blocks, and each pair of blocks is a group of its
own, so no task ever holds more than two blocks. Every node also has a home: a block of the largest
bucket that it is in. A bucket's survivors leave it as bitmaps, one for each pair of homes, a
pair only from the first band that both nodes share; texts are sent to a pair of homes only for the
nodes that have a surviving pair there. So a text is copied at most once for each surviving pair and at
most once for each block of its neighbourhood, and what leaves a verified group is a count
per node and a star of edges, never its pairs.

Every row is a document. Texts that are null or have no words link with nothing; each is a class
of its own. Rows that repeat an id with another text are other documents, rows that repeat id and
text are copies of each other. Rows without a doc_id are documents like all others; they come
after those with one, so a class is named by a null only if none of its rows has an id. Ties go
to the smallest doc_id, then the text's hash. An empty table gives none; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, WordHashes, arrow_batches, connected_components, deal, in_blocks, local_components, mix, shingle_set, spare, starts, whole_groups, written

THRESHOLD = 0.8
#: A pair at the threshold meets in no band with probability (1 - 0.8 ** 4) ** 20 = 2.6e-5.
BANDS, BAND = 20, 4
N_HASHES = BANDS * BAND
#: MinHash values compared before each decision to drop, and the posterior that is too low.
ROUND, TOLERANCE = 16, 1e-5
#: Nodes in a block, and bytes of text in a block that is verified, on average.
BLOCK, BLOCK_BYTES = 256, 2 << 20

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 2**32, N_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, N_HASHES, dtype=np.uint64).astype(np.uint32)


def fewest_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of equal values among compared that keeps a pair.

    With a uniform prior the similarity is Beta(m + 1, compared - m + 1) after m matches, and
    the chance that it is at least t equals P(Binomial(compared + 1, t) <= m).
    """
    n, total = compared + 1, 0.0
    for m in range(compared + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def minhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """N_HASHES MinHash values of each set values[offsets[i]:offsets[i + 1]], none empty; 16 bits of each are kept."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets), N_HASHES), np.uint16)
    for k in range(N_HASHES):
        out[:, k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], offsets).astype(np.uint16)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature: equal where the band's values are."""
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::BAND])
    return h.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(t, hashes) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        keep = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
        digests: list[bytes | None] = [None] * len(sets)
        sigs: list[bytes | None] = [None] * len(sets)
        bands: list[np.ndarray | None] = [None] * len(sets)
        for at in range(0, len(keep), 64):
            part = [sets[i] for i in keep[at : at + 64]]
            sig = minhash(np.concatenate(part), np.cumsum([0] + [len(s) for s in part[:-1]]))
            keys = band_keys(sig)
            for j, i in enumerate(keep[at : at + 64]):
                digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                sigs[i], bands[i] = sig[j].tobytes(), keys[j]
        same = ["doc_id", "text_hash", "rid", "n_bytes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], [*same, "digest", "sig", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, rid (a number of the row), n_bytes and, for texts with words, digest of the shingle set, sig, bands."""
    arrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("rid"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(_signatures, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, rid long, n_bytes long, digest binary, sig binary, bands array<long>")


def _surviving(threshold: float):
    """Pairs of a bucket that the pruning leaves: a bitmap over nodes a and nodes b for each pair of homes."""
    least = [(n, fewest_matches(n, threshold)) for n in range(ROUND, N_HASHES + 1, ROUND)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "lo", "hi"]):
            run_id = np.cumsum(starts(table, ["key", "lo", "hi"]))
            node, home, block, band = (table[c].to_numpy() for c in ("node", "home", "block", "band"))
            inner = table["lo"].to_numpy() == table["hi"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, N_HASHES)
            found_a, found_b = [], []
            for d in range(1, int(np.bincount(run_id).max())):
                a = np.flatnonzero(run_id[:-d] == run_id[d:])
                a = a[inner[a] | (block[a] != block[a + d])]
                matches = np.zeros(len(a), np.int32)
                for n, fewest in least:
                    matches = matches + (sig[a, n - ROUND : n] == sig[a + d, n - ROUND : n]).sum(1, dtype=np.int32)
                    keep = matches >= fewest
                    a, matches = a[keep], matches[keep]
                shared = (sig[a] == sig[a + d]).reshape(-1, BANDS, BAND).all(2)
                a = a[shared.argmax(1) == band[a]]
                found_a.append(a)
                found_b.append(a + d)
            if not found_a:
                continue
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            swap = home[a] > home[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            order = np.lexsort((home[b], home[a]))
            a, b = a[order], b[order]
            if not len(a):
                continue
            cut = np.flatnonzero(np.r_[True, (home[a][1:] != home[a][:-1]) | (home[b][1:] != home[b][:-1])])
            rows_a, rows_b, bits = [], [], []
            for s, e in zip(cut, [*cut[1:], len(a)], strict=True):
                x, at_x = np.unique(node[a[s:e]], return_inverse=True)
                y, at_y = np.unique(node[b[s:e]], return_inverse=True)
                m = np.zeros((len(x), len(y)), bool)
                m[at_x, at_y] = True
                rows_a.append(x)
                rows_b.append(y)
                bits.append(np.packbits(m).tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(home[a[cut]]), pa.array(home[b[cut]]), pa.array(rows_a, longs), pa.array(rows_b, longs), pa.array(bits, pa.binary())], ["lo", "hi", "a", "b", "bits"])

    return run


def surviving_pairs(reps: DataFrame, tmp: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """lo, hi, a, b, bits: for each pair of homes the nodes a and b and the bitmap of the pairs that are left. reps: node, n_bytes, sig, bands."""
    each = reps.select("node", F.posexplode("bands").alias("band", "key"))
    shared = tmp.table(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = tmp.table(each.join(shared, "key"))
    labels = members.groupBy("node").agg(F.max(F.struct("n", "key")).alias("label")).select("node", "label.key").join(reps.select("node", "n_bytes", "sig"), "node")
    labels = tmp.table(labels.withColumnRenamed("key", "label"))
    sizes = labels.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_bytes") / BLOCK_BYTES)).alias("homes"))
    homes = labels.join(tmp.table(sizes), "label").select("node", "sig", F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("homes"))).alias("home"))
    rows = members.select("node", "band", "key", F.ceil(F.col("n") / BLOCK).alias("blocks")).join(homes, "node")
    return in_blocks(rows, "key", "node", "blocks").mapInArrow(_surviving(threshold), "lo long, hi long, a array<long>, b array<long>, bits binary")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over a few thousand shingles at a time."""
    n = len(sets)
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(value)) > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += m @ m.T
    return out


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for table in whole_groups(batches, ["lo", "hi"], rows=2000, nbytes=8 << 20):
            bounds = [*np.flatnonzero(starts(table, ["lo", "hi"])), table.num_rows]
            out: list[list[np.ndarray]] = [[], [], []]
            for s, e in zip(bounds, bounds[1:], strict=False):
                group = table.slice(s, e - s)
                texts = group.filter(pa.compute.is_valid(group["node"]))
                node, copies = texts["node"].to_numpy(), texts["copies"].to_numpy()
                order = np.argsort(node)
                n = len(node)
                wanted = np.zeros((n, n), bool)
                for p in group.filter(pa.compute.is_null(group["node"]))["parts"].to_pylist()[0]:
                    a, b = (order[np.searchsorted(node[order], p[c])] for c in ("a", "b"))
                    wanted[np.ix_(a, b)] |= np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=len(a) * len(b)).astype(bool).reshape(len(a), len(b))
                sets = [shingle_set(t, hashes) for t in texts["text"].cast(pa.binary()).to_pylist()]
                size = np.array([len(x) for x in sets])
                both = _shared_counts(sets)
                linked = (wanted | wanted.T) & (both / (size[:, None] + size[None, :] - both) >= threshold)
                np.fill_diagonal(linked, False)
                weight = linked @ copies
                label = local_components(n, *np.nonzero(np.triu(linked)))
                at = np.flatnonzero(weight)
                for o, v in zip(out, (node[at], weight[at], node[label[at]]), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["node", "n_links", "star"])

    return run


def verified_links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, tmp: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """node, n_links, star for the nodes of each pair of homes: how many documents they link with there, and a linked node.

    The bitmaps of a pair of homes are brought together first (at most one for each band and pair
    of a bucket's blocks), so each node is named once there however many bands it shares.
    """
    merged = tmp.table(pairs.groupBy("lo", "hi").agg(F.collect_list(F.struct("a", "b", "bits")).alias("parts")))
    need = tmp.table(merged.select("lo", "hi", F.explode(F.array_distinct(F.flatten(F.transform("parts", lambda p: F.concat(p["a"], p["b"]))))).alias("node")))
    keys = need.select("node").distinct().join(reps.select("node", "copies", "r.no_id", "r.doc_id", "r.text_hash"), "node")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    texts = keys.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("node", "copies", "text").dropDuplicates(["node"])
    rows = need.join(texts, "node").unionByName(merged, allowMissingColumns=True)
    return deal(rows, "lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(_verified(threshold), "node long, n_links long, star long")


def _decided(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, kept for each row of docs, written."""
    arrow_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as tmp:
        sigs = tmp.table(signatures(docs))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "rid", "n_bytes")).alias("r")
        reps = sigs.where("digest IS NOT NULL").groupBy("digest").agg(first, F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        reps = tmp.table(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "r", F.col("r.n_bytes").alias("n_bytes"), "copies", "sig", "bands"))
        pairs = surviving_pairs(reps, tmp, threshold)
        found = tmp.table(verified_links(pairs, reps, docs.select("doc_id", "text"), tmp, threshold))
        parts = connected_components(found.select(F.col("node").alias("a"), F.col("star").alias("b")))
        links = found.groupBy("node").agg(F.sum("n_links").alias("far"))
        own = reps.select("node", "digest", "r", "copies").join(links, "node", "left").join(parts, "node", "left")
        own = tmp.table(own.select("digest", "r", F.coalesce("component", "node").alias("component"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        best = tmp.table(own.groupBy("component").agg(F.min("r").alias("best")))
        named = own.join(best, "component").select(F.col("digest").alias("d"), "n_links", F.col("best.doc_id").alias("class_id"), F.col("best.rid").alias("best_rid"))
        out = sigs.select("doc_id", "text_hash", "rid", "digest").join(named, F.col("digest") == F.col("d"), "left")
        alone = F.col("d").isNull()
        return written(
            out.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("rid") == F.col("best_rid"))).alias("kept"))
        )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, kept: one row for each row of docs (doc_id, text).

    class_id is the smallest doc_id reachable by links, n_links the number of other documents
    whose similarity is at least the threshold, kept is true for one row of each class.
    """
    return _decided(docs, threshold).drop("text_hash")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class of near duplicates, with all its columns.

    Rows are known by id and text; of rows that repeat both, which only other columns can tell
    apart, any one is kept.
    """
    d, h, mark = spare(docs, "d", "h", "mark")
    rows = _decided(docs, threshold).groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept"))
    marks = written(rows.where("n_kept < n").select(d, h, (F.col("n_kept") > 0).alias(mark)))
    same: Column = docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h))
    out = docs.join(marks, same, "left_anti")
    again = marks.where(mark)
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(again, same).dropDuplicates([d, h]).select(*docs.columns))
