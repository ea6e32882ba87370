"""Quality classifier: logistic regression on hashed word n-grams, trained by follow the regularised leader.

A text's features are its words and word pairs and the one, two and three word n-grams of its
words' shapes (letters, digits and signs of a word, marked where it repeats the word before),
hashed into BUCKETS. A feature's value is its share of the n-grams, so the score is a sparse dot
product that doesn't depend on the length. Null, empty and blank texts have no features and get
the score of the bias alone. A table without usable labels gives the score 0.5 to every text, an
empty table none. Repeated rows get the same score each; rows that repeat an id with another text
are scored each by its own text. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, arrow_batches, spare

#: Bits of the feature hash; the model holds 8 bytes for each bucket.
BITS = 18
BUCKETS = 1 << BITS
#: Labelled rows that are learnt from at most: those whose doc_id hashes lowest.
MOST_ROWS = 8192
#: How often the rows are gone through, and the learner's parameters.
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Features count as this many times their share of the n-grams.
SCALE = 8.0
#: Scores from here on are predicted 1.
CUT = 0.7

_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Kinds(dict):
    """The kind of each character: A upper, a other letters, 0 digits; others stand for themselves."""

    def __missing__(self, c: str) -> str:
        k = self[c] = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return k


_KINDS = _Kinds()


def shape(word: str) -> str:
    """The kinds of all of a word's characters, runs of a kind as one."""
    return "".join(k for k, _ in groupby(map(_KINDS.__getitem__, word)))


class _Words(dict):
    """Hash of a word and of its shape, remembered for the words seen lately."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        kind = shape(word)
        h = self[word] = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(kind))
        return h


def features(text: str | None, words: _Words) -> np.ndarray:
    """Buckets of all n-grams of a text, with repetitions."""
    parts = (text or "").split()
    n = len(parts)
    if not n:
        return np.empty(0, np.int64)
    both = np.fromiter(chain.from_iterable(map(words.__getitem__, parts)), np.uint64, 2 * n)
    w, s = both[::2], both[1::2].copy()
    s[1:][w[1:] == w[:-1]] += np.uint64(1)
    found = [w * _SALT[0], s * _SALT[1]]
    if n > 1:
        found.append((w[:-1] * _SALT[2] + w[1:]) * _SALT[0])
        found.append((s[:-1] * _SALT[3] + s[1:]) * _SALT[1])
    if n > 2:
        found.append(((s[:-2] * _SALT[3] + s[1:-1]) * _SALT[4] + s[2:]) * _SALT[1])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct buckets of each text and how often each occurs."""
    words, ints = _Words(), pa.list_(pa.int32())
    for batch in batches:
        found = [np.unique(features(t, words), return_counts=True) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([f[i].astype(np.int32) for f in found], ints) for i in (0, 1))], ["doc_id", "label", "at", "times"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the regularised leader over the rows as they come; the last bucket is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for batch in batches:
        for at, times, y in zip(batch.column("at"), batch.column("times"), batch.column("label").to_pylist(), strict=True):
            at, count = np.append(at.values.to_numpy(), BUCKETS), times.values.to_numpy()
            x = np.append(count * (SCALE / max(1, count.sum())), 1.0)
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_weights(z[at], n[at]))], ["bucket", "weight"])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of BUCKETS features and the bias. docs: doc_id, text; labels: doc_id and a 0/1 column.

    Learns from most_rows rows at most (a documented bound, those whose id hashes lowest; of rows
    that repeat an id the smallest text and the largest label). Only their ids are broadcast. The
    texts are hashed in parallel; what the one learning task gets are counts of at most BUCKETS
    features a row, in the order of a hash that differs by epoch. The model has a fixed size.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    with Scratch(spark) as tmp:
        ids = tmp.table(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
        hashed = tmp.table(rows.mapInArrow(_hashed, f"doc_id {dict(rows.dtypes)['doc_id']}, label double, at array<int>, times array<int>"))
        turns = hashed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"))
        model = tmp.table(turns.select("at", "times", "label").mapInArrow(_learn, "bucket long, weight double")).toPandas()
    weights = np.zeros(BUCKETS + 1)
    weights[model["bucket"]] = model["weight"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, col: str = "score") -> DataFrame:
    """docs with the column col (in place of one of that name): the probability of label 1 for each whole text."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, words = held.value, _Words()
        for batch in batches:
            margin = np.full(len(batch), w[BUCKETS])
            for i, text in enumerate(batch):
                at = features(text.as_py(), words)
                if len(at):
                    margin[i] += SCALE * w[at].mean()
            yield pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))))

    return docs.withColumn(col, scored(F.col("text")))


def is_held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from; null ids aren't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learnt from the rows that aren't held out."""
    weights = train(docs, labels.where(~is_held_out(F.col("doc_id"))))
    out = score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept_by_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    weights = train(docs, labels.where(~is_held_out(F.col("doc_id"))))
    (col,) = spare(docs, "score")
    return score(docs, weights, col).where(F.col(col) >= cut).drop(col)
