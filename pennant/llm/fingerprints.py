"""Bottom-k sketches of shingle hashes, with SQL functions only.

A sketch is the sorted array of the k smallest distinct shingle hashes (48 bits, as longs).
Sketches of parts merge into the sketch of the whole. Null and empty texts have an empty sketch,
alike to each other (1.0) and to nothing else (0.0). Repeated rows get equal results; columns
other than doc_id and text are not read; an empty table gives none.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.llm.common import SHINGLE, spare, written

K = 128
BITS = 48
_BLANK = " \t\n\x0b\f\r"
#: Stands for a null doc_id, in order and in joins: below every long.
_NONE = Decimal(-(2**63) - 1)
_ID = "decimal(20,0)"
#: Rows of one id beyond which they are joined apart.
HOT_ROWS = 4096


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text's shingles of five words."""
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK)), r"[\x20\x09-\x0D]+")

    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        last = F.greatest(n - SHINGLE, F.lit(0))
        # words behind the end of a shorter text are null, and don't change the hash
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(ws, i + j if j else i) for j in range(SHINGLE)]), 64 - BITS))
        return F.when((n == 1) & (ws[0] == ""), F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(each)), 1, k))

    return let(words, hashes)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, by: list[str], col: str, k: int = K) -> DataFrame:
    """The sketch of each group of by: the k smallest distinct hashes of the group's sketches.

    The hashes are made distinct before they are ranked, so no group is gathered in one task
    before it has been reduced, except for its distinct hashes.
    """
    h, r = spare(sketches, "h", "r")
    each = sketches.select(*by, F.explode(col).alias(h)).distinct()
    low = each.withColumn(r, F.row_number().over(Window.partitionBy(*by).orderBy(h))).where(F.col(r) <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list(h)).alias(col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest that both sets have."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(2**BITS) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, BITS / 4 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def ring(ids: DataFrame) -> DataFrame:
    """k, next_k for distinct numbers k: the next larger, and the smallest behind the largest.

    The ids are range-partitioned and written, so that each partition finds its own neighbours;
    only one row per partition takes part in the step across partitions.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(ids.select("k").repartitionByRange(n, "k").withColumn("part", F.spark_partition_id()))
    ends = parts.groupBy("part").agg(F.min("k").alias("low"))
    over = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("low").over(over), F.min("low").over(Window.partitionBy(F.lit(0)))).alias("beyond"))
    inside = parts.withColumn("inner", F.lead("k").over(Window.partitionBy("part").orderBy("k")))
    return inside.join(F.broadcast(ends), "part").select("k", F.coalesce("inner", "beyond").alias("next_k"))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's sketch beside those of its edited text and of the next document by doc_id.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the
    next document. Of documents that repeat an id, the one whose text hashes lowest counts as
    the next; documents without an id count as one with the smallest. The whole texts are shuffled once; each
    next document sends back only the prefix that its predecessor needs and its sketch. Rows of an id that
    more than HOT_ROWS rows have are joined to its written prefix apart, where Spark can split them.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast(_ID), F.lit(_NONE).cast(_ID)).alias("k"), text.alias("text"))
    lengths = written(base.select("k", F.char_length("text").alias("n")).groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("rows")))
    asks = written(lengths.join(ring(lengths), "k").select(F.col("next_k"), F.col("k").alias("asker"), (F.col("n") / 2).cast("int").alias("m")))
    heads = base.join(asks, F.col("k") == F.col("next_k")).select("asker", F.struct(F.xxhash64("text").alias("h"), F.substr("text", F.lit(1), F.col("m")).alias("head"), sketch(F.col("text"), k).alias("sk")).alias("next"))
    heads = heads.groupBy("asker").agg(F.min("next").alias("next"))
    hot = lengths.where(F.col("rows") > HOT_ROWS).select(F.col("k").alias("hot_k"))
    if hot.isEmpty():
        rows = base.join(heads, F.col("k") == F.col("asker"))
    else:
        is_hot = F.col("k") == F.col("hot_k")
        few = written(heads.join(hot, F.col("asker") == F.col("hot_k"), "left_semi"))
        rows = base.join(hot, is_hot, "left_anti").join(heads, F.col("k") == F.col("asker")).unionByName(base.join(few, F.col("k") == F.col("asker")))
    n = F.char_length("text")
    cut = (n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.col("next.head"), F.lit(1), cut))
    rows = rows.select("k", "text", "next", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("k", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array(sketch(F.col("text"), k), sketch(F.col("edited"), k), F.col("next.sk")).alias("s"))
    out = F.transform(
        F.array("s"),
        lambda s: F.struct(
            as_text(s[0]).alias("fingerprint"),
            as_text(s[1]).alias("edited_fingerprint"),
            resemblance(s[0], s[1], k).alias("near_edited"),
            resemblance(s[0], s[2], k).alias("near_next"),
            containment(s[0], s[1], k).alias("kept_in_edited"),
            distinct_shingles(s[0], k).alias("n_shingles"),
        ),
    )[0]
    return rows.select(F.nullif("k", F.lit(_NONE).cast(_ID)).cast("long").alias("doc_id"), "n_chars", "edited_sha256", out.alias("o")).select("doc_id", "n_chars", "edited_sha256", "o.*")
