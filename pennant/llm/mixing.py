"""Mixing sources to target weights: hash-random order, distributed prefix sums, budget cuts, epochs.

Rows with a null text or no words have size 0 and take nothing; null sources form one source
that sorts last. The order within a source is that of a hash of id and text, so rows that repeat an id
with another text (or have none) stand apart; rows that repeat both are interchangeable, and a cut
may fall between them. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.llm.common import WORD, replaced, spare, written

#: Keys that one prefix-sum group holds on average.
RUN = 4096


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(keys: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, n_keys, target. keys: source, size, n (rows of that size). One row per source, so its windows may be global.

    Every source gets its weight's share of all sizes; a target stops at most times its
    source's size and the excess is shared out again. In the order of the shares at which
    sources reach their limit, the first that stays below it fixes the level for the rest.
    """
    s = keys.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_keys"))
    every = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights)) + 1).cast("long")
    s = s.withColumn("w", w)
    rising = Window.orderBy(F.col("source_size") * float(most) / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), zero)).alias("left_size"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero)).alias("left_w"),
        F.row_number().over(rising).alias("rk"),
    )
    big = "decimal(38,0)"
    below = F.col("left_size").cast(big) * F.col("w") <= (F.col("source_size") * most).cast(big) * F.col("left_w")
    first = F.min(F.when(below, F.struct("rk", "left_size", "left_w"))).over(whole)
    s = s.withColumn("first", first)
    level = F.col("w").cast("double") * F.col("first.left_size").cast("double") / F.col("first.left_w").cast("double")
    limit = (F.col("source_size") * most).cast("double")
    return s.select("source", "source_size", "n_keys", F.when(F.col("rk") < F.col("first.rk"), limit).otherwise(level).alias("target"))


def _cuts(keys: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """source, source_size, target, full (whole epochs), cut_key, cut_n, cut_j: behind the epochs, all keys before cut_key are taken and cut_j of its cut_n rows."""
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(2**32)
    t = targets.withColumns({"runs": F.ceil(F.col("n_keys") / RUN), "full": F.least(F.lit(most), F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))})
    t = t.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    keyed = keys.join(t.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "key", F.floor(u * F.col("runs")).alias("run"), "rest")
    runs = keyed.groupBy("source", "run").agg(F.sum(F.col("size") * F.col("n")).alias("run_size"))
    before = F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), before.alias("before"))
    inside = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source", "run").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = keyed.withColumn("inside", inside).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    start = F.col("before") + F.col("inside")
    # of a key's rows, those after which the sum is just below and just above what is left
    below = F.floor(F.coalesce(F.try_divide(F.col("rest") - start, "size"), F.lit(0.0)))
    tries = [F.greatest(F.lit(1), F.least(F.col("n"), below + i)).cast("long") for i in (0, 1)]
    off = [F.struct(F.abs(start + F.col("size") * j - F.col("rest")).alias("off"), "key", j.alias("j"), "n") for j in tries]
    cuts = prefix.groupBy("source").agg(F.min(F.least(*off)).alias("cut")).select(F.col("source").alias("s"), "cut")
    t = t.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    at = lambda name: F.when(F.col("cut.off") < F.col("rest"), F.col(f"cut.{name}"))
    return t.select("source", "source_size", "target", "full", at("key").alias("cut_key"), at("n").alias("cut_n"), at("j").alias("cut_j"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, list[str]]:
    """docs with four more columns, and their names: size, source_size, target, times.

    Keys and sizes are read once; the rows themselves are never shuffled for the order, only the cuts
    of each source are joined to them. Rows that repeat id and text are numbered only where a cut falls between
    them: by partition, with the counts of the partitions before.
    """
    size, source_size, target, times, key, source, full, cut_key, cut_n, cut_j, part, at = names = spare(docs, "size", "source_size", "target", "times", "key", "source_of", "full", "cut_key", "cut_n", "cut_j", "part", "at")
    hashed = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.withColumns({size: n_words(F.col("text")), key: hashed})
    keys = written(sized.groupBy("source", F.col(key).alias("key")).agg(F.first(size).alias("size"), F.count("*").alias("n")))
    cuts = written(_cuts(keys, written(source_targets(keys, weights, most)), most))
    many = not cuts.where("cut_j < cut_n").isEmpty()
    cuts = cuts.toDF(source, source_size, target, full, cut_key, cut_n, cut_j)
    out = sized.join(cuts, F.col("source").eqNullSafe(F.col(source)))
    here = F.coalesce(F.col(key) == F.col(cut_key), F.lit(False))
    more = F.coalesce(F.col(key) <= F.col(cut_key), F.lit(False)).cast("long")
    columns = [*docs.columns, size, source_size, target]
    if not many:
        return out.select(*columns, (F.col(full) + more).cast("long").alias(times)), names[:4]
    tied = here & (F.col(cut_j) < F.col(cut_n))
    rest = out.where(~tied).select(*columns, (F.col(full) + more).cast("long").alias(times))
    repeated = written(out.where(tied).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    counts = repeated.groupBy(source, part).agg(F.count("*").alias("c"))
    counts = counts.select(F.col(source).alias("s"), F.col(part).alias("p"), F.coalesce(F.sum("c").over(Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy(source, part).orderBy(at))
    repeated = repeated.withColumn(at, number).join(counts, F.col(source).eqNullSafe(F.col("s")) & (F.col(part) == F.col("p")))
    repeated = repeated.select(*columns, (F.col(full) + (F.col(at) + F.col("earlier") <= F.col(cut_j)).cast("long")).cast("long").alias(times))
    return rest.unionByName(repeated), names[:4]


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs with size, source_size, target and times (how often the mix takes the whole row), in place of columns of these names.

    docs needs doc_id, source and text. A source's words are taken whole times over, then its rows
    in the order of the hash up to the row whose prefix sum comes nearest to what is left.
    """
    out, names = _mixed(docs, weights, most)
    results = ["size", "source_size", "target", "times"]
    return out.select(*replaced(docs, *results), *[F.col(n).alias(r) for n, r in zip(names, results, strict=True)])


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    out, (*_, times) = _mixed(docs, weights, most)
    (copy,) = spare(out, "copy")
    return out.where(F.col(times) > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int"))).alias(copy)).drop(copy)


def sizes_and_takes(docs: DataFrame) -> DataFrame:
    """The digest of mixture(): words taken by document."""
    return mixture(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER r AS rk,
         sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
         sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM s WINDOW r AS (ORDER BY source_size * CAST(3 AS DOUBLE) / w, source NULLS LAST)),
f AS (SELECT * FROM o WHERE left_size * w <= source_size * 3 * left_w ORDER BY rk LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.rk < f.rk THEN CAST(o.source_size * 3 AS DOUBLE)
              ELSE CAST(o.w AS DOUBLE) * CAST(f.left_size AS DOUBLE) / CAST(f.left_w AS DOUBLE) END AS target
  FROM o CROSS JOIN f),
b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         abs(sum(d.size) OVER o - (b.target - b.epochs * b.source_size)) AS off, row_number() OVER o AS rn
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source WINDOW o AS (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING)),
c AS (SELECT source, rn AS last FROM p WHERE off < rest QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, rn) = 1)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN rn <= c.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""
