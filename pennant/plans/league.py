"""A league derived from the order tables: nations play, orders are games, line items are scores.

Games and teams are derived once for each set of input tables, with one scan of each, and
written; all queries read them from there. The SQL prelude states the same derivation for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.plans.tables import derived

STATS = ["runs", "hits", "k", "errors", "walks"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def team_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, name, ord: one row per nation."""
    n = _read(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("team_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))


def _paths(sf_dir: str, *names: str) -> list[str]:
    return [f"{sf_dir}/{n}.parquet" for n in names]


def sources(sf_dir: str) -> list[str]:
    """The tables that the league is derived from."""
    return _paths(sf_dir, "nation", "customer", "orders", "lineitem")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season, team_id, name, ord: every nation in every season."""
    return derived(spark, _paths(sf_dir, "nation", "orders"), "teams", lambda: _teams(spark, sf_dir))


def _teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    seasons = _read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("season")).distinct()
    every = team_names(spark, sf_dir).agg(F.collect_list(F.struct("team_id", "name", "ord")).alias("t"))
    return seasons.join(F.broadcast(every)).select("season", F.explode("t").alias("t")).select("season", "t.*")


def matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season, game_id, ord, game_date, away_id, home_id."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    away = F.col("c_nationkey").cast("long")
    home = F.pmod(away + 1 + F.pmod("o_orderkey", F.lit(24)), F.lit(25))
    team = lambda k: F.concat(F.lit("N"), F.lpad(k.cast("string"), 2, "0"))
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return g.select(F.date_format("o_orderdate", "yyyy-MM").alias("season"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("game_id"), F.col("o_orderkey").alias("ord"), F.to_date("o_orderdate").alias("game_date"), team(away).alias("away_id"), team(home).alias("home_id"), (F.col("o_orderstatus") == "F").alias("is_final"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord and the statistics of both sides: one row per order with line items."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    found = []
    for side, odd in (("away", 1), ("home", 0)):
        mine = F.col("l_linenumber") % 2 == odd
        total = lambda e, mine=mine: F.coalesce(F.sum(F.when(mine, e)), F.lit(0)).cast("long")
        runs = F.pmod(total(F.col("l_quantity")), F.lit(16))
        found += [runs.alias(f"{side}_runs"), (runs + F.count(F.when(mine, 1))).alias(f"{side}_hits"), F.pmod(total(F.col("l_partkey")), F.lit(9)).alias(f"{side}_k"), F.pmod(total(F.col("l_suppkey")), F.lit(4)).alias(f"{side}_errors"), F.pmod(total(F.col("l_partkey") + F.col("l_suppkey")), F.lit(6)).alias(f"{side}_walks")]
    return items.groupBy(F.col("l_orderkey").alias("log_ord")).agg(*found)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matchup with its statistics (null unless final), innings and is_final."""
    return derived(spark, _paths(sf_dir, "orders", "customer", "lineitem"), "games", lambda: _games(spark, sf_dir))


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matchups(spark, sf_dir).join(logs(spark, sf_dir), F.col("ord") == F.col("log_ord"), "left").drop("log_ord")
    stat = lambda c: F.when(F.col("is_final"), F.coalesce(c, F.lit(0)))
    return g.withColumns({f"{s}_{x}": stat(F.col(f"{s}_{x}")) for s in ("away", "home") for x in STATS}).withColumn("innings", F.lit(6).cast("long"))


def _side_sql(side: str, odd: int) -> str:
    mine = f"l_linenumber % 2 = {odd}"
    total = lambda e: f"CAST(coalesce(sum({e}) FILTER (WHERE {mine}), 0) AS BIGINT)"
    return f"""{total("l_quantity")} % 16 AS {side}_runs, {total("l_quantity")} % 16 + count(*) FILTER (WHERE {mine}) AS {side}_hits,
    {total("l_partkey")} % 9 AS {side}_k, {total("l_suppkey")} % 4 AS {side}_errors, {total("l_partkey + l_suppkey")} % 6 AS {side}_walks"""


SQL = f"""
teams AS (
  SELECT season, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS team_id, n_name AS name, CAST(n_nationkey AS BIGINT) AS ord
  FROM nation, (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS season FROM orders)),
side_logs AS (SELECT l_orderkey, {_side_sql("away", 1)}, {_side_sql("home", 0)} FROM lineitem GROUP BY l_orderkey),
games AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS season, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS game_id, o_orderkey AS ord, CAST(o_orderdate AS DATE) AS game_date,
    'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS away_id,
    'N' || lpad(CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS VARCHAR), 2, '0') AS home_id, o_orderstatus = 'F' AS is_final,
    {", ".join(f"CASE WHEN o_orderstatus = 'F' THEN coalesce({s}_{x}, 0) END AS {s}_{x}" for s in ("away", "home") for x in STATS)}, CAST(6 AS BIGINT) AS innings
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN side_logs ON l_orderkey = o_orderkey)"""
