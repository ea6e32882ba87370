"""Changes of stored tables: each takes the table and gives the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.operators.stats import SEASON, Keys


def upsert(table: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """MU1: rows of changes replace those with equal keys; of repeated changes the one with the largest change_no."""
    w = Window.partitionBy(*by).orderBy(F.col("change_no").desc())
    every = table.withColumn("change_no", F.lit(-1).cast("long")).unionByName(changes)
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "change_no")


def toggle_final(games: DataFrame, toggled: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """MU2: games whose ids are in toggled change between open and final."""
    t = toggled.select(*keys, "game_id", F.lit(True).alias("_t")).distinct()
    g = games.join(t, [*keys, "game_id"], "left")
    return g.withColumn("is_final", F.coalesce("is_final", F.lit(False)) != F.coalesce("_t", F.lit(False))).drop("_t")


def remove(table: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """MU3, MU4: without the rows whose keys are in gone."""
    return table.join(gone.select(*by), by, "left_anti")


def swap_sides(games: DataFrame, swapped: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """MU3: home and away exchanged in the games of swapped."""
    g = games.join(swapped.select(*keys, "game_id", F.lit(True).alias("_s")).distinct(), [*keys, "game_id"], "left")
    pick = lambda a, b: F.when(F.col("_s"), F.col(b)).otherwise(F.col(a))
    return g.withColumns({"away_id": pick("away_id", "home_id"), "home_id": pick("home_id", "away_id")}).drop("_s")


def enter(logs: DataFrame, entries: DataFrame, bracket: bool = False, keys: Keys = SEASON) -> DataFrame:
    """MU1: logs after entries (keys, game_id, field, value, change_no): the last value of each field stays.

    A game without a log gets a blank one; logs of bracket games get strikeouts of 0 where they have none.
    """
    fields = [c for c in logs.columns if c not in (*keys, "game_id")]
    last = entries.groupBy(*keys, "game_id").pivot("field", fields).agg(F.max_by("value", "change_no")) if fields else entries
    new = last.select(*keys, "game_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_entered"))
    blank = {"innings": F.lit("6"), "is_final": F.lit(False)}
    types = dict(logs.dtypes)
    out = logs.withColumn("_there", F.lit(True)).join(new, [*keys, "game_id"], "full_outer")
    value = lambda f: F.coalesce(F.col(f"_{f}").cast(types[f]), F.when(F.col("_there"), F.col(f)).otherwise(blank.get(f, F.lit(""))))
    zero = lambda f, v: F.when(F.col("_entered") & (F.coalesce(v, F.lit("")) == ""), "0").otherwise(v) if bracket and f in ("away_k", "home_k") else v
    return out.select(*keys, "game_id", *[zero(f, value(f)).alias(f) for f in fields])
