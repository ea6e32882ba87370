"""Two teams side by side, the dashboard's tiles, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.functions.scalars import half_up, record_text
from pennant.operators.stats import SEASON, Keys

# What is compared, in this order: label, column, 1 where more is better and -1 where less is.
COMPARED = [
    ("Win %", "pct", 1), ("Run Diff", "run_diff", 1), ("Runs/Game", "rsg", 1), ("Runs Allowed/Game", "rag", -1), ("Hits/Game", "hpg", 1), ("K/Game (batting)", "kpg", -1),
    ("Ks Against/Game", "opp_kpg", 1), ("TPI", "tpi", 1), ("Gold Odds", "gold_pct", 1), ("Current Seed", "rank", -1), ("Projected Seed", "projected_rank", -1),
]


def _text(label: str, v: Column) -> Column:
    one = F.format_string("%.1f", v.cast("double"))
    sign = F.when(v > 0, "+").otherwise("")
    known = {
        "Win %": F.concat(half_up(v * 100).cast("string"), F.lit("%")),
        "Run Diff": F.concat(sign, v.cast("string")),
        "TPI": F.concat(sign, F.format_string("%.2f", v.cast("double"))),
        "Gold Odds": F.concat(half_up(v).cast("string"), F.lit("%")),
        "Current Seed": F.concat(F.lit("#"), v.cast("string")),
        "Projected Seed": F.concat(F.lit("#"), v.cast("string")),
    }
    return known.get(label, one)


def compare_teams(pairs: DataFrame, board: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """keys, left_id, right_id, nth, label, left, right, better: twelve rows for each pair.

    pairs: keys, left_id, right_id. better is left, right or tie; null for the record, which has none.
    A team without a rank counts as 99th.
    """
    columns = [c for _, c, _ in COMPARED]
    out = pairs
    for s in ("left", "right"):
        team = board.select(*keys, F.col("team_id").alias(f"{s}_id"), F.struct("w", "l", "t", *columns).alias(s))
        out = out.join(team, [*keys, f"{s}_id"])
    rows = [F.struct(F.lit(1).alias("nth"), F.lit("Record").alias("label"), *[record_text(F.col(f"{s}.w"), F.col(f"{s}.l"), F.col(f"{s}.t")).alias(s) for s in ("left", "right")], F.lit(None).cast("string").alias("better"))]
    for i, (label, c, sign) in enumerate(COMPARED, 2):
        a, b = (F.coalesce(F.col(f"{s}.{c}"), F.lit(99)) if c == "rank" else F.col(f"{s}.{c}") for s in ("left", "right"))
        better = F.when(a == b, "tie").when((a > b) if sign > 0 else (a < b), "left").otherwise("right")
        rows.append(F.struct(F.lit(i).alias("nth"), F.lit(label).alias("label"), _text(label, F.col(f"left.{c}")).alias("left"), _text(label, F.col(f"right.{c}")).alias("right"), better.alias("better")))
    return out.select(*keys, "left_id", "right_id", F.explode(F.array(*rows)).alias("x")).select(*keys, "left_id", "right_id", F.col("x.nth").cast("long").alias("nth"), "x.label", "x.left", "x.right", "x.better")


def tiles(games: DataFrame, forecasts: DataFrame, power: DataFrame, quality: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """One row per season: completed games, forecast games, their average confidence (0 without any), the top-rated team, the data's quality."""
    done = games.groupBy(*keys).agg(F.count_if(F.coalesce("is_final", F.lit(False))).alias("completed"))
    f = forecasts.groupBy(*keys).agg(F.count("*").alias("forecasted"), half_up(F.avg("confidence")).cast("long").alias("avg_confidence"))
    top = power.where("rank = 1").select(*keys, F.col("name").alias("top_team"))
    out = quality.select(*keys, "tier").join(done, list(keys), "left").join(f, list(keys), "left").join(top, list(keys), "left")
    return out.fillna(0, ["completed", "forecasted", "avg_confidence"]).select(*keys, "completed", "forecasted", "avg_confidence", "top_team", "tier")
