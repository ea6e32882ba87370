"""Form of a team against its season, and league rankings by statistic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.operators.stats import SEASON, Keys, finals, team_games

# Metric, column, higher is better, threshold.
TRENDS = [("runs-for", "runs", True, 0.5), ("hits-for", "hits", True, 0.75), ("runs-against", "opp_runs", False, 0.5), ("hits-against", "opp_hits", False, 0.75)]
# Metric, column, higher is better, by the way pitches are thrown.
RANKINGS = {
    "machine": [("runs-scored", "runs", True), ("hits", "hits", True), ("least-strikeouts", "k", False), ("opponent-strikeouts", "opp_k", True), ("runs-allowed", "opp_runs", False), ("hits-allowed", "opp_hits", False)],
    "player": [("runs-scored", "runs", True), ("hits", "hits", True), ("walks-drawn", "opp_walks", True), ("errors", "errors", False), ("runs-allowed", "opp_runs", False), ("walks-allowed", "walks", False)],
}


def team_trends(games: DataFrame, keys: Keys = SEASON, window: int = 3) -> DataFrame:
    """Keys, team_id, metric, season_avg, recent_avg, delta, status, headline: the last games against all."""
    latest = Window.partitionBy(*keys, "team_id").orderBy(F.col("game_date").desc_nulls_first(), F.col("game_id").desc())
    tg = team_games(finals(games), keys).withColumn("age", F.row_number().over(latest))
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("v"), F.lit(1 if up else -1).alias("sign"), F.lit(t).alias("threshold")) for m, c, up, t in TRENDS])
    long = tg.select(*keys, "team_id", "age", F.explode(metrics).alias("m")).select(*keys, "team_id", "age", "m.*")
    out = long.groupBy(*keys, "team_id", "metric", "sign", "threshold").agg(F.count("*").alias("games"), F.avg("v").alias("season_avg"), F.avg(F.when(F.col("age") <= window, F.col("v"))).alias("recent_avg"))
    out = out.withColumn("delta", F.col("recent_avg") - F.col("season_avg"))
    status = F.when(F.abs("delta") < F.col("threshold"), "Steady").when(F.col("delta") * F.col("sign") > 0, "Hot").otherwise("Cold")
    every = Window.partitionBy(*keys, "team_id")
    out = out.withColumn("status", status)
    hot, cold = (F.sum((F.col("status") == x).cast("int")).over(every) for x in ("Hot", "Cold"))
    headline = F.when(F.col("games") < 2, "Need more finals for a real trend.").when(hot > cold, "Heating up").when(cold > hot, "Cooling off").otherwise("Holding steady")
    return out.withColumn("headline", headline).select(*keys, "team_id", "metric", "games", "season_avg", "recent_avg", "delta", "status", "headline")


def stat_rankings(games: DataFrame, teams: DataFrame, mode: str = "machine", keys: Keys = SEASON) -> DataFrame:
    """Keys, metric, team_id, value, rank, average, insert_at: teams by each statistic a game.

    Teams without games come last; insert_at is the rank before which the league's average falls.
    """
    from pennant.operators.standings import anchors

    metrics = RANKINGS[mode]
    tg = team_games(finals(games), keys).groupBy(*keys, "team_id").agg(F.count("*").alias("games"), *[F.sum(c).alias(m) for m, c, _ in metrics])
    t = teams.select(*keys, "team_id", "name").join(tg, [*keys, "team_id"], "left").fillna(0, ["games"])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("total"), F.lit(-1.0 if up else 1.0).alias("sign")) for m, _, up in metrics])
    long = t.select(*keys, "team_id", "name", "games", F.explode(each).alias("m")).select(*keys, "team_id", "name", "games", "m.*")
    long = long.withColumn("value", F.when(F.col("games") > 0, F.col("total") / F.col("games")))
    # values within the tolerance of a group's first are tied, and follow the names
    long = anchors(long.withColumn("better", F.coalesce(-F.col("value") * F.col("sign"), F.lit(-1e18))), "better", [*keys, "metric"])
    order = Window.partitionBy(*keys, "metric").orderBy(F.col("anchor").desc(), "name")
    every = Window.partitionBy(*keys, "metric")
    average = F.try_divide(F.sum("total").over(every), F.sum("games").over(every))
    out = long.withColumns({"rank": F.row_number().over(order).cast("long"), "average": average})
    beyond = (F.col("value") * F.col("sign") > F.col("average") * F.col("sign")) | F.col("value").isNull()
    return out.withColumn("insert_at", F.coalesce(F.min(F.when(beyond, F.col("rank"))).over(every), F.count("*").over(every) + 1)).select(*keys, "metric", "team_id", "value", "rank", "average", "insert_at")
