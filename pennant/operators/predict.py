"""Game predictions from team statistics, as column expressions over games joined with both teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pennant.functions.scalars import clamp, half_up, logistic, logit, ratio
from pennant.operators.stats import SEASON, Keys
from pennant.settings import Settings

#: Columns of the statistics that the models read.
READS = ["games", "rs", "ra", "run_diff", "pct", "rsg", "rag", "hpg", "kpg", "total_k6", "away_k6", "home_k6", "tpi", "sos", "momentum", "machine_difficulty", "hit_diff", "walk_diff", "error_diff", "walks_allowed_pg", "errors_pg"]


def calibrate(p: Column, games: Column, aggression: float) -> Column:
    """PM5: shrinks a probability towards a half while few games are known, between .04 and .96."""
    shrink = F.lit(0.58) + clamp(games / F.lit(20.0), 0.0, 1.0) * 0.28
    lean = min(1.1, max(0.9, 1 + (aggression - 1) * 0.12))
    return clamp(logistic(logit(clamp(p, 0.02, 0.98)) * shrink * lean), 0.04, 0.96)


def league_scalars(stats: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Runs and strikeouts of a team in a game; 7 and 4.5 before the first."""
    g = F.sum("games")
    runs, ks = F.try_divide(F.sum("rs").cast("double"), g), F.try_divide(F.sum(F.col("kpg") * F.col("games")), g)
    return stats.groupBy(*keys).agg(F.coalesce(runs, F.lit(7.0)).alias("lg_runs"), F.coalesce(ks, F.lit(4.5)).alias("lg_k"))


def with_teams(games: DataFrame, stats: DataFrame, h2h: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """games with both teams' statistics (a_, h_), the away team's record against the home team, league scalars."""
    out = games
    for p, side in (("a_", "away"), ("h_", "home")):
        out = out.join(stats.select(*keys, F.col("team_id").alias(f"{side}_id"), *[F.col(c).alias(p + c) for c in READS]), [*keys, f"{side}_id"], "left")
    met = h2h.select(*keys, F.col("team_id").alias("away_id"), F.col("opp_id").alias("home_id"), "wins", "losses", "ties")
    return out.join(met, [*keys, "away_id", "home_id"], "left").join(league_scalars(stats, keys), list(keys), "left")


def h2h_edge() -> Column:
    """PM6"""
    n = F.col("wins") + F.col("losses") + F.col("ties")
    pct = F.try_divide(F.col("wins") + F.col("ties") * 0.5, n)
    return clamp(F.coalesce((pct - 0.5) * 2 * clamp(n / F.lit(4.0), 0.25, 1.0), F.lit(0.0)), -1.0, 1.0)


def _d(name: str) -> Column:
    return F.col("a_" + name) - F.col("h_" + name)


def _per(p: str, name: str) -> Column:
    return F.col(p + name) / F.greatest(F.col(p + "games"), F.lit(1))


def _diff_per_game() -> Column:
    return ratio(F.col("a_run_diff"), F.col("a_games")) - ratio(F.col("h_run_diff"), F.col("h_games"))


def machine_edge(margin: Column, aggression: float) -> Column:
    """PM3: ten weighted differences, the home team's advantage last."""
    contact = lambda p: (F.col("lg_k") - F.coalesce(F.col(p + "total_k6"), F.col("lg_k"))) * 0.18 + F.col(p + "hpg") * 0.08
    # Weight, difference, bound.
    terms = [
        (0.34, margin / 8, 1.35),
        (0.28, _d("tpi") / 7, 1.25),
        (0.20, (_d("rsg") + (F.col("h_rag") - F.col("a_rag")) * 0.7) / 9, 1.1),
        (0.15, _d("pct") * 1.35, 1.0),
        (0.13, _diff_per_game() / 7, 1.0),
        (0.10, _d("momentum") / 7, 0.85),
        (0.08, h2h_edge(), 1.0),
        (0.07, (contact("a_") - contact("h_")) / 2.5, 0.75),
        (0.05, _d("sos") / 8, 0.55),
    ]
    edge = F.lit(-0.06)
    for w, v, bound in terms:
        edge = edge + clamp(v, -bound, bound) * w
    return edge * clamp((F.col("a_games") + F.col("h_games")) / F.lit(14.0), 0.35, 1.0) * min(1.25, max(0.95, 0.95 + aggression * 0.18))


def player_edge(aggression: float) -> Column:
    """PM4: eight weighted differences, the home team's advantage last."""
    per = lambda name: _per("a_", name) - _per("h_", name)
    # Weight, difference; all within 1.
    terms = [
        (0.30, _diff_per_game() / 8),
        (0.25, (_d("rsg") + F.col("h_rag") - F.col("a_rag")) / 10),
        (0.15, per("walk_diff") / 5),
        (0.10, per("hit_diff") / 7),
        (0.10, per("error_diff") / 4),
        (0.05, _d("sos") / 8),
        (0.05, _d("momentum") / 7),
        (0.05, h2h_edge()),
    ]
    edge = F.lit(-0.04)
    for w, v in terms:
        edge = edge + clamp(v, -1.0, 1.0) * w
    return edge * min(1.25, max(0.95, 0.95 + aggression * 0.16))


def predict(joined: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """PM1, PM2, PM4: away_score, home_score, away_pct, winner_id, confidence for games with their teams."""
    ag, player = settings.aggression, settings.pitch_mode == "player"
    lg = F.greatest(F.col("lg_runs"), F.lit(1.0))
    a, h = F.col("a_rsg") * F.col("h_rag") / lg, F.col("h_rsg") * F.col("a_rag") / lg
    if player:
        push = lambda me, other: F.col(other + "walks_allowed_pg") * 0.28 - F.col(me + "errors_pg") * 0.18 + F.col(me + "momentum") * 0.08
        a, h = a + push("a_", "h_"), h + push("h_", "a_")
    else:
        tilt = clamp(_d("tpi"), -6.0, 6.0) * 0.025 * ag
        swing = lambda p: clamp(F.col(p + "momentum"), -3.0, 3.0) * 0.15 * ag
        k = clamp(F.coalesce("a_away_k6", F.lit(4.5)) + F.col("h_machine_difficulty") - F.coalesce("h_home_k6", F.lit(4.5)), -3.0, 3.0)
        a, h = a * (F.lit(1.0) + tilt) + swing("a_") + F.greatest(-k, F.lit(0.0)) * 0.2, h * (F.lit(1.0) - tilt) + swing("h_") + F.greatest(k, F.lit(0.0)) * 0.2
    prior = lambda p: F.when(F.col(p + "games") > 0, F.col(p + "pct")).otherwise(0.5)
    known = F.col("a_games").isNotNull() & F.col("h_games").isNotNull()
    thin = (F.col("a_games") < 2) | (F.col("h_games") < 2)
    both = F.col("a_games") + F.col("h_games")
    thin_p = calibrate(F.lit(0.5) + clamp((prior("a_") - prior("h_")) * (0.16 if player else 0.18), -0.08, 0.08), both, ag)
    out = joined.withColumns({"_a": F.greatest(F.lit(1.0), a), "_h": F.greatest(F.lit(1.0), h)}).withColumn("_m", F.col("_a") - F.col("_h"))
    full_p = calibrate(logistic(player_edge(ag) if player else machine_edge(F.col("_m"), ag)), both, ag)
    out = out.withColumn("away_pct", F.when(~known, 0.5).when(thin, thin_p).otherwise(full_p))
    spread = clamp((F.col("away_pct") - 0.5) * 6, -1.0, 1.0)
    score = lambda full, sign: F.when(~known, half_up(F.col("lg_runs"))).when(thin, F.greatest(F.lit(1), half_up(F.col("lg_runs") + spread * sign))).otherwise(half_up(F.col(full)))
    least = F.least("a_games", "h_games")
    sure = F.greatest(F.col("away_pct"), F.lit(1.0) - F.col("away_pct"))
    high, medium = ((6, 5, 0.76), (4, 2.5, 0.63)) if player else ((6, 6, 0.78), (4, 3, 0.65))
    reaches = lambda b: (least >= b[0]) & (F.abs("_m") >= b[1]) & (sure >= b[2])
    out = out.withColumns({"away_score": score("_a", 1).cast("long"), "home_score": score("_h", -1).cast("long"), "winner_id": F.when(~known | (F.col("away_pct") >= 0.5), F.col("away_id")).otherwise(F.col("home_id"))})
    out = out.withColumn("confidence", F.when(~known | thin, "Low").when(reaches(high), "High").when(reaches(medium), "Medium").otherwise("Low"))
    drop = [p + c for p in ("a_", "h_") for c in READS] + ["wins", "losses", "ties", "lg_runs", "lg_k", "_a", "_h", "_m"]
    return out.drop(*drop)


def predictions(games: DataFrame, stats: DataFrame, h2h: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """PM11: predictions of all given games."""
    return predict(with_teams(games, stats, h2h, keys), settings)
