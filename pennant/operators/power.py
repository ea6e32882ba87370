"""Power ratings: schedule-adjusted strength, Elo, form; league predictions with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import clamp, half_up, logistic, record_text
from pennant.operators.stats import SEASON, Keys, finals, league_scoring, margins, net_sos, remaining, team_games

# Fixed values of the Elo scale.
START, K_FACTOR, MARGIN_WEIGHT, MOST = 1500.0, 22.0, 1.15, 34.0


# Sentences, labels and formats in which results are told.
SAID = {
    "no_completed_results": " no completed results.",
    "add_at_least_two_teams": "Add at least two teams before the model can compare matchups.",
    "no_completed_scores_are_available": "No completed scores are available, so forecasts are only league-average placeholders.",
    "add_teams_or_import_a": "Add teams or import a schedule.",
    "enter_completed_game_scores": "Enter completed game scores.",
    "add_scores_for_teams_with": "Add scores for teams with no completed games.",
    "add_future_scheduled_games_to": "Add future scheduled games to generate upcoming predictions.",
    "s_owns_the_stronger_blended": "%s owns the stronger blended power rating (%.1f vs %.1f).",
    "has_an_adjusted_net_rating": " has an adjusted net rating edge after opponent-strength correction.",
    "recent_form_supports_the_projected": "Recent form supports the projected winner.",
    "head_to_head_results_are": "Head-to-head results are included but capped so one game does not dominate.",
    "confidence_is_reduced_because_at": "Confidence is reduced because at least one team has fewer than three completed games.",
    "projected_margin_is_tight_so": "Projected margin is tight, so winner certainty remains limited.",
    "recent_results_are_volatile_which": "Recent results are volatile, which lowers model confidence.",
    "small_sample_size_can_make": "Small sample size can make ratings unstable.",
    "similar_team_ratings_create_a": "Similar team ratings create a close-game risk.",
    "the_model_needs_completed_scores": "The model needs completed scores before it can forecast this matchup.",
    "insufficient_completed_game_data": "Insufficient completed game data.",
}


def data_quality(games: DataFrame, teams: DataFrame, keys: Keys = SEASON, least_from_zero: bool = True) -> DataFrame:
    """Tier, warnings and recommended actions of each season.

    With least_from_zero (as users of the model know it) the least number of games counts from 0,
    so that no tier beyond Limited is reached.
    """
    n = team_games(finals(games), keys).groupBy(*keys, "team_id").agg(F.count("*").alias("n"))
    t = teams.join(n, [*keys, "team_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = t.groupBy(*keys).agg(F.count("*").alias("teams"), F.count_if(F.col("n") == 0).alias("idle"), F.min("n").alias("least"))
    g = games.groupBy(*keys).agg(F.count_if(F.coalesce("is_final", F.lit(False))).alias("done"), F.count_if(~F.coalesce("is_final", F.lit(False))).alias("open"))
    out = t.join(g, list(keys), "left").fillna(0, ["done", "open"])
    least = F.lit(0) if least_from_zero else F.col("least")
    reached = lambda k: (F.col("done") >= F.col("teams") * k) & (least >= k)
    tier = F.when((F.col("teams") < 2) | (F.col("done") == 0), "Insufficient").when(reached(4), "Excellent").when(reached(3), "Strong").when(reached(1), "Developing").otherwise("Limited")
    few, none = F.col("teams") < 2, F.col("done") == 0
    idle = F.concat(F.col("idle").cast("string"), F.lit(" team"), F.when(F.col("idle") == 1, " has").otherwise("s have"), F.lit(SAID["no_completed_results"]))
    warn = F.array_compact(F.array(F.when(few, F.lit(SAID["add_at_least_two_teams"])), F.when(none, F.lit(SAID["no_completed_scores_are_available"])), F.when(F.col("idle") > 0, idle)))
    act = F.array_compact(F.array(F.when(few, F.lit(SAID["add_teams_or_import_a"])), F.when(none, F.lit(SAID["enter_completed_game_scores"])), F.when(F.col("idle") > 0, F.lit(SAID["add_scores_for_teams_with"])), F.when(F.col("open") == 0, F.lit(SAID["add_future_scheduled_games_to"]))))
    return out.select(*keys, "teams", "done", "open", "idle", tier.alias("tier"), warn.alias("warnings"), act.alias("actions"))


def recent_form(games: DataFrame, keys: Keys = SEASON, last: int = 5) -> DataFrame:
    """Margins of the last games in the order of input, later ones weighing more, over their number."""
    latest = Window.partitionBy(*keys, "team_id").orderBy(F.col("ord").desc())
    tg = team_games(finals(games), keys).withColumn("age", F.row_number().over(latest) - 1).where(F.col("age") < last)
    n = F.count("*").over(Window.partitionBy(*keys, "team_id"))
    tg = tg.withColumn("v", (F.col("runs") - F.col("opp_runs")) * (n - F.col("age")) / n)
    return tg.groupBy(*keys, "team_id").agg((F.sum("v") / F.count("*")).alias("recent_form"))


def elo(games: DataFrame, teams: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """PM8: keys, team_id, elo: ratings after all finals in the order of their dates.

    A season's games are folded in order over a map of ratings, within one SQL expression; seasons run side by side.
    """
    f = finals(games)
    day = F.concat_ws("/", F.month("game_date").cast("string"), F.dayofmonth("game_date").cast("string"))
    ordered = f.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.coalesce(day, F.lit("")).alias("day"), "ord", "away_id", "home_id", (F.col("away_runs") - F.col("home_runs")).cast("double").alias("m")))).alias("g"))
    none = F.create_map().cast("map<string,double>")
    at = lambda state, team: F.coalesce(F.try_element_at(state, team), F.lit(START))

    def play(state: Column, g: Column) -> Column:
        a, h = at(state, g["away_id"]), at(state, g["home_id"])
        expected = F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (h - a) / 400))
        actual = F.when(g["m"] > 0, 1.0).when(g["m"] < 0, 0.0).otherwise(0.5)
        change = clamp((F.ln(F.abs(g["m"]) + 1) * MARGIN_WEIGHT) * K_FACTOR * (actual - expected), -MOST, MOST)
        kept = F.map_filter(state, lambda k, _: (k != g["away_id"]) & (k != g["home_id"]))
        return F.map_concat(kept, F.create_map(g["away_id"], a + change, g["home_id"], h - change))

    rated = ordered.select(*keys, F.explode(F.aggregate("g", none, play)).alias("team_id", "elo"))
    return teams.select(*keys, "team_id").join(rated, [*keys, "team_id"], "left").withColumn("elo", F.coalesce("elo", F.lit(START)))


def power_ratings(games: DataFrame, teams: DataFrame, stats: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """PM9, W5: rating, its parts, trend and rank of every team."""
    t = stats.select(*keys, "team_id", "name", "ord", "games", "w", "l", "t", "pct", "rsg", "rag")
    for part in (net_sos(games, stats, keys), elo(games, teams, keys), margins(games, keys), recent_form(games, keys)):
        t = t.join(part, [*keys, "team_id"], "left")
    t = t.fillna(0.0, ["net_sos", "avg_margin", "volatility", "recent_form"])
    sample = clamp(F.col("games") / F.lit(5.0), 0.0, 1.0)
    t = t.withColumn("adj_net", (F.col("rsg") - F.col("rag")) * 0.7 + F.col("net_sos") * 0.3)
    rating = ((F.col("pct") - 0.5) * 18 + F.col("avg_margin") * 2.1) * (F.lit(0.35) + sample * 0.65) + F.col("adj_net") * 2.4 + (F.col("elo") - START) / 14 + F.col("recent_form") * 0.9
    trend = F.when(F.col("games") == 0, "New").when(F.col("recent_form") > F.col("avg_margin") + 1, "Up").when(F.col("recent_form") < F.col("avg_margin") - 1, "Down").otherwise("Stable")
    t = t.withColumns({"rating": rating, "trend": trend, "record": record_text(F.col("w"), F.col("l"), F.col("t"))})
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rating").desc(), "ord")).cast("long"))


def _tier(score: Column) -> Column:
    return F.when(score >= 82, "High").when(score >= 66, "Strong").when(score >= 46, "Moderate").otherwise("Low")


def league_predictions(games: DataFrame, power: DataFrame, h2h: DataFrame, quality: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """PM10: the forecast of each open game with confidence, factors and risks; neutral where data is insufficient."""
    reads = ["name", "games", "rating", "adj_net", "volatility", "recent_form"]
    g = remaining(games).select(*keys, "game_id", "away_id", "home_id")
    for p, side in (("a_", "away"), ("b_", "home")):
        g = g.join(power.select(*keys, F.col("team_id").alias(f"{side}_id"), *[F.col(c).alias(p + c) for c in reads]), [*keys, f"{side}_id"], "left")
    met = h2h.select(*keys, F.col("team_id").alias("away_id"), F.col("opp_id").alias("home_id"), "wins", "losses", "ties")
    g = g.join(met, [*keys, "away_id", "home_id"], "left").join(quality.select(*keys, "tier", "warnings"), list(keys), "left").join(league_scoring(games, keys), list(keys), "left")
    edge = F.coalesce((F.col("wins") - F.col("losses")) * 1.2, F.lit(0.0))
    g = g.withColumn("m", clamp((F.col("a_rating") - F.col("b_rating")) / 3.8 + (F.col("a_adj_net") - F.col("b_adj_net")) * 0.45 + edge, -24.0, 24.0))
    ok = F.coalesce(F.col("m").isNotNull() & (F.col("tier") != "Insufficient"), F.lit(False))
    least, wild = F.least("a_games", "b_games"), F.col("a_volatility") + F.col("b_volatility")
    bonus = F.when(F.col("tier") == "Limited", -18.0).when(F.col("tier") == "Developing", 0.0).when(F.col("tier") == "Strong", 9.0).when(F.col("tier") == "Excellent", 14.0).otherwise(-35.0)
    score = clamp(F.lit(42.0) + F.abs("m") * 3.1 + bonus - F.greatest(F.lit(0), F.lit(3) - least) * 13 - clamp(wild * 1.1, 0.0, 20.0), 5.0, 94.0)
    p = clamp(logistic(F.col("m") / 7.2), 0.08, 0.92)
    away_wins = F.col("m") >= 0
    fav = lambda c: F.when(away_wins, F.col("a_" + c)).otherwise(F.col("b_" + c))
    dog = lambda c: F.when(away_wins, F.col("b_" + c)).otherwise(F.col("a_" + c))
    factors = F.array_compact(F.array(
        F.format_string(SAID["s_owns_the_stronger_blended"], fav("name"), fav("rating"), dog("rating")),
        F.concat(fav("name"), F.lit(SAID["has_an_adjusted_net_rating"])),
        F.when(F.abs(fav("recent_form") - dog("recent_form")) >= 1, F.lit(SAID["recent_form_supports_the_projected"])),
        F.when(F.col("wins") + F.col("losses") + F.col("ties") > 0, F.lit(SAID["head_to_head_results_are"])),
    ))
    risks = F.concat("warnings", F.array_compact(F.array(F.when(least < 3, F.lit(SAID["small_sample_size_can_make"])), F.when(F.abs("m") < 3, F.lit(SAID["similar_team_ratings_create_a"])))))
    reasons = F.array_compact(F.array(
        F.when(least < 3, F.lit(SAID["confidence_is_reduced_because_at"])),
        F.when(F.abs("m") < 3, F.lit(SAID["projected_margin_is_tight_so"])),
        F.when(wild > 12, F.lit(SAID["recent_results_are_volatile_which"])),
    ))
    expected = lambda v: F.when(ok & (F.col("avg_runs") > 0), F.greatest(F.lit(0.0), half_up(v, 1)))
    return g.select(
        *keys, "game_id", F.col("away_id").alias("team_a"), F.col("home_id").alias("team_b"),
        F.when(ok, F.when(away_wins, F.col("away_id")).otherwise(F.col("home_id"))).alias("winner_id"),
        F.when(ok, half_up(F.abs("m"), 1)).alias("margin"),
        F.when(ok, half_up(p, 2)).otherwise(0.5).alias("p_a"), F.when(ok, half_up(F.lit(1.0) - p, 2)).otherwise(0.5).alias("p_b"),
        expected(F.col("avg_runs") + F.col("m") / 2).alias("score_a"), expected(F.col("avg_runs") - F.col("m") / 2).alias("score_b"),
        F.when(ok, half_up(score)).otherwise(12).cast("long").alias("confidence"), F.when(ok, _tier(score)).otherwise("Low").alias("confidence_tier"),
        F.when(ok, reasons).otherwise(F.array(F.lit(SAID["the_model_needs_completed_scores"]))).alias("reasons"),
        F.when(ok, factors).otherwise(F.array(F.lit(SAID["insufficient_completed_game_data"]))).alias("key_factors"),
        F.when(ok, risks).otherwise(F.col("warnings")).alias("risk_factors"), "tier",
    )


def accuracy(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """The number of games that ratings rest on."""
    return finals(games).groupBy(*keys).agg(F.count("*").alias("games_evaluated"))

