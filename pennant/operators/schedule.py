"""Schedules: filters and orders of games, generators, difficulty of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import display_name, match_score, week_ending
from pennant.operators.stats import SEASON, Keys, finals, is_final, remaining, team_games


def completed_by_date(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """FIL3: finals with seq, their place in the order of dates (1 first, undated last)."""
    w = Window.partitionBy(*keys).orderBy(F.col("game_date").asc_nulls_last(), "ord")
    return finals(games).withColumn("seq", F.row_number().over(w).cast("long"))


def games_of(games: DataFrame, team_id: str) -> DataFrame:
    """FIL4"""
    return games.where((F.col("away_id") == team_id) | (F.col("home_id") == team_id))


def completed_with_score(games: DataFrame) -> DataFrame:
    """FIL5: finals with both scores, and the away team's margin."""
    return finals(games).where("away_runs IS NOT NULL AND home_runs IS NOT NULL").withColumn("margin", F.col("away_runs") - F.col("home_runs"))


def scoreboard_order() -> list[Column]:
    """FIL6: open games first, of those the undated first, then by date and id."""
    open_undated = ~is_final() & F.col("game_date").isNull()
    return [is_final().asc(), F.when(open_undated, 0).otherwise(1).asc(), F.col("game_date").asc_nulls_last(), F.col("game_id").asc()]


def scoreboard(games: DataFrame, team_id: str | None = None, show: str = "all", today: Column | None = None, keys: Keys = SEASON) -> DataFrame:
    """FIL6, FIL7: games with place, for all teams or one; show is all, open or today."""
    g = games_of(games, team_id) if team_id else games
    g = g.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*scoreboard_order())).cast("long"))
    if show == "open":
        return g.where(~is_final())
    return g.where(F.date_format("game_date", "M/d") == F.date_format(today if today is not None else F.current_date(), "M/d")) if show == "today" else g


def next_open(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """FIL9: keys, game_id of the first open game on the scoreboard."""
    w = Window.partitionBy(*keys).orderBy(*scoreboard_order())
    return remaining(games).withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, "game_id")


def next_games(games: DataFrame, n: int = 1, keys: Keys = SEASON) -> DataFrame:
    """J12 (n = 1), W11 (n = 2): each team's next open games by date, with nth."""
    w = Window.partitionBy(*keys, "team_id").orderBy(F.col("game_date").asc_nulls_last(), "ord")
    return team_games(remaining(games), keys).withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n).select(*keys, "team_id", "opp_id", "side", "game_id", "game_date", "nth")


def recap_window(games: DataFrame, grouping: str = "date") -> DataFrame:
    """Games with window, the key of the recap they belong to: their id, date, or week's Sunday."""
    if grouping == "game":
        key: Column = F.col("game_id")
    else:
        key = F.date_format(week_ending(F.col("game_date")) if grouping == "week" else F.col("game_date"), "M/d")
    return games.withColumn("window", F.coalesce(key, F.lit("")))


def difficulty_scores(games: DataFrame, stats: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Keys, team_id, score: runs against what opponents usually allow and score, and the record."""
    opp = stats.select(*keys, F.col("team_id").alias("opp_id"), F.col("rag").alias("o_rag"), F.col("rsg").alias("o_rsg"), F.col("games").alias("o_games")).where("o_games > 0")
    played = team_games(finals(games), keys).join(opp, [*keys, "opp_id"]).groupBy(*keys, "team_id").agg(F.avg(F.col("runs") - F.col("o_rag")).alias("off"), F.avg(F.col("o_rsg") - F.col("opp_runs")).alias("dfn"))
    some = F.col("games") > 0
    league = stats.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(some, F.col("rsg"))), F.avg("rsg")).alias("lg_rsg"),
        F.coalesce(F.avg(F.when(some, F.col("rag"))), F.avg("rag")).alias("lg_rag"),
    )
    t = stats.join(played, [*keys, "team_id"], "left").join(league, list(keys))
    off, dfn = F.coalesce(F.col("off"), F.col("rsg") - F.col("lg_rag")), F.coalesce(F.col("dfn"), F.col("lg_rsg") - F.col("rag"))
    return t.select(*keys, "team_id", "name", "rsg", "rag", (off * 0.45 + dfn * 0.45 + (F.col("pct") - 0.5) * 6 * 0.1).alias("score"))


def schedule_difficulty(games: DataFrame, stats: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Keys, team_id, rating, label, opponents of each team's open games."""
    name = display_name(F.col("name"))
    scored = difficulty_scores(games, stats, keys)
    opp = scored.select(*keys, F.col("team_id").alias("opp_id"), "score", name.alias("shown"), F.format_string("%s (%.1f R/G, %.1f RA/G)", name, "rsg", "rag").alias("line"))
    left = team_games(remaining(games), keys).select(*keys, "team_id", "opp_id").join(opp, [*keys, "opp_id"], "left")
    shown = F.coalesce("shown", display_name(F.col("opp_id")))
    line = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), shown.alias("n"), F.coalesce("line", F.concat(shown, F.lit(" (no profile yet)"))).alias("line"))
    agg = left.groupBy(*keys, "team_id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("rating"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), ", ").alias("opponents"))
    out = stats.select(*keys, "team_id").join(agg, [*keys, "team_id"], "left")
    label = F.when(F.col("rating").isNull(), "Complete").when(F.col("rating") >= 1.25, "Hard").when(F.col("rating") >= -0.5, "Medium").otherwise("Easy")
    return out.select(*keys, "team_id", label.alias("label"), F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("opponents", F.lit("No games left")).alias("opponents"))


def round_robin(teams: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """SRC12, J9: each pair once, the earlier team away; games numbered in the order of the pairs."""
    a = teams.select(*keys, F.col("ord").alias("a"), F.col("team_id").alias("away_id"))
    h = teams.select(*keys, F.col("ord").alias("h"), F.col("team_id").alias("home_id"))
    p = a.join(h, list(keys)).where("a < h")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("a", "h"))
    return p.withColumn("ord", n.cast("long")).select(*keys, F.concat_ws("_", F.lit("game"), F.lpad(F.col("ord").cast("string"), 3, "0"), "away_id", "home_id").alias("game_id"), "ord", "away_id", "home_id")


# The teams and dates of the demo season.
DEMO_TEAMS = ["Northside Knockouts", "River City Rockets", "Metro Mashers", "Lakeside Legends", "Capital Crushers", "East End Eagles", "Westfield Whales", "Southtown Sluggers"]
DEMO_START, DEMO_FINALS = "2026-04-05", 18


def demo_season(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """SRC11: teams and games of the demo season: eight teams, weekly rounds of four, 18 finals."""
    from pennant.operators.validate import team_ids

    n = len(DEMO_TEAMS)
    rows = [("demo", i, name) for i, name in zip(team_ids(DEMO_TEAMS), DEMO_TEAMS, strict=True)]
    teams = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "season string, team_id string, name string, ord long")
    ids = F.array(*[F.lit(r[1]) for r in rows])
    g = spark.range((n - 1) * n // 2).select((F.col("id") / (n // 2)).cast("long").alias("r"), (F.col("id") % (n // 2)).alias("s"))
    g = g.select("r", F.pmod(F.col("r") + F.col("s"), F.lit(n)).alias("a"), F.pmod(F.lit(n - 1) - F.col("s") + F.col("r"), F.lit(n)).alias("h")).where("a <> h")
    g = g.withColumn("i", F.row_number().over(Window.orderBy("r", F.pmod(F.col("a") - F.col("r"), F.lit(n)))).cast("long"))
    final = F.col("i") <= DEMO_FINALS
    g = g.withColumns({"ar": F.col("i") * 3 + F.col("a"), "hr": F.col("i") * 5 + F.col("h")}).withColumns({"ar": F.col("ar") % 9 + 6, "hr": F.col("hr") % 9 + 5})
    hits = lambda runs, team: F.greatest(F.col(runs) + 3, (F.col("i") + F.col(team)) % 8 + 8)
    stat = lambda e, name: F.when(final, e).cast("long").alias(name)
    zero = [stat(F.lit(0), f"{s}_{x}") for s in ("away", "home") for x in ("errors", "walks")]
    games = g.select(
        F.lit("demo").alias("season"), F.format_string("demo-%02d", "i").alias("game_id"), F.col("i").alias("ord"),
        F.date_add(F.lit(DEMO_START).cast("date"), (F.col("r") * 7).cast("int")).alias("game_date"),
        F.element_at(ids, (F.col("a") + 1).cast("int")).alias("away_id"), F.element_at(ids, (F.col("h") + 1).cast("int")).alias("home_id"), final.alias("is_final"),
        stat(F.col("ar") + (F.col("ar") == F.col("hr")).cast("long"), "away_runs"), stat(F.col("hr"), "home_runs"),
        stat(hits("ar", "a"), "away_hits"), stat(hits("hr", "h"), "home_hits"),
        stat((F.col("i") + F.col("a")) % 6 + 2, "away_k"), stat((F.col("i") + F.col("h")) % 6 + 2, "home_k"), *zero, F.lit(6).cast("long").alias("innings"),
    )
    return teams, games


def found_commands(commands: DataFrame, queries: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """For each query (keys, query) the commands (keys, label, hint, ord) that match it by label or hint, best first, with score and place."""
    score = F.greatest(match_score(F.col("query"), F.col("label")), match_score(F.col("query"), F.col("hint")))
    hits = commands.join(queries, list(keys)).withColumn("score", score.cast("long")).where("score > 0")
    w = Window.partitionBy(*keys, "query").orderBy(F.desc("score"), "ord")
    return hits.withColumn("place", F.row_number().over(w).cast("long"))
