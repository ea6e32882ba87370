"""A season as a row of states: state k holds the first k finals. States are one more grouping key,
so statistics, ranks and predictions of all states come from the same operators in one plan.

A season with n finals has n * (n + 1) / 2 rows of games in its states; n is bounded by a season's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import date_label, display_name
from pennant.operators import standings, stats
from pennant.operators.asof import in_order
from pennant.operators.stats import SEASON, Keys, team_games
from pennant.settings import RUN_CAP, Settings

STATE = ("season", "state")


def states(games: DataFrame, teams: DataFrame, last: int | None = None, since: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(finals with seq, the games of each state, the teams of each state).

    last: only the latest finals count, as if the season had begun with them. since: only the
    states from that many finals before the end on are made, so rows grow with the finals, not with their square.
    """
    f = in_order(games)
    if last is not None:
        f = f.withColumns({"seq": F.col("seq") - F.greatest(F.col("n") - last, F.lit(0)), "n": F.least(F.col("n"), F.lit(last))}).where("seq >= 0")
    first = F.lit(0) if since is None else F.greatest(F.lit(0), F.col("n") - since)
    inside = f.withColumn("state", F.explode(F.sequence(F.greatest(F.col("seq") + 1, first).cast("int"), F.col("n").cast("int")))).drop("seq", "n")
    n = f.groupBy("season").agg(F.max("n").cast("int").alias("n"))
    rows = teams.join(n, "season").withColumn("state", F.explode(F.sequence(first.cast("int"), F.col("n")))).drop("n")
    return f.drop("n"), inside, rows


def state_games(games: DataFrame) -> DataFrame:
    """Season, state, n: how many finals each state holds, as running counts; no game has a row in each later state."""
    so_far = Window.partitionBy("season").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return in_order(games).select("season", (F.col("seq") + 1).cast("long").alias("state"), F.count("*").over(so_far).alias("n"))


def ranked_states(inside: DataFrame, rows: DataFrame, scheduled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rank and mathematical status of every team in every state. scheduled: season, team_id, scheduled games."""
    s = stats.team_stats(inside, rows, RUN_CAP, STATE)
    r = standings.rank_teams(s, stats.head_to_head(inside, STATE), settings, STATE)
    left = r.join(scheduled, ["season", "team_id"], "left").select("season", "state", "team_id", (F.coalesce("scheduled", F.lit(0)) - F.col("games")).cast("long").alias("remaining"))
    return standings.gold_status(r, left, settings, STATE)


def scheduled_games(games: DataFrame) -> DataFrame:
    return team_games(games).groupBy("season", "team_id").agg(F.count("*").alias("scheduled"))


def movements(games: DataFrame, teams: DataFrame, settings: Settings = Settings(), since: int | None = None) -> DataFrame:
    """Season, state, team_id, rank, status before and after each final, or each of the latest (since)."""
    _, inside, rows = states(games, teams, since=since)
    r = ranked_states(inside, rows, scheduled_games(games), settings)
    before = Window.partitionBy("season", "team_id").orderBy("state")
    return r.select("season", "state", "team_id", "name", "rank", "gold_status", F.lag("rank").over(before).alias("rank_before"), F.lag("gold_status").over(before).alias("status_before")).where("state > 0")


def season_timeline(games: DataFrame, teams: DataFrame, settings: Settings = Settings(), limit: int = 8) -> DataFrame:
    """The latest finals, newest first (nth): label, score, winner, movement, impact on the cut line."""
    cut = settings.gold_cutoff
    m = movements(games, teams, settings, limit)
    shown = display_name(F.col("name"))
    changed = F.col("status_before") != F.col("gold_status")
    message = (
        F.when((F.col("rank_before") > cut) & (F.col("rank") <= cut), F.concat(shown, F.lit(" moved into Gold")))
        .when((F.col("rank_before") <= cut) & (F.col("rank") > cut), F.concat(shown, F.lit(" dropped below Gold")))
        .when(changed & (F.col("gold_status") == "Clinched"), F.concat(shown, F.lit(" clinched Gold")))
        .when(changed & (F.col("gold_status") == "Eliminated"), F.concat(shown, F.lit(" were eliminated")))
    )
    moved = F.when(F.col("rank") < F.col("rank_before"), "climbed").when(F.col("rank") > F.col("rank_before"), "fell")
    line = F.when(moved.isNotNull(), F.concat(shown, F.lit(" "), moved, F.lit(" #"), F.col("rank_before").cast("string"), F.lit(" → #"), F.col("rank").cast("string")))
    m = m.withColumns({"shown": shown, "message": message, "line": line})
    f = in_order(games).where(F.col("seq") >= F.col("n") - limit).withColumn("state", F.col("seq") + 1)
    cut_lines = m.groupBy("season", "state").agg(F.min_by("message", F.when(F.col("message").isNotNull(), F.col("rank"))).alias("impact"))
    e = f.join(cut_lines, ["season", "state"])
    for side in ("away", "home"):
        e = e.join(m.select("season", "state", F.col("team_id").alias(f"{side}_id"), F.col("shown").alias(f"{side}_name"), F.col("line").alias(f"{side}_line")), ["season", "state", f"{side}_id"])
    winner = F.when(F.col("away_runs") > F.col("home_runs"), F.col("away_name")).when(F.col("away_runs") < F.col("home_runs"), F.col("home_name")).otherwise("Tie")
    day = date_label(F.col("game_date"))
    return e.select(
        "season", (F.col("n") - F.col("seq")).cast("long").alias("nth"), "game_id", day.alias("day"), F.concat_ws(" at ", "away_name", "home_name").alias("label"),
        F.concat_ws("-", F.col("away_runs").cast("string"), F.col("home_runs").cast("string")).alias("score"), winner.alias("winner"),
        F.array_join(F.array_compact(F.array("away_line", "home_line")), "; ").alias("movement"), F.coalesce("impact", F.concat(F.lit("Gold cut line held after "), day, F.lit("."))).alias("cut_line_impact"),
    )


def scores(tested: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Brier score, share of upsets among sure predictions, sample size."""
    upsets = F.count_if("upset")
    return tested.groupBy(*keys).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.coalesce(F.try_divide(F.count_if(F.col("upset") & F.col("captured")).cast("double"), upsets), F.lit(0.0)).alias("upset_capture"), F.count("*").alias("samples"))


def calibration(tested: DataFrame, bucket: float = 0.1, keys: Keys = SEASON) -> DataFrame:
    """Predicted and actual share in each bucket of the prediction."""
    i = F.least(F.floor(F.col("p") / bucket), F.lit(int(1 / bucket) - 1)).cast("long")
    b = tested.withColumn("bucket", i).groupBy(*keys, "bucket").agg(F.avg("p").alias("predicted"), F.avg("y").alias("actual"), F.count("*").alias("samples"))
    return b.withColumns({"low": F.col("bucket") * bucket, "high": (F.col("bucket") + 1) * bucket})
