"""Team statistics from final games. Every operator groups by the key columns, so many seasons,
or many states of many seasons, are computed side by side.

games: keys, game_id, ord, game_date, away_id, home_id, {away,home}_{runs,hits,k,errors,walks},
innings, is_final. teams: keys, team_id, name, ord.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import clamp, half_up, ratio
from pennant.settings import RUN_CAP

Keys = Sequence[str]
SEASON = ("season",)
STATS = ("runs", "hits", "k", "errors", "walks")


def is_final(c: str = "is_final") -> Column:
    """FIL1"""
    return F.coalesce(F.col(c), F.lit(False))


def finals(games: DataFrame) -> DataFrame:
    return games.where(is_final())


def remaining(games: DataFrame) -> DataFrame:
    """FIL2"""
    return games.where(~is_final())


def capped(diff: Column, cap: int) -> Column:
    """A2: a run difference within the cap; a cap of 0 is none."""
    cap = max(0, min(RUN_CAP, cap))
    return clamp(diff, -cap, cap) if cap else diff


def team_games(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Two rows for each game, one from either side, in one pass."""

    def side(me: str, other: str) -> Column:
        stats = [F.col(f"{s}_{x}").alias(("" if s == me else "opp_") + x) for s in (me, other) for x in STATS]
        return F.struct(F.col(f"{me}_id").alias("team_id"), F.col(f"{other}_id").alias("opp_id"), F.lit(me).alias("side"), *stats)

    both = games.select(*keys, "game_id", "ord", "game_date", "innings", "is_final", F.explode(F.array(side("away", "home"), side("home", "away"))).alias("t"))
    return both.select(*keys, "game_id", "ord", "game_date", "innings", "is_final", "t.*")


def of_known_teams(games: DataFrame, teams: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Games both of whose teams are known. Teams are few in each season, so each side is a hash join."""
    ids = teams.select(*keys, "team_id").distinct()
    for s in ("away", "home"):
        games = games.join(ids.withColumnRenamed("team_id", f"{s}_id"), [*keys, f"{s}_id"], "left_semi")
    return games


def team_totals(games: DataFrame, teams: DataFrame, cap: int = 8, keys: Keys = SEASON) -> DataFrame:
    """A1, A2, A9's sums: box-score totals of each team; teams without games keep a row of zeros."""
    tg = team_games(finals(games), keys)
    diff = F.col("runs") - F.col("opp_runs")
    away, home = F.col("side") == "away", F.col("side") == "home"
    total = lambda c, when=None: F.sum(F.col(c) if when is None else F.when(when, F.col(c)).otherwise(0))
    agg = tg.groupBy(*keys, "team_id").agg(
        F.count("*").alias("games"),
        F.count_if(diff > 0).alias("w"), F.count_if(diff < 0).alias("l"), F.count_if(diff == 0).alias("t"),
        total("runs").alias("rs"), total("opp_runs").alias("ra"), F.sum(capped(diff, cap)).alias("run_diff"),
        total("hits").alias("hits"), total("opp_hits").alias("hits_allowed"),
        total("k").alias("ks"), total("opp_k").alias("opp_ks"),
        total("errors").alias("errors"), total("opp_errors").alias("opp_errors"),
        total("walks").alias("walks_allowed"), total("opp_walks").alias("walks_received"),
        total("k", away).alias("away_ks"), total("innings", away).alias("away_inns"),
        total("k", home).alias("home_ks"), total("innings", home).alias("home_inns"),
    )
    names = [c for c in agg.columns if c not in (*keys, "team_id")]
    out = teams.select(*keys, "team_id", "name", "ord").join(agg, [*keys, "team_id"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in names})


def league_k6(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """A3: strikeouts in six innings, 4.5 up to 30 innings."""
    k, inn = F.sum(F.col("away_k") + F.col("home_k")), F.sum(F.col("innings") * 2)
    return finals(games).groupBy(*keys).agg(F.when(inn > 30, k.cast("double") / inn * 6).otherwise(4.5).alias("league_k6"))


def rates(totals: DataFrame) -> DataFrame:
    """A4, A5: what a team does in a game, and its strikeouts in six innings (null without innings)."""
    g = F.col("games")
    six = lambda k, inn: F.try_divide(k.cast("double"), inn) * 6
    per = {"rsg": "rs", "rag": "ra", "hpg": "hits", "kpg": "ks", "opp_kpg": "opp_ks", "errors_pg": "errors", "walks_allowed_pg": "walks_allowed", "walks_received_pg": "walks_received"}
    return totals.withColumns(
        {"pct": ratio(F.col("w") + F.col("t") * 0.5, g)}
        | {name: ratio(F.col(c), g) for name, c in per.items()}
        | {
            "hit_diff": F.col("hits") - F.col("hits_allowed"), "error_diff": F.col("opp_errors") - F.col("errors"), "walk_diff": F.col("walks_received") - F.col("walks_allowed"),
            "away_k6": six(F.col("away_ks"), F.col("away_inns")), "home_k6": six(F.col("home_ks"), F.col("home_inns")),
            "total_k6": six(F.col("away_ks") + F.col("home_ks"), F.col("away_inns") + F.col("home_inns")),
        }
    )


def base_tpi(rated: DataFrame, k6: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """The index before the schedule counts; league_k6 stays as a column."""
    out = rated.join(k6, list(keys), "left").withColumn("league_k6", F.coalesce("league_k6", F.lit(4.5)))
    contact = clamp(F.coalesce((F.col("league_k6") - F.col("total_k6")) * 0.35, F.lit(0.0)), -1.25, 1.25)
    return out.withColumn("base_tpi", F.when(F.col("games") > 0, clamp(ratio(F.col("run_diff"), F.col("games")), -8.0, 8.0) + F.col("pct") * 2 + contact).otherwise(0.0))


def team_stats(games: DataFrame, teams: DataFrame, cap: int = 8, keys: Keys = SEASON) -> DataFrame:
    """Everything about each team: totals, rates, index, schedule, difficulty, momentum."""
    base = base_tpi(rates(team_totals(games, teams, cap, keys)), league_k6(games, keys), keys)
    tg = team_games(finals(games), keys).join(base.select(*keys, F.col("team_id").alias("opp_id"), F.col("base_tpi").alias("opp_tpi"), (F.col("away_ks") + F.col("home_ks")).alias("opp_all_ks"), (F.col("away_inns") + F.col("home_inns")).alias("opp_inns"), "league_k6"), [*keys, "opp_id"])
    latest = Window.partitionBy(*keys, "team_id").orderBy(F.col("game_date").desc_nulls_first(), F.col("ord").desc())
    tg = tg.withColumn("age", F.row_number().over(latest) - 1)
    weight = F.when(F.col("age") < 6, F.pow(F.lit(0.72), F.col("age")))
    baseline = F.try_divide(F.col("opp_all_ks") + F.col("league_k6") * 2, F.col("opp_inns") + 12) * 6
    extra = F.when(F.col("side") == "home", F.col("opp_k").cast("double") / F.col("innings") * 6 - F.when(F.col("opp_inns") > 0, baseline).otherwise(F.col("league_k6")))
    agg = tg.groupBy(*keys, "team_id").agg(
        F.sum("opp_tpi").alias("opp_tpi_sum"),
        F.avg(extra).alias("extra"),
        F.sum((F.col("runs") - F.col("opp_runs")) * weight).alias("wd"),
        F.sum(F.col("opp_tpi") * weight).alias("wo"),
        F.sum(weight).alias("ws"),
    )
    out = base.join(agg, [*keys, "team_id"], "left")
    out = out.withColumn("sos", F.when(F.col("games") > 0, F.coalesce(F.col("opp_tpi_sum") / F.col("games"), F.lit(0.0))).otherwise(0.0))
    swing = clamp(F.col("wd") / F.col("ws") - F.col("run_diff") / F.col("games") + F.col("wo") / F.col("ws") * 0.18, -4.5, 4.5)
    return out.withColumns({"tpi": F.col("base_tpi") + F.col("sos") * 0.2, "machine_difficulty": clamp(F.coalesce("extra", F.lit(0.0)), -3.0, 3.0), "momentum": F.when(F.col("games") >= 3, swing).otherwise(0.0)}).drop("opp_tpi_sum", "extra", "wd", "wo", "ws")


def head_to_head(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Wins, losses, ties of each team against each opponent it met."""
    d = F.col("runs") - F.col("opp_runs")
    return team_games(finals(games), keys).groupBy(*keys, "team_id", "opp_id").agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def h2h_matrix(h2h: DataFrame, team_ids: Sequence[str], keys: Keys = SEASON) -> DataFrame:
    """one row per team, one column per opponent with the record against it."""
    cell = F.concat_ws("-", F.col("wins").cast("string"), F.col("losses").cast("string"), F.when(F.col("ties") > 0, F.col("ties").cast("string")))
    return h2h.groupBy(*keys, "team_id").pivot("opp_id", list(team_ids)).agg(F.first(cell))


def remaining_counts(games: DataFrame, totals: DataFrame, season_length: int = 0, keys: Keys = SEASON) -> DataFrame:
    """Keys, team_id, remaining: open games, or what is missing to the season's length if that is more."""
    left = team_games(remaining(games), keys).groupBy(*keys, "team_id").agg(F.count("*").alias("open_games"))
    n = F.coalesce("open_games", F.lit(0)).cast("long")
    if season_length > 0:
        n = F.greatest(n, F.lit(season_length) - F.col("games"))
    return totals.join(left, [*keys, "team_id"], "left").select(*keys, "team_id", n.alias("remaining"))


def points(win_points: float = 1.0, tie_points: float = 0.5) -> Column:
    """A13"""
    return F.col("w") * float(win_points) + F.col("t") * float(tie_points)


def league_averages(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """A10: the average box score of one side in a final game."""
    tg = team_games(finals(games), keys)
    bip = F.col("hits") + F.col("innings") * 3 - F.col("k")
    return tg.groupBy(*keys).agg(F.count("*").alias("team_games"), *[F.avg(x).alias(f"avg_{x}") for x in STATS], F.avg(bip).alias("avg_bip"))


def team_splits(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Each team's lines over all games, at home and away, by one rollup."""
    tg = team_games(finals(games), keys)
    bip = lambda p: F.sum(F.col(f"{p}hits") + F.col("innings") * 3 - F.col(f"{p}k"))
    agg = [F.count("*").alias("games")] + [F.sum(p + x).alias(p + x) for p in ("", "opp_") for x in STATS] + [bip("").alias("bip"), bip("opp_").alias("opp_bip")]
    grouped = tg.groupingSets([[*keys, "team_id"], [*keys, "team_id", "side"]], *keys, "team_id", "side").agg(*agg)
    return grouped.withColumn("split", F.coalesce("side", F.lit("overall"))).drop("side")


def pair_series(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Each pair's series: record of the smaller id, and its meetings in order."""
    tg = team_games(finals(games), keys).where("team_id < opp_id")
    d = F.col("runs") - F.col("opp_runs")
    meeting = F.struct("game_date", "ord", F.concat_ws(" ", F.date_format("game_date", "M/d"), F.concat_ws("-", F.col("runs").cast("string"), F.col("opp_runs").cast("string"))).alias("line"))
    out = tg.groupBy(*keys, "team_id", "opp_id").agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.sort_array(F.collect_list(meeting)).alias("m"))
    return out.withColumn("meetings", F.array_join(F.transform("m", lambda x: x["line"]), ", ")).drop("m")


def common_opponents(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """For each pair that met, the opponents that both have met."""
    met = team_games(finals(games), keys).select(*keys, "team_id", "opp_id").distinct()
    sets = met.groupBy(*keys, "team_id").agg(F.collect_set("opp_id").alias("opps"))
    pairs = met.where("team_id < opp_id").join(sets, [*keys, "team_id"]).join(sets.select(*keys, F.col("team_id").alias("opp_id"), F.col("opps").alias("other")), [*keys, "opp_id"])
    both = F.array_sort(F.array_intersect("opps", "other"))
    return pairs.select(*keys, "team_id", "opp_id", F.size(both).cast("long").alias("n_common"), F.array_join(both, ",").alias("common"))


def counts(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Final and open games, whether the season is over, the latest final's date."""
    return games.groupBy(*keys).agg(F.count_if(is_final()).alias("n_final"), F.count_if(~is_final()).alias("n_open"), F.max(F.when(is_final(), F.col("game_date"))).alias("latest_final")).withColumn("finalized", (F.col("n_open") == 0) & (F.col("n_final") > 0))


def league_scoring(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Runs of one side in a game."""
    return finals(games).groupBy(*keys).agg((F.sum(F.col("away_runs") + F.col("home_runs")) / (F.count("*") * 2)).alias("avg_runs"))


def margins(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Mean and population deviation of a team's margins."""
    d = F.col("runs") - F.col("opp_runs")
    return team_games(finals(games), keys).groupBy(*keys, "team_id").agg(F.avg(d).alias("avg_margin"), F.stddev_pop(d).alias("volatility"))


def net_sos(games: DataFrame, stats: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Mean run difference a game of the opponents met."""
    per = stats.select(*keys, F.col("team_id").alias("opp_id"), ratio(F.col("run_diff"), F.col("games")).alias("strength"))
    return team_games(finals(games), keys).join(per, [*keys, "opp_id"]).groupBy(*keys, "team_id").agg(F.avg("strength").alias("net_sos"))


def rounded(v: Column, scale: int = 6) -> Column:
    return half_up(v, scale)
