"""Scalar functions over columns of the league: rates, standings and results instead of made-up ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.functions import scalars as fn
from pennant.operators import bracket, predict, stats
from pennant.plans import league
from pennant.plans.oracle import sql
from pennant.plans.queries_core import stats_of, status_of, tidy
from pennant.plans.queries_models import _calibrated
from pennant.sources import schedule_csv

_WILSON = """(SELECT *, greatest(0, least(1, c - s)) AS lo, greatest(0, least(1, c + s)) AS hi FROM (
  SELECT *, (pct + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) AS c, 1.96::DOUBLE * sqrt(pct * (1 - pct) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.8416::DOUBLE / n) AS s FROM (SELECT *, games * {times} AS n FROM rates WHERE games > 0)))"""


def _rates(s: SparkSession, d: str) -> DataFrame:
    return stats_of(s, d).where("games > 0")


def _margin(times: int) -> Column:
    return fn.wilson(F.col("pct"), F.col("games") * times)["margin"]


def _race(s: SparkSession, d: str) -> DataFrame:
    """Standings with the winning percentage as the chance and the order of the teams as the projection."""
    return status_of(s, d).withColumns({"chance": F.col("pct") * 100 - 0.25, "projected": F.col("ord") + 1})


_RACE = "(SELECT *, pct * 100 - 0.25::DOUBLE AS chance, ord + 1 AS projected FROM status)"


def _items(s: SparkSession, d: str) -> DataFrame:
    """A recap item of every kind for each team, with and without a seed."""
    kinds = F.array(*map(F.lit, [*fn.RECAP_WEIGHTS, "other"]))
    text = F.when(F.col("ord") % 2 == 0, F.concat("name", F.lit(" to #3"))).otherwise(F.col("name"))
    return league.teams(s, d).select("season", "team_id", F.explode(kinds).alias("kind"), text.alias("text"))


_WEIGHTS = ", ".join(f"('{k}', {fn.RECAP_WEIGHTS.get(k, 40)}::BIGINT)" for k in [*fn.RECAP_WEIGHTS, "other"])


def _lists(s: SparkSession, d: str) -> DataFrame:
    """A season's teams as one list by lines and commas, with blanks and repetitions."""
    name = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" "), "name", F.lit(" ,"))).otherwise(F.col("name"))
    rows = F.sort_array(F.collect_list(F.struct("ord", name.alias("name"))))
    text = F.array_join(F.transform(rows, lambda r: r["name"]), "\r\n")
    return league.teams(s, d).groupBy("season").agg(F.concat(text, F.lit(",NATION_3,\n\n"), text).alias("text"))


SCALARS = {
    "f16_league_logits": (
        lambda s, d: tidy(_rates(s, d).select("season", "team_id", fn.logit((F.col("w") + 0.5) / (F.col("games") + 1.0)).alias("x"), fn.logistic(F.col("run_diff") / 10.0).alias("p"))),
        sql("rates", "SELECT season, team_id, ln(((w + 0.5::DOUBLE) / (games + 1)) / (1 - (w + 0.5::DOUBLE) / (games + 1))) AS x, 1 / (1 + exp(-run_diff / 10.0::DOUBLE)) AS p FROM rates WHERE games > 0", "x, p"),
    ),
    "f20_league_intervals": (
        lambda s, d: tidy(_rates(s, d).select("season", "team_id", fn.wilson(F.col("pct"), F.col("games")).alias("w")).select("season", "team_id", "w.*")),
        sql("rates", f"SELECT season, team_id, pct AS estimate, lo AS lower, hi AS upper, greatest(pct - lo, hi - pct) AS margin FROM {_WILSON.format(times=1)}", "estimate, lower, upper, margin"),
    ),
    "f21_league_margins": (
        lambda s, d: _rates(s, d).select("season", "team_id", fn.margin_text(_margin(40)).alias("text")),
        sql("rates", f"SELECT season, team_id, '±' || CAST(CASE WHEN greatest(pct - lo, hi - pct) > 0 THEN greatest(1, ceil(greatest(pct - lo, hi - pct) * 100)) ELSE 0 END AS BIGINT) || '%' AS text FROM {_WILSON.format(times=40)}"),
    ),
    "f22_league_confidence": (
        lambda s, d: _rates(s, d).select("season", "team_id", fn.projection_confidence(_margin(40) * 100, F.col("pct") * 100, F.col("w") - F.col("l")).alias("label")),
        sql("rates", f"SELECT season, team_id, CASE WHEN m >= 12 OR abs(p - 50) <= 12 OR v >= 3 THEN 'Too close' WHEN m >= 7 OR abs(p - 50) <= 25 OR v >= 2 THEN 'Volatile' ELSE 'Stable' END AS label FROM (SELECT season, team_id, greatest(pct - lo, hi - pct) * 100 AS m, pct * 100 AS p, abs(w - l) AS v FROM {_WILSON.format(times=40)})"),
    ),
    "f23_league_gold_texts": (
        lambda s, d: _race(s, d).select("season", "team_id", fn.gold_pct_text(F.col("gold_status"), F.col("chance")).alias("text")),
        sql("status", f"SELECT season, team_id, CASE WHEN gold_status <> 'Eliminated' AND chance > 0 AND chance < 1 THEN '<1%' WHEN gold_status <> 'Clinched' AND chance >= 99.5 THEN '99%+' WHEN gold_status <> 'Eliminated' AND chance <= 0.5 THEN '<1%' ELSE CAST(floor(chance + 0.5) AS BIGINT) || '%' END AS text FROM {_RACE}"),
    ),
    "f25_league_tones": (
        lambda s, d: _race(s, d).select("season", "team_id", fn.race_tone(F.col("gold_status"), F.col("rank"), F.col("projected"), F.col("chance"), 7).alias("tone")),
        sql("status", f"SELECT season, team_id, CASE WHEN gold_status = 'Clinched' THEN 'clinched' WHEN gold_status = 'Eliminated' THEN 'out' WHEN rank <= 7 AND chance >= 75 THEN 'safe' WHEN rank <= 7 THEN 'inside' WHEN chance >= 25 OR projected <= 7 THEN 'bubble' ELSE 'chasing' END AS tone FROM {_RACE}"),
    ),
    "f27_league_upset_risks": (
        lambda s, d: stats.finals(league.games(s, d)).select("season", "game_id", fn.upset_risk(0.5 + F.abs(F.col("away_hits") - F.col("home_hits")) / 40.0, F.abs(F.col("away_runs") - F.col("home_runs"))).alias("risk")),
        sql("games", "SELECT season, game_id, CASE WHEN 0.5::DOUBLE + abs(away_hits - home_hits) / 40.0::DOUBLE < 0.58::DOUBLE OR abs(away_runs - home_runs) <= 2 THEN 'High' WHEN 0.5::DOUBLE + abs(away_hits - home_hits) / 40.0::DOUBLE < 0.7::DOUBLE OR abs(away_runs - home_runs) <= 5 THEN 'Medium' ELSE 'Low' END AS risk FROM games WHERE is_final"),
    ),
    "f33_league_weights": (
        lambda s, d: _items(s, d).select("season", "team_id", "kind", fn.recap_weight(F.col("kind"), F.col("text")).cast("long").alias("weight")),
        sql("games", f"SELECT season, team_id, kind, CASE WHEN kind = 'rank-change' AND ord % 2 = 1 THEN 45 ELSE weight END AS weight FROM teams, (VALUES {_WEIGHTS}) v(kind, weight)"),
    ),
    "f34_league_deltas": (
        lambda s, d: _rates(s, d).select("season", "team_id", fn.delta_text((F.col("run_diff") * 4 + F.col("hits") % 3) / 7.0).alias("text")),
        sql("rates", "SELECT season, team_id, CASE WHEN abs((run_diff * 4 + hits % 3) / 7.0::DOUBLE) < 0.05 THEN '0.0' ELSE printf('%+.1f', (run_diff * 4 + hits % 3) / 7.0::DOUBLE) END AS text FROM rates WHERE games > 0"),
    ),
    "f44_league_winner_labels": (
        lambda s, d: bracket.winner_label(league.games(s, d).select("season", "game_id", F.when(F.col("is_final"), "actual").when(F.col("ord") % 4 == 0, "bye").when(F.col("ord") % 4 == 1, "projected").when(F.col("ord") % 4 == 2, "none").alias("winner_source"))),
        sql("games", "SELECT season, game_id, winner_source, CASE winner_source WHEN 'actual' THEN 'Final' WHEN 'bye' THEN 'Bye' WHEN 'projected' THEN 'Projected' ELSE 'Pending' END AS winner_label FROM (SELECT season, game_id, CASE WHEN is_final THEN 'actual' WHEN ord % 4 = 0 THEN 'bye' WHEN ord % 4 = 1 THEN 'projected' WHEN ord % 4 = 2 THEN 'none' END AS winner_source FROM games)"),
    ),
    "pm5_league_calibration": (
        lambda s, d: tidy(_rates(s, d).select("season", "team_id", predict.calibrate(F.col("pct"), F.col("games"), 1.0).alias("calibrated"))),
        sql("rates", f"SELECT season, team_id, {_calibrated('pct', 1.0).replace('(a_games + h_games)', 'games')} AS calibrated FROM rates WHERE games > 0", "calibrated"),
    ),
    "src13_league_team_lists": (
        lambda s, d: _lists(s, d).select("season", F.posexplode(schedule_csv.listed_teams(F.col("text"))).alias("i", "name")).select("season", F.col("i").cast("long"), "name"),
        sql("games", "SELECT season, row_number() OVER (PARTITION BY season ORDER BY ord) - 1 AS i, name FROM teams"),
    ),
}
