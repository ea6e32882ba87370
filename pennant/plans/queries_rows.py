"""Queries over the derived league: scalar functions, coercion, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.functions import scalars as fn
from pennant.operators import mutations, stats, validate
from pennant.plans import league
from pennant.plans.oracle import sql
from pennant.plans.queries_core import tidy


def _raw_logs(s: SparkSession, d: str) -> DataFrame:
    """Logs as untrusted texts: some blank, some no number, some out of range."""
    g = league.games(s, d)
    text = lambda c: F.when(F.col("ord") % 7 == 0, "").when(F.col("ord") % 11 == 0, "x").when(F.col("ord") % 13 == 0, "101").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cols = [f"{a}_{x}" for a in ("away", "home") for x in league.STATS]
    return g.select("season", "game_id", *[text(c).alias(c) for c in cols], F.when(F.col("ord") % 5 == 0, "").when(F.col("ord") % 3 == 0, "12").otherwise("6").alias("innings"), F.lit(True).alias("is_final"))


def _next(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An import against what is there: every ninth game is missing, every fourth rescored, every sixth open."""
    now = league.games(s, d).withColumn("date_text", F.date_format("game_date", "M/d"))
    new = now.where("ord % 9 <> 0").withColumns({"away_runs": F.when(F.col("ord") % 4 == 0, F.col("away_runs") + 1).otherwise(F.col("away_runs")), "is_final": F.col("is_final") & (F.col("ord") % 6 != 0)})
    return new, now


def _clamped(c: str, most: int) -> str:
    return f"CASE WHEN ord % 7 = 0 OR ord % 11 = 0 OR ({c} IS NULL AND ord % 13 <> 0) THEN '' WHEN ord % 13 = 0 THEN '{most}' ELSE CAST(least({most}, {c}) AS VARCHAR) END"


_NOISE = "trim(regexp_replace(regexp_replace(n, '(?i)\\b(8u|NKB|NKY|NKYA|Union|SOAS)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_FINAL = "away_runs <> '' AND home_runs <> '' AND away_k <> '' AND home_k <> ''"
_INN = "CASE WHEN ord % 5 = 0 THEN '1' WHEN ord % 3 = 0 THEN '10' ELSE '6' END"

ROWS = {
    "f5_display_names": (
        lambda s, d: league.team_names(s, d).select("team_id", fn.display_name(F.concat(F.lit("NKB "), "name", F.lit(" 8U"))).alias("shown"), fn.team_abbr(F.concat("name", F.lit(" Reds"))).alias("abbr")),
        f"SELECT team_id, {_NOISE} AS shown, 'NR' AS abbr FROM (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS team_id, 'NKB ' || n_name || ' 8U' AS n FROM nation)",
    ),
    "f7_records": (
        lambda s, d: stats.team_totals(league.games(s, d), league.teams(s, d)).select("season", "team_id", fn.record_text(F.col("w"), F.col("l"), F.col("t")).alias("record")),
        sql("totals", "SELECT season, team_id, w || '-' || l || CASE WHEN t > 0 THEN '-' || t ELSE '' END AS record FROM totals"),
    ),
    "f9_dates": (
        lambda s, d: league.games(s, d).select("season", "game_id", fn.normal_date(F.date_format("game_date", "yyyy-MM-dd")).alias("iso"), fn.normal_date(F.date_format("game_date", "MM/dd/yyyy")).alias("slash"), fn.date_label(F.col("game_date")).alias("label"), F.date_format(fn.week_ending(F.col("game_date")), "M/d").alias("week")),
        sql("games", "SELECT season, game_id, strftime(game_date, '%-m/%-d') AS iso, strftime(game_date, '%-m/%-d') AS slash, strftime(game_date, '%-m/%-d') AS label, strftime(game_date + CAST((7 - dayofweek(game_date)) % 7 AS INTEGER), '%-m/%-d') AS week FROM games"),
    ),
    "f20_wilson": (
        lambda s, d: tidy(s.range(0, 101).select("id", fn.wilson(F.col("id") / 100, F.lit(220)).alias("w")).select("id", "w.lower", "w.upper", "w.margin")),
        "SELECT id, round(lo + 1e-9, 6) + 0.0 AS lower, round(hi + 1e-9, 6) + 0.0 AS upper, round(greatest(p - lo, hi - p) + 1e-9, 6) + 0.0 AS margin FROM (SELECT id, p, greatest(0, least(1, c - s)) AS lo, greatest(0, least(1, c + s)) AS hi FROM (SELECT id, p, (p + 3.8416::DOUBLE / 440) / (1 + 3.8416::DOUBLE / 220) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / 220 + 3.8416::DOUBLE / (4 * 220 * 220)) / (1 + 3.8416::DOUBLE / 220) AS s FROM (SELECT id, id / 100.0::DOUBLE AS p FROM range(0, 101) t(id))))",
    ),
    "val4_logs": (
        lambda s, d: validate.coerce_logs(_raw_logs(s, d), league.games(s, d)).select("season", "game_id", "away_runs", "home_runs", "away_k", "home_k", "innings", "is_final"),
        sql("games", f"SELECT *, {_FINAL} AS is_final FROM (SELECT season, game_id, {_clamped('away_runs', 35)} AS away_runs, {_clamped('home_runs', 35)} AS home_runs, {_clamped('away_k', 99)} AS away_k, {_clamped('home_k', 99)} AS home_k, {_INN} AS innings FROM games)"),
    ),
    "rec1_added_removed_games": (lambda s, d: (n := _next(s, d)) and validate.added_removed(n[0], n[1], "game_id"), sql("games", "SELECT season, game_id, 'removed' AS change FROM games WHERE ord % 9 = 0")),
    "rec2_duplicates": (
        lambda s, d: validate.duplicates(_next(s, d)[1]).where("duplicate OR reversed").select("season", "game_id", "duplicate", "reversed"),
        sql("games", "SELECT season, game_id, dup AS duplicate, rev AS reversed FROM (SELECT g.season, g.game_id, row_number() OVER (PARTITION BY g.season, game_date, away_id, home_id ORDER BY ord) > 1 AS dup, coalesce(f.first < g.ord, false) AS rev FROM games g LEFT JOIN (SELECT season, game_date AS dt, away_id AS a, home_id AS h, min(ord) AS first FROM games GROUP BY 1, 2, 3, 4) f ON f.season = g.season AND f.dt = g.game_date AND f.a = g.home_id AND f.h = g.away_id) WHERE dup OR rev"),
    ),
    "rec3_changed_finals": (
        lambda s, d: (n := _next(s, d)) and validate.changed_finals(n[0], n[1]),
        sql("games", "SELECT season, game_id, CASE WHEN ord % 9 = 0 THEN 'removed' WHEN ord % 6 = 0 THEN 'downgraded' ELSE 'rescored' END AS change FROM games WHERE is_final AND (ord % 9 = 0 OR ord % 6 = 0 OR ord % 4 = 0)"),
    ),
    "rec8_pending_imports": (lambda s, d: validate.pending_imports(league.games(s, d)).select("season", "game_id", "is_final", "pending_verification"), sql("games", "SELECT season, game_id, false AS is_final, is_final AS pending_verification FROM games")),
    "mu2_toggled_finals": (lambda s, d: mutations.toggle_final(league.games(s, d), league.games(s, d).where("ord % 10 = 3")).select("season", "game_id", "is_final"), sql("games", "SELECT season, game_id, CASE WHEN ord % 10 = 3 THEN NOT is_final ELSE is_final END AS is_final FROM games")),
    "mu3_swapped_sides": (lambda s, d: mutations.swap_sides(league.games(s, d), league.games(s, d).where("ord % 2 = 0")).select("season", "game_id", "away_id", "home_id"), sql("games", "SELECT season, game_id, CASE WHEN ord % 2 = 0 THEN home_id ELSE away_id END AS away_id, CASE WHEN ord % 2 = 0 THEN away_id ELSE home_id END AS home_id FROM games")),
    "snk2_csv_cells": (
        lambda s, d: league.team_names(s, d).select("team_id", fn.csv_cell(F.concat(F.when(F.col("ord") % 2 == 0, "=").otherwise(""), "name", F.when(F.col("ord") % 3 == 0, ',"x"').otherwise(""))).alias("cell")),
        """SELECT team_id, CASE WHEN regexp_matches(v, '[",\\n\\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT team_id, CASE WHEN t[1] = '=' THEN chr(39) || t ELSE t END AS v FROM (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS team_id, CASE WHEN n_nationkey % 2 = 0 THEN '=' ELSE '' END || n_name || CASE WHEN n_nationkey % 3 = 0 THEN ',"x"' ELSE '' END AS t FROM nation))""",
    ),
}
