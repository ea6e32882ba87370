"""Queries over the derived league: statistics and standings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.operators import standings as st
from pennant.operators import stats as s
from pennant.plans import league
from pennant.plans.oracle import RANKED, sql
from pennant.plans.tables import derived
from pennant.settings import Settings


def six_decimals(c: Column) -> Column:
    """c rounded off exact ties, which sums in another order can miss."""
    return F.round(c + 1e-9, 6) + 0.0


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals, whole numbers as longs: what the oracles give."""
    kinds = {"double": six_decimals, "int": lambda c: c.cast("long")}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def _games(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return league.games(spark, d), league.teams(spark, d)


def stats_of(spark: SparkSession, d: str, settings: Settings = Settings()) -> DataFrame:
    """The teams' statistics, derived once for a state of the tables: every query that ranks or predicts reads them."""
    return derived(spark, league.sources(d), f"stats {settings.max_run_differential}", lambda: s.team_stats(*_games(spark, d), settings.max_run_differential))


def h2h_of(spark: SparkSession, d: str) -> DataFrame:
    """Records of team against team, derived once like the statistics."""
    return derived(spark, league.sources(d), "h2h", lambda: s.head_to_head(league.games(spark, d)))


def ranked_of(spark: SparkSession, d: str, settings: Settings = Settings()) -> DataFrame:
    return st.rank_teams(stats_of(spark, d, settings), h2h_of(spark, d), settings)


def status_of(spark: SparkSession, d: str, settings: Settings = Settings()) -> DataFrame:
    g = league.games(spark, d)
    ranked = ranked_of(spark, d, settings)
    return st.gold_status(ranked, s.remaining_counts(g, ranked), settings)


_TOTALS = "season, team_id, games, w, l, t, rs, ra, run_diff, hits, hits_allowed, ks, opp_ks, errors, opp_errors, walks_allowed, walks_received"
_RATES = "pct, rsg, rag, hpg, kpg, opp_kpg, errors_pg, walks_allowed_pg, walks_received_pg"
_K6 = "away_k6, home_k6, total_k6"
_INDEX = "base_tpi, sos, tpi, machine_difficulty, momentum"


def _pick(df: DataFrame, cols: str) -> DataFrame:
    return tidy(df.select(*[c.strip() for c in cols.split(",")]))


def _standings(spark: SparkSession, d: str) -> DataFrame:
    return _pick(ranked_of(spark, d), "season, rank, team_id, name, w, l, t, pct, rs, ra, run_diff, tpi")


#: name: (query, SQL)
CORE = {
    "w1_standings": (_standings, sql("ranked", "SELECT season, rank, team_id, name, w, l, t, pct, rs, ra, run_diff, tpi FROM ranked", "pct, tpi")),
    "src_league_games": (
        lambda spark, d: league.games(spark, d),
        sql("games", "SELECT season, game_id, ord, game_date, away_id, home_id, is_final, " + ", ".join(f"{a}_{x}" for a in ("away", "home") for x in league.STATS) + ", innings FROM games"),
    ),
    "j1_games_with_logs": (lambda spark, d: _pick(league.games(spark, d).groupBy("season").agg(F.count("*").alias("n"), F.count("away_runs").alias("with_runs")), "season, n, with_runs"), sql("games", "SELECT season, count(*) AS n, count(away_runs) AS with_runs FROM games GROUP BY season")),
    "j2_known_teams": (
        lambda spark, d: s.of_known_teams(league.games(spark, d), league.teams(spark, d).where("ord < 20")).select("season", "game_id", "away_id", "home_id"),
        sql("games", "SELECT g.season, game_id, away_id, home_id FROM games g WHERE away_id IN (SELECT team_id FROM teams WHERE ord < 20) AND home_id IN (SELECT team_id FROM teams WHERE ord < 20)"),
    ),
    "fil1_finals": (lambda spark, d: s.finals(league.games(spark, d)).select("season", "game_id", "away_runs", "home_runs"), sql("games", "SELECT season, game_id, away_runs, home_runs FROM games WHERE is_final")),
    "fil2_remaining_games": (lambda spark, d: s.remaining(league.games(spark, d)).select("season", "game_id", "away_id", "home_id"), sql("games", "SELECT season, game_id, away_id, home_id FROM games WHERE NOT is_final")),
    "p2_team_games": (lambda spark, d: s.team_games(s.finals(league.games(spark, d))).select("season", "game_id", "team_id", "opp_id", "side", "runs", "opp_runs", "hits", "k"), sql("tg", "SELECT season, game_id, team_id, opp_id, side, runs, opp_runs, hits, k FROM tg")),
    "a1_team_totals": (lambda spark, d: _pick(s.team_totals(*_games(spark, d)), _TOTALS), sql("totals", f"SELECT {_TOTALS} FROM totals")),
    "a2_run_diff_uncapped": (
        lambda spark, d: _pick(s.team_totals(*_games(spark, d), cap=0), "season, team_id, run_diff"),
        sql("totals", "SELECT season, team_id, rs - ra AS run_diff FROM totals"),
    ),
    "a3_league_k6": (lambda spark, d: tidy(s.league_k6(league.games(spark, d))), sql("base", "SELECT * FROM k6", "league_k6")),
    "a4_rates": (lambda spark, d: _pick(s.rates(s.team_totals(*_games(spark, d))), f"season, team_id, {_RATES}, hit_diff, error_diff, walk_diff"), sql("rates", f"SELECT season, team_id, {_RATES}, hit_diff, error_diff, walk_diff FROM rates", _RATES)),
    "a5_k6": (lambda spark, d: _pick(s.rates(s.team_totals(*_games(spark, d))), f"season, team_id, {_K6}"), sql("rates", f"SELECT season, team_id, {_K6} FROM rates", _K6)),
    "a6_base_tpi": (lambda spark, d: _pick(stats_of(spark, d), "season, team_id, base_tpi"), sql("base", "SELECT season, team_id, base_tpi FROM base", "base_tpi")),
    "a7_sos_tpi": (lambda spark, d: _pick(stats_of(spark, d), "season, team_id, sos, tpi"), sql("stats", "SELECT season, team_id, sos, tpi FROM stats", "sos, tpi")),
    "a8_machine_difficulty": (lambda spark, d: _pick(stats_of(spark, d), "season, team_id, machine_difficulty"), sql("stats", "SELECT season, team_id, machine_difficulty FROM stats", "machine_difficulty")),
    "a9_head_to_head": (lambda spark, d: s.head_to_head(league.games(spark, d)), sql("h2h", "SELECT * FROM h2h")),
    "a10_league_averages": (
        lambda spark, d: tidy(s.league_averages(league.games(spark, d))),
        sql("tg", "SELECT season, count(*) AS team_games, " + ", ".join(f"avg({x}) AS avg_{x}" for x in s.STATS) + ", avg(hits + innings * 3 - k) AS avg_bip FROM tg GROUP BY season", ", ".join(f"avg_{x}" for x in (*s.STATS, "bip"))),
    ),
    "a11_team_splits": (
        lambda spark, d: tidy(s.team_splits(league.games(spark, d))),
        sql("tg", "SELECT season, team_id, count(*) AS games, " + ", ".join(f"CAST(sum({p}{x}) AS BIGINT) AS {p}{x}" for p in ("", "opp_") for x in s.STATS) + ", CAST(sum(hits + innings * 3 - k) AS BIGINT) AS bip, CAST(sum(opp_hits + innings * 3 - opp_k) AS BIGINT) AS opp_bip, coalesce(side, 'overall') AS split FROM tg GROUP BY GROUPING SETS ((season, team_id), (season, team_id, side))"),
    ),
    "a12_remaining_counts": (
        lambda spark, d: tidy(s.remaining_counts(league.games(spark, d), s.team_totals(*_games(spark, d)), 12)),
        sql("totals", "SELECT t.season, t.team_id, greatest(coalesce(n, 0), 12 - games) AS remaining FROM totals t LEFT JOIN (SELECT season, team_id, count(*) AS n FROM all_tg WHERE NOT is_final GROUP BY 1, 2) USING (season, team_id)"),
    ),
    "a13_points": (lambda spark, d: tidy(s.team_totals(*_games(spark, d)).select("season", "team_id", s.points(3, 1).alias("points"))), sql("totals", "SELECT season, team_id, w * 3.0::DOUBLE + t * 1.0::DOUBLE AS points FROM totals", "points")),
    "a15_league_scoring": (lambda spark, d: tidy(s.league_scoring(league.games(spark, d))), sql("tg", "SELECT season, avg(runs) AS avg_runs FROM tg GROUP BY season", "avg_runs")),
    "a16_margins": (lambda spark, d: tidy(s.margins(league.games(spark, d))), sql("tg", "SELECT season, team_id, avg(runs - opp_runs) AS avg_margin, stddev_pop(runs - opp_runs) AS volatility FROM tg GROUP BY season, team_id", "avg_margin, volatility")),
    "a17_net_sos": (
        lambda spark, d: tidy(s.net_sos(league.games(spark, d), s.team_totals(*_games(spark, d)))),
        sql("totals", "SELECT g.season, g.team_id, avg(o.run_diff::DOUBLE / o.games) AS net_sos FROM tg g JOIN totals o ON g.season = o.season AND g.opp_id = o.team_id GROUP BY 1, 2", "net_sos"),
    ),
    "a23_cut_line": (
        lambda spark, d: tidy(st.cut_line(status_of(spark, d))),
        sql("status", "SELECT season, max(team_id) FILTER (WHERE rank = 7) AS last_in, max(team_id) FILTER (WHERE rank = 8) AS first_out, max(points) FILTER (WHERE rank = 7) - max(points) FILTER (WHERE rank = 8) AS gap FROM status GROUP BY season", "gap"),
    ),
    "a24_pair_series": (
        lambda spark, d: s.pair_series(league.games(spark, d)),
        sql("tg", "SELECT season, team_id, opp_id, count(*) FILTER (WHERE runs > opp_runs) AS wins, count(*) FILTER (WHERE runs < opp_runs) AS losses, count(*) FILTER (WHERE runs = opp_runs) AS ties, string_agg(strftime(game_date, '%-m/%-d') || ' ' || runs || '-' || opp_runs, ', ' ORDER BY game_date, ord) AS meetings FROM tg WHERE team_id < opp_id GROUP BY 1, 2, 3"),
    ),
    "a26_game_counts": (
        lambda spark, d: s.counts(league.games(spark, d)),
        sql("games", "SELECT season, count(*) FILTER (WHERE is_final) AS n_final, count(*) FILTER (WHERE NOT is_final) AS n_open, max(game_date) FILTER (WHERE is_final) AS latest_final, count(*) FILTER (WHERE NOT is_final) = 0 AND count(*) FILTER (WHERE is_final) > 0 AS finalized FROM games GROUP BY season"),
    ),
    "f39_h2h_matrix": (
        lambda spark, d: s.h2h_matrix(s.head_to_head(league.games(spark, d)), ["N00", "N01", "N02", "N03"]),
        sql("h2h", "SELECT season, team_id, " + ", ".join(f"max(wins || '-' || losses || CASE WHEN ties > 0 THEN '-' || ties ELSE '' END) FILTER (WHERE opp_id = '{o}') AS {o}" for o in ("N00", "N01", "N02", "N03")) + " FROM h2h GROUP BY season, team_id"),
    ),
    "j10_common_opponents": (
        lambda spark, d: s.common_opponents(league.games(spark, d)),
        sql(
            "tg",
            "SELECT p.season, p.team_id, p.opp_id, count(b.opp_id) AS n_common, coalesce(string_agg(b.opp_id, ',' ORDER BY b.opp_id), '') AS common FROM (SELECT * FROM met WHERE team_id < opp_id) p LEFT JOIN met a ON a.season = p.season AND a.team_id = p.team_id LEFT JOIN met b ON b.season = p.season AND b.team_id = p.opp_id AND b.opp_id = a.opp_id GROUP BY 1, 2, 3",
            more="met AS (SELECT DISTINCT season, team_id, opp_id FROM tg)",
        ),
    ),
    "w2_pair_tiebreak": (
        lambda spark, d: _pick(ranked_of(spark, d, Settings(tiebreaker_order=("headToHead",))), "season, rank, team_id"),
        sql("h2h", "SELECT season, row_number() OVER (PARTITION BY season ORDER BY grp, h2h_edge DESC, round(tpi, 4) DESC, team_id) AS rank, team_id FROM keyed", more=RANKED),
    ),
    "w3_momentum": (lambda spark, d: _pick(stats_of(spark, d), "season, team_id, momentum"), sql("stats", "SELECT season, team_id, momentum FROM stats", "momentum")),
    "w8_sos_ranks": (lambda spark, d: st.sos_ranks(stats_of(spark, d).withColumn("sos", F.round("sos", 6))), sql("stats", "SELECT season, team_id, row_number() OVER (PARTITION BY season ORDER BY round(sos, 6) DESC, team_id) AS sos_rank FROM stats")),
    "f32_gold_status": (lambda spark, d: _pick(status_of(spark, d), "season, team_id, rank, points, remaining, max_points, blockers_ahead, catchers, gold_status"), sql("status", "SELECT season, team_id, rank, points, remaining, max_points, blockers_ahead, catchers, gold_status FROM status", "points, max_points")),
    "f24_title_race": (
        lambda spark, d: st.title_race(status_of(spark, d)),
        sql("status", "SELECT s.season, s.team_id, CASE WHEN s.rank = 1 THEN 'Title Leader' WHEN s.max_points < l.points THEN 'Title Eliminated' WHEN (l.w - s.w + (s.l - l.l) + (l.t - s.t) * 0.5) / 2 <= 2 AND s.rank <= 5 THEN 'Title Contender' ELSE '' END AS badge FROM status s JOIN status l ON s.season = l.season AND l.rank = 1"),
    ),
    "val9_effective_cutoff": (lambda spark, d: st.effective_cutoff(league.teams(spark, d), 30), sql("games", "SELECT season, greatest(1, least(30, count(*))) AS cutoff FROM teams GROUP BY season")),
}
