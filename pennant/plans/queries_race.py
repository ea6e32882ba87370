"""Queries over the derived league: projections, odds, scenarios, exact mathematics, brackets, changes, texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.functions import scalars as fn
from pennant.operators import bracket, changes, power, predict, race, schedule, simulate, standings, states, stats
from pennant.plans import league
from pennant.plans.oracle import sql
from pennant.plans.queries_core import h2h_of, stats_of, tidy
from pennant.plans.tables import derived, written
from pennant.settings import TREND_ITERATIONS, Settings


class Race:
    """The relations that the queries share, each written when it is first asked for; those of the tables as they are once in an application."""

    def __init__(self, spark: SparkSession, sf_dir: str, games: DataFrame | None = None, settings: Settings = Settings(), of: str = ""):
        """games: other than the tables' own; of: what they are, if they follow from the tables alone."""
        self.spark, self.settings, self.dir, self.own, self.of = spark, settings, sf_dir, games is not None, of
        self.games = league.games(spark, sf_dir) if games is None else self._kept("games", lambda: games)
        self.teams = league.teams(spark, sf_dir)

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return written(make()) if self.own and not self.of else derived(self.spark, league.sources(self.dir), f"race {self.of}{name} {self.settings}", make)

    @cached_property
    def stats(self) -> DataFrame:
        return self._kept("stats", lambda: stats.team_stats(self.games, self.teams, self.settings.max_run_differential)) if self.own else stats_of(self.spark, self.dir, self.settings)

    @cached_property
    def h2h(self) -> DataFrame:
        return self._kept("h2h", lambda: stats.head_to_head(self.games)) if self.own else h2h_of(self.spark, self.dir)

    @cached_property
    def left(self) -> DataFrame:
        return self._kept("left", lambda: stats.remaining_counts(self.games, self.stats))

    @cached_property
    def status(self) -> DataFrame:
        return self._kept("status", lambda: standings.gold_status(standings.rank_teams(self.stats, self.h2h, self.settings), self.left, self.settings))

    @cached_property
    def fold(self) -> DataFrame:
        return self._kept("fold", lambda: simulate.fold_teams(self.stats, self.h2h))

    @cached_property
    def open(self) -> DataFrame:
        return self._kept("open", lambda: simulate.open_games(self.games))

    @cached_property
    def projected(self) -> DataFrame:
        return self._kept("projected", lambda: simulate.project(self.fold, self.open, self.settings))

    @cached_property
    def odds(self) -> DataFrame:
        return self._kept("odds", lambda: simulate.gold_odds(self.fold, self.games, self.settings))

    @cached_property
    def board(self) -> DataFrame:
        return self._kept("board", lambda: simulate.dashboard(self.status, self.projected, self.odds, self.settings))

    @cached_property
    def plain_board(self) -> DataFrame:
        """The ranks now and projected, where odds aren't read."""
        return self._kept("plain_board", lambda: simulate.dashboard(self.status, self.projected, self.projected.select("season", "team_id", F.lit(0.0).alias("odds")), self.settings))

    @cached_property
    def predicted(self) -> DataFrame:
        return self._kept("predicted", lambda: predict.predictions(stats.remaining(self.games), self.stats, self.h2h, self.settings))

    @cached_property
    def scenarios(self) -> DataFrame:
        """Fifty rows for each open game: they are not written."""
        return simulate.scenarios(self.fold, self.open, self.settings)

    @cached_property
    def own_games(self) -> DataFrame:
        return self._kept("own_games", lambda: race.own_games(self.games, simulate.own_seeds(self.fold, self.open, self.settings)))

    @cached_property
    def swings(self) -> DataFrame:
        """Only games that are among the next two of a team go either way: their number doesn't grow with the season."""
        nxt = schedule.next_games(self.games, 2)
        return self._kept("swings", lambda: race.swing_games(race.own_scenarios(self.games, simulate.scenarios(self.fold, self.open, self.settings, only=nxt)), self.projected, self.predicted))

    @cached_property
    def exact(self) -> DataFrame:
        return self._kept("exact", lambda: simulate.exact_status(self.fold, self.open, self.settings))

    @cached_property
    def impacts(self) -> DataFrame:
        return self._kept("impacts", lambda: race.game_impacts(self.own_games, self.predicted))

    @cached_property
    def pairs(self) -> DataFrame:
        return race.open_pairs(self.games, self.predicted)

    @cached_property
    def one_result(self) -> DataFrame:
        return self._kept("one_result", lambda: race.pair_status(self.pairs, self.stats, self.h2h, self.left, self.settings))

    @cached_property
    def brackets(self) -> DataFrame:
        return self._kept("brackets", lambda: bracket.gold_and_silver(self.board, self.fold, no_results(self.spark), self.settings))


def no_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "season string, game_id string, home_runs long, away_runs long, is_final boolean")


def _trend(spark: SparkSession, d: str) -> DataFrame:
    """MC4, W10: odds in each of the states that the last eight finals make."""
    settings = Settings()
    g, t = league.games(spark, d), league.teams(spark, d)
    f, inside, rows = map(written, states.states(written(g), written(t), last=8))
    s = stats.team_stats(inside, rows, settings.max_run_differential, states.STATE)
    teams = written(simulate.fold_teams(s, stats.head_to_head(inside, states.STATE), states.STATE).where("state > 0"))
    n = f.groupBy("season").agg((F.max("seq") + 1).cast("int").alias("n"))
    # a game is a final in the states after it; each is sent once, whatever the number of states
    every = g.join(f.select("season", "game_id", (F.col("seq") + 1).alias("since")), ["season", "game_id"], "left").select("season", "ord", "game_id", "away_id", "home_id", "since")
    extras = F.concat(F.lit("trend-"), F.col("state").cast("string"), F.lit(f"-{settings.gold_cutoff}-{settings.model_aggression}"))
    ids = every.groupBy("season").agg(F.sort_array(F.collect_list(F.struct(F.concat("game_id", F.lit("|")).alias("id"), "since"))).alias("all")).join(n, "season")
    ids = ids.withColumn("state", F.explode(F.sequence(F.lit(1), F.col("n"))))
    text = F.array_join(F.transform("all", lambda x: F.concat(x["id"], F.when(x["since"] <= F.col("state"), "F").otherwise("O"))), ",")
    seeds = ids.select("season", "state", F.concat(extras, F.lit("::"), text).alias("seed_text"))
    hits = simulate.simulate_states(teams, every, seeds, settings, TREND_ITERATIONS)
    return tidy(simulate.converged_odds(hits, TREND_ITERATIONS, states.STATE))


def _moves(spark: SparkSession, d: str, grouping: str = "date") -> tuple[Race, Race, DataFrame, DataFrame]:
    """Both snapshots around the latest recap window, the moves between them, the window's finals; each derived once."""
    after, sources = Race(spark, d), league.sources(d)
    games, window = changes.before_window(after.games, grouping)
    window = derived(spark, sources, f"window {grouping}", lambda: window)
    before = Race(spark, d, games, of=f"before {grouping} ")
    return before, after, derived(spark, sources, f"moves {grouping}", lambda: changes.rank_moves(before.board, after.board)), window


def _recap(spark: SparkSession, d: str) -> DataFrame:
    _, after, moves, window = _moves(spark, d)
    return written(changes.weekly_recap(moves, window, after.teams))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    before, after, _, _ = _moves(spark, d)
    return written(changes.diff(changes.snapshot(before.board, before.games), changes.snapshot(after.board, after.games)))


def _team_detail(spark: SparkSession, d: str) -> DataFrame:
    r = Race(spark, d)
    difficulty = schedule.schedule_difficulty(r.games, r.stats).select("season", "team_id", F.col("label").alias("difficulty"), "rating")
    return tidy(race.team_detail(r.board, race.bubble_tiers(r.board), standings.sos_ranks(r.stats), race.seed_ranges(r.own_games, r.projected), difficulty, standings.title_race(r.status), r.exact))


_DAY = "2026-05-10"

RACE = {
    "mc2_projected_standings": (lambda s, d: Race(s, d).projected, ""),
    "mc3_gold_odds": (lambda s, d: tidy(Race(s, d).odds), ""),
    "mc4_odds_trend": (_trend, ""),
    "mc5_exact_status": (lambda s, d: Race(s, d).exact, ""),
    "mc6_elimination_numbers": (lambda s, d: Race(s, d).exact.where("losses_to_out IS NOT NULL").select("season", "team_id", "losses_to_out"), ""),
    "mc7_seeding_locked": (lambda s, d: (r := Race(s, d)) and simulate.seeding_locked(r.fold, r.open), ""),
    "mc8_scenarios": (lambda s, d: Race(s, d).scenarios, ""),
    "mc9_seed_ranges": (lambda s, d: (r := Race(s, d)) and race.seed_ranges(r.own_games, r.projected), ""),
    "mc10_swing_games": (lambda s, d: tidy(Race(s, d).swings), ""),
    "mc11_game_impacts": (lambda s, d: Race(s, d).impacts, ""),
    "mc12_control_levels": (lambda s, d: (r := Race(s, d)) and race.control_levels(r.board, simulate.win_out(r.fold, r.open), r.swings), ""),
    "mc13_game_badges": (lambda s, d: (r := Race(s, d)) and race.game_badges(r.games, r.pairs, r.one_result, r.status, r.impacts), ""),
    "mc14_brackets": (lambda s, d: tidy(Race(s, d).brackets), ""),
    "mc14_champions": (lambda s, d: bracket.champions(Race(s, d).brackets), ""),
    "mc15_clinching_paths": (lambda s, d: tidy((r := Race(s, d)) and race.clinching_paths(r.games, r.board, r.exact, r.swings)), ""),
    "mc16_clinch_scenarios": (lambda s, d: (r := Race(s, d)) and race.clinch_scenarios(r.board, r.swings), ""),
    "mc17_rank_snapshot": (lambda s, d: tidy(Race(s, d).plain_board.select("season", "team_id", "rank", "projected_rank", "gold_status", "max_points", "blockers_ahead")), ""),
    "j4_dashboard": (lambda s, d: tidy(Race(s, d).board.select("season", "team_id", "rank", "projected_rank", "projected_w", "projected_l", "gold_pct", "gold_margin", "gold_status", "model_place")), ""),
    "f30_bubble_tiers": (lambda s, d: race.bubble_tiers(Race(s, d).board), ""),
    "f31_status_labels": (lambda s, d: race.status_labels(Race(s, d).board), ""),
    "f22_projection_labels": (lambda s, d: Race(s, d).board.select("season", "team_id", fn.projection_confidence(F.col("gold_margin"), F.col("gold_pct"), F.col("projected_rank") - F.col("rank")).alias("label"), fn.gold_pct_text(F.col("gold_status"), F.col("gold_pct")).alias("odds"), fn.race_tone(F.col("gold_status"), F.col("rank"), F.col("projected_rank"), F.col("gold_pct"), 7).alias("tone"), fn.margin_text(F.col("gold_margin") / 100).alias("margin")), ""),
    "fil8_cut_band": (lambda s, d: standings.cut_band(Race(s, d).projected, 7).select("season", "team_id", "projected_rank"), ""),
    "o1_model_rows": (lambda s, d: Race(s, d).board.select("season", "model_place", "team_id"), ""),
    "o2_games_that_matter": (lambda s, d: tidy((r := Race(s, d)) and race.top_games(r.games, race.importance(r.games, r.board))), ""),
    "o3_importance": (lambda s, d: tidy((r := Race(s, d)) and race.importance(r.games, r.board)), ""),
    "o7_forecasts": (lambda s, d: tidy((r := Race(s, d)) and changes.forecasts(r.games, r.predicted, r.brackets)), ""),
    "o8_tournament_games": (lambda s, d: Race(s, d).brackets.select("season", "place", "label", "game_id", "round_name", "top_id", "bottom_id"), ""),
    "o9_bubble_movement": (lambda s, d: race.bubble_movement(race.bubble_tiers(Race(s, d).board)), ""),
    "p4_team_detail": (_team_detail, ""),
    "ch1_snapshot": (lambda s, d: tidy((r := Race(s, d)) and changes.snapshot(r.board, r.games).drop("settings")), ""),
    "ch2_team_diffs": (lambda s, d: _diff(s, d).select("season", "team_id", "status", F.size("changes").cast("long").alias("n_changes"), F.array_join("reasons", ",").alias("reasons")), ""),
    "ch3_diff_reasons": (lambda s, d: changes.diff_reasons(_diff(s, d)), ""),
    "ch4_explanations": (lambda s, d: tidy(changes.explanations(_diff(s, d))), ""),
    "ch5_weekly_recap": (lambda s, d: _recap(s, d).withColumn("why", F.array_join("why", " ")), ""),
    "ch7_recap_by_week": (lambda s, d: (m := _moves(s, d, "week")) and changes.weekly_recap(m[2], m[3], m[1].teams).select("season", "nth", "kind", "text"), ""),
    "f40_path_summaries": (lambda s, d: (r := Race(s, d)) and changes.path_summary(r.board, r.swings), ""),
    "f41_recap_markdown": (lambda s, d: changes.recap_markdown(_recap(s, d), Settings(), F.lit(_DAY).cast("date")), ""),
    "f41_story_brief": (lambda s, d: changes.story_brief(_recap(s, d), Settings(), F.lit(_DAY).cast("date")), ""),
    "f42_standings_text": (lambda s, d: changes.standings_text(Race(s, d).board, Settings(), F.lit(_DAY).cast("date")), ""),
    "f19_simulation_seeds": (
        lambda s, d: simulate.seed_text(league.games(s, d), simulate.odds_extras(Settings())).select("season", fn.fnv1a(F.col("seed_text")).alias("seed"), F.length("seed_text").cast("long").alias("n")),
        sql(
            "games",
            "SELECT season, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS seed, length(t) AS n FROM (SELECT season, 'odds-7-Balanced-1-0.5-headToHead,runDifferential,runsAgainst,runsFor::' || string_agg(game_id || '|' || CASE WHEN is_final THEN 'F' ELSE 'O' END, ',' ORDER BY game_id || '|' || CASE WHEN is_final THEN 'F' ELSE 'O' END) AS t FROM games GROUP BY season)",
        ),
    ),
}
