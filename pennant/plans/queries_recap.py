"""Weekly recaps and their texts on the record board: chances are winning percentages, so SQL can tell them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.functions.scalars import RECAP_WEIGHTS
from pennant.operators import changes, standings, stats
from pennant.operators.changes import SAID
from pennant.plans import league
from pennant.plans.oracle import LEAGUE, sql
from pennant.plans.queries_more import _TWO
from pennant.plans.tables import derived
from pennant.settings import Settings

_DAY = "2026-05-10"


def _moves(s: SparkSession, d: str, grouping: str) -> tuple[DataFrame, DataFrame]:
    """The moves between the boards before and after the latest window, and the window's finals; each written once."""
    g, t = league.games(s, d), league.teams(s, d)
    before, window = changes.before_window(g, grouping)

    def board(games: DataFrame) -> DataFrame:
        st = stats.team_stats(games, t)
        return standings.gold_status(standings.rank_teams(st, stats.head_to_head(games)), stats.remaining_counts(games, st)).withColumn("gold_pct", F.floor(F.col("pct") * 100).cast("double"))

    sources = league.sources(d)
    return derived(s, sources, f"record moves {grouping}", lambda: changes.rank_moves(board(before), board(g))), derived(s, sources, f"record window {grouping}", lambda: window)


def _recap(s: SparkSession, d: str, grouping: str) -> DataFrame:
    moves, window = _moves(s, d, grouping)
    return changes.weekly_recap(moves, window, league.teams(s, d))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(*keys: str) -> str:
    """Sentences of the fixed table, as one SQL text."""
    return _q(" ".join(SAID[k] for k in keys))


_WHY = {
    "dependency-chain": _said("finalized_results_changed_standings_order", "cut_line_pressure_can_move"),
    "bubble-watch": _said("the_teams_nearest_the_cut", "gold_odds_show_how_current"),
    "clinched": _said("team_status_changed_to_clinched", "remaining_results_now_affect_only"),
    "eliminated": _said("team_status_changed_to_eliminated", "gold_path_is_no_longer"),
    "crossed-cut-down": _said("seed_moved_from_inside_to", "cut_line_movement_can_swing"),
    "crossed-cut-up": _said("seed_moved_from_outside_to", "team_now_controls_its_path"),
    "gold-shift": _said("simulation_odds_moved_by_at", "this_reflects_both_own_result"),
    "biggest-mover": _said("largest_positive_seed_movement_in"),
    "biggest-faller": _said("largest_negative_seed_movement_in"),
}
_DATE, _WEEK = "strftime(game_date, '%-m/%-d')", "strftime(game_date + CAST((7 - dayofweek(game_date)) % 7 AS INTEGER), '%-m/%-d')"
_WHOLE = "CAST(floor({} + 0.5) AS BIGINT)"


def _items(key: str) -> str:
    """SQL relations from the moves to the recap's items; key: a game's window."""
    path = "' (#' || rank_before || ' → #' || rank || ').'"
    return f"""mv AS (
  SELECT split_part(a.season, '#', 1) AS season, a.team_id, a.name, b.rank AS rank_before, a.rank, b.rank - a.rank AS delta, b.gold_status AS status_before, a.gold_status, floor(b.pct * 100) AS pct_before, floor(a.pct * 100) AS gold_pct
  FROM status a JOIN status b ON split_part(a.season, '#', 1) = split_part(b.season, '#', 1) AND a.team_id = b.team_id AND a.season LIKE '%#1' AND b.season LIKE '%#0'),
fin AS (
  SELECT g.season, g.ord, away_id, home_id, away_runs, home_runs, a.name AS away_name, h.name AS home_name, a.rank_before AS a_before, a.rank AS a_now, h.rank_before AS h_before, h.rank AS h_now
  FROM games0 g JOIN latest l USING (season) JOIN mv a ON a.season = g.season AND a.team_id = g.away_id JOIN mv h ON h.season = g.season AND h.team_id = g.home_id WHERE is_final AND {key} = day),
told AS (
  SELECT season, CASE WHEN count(*) = 1 THEN {_said("1_game_finalized")} || any_value(away_name || ' ' || away_runs || ', ' || home_name || ' ' || home_runs) || '.'
    ELSE count(*) || {_said("finals_dropped")} || string_agg(away_name || ' ' || away_runs || '–' || home_name || ' ' || home_runs, '; ' ORDER BY ord) || '.' END AS text FROM fin GROUP BY season),
side AS (
  SELECT season, ord, away_id AS team_id, home_name AS opp, away_runs > home_runs AS won, h_now AS opp_rank, CASE WHEN away_runs > home_runs THEN a_before > h_before ELSE h_before > a_before END AS upset FROM fin WHERE away_runs <> home_runs
  UNION ALL SELECT season, ord, home_id, away_name, home_runs > away_runs, a_now, CASE WHEN away_runs > home_runs THEN a_before > h_before ELSE h_before > a_before END FROM fin WHERE away_runs <> home_runs),
own AS (SELECT season, team_id, arg_max(opp, ord) AS opp, arg_max(won, ord) AS won, arg_max(upset, ord) AS upset, arg_min(opp, ord) AS rival, arg_min(won, ord) AS rival_won, arg_min(opp_rank, ord) AS rival_rank FROM side GROUP BY season, team_id),
movers AS (
  SELECT m.*, row_number() OVER (PARTITION BY season ORDER BY abs(delta) DESC, rank) AS n, concat_ws('; ',
      CASE WHEN won THEN {_said("they_took_care_of_business")} || opp || CASE WHEN upset THEN {_said("in_an_upset_special")} ELSE '' END WHEN opp IS NOT NULL THEN {_said("they_got_clipped_by")} || opp || CASE WHEN upset THEN {_said("in_an_upset")} ELSE '' END END,
      CASE WHEN rival <> name THEN rival || CASE WHEN rival_won THEN {_said("slipped_to")} ELSE {_said("climbed_to")} END || rival_rank END) AS reason
  FROM mv m LEFT JOIN own USING (season, team_id) WHERE delta <> 0),
shifts AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY abs(d) DESC, rank) AS n FROM (SELECT *, {_WHOLE.format("gold_pct - pct_before")} AS d FROM mv) WHERE abs(d) >= 5),
items AS (
  SELECT season, 'summary' AS kind, 0 AS place, text FROM told
  UNION ALL SELECT season, 'dependency-chain', 1000, {_said("dependency_chain_those_finals_tugged")} || string_agg(name, ', ' ORDER BY rank) || '.' FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY rank) AS n FROM mv WHERE delta <> 0) WHERE n <= 6 AND season IN (SELECT season FROM told) GROUP BY season
  UNION ALL SELECT i.season, 'bubble-watch', 2000, {_said("bubble_watch")} || i.name || ' hold the final Gold slot at #7 (' || {_WHOLE.format("i.gold_pct")} || {_said("with")} || o.name || ' first out at #8 (' || {_WHOLE.format("o.gold_pct")} || '%).' FROM mv i JOIN mv o ON i.season = o.season AND i.rank = 7 AND o.rank = 8
  UNION ALL SELECT season, 'clinched', 3000 + rank, name || {_said("clinched_a_gold_bracket_spot")} FROM mv WHERE gold_status = 'Clinched' AND status_before <> 'Clinched'
  UNION ALL SELECT season, 'eliminated', 3000 + rank, name || {_said("were_knocked_out_of_gold")} FROM mv WHERE gold_status = 'Eliminated' AND status_before <> 'Eliminated'
  UNION ALL SELECT season, 'crossed-cut-down', 3000 + rank, name || {_said("dropped_below_the_gold_cut")} || {path} FROM mv WHERE rank_before <= 7 AND rank > 7
  UNION ALL SELECT season, 'crossed-cut-up', 3000 + rank, name || {_said("moved_above_the_gold_cut_2")} || {path} FROM mv WHERE rank_before > 7 AND rank <= 7
  UNION ALL SELECT season, 'rank-change', 4000 + n, name || CASE WHEN delta > 0 THEN ' climbed' ELSE ' slipped' END || ' from #' || rank_before || ' to #' || rank || '. ' || CASE WHEN reason <> '' THEN reason || '.' ELSE {_said("final_scores_across_the_board")} END FROM movers WHERE n <= 4
  UNION ALL SELECT season, 'gold-shift', 5000 + n, name || {_said("gold_odds")} || CASE WHEN d > 0 THEN {_said("climbed")} ELSE 'dropped ' END || d || '% (now ' || {_WHOLE.format("gold_pct")} || '%).' FROM shifts WHERE n <= 4
  UNION ALL SELECT season, 'biggest-mover', 6000, {_said("biggest_mover")} || name || ' (+' || delta || ' seeds).' FROM mv WHERE delta >= 3 QUALIFY row_number() OVER (PARTITION BY season ORDER BY delta DESC, rank) = 1
  UNION ALL SELECT season, 'biggest-faller', 6001, {_said("biggest_faller")} || name || ' (' || delta || ' seeds).' FROM mv WHERE delta <= -3 QUALIFY row_number() OVER (PARTITION BY season ORDER BY delta, rank) = 1),
recap AS (
  SELECT season, row_number() OVER (PARTITION BY season ORDER BY impact DESC, place, text) AS nth, kind, text, CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in _WHY.items())} ELSE '' END AS why, impact FROM (
    SELECT season, text, kind, place, CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in RECAP_WEIGHTS.items())} END::BIGINT AS impact
    FROM (SELECT season, text, arg_max(kind, place) AS kind, min(place) AS place FROM items GROUP BY season, text)) QUALIFY nth <= 16)"""


def _sql(body: str, key: str = _DATE) -> str:
    two = _TWO(LEAGUE).replace(_TWO(""), _TWO("").replace(_DATE, key))
    return sql("status", body, more=_items(key)).replace(LEAGUE, two)


_LABEL = Settings().season_label
_MARKDOWN = f"SELECT season, '# {_LABEL} Recap — 5/10' || chr(10) || chr(10) || string_agg('- ' || text, chr(10) ORDER BY nth) AS text FROM recap GROUP BY season"
_BRIEF = f"""SELECT season, '{_LABEL} League Story — 5/10' || chr(10) || 'Headline: ' || max(line) FILTER (WHERE nth = 1) || CASE WHEN count(*) > 1 THEN chr(10) || {_said("story_beats")} || chr(10) || string_agg('- ' || line, chr(10) ORDER BY nth) FILTER (WHERE nth > 1) ELSE '' END AS text
FROM (SELECT season, nth, text || CASE WHEN why <> '' THEN ' Context: ' || why ELSE '' END AS line FROM recap WHERE nth <= 5) GROUP BY season"""

RECAP = {
    "ch5_record_recap": (lambda s, d: _recap(s, d, "date").withColumn("why", F.array_join("why", " ")), _sql("SELECT season, nth, kind, text, why, impact FROM recap")),
    "ch7_record_recap_by_week": (lambda s, d: _recap(s, d, "week").select("season", "nth", "kind", "text"), _sql("SELECT season, nth, kind, text FROM recap", _WEEK)),
    "o5_record_movers": (lambda s, d: _recap(s, d, "week").where("kind IN ('rank-change', 'gold-shift', 'biggest-mover', 'biggest-faller')").select("season", "kind", "text"), _sql("SELECT season, kind, text FROM recap WHERE kind IN ('rank-change', 'gold-shift', 'biggest-mover', 'biggest-faller')", _WEEK)),
    "f41_record_markdown": (lambda s, d: changes.recap_markdown(_recap(s, d, "week"), Settings(), F.lit(_DAY).cast("date")), _sql(_MARKDOWN, _WEEK)),
    "f41_record_brief": (lambda s, d: changes.story_brief(_recap(s, d, "week"), Settings(), F.lit(_DAY).cast("date")), _sql(_BRIEF, _WEEK)),
}
