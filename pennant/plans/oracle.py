"""SQL that states the league's relations independently of the operators; DuckDB's dialect."""

from __future__ import annotations

from pennant.plans.league import SQL as LEAGUE

_SIDE = "SELECT season, game_id, ord, game_date, {me}_id AS team_id, {other}_id AS opp_id, '{me}' AS side, is_final, innings, " + ", ".join(f"{{me}}_{x} AS {x}, {{other}}_{x} AS opp_{x}" for x in ("runs", "hits", "k", "errors", "walks")) + " FROM games"
ALL_SIDES = f"all_tg AS ({_SIDE.format(me='away', other='home')} UNION ALL {_SIDE.format(me='home', other='away')}), tg AS (SELECT * FROM all_tg WHERE is_final)"

_SUMS = {"rs": "runs", "ra": "opp_runs", "run_diff": "CASE WHEN runs IS NOT NULL THEN greatest(least(runs - opp_runs, 8), -8) END", "hits": "hits", "hits_allowed": "opp_hits", "ks": "k", "opp_ks": "opp_k", "errors": "errors", "opp_errors": "opp_errors", "walks_allowed": "walks", "walks_received": "opp_walks", "away_ks": "CASE WHEN side = 'away' THEN k END", "away_inns": "CASE WHEN side = 'away' THEN innings END", "home_ks": "CASE WHEN side = 'home' THEN k END", "home_inns": "CASE WHEN side = 'home' THEN innings END"}
TOTALS = f"""totals AS (
  SELECT t.season, t.team_id, any_value(t.name) AS name, any_value(t.ord) AS ord, count(g.game_id) AS games,
    count(*) FILTER (WHERE runs > opp_runs) AS w, count(*) FILTER (WHERE runs < opp_runs) AS l, count(*) FILTER (WHERE runs = opp_runs) AS t,
    {", ".join(f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {n}" for n, e in _SUMS.items())}
  FROM teams t LEFT JOIN tg g ON t.season = g.season AND t.team_id = g.team_id GROUP BY t.season, t.team_id)"""

_PG = {"rsg": "rs", "rag": "ra", "hpg": "hits", "kpg": "ks", "opp_kpg": "opp_ks", "errors_pg": "errors", "walks_allowed_pg": "walks_allowed", "walks_received_pg": "walks_received"}
RATES = f"""rates AS (
  SELECT *, CASE WHEN games = 0 THEN 0.0::DOUBLE ELSE (w + t * 0.5::DOUBLE) / games END AS pct,
    {", ".join(f"CASE WHEN games = 0 THEN 0.0::DOUBLE ELSE {c}::DOUBLE / games END AS {n}" for n, c in _PG.items())},
    hits - hits_allowed AS hit_diff, opp_errors - errors AS error_diff, walks_received - walks_allowed AS walk_diff,
    CASE WHEN away_inns > 0 THEN away_ks::DOUBLE / away_inns * 6 END AS away_k6, CASE WHEN home_inns > 0 THEN home_ks::DOUBLE / home_inns * 6 END AS home_k6,
    CASE WHEN away_inns + home_inns > 0 THEN (away_ks + home_ks)::DOUBLE / (away_inns + home_inns) * 6 END AS total_k6
  FROM totals)"""
K6 = "k6 AS (SELECT season, CASE WHEN sum(innings) > 30 THEN sum(k)::DOUBLE / sum(innings) * 6 ELSE 4.5::DOUBLE END AS league_k6 FROM tg GROUP BY season)"
BASE = """base AS (
  SELECT r.*, coalesce(league_k6, 4.5) AS league_k6, CASE WHEN games = 0 THEN 0.0::DOUBLE ELSE
    greatest(-8.0, least(8.0, run_diff::DOUBLE / games)) + pct * 2 + CASE WHEN total_k6 IS NULL THEN 0 ELSE greatest(-1.25, least(1.25, (coalesce(league_k6, 4.5) - total_k6) * 0.35::DOUBLE)) END END AS base_tpi
  FROM rates r LEFT JOIN k6 USING (season))"""
STATS = """aged AS (
  SELECT tg.*, o.base_tpi AS opp_tpi, row_number() OVER (PARTITION BY tg.season, tg.team_id ORDER BY game_date DESC, tg.ord DESC) - 1 AS age,
    CASE WHEN side = 'home' THEN opp_k::DOUBLE / innings * 6 - (o.away_ks + o.home_ks + o.league_k6 * 2) / (o.away_inns + o.home_inns + 12) * 6 END AS extra
  FROM tg JOIN base o ON tg.season = o.season AND tg.opp_id = o.team_id),
form AS (
  SELECT season, team_id, sum(opp_tpi) AS opp_sum, avg(extra) AS extra, sum((runs - opp_runs) * pow(0.72::DOUBLE, age)) FILTER (WHERE age < 6) AS wd,
    sum(opp_tpi * pow(0.72::DOUBLE, age)) FILTER (WHERE age < 6) AS wo, sum(pow(0.72::DOUBLE, age)) FILTER (WHERE age < 6) AS ws
  FROM aged GROUP BY season, team_id),
stats AS (
  SELECT b.*, coalesce(opp_sum / games, 0.0::DOUBLE) AS sos, base_tpi + coalesce(opp_sum / games, 0.0::DOUBLE) * 0.2::DOUBLE AS tpi,
    CASE WHEN extra IS NULL THEN 0.0::DOUBLE ELSE greatest(-3.0::DOUBLE, least(3.0::DOUBLE, extra)) END AS machine_difficulty,
    CASE WHEN games >= 3 THEN greatest(-4.5::DOUBLE, least(4.5::DOUBLE, wd / ws - run_diff::DOUBLE / games + wo / ws * 0.18::DOUBLE)) ELSE 0.0::DOUBLE END AS momentum
  FROM base b LEFT JOIN form f USING (season, team_id))"""
H2H = "h2h AS (SELECT season, team_id, opp_id, count(*) FILTER (WHERE runs > opp_runs) AS wins, count(*) FILTER (WHERE runs < opp_runs) AS losses, count(*) FILTER (WHERE runs = opp_runs) AS ties FROM tg GROUP BY season, team_id, opp_id)"
#: Distinct percentages of teams with at most 70 games differ by more than the tolerance.
RANKED = """grouped AS (
  SELECT s.*, dense_rank() OVER (PARTITION BY season ORDER BY round(pct, 9) DESC) AS grp FROM stats s),
pairs AS (SELECT season, grp, min(team_id) AS a, max(team_id) AS b FROM grouped GROUP BY season, grp HAVING count(*) = 2),
keyed AS (
  SELECT g.*, coalesce((h.wins - h.losses)::DOUBLE / (h.wins + h.losses + h.ties), 0) AS h2h_edge
  FROM grouped g LEFT JOIN pairs p ON g.season = p.season AND g.grp = p.grp
  LEFT JOIN h2h h ON h.season = g.season AND h.team_id = g.team_id AND h.opp_id = CASE WHEN g.team_id = p.a THEN p.b WHEN g.team_id = p.b THEN p.a END),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY season ORDER BY grp, h2h_edge DESC, run_diff DESC, ra, rs DESC, round(tpi, 4) DESC, team_id) AS rank FROM keyed)"""
STATUS = """open_games AS (SELECT season, team_id, count(*) AS n FROM all_tg WHERE NOT is_final GROUP BY season, team_id),
pts AS (
  SELECT r.*, coalesce(n, 0) AS remaining, w * 1.0::DOUBLE + t * 0.5::DOUBLE AS points, w * 1.0::DOUBLE + t * 0.5::DOUBLE + coalesce(n, 0) * 1.0::DOUBLE AS max_points
  FROM ranked r LEFT JOIN open_games USING (season, team_id)),
rivals AS (
  SELECT a.season, a.team_id, count(*) FILTER (WHERE b.points > a.max_points) AS blockers_ahead, count(*) FILTER (WHERE b.max_points >= a.points) AS catchers
  FROM pts a JOIN pts b ON a.season = b.season AND a.team_id <> b.team_id GROUP BY a.season, a.team_id),
status AS (
  SELECT p.*, blockers_ahead, catchers, CASE WHEN blockers_ahead >= 7 THEN 'Eliminated' WHEN catchers < 7 THEN 'Clinched' WHEN rank <= 7 THEN 'In' ELSE 'Alive' END AS gold_status
  FROM pts p JOIN rivals USING (season, team_id))"""

_LAYERS = [("games", LEAGUE), ("tg", ALL_SIDES), ("totals", TOTALS), ("rates", RATES), ("base", f"{K6}, {BASE}"), ("stats", STATS), ("h2h", H2H), ("ranked", RANKED), ("status", STATUS)]


def sql(upto: str, body: str, doubles: str = "", more: str = "") -> str:
    """The query body over the relations up to a layer; the named columns (by commas) are rounded, off exact ties."""
    names = [n for n, _ in _LAYERS]
    layers = [s for _, s in _LAYERS[: names.index(upto) + 1]] + ([more] if more else [])
    cols = ", ".join(f"round({c.strip()} + 1e-9, 6) + 0.0 AS {c.strip()}" for c in doubles.split(",") if c.strip())
    replaced = f" REPLACE ({cols})" if cols else ""
    return f"WITH {', '.join(layers)}\nSELECT *{replaced} FROM (\n{body}\n)"
