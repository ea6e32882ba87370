"""Queries over the derived league: scalar functions, coercion, imports, files, documents, and what needs no simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.functions import scalars as fn
from pennant.operators import compare, mutations, power, predict, race, schedule, standings, states, stats, validate
from pennant.plans import league
from pennant.plans.oracle import sql
from pennant.plans.queries_core import h2h_of, ranked_of, six_decimals, stats_of, status_of, tidy
from pennant.plans.queries_models import _BACKTEST_J, _JOINED, _open, _power, prediction_sql, state_sql
from pennant.plans.queries_rows import _next, _raw_logs
from pennant.plans.tables import derived, shared_dir
from pennant.settings import Settings, coerce_settings
from pennant.sources import schedule_csv, share, storage

_TEAM = "'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"
_SIDES = ("away", "home")
_TEXTS = [f"{a}_{x}" for a in _SIDES for x in league.STATS]
#: The untrusted texts of queries_rows._raw_logs, and their innings.
_RAW = lambda c: f"CASE WHEN ord % 7 = 0 THEN '' WHEN ord % 11 = 0 THEN 'x' WHEN ord % 13 = 0 THEN '101' ELSE coalesce(CAST({c} AS VARCHAR), '') END"
_RAW_INNINGS = "CASE WHEN ord % 5 = 0 THEN '' WHEN ord % 3 = 0 THEN '12' ELSE '6' END"


def _number(text: str, fallback: str) -> str:
    return f"CASE WHEN trim({text}) = '' THEN 0.0::DOUBLE ELSE coalesce(TRY_CAST(trim({text}) AS DOUBLE), {fallback}) END"


def _rounded(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) + 0.0 AS {c}" for c in cols)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], cols: str) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::{'DOUBLE' if isinstance(v, float) else 'BIGINT'}"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({cols})"


# --- teams and games as untrusted tables -------------------------------------------------------


def _raw_teams(s: SparkSession, d: str) -> DataFrame:
    """Every team twice, with spaces; some blank, some names very long."""
    t = league.teams(s, d)
    name = F.when(F.col("ord") % 7 == 3, "  ").when(F.col("ord") % 5 == 1, F.concat(F.lit(" "), F.repeat("name", 30))).otherwise(F.col("name"))
    first = t.select("season", F.concat(F.lit(" "), "team_id", F.lit(" ")).alias("team_id"), name.alias("name"), "ord")
    return first.unionByName(t.select("season", "team_id", F.concat(F.lit("Other "), "name").alias("name"), (F.col("ord") + 100).alias("ord")))


def _raw_matchups(s: SparkSession, d: str) -> DataFrame:
    """Games with spaces around ids; some without a team, some against themselves, some of unknown teams, some twice."""
    g = league.games(s, d).select("season", F.concat(F.lit(" "), F.when(F.col("ord") % 19 == 0, "twice").otherwise(F.col("game_id"))).alias("game_id"), "ord", F.date_format("game_date", "MM/dd/yyyy").alias("date_text"), F.when(F.col("ord") % 11 == 0, " ").when(F.col("ord") % 13 == 0, F.col("home_id")).when(F.col("ord") % 17 == 0, "ZZZ").otherwise(F.col("away_id")).alias("away_id"), "home_id")
    return g


_RAW_GAMES = "(SELECT season, CASE WHEN ord % 19 = 0 THEN 'twice' ELSE game_id END AS game_id, ord, strftime(game_date, '%-m/%-d') AS date_text, CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 13 = 0 THEN home_id WHEN ord % 17 = 0 THEN 'ZZZ' ELSE away_id END AS away_id, home_id FROM games)"

# --- documents ---------------------------------------------------------------------------------


def _stored(s: SparkSession, d: str) -> storage.Stored:
    g = league.games(s, d)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    logs = g.select("season", "game_id", *[text(c).alias(c) for c in storage.FIELDS.values() if c != "is_final"], "is_final")
    settings = league.teams(s, d).select("season").distinct().select("season", F.concat(F.lit('{"goldCutoff":7,"seasonLabel":"'), "season", F.lit('"}')).alias("settings"))
    return storage.Stored(league.teams(s, d).select("season", "team_id", "name", "ord"), g.select("season", "game_id", "ord", fn.date_label(F.col("game_date")).alias("date_text"), "away_id", "home_id"), logs, logs.where("is_final"), settings)


_LOG_COLUMNS = [c for c in storage.FIELDS.values() if c != "is_final"]
_LOGS_SQL = "SELECT season, game_id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _LOG_COLUMNS) + ", is_final FROM games"


def _saved(s: SparkSession, d: str) -> storage.Stored:
    path = shared_dir(s)
    if not storage.save_all(_stored(s, d), path):
        raise OSError(path)
    return storage.load_all(s, path)


def _schedule(s: SparkSession, d: str) -> DataFrame:
    """All games as one schedule file of one league, written and read."""
    path = shared_dir(s)
    g = league.games(s, d).withColumn("date_text", fn.date_label(F.col("game_date")))
    schedule_csv.write(g.drop("season"), league.team_names(s, d), path, "machine")
    return schedule_csv.read_rows(s, path)


def _with_settings(raws: list) -> list[tuple]:
    out = []
    for i, raw in enumerate(raws):
        c = coerce_settings(raw)
        out.append((i, c.gold_cutoff, c.season_label, c.default_game_innings, float(c.win_points), float(c.tie_points), c.max_run_differential, c.model_aggression, c.pitch_mode, c.recap_grouping, ",".join(c.tiebreaker_order)))
    return out


_SETTINGS_SCHEMA = "i long, cutoff long, label string, innings long, win double, tie double, diff long, model string, mode string, grouping string, tiebreakers string"
_RAW_SETTINGS = [None, {}, {"goldCutoff": 3.6, "seasonLabel": "x" * 90, "winPoints": 12, "tiePoints": -1}, {"goldCutoff": 500, "defaultGameInnings": 0, "maxRunDifferential": 99, "modelAggression": "Wild", "pitchMode": "player"}, {"goldCutoff": "7", "recapGrouping": "week", "modelAggression": "Conservative", "winPoints": 2.5}]
_ALL_FACTORS = "headToHead,runDifferential,runsAgainst,runsFor"
#: Worked out by hand from the limits of the data model.
_COERCED = [
    (0, 7, "Current Season", 6, 1.0, 0.5, 8, "Balanced", "machine", "date", _ALL_FACTORS),
    (1, 7, "Current Season", 6, 1.0, 0.5, 8, "Balanced", "machine", "date", _ALL_FACTORS),
    (2, 4, "x" * 80, 6, 10.0, 0.0, 8, "Balanced", "machine", "date", _ALL_FACTORS),
    (3, 64, "Current Season", 1, 1.0, 0.5, 35, "Balanced", "player", "date", _ALL_FACTORS),
    (4, 7, "Current Season", 6, 2.5, 0.5, 8, "Conservative", "machine", "week", _ALL_FACTORS),
]
_ORDERS = [["runsFor", "headToHead", "runsFor", "x"], ["headToHead", "runDifferential", "runsAgainst"], [], "runsFor", ["runsAgainst"]]
_ORDERS_DONE = ["runsFor,headToHead", _ALL_FACTORS, _ALL_FACTORS, _ALL_FACTORS, "runsAgainst"]

# --- Elo and what rests on it --------------------------------------------------------------------
_LAST = "CAST(month(game_date) AS VARCHAR) || '/' || CAST(day(game_date) AS VARCHAR)"
_ELO = f"""RECURSIVE_eg AS (
  SELECT season, row_number() OVER (PARTITION BY season ORDER BY {_LAST}, g.ord) AS i, a.ord + 1 AS a, h.ord + 1 AS h, away_runs - home_runs AS m
  FROM games g JOIN teams a USING (season) JOIN teams h USING (season) WHERE is_final AND a.team_id = g.away_id AND h.team_id = g.home_id),
er AS (
  SELECT season, 0::BIGINT AS i, list_transform(range(0, 25), lambda x: 1500.0::DOUBLE) AS r FROM teams GROUP BY season
  UNION ALL
  SELECT season, i, list_transform(r, lambda v, j: CASE WHEN j = a THEN v + c WHEN j = h THEN v - c ELSE v END) AS r
  FROM (SELECT season, i, r, a, h, greatest(-34.0::DOUBLE, least(34.0::DOUBLE, (ln(abs(m) + 1) * 1.15::DOUBLE) * 22.0::DOUBLE * ((CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 ELSE 0.5 END)::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (r[h] - r[a]) / 400)))))  AS c
    FROM (SELECT er.season, eg.i, er.r, eg.a, eg.h, eg.m FROM er JOIN RECURSIVE_eg eg ON er.season = eg.season AND eg.i = er.i + 1))),
elo AS (SELECT t.season, t.team_id, l.r[t.ord + 1] AS elo FROM teams t JOIN (SELECT season, max_by(r, i) AS r FROM er GROUP BY season) l USING (season))"""
_POWER = (
    _ELO
    + """,
nets AS (SELECT g.season, g.team_id, avg(o.run_diff::DOUBLE / o.games) AS net_sos FROM tg g JOIN totals o ON g.season = o.season AND g.opp_id = o.team_id GROUP BY 1, 2),
mar AS (SELECT season, team_id, avg(runs - opp_runs) AS avg_margin, stddev_pop(runs - opp_runs) AS volatility FROM tg GROUP BY season, team_id),
rec AS (SELECT season, team_id, sum((runs - opp_runs) * (n - age)::DOUBLE / n) / n AS recent_form FROM (SELECT *, least(5, count(*) OVER (PARTITION BY season, team_id)) AS n, row_number() OVER (PARTITION BY season, team_id ORDER BY ord DESC) - 1 AS age FROM tg) WHERE age < 5 GROUP BY season, team_id, n),
pow0 AS (
  SELECT s.season, s.team_id, s.name, s.ord, s.games, s.w, s.l, s.t, pct, elo, coalesce(net_sos, 0) AS net_sos, coalesce(avg_margin, 0) AS avg_margin, coalesce(volatility, 0) AS volatility, coalesce(recent_form, 0) AS recent_form, (rsg - rag) * 0.7::DOUBLE + coalesce(net_sos, 0) * 0.3::DOUBLE AS adj_net
  FROM stats s LEFT JOIN elo USING (season, team_id) LEFT JOIN nets USING (season, team_id) LEFT JOIN mar USING (season, team_id) LEFT JOIN rec USING (season, team_id)),
pow1 AS (SELECT *, ((pct - 0.5) * 18 + avg_margin * 2.1::DOUBLE) * (0.35::DOUBLE + greatest(0, least(1, games / 5.0::DOUBLE)) * 0.65::DOUBLE) + adj_net * 2.4::DOUBLE + (elo - 1500) / 14 + recent_form * 0.9::DOUBLE AS rating,
  CASE WHEN games = 0 THEN 'New' WHEN recent_form > avg_margin + 1 THEN 'Up' WHEN recent_form < avg_margin - 1 THEN 'Down' ELSE 'Stable' END AS trend, w || '-' || l || CASE WHEN t > 0 THEN '-' || t ELSE '' END AS record FROM pow0),
power AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY rating DESC, ord) AS rank FROM pow1)"""
)
_QUALITY = "dq AS (SELECT season, idle, CASE WHEN done = 0 THEN 'Insufficient' ELSE 'Limited' END AS tier, CASE WHEN idle > 0 THEN idle || ' team' || CASE WHEN idle = 1 THEN ' has' ELSE 's have' END || ' no completed results.' END AS warning FROM (SELECT season, count(*) FILTER (WHERE games = 0) AS idle FROM totals GROUP BY season) JOIN (SELECT season, count(*) FILTER (WHERE is_final) AS done FROM games GROUP BY season) USING (season))"
_LEAGUE = f"""{_QUALITY},
ls AS (SELECT season, sum(away_runs + home_runs)::DOUBLE / (count(*) * 2) AS avg_runs FROM games WHERE is_final GROUP BY season),
lp0 AS (SELECT g.season, g.game_id, g.away_id, g.home_id, g.ord, a.rating AS a_rating, b.rating AS b_rating, a.adj_net AS a_net, b.adj_net AS b_net, a.games AS a_games, b.games AS b_games, a.volatility + b.volatility AS wild, coalesce((x.wins - x.losses) * 1.2::DOUBLE, 0) AS edge, q.tier, l.avg_runs
  FROM games g LEFT JOIN power a ON a.season = g.season AND a.team_id = g.away_id LEFT JOIN power b ON b.season = g.season AND b.team_id = g.home_id LEFT JOIN h2h x ON x.season = g.season AND x.team_id = g.away_id AND x.opp_id = g.home_id LEFT JOIN dq q ON q.season = g.season LEFT JOIN ls l ON l.season = g.season WHERE NOT g.is_final),
lp1 AS (SELECT *, greatest(-24.0::DOUBLE, least(24.0::DOUBLE, (a_rating - b_rating) / 3.8::DOUBLE + (a_net - b_net) * 0.45::DOUBLE + edge)) AS m FROM lp0),
lp2 AS (SELECT *, coalesce(m IS NOT NULL AND tier <> 'Insufficient', false) AS ok, greatest(5.0::DOUBLE, least(94.0::DOUBLE, 42.0::DOUBLE + abs(m) * 3.1::DOUBLE + CASE tier WHEN 'Limited' THEN -18.0::DOUBLE ELSE -35.0::DOUBLE END - greatest(0, 3 - least(a_games, b_games)) * 13 - greatest(0.0::DOUBLE, least(20.0::DOUBLE, wild * 1.1::DOUBLE)))) AS score, greatest(0.08::DOUBLE, least(0.92::DOUBLE, 1 / (1 + exp(-(m / 7.2::DOUBLE))))) AS p FROM lp1),
forecast AS (SELECT season, game_id, away_id AS team_a, home_id AS team_b, CASE WHEN ok THEN CASE WHEN m >= 0 THEN away_id ELSE home_id END END AS winner_id, CASE WHEN ok THEN floor(abs(m) * 10 + 0.5) / 10 END AS margin,
  CASE WHEN ok THEN floor(p * 100 + 0.5) / 100 ELSE 0.5::DOUBLE END AS p_a, CAST(CASE WHEN ok THEN floor(score + 0.5) ELSE 12 END AS BIGINT) AS confidence,
  CASE WHEN NOT ok THEN 'Low' WHEN score >= 82 THEN 'High' WHEN score >= 66 THEN 'Strong' WHEN score >= 46 THEN 'Moderate' ELSE 'Low' END AS confidence_tier,
  CASE WHEN ok AND avg_runs > 0 THEN greatest(0.0::DOUBLE, floor((avg_runs + m / 2) * 10 + 0.5) / 10) END AS score_a, tier FROM lp2)"""


def _power_sql(body: str, doubles: str = "", more: str = "") -> str:
    text = sql("ranked", body, doubles, f"{_POWER}{', ' + more if more else ''}")
    return text.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_eg", "eg")


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    g, t = league.games(s, d), league.teams(s, d)
    return power.league_predictions(g, _power(s, d), h2h_of(s, d), power.data_quality(g, t))


def _tiles(s: SparkSession, d: str) -> DataFrame:
    g = league.games(s, d)
    return compare.tiles(g, _forecasts(s, d), _power(s, d), power.data_quality(g, league.teams(s, d)))


# --- comparisons ---------------------------------------------------------------------------------


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    """Each team against the next in rank; no odds, and the present seed for the projected one."""
    board = ranked_of(s, d).withColumns({"gold_pct": F.lit(0.0), "projected_rank": F.col("rank")})
    b = board.select("season", F.col("rank").alias("r"), F.col("team_id").alias("left_id")).join(board.select("season", (F.col("rank") - 1).alias("r"), F.col("team_id").alias("right_id")), ["season", "r"])
    return compare.compare_teams(b.select("season", "left_id", "right_id"), board)


_BETTER = "CASE WHEN a.{c} = b.{c} THEN 'tie' WHEN a.{c} {op} b.{c} THEN 'left' ELSE 'right' END"
_COMPARED = " UNION ALL ".join(
    [f"SELECT a.season, a.team_id AS left_id, b.team_id AS right_id, 1::BIGINT AS nth, 'Record' AS label, NULL AS better FROM {{j}}"]
    + [
        f"SELECT a.season, a.team_id, b.team_id, {i}, '{label}', " + ("'tie'" if c == "gold_pct" else _BETTER.format(c="rank" if c == "projected_rank" else c, op=">" if sign > 0 else "<")) + " FROM {j}"
        for i, (label, c, sign) in enumerate(compare.COMPARED, 2)
    ]
).replace("{j}", "ranked a JOIN ranked b ON a.season = b.season AND b.rank = a.rank + 1")

# --- a schedule file for each season --------------------------------------------------------------


def _season_files(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Every season written to a schedule file of its own, all read in one and parsed."""
    path = shared_dir(s)
    games = league.games(s, d).withColumn("date_text", fn.date_label(F.col("game_date")))
    schedule_csv.write_seasons(games, league.teams(s, d).select("season", "team_id", "name"), path)
    return schedule_csv.parse(schedule_csv.read_seasons(s, path)[0])


# --- commands found by name -----------------------------------------------------------------------


def _found(s: SparkSession, d: str) -> DataFrame:
    """Every team looked up by its name's consonants and by the first four letters of the next one's."""
    t = league.teams(s, d).select("season", F.col("name").alias("label"), F.col("team_id").alias("hint"), "ord")
    short = F.array(F.regexp_replace("label", "[AEIOU ]", ""), F.lower(F.left("label", F.lit(4))))
    queries = t.select("season", F.explode(short).alias("query")).distinct()
    return schedule.found_commands(t, queries).select("season", "query", "place", "label", "score")


_IN_ORDER = "regexp_matches(lower({t}), array_to_string(list_transform(string_split(lower(query), ''), lambda c: regexp_escape(c)), '.*'))"
_SCORE = "CASE WHEN query = '' THEN 1 WHEN contains(lower({t}), lower(query)) THEN 2 WHEN " + _IN_ORDER + " THEN 1 ELSE 0 END"
_FOUND = f"""SELECT season, query, row_number() OVER (PARTITION BY season, query ORDER BY score DESC, ord) AS place, label, score FROM (
  SELECT t.season, query, t.name AS label, ord, CAST(greatest({_SCORE.format(t="t.name")}, {_SCORE.format(t="t.team_id")}) AS BIGINT) AS score
  FROM teams t JOIN (SELECT DISTINCT season, unnest([regexp_replace(name, '[AEIOU ]', '', 'g'), lower(left(name, 4))]) AS query FROM teams) q USING (season)) WHERE score > 0"""

# --- one result more -----------------------------------------------------------------------------


def _one_result(s: SparkSession, d: str) -> DataFrame:
    g = league.games(s, d)
    pairs = stats.remaining(g).select("season", "away_id", "home_id").distinct()
    predicted = predict.predictions(pairs, stats_of(s, d), h2h_of(s, d))
    # rounded as tidy() does, but on lines of pairs and seasons
    return race.one_result_states(g, stats_of(s, d), predicted, value=six_decimals)


_ONE = f"""pr AS (SELECT season, game_id, away_id, home_id, away_score, home_score FROM ({prediction_sql(False, 1.0)}) JOIN (SELECT season, game_id, away_id, home_id FROM games) USING (season, game_id)),
wn AS (SELECT *, away_id AS winner_id FROM pr UNION ALL SELECT *, home_id FROM pr),
sc AS (SELECT *, CASE WHEN winner_id = away_id AND away_score <= home_score THEN home_score + 1 ELSE away_score END AS a, CASE WHEN winner_id = home_id AND home_score <= away_score THEN away_score + 1 ELSE home_score END AS h FROM wn),
st0 AS (SELECT c.season, c.game_id, c.winner_id, c.away_id, c.home_id, s.team_id, s.games, s.w, s.l, s.t, s.rs, s.ra, s.run_diff, s.pct, s.tpi, s.sos, CASE s.team_id WHEN c.away_id THEN a - h WHEN c.home_id THEN h - a END AS df, CASE s.team_id WHEN c.away_id THEN a ELSE h END AS mine FROM sc c JOIN stats s ON s.season = c.season),
st1 AS (SELECT season, game_id, winner_id, away_id, home_id, team_id, sos, df, games + CASE WHEN df IS NULL THEN 0 ELSE 1 END AS games, w + CASE WHEN df > 0 THEN 1 ELSE 0 END AS w, l + CASE WHEN df < 0 THEN 1 ELSE 0 END AS l, t, rs + CASE WHEN df IS NULL THEN 0 ELSE mine END AS rs, ra + CASE WHEN df IS NULL THEN 0 ELSE mine - df END AS ra, run_diff + CASE WHEN df IS NULL THEN 0 ELSE greatest(-8, least(8, df)) END AS run_diff, pct AS pct0, tpi AS tpi0 FROM st0),
st2 AS (SELECT *, CASE WHEN df IS NULL THEN pct0 ELSE (w + t * 0.5::DOUBLE) / games END AS pct FROM st1),
one AS (SELECT *, CASE WHEN df IS NULL THEN tpi0 ELSE greatest(-8.0::DOUBLE, least(8.0::DOUBLE, run_diff::DOUBLE / games)) + pct * 2 + sos * 0.2::DOUBLE END AS tpi FROM st2)"""
_ONE_RANKED = """og AS (SELECT *, dense_rank() OVER (PARTITION BY season, game_id, winner_id ORDER BY round(pct, 9) DESC) AS grp FROM one),
op AS (SELECT season, game_id, winner_id, grp, min(team_id) AS a, max(team_id) AS b FROM og GROUP BY 1, 2, 3, 4 HAVING count(*) = 2),
ok AS (
  SELECT g.*, CASE WHEN g.team_id = p.a THEN p.b WHEN g.team_id = p.b THEN p.a END AS opp FROM og g LEFT JOIN op p ON g.season = p.season AND g.game_id = p.game_id AND g.winner_id = p.winner_id AND g.grp = p.grp),
oh AS (
  SELECT k.*, coalesce(h.wins, 0) + CASE WHEN own AND k.winner_id = k.team_id THEN 1 ELSE 0 END AS hw, coalesce(h.losses, 0) + CASE WHEN own AND k.winner_id <> k.team_id THEN 1 ELSE 0 END AS hl, coalesce(h.ties, 0) AS ht
  FROM (SELECT *, coalesce((team_id = away_id AND opp = home_id) OR (team_id = home_id AND opp = away_id), false) AS own FROM ok) k LEFT JOIN h2h h ON h.season = k.season AND h.team_id = k.team_id AND h.opp_id = k.opp),
onerank AS (SELECT *, row_number() OVER (PARTITION BY season, game_id, winner_id ORDER BY grp, CASE WHEN opp IS NULL OR hw + hl + ht = 0 THEN 0 ELSE (hw - hl)::DOUBLE / (hw + hl + ht) END DESC, run_diff DESC, ra, rs DESC, round(tpi, 4) DESC, team_id) AS rank FROM oh)"""


def _one_result_ranks(s: SparkSession, d: str) -> DataFrame:
    return derived(s, league.sources(d), "one_result_ranks", lambda: _ranks_after_one(s, d))


def _ranks_after_one(s: SparkSession, d: str) -> DataFrame:
    g, t = league.games(s, d), stats_of(s, d)
    return race.one_result_status(g, t, h2h_of(s, d), stats.remaining_counts(g, t), _open(s, d))


def _with_window_open(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pennant.operators import changes

    g, t = league.games(s, d), league.teams(s, d)
    before, _ = changes.before_window(g)

    def board(games: DataFrame) -> DataFrame:
        st = stats.team_stats(games, t)
        return standings.gold_status(standings.rank_teams(st, stats.head_to_head(games)), stats.remaining_counts(games, st)).withColumn("gold_pct", F.lit(0.0))

    return board(before), board(g)


def _moves(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    return changes.rank_moves(*_with_window_open(s, d))


#: Both snapshots as seasons of their own: the latest date's finals open again, and as it is.
_TWO = (
    lambda text: text.replace("teams AS (\n", "teams0 AS (\n").replace("games AS (\n", "games0 AS (\n")
    + """,
latest AS (SELECT season, max_by(strftime(game_date, '%-m/%-d'), (game_date, ord)) AS day FROM games0 WHERE is_final GROUP BY season),
games AS (
  SELECT g.* REPLACE (g.season || '#1' AS season) FROM games0 g
  UNION ALL SELECT g.* REPLACE (g.season || '#0' AS season, g.is_final AND strftime(game_date, '%-m/%-d') IS DISTINCT FROM day AS is_final) FROM games0 g LEFT JOIN latest l ON g.season = l.season),
teams AS (SELECT season || '#' || k AS season, team_id, name, ord FROM teams0, (VALUES ('0'), ('1')) v(k))"""
)


def _moves_sql(body: str) -> str:
    from pennant.plans.oracle import LEAGUE

    moves = "mv AS (SELECT split_part(a.season, '#', 1) AS season, a.team_id, a.name, b.rank AS rank_before, a.rank, b.gold_status AS status_before, a.gold_status FROM status a JOIN status b ON split_part(a.season, '#', 1) = split_part(b.season, '#', 1) AND a.team_id = b.team_id AND a.season LIKE '%#1' AND b.season LIKE '%#0')"
    return sql("status", body, more=moves).replace(LEAGUE, _TWO(LEAGUE))


_MESSAGES = """SELECT season, row_number() OVER (PARTITION BY season ORDER BY rank, i) AS nth, text FROM (
  SELECT season, text, min(rank * 10 + i) // 10 AS rank, min(rank * 10 + i) % 10 AS i FROM (
    SELECT season, rank, i, text FROM mv, LATERAL (VALUES
      (0, CASE WHEN rank <> rank_before THEN name || CASE WHEN rank < rank_before THEN ' moved up' ELSE ' dropped' END || ' from #' || rank_before || ' to #' || rank END),
      (1, CASE WHEN rank_before <= 7 AND rank > 7 THEN name || ' dropped below the Gold cut line' END),
      (2, CASE WHEN rank_before > 7 AND rank <= 7 THEN name || ' moved above the Gold cut line into Gold position' END),
      (3, CASE WHEN gold_status <> status_before AND gold_status = 'Eliminated' THEN name || ' is now eliminated from Gold Bracket contention' END),
      (4, CASE WHEN gold_status <> status_before AND gold_status = 'Clinched' THEN name || ' clinched the Gold Bracket' END)) v(i, text) WHERE text IS NOT NULL)
  GROUP BY season, text) QUALIFY nth <= 10"""

_TIMELINE = """SELECT season, nth, game_id, day, label, score, winner, movement, coalesce(impact, 'Gold cut line held after ' || day || '.') AS cut_line_impact FROM (
  SELECT q.season, q.n - q.seq AS nth, q.game_id, strftime(q.game_date, '%-m/%-d') AS day, a.name || ' at ' || h.name AS label, q.away_runs || '-' || q.home_runs AS score,
    CASE WHEN q.away_runs > q.home_runs THEN a.name WHEN q.away_runs < q.home_runs THEN h.name ELSE 'Tie' END AS winner, concat_ws('; ', a.line, h.line) AS movement,
    (SELECT min_by(m.message, m.rank) FROM mm m WHERE m.season = q.season AND m.state = q.seq + 1 AND m.message IS NOT NULL) AS impact
  FROM seqd q JOIN mm a ON a.season = q.season AND a.state = q.seq + 1 AND a.team_id = q.away_id JOIN mm h ON h.season = q.season AND h.state = q.seq + 1 AND h.team_id = q.home_id WHERE q.seq >= q.n - 8)"""
_TIMELINE_MORE = """sch AS (SELECT season, team_id, count(*) AS scheduled FROM (SELECT season, away_id AS team_id FROM games0 UNION ALL SELECT season, home_id FROM games0) GROUP BY 1, 2),
sp AS (SELECT split_part(r.season, '#', 1) AS season, CAST(split_part(r.season, '#', 2) AS BIGINT) AS state, r.team_id, name, rank, w * 1.0::DOUBLE + t * 0.5::DOUBLE AS points, coalesce(scheduled, 0) - games AS remaining FROM ranked r LEFT JOIN sch ON sch.season = split_part(r.season, '#', 1) AND sch.team_id = r.team_id),
sx AS (SELECT *, points + remaining AS max_points FROM sp),
sg AS (SELECT a.season, a.state, a.team_id, count(*) FILTER (WHERE b.points > a.max_points) AS blockers, count(*) FILTER (WHERE b.max_points >= a.points) AS catchers FROM sx a JOIN sx b ON a.season = b.season AND a.state = b.state AND a.team_id <> b.team_id GROUP BY 1, 2, 3),
sm AS (SELECT x.*, CASE WHEN blockers >= 7 THEN 'Eliminated' WHEN catchers < 7 THEN 'Clinched' WHEN rank <= 7 THEN 'In' ELSE 'Alive' END AS gold_status FROM sx x JOIN sg USING (season, state, team_id)),
sb AS (SELECT *, lag(rank) OVER w AS rank_before, lag(gold_status) OVER w AS status_before FROM sm WINDOW w AS (PARTITION BY season, team_id ORDER BY state)),
mm AS (SELECT *, CASE WHEN rank_before > 7 AND rank <= 7 THEN name || ' moved into Gold' WHEN rank_before <= 7 AND rank > 7 THEN name || ' dropped below Gold' WHEN status_before <> gold_status AND gold_status = 'Clinched' THEN name || ' clinched Gold' WHEN status_before <> gold_status AND gold_status = 'Eliminated' THEN name || ' were eliminated' END AS message,
  CASE WHEN rank < rank_before THEN name || ' climbed #' || rank_before || ' → #' || rank WHEN rank > rank_before THEN name || ' fell #' || rank_before || ' → #' || rank END AS line FROM sb)"""

# --- imports ---------------------------------------------------------------------------------------


def _preview(s: SparkSession, d: str) -> DataFrame:
    new, now = _next(s, d)
    t = league.teams(s, d)
    return validate.import_preview(t.where("ord <> 4"), new, t, now)


_PREVIEW = """SELECT t.season, 24::BIGINT AS teams, games, finals, games - finals AS open, 0::BIGINT AS added_teams, 1::BIGINT AS removed_teams, 0::BIGINT AS added_games, gone AS removed_games, rescored AS changed_finals, downgraded AS final_downgrades, removed_finals, dup AS duplicate_games, rev AS reversed_games, played4 AS removed_teams_with_finals
FROM (SELECT DISTINCT season FROM teams) t JOIN (
  SELECT season, count(*) FILTER (WHERE ord % 9 <> 0) AS games, count(*) FILTER (WHERE ord % 9 <> 0 AND is_final AND ord % 6 <> 0) AS finals, count(*) FILTER (WHERE ord % 9 = 0) AS gone,
    count(*) FILTER (WHERE is_final AND ord % 9 <> 0 AND ord % 6 <> 0 AND ord % 4 = 0) AS rescored, count(*) FILTER (WHERE is_final AND ord % 9 <> 0 AND ord % 6 = 0) AS downgraded, count(*) FILTER (WHERE is_final AND ord % 9 = 0) AS removed_finals,
    CASE WHEN count(*) FILTER (WHERE is_final AND 'N04' IN (away_id, home_id)) > 0 THEN 1::BIGINT ELSE 0::BIGINT END AS played4 FROM games GROUP BY season) USING (season)
LEFT JOIN (SELECT season, count(*) FILTER (WHERE dup) AS dup, count(*) FILTER (WHERE rev) AS rev FROM (SELECT g.season, row_number() OVER (PARTITION BY g.season, strftime(game_date, '%m-%d'), away_id, home_id ORDER BY ord) > 1 AS dup, coalesce(f.first < g.ord, false) AS rev FROM (SELECT * FROM games WHERE ord % 9 <> 0) g LEFT JOIN (SELECT season, strftime(game_date, '%m-%d') AS dt, away_id AS a, home_id AS h, min(ord) AS first FROM games WHERE ord % 9 <> 0 GROUP BY 1, 2, 3, 4) f ON f.season = g.season AND f.dt = strftime(g.game_date, '%m-%d') AND f.a = g.home_id AND f.h = g.away_id) GROUP BY season) USING (season)"""
_PREVIEW_COUNTS = ["teams", "games", "finals", "open", "added_teams", "removed_teams", "added_games", "removed_games", "changed_finals", "final_downgrades", "removed_finals", "duplicate_games", "reversed_games", "removed_teams_with_finals"]


def _issues(s: SparkSession, d: str) -> DataFrame:
    g = league.games(s, d)
    kind = F.when(F.col("ord") % 3 == 0, "missing-team").when(F.col("ord") % 3 == 1, "unknown-team").otherwise("duplicate-id")
    return g.select(kind.alias("kind"), F.col("ord").alias("row_number"), F.when(F.col("ord") % 3 == 1, F.col("away_id")).alias("detail"))


_PREVIEW_TEXT = f"""SELECT season, teams || ' teams · ' || games || ' games · ' || finals || ' finals · ' || open || ' open' || chr(10) || chr(10) || 'Change summary: +' || added_teams || '/-' || removed_teams || ' teams · +' || added_games || '/-' || removed_games || ' games' AS text FROM ({_PREVIEW})"""

_KINDS = list(fn.RECAP_WEIGHTS)
_STATUSES = ["Clinched", "Eliminated", "In", "Alive"]


def _grid(s: SparkSession) -> DataFrame:
    """Every status with ranks and chances."""
    return s.range(0, 4 * 12 * 101).select((F.col("id") % 4).alias("k"), ((F.col("id") / 4).cast("long") % 12 + 1).alias("rank"), (F.col("id") / 48).cast("long").alias("p")).withColumn("status", F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("k") + 1).cast("int"))).withColumn("pct", F.col("p") * 1.0 - 0.25).withColumn("projected", F.pmod(F.col("rank") + F.col("p"), F.lit(12)) + 1)


_GRID = f"(SELECT id % 4 AS k, (id // 4) % 12 + 1 AS rank, id // 48 AS p, [{', '.join(repr(x) for x in _STATUSES)}][id % 4 + 1] AS status, (id // 48) * 1.0::DOUBLE - 0.25::DOUBLE AS pct, ((id // 4) % 12 + 1 + id // 48) % 12 + 1 AS projected FROM range({4 * 12 * 101}) t(id))"

MORE = {
    "f1_clamped": (lambda s, d: stats.finals(league.games(s, d)).select("season", "game_id", fn.clamp(F.col("away_runs") - F.col("home_runs"), -3, 3).alias("margin")), sql("games", "SELECT season, game_id, greatest(-3, least(3, away_runs - home_runs)) AS margin FROM games WHERE is_final")),
    "f2_numbers": (lambda s, d: _raw_logs(s, d).select("season", "game_id", *[fn.number(F.col(c), -1.0).alias(c) for c in ("away_runs", "home_hits")]), sql("games", f"SELECT season, game_id, {_number(_RAW('away_runs'), '-1.0')} AS away_runs, {_number(_RAW('home_hits'), '-1.0')} AS home_hits FROM games")),
    "f3_blank_logs": (lambda s, d: stats.remaining(league.games(s, d)).select("season", "game_id", fn.blank_log().alias("l")).select("season", "game_id", "l.*"), sql("games", "SELECT season, game_id, " + ", ".join(f"'' AS {c}" for c in _TEXTS) + ", '6' AS innings, false AS is_final FROM games WHERE NOT is_final")),
    "f4_innings": (lambda s, d: _raw_logs(s, d).select("season", "game_id", fn.innings(F.when(F.col("innings") == "12", "x").otherwise(F.col("innings"))).alias("innings"), fn.innings(F.col("away_k")).alias("odd")), sql("games", f"SELECT season, game_id, 6.0::DOUBLE AS innings, coalesce(nullif({_number(_RAW('away_k'), '6.0')}, 0), 6.0)::DOUBLE AS odd FROM games")),
    "f6_abbreviations": (lambda s, d: league.team_names(s, d).select("team_id", fn.team_abbr(F.col("name")).alias("abbr"), fn.team_abbr(F.concat("name", F.lit(" Town Club Nine"))).alias("long")), f"SELECT {_TEAM} AS team_id, CASE WHEN contains(n_name, ' ') THEN string_split(n_name, ' ')[1][1] || string_split(n_name, ' ')[2][1] ELSE left(n_name, 3) END AS abbr, upper(array_to_string(list_transform(string_split(n_name || ' Town Club Nine', ' ')[1:3], lambda w: w[1]), '')) AS long FROM nation"),
    "f8_team_formats": (lambda s, d: stats.team_totals(league.games(s, d), league.teams(s, d)).select("season", "team_id", fn.team_format(F.col("name"), F.col("w"), F.col("l"), F.col("t")).alias("f")).select("season", "team_id", "f.*"), sql("totals", "SELECT season, team_id, name AS display, CASE WHEN contains(name, ' ') THEN string_split(name, ' ')[1][1] || string_split(name, ' ')[2][1] ELSE left(name, 3) END AS abbr, w || '-' || l || CASE WHEN t > 0 THEN '-' || t ELSE '' END AS record FROM totals")),
    "f10_date_values": (lambda s, d: league.games(s, d).select("season", "game_id", fn.date_value(F.when(F.col("ord") % 8 == 0, "").otherwise(F.date_format("game_date", "yyyy-MM-dd"))).alias("day")), sql("games", "SELECT season, game_id, CASE WHEN ord % 8 <> 0 THEN TRY_CAST('2026-' || strftime(game_date, '%m-%d') AS DATE) END AS day FROM games")),
    "f11_date_labels": (lambda s, d: league.games(s, d).select("season", "game_id", fn.date_label(F.when(F.col("ord") % 5 > 0, F.col("game_date"))).alias("label"), fn.date_label(F.when(F.col("ord") % 3 > 0, F.col("game_date")), "TBD").alias("other")), sql("games", "SELECT season, game_id, CASE WHEN ord % 5 > 0 THEN strftime(game_date, '%-m/%-d') ELSE 'No Date' END AS label, CASE WHEN ord % 3 > 0 THEN strftime(game_date, '%-m/%-d') ELSE 'TBD' END AS other FROM games")),
    "f12_week_endings": (lambda s, d: league.games(s, d).select("season", "game_id", fn.week_ending(F.col("game_date")).alias("sunday")), sql("games", "SELECT season, game_id, CAST(game_date + CAST((7 - dayofweek(game_date)) % 7 AS INTEGER) AS DATE) AS sunday FROM games")),
    "f14_headers": (lambda s, d: _values(s, [(h, schedule_csv.normal_header(h)) for h in ("﻿Game ID", " Away   Team ", "HOME\tK", "", "Innings")], "header string, normal string"), _sql_values([("﻿Game ID", "game id"), (" Away   Team ", "away team"), ("HOME\tK", "home k"), ("", ""), ("Innings", "innings")], "header, normal")),
    "f15_team_ids": (
        lambda s, d: validate.with_team_ids(league.teams(s, d).select("season", F.concat(F.lit("The "), "name").alias("name"), "ord").unionByName(league.teams(s, d).select("season", "name", (F.col("ord") + 100).alias("ord")))).select("season", "ord", "team_id"),
        sql("games", "SELECT season, ord, CASE WHEN n = 0 THEN base ELSE left(base, 3) || n END AS team_id FROM (SELECT season, ord, base, row_number() OVER (PARTITION BY season, base ORDER BY ord) - 1 AS n FROM (SELECT season, ord, left(regexp_replace(upper('The ' || name), '[^A-Z0-9]', '', 'g'), 4) AS base FROM teams UNION ALL SELECT season, ord + 100, left(regexp_replace(upper(name), '[^A-Z0-9]', '', 'g'), 4) FROM teams))"),
    ),
    "f16_logits": (lambda s, d: tidy(s.range(1, 200).select("id", fn.logit(F.col("id") / 200).alias("x"), fn.logistic(F.col("id") / 20 - 5).alias("p"))), f"SELECT id, {_rounded('x', 'p')} FROM (SELECT id, ln((id / 200.0::DOUBLE) / (1 - id / 200.0::DOUBLE)) AS x, 1 / (1 + exp(-(id / 20.0::DOUBLE - 5))) AS p FROM range(1, 200) t(id))"),
    "f17_hashes": (lambda s, d: league.team_names(s, d).select("team_id", fn.fnv1a(F.concat("name", F.lit("|"), "team_id")).alias("hash")), f"SELECT {_TEAM} AS team_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(n_name || '|' || {_TEAM}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM nation"),
    "f21_margin_texts": (lambda s, d: s.range(-20, 500).select("id", fn.margin_text(F.col("id") / 1000).alias("text")), "SELECT id, '±' || CAST(CASE WHEN id > 0 THEN greatest(1, ceil(id / 1000.0::DOUBLE * 100)) ELSE 0 END AS BIGINT) || '%' AS text FROM range(-20, 500) t(id)"),
    "f22_confidence_words": (
        lambda s, d: s.range(0, 20 * 101).select("id", fn.projection_confidence(F.col("id") % 20, (F.col("id") / 20).cast("long"), F.col("id") % 5 - 2).alias("label")),
        "SELECT id, CASE WHEN m >= 12 OR abs(p - 50) <= 12 OR v >= 3 THEN 'Too close' WHEN m >= 7 OR abs(p - 50) <= 25 OR v >= 2 THEN 'Volatile' ELSE 'Stable' END AS label FROM (SELECT id, id % 20 AS m, id // 20 AS p, abs(id % 5 - 2) AS v FROM range(2020) t(id))",
    ),
    "f23_gold_texts": (lambda s, d: _grid(s).select("k", "rank", "p", fn.gold_pct_text(F.col("status"), F.col("pct")).alias("text")), f"SELECT k, rank, p, CASE WHEN status <> 'Eliminated' AND pct > 0 AND pct < 1 THEN '<1%' WHEN status <> 'Clinched' AND pct >= 99.5 THEN '99%+' WHEN status <> 'Eliminated' AND pct <= 0.5 THEN '<1%' ELSE CAST(floor(pct + 0.5) AS BIGINT) || '%' END AS text FROM {_GRID}"),
    "f25_race_tones": (lambda s, d: _grid(s).select("k", "rank", "p", fn.race_tone(F.col("status"), F.col("rank"), F.col("projected"), F.col("pct"), 7).alias("tone")), f"SELECT k, rank, p, CASE WHEN status = 'Clinched' THEN 'clinched' WHEN status = 'Eliminated' THEN 'out' WHEN rank <= 7 AND pct >= 75 THEN 'safe' WHEN rank <= 7 THEN 'inside' WHEN pct >= 25 OR projected <= 7 THEN 'bubble' ELSE 'chasing' END AS tone FROM {_GRID}"),
    "f27_upset_risks": (lambda s, d: s.range(0, 1000).select("id", fn.upset_risk(F.col("id") / 1000, F.col("id") % 9).alias("risk")), "SELECT id, CASE WHEN id / 1000.0::DOUBLE < 0.58::DOUBLE OR id % 9 <= 2 THEN 'High' WHEN id / 1000.0::DOUBLE < 0.7::DOUBLE OR id % 9 <= 5 THEN 'Medium' ELSE 'Low' END AS risk FROM range(1000) t(id)"),
    "f28_balls_in_play": (
        lambda s, d: _raw_logs(s, d).select("season", "game_id", fn.balls_in_play(F.when(F.length("game_id") + F.col("innings").cast("string").isin("12").cast("int") > 12, "x").otherwise(F.col("away_hits")), F.col("away_runs"), F.col("away_k"), F.col("innings")).alias("bip")),
        sql("games", f"SELECT season, game_id, CASE WHEN {_RAW_INNINGS} = '12' THEN {_number(_RAW('away_runs'), '0.0')} ELSE CASE WHEN TRY_CAST(coalesce(nullif(trim({_RAW('away_hits')}), ''), '0') AS DOUBLE) IS NULL THEN {_number(_RAW('away_runs'), '0.0')} ELSE {_number(_RAW('away_hits'), '0.0')} END END + {_number(_RAW_INNINGS, '6.0')} * 3 - {_number(_RAW('away_k'), '0.0')} AS bip FROM games"),
    ),
    "f29_per_game": (lambda s, d: stats.team_totals(league.games(s, d), league.teams(s, d)).select("season", "team_id", fn.per_game_text(F.col("rs"), F.col("games")).alias("text")), sql("totals", "SELECT season, team_id, CASE WHEN games > 0 THEN CAST(CAST(floor(rs::DOUBLE / games * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(rs::DOUBLE / games * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) ELSE '—' END AS text FROM totals")),
    "f33_recap_weights": (lambda s, d: _values(s, [(k, t) for k in [*_KINDS, "other"] for t in ("to #3", "none")], "kind string, text string").select("kind", "text", fn.recap_weight(F.col("kind"), F.col("text")).cast("long").alias("weight")), _sql_values([(k, t, 45 if k == "rank-change" and t == "none" else fn.RECAP_WEIGHTS.get(k, 40)) for k in [*_KINDS, "other"] for t in ("to #3", "none")], "kind, text, weight")),
    "f34_delta_texts": (lambda s, d: s.range(0, 100).select("id", fn.delta_text((F.col("id") - 50) / 7).alias("text")), "SELECT id, CASE WHEN abs((id - 50) / 7.0::DOUBLE) < 0.05 THEN '0.0' ELSE printf('%+.1f', (id - 50) / 7.0::DOUBLE) END AS text FROM range(100) t(id)"),
    "f36_points": (lambda s, d: tidy(stats.team_totals(league.games(s, d), league.teams(s, d)).select("season", "team_id", stats.points(2, 0.25).alias("points"))), sql("totals", "SELECT season, team_id, w * 2.0::DOUBLE + t * 0.25::DOUBLE AS points FROM totals", "points")),
    "f37_compared_teams": (lambda s, d: _neighbours(s, d).select("season", "left_id", "right_id", "nth", "label", "better"), sql("ranked", _COMPARED)),
    "val1_texts": (lambda s, d: _raw_matchups(s, d).where(validate.is_text("away_id")).groupBy("season").agg(F.count("*").alias("n")), sql("games", f"SELECT season, count(*) AS n FROM {_RAW_GAMES} WHERE away_id <> '' GROUP BY season")),
    "val2_teams": (lambda s, d: validate.coerce_teams(_raw_teams(s, d)).select("season", "team_id", "name", "ord"), sql("games", "SELECT season, team_id, CASE WHEN ord % 7 = 3 THEN 'Other ' || name WHEN ord % 5 = 1 THEN left(repeat(name, 30), 120) ELSE name END AS name, CASE WHEN ord % 7 = 3 THEN ord + 100 ELSE ord END AS ord FROM teams")),
    "val3_matchups": (
        lambda s, d: validate.coerce_matchups(_raw_matchups(s, d), league.teams(s, d)).select("season", "game_id", "ord", "date_text", "away_id", "home_id"),
        sql("games", f"SELECT * FROM {_RAW_GAMES} WHERE away_id NOT IN ('', 'ZZZ') AND away_id <> home_id QUALIFY row_number() OVER (PARTITION BY season, game_id ORDER BY ord) = 1"),
    ),
    "val5_stat_texts": (lambda s, d: _raw_logs(s, d).select("season", "game_id", validate.clamp_text(F.col("home_runs"), 35).alias("runs")), sql("games", f"SELECT season, game_id, CASE WHEN x = '' OR TRY_CAST(x AS DOUBLE) IS NULL THEN '' ELSE CAST(least(35, CAST(x AS BIGINT)) AS VARCHAR) END AS runs FROM (SELECT season, game_id, {_RAW('home_runs')} AS x FROM games)")),
    "val6_innings": (lambda s, d: _raw_logs(s, d).select("season", "game_id", validate.clamp_innings(F.col("innings")).alias("innings"), validate.clamp_innings(F.col("away_k")).alias("odd")), sql("games", f"SELECT season, game_id, CASE {_RAW_INNINGS} WHEN '' THEN '1' WHEN '12' THEN '10' ELSE '6' END AS innings, CASE WHEN x = '' THEN '1' ELSE CAST(greatest(1, least(10, coalesce(TRY_CAST(x AS BIGINT), 6))) AS VARCHAR) END AS odd FROM (SELECT *, {_RAW('away_k')} AS x FROM games)")),
    "val7_settings": (lambda s, d: _values(s, _with_settings(_RAW_SETTINGS), _SETTINGS_SCHEMA), _sql_values(_COERCED, "i, cutoff, label, innings, win, tie, diff, model, mode, grouping, tiebreakers")),
    "val8_tiebreakers": (lambda s, d: _values(s, [(i, ",".join(coerce_settings({"tiebreakerOrder": o}).tiebreaker_order)) for i, o in enumerate(_ORDERS)], "i long, tiebreakers string"), _sql_values(list(enumerate(_ORDERS_DONE)), "i, tiebreakers")),
    "mu6_tiebreaker_edits": (lambda s, d: _values(s, [(i, ",".join(Settings().but(tiebreaker_order=coerce_settings({"tiebreakerOrder": o}).tiebreaker_order).factors)) for i, o in enumerate(_ORDERS)], "i long, factors string"), _sql_values(list(enumerate(_ORDERS_DONE)), "i, factors")),
    "val10_typed_scores": (lambda s, d: league.games(s, d).select("season", "game_id", fn.digits_only(F.concat(F.lit("a"), F.col("ord").cast("string"), F.lit("-9"))).alias("typed")), sql("games", "SELECT season, game_id, left(CAST(ord AS VARCHAR) || '9', 2) AS typed FROM games")),
    "rec5_import_counts": (lambda s, d: _preview(s, d).select("season", *_PREVIEW_COUNTS), sql("games", _PREVIEW)),
    "rec6_import_texts": (lambda s, d: validate.preview_text(_preview(s, d).withColumns({"sample_teams": F.lit(""), "sample_games": F.lit(""), "notes": F.array().cast("array<string>")})), sql("games", _PREVIEW_TEXT)),
    "rec7_issue_lines": (
        lambda s, d: validate.issue_summary(_issues(s, d)),
        sql("games", "SELECT kind, rows[1] AS first_row, n || ' row(s) skipped: ' || CASE kind WHEN 'missing-team' THEN 'missing Away/Home team' WHEN 'unknown-team' THEN 'team name mismatch' ELSE 'duplicate Game ID' END || ' (rows ' || array_to_string(rows[1:5], ', ') || CASE WHEN n > 5 THEN ', +' || (n - 5) || ' more' ELSE '' END || ')' || CASE WHEN kind = 'unknown-team' THEN ' — ' || d1 || '; ' || d2 ELSE '' END AS line FROM (SELECT ['missing-team', 'unknown-team', 'duplicate-id'][ord % 3 + 1] AS kind, count(*) AS n, list(ord ORDER BY ord) AS rows FROM games GROUP BY 1), (SELECT min(away_id) FILTER (WHERE nth = 1) AS d1, min(away_id) FILTER (WHERE nth = 2) AS d2 FROM (SELECT away_id, row_number() OVER (ORDER BY min(ord)) AS nth FROM games WHERE ord % 3 = 1 GROUP BY away_id))"),
    ),
    "src1_schedule_rows": (lambda s, d: _schedule(s, d).select("game_id", "date", "away", "home", "away_runs", "home_runs", "innings"), sql("games", "SELECT game_id, strftime(game_date, '%-m/%-d') AS date, a.n_name AS away, h.n_name AS home, coalesce(CAST(away_runs AS VARCHAR), '') AS away_runs, coalesce(CAST(home_runs AS VARCHAR), '') AS home_runs, '6' AS innings FROM games JOIN nation a ON away_id = 'N' || lpad(CAST(a.n_nationkey AS VARCHAR), 2, '0') JOIN nation h ON home_id = 'N' || lpad(CAST(h.n_nationkey AS VARCHAR), 2, '0')")),
    "src1_season_files": (lambda s, d: _season_files(s, d)[2].select("season", "game_id", "away_runs", "home_runs", "away_hits", "home_hits", "away_k", "home_k", "is_final"), sql("games", "SELECT season, game_id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("away_runs", "home_runs", "away_hits", "home_hits", "away_k", "home_k")) + ", is_final FROM games")),
    "src3_season_games": (
        lambda s, d: (p := _season_files(s, d)) and p[1].select("season", "game_id", "ord", "date_text", *[F.col(f"{x}_id").alias(x) for x in _SIDES]).join(p[0].select("season", F.col("team_id").alias("away"), F.col("name").alias("away_name")), ["season", "away"]).select("season", "game_id", "ord", "date_text", "away_name"),
        sql("games", "SELECT season, game_id, row_number() OVER (PARTITION BY season ORDER BY ord) + 1 AS ord, strftime(game_date, '%-m/%-d') AS date_text, n_name AS away_name FROM games JOIN nation ON away_id = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"),
    ),
    "src3_parsed_logs": (lambda s, d: schedule_csv.parse(_schedule(s, d))[2].select("game_id", "away_runs", "home_runs", "away_hits", "home_hits", "away_k", "home_k", "is_final"), sql("games", "SELECT game_id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("away_runs", "home_runs", "away_hits", "home_hits", "away_k", "home_k")) + ", is_final FROM games")),
    "src3_parsed_teams": (lambda s, d: schedule_csv.parse(_schedule(s, d))[0].select("name", "ord"), sql("games", "SELECT n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS ord FROM nation WHERE 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') IN (SELECT away_id FROM games UNION SELECT home_id FROM games)")),
    "src4_unguarded": (lambda s, d: league.team_names(s, d).select("team_id", fn.csv_unguard(F.concat(F.lit(" '"), F.when(F.col("ord") % 2 == 0, "=").otherwise(""), "name")).alias("cell")), f"SELECT {_TEAM} AS team_id, CASE WHEN n_nationkey % 2 = 0 THEN '=' || n_name ELSE chr(39) || n_name END AS cell FROM nation"),
    "src6_stored_teams": (lambda s, d: _saved(s, d).teams, sql("games", "SELECT season, team_id, name, ord FROM teams")),
    "snk5_stored_logs": (lambda s, d: _saved(s, d).logs, sql("games", _LOGS_SQL)),
    "src8_backup_logs": (lambda s, d: storage.from_documents(storage.documents(_stored(s, d))).logs, sql("games", _LOGS_SQL)),
    "snk4_backup_games": (lambda s, d: storage.from_documents(storage.documents(_stored(s, d))).matchups.drop("ord"), sql("games", "SELECT season, game_id, strftime(game_date, '%-m/%-d') AS date_text, away_id, home_id FROM games")),
    "src9_shared_finals": (lambda s, d: share.from_parts(share.in_parts(_stored(s, d))).logs.where("is_final"), sql("games", _LOGS_SQL + " WHERE is_final")),
    "snk6_shared_settings": (lambda s, d: share.from_parts(share.in_parts(_stored(s, d))).settings, sql("games", "SELECT DISTINCT season, '{\"goldCutoff\":7,\"seasonLabel\":\"' || season || '\"}' AS settings FROM teams")),
    "src10_addresses": (lambda s, d: _values(s, [(f, p.get("s"), p.get("view"), p.get("team")) for f in ("#s=abc&view=games&team=N01", "s=x", "", "#view=power") for p in [share.address_parts(f)]], "fragment string, payload string, view string, team string"), _sql_values([("#s=abc&view=games&team=N01", "abc", "games", "N01"), ("s=x", "x", None, None), ("", None, None, None), ("#view=power", None, "power", None)], "fragment, payload, view, team")),
    "src13_team_lists": (lambda s, d: _values(s, list(enumerate(schedule_csv.team_list("Aces, Bears\r\nCubs\n\n Aces ,Dogs,"))), "i long, name string"), _sql_values(list(enumerate(["Aces", "Bears", "Cubs", "Dogs"])), "i, name")),
    "snk1_schedule_layout": (
        lambda s, d: (o := schedule_csv.layout(league.games(s, d).withColumn("date_text", fn.date_label(F.col("game_date"))), league.team_names(s, d)))
        and o.select(F.col("`Game ID`").alias("game_id"), F.col("`Away Team`").alias("away"), F.col("`Home K`").alias("home_k"), F.col("`Away BIP`").alias("away_bip")),
        sql("games", "SELECT game_id, n_name AS away, coalesce(CAST(home_k AS VARCHAR), '') AS home_k, coalesce(CAST(away_hits + innings * 3 - away_k AS VARCHAR), '') AS away_bip FROM games JOIN nation ON away_id = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"),
    ),
    "snk3_player_layout": (
        lambda s, d: (o := schedule_csv.layout(league.games(s, d).withColumn("date_text", fn.date_label(F.col("game_date"))), league.team_names(s, d), "player"))
        and o.select(F.col("`Game ID`").alias("game_id"), F.col("`Away E`").alias("away_e"), F.col("`Away BB`").alias("away_bb"), F.col("`Home BB`").alias("home_bb")),
        sql("games", "SELECT game_id, coalesce(CAST(away_errors AS VARCHAR), '') AS away_e, coalesce(CAST(home_walks AS VARCHAR), '') AS away_bb, coalesce(CAST(away_walks AS VARCHAR), '') AS home_bb FROM games"),
    ),
    "mu1_entries": (
        lambda s, d: mutations.enter(
            _stored(s, d).logs,
            league.games(s, d).where("ord % 4 = 1").select("season", "game_id", F.explode(F.array(F.struct(F.lit("away_runs").alias("field"), F.lit("1").alias("value"), F.lit(1).cast("long").alias("change_no")), F.struct(F.lit("away_runs").alias("field"), F.lit("2").alias("value"), F.lit(2).cast("long").alias("change_no")), F.struct(F.lit("is_final").alias("field"), F.lit("true").alias("value"), F.lit(3).cast("long").alias("change_no")))).alias("e")).select("season", "game_id", "e.*"),
        ).select("season", "game_id", "away_runs", "home_runs", "is_final"),
        sql("games", "SELECT season, game_id, CASE WHEN ord % 4 = 1 THEN '2' ELSE coalesce(CAST(away_runs AS VARCHAR), '') END AS away_runs, coalesce(CAST(home_runs AS VARCHAR), '') AS home_runs, ord % 4 = 1 OR is_final AS is_final FROM games"),
    ),
    "mu4_cleared_scores": (lambda s, d: mutations.remove(_stored(s, d).logs, league.games(s, d).where("ord % 6 = 5"), ["season", "game_id"]), sql("games", _LOGS_SQL + " WHERE ord % 6 <> 5")),
    "mu5_undone": (lambda s, d: _undone(s, d).matchups.drop("ord"), sql("games", "SELECT season, game_id, strftime(game_date, '%-m/%-d') AS date_text, away_id, home_id FROM games")),
    "o12_locale_order": (lambda s, d: league.teams(s, d).select("season", "team_id", F.row_number().over(_by_name()).cast("long").alias("place")), sql("games", "SELECT season, team_id, row_number() OVER (PARTITION BY season ORDER BY name) AS place FROM teams")),
    "a22_tiles": (_tiles, _power_sql("SELECT q.season, coalesce(completed, 0) AS completed, coalesce(forecasted, 0) AS forecasted, coalesce(avg_confidence, 0) AS avg_confidence, p.name AS top_team, q.tier FROM dq q LEFT JOIN (SELECT season, count(*) FILTER (WHERE is_final) AS completed FROM games GROUP BY season) USING (season) LEFT JOIN (SELECT season, count(*) AS forecasted, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS avg_confidence FROM forecast GROUP BY season) USING (season) LEFT JOIN power p ON p.season = q.season AND p.rank = 1", more=_LEAGUE)),
    "a25_saved_games": (lambda s, d: _saved_games(s, d), sql("games", "SELECT season, count(away_runs) AS saved FROM games GROUP BY season")),
    "f44_winner_labels": (lambda s, d: _winner_labels(s), _sql_values([("actual", "Final"), ("bye", "Bye"), ("projected", "Projected"), ("none", "Pending"), (None, "Pending")], "winner_source, winner_label")),
    "pm8_elo": (lambda s, d: tidy(power.elo(league.games(s, d), league.teams(s, d))), _power_sql("SELECT season, team_id, elo FROM elo", "elo")),
    "pm9_power_ratings": (
        lambda s, d: tidy(_power(s, d).select("season", "rank", "team_id", "name", "rating", "elo", "adj_net", "net_sos", "recent_form", "volatility", "trend", "record", "games")),
        _power_sql("SELECT season, rank, team_id, name, rating, elo, adj_net, net_sos, recent_form, volatility, trend, record, games FROM power", "rating, elo, adj_net, net_sos, recent_form, volatility"),
    ),
    "pm10_league_predictions": (
        lambda s, d: tidy(_forecasts(s, d).select("season", "game_id", "team_a", "team_b", "winner_id", "margin", "p_a", "confidence", "confidence_tier", "score_a", "tier")),
        _power_sql("SELECT season, game_id, team_a, team_b, winner_id, margin, p_a, confidence, confidence_tier, score_a, tier FROM forecast", "margin, p_a, score_a", more=_LEAGUE),
    ),
    "w5_power_ranks": (lambda s, d: tidy(_power(s, d).select("season", "rank", "team_id", "rating")), _power_sql("SELECT season, rank, team_id, rating FROM power", "rating")),
    "o13_first_ratings": (lambda s, d: _power(s, d).where("rank <= 6").select("season", "rank", "name"), _power_sql("SELECT season, rank, name FROM power WHERE rank <= 6")),
    "o11_found_commands": (lambda s, d: _found(s, d), sql("games", _FOUND)),
    "mc1_one_result_states": (
        lambda s, d: _one_result(s, d).select("season", "game_id", "winner_id", "team_id", "w", "l", "rs", "ra", "run_diff", "pct", "tpi"),
        sql("ranked", "SELECT season, game_id, winner_id, team_id, w, l, rs, ra, run_diff, pct, tpi FROM one", "pct, tpi", more=f"{_JOINED}, {_ONE}"),
    ),
    "mc13_one_result_ranks": (lambda s, d: _one_result_ranks(s, d).select("season", "game_id", "winner_id", "team_id", "rank"), sql("ranked", "SELECT season, game_id, winner_id, team_id, rank FROM onerank", more=f"{_JOINED}, {_ONE}, {_ONE_RANKED}")),
    "w13_rank_moves": (lambda s, d: _moves(s, d).select("season", "team_id", "rank_before", "rank", "delta"), _moves_sql("SELECT season, team_id, rank_before, rank, rank_before - rank AS delta FROM mv")),
    "ch6_change_messages": (lambda s, d: _messages(s, d), _moves_sql(_MESSAGES)),
    "w9_season_timeline": (lambda s, d: states.season_timeline(league.games(s, d), league.teams(s, d)), state_sql(_TIMELINE, more=_TIMELINE_MORE)),
}


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("season").orderBy(F.collate("name", "UNICODE"))


def _undone(s: SparkSession, d: str) -> storage.Stored:
    path, kept = shared_dir(s), _stored(s, d)
    if not storage.capture_undo(kept, path, "before"):
        raise OSError(path)
    return storage.restore_undo(s, path)[1]


def _saved_games(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import bracket

    return bracket.saved_games(league.games(s, d))


def _messages(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    return changes.change_messages(_moves(s, d))


def _winner_labels(s: SparkSession) -> DataFrame:
    from pennant.operators import bracket

    return bracket.winner_label(_values(s, [(x,) for x in ("actual", "bye", "projected", "none", None)], "winner_source string"))


# --- the race without simulation: a board of records, scenarios of one result more -----------------


def _board(s: SparkSession, d: str) -> DataFrame:
    """A board whose chance is the winning percentage and whose projected seed is the order by run difference."""
    from pyspark.sql import Window

    by_runs = Window.partitionBy("season").orderBy(F.col("run_diff").desc(), "team_id")
    return derived(s, league.sources(d), "record board", lambda: status_of(s, d).withColumns({"gold_pct": F.floor(F.col("pct") * 100).cast("double"), "projected_rank": F.row_number().over(by_runs).cast("long")}))


def _scenarios(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The seeds that one result more gives, as each team's own scenarios, and the seeds as they are."""
    seeds = _one_result_ranks(s, d).select("season", "game_id", "winner_id", "team_id", F.col("rank").alias("seed"))
    return race.own_scenarios(league.games(s, d), seeds), ranked_of(s, d).select("season", "team_id", F.col("rank").alias("projected_rank"))


_BOARD = "board AS (SELECT *, floor(pct * 100)::DOUBLE AS gold_pct, row_number() OVER (PARTITION BY season ORDER BY run_diff DESC, team_id) AS projected_rank FROM status)"
_TIERS = f"""{_BOARD}, at_cut AS (SELECT season, max(points) FILTER (WHERE rank = 7) AS cut FROM status GROUP BY season),
tiers AS (SELECT season, team_id, rank, projected_rank, CASE WHEN gold_status = 'Clinched' THEN 'Locked In' WHEN gold_status = 'Eliminated' THEN 'Eliminated' WHEN rank <= 5 AND projected_rank <= 7 AND gold_pct >= 80 THEN 'Likely In' WHEN rank <= 7 OR projected_rank <= 7 THEN 'Bubble In' WHEN gold_pct >= 20 OR projected_rank <= 9 OR max_points >= cut THEN 'Bubble Out' ELSE 'Long Shot' END AS tier FROM board JOIN at_cut USING (season))"""
_LABELS = """SELECT season, team_id, CASE WHEN gold_status IN ('Clinched', 'Eliminated') THEN gold_status WHEN rank <= 5 AND projected_rank <= 7 AND gold_pct >= 90 AND NOT exposed THEN 'Firmly In' WHEN rank <= 7 THEN 'In' WHEN projected_rank <= 7 AND gold_pct >= 15 THEN 'Alive' WHEN gold_pct >= 25 AND rank - 7 <= 3 THEN 'Alive' WHEN projected_rank <= 8 AND gold_pct >= 12 THEN 'Alive' ELSE 'Work To Do' END AS label
FROM (SELECT b.*, (SELECT count(*) FROM board c WHERE c.season = b.season AND c.rank > 7 AND c.max_points >= b.points) > greatest(0, 7 - b.rank) AS exposed FROM board b)"""
_IMPORTANT = f"""{_BOARD}, near AS (SELECT season, team_id, greatest(0.0::DOUBLE, 8.0::DOUBLE - abs(rank - 7)) + greatest(0.0::DOUBLE, 50.0::DOUBLE - abs(gold_pct - 50)) / 10 + greatest(0.0::DOUBLE, 5.0::DOUBLE - abs(projected_rank - 7)) AS v FROM board),
imp AS (SELECT g.season, g.game_id, g.ord, g.away_id, g.home_id, a.v + h.v AS importance FROM games g JOIN near a ON a.season = g.season AND a.team_id = g.away_id JOIN near h ON h.season = g.season AND h.team_id = g.home_id WHERE NOT is_final)"""
_OWN = f"""{_JOINED}, {_ONE}, {_ONE_RANKED},
own AS (SELECT g.season, g.game_id, g.team_id, g.opp_id, g.side, g.game_date, g.ord, max(o.rank) FILTER (WHERE o.winner_id = g.team_id) AS win_seed, max(o.rank) FILTER (WHERE o.winner_id <> g.team_id) AS loss_seed
  FROM all_tg g JOIN onerank o ON o.season = g.season AND o.game_id = g.game_id AND o.team_id = g.team_id WHERE NOT g.is_final GROUP BY ALL),
swing AS (SELECT season, team_id, row_number() OVER (PARTITION BY season, team_id ORDER BY game_date, ord) AS nth, game_id, opp_id, side, win_seed, loss_seed FROM own QUALIFY nth <= 2)"""
_SWING_LINE = "CASE WHEN side = 'away' THEN 'at ' ELSE 'vs ' END || o.name || CASE WHEN win_seed <= 7 AND loss_seed > 7 THEN ': win projects inside the Gold cut line at #' || win_seed || '; loss drops outside the Gold cut line at #' || loss_seed || '.' WHEN win_seed <= 7 THEN ': win improves or protects the Gold Bracket path at #' || win_seed || '; loss still projects #' || loss_seed || '.' WHEN loss_seed > 7 THEN ': win projects #' || win_seed || '; loss projects #' || loss_seed || ', so outside help is still needed.' ELSE ': win projects #' || win_seed || '; loss projects #' || loss_seed || '.' END"


def _swings(s: SparkSession, d: str) -> DataFrame:
    """Only games that are among the next two of a team get a result more: their number doesn't grow with the season."""
    g, t = league.games(s, d), stats_of(s, d)

    def made() -> DataFrame:
        near = g.join(schedule.next_games(g, 2).select("season", "game_id").distinct(), ["season", "game_id"], "left_semi")
        seeds = race.one_result_status(near, t, h2h_of(s, d), stats.remaining_counts(g, t), _open(s, d))
        return race.swing_games(race.own_scenarios(near, seeds.withColumnRenamed("rank", "seed")), ranked_of(s, d).withColumnRenamed("rank", "projected_rank"), _open(s, d))

    return derived(s, league.sources(d), "record swings", made)


def _standings_text(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    return changes.standings_text(_board(s, d), Settings(), F.lit("2026-05-10").cast("date"))


def _now_snapshot(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    board = _board(s, d).withColumns({"projected_w": F.col("w"), "projected_t": F.col("t"), "projected_run_diff": F.col("run_diff")})
    return changes.snapshot(board, league.games(s, d))


def _regular_forecasts(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    return changes.forecasts(league.games(s, d), _open(s, d))


def _snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    """The board's snapshot with the latest window open against the one of now."""
    from pennant.operators import changes

    before_games, _ = changes.before_window(league.games(s, d))
    boards = [b.withColumns({"gold_pct": F.floor(F.col("pct") * 100).cast("double"), "projected_w": F.col("w"), "projected_t": F.col("t"), "projected_rank": F.col("rank"), "projected_run_diff": F.col("run_diff")}) for b in _with_window_open(s, d)]
    return changes.diff(changes.snapshot(boards[0], before_games), changes.snapshot(boards[1], league.games(s, d)))


def _diff_sql(body: str) -> str:
    from pennant.plans.oracle import LEAGUE

    more = """cnt AS (SELECT season, count(*) FILTER (WHERE is_final) AS finals FROM games GROUP BY season),
bd AS (SELECT s.*, floor(pct * 100)::DOUBLE AS odds, finals FROM status s JOIN cnt USING (season)),
pr AS (SELECT split_part(a.season, '#', 1) AS season, a.team_id, a.rank <> b.rank AS d_rank, a.odds <> b.odds AS d_odds, a.points <> b.points AS d_points, (a.run_diff, a.rs, a.ra) <> (b.run_diff, b.rs, b.ra) AS d_tied, a.finals <> b.finals AS d_finals, a.rank - b.rank AS rank_by, a.odds - b.odds AS odds_by, a.points - b.points AS points_by
  FROM bd a JOIN bd b ON split_part(a.season, '#', 1) = split_part(b.season, '#', 1) AND a.team_id = b.team_id AND a.season LIKE '%#1' AND b.season LIKE '%#0')"""
    return sql("status", body, more=more).replace(LEAGUE, _TWO(LEAGUE))


#: Projected points are those of the standings here, so both change together.
_DIFFS = """SELECT season, team_id, CASE WHEN d_rank OR d_odds OR d_points OR d_tied OR d_finals THEN 'changed' ELSE 'unchanged' END AS status,
  d_rank::BIGINT + d_odds::BIGINT + 2 * d_points::BIGINT + d_tied::BIGINT + d_finals::BIGINT AS n_changes,
  concat_ws(',', CASE WHEN d_rank AND d_tied THEN 'tiebreak-change' WHEN d_rank THEN 'projection-change' END, CASE WHEN d_odds THEN 'odds-change' END, CASE WHEN d_points AND NOT (d_rank AND NOT d_tied) THEN 'projection-change' END,
    CASE WHEN d_points THEN 'result-change' END, CASE WHEN d_tied AND NOT d_rank THEN 'tiebreak-change' END, CASE WHEN d_finals AND NOT d_points THEN 'result-change' END) AS reasons FROM pr"""

MORE |= {
    "f30_record_tiers": (lambda s, d: race.bubble_tiers(_board(s, d)), sql("status", "SELECT season, team_id, rank, projected_rank, tier FROM tiers", more=_TIERS)),
    "f31_record_labels": (lambda s, d: race.status_labels(_board(s, d)), sql("status", _LABELS, more=_BOARD)),
    "o9_record_movement": (lambda s, d: race.bubble_movement(race.bubble_tiers(_board(s, d))), sql("status", "SELECT season, team_id, rank, projected_rank, tier, row_number() OVER (PARTITION BY season ORDER BY CASE WHEN (rank <= 7) <> (projected_rank <= 7) THEN 0 ELSE 1 END, abs(rank - 7), rank) AS place FROM tiers WHERE rank BETWEEN 6 AND 10 OR (rank <= 7) <> (projected_rank <= 7)", more=_TIERS)),
    "o3_record_importance": (lambda s, d: tidy(race.importance(league.games(s, d), _board(s, d))), sql("status", "SELECT season, game_id, importance FROM imp", "importance", more=_IMPORTANT)),
    "o2_record_top_games": (lambda s, d: tidy((g := league.games(s, d)) and race.top_games(g, race.importance(g, _board(s, d)))), sql("status", "SELECT season, row_number() OVER (PARTITION BY season ORDER BY round(importance, 9) DESC, ord) AS place, game_id, away_id, home_id, importance FROM imp QUALIFY place <= 5", "importance", more=_IMPORTANT)),
    "fil8_record_band": (lambda s, d: standings.cut_band(_board(s, d), 7).select("season", "team_id", "projected_rank"), sql("status", "SELECT season, team_id, projected_rank FROM board WHERE projected_rank BETWEEN 5 AND 10", more=_BOARD)),
    "f42_record_texts": (
        lambda s, d: _standings_text(s, d),
        sql("status", "SELECT season, 'Current Season Standings — 5/10' || chr(10) || 'Top 7 make the Gold Bracket.' || chr(10) || chr(10) || string_agg(CASE WHEN rank <= 7 THEN '★' ELSE ' ' END || ' #' || rank || ' ' || name || ' — ' || w || '-' || l || CASE WHEN t > 0 THEN '-' || t ELSE '' END || ' (' || CAST(gold_pct AS BIGINT) || '% Gold)', chr(10) ORDER BY rank) AS text FROM board GROUP BY season", more=_BOARD),
    ),
    "ch2_record_diffs": (lambda s, d: _snapshot_diff(s, d).select("season", "team_id", "status", F.size("changes").cast("long").alias("n_changes"), F.array_join("reasons", ",").alias("reasons")), _diff_sql(_DIFFS)),
    "ch1_record_snapshot": (
        lambda s, d: tidy(_now_snapshot(s, d).drop("settings")),
        sql("status", "SELECT season, team_id, projected_rank AS rank, gold_pct AS gold_odds, w * 1.0::DOUBLE + t * 0.5::DOUBLE AS projected_points, points AS standings_points, run_diff, rs, ra, n AS matchup_count, n AS log_count, f AS finalized_count FROM board JOIN (SELECT season, count(*) AS n, count(*) FILTER (WHERE is_final) AS f FROM games GROUP BY season) USING (season)", "gold_odds, projected_points, standings_points", more=_BOARD),
    ),
    "o7_regular_forecasts": (
        lambda s, d: tidy(_regular_forecasts(s, d)),
        sql("ranked", f"SELECT season, game_id, game_date, winner_id, winner_pct, 'Regular Season' AS source, row_number() OVER (PARTITION BY season ORDER BY game_date, game_id) AS place FROM (SELECT p.season, p.game_id, g.game_date, p.winner_id, greatest(away_pct, 1 - away_pct) AS winner_pct FROM ({prediction_sql(False, 1.0)}) p JOIN games g USING (season, game_id))", "winner_pct", more=_JOINED),
    ),
    "mc9_one_result_ranges": (lambda s, d: race.seed_ranges(*_scenarios(s, d)), sql("ranked", "SELECT r.season, r.team_id, least(r.rank, min(least(win_seed, loss_seed))) AS best, greatest(r.rank, max(greatest(win_seed, loss_seed))) AS worst, r.rank AS baseline FROM ranked r LEFT JOIN own USING (season, team_id) GROUP BY r.season, r.team_id, r.rank", more=_OWN)),
    "mc10_one_result_swings": (lambda s, d: _swings(s, d).select("season", "team_id", "nth", "game_id", "opp_id", "side", "win_seed", "loss_seed"), sql("ranked", "SELECT season, team_id, nth, game_id, opp_id, side, win_seed, loss_seed FROM swing", more=_OWN)),
    "mc11_one_result_impacts": (
        lambda s, d: race.game_impacts(_scenarios(s, d)[0], _open(s, d)).select("season", "game_id", "away_seed_win", "away_seed_loss", "home_seed_win", "home_seed_loss", "seed_impact", "impact_label"),
        sql("ranked", "SELECT season, game_id, aw AS away_seed_win, al AS away_seed_loss, hw AS home_seed_win, hl AS home_seed_loss, greatest(abs(al - aw), abs(hl - hw)) AS seed_impact, CASE WHEN greatest(abs(al - aw), abs(hl - hw)) >= 3 THEN 'High' WHEN greatest(abs(al - aw), abs(hl - hw)) >= 1 THEN 'Medium' ELSE 'Low' END AS impact_label FROM (SELECT season, game_id, " + ", ".join(f"max({r}_seed) FILTER (WHERE side = '{sd}') AS {sd[0]}{r[0]}" for sd in ("away", "home") for r in ("win", "loss")) + " FROM own GROUP BY season, game_id)", more=_OWN),
    ),
    "mc16_one_result_lines": (
        lambda s, d: race.clinch_scenarios(_board(s, d), _swings(s, d)),
        sql("status", f"SELECT b.season, b.team_id, CASE WHEN b.gold_status = 'Clinched' THEN b.name || ' have already clinched a Gold Bracket spot.' WHEN b.gold_status = 'Eliminated' THEN b.name || ' are eliminated from Gold Bracket contention.' ELSE coalesce(lines, b.name || ' have no remaining games; Gold Bracket status depends only on outside results.') END AS lines FROM status b LEFT JOIN (SELECT s.season, s.team_id, string_agg({_SWING_LINE}, ' | ' ORDER BY nth) AS lines FROM swing s JOIN teams o ON o.season = s.season AND o.team_id = s.opp_id GROUP BY 1, 2) x USING (season, team_id)", more=_OWN),
    ),
}


# --- operators that others contain, each by itself --------------------------------------------------


def _two_snapshots(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of which one lacks N03 and the other N07."""
    from pennant.operators import changes

    now = _now_snapshot(s, d)
    return changes.diff(now.where("team_id <> 'N03'"), now.where("team_id <> 'N07'"))


def _legacy(s: SparkSession, d: str) -> DataFrame:
    path = shared_dir(s)
    storage.save(league.teams(s, d).select("season", "team_id", "name", "ord"), f"{path}/former")
    return storage.load(s, f"{path}/now", storage.TEAMS, f"{path}/former")


def _bad_files(s: SparkSession) -> DataFrame:
    """What is said of files without rows, without a required column, and of one with a byte order mark."""
    said = []
    for lines in ((), ("Game ID,Date,Away Team,Home Team",), ("Game ID,Date,Away Team", "g,5/1,A"), ("﻿Game ID, DATE,away team,Home  Team", "g,5/1,A,B")):
        path = shared_dir(s)
        s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        try:
            said.append((len(said), str(schedule_csv.read_rows(s, path).first().home)))
        except ValueError as e:
            said.append((len(said), str(e)))
    return _values(s, said, "i long, said string")


_OPP = "SELECT g.season, g.game_id, g.team_id, o.games AS opp_games, o.run_diff AS opp_diff FROM tg g JOIN totals o ON g.season = o.season AND g.opp_id = o.team_id"


def _opponents(s: SparkSession, d: str) -> DataFrame:
    g = league.games(s, d)
    o = stats.team_totals(g, league.teams(s, d)).select("season", F.col("team_id").alias("opp_id"), F.col("games").alias("opp_games"), F.col("run_diff").alias("opp_diff"))
    return stats.team_games(stats.finals(g)).join(o, ["season", "opp_id"]).select("season", "game_id", "team_id", "opp_games", "opp_diff")


MORE |= {
    "p1_derived_columns": (lambda s, d: tidy(stats.rates(stats.team_totals(league.games(s, d), league.teams(s, d))).withColumn("net", F.col("rsg") - F.col("rag")).select("season", "team_id", "net")), sql("rates", "SELECT season, team_id, rsg - rag AS net FROM rates", "net")),
    "p3_public_columns": (lambda s, d: ranked_of(s, d).drop("base_tpi", "league_k6", "away_ks", "home_ks", "away_inns", "home_inns", "sos", "momentum", "machine_difficulty").select("season", "team_id", "rank", "w", "l", "t"), sql("ranked", "SELECT season, team_id, rank, w, l, t FROM ranked")),
    "j3_opponents": (_opponents, sql("totals", _OPP)),
    "j5_known_games": (lambda s, d: league.games(s, d).join(league.teams(s, d).where("ord % 3 <> 0").select("season", F.col("team_id").alias("away_id")), ["season", "away_id"], "left_semi").select("season", "game_id"), sql("games", "SELECT season, game_id FROM games g WHERE away_id IN (SELECT team_id FROM teams t WHERE t.season = g.season AND ord % 3 <> 0)")),
    "j6_orphans": (lambda s, d: validate.added_removed(league.teams(s, d).where("ord <> 4"), league.teams(s, d).where("ord <> 9"), "team_id"), sql("games", "SELECT season, team_id, CASE WHEN ord = 9 THEN 'added' ELSE 'removed' END AS change FROM teams WHERE ord IN (4, 9)")),
    "j7_snapshot_union": (lambda s, d: _two_snapshots(s, d).select("season", "team_id", "status"), sql("games", "SELECT season, team_id, CASE team_id WHEN 'N03' THEN 'added' WHEN 'N07' THEN 'removed' ELSE 'unchanged' END AS status FROM teams")),
    "f35_equal_snapshots": (lambda s, d: _two_snapshots(s, d).groupBy("season", "status").agg(F.count("*").alias("n"), F.sum(F.size("changes")).cast("long").alias("changes")), sql("games", "SELECT season, status, n, n * CASE WHEN status = 'unchanged' THEN 0 ELSE 1 END AS changes FROM (SELECT season, CASE team_id WHEN 'N03' THEN 'added' WHEN 'N07' THEN 'removed' ELSE 'unchanged' END AS status, count(*) AS n FROM teams GROUP BY 1, 2)")),
    "u2_all_ids": (lambda s, d: _two_snapshots(s, d).select("season", "team_id"), sql("games", "SELECT season, team_id FROM teams")),
    "j8_rivals": (lambda s, d: status_of(s, d).select("season", "team_id", "blockers_ahead", "catchers"), sql("status", "SELECT season, team_id, blockers_ahead, catchers FROM status")),
    "j9_pairs": (lambda s, d: schedule.round_robin(league.teams(s, d)).groupBy("season", "away_id").agg(F.count("*").alias("n")), sql("games", "SELECT a.season, a.team_id AS away_id, count(*) AS n FROM teams a JOIN teams h ON a.season = h.season AND a.ord < h.ord GROUP BY 1, 2")),
    "rec4_removed_finals": (lambda s, d: (n := _next(s, d)) and validate.changed_finals(n[0], n[1]).where("change = 'removed'").select("season", "game_id"), sql("games", "SELECT season, game_id FROM games WHERE is_final AND ord % 9 = 0")),
    "u3_shared_opponents": (lambda s, d: stats.common_opponents(league.games(s, d)).groupBy("season").agg(F.sum("n_common").alias("n")), sql("tg", "SELECT p.season, CAST(count(b.opp_id) AS BIGINT) AS n FROM (SELECT * FROM met WHERE team_id < opp_id) p LEFT JOIN met a ON a.season = p.season AND a.team_id = p.team_id LEFT JOIN met b ON b.season = p.season AND b.team_id = p.opp_id AND b.opp_id = a.opp_id GROUP BY p.season", more="met AS (SELECT DISTINCT season, team_id, opp_id FROM tg)")),
    "u4_removed_games": (lambda s, d: (n := _next(s, d)) and validate.added_removed(n[0], n[1], "game_id").where("change = 'removed'").select("season", "game_id"), sql("games", "SELECT season, game_id FROM games WHERE ord % 9 = 0")),
    "f43_finished_seasons": (lambda s, d: stats.counts(league.games(s, d)).select("season", "finalized", fn.date_label(F.col("latest_final")).alias("latest")), sql("games", "SELECT season, count(*) FILTER (WHERE is_final) = count(*) AS finalized, coalesce(strftime(max(game_date) FILTER (WHERE is_final), '%-m/%-d'), 'No Date') AS latest FROM games GROUP BY season")),
    "pm7_aggression": (lambda s, d: _values(s, [(m, Settings(model_aggression=m).aggression) for m in ("Conservative", "Balanced", "Aggressive")], "model string, factor double"), _sql_values([("Conservative", 0.6), ("Balanced", 1.0), ("Aggressive", 1.4)], "model, factor")),
    "pm11_predicted_games": (lambda s, d: _open(s, d).select("season", "game_id", "winner_id"), sql("ranked", f"SELECT season, game_id, winner_id FROM ({prediction_sql(False, 1.0)})", more=_JOINED)),
    "ch3_record_reasons": (
        lambda s, d: _reasons_of(s, d),
        _diff_sql("SELECT season, array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ','))))), ',') AS reasons FROM (" + _DIFFS + ") WHERE reasons <> '' GROUP BY season"),
    ),
    "src2_file_errors": (lambda s, d: _bad_files(s).where("i < 3"), _sql_values([(0, "CSV has no rows"), (1, "CSV has no rows"), (2, "Missing required columns")], "i, said")),
    "src5_byte_order_mark": (lambda s, d: _bad_files(s).where("i = 3"), _sql_values([(3, "B")], "i, said")),
    "src7_former_tables": (_legacy, sql("games", "SELECT season, team_id, name, ord FROM teams")),
}


def _reasons_of(s: SparkSession, d: str) -> DataFrame:
    """The reasons of each season, in the order of the alphabet; seasons in which nothing changed have none."""
    from pennant.operators import changes

    r = changes.diff_reasons(_snapshot_diff(s, d)).where("reasons <> ''")
    return r.select("season", F.array_join(F.sort_array(F.split("reasons", ",")), ",").alias("reasons"))


# --- dashboards, snapshots and explanations on records ------------------------------------------------


def _dashboard(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import simulate

    b = _board(s, d)
    projected = b.select("season", "team_id", "projected_rank", "w", "l", "t", "run_diff")
    return simulate.dashboard(status_of(s, d), projected, b.select("season", "team_id", F.col("gold_pct").alias("odds")))


def _explained(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    return changes.explanations(_snapshot_diff(s, d))


_DASHBOARD = f"""{_BOARD}, wil AS (SELECT *, gold_pct / 100 AS p FROM board),
wi2 AS (SELECT *, (p + 3.8416::DOUBLE / 440) / (1 + 3.8416::DOUBLE / 220) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / 220 + 3.8416::DOUBLE / (4 * 220 * 220)) / (1 + 3.8416::DOUBLE / 220) AS sp FROM wil),
dash AS (SELECT *, greatest(p - greatest(0, least(1, c - sp)), greatest(0, least(1, c + sp)) - p) * 100 AS gold_margin, row_number() OVER (PARTITION BY season ORDER BY projected_rank, round(gold_pct, 2) DESC, rank) AS model_place FROM wi2)"""
_COUNT = "CASE WHEN abs(v) = floor(abs(v)) THEN CAST(CAST(abs(v) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', abs(v)) END"
_EXPLAIN = f"""SELECT season, team_id, nth, text, impact FROM (
  SELECT *, row_number() OVER (PARTITION BY season, team_id ORDER BY impact DESC, i) AS nth FROM (
    SELECT season, team_id, i, CASE i WHEN 0 THEN abs(v) * 24 + 12 WHEN 1 THEN abs(v) / 3.0::DOUBLE * 22 + 10 WHEN 2 THEN abs(v) / 0.5::DOUBLE * 18 + 8 ELSE abs(v) / 0.5::DOUBLE * 18 + 7 END AS impact,
      CASE WHEN i = 0 THEN CASE WHEN d_tied THEN 'Tiebreak movement' ELSE 'Recent results' END || CASE WHEN v < 0 THEN ' lifted the projected finish by ' ELSE ' pushed the projected finish down by ' END || {_COUNT} || CASE WHEN abs(v) = 1 THEN ' spot.' ELSE ' spots.' END
        WHEN i = 1 THEN CASE WHEN v > 0 THEN 'Gold odds lifted by ' ELSE 'Gold odds dipped by ' END || CAST(CAST(abs(v) AS BIGINT) AS VARCHAR) || CASE WHEN abs(v) = 1 THEN ' point' ELSE ' points' END || CASE WHEN v > 0 AND rank_by > 0 THEN ' as the projected finish moved up.' WHEN v > 0 THEN ' after the projection moved up.' WHEN rank_by > 0 THEN ' after the projected finish moved closer to the cutoff.' ELSE ' after the projection moved down.' END
        WHEN i = 2 AND v > 0 THEN 'Projected points nudged up by ' || {_COUNT} || ', lifting the Gold outlook.' WHEN i = 2 THEN 'Projected points dipped by ' || {_COUNT} || ', softening the Gold outlook.'
        WHEN v > 0 THEN 'Standings points moved up by ' || {_COUNT} || ' after recent results.' ELSE 'Standings points dipped by ' || {_COUNT} || ' after recent results.' END AS text
    FROM (SELECT pr.*, x.i, x.v FROM pr, LATERAL (VALUES (0, rank_by::DOUBLE, 1.0::DOUBLE), (1, odds_by::DOUBLE, 3.0::DOUBLE), (2, points_by::DOUBLE, 0.5::DOUBLE), (3, points_by::DOUBLE, 0.5::DOUBLE)) x(i, v, least_v) WHERE abs(x.v) >= x.least_v))) WHERE nth <= 3"""

MORE |= {
    "j4_record_board": (
        lambda s, d: tidy(_dashboard(s, d).select("season", "team_id", "rank", "projected_rank", "projected_w", "projected_l", "gold_pct", "gold_margin", "gold_status")),
        sql("status", "SELECT season, team_id, rank, projected_rank, w AS projected_w, l AS projected_l, gold_pct, gold_margin, gold_status FROM dash", "gold_pct, gold_margin", more=_DASHBOARD),
    ),
    "o1_record_rows": (lambda s, d: _dashboard(s, d).select("season", "model_place", "team_id"), sql("status", "SELECT season, model_place, team_id FROM dash", more=_DASHBOARD)),
    "mc17_record_snapshot": (lambda s, d: tidy(_dashboard(s, d).select("season", "team_id", "rank", "projected_rank", "gold_status", "max_points", "blockers_ahead")), sql("status", "SELECT season, team_id, rank, projected_rank, gold_status, max_points, blockers_ahead FROM board", "max_points", more=_BOARD)),
    "ch4_record_explanations": (lambda s, d: tidy(_explained(s, d)), _diff_sql(_EXPLAIN).replace("SELECT * FROM (\nSELECT season, team_id, nth", "SELECT * REPLACE (round(impact + 1e-9, 6) + 0.0 AS impact) FROM (\nSELECT season, team_id, nth")),
}


# --- paths on records and on one result more -----------------------------------------------------------


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Clinching paths without exact numbers, as for seasons with too many open games."""
    board = _board(s, d)
    exact = board.select("season", "team_id", F.lit(None).cast("string").alias("magic"), F.lit(None).cast("long").alias("losses_to_out"))
    return race.clinching_paths(league.games(s, d), board, exact, _swings(s, d))


def _path_texts(s: SparkSession, d: str) -> DataFrame:
    from pennant.operators import changes

    return changes.path_summary(_board(s, d), _swings(s, d))


def _control(s: SparkSession, d: str) -> DataFrame:
    """Control levels where no season was won out."""
    board = _board(s, d)
    return race.control_levels(board, board.select("season", "team_id", F.lit(None).cast("long").alias("win_out_seed")), _swings(s, d))


_PATH_LINE = f"""{_BOARD}, {_OWN},
pl AS (SELECT s.season, s.team_id, string_agg(CASE WHEN side = 'away' THEN 'at ' ELSE 'vs ' END || o.name || ' (win → #' || win_seed || ', loss → #' || loss_seed || ')', ' and ' ORDER BY nth) AS line FROM swing s JOIN teams o ON o.season = s.season AND o.team_id = s.opp_id GROUP BY 1, 2),
ld AS (SELECT season, name AS leader FROM board WHERE rank = 1)"""
_PATH_TEXT = """SELECT season, team_id, CASE
  WHEN gold_status = 'Clinched' THEN name || ' have clinched a Gold Bracket ticket at #' || rank || '; now it''s all about sharpening their blade for seeding battles.'
  WHEN gold_status = 'Eliminated' THEN name || ' are mathematically eliminated from the Gold race, but they still get to play spoiler and reshape everyone else''s path.'
  WHEN rank <= 7 AND projected_rank <= 7 THEN name || ' are holding firm at #' || rank || ' with a projection of #' || projected_rank || ' and ' || pct || '% Gold odds — safely above the line for now. Next two pressure points: ' || line || '.'
  WHEN rank <= 7 THEN name || ' currently own #' || rank || ', but the model sees a slide to #' || projected_rank || ' as the stretch run unfolds (' || pct || '% Gold). ' || CASE WHEN line <> '' THEN 'They need to defend that cushion immediately: ' || line || '.' ELSE 'Every remaining loss is gasoline on the fire.' END
  WHEN projected_rank <= 7 THEN name || ' are sitting at #' || rank || ' today but are projected to rise to #' || projected_rank || ' (' || pct || '% Gold). The door is cracked open if these next two tilt their way: ' || line || '.'
  WHEN CAST(pct AS BIGINT) >= 15 THEN name || ' are #' || rank || ' now and project to #' || projected_rank || ' — still outside the line, but ' || pct || '% means they''re alive and dangerous. ' || leader || ' currently set the pace up top.' || CASE WHEN line <> '' THEN ' Swing games to circle: ' || line || '.' ELSE '' END
  ELSE name || ' are in survival mode (now #' || rank || ', projected #' || projected_rank || ', ' || pct || '% Gold): they need wins plus help from around the league.' || CASE WHEN line <> '' THEN ' Must-watch swings: ' || line || '.' ELSE '' END END AS text
FROM (SELECT b.season, b.team_id, b.name, b.rank, b.projected_rank, b.gold_status, CAST(CAST(floor(gold_pct + 0.5) AS BIGINT) AS VARCHAR) AS pct, coalesce(line, '') AS line, leader FROM board b LEFT JOIN pl USING (season, team_id) JOIN ld USING (season))"""
_PATHS = f"""{_BOARD}, {_OWN},
near AS (SELECT *, least(abs(rank - 7), abs(projected_rank - 7)) AS dist, rank <= 7 AS inside, projected_rank <= 7 AS planned, floor(gold_pct + 0.5)::BIGINT AS pct0 FROM board),
sl AS (SELECT s.season, s.team_id, list(line ORDER BY nth) FILTER (WHERE line IS NOT NULL) AS lines FROM (
  SELECT s.season, s.team_id, nth, CASE WHEN win_seed <= 7 AND loss_seed > 7 THEN opp || ': win projects inside Gold (#' || win_seed || '); loss falls outside (#' || loss_seed || ').' WHEN win_seed <= 7 AND dist <= 2 THEN opp || ': win protects the path (#' || win_seed || '); loss still projects #' || loss_seed || '.' WHEN win_seed > 7 AND NOT inside AND dist <= 3 THEN opp || ': win projects #' || win_seed || '; extra help is still needed.' END AS line
  FROM (SELECT s.*, n.dist, n.inside, CASE WHEN side = 'away' THEN 'At ' ELSE 'Vs ' END || o.name AS opp FROM swing s JOIN near n USING (season, team_id) JOIN teams o ON o.season = s.season AND o.team_id = s.opp_id) s) s GROUP BY 1, 2),
help AS (SELECT t.season, t.team_id, t.name || ' get help if ' || r.name || ' lose to ' || o.name || '.' AS help FROM near t JOIN (SELECT g.season, g.team_id AS rival, g.opp_id, g.ord, b.rank, b.name FROM all_tg g JOIN board b ON b.season = g.season AND b.team_id = g.team_id WHERE NOT g.is_final AND b.rank BETWEEN 4 AND 7) r ON r.season = t.season AND t.team_id <> r.rival AND t.team_id <> r.opp_id JOIN teams o ON o.season = r.season AND o.team_id = r.opp_id QUALIFY row_number() OVER (PARTITION BY t.season, t.team_id ORDER BY r.rank DESC, r.ord, r.rival) = 1),
cp AS (SELECT n.*, coalesce(h.help, 'Needs help from teams above the line.') AS help, coalesce(lines, []) AS lines, CASE WHEN gold_status IN ('Alive', 'In') THEN 30 ELSE 0 END + greatest(0, 16 - dist * 4) + CASE WHEN inside <> planned THEN 15 ELSE 0 END + CASE WHEN abs(50 - pct0) <= 35 THEN 15.0::DOUBLE - abs(50 - pct0) / 4 ELSE 0 END AS priority FROM near n LEFT JOIN help h USING (season, team_id) LEFT JOIN sl USING (season, team_id))"""
_PATH_ROWS = """SELECT season, row_number() OVER (PARTITION BY season ORDER BY priority DESC, rank) AS place, team_id, rank AS seed, projected_rank, pct0 AS gold_pct, gold_status AS status, priority,
  array_to_string(list_prepend(CASE WHEN inside AND planned THEN 'Controls a Gold spot by protecting the current cut-line cushion.' WHEN planned THEN 'Projected path reaches Gold, but the team still needs the swing games to break their way.' WHEN NOT inside THEN help ELSE 'Currently above the line, but the projected path is fragile.' END, CASE WHEN lines[1] = lines[2] THEN lines[1:1] ELSE lines END)[1:3], ' | ') AS notes
FROM cp WHERE gold_status NOT IN ('Clinched', 'Eliminated') QUALIFY place <= 8"""

MORE |= {
    "mc12_record_control": (_control, sql("status", "SELECT season, team_id, CASE WHEN gold_status IN ('Clinched', 'Eliminated') THEN gold_status WHEN rank <= 7 THEN 'Controls Spot' ELSE 'Needs Help' END AS control FROM status")),
    "f40_record_paths": (_path_texts, sql("status", _PATH_TEXT, more=_PATH_LINE)),
    "mc15_record_paths": (lambda s, d: tidy(_paths(s, d)), sql("status", _PATH_ROWS, "priority", more=_PATHS)),
    "o4_record_order": (lambda s, d: _paths(s, d).select("season", "place", "team_id"), sql("status", f"SELECT season, place, team_id FROM ({_PATH_ROWS})", more=_PATHS)),
}
