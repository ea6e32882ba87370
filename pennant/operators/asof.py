"""The backtest in rows that grow with the finals: each final's two teams as they stood before it.

What a team's schedule was worth then depends on how its former opponents stood at that moment. A
season's finals are cut into blocks: what each team had done against each other before a block are
running sums over the blocks, and within a block the lines of all teams follow by running sums on
arrays. So a block is one group, whatever the season's length, and no row is made for a final and
an opponent met.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.operators.predict import READS, predict
from pennant.operators.stats import capped, finals, team_games
from pennant.settings import RUN_CAP, Settings

#: Finals of a block; the latest games that a team's form counts.
BLOCK, FORM = 4096, 6
_SUMS = ["games", "w", "l", "t", "rs", "ra", "run_diff", "hits", "hits_allowed", "ks", "errors", "opp_errors", "walks_allowed", "walks_received", "away_ks", "away_inns", "home_ks", "home_inns", "at_home", "six"]
_AT = {c: i for i, c in enumerate(_SUMS)}


def in_order(games: DataFrame) -> DataFrame:
    """Finals with seq, their place by date and id from 0, and n, the season's finals."""
    w = Window.partitionBy("season").orderBy(F.col("game_date").asc_nulls_last(), "game_id")
    return finals(games).withColumns({"seq": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("season"))})


def _line(cap: int) -> list[Column]:
    """What one game adds to its team's totals (_SUMS); six: the opponent's strikeouts in six innings at this team's home."""
    d = F.col("runs") - F.col("opp_runs")
    away, home = F.col("side") == "away", F.col("side") == "home"
    one = lambda c: F.when(c, 1).otherwise(0)
    only = lambda s, c: F.when(s, F.col(c)).otherwise(0)
    of = {
        "games": F.lit(1), "w": one(d > 0), "l": one(d < 0), "t": one(d == 0),
        "rs": F.col("runs"), "ra": F.col("opp_runs"), "run_diff": capped(d, cap),
        "hits": F.col("hits"), "hits_allowed": F.col("opp_hits"), "ks": F.col("k"),
        "errors": F.col("errors"), "opp_errors": F.col("opp_errors"), "walks_allowed": F.col("walks"), "walks_received": F.col("opp_walks"),
        "away_ks": only(away, "k"), "away_inns": only(away, "innings"), "home_ks": only(home, "k"), "home_inns": only(home, "innings"),
        "at_home": one(home), "six": F.when(home, F.col("opp_k").cast("double") / F.col("innings") * 6),
    }
    return [F.coalesce(of[c], F.lit(0)).cast("double" if c == "six" else "long").alias(c) for c in _SUMS]


def _openings(tg: DataFrame, known: DataFrame) -> DataFrame:
    """season, block, team_id, opp_id, sums of the team's games against the opponent before the block.

    For each listed team a row without sums: latest, its last games against listed teams before the block, oldest first.
    """
    last = tg.groupBy("season").agg(F.max("block").alias("_last"))
    blocks = last.select("season", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("block"))
    sums = tg.groupBy("season", "block", "team_id", "opp_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    # in every block after a pair's first meeting, also where it didn't meet
    pairs = tg.groupBy("season", "team_id", "opp_id").agg(F.min("block").alias("_first")).join(last, "season")
    pairs = pairs.select("season", F.explode(F.sequence("_first", "_last")).alias("block"), "team_id", "opp_id", *[F.lit(0).cast("double" if c == "six" else "long").alias(c) for c in _SUMS])
    met = sums.unionByName(pairs).groupBy("season", "block", "team_id", "opp_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    past = Window.partitionBy("season", "team_id", "opp_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select("season", "block", "team_id", "opp_id", *[F.sum(c).over(past).alias(c) for c in _SUMS]).where("games > 0")

    listed = tg.select("season", "block", "seq", "team_id", "opp_id", (F.col("rs") - F.col("ra")).alias("diff"))
    for c in ("team_id", "opp_id"):
        listed = listed.join(known.withColumnRenamed("team_id", c), ["season", c], "left_semi")
    newest = Window.partitionBy("season", "block", "team_id").orderBy(F.col("seq").desc())
    run = listed.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= FORM)
    run = run.groupBy("season", "block", "team_id").agg(F.sort_array(F.collect_list(F.struct("seq", "diff", "opp_id"))).alias("run"))
    every = known.join(blocks, "season").join(run, ["season", "block", "team_id"], "left").withColumn("has", F.col("run").isNotNull())
    # each block with games adds one at least, so the games of as many blocks hold the latest
    gathered = F.flatten(F.collect_list("run").over(Window.partitionBy("season", "team_id", "has").orderBy("block").rowsBetween(1 - FORM, 0)))
    every = every.withColumn("upto", F.when(F.col("has"), F.slice(gathered, F.greatest(F.size(gathered) - FORM + 1, F.lit(1)), F.lit(FORM))))
    latest = F.last("upto", ignorenulls=True).over(Window.partitionBy("season", "team_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    every = every.select("season", "block", "team_id", F.lit(None).cast("string").alias("opp_id"), *[F.lit(None).cast("double" if c == "six" else "long").alias(c) for c in _SUMS], F.coalesce(latest, F.array().cast("array<struct<seq:int,diff:long,opp_id:string>>")).alias("latest"))
    return met.withColumn("latest", F.lit(None).cast("array<struct<seq:int,diff:long,opp_id:string>>")).unionByName(every)


def _ratio(a: np.ndarray, b: np.ndarray, none: float = 0.0) -> np.ndarray:
    """a / b, none where b is 0."""
    return np.where(b > 0, a / np.where(b > 0, b, 1), none)


def _index(s: dict[str, np.ndarray], k6: np.ndarray) -> np.ndarray:
    """A6 on totals: the index before the schedule counts."""
    inns = s["away_inns"] + s["home_inns"]
    contact = np.where(inns > 0, np.clip((k6 - _ratio(s["away_ks"] + s["home_ks"], inns) * 6) * 0.35, -1.25, 1.25), 0.0)
    return np.where(s["games"] > 0, np.clip(_ratio(s["run_diff"], s["games"]), -8, 8) + _ratio(s["w"] + s["t"] * 0.5, s["games"]) * 2 + contact, 0.0)


def _named(sums: np.ndarray) -> dict[str, np.ndarray]:
    return {c: sums[:, i] for c, i in _AT.items()}


def _reads(s: dict[str, np.ndarray], k6: np.ndarray, schedule: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """READS of totals and what the schedule was worth."""
    g = s["games"]
    inns, per = s["away_inns"] + s["home_inns"], _ratio(s["run_diff"], g)
    sos = _ratio(schedule["opp_sum"], g)
    # without a game against a listed team the bound, as in the SQL
    swing = np.where(schedule["ws"] > 0, np.clip(_ratio(schedule["wd"], schedule["ws"]) - per + _ratio(schedule["wo"], schedule["ws"]) * 0.18, -4.5, 4.5), 4.5)
    return {
        "games": g, "rs": s["rs"], "ra": s["ra"], "run_diff": s["run_diff"], "pct": _ratio(s["w"] + s["t"] * 0.5, g),
        "rsg": _ratio(s["rs"], g), "rag": _ratio(s["ra"], g), "hpg": _ratio(s["hits"], g), "kpg": _ratio(s["ks"], g),
        "total_k6": _ratio(s["away_ks"] + s["home_ks"], inns, np.nan) * 6, "away_k6": _ratio(s["away_ks"], s["away_inns"], np.nan) * 6, "home_k6": _ratio(s["home_ks"], s["home_inns"], np.nan) * 6,
        "tpi": _index(s, k6) + sos * 0.2, "sos": sos, "momentum": np.where(g >= 3, swing, 0.0),
        "machine_difficulty": np.clip(_ratio(schedule["six"] - schedule["base_sum"], schedule["at_home"]), -3, 3),
        "hit_diff": s["hits"] - s["hits_allowed"], "walk_diff": s["walks_received"] - s["walks_allowed"], "error_diff": s["opp_errors"] - s["errors"],
        "walks_allowed_pg": _ratio(s["walks_allowed"], g), "errors_pg": _ratio(s["errors"], g),
    }


def _block(opening: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """READS of both teams, league scalars and the record between them before each final of a block."""
    listed = opening["latest"].notna()
    ids = opening.loc[listed, "team_id"].tolist()
    at, m = {t: i for i, t in enumerate(ids)}, len(ids)
    place = lambda ids: ids.map(at).fillna(-1).to_numpy(np.int64)
    past = opening[~listed]
    sums, px, py = past[_SUMS].to_numpy(np.float64), place(past["team_id"]), place(past["opp_id"])
    sides = sides.sort_values(["seq", "side"])
    lines, x, y = sides[_SUMS].to_numpy(np.float64), place(sides["team_id"]), place(sides["opp_id"])
    n = len(sides) // 2

    # the league's values before each final
    parts = lambda v, t: np.column_stack([v[:, [_AT["games"], _AT["rs"], _AT["ks"]]] * (t >= 0)[:, None], v[:, _AT["ks"]], v[:, _AT["away_inns"]] + v[:, _AT["home_inns"]]])
    each = parts(lines, x)
    league = np.cumsum(np.vstack([parts(sums, px).sum(0), each[0::2] + each[1::2]]), 0)[:-1]
    lg_runs, lg_k = _ratio(league[:, 1], league[:, 0], 7.0), _ratio(league[:, 2], league[:, 0], 4.5)
    k6 = np.where(league[:, 4] > 30, _ratio(league[:, 3], league[:, 4]) * 6, 4.5)

    # each team's own games, its totals before them, and its index in all states
    start = np.zeros((m, len(_SUMS)))
    np.add.at(start, px[px >= 0], sums[px >= 0])
    by_team = np.argsort(x, kind="stable")
    bounds = np.searchsorted(x[by_team], np.arange(m + 1))
    own = [by_team[bounds[i] : bounds[i + 1]] for i in range(m)]
    before, index, baseline = np.full((2 * n, len(_SUMS)), np.nan), np.zeros((n, m)), np.zeros((n, m))
    for i, rows in enumerate(own):
        run = np.cumsum(np.vstack([start[i], lines[rows]]), 0)
        before[rows] = run[:-1]
        s = _named(run[np.searchsorted(rows // 2, np.arange(n))])
        inns = s["away_inns"] + s["home_inns"]
        index[:, i] = _index(s, k6)
        baseline[:, i] = np.where(inns > 0, (s["away_ks"] + s["home_ks"] + k6 * 2) / (inns + 12) * 6, k6)

    # what it had done against each listed team, and what these were worth then
    met = np.zeros((5, m, m))
    both = (px >= 0) & (py >= 0)
    columns = [_AT[c] for c in ("games", "at_home", "w", "l", "t")]
    met[:, px[both], py[both]] = sums[both][:, columns].T
    six = np.zeros(m)
    np.add.at(six, px[both], sums[both, _AT["six"]])
    latest = dict(zip(ids, opening.loc[listed, "latest"], strict=True))
    schedule = {c: np.full(2 * n, np.nan) for c in ("opp_sum", "base_sum", "at_home", "six", "ws", "wd", "wo")}
    record = np.zeros((3, 2 * n))
    for i, rows in enumerate(own):
        if not len(rows):
            continue
        j, k, known = np.arange(len(rows)), rows // 2, y[rows] >= 0
        new = np.zeros((5, len(rows) + 1, m))
        new[:, 0] = met[:, i]
        new[:, j[known] + 1, y[rows][known]] = lines[rows][known][:, columns].T
        n_met, at_home, *results = np.cumsum(new, 1)[:, :-1]
        schedule["opp_sum"][rows] = (n_met * index[k]).sum(1)
        schedule["base_sum"][rows] = (at_home * baseline[k]).sum(1)
        schedule["at_home"][rows] = at_home.sum(1)
        schedule["six"][rows] = np.cumsum(np.concatenate([[six[i]], np.where(known, lines[rows, _AT["six"]], 0.0)]))[:-1]
        record[:, rows] = [np.where(known, r[j, y[rows]], 0.0) for r in results]
        # the latest games against listed teams, newest first
        old = latest[ids[i]]
        diff = np.concatenate([[e["diff"] for e in old], (lines[rows, _AT["rs"]] - lines[rows, _AT["ra"]])[known]])
        opp = np.concatenate([[at[e["opp_id"]] for e in old], y[rows][known]]).astype(np.int64)
        event = len(old) + np.concatenate([[0], np.cumsum(known)])[:-1, None] - 1 - np.arange(FORM)
        weight = np.where(event >= 0, 0.72 ** np.arange(FORM), 0.0)
        event = np.maximum(event, 0)
        schedule["ws"][rows] = weight.sum(1)
        if len(opp):
            schedule["wd"][rows] = (diff[event] * weight).sum(1)
            schedule["wo"][rows] = (index[k[:, None], opp[event]] * weight).sum(1)

    reads = _reads(_named(before), np.repeat(k6, 2), schedule)
    out = {"game_id": sides["game_id"].to_numpy(object)[0::2], "away_id": sides["team_id"].to_numpy(object)[0::2], "home_id": sides["opp_id"].to_numpy(object)[0::2]}
    out |= {"away_runs": lines[0::2, _AT["rs"]].astype(np.int64), "home_runs": lines[0::2, _AT["ra"]].astype(np.int64)}
    out |= {p + c: np.where(x[o::2] >= 0, reads[c][o::2], np.nan) for o, p in enumerate(("a_", "h_")) for c in READS}
    return pd.DataFrame(out | {"lg_runs": lg_runs, "lg_k": lg_k} | dict(zip(("wins", "losses", "ties"), record[:, 0::2], strict=True)))


def before_finals(games: DataFrame, teams: DataFrame, cap: int = RUN_CAP, block_of: int = BLOCK) -> DataFrame:
    """Each final with both teams' statistics (a_, h_), league scalars and the away team's record against the home team before it.

    Teams that teams doesn't list have null statistics, and don't count as opponents.
    """
    known = teams.select("season", "team_id").distinct()
    block = F.floor(F.col("seq") / block_of).alias("block")
    tg = team_games(in_order(games.where("season IS NOT NULL")), ("season", "seq")).select("season", block, "seq", "side", "game_id", "team_id", "opp_id", *_line(cap))

    def run(key: tuple, opening: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        out = _block(opening, sides)
        out.insert(0, "season", key[0])
        return out

    doubles = [p + c for p in ("a_", "h_") for c in READS] + ["lg_runs", "lg_k", "wins", "losses", "ties"]
    schema = "season string, game_id string, away_id string, home_id string, away_runs long, home_runs long, " + ", ".join(f"{c} double" for c in doubles)
    n = tg.sparkSession.sparkContext.defaultParallelism * 8
    # columns of their own: both sides come from the same games
    sides = tg.select(*[F.col(c).alias(c) for c in tg.columns])
    parts = [t.repartition(n, "season", "block") for t in (_openings(tg, known), sides)]
    return parts[0].groupBy("season", "block").cogroup(parts[1].groupBy("season", "block")).applyInPandas(run, schema)


def backtest(games: DataFrame, teams: DataFrame, settings: Settings = Settings(), block_of: int = BLOCK) -> DataFrame:
    """PM12: each final without a tie, predicted from the finals before it: season, game_id, p, y, upset, captured."""
    p = predict(before_finals(games, teams, block_of=block_of).where("away_runs <> home_runs"), settings)
    y = (F.col("away_runs") > F.col("home_runs")).cast("long")
    fav = F.col("away_pct") >= 0.5
    return p.select("season", "game_id", F.col("away_pct").alias("p"), y.alias("y"), (fav != (y == 1)).alias("upset"), ((F.col("away_pct") <= 0.45) | (F.col("away_pct") >= 0.55)).alias("captured"))
