"""Bracket projections: power-of-two brackets with byes, actual results, model picks and a small upset lane."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pennant.operators.fold import TEAM_COLUMNS, Season
from pennant.operators.stats import SEASON, Keys
from pennant.settings import Settings

_SCHEMA = "game_id string, round_index long, game_index long, round_name string, top_id string, top_seed long, bottom_id string, bottom_seed long, predicted_id string, away_pct double, winner_id string, winner_source string"


def seed_order(size: int) -> list[int]:
    """The seeds from top to bottom: each seed meets the one that sums up with it to the round's size plus one."""
    order = [1]
    while len(order) < size:
        order = [s for seed in order for s in (seed, 2 * len(order) + 1 - seed)]
    return order


def fnv(text: str) -> int:
    """F17 for a single text."""
    h = 2166136261
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619 % 2**32
    return h


def round_name(index: int, rounds: int) -> str:
    return {1: "Championship", 2: "Semifinals", 3: "Quarterfinals"}.get(rounds - index, f"Round {index + 1}")


def pick(game_id: str, index: int, top: tuple[str, int], bottom: tuple[str, int], away_pct: float) -> str:
    """The projected winner of top (home) and bottom (away), each (id, seed).

    A close game whose favourite has the better seed goes to the other team if the game's own roll
    is below the upset's chance.
    """
    top_pct = 1 - away_pct
    fav, dog = (top, bottom) if top_pct >= away_pct else (bottom, top)
    p, q = max(top_pct, away_pct), min(top_pct, away_pct)
    if fav[1] > dog[1] or p > 0.66:
        return fav[0]
    chance = q * (0.6 + min(0.25, (dog[1] - fav[1]) / 8)) * min(1.0, max(0.0, (0.66 - p) / 0.16)) * max(0.65, 1 - 0.12 * index)
    roll = fnv(f"{game_id}:{top[0]}:{bottom[0]}:bracket-volatility") % 10000 / 10000
    return dog[0] if roll < min(0.28, max(0.0, chance)) else fav[0]


def bracket(entrants: DataFrame, results: DataFrame, prefix: str = "bracket", settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """MC14: the games of each season's bracket. entrants: fold teams with bracket_seed (1, 2, ...).

    results: keys, game_id, home_runs, away_runs, is_final of bracket games played; top teams are at home.
    """

    kinds = dict(entrants.dtypes)

    def run(key: tuple, t: pd.DataFrame, played: pd.DataFrame) -> pd.DataFrame:
        names = [c.strip().split(" ")[0] for c in _SCHEMA.split(",")]
        if len(t) < 2:
            return pd.DataFrame(columns=[*keys, *names])
        s = Season(t, settings, 1)
        by_seed = {int(r.bracket_seed): r.team_id for r in t.itertuples()}
        seed_of = {v: k for k, v in by_seed.items()}
        scores = {r.game_id: (r.home_runs, r.away_runs) for r in played.itertuples() if r.is_final and pd.notna(r.home_runs) and pd.notna(r.away_runs)}
        size = 1 << (len(t) - 1).bit_length()
        rounds = size.bit_length() - 1
        slots: list[tuple[str | None, int]] = [(by_seed.get(x), x) for x in seed_order(size)]
        rows = []
        for r in range(rounds):
            after: list[tuple[str | None, int]] = []
            for g in range(len(slots) // 2):
                top, bottom = slots[2 * g], slots[2 * g + 1]
                game_id = f"{prefix}-r{r + 1}-g{g + 1}"
                predicted, away_pct, winner, source = None, None, None, "pending"
                if top[0] and bottom[0]:
                    *_, p = s.predict(s.at[bottom[0]], s.at[top[0]])
                    away_pct = float(p)
                    predicted = pick(game_id, r, (top[0], seed_of[top[0]]), (bottom[0], seed_of[bottom[0]]), away_pct)
                    home, away = scores.get(game_id, (0, 0))
                    winner, source = (top[0] if home > away else bottom[0], "actual") if home != away else (predicted, "projected")
                elif top[0] or bottom[0]:
                    winner, source = top[0] or bottom[0], "bye"
                rows.append((*key, game_id, r, g, round_name(r, rounds), *top, *bottom, predicted, away_pct, winner, source))
                after.append((winner, seed_of.get(winner, min(top[1], bottom[1]))))
            slots = after
        return pd.DataFrame(rows, columns=[*keys, *names])

    prefix_types = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return entrants.groupBy(*keys).cogroup(results.groupBy(*keys)).applyInPandas(run, f"{prefix_types}, {_SCHEMA}")


def entrants(board: DataFrame, teams: DataFrame, start: int, count: int | None, keys: Keys = SEASON) -> DataFrame:
    """Fold teams in the order of the model's places, from place start (0 first), reseeded from 1."""
    p = board.select(*keys, "team_id", (F.col("model_place") - start).alias("bracket_seed")).where("bracket_seed >= 1")
    if count is not None:
        p = p.where(F.col("bracket_seed") <= count)
    return teams.select(*keys, "team_id", *TEAM_COLUMNS, "met").join(p, [*keys, "team_id"])


def gold_and_silver(board: DataFrame, teams: DataFrame, results: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """MC14, U1, O8: both brackets' games with label and place in the order of rounds."""
    cut = settings.gold_cutoff
    gold = bracket(entrants(board, teams, 0, cut, keys), results, "bracket", settings, keys).withColumn("label", F.lit("Gold Bracket"))
    silver = bracket(entrants(board, teams, cut, None, keys), results, "silver-bracket", settings, keys).withColumn("label", F.lit("Silver Bracket"))
    both = gold.unionByName(silver)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("round_index", "label", "game_index")).cast("long"))


def champions(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """The winner of each bracket's last round."""
    last = Window.partitionBy(*keys, "label").orderBy(F.col("round_index").desc())
    return games.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*keys, "label", F.col("winner_id").alias("champion_id"), F.col("winner_source").alias("champion_source"))


def saved_games(results: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """How many bracket games hold a score."""
    some = F.col("home_runs").isNotNull() | F.col("away_runs").isNotNull()
    return results.groupBy(*keys).agg(F.count_if(some).alias("saved"))


def winner_label(game: DataFrame) -> DataFrame:
    """how a winner is announced."""
    text = F.when(F.col("winner_source") == "actual", "Final").when(F.col("winner_source") == "bye", "Bye").when(F.col("winner_source") == "projected", "Projected").otherwise("Pending")
    return game.withColumn("winner_label", text)
