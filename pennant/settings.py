"""League settings: defaults, limits and coercion of untrusted values."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

# Limits and defaults of the data model.
RUN_CAP = 35
STAT_CAP = 99
DEFAULT_INNINGS = 6
SEASON_YEAR = 2026
FACTORS = ("headToHead", "runDifferential", "runsAgainst", "runsFor")
OLD_DEFAULT_FACTORS = ("headToHead", "runDifferential", "runsAgainst")
NO_RUN_DIFF_FACTORS = ("headToHead", "runsAgainst", "runsFor")
AGGRESSION = {"Conservative": 0.6, "Balanced": 1.0, "Aggressive": 1.4}
PITCH_MODES = ("machine", "player")
RECAP_GROUPINGS = ("game", "date", "week")
ODDS_ITERATIONS, TREND_ITERATIONS = 220, 70


@dataclass(frozen=True)
class Settings:
    gold_cutoff: int = 7
    season_label: str = "Current Season"
    regular_season_games_per_team: int = 0
    default_game_innings: int = DEFAULT_INNINGS
    win_points: float = 1.0
    tie_points: float = 0.5
    run_diff_tiebreaker: bool = True
    tiebreaker_order: tuple[str, ...] | None = FACTORS
    max_score_cap: int = RUN_CAP
    max_run_differential: int = 8
    model_aggression: str = "Balanced"
    pitch_mode: str = "machine"
    recap_grouping: str = "date"

    @property
    def aggression(self) -> float:
        return AGGRESSION.get(self.model_aggression, 1.0)

    @property
    def factors(self) -> tuple[str, ...]:
        """The tiebreakers in force."""
        if self.tiebreaker_order is not None:
            return self.tiebreaker_order
        return FACTORS if self.run_diff_tiebreaker else ()

    def but(self, **changes: Any) -> Settings:
        return replace(self, **changes)


def _number(value: Any, default: float, low: float, high: float) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return default
    return min(high, max(low, value))


def coerce_order(raw: Any, run_diff: bool = True) -> tuple[str, ...]:
    """Known tiebreakers, each once; none, or a former default, become the present one."""
    if not isinstance(raw, list | tuple):
        return FACTORS if run_diff else NO_RUN_DIFF_FACTORS
    known = tuple(dict.fromkeys(f for f in raw if isinstance(f, str) and f in FACTORS))
    return FACTORS if not known or known == OLD_DEFAULT_FACTORS else known


def coerce_settings(raw: Any) -> Settings:
    """Settings from a decoded JSON object: what is missing or of another type gets its default, numbers are clamped."""
    raw = raw if isinstance(raw, dict) else {}
    d = Settings()
    whole = lambda key, default, low, high: int(math.floor(_number(raw.get(key), default, low, high) + 0.5))
    one_of = lambda key, known, default: raw[key] if raw.get(key) in known else default
    run_diff = raw["runDiffTiebreaker"] if isinstance(raw.get("runDiffTiebreaker"), bool) else d.run_diff_tiebreaker
    return Settings(
        gold_cutoff=whole("goldCutoff", d.gold_cutoff, 1, 64),
        season_label=raw["seasonLabel"][:80] if isinstance(raw.get("seasonLabel"), str) else d.season_label,
        regular_season_games_per_team=whole("regularSeasonGamesPerTeam", d.regular_season_games_per_team, 0, 200),
        default_game_innings=whole("defaultGameInnings", d.default_game_innings, 1, 10),
        win_points=_number(raw.get("winPoints"), d.win_points, 0, 10),
        tie_points=_number(raw.get("tiePoints"), d.tie_points, 0, 10),
        run_diff_tiebreaker=run_diff,
        tiebreaker_order=coerce_order(raw.get("tiebreakerOrder"), run_diff),
        max_run_differential=whole("maxRunDifferential", d.max_run_differential, 0, RUN_CAP),
        model_aggression=one_of("modelAggression", AGGRESSION, d.model_aggression),
        pitch_mode=one_of("pitchMode", PITCH_MODES, d.pitch_mode),
        recap_grouping=one_of("recapGrouping", RECAP_GROUPINGS, d.recap_grouping),
    )
