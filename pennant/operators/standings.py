"""Ranking, mathematical status and what follows from the order of the teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.operators.stats import SEASON, Keys, points
from pennant.settings import Settings

TOLERANCE = 1e-4


def anchors(stats: DataFrame, col: str = "pct", keys: Keys = SEASON) -> DataFrame:
    """stats with anchor: the value that leads the tie group of a team's value.

    A group is led by the largest value that is left and holds those within the tolerance of it.
    A season has few teams, so its distinct values are folded as one array.
    """
    start = F.array().cast("array<double>")

    def add(found: Column, v: Column) -> Column:
        new = (F.size(found) == 0) | (F.abs(F.element_at(found, -1) - v) > TOLERANCE)
        return F.when(new, F.concat(found, F.array(v))).otherwise(found)

    led = stats.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_set(col), asc=False), start, add).alias("_lead"))
    out = stats.join(led, list(keys))
    return out.withColumn("anchor", F.array_min(F.filter("_lead", lambda a: a >= F.col(col)))).drop("_lead")


def rank_teams(stats: DataFrame, h2h: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON, met_keys: Keys | None = None, more: tuple[Column, Column] | None = None) -> DataFrame:
    """Stats with rank: by percentage in tie groups, then the tiebreakers, the index, the id.

    Head-to-head counts in groups of exactly two teams that met, and only for these it is joined.
    met_keys: the keys of h2h, where it holds for many states; more: wins and losses against
    opp_id that a state adds to it, from columns of stats.
    """
    out = anchors(stats, "pct", keys)
    group = Window.partitionBy(*keys, "anchor")
    out = out.withColumns({"group_size": F.count("*").over(group), "group_low": F.min("team_id").over(group), "group_high": F.max("team_id").over(group)})
    order: list[Column] = [F.col("anchor").desc()]
    if "headToHead" in settings.factors:
        other = F.when(F.col("team_id") == F.col("group_low"), F.col("group_high")).otherwise(F.col("group_low"))
        out = out.withColumn("opp_id", F.when(F.col("group_size") == 2, other)).join(h2h, [*(met_keys or keys), "team_id", "opp_id"], "left")
        if more:
            known = lambda c: F.coalesce(F.col(c), F.lit(0))
            out = out.withColumns({"wins": known("wins") + more[0], "losses": known("losses") + more[1], "ties": known("ties")})
        mine = F.try_divide(F.col("wins") + F.col("ties") * 0.5, F.col("wins") + F.col("losses") + F.col("ties"))
        # the other team's share is what is missing to 1
        out = out.withColumn("h2h_key", F.when(F.abs(mine * 2 - 1) > TOLERANCE, -mine).otherwise(F.lit(0.0)))
        out = out.withColumn("h2h_key", F.coalesce("h2h_key", F.lit(0.0))).drop("opp_id", "wins", "losses", "ties")
    terms = {"headToHead": F.col("h2h_key") if "headToHead" in settings.factors else None, "runDifferential": -F.col("run_diff"), "runsAgainst": F.col("ra"), "runsFor": -F.col("rs")}
    order += [terms[f].asc() for f in settings.factors]
    order += [F.round("tpi", 4).desc(), F.col("team_id").asc()]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return out.drop("anchor", "group_size", "group_low", "group_high", "h2h_key")


def gold_status(ranked: DataFrame, left: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """Ranked with remaining, points, max_points, blockers_ahead, catchers and gold_status.

    How many rivals are beyond a bound is read off the season's sorted points, so no team is
    joined with all others.
    """
    cut = settings.gold_cutoff
    t = ranked.join(left, [*keys, "team_id"], "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)).cast("long"))
    t = t.withColumn("points", points(settings.win_points, settings.tie_points))
    t = t.withColumn("max_points", F.col("points") + F.col("remaining") * float(settings.win_points))
    every = Window.partitionBy(*keys)
    t = t.withColumns({"_p": F.collect_list("points").over(every), "_m": F.collect_list("max_points").over(every)})
    blockers = F.size(F.filter("_p", lambda p: p > F.col("max_points"))).cast("long")
    catchers = (F.size(F.filter("_m", lambda m: m >= F.col("points"))) - 1).cast("long")
    t = t.withColumns({"blockers_ahead": blockers, "catchers": catchers}).drop("_p", "_m")
    status = F.when(F.col("blockers_ahead") >= cut, "Eliminated").when(F.col("catchers") < cut, "Clinched").when(F.col("rank") <= cut, "In").otherwise("Alive")
    return t.withColumn("gold_status", status)


def cut_line(status: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """The last team in, the first out, and the gap in points."""
    cut = settings.gold_cutoff
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return status.groupBy(*keys).agg(at(cut, "team_id").alias("last_in"), at(cut + 1, "team_id").alias("first_out"), (at(cut, "points") - at(cut + 1, "points")).alias("gap"))


def title_race(status: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """keys, team_id, badge of the title race ('' for none)."""
    first = Window.partitionBy(*keys).orderBy("rank")
    lead = lambda c: F.first(c).over(first)
    t = status.withColumns({"_w": lead("w"), "_l": lead("l"), "_t": lead("t"), "_p": lead("points")})
    back = (F.col("_w") - F.col("w") + (F.col("l") - F.col("_l")) + (F.col("_t") - F.col("t")) * 0.5) / 2
    badge = F.when(F.col("rank") == 1, "Title Leader").when(F.col("max_points") < F.col("_p"), "Title Eliminated").when((back <= 2) & (F.col("rank") <= 5), "Title Contender").otherwise("")
    return t.select(*keys, "team_id", badge.alias("badge"))


def sos_ranks(stats: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Keys, team_id, sos_rank. Differences below the ninth decimal are noise of the sums."""
    return stats.select(*keys, "team_id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("sos", 9).desc(), "team_id")).cast("long").alias("sos_rank"))


def effective_cutoff(teams: DataFrame, cutoff: float | None, keys: Keys = SEASON) -> DataFrame:
    """VAL9: the cutoff within 1 and the number of teams."""
    want = int((cutoff or 7) + 0.5)
    return teams.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.lit(want), F.greatest(F.lit(1), F.count("*")))).cast("long").alias("cutoff"))


def cut_band(projected: DataFrame, cutoff: int, keys: Keys = SEASON) -> DataFrame:
    """FIL8: teams whose projected seed is around the cut line."""
    return projected.where(F.col("projected_rank").between(cutoff - 2, cutoff + 3))
