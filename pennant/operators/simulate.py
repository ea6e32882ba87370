"""Projections, qualification odds, scenarios and exact mathematics of a season's open games."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import fnv1a, wilson
from pennant.operators.fold import TEAM_COLUMNS, Abreast, Apart, Season, Versions, streams
from pennant.operators.standings import TOLERANCE
from pennant.operators.stats import SEASON, Keys, is_final, remaining
from pennant.settings import ODDS_ITERATIONS, Settings

#: Open games above which the reference makes no projection or scenarios; as a limit they are opt-in.
PROJECT_LIMIT, SCENARIO_LIMIT = 250, 60
#: Open games above which outcomes, whose number is exponential, are not gone through.
EXACT_LIMIT = 15
#: Games whose outcomes are courses side by side where neighbours in rank can end tied.
TIED = 12
#: Pairs of teams whose games' scenarios are one group, and the courses that a group may have at a time.
FORCED, COURSES = 128, 8192
#: Iterations are watched for convergence at every so many, the first time after two.
WINDOW, SETTLED, FIRST_CHECK = 25, 0.35, 100
#: Windows whose iterations are courses of one group side by side.
ABREAST = 10
#: Outcomes that are held at a time.
CHUNK = 1 << 16
#: Partitions a core that the groups are dealt to: few share one, and who is done takes the next.
SPREAD = 8


def fold_teams(stats: DataFrame, h2h: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Teams as a fold reads them, each with its records against opponents."""
    met = h2h.groupBy(*keys, "team_id").agg(F.collect_list(F.struct("opp_id", "wins", "losses", "ties")).alias("met"))
    return stats.select(*keys, "team_id", *TEAM_COLUMNS).join(met, [*keys, "team_id"], "left")


def open_games(games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    return remaining(games).select(*keys, "ord", "game_id", "game_date", "away_id", "home_id")


def _type_of(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def by_season(teams: DataFrame, games: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, keys: Keys = SEASON) -> DataFrame:
    """run(teams, open games in order) for each group of the keys; its result follows the keys."""
    kinds = ", ".join(f"{k} {_type_of(teams, k)}" for k in keys)

    def grouped(key: tuple, t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        if t.empty:
            return pd.DataFrame(columns=[*keys, *names])
        # ids decide only where places are equal: texts are slow to sort
        out = run(t, g.sort_values("ord" if g["ord"].is_unique else ["ord", "game_id"], ignore_index=True))
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    # by a number of its own: a season is little data but much work, and small partitions would be joined by size
    n = SPREAD * teams.sparkSession.sparkContext.defaultParallelism
    teams, games = teams.repartition(n, *keys), games.drop("game_date").repartition(n, *keys)
    return teams.groupBy(*keys).cogroup(games.groupBy(*keys)).applyInPandas(grouped, f"{kinds}, {schema}")


def project(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), limit: int | None = None, keys: Keys = SEASON) -> DataFrame:
    """MC2: keys, team_id, projected_rank, w, l, t, run_diff after every open game is won by the predicted winner.

    With more than limit games open, if one is given, nothing is played.
    """

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        s = Season(t, settings, 1)
        if limit is None or len(g) <= limit:
            s.play_all(s.pairs(g))
        return pd.DataFrame({"team_id": s.ids, "projected_rank": s.ranks()[0], **{c: np.array(s.state[c]).astype(np.int64) for c in ("w", "l", "t", "run_diff")}})

    return by_season(teams, games, run, "team_id string, projected_rank long, w long, l long, t long, run_diff long", keys)


def seed_text(games: DataFrame, extras: Column, keys: Keys = SEASON) -> DataFrame:
    """keys, seed_text: extras and the sorted ids of all games with F for finals and O for open ones."""
    each = F.concat("game_id", F.lit("|"), F.when(is_final(), "F").otherwise("O"))
    return games.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(each)), ",").alias("_all")).select(*keys, F.concat(extras, F.lit("::"), "_all").alias("seed_text"))


def odds_extras(settings: Settings) -> Column:
    num = lambda x: f"{x:g}"
    return F.lit(f"odds-{settings.gold_cutoff}-{settings.model_aggression}-{num(settings.win_points)}-{num(settings.tie_points)}-{','.join(settings.factors)}")


def simulate(teams: DataFrame, games: DataFrame, seeds: DataFrame, settings: Settings = Settings(), iterations: int = ODDS_ITERATIONS, keys: Keys = SEASON, abreast: int = ABREAST) -> DataFrame:
    """MC3: keys, team_id, block, hits: how often each team ends within the cutoff in each block of iterations.

    abreast blocks of WINDOW iterations are a group; each iteration jumps to its place in the season's
    stream of random numbers, so the result is that of one serial run. seeds: keys, seed_text.
    """
    groups = F.sequence(F.lit(0), F.lit((iterations - 1) // (WINDOW * abreast)))
    seeded = teams.join(seeds.select(*keys, fnv1a(F.col("seed_text")).alias("seed")), list(keys)).withColumn("group", F.explode(groups))
    spread = games.withColumn("group", F.explode(groups))
    cut = settings.gold_cutoff

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        low = int(t["group"].iloc[0]) * WINDOW * abreast
        n = min(WINDOW * abreast, iterations - low)
        s = Abreast(t, settings, n) if n > 1 else Season(t, settings, 1)
        draws = (row for piece in streams(int(t["seed"].iloc[0]), [i * len(g) for i in range(low, low + n)], len(g)) for row in piece)
        for (a, h), draw in zip(s.pairs(g), draws, strict=True):
            if a < 0:
                continue
            if n > 1:
                s.game(a, h, lambda p, draw=draw: draw < p)
            else:  # a single iteration is kept in plain numbers
                *scores, p = s.predict(a, h)
                s.play(a, h, bool(draw[0] < p), (scores[0], scores[1]))
        starts = np.arange(0, n, WINDOW)
        hits = np.add.reduceat((s.ranks() <= cut).astype(np.int64), starts, 0)
        return pd.DataFrame({"team_id": np.tile(np.array(s.ids, object), len(starts)), "block": np.repeat((low + starts) // WINDOW, len(s.ids)), "hits": hits.reshape(-1)})

    return by_season(seeded, spread, run, "team_id string, block int, hits long", [*keys, "group"]).drop("group")


def simulate_states(teams: DataFrame, games: DataFrame, seeds: DataFrame, settings: Settings = Settings(), iterations: int = ODDS_ITERATIONS, keys: Keys = SEASON) -> DataFrame:
    """MC4: keys, state, team_id, block, hits: simulate() of every state of a season, whose courses are all side by side.

    teams and seeds: keys, state and what simulate() reads. games: keys, ord, game_id, away_id, home_id of all games that
    are open in some state, each once, and since: the first state in which it is a final, else null.
    """
    seeded = teams.join(seeds.select(*keys, "state", fnv1a(F.col("seed_text")).alias("seed")), [*keys, "state"])
    cut, n = settings.gold_cutoff, max(2, iterations)

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        each = [x for _, x in t.groupby("state")]
        s = Versions([Season(x, settings, n) for x in each])
        numbers = np.array([x["state"].iloc[0] for x in each])
        since = g["since"].to_numpy(np.float64)[:, None]
        open_ = np.isnan(since) | (since > numbers)
        everywhere, mine = open_.all(1).tolist(), [slice(i * n, i * n + n) for i in range(len(each))]
        counts = open_.sum(0).tolist()
        draws = [(row for piece in streams(int(x["seed"].iloc[0]), [i * count for i in range(n)], count) for row in piece) for x, count in zip(each, counts, strict=True)]
        draw = np.zeros(s.n)
        for j, (a, h) in enumerate(s.pairs(g)):
            for i, part in enumerate(mine):
                if everywhere[j] or open_[j, i]:
                    draw[part] = next(draws[i])
            if a >= 0 and open_[j].any():
                s.game(a, h, draw, None if everywhere[j] else np.repeat(open_[j], n))
        inside = (s.ranks() <= cut).astype(np.int64)
        starts = np.arange(0, iterations, WINDOW)
        hits = [np.add.reduceat(inside[part][:iterations], starts, 0).reshape(-1) for part in mine]
        rows = len(starts) * len(s.ids)
        return pd.DataFrame({"state": np.repeat(numbers, rows), "team_id": np.tile(np.array(s.ids, object), len(starts) * len(each)), "block": np.tile(np.repeat(starts // WINDOW, len(s.ids)), len(each)), "hits": np.concatenate(hits)})

    return by_season(seeded, games.withColumn("game_date", F.lit(None).cast("date")), run, f"state {_type_of(teams, 'state')}, team_id string, block int, hits long", keys)


def converged_odds(hits: DataFrame, iterations: int = ODDS_ITERATIONS, keys: Keys = SEASON) -> DataFrame:
    """MC3: keys, team_id, odds (per cent), iterations: up to the first check at which no team's odds still move."""
    done = F.least((F.col("block") + 1) * WINDOW, F.lit(iterations))
    run = Window.partitionBy(*keys, "team_id").orderBy("block")
    c = hits.withColumns({"done": done, "sum": F.sum("hits").over(run)}).withColumn("odds", F.col("sum") / F.col("done") * 100)
    move = F.abs(F.col("odds") - F.lag("odds").over(run))
    checked = (F.col("done") > min(iterations, FIRST_CHECK)) & (F.col("done") % WINDOW == 0)
    c = c.withColumn("still", F.max(F.when(checked, move).otherwise(float("inf"))).over(Window.partitionBy(*keys, "block")))
    stop = F.coalesce(F.min(F.when(F.col("still") <= SETTLED, F.col("block"))).over(Window.partitionBy(*keys)), F.max("block").over(Window.partitionBy(*keys)))
    return c.withColumn("_stop", stop).where("block = _stop").select(*keys, "team_id", "odds", F.col("done").cast("long").alias("iterations"))


def gold_odds(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), iterations: int = ODDS_ITERATIONS) -> DataFrame:
    """MC3 over seasons. games: all, with finals, from which the seeds are made."""
    hits = simulate(teams, open_games(games), seed_text(games, odds_extras(settings)), settings, iterations)
    return converged_odds(hits, iterations)


def dashboard(status: DataFrame, projected: DataFrame, odds: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """Every team's rank, status, projection and odds with their margin; model_place orders the projections."""
    p = projected.select(*keys, "team_id", "projected_rank", F.col("w").alias("projected_w"), F.col("l").alias("projected_l"), F.col("t").alias("projected_t"), F.col("run_diff").alias("projected_run_diff"))
    d = status.join(p, [*keys, "team_id"], "left").join(odds.select(*keys, "team_id", F.col("odds").alias("gold_pct")), [*keys, "team_id"], "left")
    d = d.withColumns({"projected_rank": F.coalesce("projected_rank", "rank"), "gold_pct": F.coalesce("gold_pct", F.lit(0.0))})
    d = d.withColumn("gold_margin", wilson(F.col("gold_pct") / 100, F.lit(ODDS_ITERATIONS))["margin"] * 100)
    order = Window.partitionBy(*keys).orderBy("projected_rank", F.round("gold_pct", 2).desc(), "rank")
    return d.withColumn("model_place", F.row_number().over(order).cast("long"))


_SCENARIO = "game_id string, winner_id string, team_id string, seed long"
_OWN = "game_id string, away_win long, away_loss long, home_win long, home_loss long"


def _either_way(t: pd.DataFrame, pairs: list[tuple[int, int]], places: list[int], settings: Settings, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Final ranks of the courses in which one of the places goes either way, and the courses (away won, home won) of each place.

    A game that goes either way is played before all others and left out at its place, so the games of
    a pair share their course up to the first of their places. There a copy leaves one out; at the
    next place it plays that one, and if it then is what the shared course was before that game, the two places go on as one.
    With more than most courses at a time, the places are halved.
    """
    live, forced = Season(t, settings, 1), set(places)
    of_pair: dict[tuple[int, int], int] = {pairs[j]: j for j in places}
    course = np.arange(2 * len(of_pair))
    s = Season(t, settings, len(course))
    for k, (a, h) in enumerate(of_pair):
        if a >= 0:
            *scores, _ = live.predict(a, h)
            s.play(a, h, course == 2 * k, (scores[0], scores[1]), course // 2 == k)
    s = Apart(s)
    shared = {pair: [2 * k, 2 * k + 1] for k, pair in enumerate(of_pair)}
    beside: dict[tuple[int, int], list[int | None]] = {pair: [None, None] for pair in of_pair}
    found = {j: tuple(shared[pairs[j]]) for j in places if pairs[j][0] < 0}
    for j, (a, h) in enumerate(pairs):
        if a < 0:
            continue
        mine = j in forced
        before = s.table[:, shared[a, h]] if mine else None
        s.game(a, h)
        if not mine:
            continue
        copies, last = beside[a, h], of_pair[a, h] == j
        for i, c in enumerate(copies):
            if c is not None and np.array_equal(s.table[:, c], before[:, i]):
                if last:
                    s.free.append(shared[a, h][i])
            else:
                copies[i] = c = shared[a, h][i] if last else s.new()
                s.table[:, c] = before[:, i]
        found[j] = tuple(copies)
        if s.n > max(most, len(course)) and len(places) > 1:
            s = before = None
            by_pair = sorted(places, key=lambda j: (pairs[j], j))
            half = len(by_pair) // 2
            parts = [(part, *_either_way(t, pairs, sorted(part), settings, most)) for part in (by_pair[:half], by_pair[half:])]
            at = {j: of + sum(len(r) for _, r, _ in parts[:i]) for i, (part, _, courses) in enumerate(parts) for j, of in zip(sorted(part), courses, strict=True)}
            return np.concatenate([r for _, r, _ in parts]), np.array([at[j] for j in places])
    used = sorted({c for of in found.values() for c in of})
    row = {c: i for i, c in enumerate(used)}
    return s.ranks(used), np.array([[row[c] for c in found[j]] for j in places])


def _scenario_groups(teams: DataFrame, games: DataFrame, tell: Callable[[list[str], pd.DataFrame, list[tuple[int, int]], np.ndarray, np.ndarray], pd.DataFrame], schema: str, settings: Settings, limit: int | None, keys: Keys, block_of: int, only: DataFrame | None, most: int) -> DataFrame:
    """tell(ids, forced games, their pairs, ranks, courses) for every block_of pairs of a season, which are a group of their own."""
    if only is None:
        games = games.withColumn("forced", F.lit(True))
    else:
        chosen = only.select(*keys, "game_id").distinct().withColumn("forced", F.lit(True))
        games = games.join(chosen, [*keys, "game_id"], "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    if limit is not None:
        games = games.join(games.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") <= limit).select(*keys), list(keys), "left_semi")
    # one key, which matches missing ids too
    games = games.withColumn("_pair", F.struct("away_id", "home_id"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_pair")) - 1
    pairs = games.where("forced").select(*keys, "_pair").distinct().select(*keys, "_pair", F.floor(place / block_of).cast("int").alias("_own"))
    last = pairs.groupBy(*keys).agg(F.max("_own").alias("_last"))
    spread = lambda df: df.join(last, list(keys)).withColumn("block", F.explode(F.sequence(F.lit(0), "_last"))).drop("_last")
    games = spread(games.join(pairs, [*keys, "_pair"], "left").drop("_pair")).withColumn("forced", F.col("forced") & (F.col("block") == F.col("_own"))).drop("_own")

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        places = np.flatnonzero(g["forced"].to_numpy(bool)).tolist()
        s = Season(t, settings, 1)
        pairs = s.pairs(g)
        ranks, courses = _either_way(t, pairs, places, settings, most)
        return tell(s.ids, g.iloc[places], [pairs[j] for j in places], ranks, courses)

    return by_season(spread(teams), games, run, schema, [*keys, "block"]).drop("block")


def scenarios(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), limit: int | None = None, keys: Keys = SEASON, block_of: int = FORCED, only: DataFrame | None = None, most: int = COURSES) -> DataFrame:
    """MC8: keys, game_id, winner_id, team_id, seed: final ranks if one open game goes either way and the rest as projected.

    only: keys, game_id of the games that are to go either way, if not all; rows and work are then theirs only.
    Games of block_of pairs of a season are a group, with at most so many courses at a time. Seasons with
    more than limit games open, if one is given, have no rows.
    """

    def tell(ids: list[str], mine: pd.DataFrame, _: list[tuple[int, int]], ranks: np.ndarray, courses: np.ndarray) -> pd.DataFrame:
        m = len(ids)
        winner = np.stack([mine["away_id"].to_numpy(object), mine["home_id"].to_numpy(object)], 1).reshape(-1)
        return pd.DataFrame({"game_id": np.repeat(mine["game_id"].to_numpy(object), 2 * m), "winner_id": np.repeat(winner, m), "team_id": np.tile(np.array(ids, object), len(winner)), "seed": ranks[courses.reshape(-1)].reshape(-1)})

    return _scenario_groups(teams, games, tell, _SCENARIO, settings, limit, keys, block_of, only, most)


def own_seeds(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON, block_of: int = FORCED, most: int = COURSES) -> DataFrame:
    """keys, game_id, away_win, away_loss, home_win, home_loss: of scenarios() what it says of a game's own two teams, one row a game."""

    def tell(ids: list[str], mine: pd.DataFrame, _: list[tuple[int, int]], ranks: np.ndarray, courses: np.ndarray) -> pd.DataFrame:
        at = {x: i for i, x in enumerate(ids)}
        out = {"game_id": mine["game_id"].to_numpy(object)}
        for side, (won, lost) in (("away", (0, 1)), ("home", (1, 0))):
            place = np.array([at.get(x, -1) for x in mine[f"{side}_id"]])
            for name, i in (("win", won), ("loss", lost)):
                out[f"{side}_{name}"] = pd.array(np.where(place < 0, 0, ranks[courses[:, i], place]), "Int64")
                out[f"{side}_{name}"][place < 0] = pd.NA
        return pd.DataFrame(out)

    return _scenario_groups(teams, games, tell, _OWN, settings, None, keys, block_of, None, most)


def win_out(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), limit: int | None = None, keys: Keys = SEASON) -> DataFrame:
    """MC12's fold: keys, team_id, win_out_seed if a team wins all its games and the others go as predicted now.

    As they are predicted now, games between the same teams go the same way, whatever their order: they
    are counted, and each pair is played once with its count.
    """
    paired = games.groupBy(*keys, "away_id", "home_id").agg(F.count("*").alias("times"), F.min("ord").alias("ord"), F.min("game_id").alias("game_id"))

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        m = len(t)
        if limit is not None and g["times"].sum() > limit:
            return pd.DataFrame(columns=["team_id", "win_out_seed"])
        s, live = Season(t, settings, m), Season(t, settings, 1)
        course = np.arange(m)
        for (a, h), times in zip(s.pairs(g), g["times"].tolist(), strict=True):
            if a >= 0:
                *scores, p = live.predict(a, h)
                s.play(a, h, np.where(course == a, True, np.where(course == h, False, p >= 0.5)), (scores[0], scores[1]), times)
        return pd.DataFrame({"team_id": s.ids, "win_out_seed": np.diagonal(s.ranks())})

    return by_season(teams, paired, run, "team_id string, win_out_seed long", keys)


def _kept_when_tied(t: pd.DataFrame, pairs: list[tuple[int, int]], settings: Settings, before: np.ndarray, lost: int, won: int) -> bool:
    """No rank changes in the outcomes in which one team loses, another wins all its games; the other games go either way, so many at a time."""
    sure = {j: h == lost or a == won for j, (a, h) in enumerate(pairs) if {a, h} & {lost, won} and lost >= 0}
    free = [j for j in range(len(pairs)) if j not in sure]
    side = min(len(free), TIED)
    course = np.arange(max(2, 1 << side))
    for high in range(1 << (len(free) - side)):
        s, at = Season(t, settings, len(course)), {j: i for i, j in enumerate(free)}
        for j, (a, h) in enumerate(pairs):
            *scores, _ = s.predict(a, h)
            i = at.get(j)
            away = np.full(len(course), sure[j]) if i is None else (course >> i) & 1 == 0 if i < side else np.full(len(course), (high >> (i - side)) & 1 == 0)
            s.play(a, h, away, (scores[0], scores[1]))
        if not (s.ranks() == before).all():
            return False
    return True


def _locked(t: pd.DataFrame, g: pd.DataFrame, settings: Settings) -> bool:
    """Whether no outcome changes a rank, for any number of games.

    Percentages follow from counts alone, and the lower of two neighbours in rank does best where it
    wins and the other loses all its games, which is an outcome. There it is ahead by more than the
    tolerance (a rank changes), still behind by more (it always is), or tied. Only what is tied there
    depends on scores: on the pair's record or run difference where no third team can join it, else on the
    outcomes of the other games, which are then gone through.
    """
    s = Season(t, settings, 1)
    before, now = s.ranks()[0], s.state
    pairs = [p for p in s.pairs(g) if p[0] >= 0]
    left = np.bincount([x for p in pairs for x in p], minlength=len(s.ids)).tolist()
    pct = lambda i, won: (now["w"][i] + won + now["t"][i] * 0.5) / max(now["games"][i] + left[i], 1) if left[i] else now["pct"][i]
    low, high = [pct(i, 0) for i in range(len(s.ids))], [pct(i, left[i]) for i in range(len(s.ids))]
    order = np.argsort(before).tolist()
    neighbours = list(zip(order, order[1:], strict=False))
    if any(high[y] - low[x] > TOLERANCE for x, y in neighbours):
        return False
    todo = []
    for x, y in (p for p in neighbours if low[p[0]] - high[p[1]] <= TOLERANCE):
        if left[x] == left[y] == 0 and not pairs:
            continue
        # with so many games, one result more can still be a tie
        many = any(left[i] and 1 / (now["games"][i] + left[i]) <= 2 * TOLERANCE for i in (x, y))
        apart = all(low[z] > max(low[x], high[y]) + 4 * TOLERANCE or high[z] < min(low[x], high[y]) - 4 * TOLERANCE for z in range(len(s.ids)) if z not in (x, y))
        if apart and not many:
            if left[x] == left[y] == 0:
                continue
            met = sum({x, y} == {a, h} for a, h in pairs)
            ahead, games = s.wins[x][y] - s.wins[y][x] - met, s.wins[x][y] + s.wins[y][x] + s.ties[x][y] + met
            own, other = now["run_diff"][x] - now["run_diff"][y], left[x] + left[y]
            factors = [f for f in settings.factors if f != "headToHead" or (games and abs(ahead) / games > TOLERANCE)]
            if factors and factors[0] == "headToHead":
                if ahead < 0:
                    return False
                continue
            if factors and factors[0] == "runDifferential":
                if own - other < 0:  # a winner leads by one run at least, and by no more than the cap
                    return False
                if own - other * s.cap > 0:
                    continue
        todo.append((-1, -1) if many else (x, y))
    return all(_kept_when_tied(t, pairs, settings, before, x, y) for x, y in dict.fromkeys(todo))


def seeding_locked(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), limit: int | None = None, keys: Keys = SEASON) -> DataFrame:
    """MC7: keys, locked, open: no outcome of the open games changes a rank.

    With more than limit games open, if one is given, what isn't false is null (paused).
    """

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        locked = _locked(t, g, settings)
        paused = locked and limit is not None and len(g) > limit
        return pd.DataFrame({"locked": pd.array([None if paused else locked], "boolean"), "open": [len(g)]})

    return by_season(teams, games, run, "locked boolean, open long", keys)


def exact_status(teams: DataFrame, games: DataFrame, settings: Settings = Settings(), limit: int = EXACT_LIMIT, keys: Keys = SEASON) -> DataFrame:
    """MC5, MC6: keys, team_id, magic, losses_to_out, text: what all outcomes of the open games say, by points and id.

    magic is clinched or impossible; losses_to_out is 0 for a team that is out, null for one that
    can't be put out by its own losses. Both are null (paused) with more than limit games open.
    All outcomes are gone through in chunks of a fixed size, for all teams at once.
    """
    cut = settings.gold_cutoff
    win, tie = settings.win_points, settings.tie_points

    def run(t: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("team_id", ignore_index=True)
        ids = t["team_id"].tolist()
        if len(g) > limit:
            paused = f"Exact numbers are paused above {limit} open games."
            return pd.DataFrame({"team_id": ids, "magic": None, "losses_to_out": pd.array([None] * len(ids), "Int64"), "text": paused})
        at = {x: i for i, x in enumerate(ids)}
        pairs = [(at[a], at[h]) for a, h in zip(g["away_id"], g["home_id"], strict=True) if a in at and h in at]
        ways = 3 if tie > 0 else 2
        start = (t["w"] * win + t["t"] * tie).to_numpy(np.float32)
        always, most = np.ones(len(ids), bool), np.full(len(ids), -1)
        total = ways ** len(pairs)
        for low in range(0, total, CHUNK):
            code = np.arange(low, min(total, low + CHUNK))
            points = np.repeat(start[:, None], len(code), 1)
            lost = np.zeros((len(ids), len(code)), np.int8)
            for a, h in pairs:
                way, code = code % ways, code // ways
                points[a] += np.choose(way, [win, 0, tie][:ways]).astype(np.float32)
                points[h] += np.choose(way, [0, win, tie][:ways]).astype(np.float32)
                lost[h] += way == 0
                lost[a] += way == 1
            for me in range(len(ids)):
                ahead = (points > points[me]).sum(0) + (points[:me] == points[me]).sum(0)
                inside = ahead < cut
                always[me] &= inside.all()
                most[me] = max(most[me], np.where(inside, lost[me], -1).max())
        own = np.bincount([x for p in pairs for x in p], minlength=len(ids))
        rows = []
        for me, team in enumerate(ids):
            out = int(most[me]) + 1 if most[me] < own[me] or most[me] < 0 else None
            magic = "clinched" if always[me] else "impossible"
            text = f"Already eliminated from top-{cut}." if out == 0 else f"Cannot be eliminated from top-{cut} this season." if out is None else f"{out} more loss{'' if out == 1 else 'es'} would eliminate the team from top-{cut}."
            rows.append((team, magic, out, "Already clinched." if magic == "clinched" else text))
        return pd.DataFrame(rows, columns=["team_id", "magic", "losses_to_out", "text"]).astype({"losses_to_out": "Int64"})

    return by_season(teams, games, run, "team_id string, magic string, losses_to_out long, text string", keys)
