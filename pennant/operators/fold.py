"""A season's open games played in order on arrays: teams by iterations (or scenarios).

The order of the games counts (each result changes what the next is predicted from), so a season
is one group of a grouped Arrow function; iterations, scenarios and states are further groups or
the arrays' first axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pennant.operators.predict import READS
from pennant.settings import RUN_CAP, Settings

_FIXED = ["rsg", "rag", "hpg", "kpg", "total_k6", "away_k6", "home_k6", "sos", "momentum", "machine_difficulty", "hit_diff", "walk_diff", "error_diff", "walks_allowed_pg", "errors_pg"]
_MOVING = ["games", "w", "l", "t", "rs", "ra", "run_diff", "pct", "tpi"]
#: The largest logit of a chance within 0.02 and 0.98.
_SURE = math.log(49)
#: Columns of the teams that a fold reads, beside team_id and met (list of opp_id, wins, losses, ties).
TEAM_COLUMNS = [*READS, "w", "l", "t"]


class _Plain:
    """What a season needs of NumPy, on plain numbers: a single course costs a fraction of arrays of one."""

    exp, log, floor, maximum, minimum = math.exp, math.log, math.floor, max, min
    where = staticmethod(lambda c, x, y: x if c else y)
    any = bool


def _within(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def ahead(n: int) -> tuple[int, int]:
    """Factor and summand of n steps of the generator, by doubling jumps."""
    a, c, ta, tc = 1, 0, 1664525, 1013904223
    while n:
        if n & 1:
            a, c = a * ta % 2**32, (c * ta + tc) % 2**32
        ta, tc, n = ta * ta % 2**32, (tc * ta + tc) % 2**32, n >> 1
    return a, c


def lcg(seed: int, start: int, count: int) -> np.ndarray:
    """numbers start .. start + count of the generator's stream, by doubling jumps."""
    return next(streams(seed, [start], count, count))[:, 0]


def streams(seed: int, starts: list[int], count: int, rows: int = 512) -> Iterator[np.ndarray]:
    """count numbers from each of the starts on, side by side, in pieces of so many rows."""
    mask = np.uint64(0xFFFFFFFF)
    state = np.array([(a * (seed or 1) + c) % 2**32 for a, c in map(ahead, starts)], np.uint64)
    mul, add = np.array([1664525], np.uint64), np.array([1013904223], np.uint64)
    while len(mul) < min(rows, count):
        mul, add = np.concatenate([mul, mul * mul[-1] & mask]), np.concatenate([add, (mul * add[-1] + add) & mask])
    for low in range(0, count, rows):
        n = min(rows, count - low)
        piece = mul[:n, None] * state + add[:n, None] & mask
        state = piece[-1]
        yield piece / 4294967296.0


class Season:
    """Teams (in a fixed order) by n parallel courses of the season; a single course is kept in plain numbers."""

    def __init__(self, teams: pd.DataFrame, settings: Settings, n: int):
        teams = teams.sort_values("team_id", ignore_index=True)
        self.ids = teams["team_id"].tolist()
        self.at = {t: i for i, t in enumerate(self.ids)}
        self.settings, self.n = settings, n
        m = len(teams)
        columns = {c: teams[c].to_numpy(np.float64) for c in {*_FIXED, *_MOVING}}
        self.fixed = {c: columns[c].tolist() for c in _FIXED}
        wins, self.ties = np.zeros((m, m)), np.zeros((m, m)).tolist()
        for i, met in enumerate(teams["met"]):
            for r in met if met is not None else ():
                j = self.at.get(r["opp_id"])
                if j is not None:
                    wins[i, j], self.ties[i][j] = r["wins"], float(r["ties"])
        self.of = _Plain if n == 1 else np
        spread = (lambda v: v.tolist()) if n == 1 else (lambda v: np.repeat(v[..., None], n, -1))
        self.state = {c: spread(columns[c]) for c in _MOVING}
        self.wins = spread(wins)
        # sums over all teams: games, runs, strikeouts
        self.played, self.scored, self.struck = (spread(np.array(v.sum())) for v in (columns["games"], columns["rs"], columns["kpg"] * columns["games"]))
        self.cap = max(0, min(RUN_CAP, settings.max_run_differential)) or math.inf
        self._pairs: dict[tuple[int, int], tuple] = {}

    def _pair(self, a: int, h: int) -> tuple:
        """What no result changes: runs on runs allowed and what is added to them, the edge's part, the part that the league's strikeouts weigh."""
        if (a, h) not in self._pairs:
            f, ag = self.fixed, self.settings.aggression
            d = lambda c: f[c][a] - f[c][h]
            # Fixed values, as in predict.py.
            if self.settings.pitch_mode == "player":
                plus = [f["walks_allowed_pg"][y] * 0.28 - f["errors_pg"][x] * 0.18 + f["momentum"][x] * 0.08 for x, y in ((a, h), (h, a))]
                terms = [(0.25, (d("rsg") + f["rag"][h] - f["rag"][a]) / 10, 1.0), (0.05, d("sos") / 8, 1.0), (0.05, d("momentum") / 7, 1.0)]
                open_ = False
            else:
                six = lambda c, i: 4.5 if math.isnan(f[c][i]) else f[c][i]
                k = _within(six("away_k6", a) + f["machine_difficulty"][h] - six("home_k6", h), -3, 3)
                plus = [_within(f["momentum"][i], -3, 3) * 0.15 * ag + max(by, 0) * 0.2 for i, by in ((a, -k), (h, k))]
                # the league's strikeouts cancel out unless only one of the teams has some
                known = [not math.isnan(f["total_k6"][i]) for i in (a, h)]
                own = [f["hpg"][i] * 0.08 - (f["total_k6"][i] * 0.18 if k else 0) for i, k in zip((a, h), known, strict=True)]
                contact, open_ = own[0] - own[1], known[0] != known[1]
                terms = [(0.2, (d("rsg") + (f["rag"][h] - f["rag"][a]) * 0.7) / 9, 1.1), (0.1, d("momentum") / 7, 0.85), (0.05, d("sos") / 8, 0.55)]
                terms += [] if open_ else [(0.07, contact / 2.5, 0.75)]
                open_ = (contact, 0.18 * (known[0] - known[1])) if open_ else False
            self._pairs[a, h] = (f["rsg"][a] * f["rag"][h], f["rsg"][h] * f["rag"][a], *plus, sum(w * _within(v, -b, b) for w, v, b in terms), open_)
        return self._pairs[a, h]

    def predict(self, a: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rounded scores and the away team's chance in each course; plain numbers for a single one."""
        x, s, f, ag = self.of, self.state, self.fixed, self.settings.aggression
        clip = lambda v, low, high: x.minimum(x.maximum(v, low), high)
        runs_a, runs_h, plus_a, plus_h, fixed, open_ = self._pair(a, h)
        runs = x.where(self.played > 0, self.scored / x.maximum(self.played, 1), 7.0)
        per_run = x.maximum(runs, 1)
        ga, gh = s["games"][a], s["games"][h]
        na, nh = x.maximum(ga, 1), x.maximum(gh, 1)
        d = lambda c: s[c][a] - s[c][h]
        wins, ties = self.wins[a][h], self.ties[a][h]
        met = wins + self.wins[h][a] + ties
        h2h = clip(((wins + ties * 0.5) / x.maximum(met, 1) - 0.5) * 2 * clip(met / 4, 0.25, 1), -1, 1) * (met > 0)
        dpg = s["run_diff"][a] / na - s["run_diff"][h] / nh
        if self.settings.pitch_mode == "player":
            sa, sh = x.maximum(1, runs_a / per_run + plus_a), x.maximum(1, runs_h / per_run + plus_h)
            per = lambda c: f[c][a] / na - f[c][h] / nh
            # Fixed values, as in predict.py: weight, difference; all within 1.
            terms = 0.3 * clip(dpg / 8, -1, 1) + 0.15 * clip(per("walk_diff") / 5, -1, 1) + 0.1 * clip(per("hit_diff") / 7, -1, 1) + 0.1 * clip(per("error_diff") / 4, -1, 1) + 0.05 * h2h
            edge = (terms + fixed - 0.04) * _within(0.95 + ag * 0.16, 0.95, 1.25)
            thin_weight = 0.16
        else:
            tpi = d("tpi")
            tilt = clip(tpi, -6, 6) * (0.025 * ag)
            sa, sh = x.maximum(1, runs_a / per_run * (1 + tilt) + plus_a), x.maximum(1, runs_h / per_run * (1 - tilt) + plus_h)
            # Fixed values, as in predict.py: weight, difference, bound.
            terms = 0.34 * clip((sa - sh) / 8, -1.35, 1.35) + 0.28 * clip(tpi / 7, -1.25, 1.25) + 0.15 * clip(d("pct") * 1.35, -1, 1) + 0.13 * clip(dpg / 7, -1, 1) + 0.08 * h2h
            if open_:
                lg_k = x.where(self.played > 0, self.struck / x.maximum(self.played, 1), 4.5)
                terms = terms + 0.07 * clip((open_[0] + lg_k * open_[1]) / 2.5, -0.75, 0.75)
            edge = (terms + fixed - 0.06) * (clip((ga + gh) / 14, 0.35, 1) * _within(0.95 + ag * 0.18, 0.95, 1.25))
            thin_weight = 0.18
        logit = clip(edge, -_SURE, _SURE)
        thin = (ga < 2) | (gh < 2)
        some_thin = x.any(thin)
        if some_thin:
            prior = x.where(ga > 0, s["pct"][a], 0.5) - x.where(gh > 0, s["pct"][h], 0.5)
            even = 0.5 + clip(prior * thin_weight, -0.08, 0.08)
            logit = x.where(thin, x.log(even / (1 - even)), logit)
        shrink = (0.58 + x.minimum((ga + gh) / 20, 1) * 0.28) * _within(1 + (ag - 1) * 0.12, 0.9, 1.1)
        p = clip(1 / (1 + x.exp(-logit * shrink)), 0.04, 0.96)
        sa, sh = x.floor(sa + 0.5), x.floor(sh + 0.5)
        if some_thin:
            lean = clip((p - 0.5) * 6, -1, 1)
            sa, sh = x.where(thin, x.maximum(1, x.floor(runs + lean + 0.5)), sa), x.where(thin, x.maximum(1, x.floor(runs - lean + 0.5)), sh)
        return sa, sh, p

    def play(self, a: int, h: int, away_wins: np.ndarray, scores: tuple[np.ndarray, np.ndarray], where: np.ndarray | None = None) -> None:
        """Applies a result in each course: the predicted score, led by the winner. where: in which courses, or how often."""
        x, s, cap = self.of, self.state, self.cap
        ra = x.where(away_wins, x.maximum(scores[0], scores[1] + 1), scores[0])
        rh = x.where(away_wins, scores[1], x.maximum(scores[1], scores[0] + 1))
        one, away, home = 1.0, away_wins * 1.0, 1.0 - away_wins
        diff = x.minimum(x.maximum(ra - rh, -cap), cap)
        if where is not None:
            one = where * 1.0
            ra, rh, away, home, diff = (v * one for v in (ra, rh, away, home, diff))
        for me, other, runs, against, by, won, lost in ((a, h, ra, rh, diff, away, home), (h, a, rh, ra, -diff, home, away)):
            s["games"][me] += one
            s["rs"][me] += runs
            s["ra"][me] += against
            s["run_diff"][me] += by
            s["w"][me] += won
            s["l"][me] += lost
            self.wins[me][other] += won
        both = ra + rh
        self.played, self.scored, self.struck = self.played + 2 * one, self.scored + both, self.struck + (self.fixed["kpg"][a] + self.fixed["kpg"][h]) * one
        for me in (a, h):
            g = x.maximum(s["games"][me], 1)
            pct = (s["w"][me] + s["t"][me] * 0.5) / g
            tpi = x.minimum(x.maximum(s["run_diff"][me] / g, -8), 8) + pct * 2 + self.fixed["sos"][me] * 0.2
            s["pct"][me] = pct if where is None else x.where(where, pct, s["pct"][me])
            s["tpi"][me] = tpi if where is None else x.where(where, tpi, s["tpi"][me])

    def play_all(self, pairs: list[tuple[int, int]]) -> None:
        """A single course led through games, each won by the team that is predicted to win it."""
        of_pair, fast = {}, self.settings.pitch_mode != "player"
        s, ag, wins, tied, sos, kpg = self.state, self.settings.aggression, self.wins, self.ties, self.fixed["sos"], self.fixed["kpg"]
        games, won, lost, scored, against, run_diff, pct, tpi = (s[c] for c in ("games", "w", "l", "rs", "ra", "run_diff", "pct", "tpi"))
        # Fixed values, as in predict(); sums and products stand in its order, bounds keep what they are compared with.
        by_tilt, weight, lean, cap, floor, exp = 0.025 * ag, _within(0.95 + ag * 0.18, 0.95, 1.25), _within(1 + (ag - 1) * 0.12, 0.9, 1.1), self.cap, math.floor, math.exp
        for a, h in pairs:
            if a < 0:
                continue
            ga, gh = games[a], games[h]
            if (a, h) not in of_pair:
                of_pair[a, h] = self._pair(a, h)
            runs_a, runs_h, plus_a, plus_h, fixed, open_ = of_pair[a, h]
            if not fast or open_ or ga < 2 or gh < 2:
                *scores, p = self.predict(a, h)
                self.play(a, h, p >= 0.5, (scores[0], scores[1]))
                continue
            runs = self.scored / self.played
            per_run = 1 if runs < 1 else runs
            before, ties = wins[a][h], tied[a][h]
            met = before + wins[h][a] + ties
            h2h = 0.0
            if met > 0:
                share = met / 4
                h2h = ((before + ties * 0.5) / (1 if met < 1 else met) - 0.5) * 2 * (0.25 if share < 0.25 else 1 if share > 1 else share)
                h2h = -1 if h2h < -1 else 1 if h2h > 1 else h2h
            index = tpi[a] - tpi[h]
            tilt = (-6 if index < -6 else 6 if index > 6 else index) * by_tilt
            sa, sh = runs_a / per_run * (1 + tilt) + plus_a, runs_h / per_run * (1 - tilt) + plus_h
            sa, sh = sa if sa > 1 else 1, sh if sh > 1 else 1
            margin, index, ahead_by, by_game = (sa - sh) / 8, index / 7, (pct[a] - pct[h]) * 1.35, (run_diff[a] / ga - run_diff[h] / gh) / 7
            terms = 0.34 * (-1.35 if margin < -1.35 else 1.35 if margin > 1.35 else margin) + 0.28 * (-1.25 if index < -1.25 else 1.25 if index > 1.25 else index)
            terms = terms + 0.15 * (-1 if ahead_by < -1 else 1 if ahead_by > 1 else ahead_by) + 0.13 * (-1 if by_game < -1 else 1 if by_game > 1 else by_game) + 0.08 * h2h
            both = ga + gh
            share, sure = both / 14, both / 20
            logit = (terms + fixed - 0.06) * ((0.35 if share < 0.35 else 1 if share > 1 else share) * weight)
            logit = -_SURE if logit < -_SURE else _SURE if logit > _SURE else logit
            p = 1 / (1 + exp(-logit * ((0.58 + (1 if sure > 1 else sure) * 0.28) * lean)))
            ra, rh = floor(sa + 0.5), floor(sh + 0.5)
            if p >= 0.5:
                ra = rh + 1 if rh + 1 > ra else ra
                win, lose, by = a, h, ra - rh
            else:
                rh = ra + 1 if ra + 1 > rh else rh
                win, lose, by = h, a, ra - rh
            by = -cap if by < -cap else cap if by > cap else by
            games[a], games[h] = ga, gh = ga + 1, gh + 1
            scored[a] += ra
            scored[h] += rh
            against[a] += rh
            against[h] += ra
            run_diff[a] += by
            run_diff[h] -= by
            won[win] += 1
            lost[lose] += 1
            wins[win][lose] += 1
            self.played, self.scored, self.struck = self.played + 2, self.scored + (ra + rh), self.struck + (kpg[a] + kpg[h])
            for me, g in ((a, ga), (h, gh)):
                pct[me] = share = (won[me] + s["t"][me] * 0.5) / g
                diff = run_diff[me] / g
                tpi[me] = (-8 if diff < -8 else 8 if diff > 8 else diff) + share * 2 + sos[me] * 0.2

    def pairs(self, games: pd.DataFrame) -> list[tuple[int, int]]:
        """Positions of the two teams of each game, (-1, -1) where one is unknown."""
        found = [(self.at.get(a, -1), self.at.get(h, -1)) for a, h in zip(games["away_id"], games["home_id"], strict=True)]
        return [(a, h) if a >= 0 and h >= 0 else (-1, -1) for a, h in found]

    def _order(self, s: dict[str, list[float]], met: Callable[[int, int], tuple[float, float, float]]) -> list[int]:
        """Team positions of a course from first to last: percentage groups, tiebreakers, index, id."""
        by_pct = sorted(range(len(self.ids)), key=lambda t: (-s["pct"][t], t))
        out: list[int] = []
        at = 0
        while at < len(by_pct):
            end = at + 1
            while end < len(by_pct) and abs(s["pct"][by_pct[end]] - s["pct"][by_pct[at]]) <= 1e-4:
                end += 1
            group = by_pct[at:end]
            edge = dict.fromkeys(group, 0.0)
            if len(group) == 2 and "headToHead" in self.settings.factors:
                x, y = group
                wins, losses, ties = met(x, y)
                games = wins + losses + ties
                if games and abs(wins - losses) / games > 1e-4:
                    edge = {x: losses - wins, y: wins - losses}
            key = {"headToHead": lambda t, e=edge: e[t], "runDifferential": lambda t: -s["run_diff"][t], "runsAgainst": lambda t: s["ra"][t], "runsFor": lambda t: -s["rs"][t]}
            terms = [key[f] for f in self.settings.factors]
            out += sorted(group, key=lambda t: (*(k(t) for k in terms), -round(s["tpi"][t], 4), t))
            at = end
        return out

    def ranks(self) -> np.ndarray:
        """Rank of each team in each course."""
        out = np.zeros((self.n, len(self.ids)), np.int64)
        read = ("pct", "run_diff", "ra", "rs", "tpi")
        by_course = {c: [self.state[c]] if self.n == 1 else self.state[c].T.tolist() for c in read}
        for i in range(self.n):
            won = lambda x, y, i=i: self.wins[x][y] if self.n == 1 else float(self.wins[x, y, i])
            order = self._order({c: by_course[c][i] for c in read}, lambda x, y, won=won: (won(x, y), won(y, x), self.ties[x][y]))
            out[i, order] = np.arange(1, len(self.ids) + 1)
        return out


class Abreast(Season):
    """Two or more courses that all play the same games: how many each team has played, and against whom, is then
    one number for all courses. game() is predict() and play() in one, on rows of buffers that are made once."""

    def __init__(self, teams: pd.DataFrame | None, settings: Settings, n: int, since: Season | None = None):
        """since: courses that have been led to the same games, from which these go on."""
        if since is None:
            super().__init__(teams, settings, n)
        else:
            self.__dict__.update(since.__dict__)
        old, m = self.state, len(self.ids)
        first = lambda v: np.array(v)[..., 0]
        self.total, self.now = np.empty((m, 4, n)), np.empty((m, 3, n))
        games = first(old["games"])[:, None]
        self.played = float(first(self.played))
        if since is None:
            self.struck = float(first(self.struck))
        self.met = (first(self.wins) + first(self.wins).T + np.array(self.ties)).tolist()
        # rows of a team: wins and half its ties, run difference, runs, runs against; index, percentage, run difference a game
        for i, v in enumerate((old["w"] + old["t"] * 0.5, old["run_diff"], old["rs"], old["ra"])):
            self.total[:, i] = v
        for i, v in enumerate((old["tpi"], old["pct"], old["run_diff"] / np.maximum(games, 1))):
            self.now[:, i] = v
        self.scored = np.array(self.scored)
        none = np.zeros((m, 1))
        self.state = {"games": games, "w": self.total[:, 0], "l": old["l"], "t": none, "run_diff": self.total[:, 1], "rs": self.total[:, 2], "ra": self.total[:, 3], "tpi": self.now[:, 0], "pct": self.now[:, 1]}
        self._shares: dict[tuple[int, int], tuple] = {}
        self._scores, self._other, self._terms = np.empty((2, n)), np.empty((2, n)), np.empty((5, n))
        self._away, self._home, self._one = np.empty((4, n)), np.empty((4, n)), np.empty(n)
        # Fixed values, as in predict.py: divisors, bounds and weights of margin, index, percentage, run difference, head to head.
        self._by, self._most, self._weights = (np.repeat(np.array(v)[:, None], n, 1) for v in ((8.0, 7.0, 1.0, 7.0, 1.0), (1.35, 1.25, 1.0, 1.0, 1.0), (0.34, 0.28, 0.15, 0.13, 0.08)))
        self._least = -self._most
        # numbers as arrays without axes: an operation takes these in half the time of a plain number
        ag = self.settings.aggression
        self._fixed_numbers = [np.array(v) for v in (0.5, 1.0, 2.0, 6.0, -6.0, 8.0, -8.0, 1.35, 0.025 * ag, 0.06, _SURE, -_SURE, 0.04, 0.96, self.cap, -self.cap)]
        self._varying = [np.empty(()) for _ in range(7)]
        self._sos = [np.array(v * 0.2) for v in self.fixed["sos"]]

    def game(self, a: int, h: int, decide: Callable[[np.ndarray], np.ndarray]) -> None:
        """Plays a game, won by the away team in those courses that decide() marks, given its chance in each."""
        g = self.state["games"]
        ga, gh, met = g.item(a), g.item(h), self.met[a][h]
        open_ = self._pair(a, h)[-1]
        if self.settings.pitch_mode == "player" or open_ or ga < 2 or gh < 2:
            *scores, p = self.predict(a, h)
            self.play(a, h, decide(p), (scores[0], scores[1]))
            for me in (a, h):
                np.divide(self.total[me, 1], g.item(me), out=self.now[me, 2])
        else:
            self._game(a, h, ga, gh, met, decide)
        self.met[a][h] = self.met[h][a] = met + 1

    def _game(self, a: int, h: int, ga: float, gh: float, met: float, decide: Callable[[np.ndarray], np.ndarray]) -> None:
        if (a, h) not in self._shares:
            runs_a, runs_h, plus_a, plus_h, fixed, _ = self._pair(a, h)
            self._shares[a, h] = (*map(np.array, (runs_a, runs_h, plus_a, plus_h, fixed)),)
        runs_a, runs_h, plus_a, plus_h, fixed = self._shares[a, h]
        half, one, two, six, minus_six, eight, minus_eight, by_pct, by_tilt, at_home, sure, minus_sure, low, high, cap, minus_cap = self._fixed_numbers
        ag, now, total, wins, games = self.settings.aggression, self.now, self.total, self.wins, self.state["games"]
        scores, other, terms, away, home, p = self._scores, self._other, self._terms, self._away, self._home, self._one
        (sa, sh), (oa, oh), met_share = scores, other, terms[4]
        away_won, away_diff, away_runs, home_runs = away
        home_won, home_diff, _, _ = home
        least, most, sub, mul, div, add = np.maximum, np.minimum, np.subtract, np.multiply, np.divide, np.add
        n_played, n_met, ties, thin_met, weight, shrink, n_games = self._varying
        n_played[()], n_met[()], ties[()], thin_met[()] = self.played, met, self.ties[a][h] * 0.5, 2 * _within(met / 4, 0.25, 1)
        weight[()] = _within((ga + gh) / 14, 0.35, 1) * _within(0.95 + ag * 0.18, 0.95, 1.25)
        shrink[()] = -(0.58 + min((ga + gh) / 20, 1) * 0.28) * _within(1 + (ag - 1) * 0.12, 0.9, 1.1)
        # scores
        least(div(self.scored, n_played, p), one, p)
        div(runs_a, p, oa)
        div(runs_h, p, oh)
        sub(now[a], now[h], terms[1:4])
        mul(most(least(terms[1], minus_six, p), six, p), by_tilt, p)
        least(add(mul(oa, add(p, one, sa), sa), plus_a, sa), one, sa)
        least(add(mul(oh, sub(one, p, sh), sh), plus_h, sh), one, sh)
        # the away team's chance
        sub(sa, sh, terms[0])
        mul(terms[2], by_pct, terms[2])
        if met:
            mul(sub(div(add(wins[a, h], ties, met_share), n_met, met_share), half, met_share), thin_met, met_share)
        else:
            met_share[:] = 0
        mul(most(least(div(terms, self._by, terms), self._least, terms), self._most, terms), self._weights, terms)
        mul(sub(add(add.reduce(terms, 0, out=p), fixed, p), at_home, p), weight, p)
        np.exp(mul(most(least(p, minus_sure, p), sure, p), shrink, p), p)
        most(least(div(one, add(p, one, p), p), low, p), high, p)
        # the result: the predicted score, led by the winner
        away_won[:] = decide(p)
        sub(one, away_won, home_won)
        np.floor(add(scores, half, scores), scores)
        mul(add(sh, one, oa), away_won, oa)
        mul(add(sa, one, oh), home_won, oh)
        least(scores, other, away[2:])
        home[2:] = away[:1:-1]
        most(least(sub(away_runs, home_runs, away_diff), minus_cap, away_diff), cap, away_diff)
        np.negative(away_diff, home_diff)
        add(add(self.scored, away_runs, self.scored), home_runs, self.scored)
        self.played, self.struck = self.played + 2, self.struck + self.fixed["kpg"][a] + self.fixed["kpg"][h]
        for me, it, line, won, n in ((a, h, away, away_won, ga + 1), (h, a, home, home_won, gh + 1)):
            mine, is_now, record = total[me], now[me], wins[me, it]
            add(record, won, record)
            add(mine, line, mine)
            games[me, 0] = n_games[()] = n
            div(mine[:2], n_games, is_now[1:])
            index, pct, diff = is_now
            most(least(diff, minus_eight, p), eight, p)
            add(add(p, mul(pct, two, index), index), self._sos[me], index)


class Apart(Season):
    """Courses that need not have played the same games, and that can be copied on the way. All numbers of a course
    are one column of a table, so courses are equal, and go on alike, where their columns are."""

    def __init__(self, since: Season):
        """since: two or more courses, from which these go on."""
        self.__dict__.update(since.__dict__)
        m, n, old = len(self.ids), self.n, self.state
        games = np.maximum(old["games"], 1)
        parts = [np.stack([old["w"] + old["t"] * 0.5, old["run_diff"], old["rs"], old["ra"]], 1), np.stack([old["tpi"], old["pct"], old["run_diff"] / games], 1), old["games"], old["l"], self.wins, np.stack([np.broadcast_to(v, n) for v in (self.scored, self.played, self.struck)])]
        self.free: list[int] = []
        # the least games of each team, and of each pair, that a course has played
        self.least = np.array(old["games"]).min(1).tolist()
        ties = np.array(self.ties)
        self.least_met = (np.array(self.wins).min(2) + np.array(self.wins).min(2).T + (ties if ties.ndim == 2 else ties.min(2))).tolist()
        self._sos = [v * 0.2 for v in self.fixed["sos"]]
        self._show(np.concatenate([p.reshape(-1, n) for p in parts]), n)

    def _show(self, table: np.ndarray, n: int) -> None:
        """Names the parts of the first n columns of a table."""
        m, room = len(self.ids), table.shape[1]
        ends = np.cumsum([0, 4 * m, 3 * m, m, m, m * m, 3])
        total, now, games, lost, wins, sums = (table[i:j] for i, j in zip(ends, ends[1:], strict=False))
        self.table, self.n = table, n
        self.total, self.now, self.wins = total.reshape(m, 4, room)[..., :n], now.reshape(m, 3, room)[..., :n], wins.reshape(m, m, room)[..., :n]
        self.scored, self.played, self.struck = self._sums = sums[:, :n]
        self.state = {"games": games[:, :n], "w": self.total[:, 0], "l": lost[:, :n], "t": np.zeros((m, 1)), "run_diff": self.total[:, 1], "rs": self.total[:, 2], "ra": self.total[:, 3], "tpi": self.now[:, 0], "pct": self.now[:, 1]}
        self._scores, self._other, self._terms = np.empty((2, n)), np.empty((2, n)), np.empty((5, n))
        self._away, self._home, self._one = np.empty((4, n)), np.empty((4, n)), np.empty(n)
        # Fixed values, as in predict.py: divisors, bounds and weights of margin, index, percentage, run difference, head to head.
        self._by, self._most, self._weights = (np.array(v)[:, None] for v in ((8.0, 7.0, 1.0, 7.0, 1.0), (1.35, 1.25, 1.0, 1.0, 1.0), (0.34, 0.28, 0.15, 0.13, 0.08)))

    def new(self) -> int:
        """A column that no course uses."""
        if self.free:
            return self.free.pop()
        n, room = self.n, self.table.shape[1]
        table = self.table if n < room else np.concatenate([self.table, np.empty((len(self.table), n))], 1)
        table[:, n] = table[:, 0]
        self._show(table, n + 1)
        return n

    def game(self, a: int, h: int, draw: np.ndarray | None = None, where: np.ndarray | None = None) -> None:
        """Plays a game, won by the team that is predicted to win it or, with draws, by the away team where they are below its chance. where: only in these courses."""
        games, least = self.state["games"], (self.least[a], self.least[h])
        if where is not None or self.settings.pitch_mode == "player" or self._pair(a, h)[-1] or min(least) < 2 or self.least_met[a][h] < 1:
            *scores, p = self.predict(a, h)
            self.play(a, h, p >= 0.5 if draw is None else draw < p, (scores[0], scores[1]), where)
            self._sums[:] = self.scored, self.played, self.struck
            self.scored, self.played, self.struck = self._sums
            for me in (a, h):
                np.divide(self.total[me, 1], np.maximum(games[me], 1), out=self.now[me, 2])
        else:
            self._game(a, h, sum(least), draw)
        if where is None:
            self.least[a], self.least[h] = least[0] + 1, least[1] + 1
            self.least_met[a][h] = self.least_met[h][a] = self.least_met[a][h] + 1

    def _game(self, a: int, h: int, least_both: float, draw: np.ndarray | None) -> None:
        runs_a, runs_h, plus_a, plus_h, fixed, _ = self._pair(a, h)
        ag, now, total, wins, games = self.settings.aggression, self.now, self.total, self.wins, self.state["games"]
        scores, other, terms, away, home, p = self._scores, self._other, self._terms, self._away, self._home, self._one
        (sa, sh), (oa, oh), share = scores, other, terms[4]
        away_won, away_diff, away_runs, home_runs = away
        home_won, home_diff, _, _ = home
        least, most, sub, mul, div, add = np.maximum, np.minimum, np.subtract, np.multiply, np.divide, np.add
        by, lean = _within(0.95 + ag * 0.18, 0.95, 1.25), _within(1 + (ag - 1) * 0.12, 0.9, 1.1)
        if least_both >= 20:
            weight, shrink = by, -(0.58 + 0.28) * lean
        else:
            both = games[a] + games[h]
            weight, shrink = most(least(both / 14, 0.35), 1) * by, -(0.58 + most(both / 20, 1) * 0.28) * lean
        # scores
        least(div(self.scored, self.played, p), 1.0, p)
        div(runs_a, p, oa)
        div(runs_h, p, oh)
        sub(now[a], now[h], terms[1:4])
        mul(most(least(terms[1], -6.0, p), 6.0, p), 0.025 * ag, p)
        least(add(mul(oa, add(p, 1.0, sa), sa), plus_a, sa), 1.0, sa)
        least(add(mul(oh, sub(1.0, p, sh), sh), plus_h, sh), 1.0, sh)
        # the away team's chance
        sub(sa, sh, terms[0])
        mul(terms[2], 1.35, terms[2])
        met = add(add(wins[a, h], wins[h, a], p), self.ties[a][h], p)
        thin = 2.0 if self.least_met[a][h] >= 4 else 2 * most(least(met / 4, 0.25), 1)
        mul(sub(div(add(wins[a, h], self.ties[a][h] * 0.5, share), met, share), 0.5, share), thin, share)
        mul(most(least(div(terms, self._by, terms), -self._most, terms), self._most, terms), self._weights, terms)
        mul(sub(add(add.reduce(terms, 0, out=p), fixed, p), 0.06, p), weight, p)
        np.exp(mul(most(least(p, -_SURE, p), _SURE, p), shrink, p), p)
        most(least(div(1.0, add(1.0, p, p), p), 0.04, p), 0.96, p)
        # the result: the predicted score, led by the winner
        np.greater(p, draw, out=away_won) if draw is not None else np.greater_equal(p, 0.5, out=away_won)
        sub(1.0, away_won, home_won)
        np.floor(add(scores, 0.5, scores), scores)
        mul(add(sh, 1.0, oa), away_won, oa)
        mul(add(sa, 1.0, oh), home_won, oh)
        least(scores, other, away[2:])
        home[2:] = away[:1:-1]
        most(least(sub(away_runs, home_runs, away_diff), -self.cap, away_diff), self.cap, away_diff)
        np.negative(away_diff, home_diff)
        add(add(self.scored, away_runs, self.scored), home_runs, self.scored)
        self.played += 2
        self.struck += self.fixed["kpg"][a] + self.fixed["kpg"][h]
        for me, it, line, won in ((a, h, away, away_won), (h, a, home, home_won)):
            mine, is_now, record, n = total[me], now[me], wins[me, it], games[me]
            add(record, won, record)
            add(mine, line, mine)
            add(n, 1.0, n)
            div(mine[:2], n, is_now[1:])
            index, pct, diff = is_now
            most(least(diff, -8.0, p), 8.0, p)
            add(add(p, mul(pct, 2.0, index), index), self._sos[me], index)

    def ranks(self, columns: list[int] | None = None) -> np.ndarray:
        """Rank of each team in each of the columns."""
        columns = list(range(self.n)) if columns is None else columns
        by_course = {c: self.state[c][:, columns].T.tolist() for c in ("pct", "run_diff", "ra", "rs", "tpi")}
        wins = self.wins
        out = np.zeros((len(columns), len(self.ids)), np.int64)
        for i, c in enumerate(columns):
            met = lambda x, y, c=c: (float(wins[x, y, c]), float(wins[y, x, c]), self.ties[x][y])
            out[i, self._order({r: v[i] for r, v in by_course.items()}, met)] = np.arange(1, len(self.ids) + 1)
        return out


class Versions(Apart):
    """Courses of several states of a season side by side: what no result changes is each state's own too."""

    def __init__(self, seasons: list[Season]):
        """seasons: of the same teams, each of two or more courses."""
        self.__dict__.update(seasons[0].__dict__)
        self.seasons, self.each, self.n = seasons, [s.n for s in seasons], sum(s.n for s in seasons)
        self.state = {c: np.concatenate([s.state[c] for s in seasons], -1) for c in _MOVING}
        self.wins = np.concatenate([s.wins for s in seasons], -1)
        self.ties = np.moveaxis(self._spread([s.ties for s in seasons]), 0, -1)
        self.scored, self.played, self.struck = (np.concatenate([np.broadcast_to(getattr(s, c), s.n) for s in seasons]) for c in ("scored", "played", "struck"))
        self.fixed = {c: self._spread([s.fixed[c] for s in seasons]).T for c in _FIXED}
        self._pairs = {}
        super().__init__(self)

    def _spread(self, values: list) -> np.ndarray:
        return np.repeat(np.array(values, np.float64), self.each, 0)

    def _pair(self, a: int, h: int) -> tuple:
        if (a, h) not in self._pairs:
            *parts, open_ = zip(*[s._pair(a, h) for s in self.seasons], strict=True)
            # a state whose strikeouts cancel out adds nothing
            open_ = tuple(self._spread([o[i] if o else 0.0 for o in open_]) for i in (0, 1)) if any(open_) else False
            self._pairs[a, h] = (*map(self._spread, parts), open_)
        return self._pairs[a, h]

    def ranks(self, columns: list[int] | None = None) -> np.ndarray:
        columns, ties, out = list(range(self.n)) if columns is None else columns, self.ties, []
        for c in columns:  # ties of a state hold for its courses only
            self.ties = ties[..., c].tolist()
            out.append(super().ranks([c])[0])
        self.ties = ties
        return np.stack(out)
