"""Queries that did too much, or less than their whole job, on larger tables."""

import numpy as np
import pandas as pd
from test_league import GAMES, season

from pennant.operators import predict, race, simulate, standings, states, stats
from pennant.operators.fold import Season
from pennant.settings import Settings


def test_record_swings_rank_the_next_games_only(spark, tmp_path, monkeypatch):
    from pennant.plans import queries_more as q

    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2)] + [(*"ABBCCA"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(12)])
    s, h = stats.team_stats(g, t), stats.head_to_head(g)
    predicted = predict.predictions(stats.remaining(g), s, h)
    ranked = standings.rank_teams(s, h)
    for name, made in {"league.games": g, "stats_of": s, "h2h_of": h, "_open": predicted, "ranked_of": ranked}.items():
        monkeypatch.setattr(f"pennant.plans.queries_more.{name}", lambda *_, made=made: made)
    monkeypatch.setattr(q, "derived", lambda s, sources, name, make: make())
    seen, real = [], race.one_result_status
    monkeypatch.setattr(race, "one_result_status", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    every = race.own_scenarios(g, real(g, s, h, stats.remaining_counts(g, s), predicted).withColumnRenamed("rank", "seed"))
    want = race.swing_games(every, ranked.withColumnRenamed("rank", "projected_rank"), predicted)
    assert sorted(map(tuple, q._swings(spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))
    assert sum(x.select("game_id").distinct().count() for x in seen) == 3


def test_state_games_are_counted_without_rows_of_states(spark, tmp_path, monkeypatch):
    from pennant.plans.queries_models import MODELS

    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("C", "A", None, None), ("C", "A", 1, 1), ("A", "B", 2, 0)])
    want = sorted((r.season, r.state, r["count"]) for r in states.states(g, t)[1].groupBy("season", "state").count().collect())
    monkeypatch.setattr("pennant.plans.queries_models.league.games", lambda *_: g)
    monkeypatch.setattr("pennant.plans.queries_models.league.teams", lambda *_: t)
    monkeypatch.setattr(states, "states", None)
    assert sorted(map(tuple, MODELS["j11_state_games"][0](spark, str(tmp_path)).collect())) == want == [("s", i, i) for i in range(1, 5)]


def _open_season(spark, n=40):
    return season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("C", "D", 5, 5), ("D", "A", 1, 7)] + [(*"ABBCCAADDBCD"[i * 5 % 6 * 2 : i * 5 % 6 * 2 + 2], None, None) for i in range(n)])


def test_scenarios_of_a_pair_share_their_courses(spark):
    """Each game either way, played by itself, gives what courses give that part and go on as one; with few courses too."""
    g, t = _open_season(spark, 26)
    fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
    teams, games = fold.toPandas(), left.orderBy("ord").toPandas()
    want = {}
    for j, game in enumerate(games.itertuples()):
        for away_won, winner in ((True, game.away_id), (False, game.home_id)):
            s = Season(teams, Settings(), 1)
            pairs = s.pairs(games)
            for i, (a, h) in enumerate([pairs[j], *pairs[:j], *pairs[j + 1 :]]):
                *scores, p = s.predict(a, h)
                s.play(a, h, away_won if i == 0 else p >= 0.5, scores)
            want |= {(game.game_id, winner, x): int(rank) for x, rank in zip(s.ids, s.ranks()[0], strict=True)}
    for kw in ({}, {"block_of": 2}, {"most": 3}):
        got = simulate.scenarios(fold, left, **kw).collect()
        assert len(got) == len(want) and {(r.game_id, r.winner_id, r.team_id): r.seed for r in got} == want
    own = race.own_games(g, simulate.own_seeds(fold, left)).collect()
    assert len(own) == 2 * 26 and all((r.win_seed, r.loss_seed) == (want[r.game_id, r.team_id, r.team_id], want[r.game_id, r.opp_id, r.team_id]) for r in own)


def test_a_group_of_scenarios_is_sent_its_games_once_a_block_of_pairs(spark, monkeypatch):
    """Rows that are shuffled grow with the open games, not with their square."""
    sent, real = [], simulate.by_season
    monkeypatch.setattr(simulate, "by_season", lambda teams, games, *a: sent.append(games) or real(teams, games, *a))
    for n in (300, 600):
        rows = [("s", i, f"g{i}", None, *("AB", "BC", "CA")[i % 3]) for i in range(n)]
        left = spark.createDataFrame(rows, "season string, ord long, game_id string, game_date date, away_id string, home_id string")
        g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("A", "C", 5, 2)])
        assert simulate.own_seeds(simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), left).count() == n
    assert [x.count() for x in sent] == [300, 600]


def test_locks_are_decided_at_any_number_of_open_games(spark):
    """Fewer or more open games say the same, and neighbours that can only draw level are decided by what breaks the tie."""
    for n in (11, 14, 30):
        # out of reach; B can pass; B can draw level, also in their games, but its wins are by a run and its losses were by six
        for finals, want in ((70, True), (n - 1, False), (n, True)):
            rows = [("s", f"g{i}", i, None, "A", "B", True, 9, 0, 0, 0, 0, 3, 0, 0, 0, 0, 6) for i in range(finals)]
            rows += [("s", f"o{i}", 999 + i, None, "A", "B", False, *[None] * 10, 6) for i in range(n)]
            g, t = spark.createDataFrame(rows, GAMES), spark.createDataFrame([("s", x, x, i) for i, x in enumerate("AB")], "season string, team_id string, name string, ord long")
            fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
            assert tuple(simulate.seeding_locked(fold, left).first()) == ("s", want, n), (n, finals)


def test_locks_equal_every_outcome():
    """Small seasons gone through outcome by outcome, with ties at the end and without."""
    rng, seen = np.random.default_rng(1), set()
    for _ in range(300):
        ids, n = list("ABCD")[: rng.integers(2, 5)], int(rng.integers(1, 7))
        m = len(ids)
        wins = np.triu(rng.integers(0, 9, (m, m)), 1) + np.tril(rng.integers(0, 2, (m, m)), -1)
        w, lost = wins.sum(1), wins.sum(0)
        columns = {c: np.zeros(m) for c in simulate.TEAM_COLUMNS} | {"games": w + lost, "w": w, "l": lost, "run_diff": (w - lost) * 2, "pct": w / np.maximum(w + lost, 1), "total_k6": np.full(m, np.nan)}
        met = [[{"opp_id": ids[j], "wins": wins[i, j], "losses": wins[j, i], "ties": 0} for j in range(m)] for i in range(m)]
        teams = pd.DataFrame({"team_id": ids, "met": met, **columns})
        games = pd.DataFrame([[ids[x] for x in rng.choice(m, 2, replace=False)] for _ in range(n)], columns=["away_id", "home_id"])
        s, course = Season(teams, Settings(), 1 << n), np.arange(1 << n)
        for j, (a, h) in enumerate(s.pairs(games)):
            *scores, _ = s.predict(a, h)
            s.play(a, h, (course >> j) & 1 == 0, (scores[0], scores[1]))
        want = bool((s.ranks() == Season(teams, Settings(), 1).ranks()).all())
        assert simulate._locked(teams, games, Settings()) is want
        seen.add(want)
    assert seen == {True, False}


def test_recaps_and_differences_tell_simulated_odds(spark):
    from pennant.plans.queries_race import RACE, Race

    d = "/root/testdata/sf0.001"
    odds = {(r.season, r.team_id): round(r.odds, 6) for r in Race(spark, d).odds.collect()}
    assert {(r.season, r.team_id): r.gold_odds for r in RACE["ch1_snapshot"][0](spark, d).collect()} == odds
    assert RACE["ch2_team_diffs"][0](spark, d).where("reasons LIKE '%odds-change%'").count() > 0
    assert RACE["ch5_weekly_recap"][0](spark, d).where("kind = 'gold-shift'").count() > 0


def test_seasons_are_shared_in_parts(spark):
    """Parts of two games each are snapshots by themselves and give the tables that one snapshot gives."""
    from pennant.sources import share, storage

    rows = lambda n, *more: spark.createDataFrame([("s", f"g{i}", *more) for i in range(n)], "season string, game_id string" + "".join(f", c{j} string" for j in range(len(more))))
    games = rows(5).selectExpr("season", "game_id", "cast(substr(game_id, 2) AS long) AS ord", "'5/1' AS date_text", "'A' AS away_id", "'B' AS home_id")
    logs = rows(7, *["1"] * 12).toDF("season", "game_id", *[c for c in storage.FIELDS.values() if c != "is_final"][:7], *[c for c in storage.FIELDS.values() if c != "is_final"][7:], "n")
    logs = logs.drop("n").withColumn("is_final", logs.game_id < "g3")
    teams = spark.createDataFrame([("s", "A", "Aces", 0), ("s", "B", "Bears", 1), ("t", "A", "Aces", 0)], storage.TEAMS)
    settings = spark.createDataFrame([("s", '{"goldCutoff":7}')], storage.SETTINGS)
    stored = storage.Stored(teams, games, logs, logs.limit(0), settings)
    parts = share.in_parts(stored, of=2)
    assert sorted((r.season, r.part) for r in parts.collect()) == [("s", 0), ("s", 1), ("s", 2), ("s", 3), ("t", 0)]
    want, got = share.expand(share.snapshots(stored, most=None), most=None), share.from_parts(parts, of=2)
    for name, one, other in zip(want._fields, want, got, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect())), name


def test_states_side_by_side_are_states_by_themselves(spark):
    """Courses of all states in one group give the hits of a group for each state; games are sent once, not once a state."""
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("C", "A", 4, 4), ("C", "D", 5, 1)] + [(*"ABBCCADA"[i % 4 * 2 : i % 4 * 2 + 2], None, None) for i in range(20)])
    f, inside, rows = states.states(g, t)
    keys = states.STATE
    teams = simulate.fold_teams(stats.team_stats(inside, rows, 8, keys), stats.head_to_head(inside, keys), keys).where("state > 0")
    seeds = spark.createDataFrame([("s", i, f"x{i}") for i in range(1, 5)], "season string, state int, seed_text string")
    every = g.join(f.selectExpr("season", "game_id", "seq + 1 AS since"), ["season", "game_id"], "left").select("season", "ord", "game_id", "away_id", "home_id", "since")
    one = every.join(seeds.select(*keys), "season").where("since IS NULL OR since > state").selectExpr("season", "state", "ord", "game_id", "cast(null AS date) AS game_date", "away_id", "home_id")
    cols = ["state", "team_id", "block", "hits"]
    for n in (1, 60):
        want = simulate.simulate(teams, one, seeds, Settings(gold_cutoff=2), n, keys).select(cols)
        got = simulate.simulate_states(teams, every, seeds, Settings(gold_cutoff=2), n).select(cols)
        assert want.count() == 4 * 4 * (1 if n == 1 else 3) and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
