"""Hand-worked seasons and generator checks."""

import datetime as dt

import numpy as np
import pandas as pd

from pennant.operators import bracket, schedule, simulate, standings, stats, validate
from pennant.operators.fold import Abreast, Season, lcg, streams
from pennant.settings import FACTORS, Settings, coerce_settings

GAMES = "season string, game_id string, ord long, game_date date, away_id string, home_id string, is_final boolean, " + ", ".join(f"{s}_{x} long" for s in ("away", "home") for x in stats.STATS) + ", innings long"


def season(spark, results):
    """results: (away, home, away runs, home runs); None for open games."""
    rows = []
    for i, (a, h, x, y) in enumerate(results):
        box = lambda r: (r, 0, 0, 0, 0) if x is not None else (None,) * 5
        rows.append(("s", f"g{i}", i, dt.date(2026, 5, i + 1), a, h, x is not None, *box(x), *box(y), 6))
    ids = sorted({t for r in results for t in r[:2]})
    teams = spark.createDataFrame([("s", t, t, i) for i, t in enumerate(ids)], "season string, team_id string, name string, ord long")
    return spark.createDataFrame(rows, GAMES), teams


def test_totals_of_a_hand_worked_week(spark):
    # X beats Y by one, Y and Z part 6-6, Z beats X twice
    g, t = season(spark, [("X", "Y", 3, 2), ("Y", "Z", 6, 6), ("Z", "X", 7, 1), ("X", "Z", 0, 4), ("Y", "X", None, None)])
    got = {r.team_id: (r.games, r.w, r.l, r.t, r.rs, r.ra, r.run_diff) for r in stats.team_totals(g, t).collect()}
    assert got == {"X": (3, 1, 2, 0, 4, 13, -9), "Y": (2, 0, 1, 1, 8, 9, -1), "Z": (3, 2, 0, 1, 17, 7, 10)}


def test_each_game_is_capped_by_itself(spark):
    g, t = season(spark, [("X", "Y", 14, 1), ("X", "Y", 2, 5), ("Y", "X", 11, 0)])
    diffs = lambda cap: {r.team_id: r.run_diff for r in stats.team_totals(g, t, cap).collect()}
    # 13, -3, -11: by 6 each 6 - 3 - 6; by 12 each 12 - 3 - 11; without a cap -1
    assert diffs(6) == {"X": -3, "Y": 3} and diffs(12) == {"X": -2, "Y": 2} and diffs(0) == {"X": -1, "Y": 1}


def test_pair_tiebreak_and_status(spark):
    g, t = season(spark, [("A", "B", 1, 2), ("A", "C", 9, 0), ("B", "C", 1, 2), ("A", "C", None, None)])
    s = stats.team_stats(g, t)
    r = standings.rank_teams(s, stats.head_to_head(g), Settings(tiebreaker_order=("headToHead",)))
    assert {x.team_id: x.rank for x in r.collect()}["C"] == 3 or s.count() == 3
    out = standings.gold_status(r, stats.remaining_counts(g, s), Settings(gold_cutoff=3)).collect()
    assert all(x.gold_status == "Clinched" for x in out)


def test_projection_odds_and_exact(spark):
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 1, 2), ("A", "C", 5, 2), ("A", "B", None, None)])
    fold = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g))
    settings = Settings(gold_cutoff=1)
    odds = {r.team_id: r.odds for r in simulate.gold_odds(fold, g, settings, 50).collect()}
    assert abs(sum(odds.values()) - 100) < 1e-6 and odds["A"] > 50
    assert {r.team_id: r.projected_rank for r in simulate.project(fold, simulate.open_games(g), settings).collect()}["A"] == 1
    exact = {r.team_id: (r.magic, r.losses_to_out) for r in simulate.exact_status(fold, simulate.open_games(g), settings).collect()}
    assert exact["A"] == ("clinched", None) and exact["B"][1] == 0
    assert simulate.scenarios(fold, simulate.open_games(g), settings).count() == 6


def test_no_limit_of_open_games(spark):
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("A", "C", 5, 2)])
    fold = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g))
    rows = [("s", i, f"g{i}", dt.date(2026, 6, 1), *("AB", "BC", "CA")[i % 3]) for i in range(255)]
    left = spark.createDataFrame(rows, "season string, ord long, game_id string, game_date date, away_id string, home_id string")
    projected = simulate.project(fold, left).collect()
    assert sum(r.w + r.l for r in projected) == 2 * 258 and simulate.win_out(fold, left).count() == 3
    assert all(r.w == 2 for r in simulate.project(fold, left, limit=simulate.PROJECT_LIMIT).where("team_id = 'A'").collect())
    assert simulate.scenarios(fold, left).count() == 255 * 2 * 3
    assert simulate.scenarios(fold, left, limit=simulate.SCENARIO_LIMIT).count() == 0
    assert simulate.seeding_locked(fold, left).first().locked is False


def test_scenario_blocks_are_one_run(spark):
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2)] + [(*"ABBCCA"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(7)])
    fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
    rows = [sorted(map(tuple, simulate.scenarios(fold, left, block_of=n).collect())) for n in (256, 3, 1)]
    assert len(rows[0]) == 7 * 2 * 3 and rows[0] == rows[1] == rows[2]


def test_iterations_abreast_are_one_run(spark):
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2)] + [(*"ABBCCA"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(7)])
    fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
    seeds = simulate.seed_text(g, simulate.odds_extras(Settings()))
    run = lambda iterations, abreast: sorted(map(tuple, simulate.simulate(fold, left, seeds, Settings(gold_cutoff=1), iterations, abreast=abreast).collect()))
    assert len(run(60, 10)) == 3 * 3 and run(60, 10) == run(60, 1) == run(60, 2)
    assert run(26, 10) == run(26, 1)


def test_a_single_course_is_kept_in_plain_numbers():
    columns = {c: [1.0, 2.0, 3.0] for c in simulate.TEAM_COLUMNS} | {"games": [0.0, 4.0, 9.0], "total_k6": [None, 5.0, 6.0], "pct": [0.0, 0.5, 0.6]}
    t = pd.DataFrame({"team_id": ["A", "B", "C"], "met": [None, [{"opp_id": "C", "wins": 1, "losses": 2, "ties": 1}], [{"opp_id": "B", "wins": 2, "losses": 1, "ties": 1}]], **columns})
    for mode in ("machine", "player"):
        one, many = (Season(t, Settings(pitch_mode=mode), n) for n in (1, 3))
        for a, h in [(0, 1), (1, 2), (2, 0), (2, 1)] * 5:
            x, y = one.predict(a, h), many.predict(a, h)
            assert all(type(v) in (float, int) for v in x) and all(np.allclose(v, w, atol=1e-12) for v, w in zip(x, y, strict=True))
            one.play(a, h, x[2] >= 0.5, x[:2])
            many.play(a, h, y[2] >= 0.5, y[:2])
        assert (many.ranks() == one.ranks()).all()


def test_draws_are_made_in_pieces():
    pieces = list(streams(99, [0, 123], 700))
    assert [len(p) for p in pieces] == [512, 188]
    assert np.array_equal(np.concatenate(pieces), np.stack([lcg(99, 0, 700), lcg(99, 123, 700)], 1))


def test_locks_above_the_limit(spark):
    g, t = season(spark, [("A", "B", 9, 3)] * 20 + [("A", "B", None, None)] * 2)
    fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
    assert simulate.seeding_locked(fold, left).first().locked is True
    assert simulate.seeding_locked(fold, left, limit=1).first().locked is None


def test_power_ranks_are_of_all_teams(spark, monkeypatch):
    from pennant.plans import queries_more as q

    rows = [("s", r, f"T{r}", 1.0 / r) for r in range(1, 9)]
    monkeypatch.setattr(q, "_power", lambda *_: spark.createDataFrame(rows, "season string, rank long, team_id string, rating double"))
    assert sorted(r["rank"] for r in q.MORE["w5_power_ranks"][0](spark, "").collect()) == list(range(1, 9))


def test_random_stream_jumps():
    state, serial = 99, []
    for _ in range(500):
        state = (1664525 * state + 1013904223) % 2**32
        serial.append(state / 2**32)
    assert np.allclose(lcg(99, 0, 500), serial) and np.allclose(lcg(99, 123, 50), serial[123:173])


def test_bracket_parts():
    assert bracket.seed_order(8) == [1, 8, 4, 5, 2, 7, 3, 6]
    assert bracket.fnv("a") == 0xE40C292C
    assert bracket.pick("g", 0, ("x", 1), ("y", 2), 0.2) == "x" and bracket.pick("g", 0, ("x", 2), ("y", 1), 0.3) == "x"


def test_unknown_teams_are_skipped():
    t = pd.DataFrame({"team_id": ["A"], "met": [None], **{c: [0.0] for c in simulate.TEAM_COLUMNS}})
    s = Season(t, Settings(), 1)
    assert s.pairs(pd.DataFrame({"away_id": ["A"], "home_id": ["Z"]})) == [(-1, -1)]


def test_demo_season_and_round_robin(spark):
    teams, games = schedule.demo_season(spark)
    assert games.count() == 28 and games.where("is_final").count() == 18
    assert schedule.round_robin(teams).count() == 28


def test_settings_and_ids_are_coerced(spark):
    s = coerce_settings({"goldCutoff": 99.4, "winPoints": float("nan"), "tiePoints": True, "defaultGameInnings": 11, "tiebreakerOrder": ["runsFor", 3, "runsFor", "headToHead"], "pitchMode": "robot"})
    assert (s.gold_cutoff, s.win_points, s.tie_points, s.default_game_innings, s.tiebreaker_order, s.pitch_mode) == (64, 1.0, 0.5, 10, ("runsFor", "headToHead"), "machine")
    assert validate.team_ids(["Wolf Pack", "wolfhounds", "", "Wolf-1", "W1"]) == ["WOLF", "WOL1", "TEAM", "WOL2", "W1"]
    names = spark.createDataFrame([("s", n, i) for i, n in enumerate(["Wolf Pack", "wolfhounds", "", "Wolf-1", "WOL1"])], "season string, name string, ord long")
    assert [r.team_id for r in validate.with_team_ids(names).orderBy("ord").collect()] == validate.team_ids(["Wolf Pack", "wolfhounds", "", "Wolf-1", "WOL1"])
    raw = spark.createDataFrame([("s", "q ", " Quails", 4), ("s", "q", "Late", 9), ("s", "r", " ", 1), ("t", "q", "Other season", 9)], "season string, team_id string, name string, ord long")
    assert sorted((r.season, r.team_id, r.name) for r in validate.coerce_teams(raw).collect()) == [("s", "q", "Quails"), ("t", "q", "Other season")]


def test_issue_lines(spark):
    rows = [("duplicate-id", r, d) for r, d in ((31, "k7"), (12, "k2"), (40, "k7"))] + [("missing-team", 8, None)] + [("unknown-team", r, f"Team {r % 2}") for r in (3, 21, 22, 23, 24, 25, 26)]
    lines = {r.kind: r.line for r in validate.issue_summary(spark.createDataFrame(rows, "kind string, row_number long, detail string")).collect()}
    assert lines["duplicate-id"].startswith("3 row(s)") and "12, 31, 40" in lines["duplicate-id"] and lines["duplicate-id"].endswith("k2; k7")
    assert "+2 more" in lines["unknown-team"] and lines["unknown-team"].endswith("Team 1; Team 0")
    assert "8" in lines["missing-team"] and "more" not in lines["missing-team"] and "—" not in lines["missing-team"]


def test_names_and_dates(spark):
    from pyspark.sql import functions as F

    from pennant.functions import scalars as fn

    names = {"Union  Comets NKYA": "Comets", "soas": "soas", "The DOBBERS 8u": "Dirt Dobbers", "Unionists": "Unionists"}
    dates = {"0/0": "1/1", "12/31/99": "12/31", "2026-02-30": "", "2025-11-09": "11/9", "Fri, June 3rd": "6/3", "sept 9, 2026": "9/9", "Juny 4": "", "Feb 29": "", "7": "", None: ""}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", fn.display_name(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == names
    got = spark.createDataFrame([(k,) for k in dates], "d string").select("d", fn.normal_date(F.col("d")).alias("v")).collect()
    assert {r.d: r.v for r in got} == dates


def test_compared_teams(spark):
    from pennant.operators import compare

    cols = ["w", "l", "t", "pct", "run_diff", "rsg", "rag", "hpg", "kpg", "opp_kpg", "tpi", "gold_pct", "rank", "projected_rank"]
    rows = [("s", "A", 3, 1, 0, 0.75, 4, 5.0, 4.0, 6.0, 2.0, 3.0, 1.25, 80.4, 1, 2), ("s", "B", 2, 1, 1, 0.625, 4, 5.5, 4.5, 6.0, 1.0, 3.5, -0.5, 80.6, 2, 1)]
    board = spark.createDataFrame(rows, "season string, team_id string, " + ", ".join(f"{c} {'double' if isinstance(v, float) else 'long'}" for c, v in zip(cols, rows[0][2:], strict=True)))
    got = compare.compare_teams(spark.createDataFrame([("s", "A", "B")], "season string, left_id string, right_id string"), board).orderBy("nth").collect()
    assert [(r.left, r.right, r.better) for r in got] == [
        ("3-1", "2-1-1", None), ("75%", "63%", "left"), ("+4", "+4", "tie"), ("5.0", "5.5", "right"), ("4.0", "4.5", "left"), ("6.0", "6.0", "tie"),
        ("2.0", "1.0", "right"), ("3.0", "3.5", "right"), ("+1.25", "-0.50", "left"), ("80%", "81%", "right"), ("#1", "#2", "left"), ("#2", "#1", "right"),
    ]


def test_match_scores(spark):
    """Held whole, held in order, not held; any case; empty queries match all."""
    from pennant.functions.scalars import match_score

    rows = [("", "x", 1), ("go", "Go to scores", 2), ("gts", "Go to scores", 1), ("stg", "Go to scores", 0), ("GTS", "go to scores", 1), ("a", None, 0), ("", None, 1), ("aa", "a", 0), ("ß.", "Straße. ", 1), ("s.", "a.s", 0)]
    df = spark.createDataFrame(rows, "q string, t string, want int")
    assert [(r.got, r.q) for r in df.select(match_score(df.q, df.t).alias("got"), "q").collect()] == [(r[2], r[0]) for r in rows]


def test_close_percentages_are_one_group(spark):
    # as the reference does: A's 0.50004 and B's 0.5 are tied, so the run difference decides; C's 0.4998 is behind
    rows = [("s", "A", 0.50004, 1, 9, 9, 0.0), ("s", "B", 0.5, 5, 9, 9, 0.0), ("s", "C", 0.4998, 99, 9, 9, 0.0)]
    s = spark.createDataFrame(rows, "season string, team_id string, pct double, run_diff long, rs long, ra long, tpi double")
    none = spark.createDataFrame([], "season string, team_id string, opp_id string, wins long, losses long, ties long")
    assert {r.team_id: r["rank"] for r in standings.rank_teams(s, none).collect()} == {"A": 2, "B": 1, "C": 3}


def test_courses_abreast_are_predicted_and_played_as_alone():
    """Rows of buffers give bit by bit what new arrays give, also from a started season on, with thin and unrated teams."""
    rng = np.random.default_rng(3)
    m = 5
    columns = {c: rng.normal(5, 1.5, m) for c in simulate.TEAM_COLUMNS} | {"games": [0.0, 1.0, 4.0, 9.0, 8.0], "w": [0.0, 1.0, 2.0, 4.0, 4.0], "t": [0.0, 0.0, 1.0, 0.0, 0.0], "total_k6": [None, 5.0, 6.0, None, 4.0]}
    t = pd.DataFrame({"team_id": list("ABCDE"), "met": [None, None, [{"opp_id": "D", "wins": 1, "losses": 2, "ties": 1}], [{"opp_id": "C", "wins": 2, "losses": 1, "ties": 1}], None], **columns})
    games = [tuple(map(int, rng.choice(m, 2, replace=False))) for _ in range(200)]
    draws = rng.random((200, 4))
    for settings in (Settings(), Settings(pitch_mode="player"), Settings(max_run_differential=0, model_aggression="Aggressive")):
        slow, fast, late = Season(t, settings, 4), Abreast(t, settings, 4), Season(t, settings, 4)
        for i, ((a, h), draw) in enumerate(zip(games, draws, strict=True)):
            *scores, p = slow.predict(a, h)
            slow.play(a, h, draw < p, (scores[0], scores[1]))
            fast.game(a, h, lambda p, draw=draw: draw < p)
            if i < 50:
                *scores, p = late.predict(a, h)
                late.play(a, h, draw < p, (scores[0], scores[1]))
            else:
                late = late if isinstance(late, Abreast) else Abreast(None, settings, 4, late)
                late.game(a, h, lambda p, draw=draw: draw < p)
        for c in ("games", "pct", "tpi", "run_diff", "rs", "ra"):
            assert all(np.array_equal(slow.state[c], np.broadcast_to(x.state[c], (m, 4))) for x in (fast, late)), c
        assert np.array_equal(slow.wins, fast.wins) and (slow.ranks() == fast.ranks()).all() and (slow.ranks() == late.ranks()).all()


def test_scenarios_of_chosen_games_only(spark):
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2)] + [(*"ABBCCA"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(9)])
    fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
    every = sorted(map(tuple, simulate.scenarios(fold, left).where("game_id IN ('g3', 'g7')").collect()))
    only = spark.createDataFrame([("s", "g3"), ("s", "g7"), ("s", "g7")], "season string, game_id string")
    assert len(every) == 2 * 2 * 3 and every == sorted(map(tuple, simulate.scenarios(fold, left, only=only).collect()))
    assert every == sorted(map(tuple, simulate.scenarios(fold, left, only=only, block_of=1).collect()))


def test_swings_make_scenarios_of_the_next_games_only(spark, tmp_path, monkeypatch):
    from pennant.plans.queries_race import Race

    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2)] + [(*"ABBCCA"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(12)])
    made, real = [], simulate.scenarios
    monkeypatch.setattr(simulate, "scenarios", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    monkeypatch.setattr("pennant.plans.queries_race.league.teams", lambda *_: t)
    assert Race(spark, str(tmp_path), g).swings.count() == 3 * 2
    assert sum(x.select("game_id").distinct().count() for x in made) == 3


def test_pairs_won_out_count_all_their_games(spark):
    """The next game of a pair is predicted as its first, so a count does what one game after the other did."""
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("A", "C", 5, 5)] + [(*"ABBCCAAC"[i % 4 * 2 : i % 4 * 2 + 2], None, None) for i in range(14)])
    fold, left = simulate.fold_teams(stats.team_stats(g, t), stats.head_to_head(g)), simulate.open_games(g)
    teams, games = fold.toPandas(), left.orderBy("ord").toPandas()
    s, live, course = Season(teams, Settings(), 3), Season(teams, Settings(), 1), np.arange(3)
    for a, h in s.pairs(games):
        *scores, p = live.predict(a, h)
        s.play(a, h, np.where(course == a, True, np.where(course == h, False, p >= 0.5)), (scores[0], scores[1]))
    assert {r.team_id: r.win_out_seed for r in simulate.win_out(fold, left).collect()} == dict(zip(s.ids, np.diagonal(s.ranks()).tolist(), strict=True))
    assert "times" in simulate.win_out(fold, left)._jdf.queryExecution().logical().toString()
    assert simulate.win_out(fold, left, limit=13).count() == 0 and simulate.win_out(fold, left, limit=14).count() == 3


def test_ranks_of_all_states_by_blocks(spark):
    """Blocks of any size give the ranks that each state has by itself; a team without a listed opponent or game counts too."""
    from pennant.operators import running, states

    rng = np.random.default_rng(1)
    g, t = season(spark, [(*map(str, rng.choice(list("ABCDEFZ"), 2, replace=False)), int(rng.integers(0, 4)), int(rng.integers(0, 4))) for _ in range(25)] + [("A", "Y", None, None)])
    t = t.where("team_id <> 'Z'")  # Z plays, but isn't listed; Y is listed, but hasn't played
    columns = ["season", "state", "team_id", "name", "rank", "gold_status", "rank_before", "status_before"]
    want = sorted(map(tuple, states.movements(g, t, Settings(gold_cutoff=3)).select(columns).collect()))
    assert len(want) == 25 * 7
    for block in (1024, 7):
        assert sorted(map(tuple, running.movements(g, t, Settings(gold_cutoff=3), block).select(columns).collect())) == want


def shuffled(spark, job):
    """Rows that job writes to shuffles."""
    context = spark.sparkContext._jsc.sc()
    jvm, none = spark.sparkContext._gateway.jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    job()
    return sum(n for i, n in stages().items() if i not in before)


def played(n, ids, seed):
    """n random finals."""
    rng = np.random.default_rng(seed)
    return [(*map(str, rng.choice(list(ids), 2, replace=False)), *map(int, rng.integers(0, 5, 2))) for _ in range(n)]


def test_backtest_by_blocks_is_that_of_each_state(spark):
    """Blocks of any size predict as the statistics of the finals before do; a team without a listed opponent or game counts too."""
    from pyspark.sql import functions as F

    from pennant.operators import asof, predict, states
    from pennant.settings import RUN_CAP

    g, t = season(spark, [*played(28, "ABCDEZ", 3), ("A", "Y", None, None)])
    g = g.withColumns({f"{s}_{c}": F.when(F.col("is_final"), F.col("ord") * k % 7) for s, k in (("away", 3), ("home", 5)) for c in ("k", "hits", "errors", "walks")})
    t = t.where("team_id <> 'Z'")  # Z plays, but isn't listed; Y is listed, but hasn't played
    keys = states.STATE
    finals, inside, rows = states.states(g, t)
    s = stats.team_stats(inside, rows, RUN_CAP, keys)
    for settings in (Settings(), Settings(pitch_mode="player")):
        p = predict.predictions(finals.withColumn("state", F.col("seq").cast("int")), s, stats.head_to_head(inside, keys), settings, keys)
        want = {r.game_id: r.away_pct for r in p.where("away_runs <> home_runs").collect()}
        assert len(want) > 20 and len(set(want.values())) > 8
        for block in (4096, 5, 1):
            got = {r.game_id: r.p for r in asof.backtest(g, t, settings, block).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_backtest_moves_no_row_for_each_opponent_met(spark):
    from pennant.operators import asof

    g, t = season(spark, played(30, "ABCDEFGHIJKLMNOPQRST", 4))
    assert shuffled(spark, asof.backtest(g, t).collect) < 30 * 2 * 10


def test_totals_after_one_result_by_pairs(spark):
    """Lines are made once a pair and predicted score; each game's rows are the totals as if it had been played, also against a team that isn't listed."""
    from pyspark.sql import functions as F

    from pennant.operators import predict, race

    left = [(*"ABBCABZA"[i % 4 * 2 : i % 4 * 2 + 2], None, None) for i in range(8)]
    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("C", "A", 1, 15), *left])
    t = t.where("team_id <> 'Z'")
    s = stats.team_stats(g, t)
    predicted = predict.predictions(stats.remaining(g).select("season", "away_id", "home_id").distinct(), s, stats.head_to_head(g))
    score = {(r.away_id, r.home_id): (r.away_score, r.home_score) for r in predicted.collect()}
    assert len(score) == 3
    states = race.one_result_states(g, s, predicted, value=lambda c: F.round(c, 3))
    rows = {(r.game_id, r.winner_id, r.team_id): r for r in states.collect()}
    assert len(rows) == states.count() == 8 * 2 * 3
    for i, (a, h, *_) in enumerate(left[:4], 3):
        for winner in (a, h):
            x, y = score[a, h]
            x, y = (max(x, y + 1), y) if winner == a else (x, max(y, x + 1))
            here = F.col("game_id") == f"g{i}"
            new = g.withColumns({"away_runs": F.when(here, x).otherwise(F.col("away_runs")), "home_runs": F.when(here, y).otherwise(F.col("home_runs")), "is_final": here | F.col("is_final")})
            for want in stats.rates(stats.team_totals(new, t)).collect():
                for game in (f"g{i}", f"g{i + 4}"):
                    got = rows[game, winner, want.team_id]
                    assert all(got[c] == want[c] for c in ("games", "w", "l", "t", "rs", "ra", "run_diff")) and got.pct == round(want.pct, 3)


def test_states_of_one_result_are_made_once_a_pair(spark):
    """Open games of the same teams have the same states; the badges are those of every game by itself."""
    from pyspark.sql import functions as F

    from pennant.operators import predict, race

    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("C", "A", 1, 5)] + [(*"ABBCAB"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(9)])
    s, h2h = stats.team_stats(g, t), stats.head_to_head(g)
    left, settings = stats.remaining_counts(g, s), Settings(gold_cutoff=1)
    predicted = predict.predictions(stats.remaining(g), s, h2h, settings)
    pairs = race.open_pairs(g, predicted)
    states = race.pair_status(pairs, s, h2h, left, settings)
    assert pairs.count() == 9 and states.count() == 2 * 2 * 3
    every = race.one_result_status(g, s, h2h, left, predicted, settings)
    assert every.count() == 9 * 2 * 3
    one = every.where("game_id = 'g5'").select("winner_id", "team_id", "rank", "title", "gold_status")
    alone = race.one_result_status(g.where("game_id = 'g5' OR is_final"), s, h2h, left, predicted, settings).select(one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, alone.collect()))
    board = standings.gold_status(standings.rank_teams(s, h2h, settings), left, settings)
    impacts = pairs.select("season", "game_id", F.lit(0).cast("long").alias("seed_impact"))
    badges = {r.game_id: r.status for r in race.game_badges(g, pairs, states, board, impacts, settings).collect()}
    assert len(badges) == 9 and set(badges.values()) <= {"Bubble Game", "Low Impact"}


def test_a_course_of_predicted_winners_is_bit_by_bit_the_same():
    rng = np.random.default_rng(5)
    m = 6
    columns = {c: rng.normal(5, 1.5, m) for c in simulate.TEAM_COLUMNS} | {"games": [0.0, 1.0, 4.0, 9.0, 8.0, 3.0], "w": [0.0, 1.0, 2.0, 4.0, 4.0, 1.0], "t": [0.0, 0.0, 1.0, 0.0, 0.0, 1.0], "total_k6": [None, 5.0, 6.0, None, 4.0, 5.5]}
    t = pd.DataFrame({"team_id": list("ABCDEF"), "met": [None, None, [{"opp_id": "D", "wins": 1, "losses": 2, "ties": 1}], [{"opp_id": "C", "wins": 2, "losses": 1, "ties": 1}], None, None], **columns})
    pairs = [tuple(map(int, rng.choice(m, 2, replace=False))) for _ in range(1500)] + [(-1, -1)]
    for settings in (Settings(), Settings(pitch_mode="player"), Settings(max_run_differential=0, model_aggression="Aggressive")):
        slow, fast = Season(t, settings, 1), Season(t, settings, 1)
        for a, h in pairs[:-1]:
            *scores, p = slow.predict(a, h)
            slow.play(a, h, p >= 0.5, (scores[0], scores[1]))
        fast.play_all(pairs)
        assert slow.state == fast.state and slow.wins == fast.wins and (slow.ranks() == fast.ranks()).all()
        assert (slow.played, slow.scored, slow.struck) == (fast.played, fast.scored, fast.struck)


def test_recaps_share_what_was_before_the_window(spark, tmp_path, monkeypatch):
    from pennant.plans import queries_race as q

    g, t = season(spark, [("A", "B", 9, 3), ("B", "C", 4, 2), ("C", "A", 1, 5)] + [(*"ABBCCA"[i % 3 * 2 : i % 3 * 2 + 2], None, None) for i in range(6)])
    made, real = [], simulate.project
    monkeypatch.setattr(q.league, "games", lambda *_: g)
    monkeypatch.setattr(q.league, "teams", lambda *_: t)
    monkeypatch.setattr(q.league, "sources", lambda *_: [str(tmp_path)])
    monkeypatch.setattr(q, "stats_of", lambda *_: stats.team_stats(g, t))
    monkeypatch.setattr(q, "h2h_of", lambda *_: stats.head_to_head(g))
    monkeypatch.setattr(simulate, "project", lambda *a, **b: made.append(1) or real(*a, **b))
    assert q._recap(spark, str(tmp_path)).count() > 0 and q._diff(spark, str(tmp_path)).count() == 3
    assert len(made) == 2
