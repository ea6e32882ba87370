"""Two snapshots of a season compared: differences, explanations, recap items and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import date_label, display_name, half_up, recap_weight, record_text
from pennant.operators.schedule import recap_window
from pennant.operators.stats import SEASON, Keys, is_final
from pennant.settings import Settings

#: Field, reason; in the order in which changes are listed.
FIELDS = [("rank", ""), ("gold_odds", "odds-change"), ("projected_points", "projection-change"), ("standings_points", "result-change")]
TIEBREAKS = ["run_diff", "rs", "ra"]
CONTEXT = [("settings", "settings-change"), ("matchup_count", "schedule-strength"), ("log_count", "result-change"), ("finalized_count", "result-change")]


# Sentences, labels and formats in which results are told.
SAID = {
    "recent_results": "Recent results",
    "tiebreak_movement": "Tiebreak movement",
    "standings_points_dipped_by": "Standings points dipped by ",
    "after_recent_results": " after recent results.",
    "standings_points_moved_up_by": "Standings points moved up by ",
    "projected_points_dipped_by": "Projected points dipped by ",
    "softening_the_gold_outlook": ", softening the Gold outlook.",
    "projected_points_nudged_up_by": "Projected points nudged up by ",
    "lifting_the_gold_outlook": ", lifting the Gold outlook.",
    "gold_odds_dipped_by": "Gold odds dipped by ",
    "after_the_projection_moved_down": " after the projection moved down.",
    "gold_odds_lifted_by": "Gold odds lifted by ",
    "after_the_projection_moved_up": " after the projection moved up.",
    "after_the_projected_finish_moved": " after the projected finish moved closer to the cutoff.",
    "pushed_the_projected_finish_down": " pushed the projected finish down by ",
    "as_the_projected_finish_moved": " as the projected finish moved up.",
    "lifted_the_projected_finish_by": " lifted the projected finish by ",
    "dropped_below_the_gold_cut": " dropped below the Gold cut line",
    "moved_above_the_gold_cut": " moved above the Gold cut line into Gold position",
    "is_now_eliminated_from_gold": " is now eliminated from Gold Bracket contention",
    "clinched_the_gold_bracket": " clinched the Gold Bracket",
    "moved_up": " moved up",
    "finalized_results_changed_standings_order": "Finalized results changed standings order for multiple teams.",
    "cut_line_pressure_can_move": "Cut-line pressure can move teams through opponent and competitor results, not just their own games.",
    "the_teams_nearest_the_cut": "The teams nearest the cut line create the clearest league-wide stakes.",
    "gold_odds_show_how_current": "Gold odds show how current standings and remaining dependencies are pulling on the bubble.",
    "team_status_changed_to_clinched": "Team status changed to Clinched.",
    "remaining_results_now_affect_only": "Remaining results now affect only seeding.",
    "team_status_changed_to_eliminated": "Team status changed to Eliminated.",
    "gold_path_is_no_longer": "Gold path is no longer mathematically available.",
    "seed_moved_from_inside_to": "Seed moved from inside to outside the cutoff.",
    "cut_line_movement_can_swing": "Cut-line movement can swing weekly priorities.",
    "seed_moved_from_outside_to": "Seed moved from outside to inside the cutoff.",
    "team_now_controls_its_path": "Team now controls its path more directly.",
    "final_scores_across_the_board": "final scores across the board scrambled the order.",
    "simulation_odds_moved_by_at": "Simulation odds moved by at least 5 percentage points.",
    "this_reflects_both_own_result": "This reflects both own result and competitor outcomes.",
    "largest_positive_seed_movement_in": "Largest positive seed movement in this update window.",
    "largest_negative_seed_movement_in": "Largest negative seed movement in this update window.",
    "dependency_chain_those_finals_tugged": "Dependency chain: those finals tugged the standings for ",
    "bubble_watch": "Bubble watch: ",
    "with": "%), with ",
    "clinched_a_gold_bracket_spot": " clinched a Gold Bracket spot.",
    "were_knocked_out_of_gold": " were knocked out of Gold Bracket contention.",
    "moved_above_the_gold_cut_2": " moved above the Gold cut line",
    "they_got_clipped_by": "they got clipped by ",
    "gold_odds": " Gold odds ",
    "biggest_mover": "Biggest mover: ",
    "biggest_faller": "Biggest faller: ",
    "finals_dropped": " finals dropped: ",
    "climbed_to": " climbed to #",
    "they_took_care_of_business": "they took care of business vs ",
    "1_game_finalized": "1 game finalized: ",
    "in_an_upset": " in an upset",
    "slipped_to": " slipped to #",
    "climbed": "climbed +",
    "in_an_upset_special": " in an upset special",
    "story_beats": "Story beats:",
    "win": " (win → #",
    "loss": ", loss → #",
    "are_in_survival_mode_now": " are in survival mode (now #",
    "projected": ", projected #",
    "gold_they_need_wins_plus": "% Gold): they need wins plus help from around the league.",
    "now_and_project_to": " now and project to #",
    "still_outside_the_line_but": " — still outside the line, but ",
    "means_they_re_alive_and": "% means they're alive and dangerous.",
    "are_sitting_at": " are sitting at #",
    "today_but_are_projected_to": " today but are projected to rise to #",
    "gold_the_door_is_cracked": "% Gold). The door is cracked open if these next two tilt their way: ",
    "must_watch_swings": " Must-watch swings: ",
    "currently_own": " currently own #",
    "but_the_model_sees_a": ", but the model sees a slide to #",
    "as_the_stretch_run_unfolds": " as the stretch run unfolds (",
    "gold": "% Gold). ",
    "currently_set_the_pace_up": " currently set the pace up top.",
    "swing_games_to_circle": " Swing games to circle: ",
    "every_remaining_loss_is_gasoline": "Every remaining loss is gasoline on the fire.",
    "are_holding_firm_at": " are holding firm at #",
    "with_a_projection_of": " with a projection of #",
    "gold_odds_safely_above_the": "% Gold odds — safely above the line for now. Next two pressure points: ",
    "are_mathematically_eliminated_from_the": " are mathematically eliminated from the Gold race, but they still get to play spoiler and reshape everyone else's path.",
    "they_need_to_defend_that": "They need to defend that cushion immediately: ",
    "have_clinched_a_gold_bracket": " have clinched a Gold Bracket ticket at #",
    "now_it_s_all_about": "; now it's all about sharpening their blade for seeding battles.",
    "regular_season": "Regular Season",
}


def snapshot(board: DataFrame, games: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """CH1: keys, team_id, rank, odds, points, tiebreak values, and the season's settings and counts."""
    c = games.groupBy(*keys).agg(F.count("*").alias("matchup_count"), F.count("*").alias("log_count"), F.count_if(is_final()).alias("finalized_count"))
    p = F.coalesce("projected_w", "w") * float(settings.win_points) + F.coalesce("projected_t", "t") * float(settings.tie_points)
    told = repr(settings)
    return board.join(c, list(keys)).select(*keys, "team_id", F.coalesce("projected_rank", "rank").alias("rank"), F.col("gold_pct").alias("gold_odds"), p.alias("projected_points"), F.col("points").alias("standings_points"), F.coalesce("projected_run_diff", "run_diff").alias("run_diff"), "rs", "ra", F.lit(told).alias("settings"), "matchup_count", "log_count", "finalized_count")


def diff(before: DataFrame, after: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """CH2, CH3, J7, F35: keys, team_id, status, changes (field, reason, before, after, delta), reasons.

    The season's own changes (settings, counts) are told on every team that is in both.
    """
    b = before.select(*keys, "team_id", F.struct(*[c for c in before.columns if c not in (*keys, "team_id")]).alias("b"))
    a = after.select(*keys, "team_id", F.struct(*[c for c in after.columns if c not in (*keys, "team_id")]).alias("a"))
    j = b.join(a, [*keys, "team_id"], "full_outer")
    tied = F.lit(False)
    for c in TIEBREAKS:
        tied = tied | ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    entry = lambda field, reason, x, y, d: F.struct(F.lit(field).alias("field"), reason.alias("reason"), x.cast("string").alias("before"), y.cast("string").alias("after"), d.cast("double").alias("delta"))
    none = F.lit(None)
    parts = []
    for f, reason in FIELDS:
        x, y = F.col(f"b.{f}"), F.col(f"a.{f}")
        why = F.lit(reason) if reason else F.when(tied, "tiebreak-change").otherwise("projection-change")
        parts.append(F.when(~x.eqNullSafe(y), entry(f, why, x, y, y - x)))
    parts.append(F.when(tied, entry("tiebreakers", F.lit("tiebreak-change"), none, none, none)))
    parts += [F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), entry(f, F.lit(r), none, none, none)) for f, r in CONTEXT]
    team = F.col("team_id")
    changes = (
        F.when(F.col("b").isNull(), F.array(entry("team", F.lit("projection-change"), none, team, none)))
        .when(F.col("a").isNull(), F.array(entry("team", F.lit("projection-change"), team, none, none))).otherwise(F.array_compact(F.array(*parts)))
    )
    j = j.withColumn("changes", changes)
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    return j.select(*keys, "team_id", status.alias("status"), "changes", F.array_distinct(F.transform("changes", lambda c: c["reason"])).alias("reasons"))


def diff_reasons(diffs: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """CH3: keys, reasons: what the teams' differences have as reasons, in the order of the ids."""
    rows = F.sort_array(F.collect_list(F.struct("team_id", "reasons")))
    return diffs.groupBy(*keys).agg(F.array_join(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["reasons"]))), ",").alias("reasons"))


def explanations(diffs: DataFrame, most: int = 3, odds: float = 3.0, rank: float = 1.0, points: float = 0.5, keys: Keys = SEASON) -> DataFrame:
    """CH4, O10: keys, team_id, nth, text: the weightiest changes of each team in words."""
    # Field, threshold, base, weight.
    rules = {"rank": (rank, 12, 24), "gold_odds": (odds, 10, 22), "projected_points": (points, 8, 18), "standings_points": (points, 7, 18)}
    e = diffs.where("status <> 'unchanged'").select(*keys, "team_id", F.posexplode("changes").alias("i", "c")).select(*keys, "team_id", "i", "c.*")
    size = F.abs("delta")
    enough, impact = F.lit(False), F.lit(0.0)
    for f, (least, base, weight) in rules.items():
        enough = enough | ((F.col("field") == f) & (size >= least))
        impact = F.when(F.col("field") == f, size / least * weight + base).otherwise(impact)
    e = e.where(F.coalesce(enough & (F.col("delta") != 0), F.lit(False))).withColumn("impact", impact)
    closer = F.max(F.when((F.col("field") == "rank") & (F.col("delta") > 0), 1).otherwise(0)).over(Window.partitionBy(*keys, "team_id")) == 1
    up = F.col("delta") > 0
    count = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(F.regexp_replace(F.format_string("%.1f", size), r"\.0$", ""))
    spots = F.concat(count, F.when(size == 1, " spot").otherwise(" spots"))
    whole = half_up(size)
    pts = F.concat(whole.cast("string"), F.when(whole == 1, " point").otherwise(" points"))
    cause = F.when(F.col("reason") == "tiebreak-change", SAID["tiebreak_movement"]).otherwise(SAID["recent_results"])
    text = (
        F.when((F.col("field") == "rank") & ~up, F.concat(cause, F.lit(SAID["lifted_the_projected_finish_by"]), spots, F.lit(".")))
        .when(F.col("field") == "rank", F.concat(cause, F.lit(SAID["pushed_the_projected_finish_down"]), spots, F.lit(".")))
        .when((F.col("field") == "gold_odds") & up, F.concat(F.lit(SAID["gold_odds_lifted_by"]), pts, F.when(closer, SAID["as_the_projected_finish_moved"]).otherwise(SAID["after_the_projection_moved_up"])))
        .when(F.col("field") == "gold_odds", F.concat(F.lit(SAID["gold_odds_dipped_by"]), pts, F.when(closer, SAID["after_the_projected_finish_moved"]).otherwise(SAID["after_the_projection_moved_down"])))
        .when((F.col("field") == "projected_points") & up, F.concat(F.lit(SAID["projected_points_nudged_up_by"]), count, F.lit(SAID["lifting_the_gold_outlook"])))
        .when(F.col("field") == "projected_points", F.concat(F.lit(SAID["projected_points_dipped_by"]), count, F.lit(SAID["softening_the_gold_outlook"])))
        .when(up, F.concat(F.lit(SAID["standings_points_moved_up_by"]), count, F.lit(SAID["after_recent_results"]))).otherwise(F.concat(F.lit(SAID["standings_points_dipped_by"]), count, F.lit(SAID["after_recent_results"])))
    )
    order = Window.partitionBy(*keys, "team_id").orderBy(F.col("impact").desc(), "i")
    return e.withColumns({"text": text, "nth": F.row_number().over(order).cast("long")}).where(F.col("nth") <= most).select(*keys, "team_id", "nth", "text", "impact")


def before_window(games: DataFrame, grouping: str = "date", keys: Keys = SEASON) -> tuple[DataFrame, DataFrame]:
    """CH7: (games with the finals of the latest recap window open again, those finals)."""
    g = recap_window(games, grouping)
    latest = g.where(is_final()).groupBy(*keys).agg(F.max_by("window", F.struct("game_date", "ord")).alias("_latest"))
    g = g.join(latest, list(keys), "left")
    inside = is_final() & F.coalesce(F.col("window") == F.col("_latest"), F.lit(False))
    stats = [c for c in games.columns if c.startswith(("away_", "home_")) and not c.endswith("_id")]
    before = g.withColumns({c: F.when(~inside, F.col(c)) for c in stats}).withColumn("is_final", is_final() & ~inside).drop("window", "_latest")
    return before, g.where(inside).drop("_latest")


def rank_moves(before: DataFrame, after: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """Teams of both snapshots with rank and status before and now, and delta (positive: climbed)."""
    b = before.select(*keys, "team_id", F.col("rank").alias("rank_before"), F.col("gold_status").alias("status_before"), F.col("gold_pct").alias("pct_before"))
    a = after.select(*keys, "team_id", "name", "rank", "gold_status", "gold_pct")
    return a.join(b, [*keys, "team_id"]).withColumn("delta", F.col("rank_before") - F.col("rank"))


def change_messages(moves: DataFrame, settings: Settings = Settings(), most: int = 10, keys: Keys = SEASON) -> DataFrame:
    """CH6, U5: keys, nth, text: what changed, team by team in the order of the ranks, without repetitions."""
    cut = settings.gold_cutoff
    shown = display_name(F.col("name"))
    r, b = F.col("rank"), F.col("rank_before")
    new = F.col("gold_status") != F.col("status_before")
    each = F.array_compact(F.array(
        F.when(r != b, F.concat(shown, F.when(r < b, SAID["moved_up"]).otherwise(" dropped"), F.lit(" from #"), b.cast("string"), F.lit(" to #"), r.cast("string"))),
        F.when((b <= cut) & (r > cut), F.concat(shown, F.lit(SAID["dropped_below_the_gold_cut"]))),
        F.when((b > cut) & (r <= cut), F.concat(shown, F.lit(SAID["moved_above_the_gold_cut"]))),
        F.when(new & (F.col("gold_status") == "Eliminated"), F.concat(shown, F.lit(SAID["is_now_eliminated_from_gold"]))),
        F.when(new & (F.col("gold_status") == "Clinched"), F.concat(shown, F.lit(SAID["clinched_the_gold_bracket"]))),
    ))
    m = moves.select(*keys, "rank", F.posexplode(each).alias("i", "text")).groupBy(*keys, "text").agg(F.min(F.struct("rank", "i")).alias("o"))
    w = Window.partitionBy(*keys).orderBy("o")
    return m.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= most).select(*keys, "nth", "text")


def _top(df: DataFrame, by: Column, n: int, keys: Keys) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by, "rank"))).where(F.col("_n") <= n)


def weekly_recap(moves: DataFrame, window_finals: DataFrame, names: DataFrame, settings: Settings = Settings(), most: int = 16, keys: Keys = SEASON) -> DataFrame:
    """CH5, O5, O6: keys, nth, kind, text, why, impact: the items of a recap, weightiest first.

    moves: rank_moves() of both snapshots. window_finals: the finals since the first. Every kind is a
    selection of its own; of items with equal texts one stays.
    """
    k, cut = list(keys), settings.gold_cutoff
    shown = display_name(F.col("name"))
    txt = lambda *p: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    why = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    item = lambda df, kind, pass_, at, text, *w: df.select(*k, F.lit(pass_).alias("pass"), at.cast("long").alias("at"), F.lit(kind).alias("kind"), text.alias("text"), why(*w).alias("why"))

    n = names.select(*k, "team_id", display_name(F.col("name")).alias("shown"))
    f = window_finals
    for s in ("away", "home"):
        f = f.join(n.select(*k, F.col("team_id").alias(f"{s}_id"), F.col("shown").alias(f"{s}_name")), [*k, f"{s}_id"], "left").withColumn(f"{s}_name", F.coalesce(f"{s}_name", f"{s}_id"))
    f = f.join(moves.select(*k, F.col("team_id").alias("away_id"), F.col("rank_before").alias("a_before"), F.col("rank").alias("a_now")), [*k, "away_id"], "left")
    f = f.join(moves.select(*k, F.col("team_id").alias("home_id"), F.col("rank_before").alias("h_before"), F.col("rank").alias("h_now")), [*k, "home_id"], "left")
    line = F.struct("ord", txt(F.col("away_name"), " ", F.col("away_runs"), ", ", F.col("home_name"), " ", F.col("home_runs")).alias("one"), txt(F.col("away_name"), " ", F.col("away_runs"), "–", F.col("home_name"), " ", F.col("home_runs")).alias("many"))
    told = f.groupBy(*k).agg(F.count("*").alias("c"), F.sort_array(F.collect_list(line)).alias("l"))
    summary = item(told, "summary", 0, F.lit(0), F.when(F.col("c") == 1, txt(SAID["1_game_finalized"], F.col("l")[0]["one"], ".")).otherwise(txt(F.col("c"), SAID["finals_dropped"], F.array_join(F.transform("l", lambda x: x["many"]), "; "), ".")))

    changed = moves.where("delta <> 0")
    moved = changed.groupBy(*k).agg(F.array_join(F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", shown.alias("s")))), lambda x: x["s"])), 1, 6), ", ").alias("list")).join(told.select(*k), k, "left_semi")
    chain = item(moved, "dependency-chain", 1, F.lit(0), txt(SAID["dependency_chain_those_finals_tugged"], F.col("list"), "."), SAID["finalized_results_changed_standings_order"], SAID["cut_line_pressure_can_move"])

    at = lambda r, c: F.max(F.when(F.col("rank") == r, c))
    line_teams = moves.groupBy(*k).agg(at(cut, shown).alias("i"), at(cut, half_up(F.col("gold_pct"))).alias("ip"), at(cut + 1, shown).alias("o"), at(cut + 1, half_up(F.col("gold_pct"))).alias("op")).where("i IS NOT NULL AND o IS NOT NULL")
    bubble = item(line_teams, "bubble-watch", 2, F.lit(0), txt(SAID["bubble_watch"], F.col("i"), f" hold the final Gold slot at #{cut} (", F.col("ip"), SAID["with"], F.col("o"), f" first out at #{cut + 1} (", F.col("op"), "%)."), SAID["the_teams_nearest_the_cut"], SAID["gold_odds_show_how_current"])

    became = lambda s: moves.where((F.col("gold_status") == s) & (F.col("status_before") != s))
    clinched = item(became("Clinched"), "clinched", 3, F.col("rank"), txt(shown, SAID["clinched_a_gold_bracket_spot"]), SAID["team_status_changed_to_clinched"], SAID["remaining_results_now_affect_only"])
    out = item(became("Eliminated"), "eliminated", 3, F.col("rank"), txt(shown, SAID["were_knocked_out_of_gold"]), SAID["team_status_changed_to_eliminated"], SAID["gold_path_is_no_longer"])
    path = (" (#", F.col("rank_before"), " → #", F.col("rank"), ").")
    down = item(moves.where((F.col("rank_before") <= cut) & (F.col("rank") > cut)), "crossed-cut-down", 3, F.col("rank"), txt(shown, SAID["dropped_below_the_gold_cut"], *path), SAID["seed_moved_from_inside_to"], SAID["cut_line_movement_can_swing"])
    up = item(moves.where((F.col("rank_before") > cut) & (F.col("rank") <= cut)), "crossed-cut-up", 3, F.col("rank"), txt(shown, SAID["moved_above_the_gold_cut_2"], *path), SAID["seed_moved_from_outside_to"], SAID["team_now_controls_its_path"])

    # a team's own result, and how its opponent moved: of several finals the last result and the first opponent count
    away_won = F.col("away_runs") > F.col("home_runs")
    upset = F.when(away_won, F.coalesce("a_before", F.lit(999)) > F.coalesce("h_before", F.lit(999))).otherwise(F.coalesce("h_before", F.lit(999)) > F.coalesce("a_before", F.lit(999)))
    side = lambda me, other, won, now: F.struct(F.col(f"{me}_id").alias("team_id"), F.col(f"{other}_name").alias("opp"), won.alias("won"), F.col(now).alias("opp_rank"))
    own = f.where("away_runs <> home_runs").withColumn("upset", upset).select(*k, "ord", "upset", F.explode(F.array(side("away", "home", away_won, "h_now"), side("home", "away", ~away_won, "a_now"))).alias("x")).select(*k, "ord", "upset", "x.*")
    own = own.groupBy(*k, "team_id").agg(F.max_by(F.struct("opp", "won", "upset"), "ord").alias("own"), F.min_by(F.struct("opp", "won", "opp_rank"), F.when(F.col("opp_rank") > 0, F.col("ord"))).alias("rival"))
    r = _top(changed, F.abs("delta").desc(), 4, k).join(own, [*k, "team_id"], "left")
    did = F.when(F.col("own.won"), txt(SAID["they_took_care_of_business"], F.col("own.opp"), F.when(F.col("own.upset"), SAID["in_an_upset_special"]).otherwise(""))).when(F.col("own").isNotNull(), txt(SAID["they_got_clipped_by"], F.col("own.opp"), F.when(F.col("own.upset"), SAID["in_an_upset"]).otherwise("")))
    other = F.when(F.col("rival").isNotNull() & (F.col("rival.opp") != shown), txt(F.col("rival.opp"), F.when(F.col("rival.won"), SAID["slipped_to"]).otherwise(SAID["climbed_to"]), F.col("rival.opp_rank")))
    reasons = F.array_compact(F.array(did, other))
    reason = F.when(F.size(reasons) > 0, txt(F.array_join(reasons, "; "), ".")).otherwise(SAID["final_scores_across_the_board"])
    ranks = item(r, "rank-change", 4, F.col("_n"), txt(shown, F.when(F.col("delta") > 0, " climbed").otherwise(" slipped"), " from #", F.col("rank_before"), " to #", F.col("rank"), ". ", reason))

    shift = moves.withColumn("d", half_up(F.col("gold_pct") - F.col("pct_before"))).where("abs(d) >= 5")
    shift = _top(shift, F.abs("d").desc(), 4, k)
    odds = item(shift, "gold-shift", 5, F.col("_n"), txt(shown, SAID["gold_odds"], F.when(F.col("d") > 0, SAID["climbed"]).otherwise("dropped "), F.col("d"), "% (now ", half_up(F.col("gold_pct")), "%)."), SAID["simulation_odds_moved_by_at"], SAID["this_reflects_both_own_result"])
    most_up = _top(changed.where("delta >= 3"), F.col("delta").desc(), 1, k)
    most_down = _top(changed.where("delta <= -3"), F.col("delta").asc(), 1, k)
    mover = item(most_up, "biggest-mover", 6, F.lit(0), txt(SAID["biggest_mover"], shown, " (+", F.col("delta"), " seeds)."), SAID["largest_positive_seed_movement_in"])
    faller = item(most_down, "biggest-faller", 6, F.lit(1), txt(SAID["biggest_faller"], shown, " (", F.col("delta"), " seeds)."), SAID["largest_negative_seed_movement_in"])

    every = summary
    for part in (chain, bubble, clinched, out, down, up, ranks, odds, mover, faller):
        every = every.unionByName(part)
    every = every.groupBy(*k, "text").agg(F.max_by(F.struct("kind", "why"), F.struct("pass", "at")).alias("x"), F.min(F.struct("pass", "at")).alias("o")).select(*k, "text", "x.*", "o")
    every = every.withColumn("impact", recap_weight(F.col("kind"), F.col("text")).cast("long"))
    w = Window.partitionBy(*k).orderBy(F.col("impact").desc(), "o", "text")
    return every.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= most).select(*k, "nth", "kind", "text", "why", "impact")


def recap_markdown(items: DataFrame, settings: Settings, day: Column, keys: Keys = SEASON) -> DataFrame:
    """F41, SNK7: keys, text: the recap as Markdown."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return items.groupBy(*keys).agg(F.concat(F.lit(f"# {settings.season_label} Recap — "), date_label(day), F.lit("\n\n"), lines).alias("text"))


def story_brief(items: DataFrame, settings: Settings, day: Column, keys: Keys = SEASON) -> DataFrame:
    """keys, text: the five weightiest items as a headline and story beats, with what is behind them."""
    context = F.when(F.size("why") > 0, F.concat(F.lit(" Context: "), F.array_join(F.slice("why", 1, 2), " "))).otherwise("")
    top = items.where("nth <= 5").withColumn("line", F.concat("text", context))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"])
    g = top.groupBy(*keys).agg(lines.alias("l"))
    beats = F.when(F.size("l") > 1, F.concat(F.array(F.lit(SAID["story_beats"])), F.transform(F.slice("l", 2, 4), lambda x: F.concat(F.lit("- "), x)))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.lit(f"{settings.season_label} League Story — "), date_label(day))
    return g.select(*keys, F.array_join(F.concat(F.array(head, F.concat(F.lit("Headline: "), F.col("l")[0])), beats), "\n").alias("text"))


def standings_text(board: DataFrame, settings: Settings, day: Column, keys: Keys = SEASON) -> DataFrame:
    """keys, text: the standings as lines, teams inside the cut marked."""
    mark = F.when(F.col("rank") <= settings.gold_cutoff, "★").otherwise(" ")
    line = F.concat(mark, F.lit(" #"), F.col("rank").cast("string"), F.lit(" "), display_name(F.col("name")), F.lit(" — "), record_text(F.col("w"), F.col("l"), F.col("t")), F.lit(" ("), half_up(F.col("gold_pct")).cast("string"), F.lit("% Gold)"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.concat(F.lit(f"{settings.season_label} Standings — "), date_label(day), F.lit(f"\nTop {settings.gold_cutoff} make the Gold Bracket.\n\n"))
    return board.groupBy(*keys).agg(F.concat(head, rows).alias("text"))


def path_summary(board: DataFrame, swings: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """keys, team_id, text: a team's way in one paragraph."""
    cut = settings.gold_cutoff
    n = board.select(*keys, F.col("team_id").alias("opp_id"), display_name(F.col("name")).alias("opp"))
    one = F.concat(F.when(F.col("side") == "away", "at ").otherwise("vs "), F.coalesce("opp", "opp_id"), F.lit(SAID["win"]), F.col("win_seed").cast("string"), F.lit(SAID["loss"]), F.col("loss_seed").cast("string"), F.lit(")"))
    s = swings.where("nth <= 2").join(n, [*keys, "opp_id"], "left").withColumn("one", one).groupBy(*keys, "team_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "one"))), lambda x: x["one"]), " and ").alias("line"))
    leader = F.first(display_name(F.col("name"))).over(Window.partitionBy(*keys).orderBy("rank"))
    b = board.withColumn("leader", leader).join(s, [*keys, "team_id"], "left").withColumn("line", F.coalesce("line", F.lit("")))
    shown, pct = display_name(F.col("name")), half_up(F.col("gold_pct")).cast("string")
    rank, proj, line = F.col("rank").cast("string"), F.col("projected_rank").cast("string"), F.col("line")
    c = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    has, inside, planned = F.col("line") != "", F.col("rank") <= cut, F.col("projected_rank") <= cut
    text = (
        F.when(F.col("gold_status") == "Clinched", c(shown, SAID["have_clinched_a_gold_bracket"], rank, SAID["now_it_s_all_about"]))
        .when(F.col("gold_status") == "Eliminated", c(shown, SAID["are_mathematically_eliminated_from_the"]))
        .when(inside & planned, c(shown, SAID["are_holding_firm_at"], rank, SAID["with_a_projection_of"], proj, " and ", pct, SAID["gold_odds_safely_above_the"], line, "."))
        .when(inside, c(shown, SAID["currently_own"], rank, SAID["but_the_model_sees_a"], proj, SAID["as_the_stretch_run_unfolds"], pct, SAID["gold"], F.when(has, c(SAID["they_need_to_defend_that"], line, ".")).otherwise(SAID["every_remaining_loss_is_gasoline"])))
        .when(planned, c(shown, SAID["are_sitting_at"], rank, SAID["today_but_are_projected_to"], proj, " (", pct, SAID["gold_the_door_is_cracked"], line, "."))
        .when(half_up(F.col("gold_pct")) >= 15, c(shown, " are #", rank, SAID["now_and_project_to"], proj, SAID["still_outside_the_line_but"], pct, SAID["means_they_re_alive_and"], F.when(F.col("leader") != "", c(" ", F.col("leader"), SAID["currently_set_the_pace_up"])).otherwise(""), F.when(has, c(SAID["swing_games_to_circle"], line, ".")).otherwise("")))
        .otherwise(c(shown, SAID["are_in_survival_mode_now"], rank, SAID["projected"], proj, ", ", pct, SAID["gold_they_need_wins_plus"], F.when(has, c(SAID["must_watch_swings"], line, ".")).otherwise("")))
    )
    return b.select(*keys, "team_id", text.alias("text"))


def forecasts(games: DataFrame, predicted: DataFrame, brackets: DataFrame | None = None, keys: Keys = SEASON) -> DataFrame:
    """Forecasts of open games by date, those of bracket games behind them."""
    g = predicted.select(*keys, "game_id", "game_date", "winner_id", F.when(F.col("winner_id") == F.col("away_id"), F.col("away_pct")).otherwise(F.lit(1.0) - F.col("away_pct")).alias("winner_pct"), F.lit(SAID["regular_season"]).alias("source"))
    if brackets is not None:
        b = brackets.where("away_pct IS NOT NULL AND winner_source <> 'actual'")
        win = F.when(F.col("away_pct") >= 0.5, F.col("bottom_id")).otherwise(F.col("top_id"))
        g = g.unionByName(b.select(*keys, "game_id", F.lit(None).cast("date").alias("game_date"), win.alias("winner_id"), F.greatest("away_pct", F.lit(1.0) - F.col("away_pct")).alias("winner_pct"), F.concat_ws(" · ", "label", "round_name").alias("source")))
    w = Window.partitionBy(*keys).orderBy(F.col("game_date").asc_nulls_last(), "game_id")
    return g.withColumn("place", F.row_number().over(w).cast("long"))

