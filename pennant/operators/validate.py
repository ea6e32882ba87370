"""Coercion of untrusted tables and reconciliation of an import with what is there."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import clamp, normal_date, number
from pennant.operators.stats import SEASON, Keys, is_final
from pennant.settings import RUN_CAP, STAT_CAP, Settings

TEXT_STATS = ["hits", "k", "errors", "walks"]
# How issues of an import are named.
ISSUES = {"missing-team": "missing Away/Home team", "unknown-team": "team name mismatch", "duplicate-id": "duplicate Game ID"}


def team_ids(names: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """an id for each name: its first four letters or digits, numbered where that is taken. The order counts."""
    used, out = set(taken), []
    for name in names:
        base = re.sub("[^A-Z0-9]", "", name.upper())[:4] or "TEAM"
        new, n = base, 1
        while new in used:
            new, n = f"{base[:3]}{n}", n + 1
        used.add(new)
        out.append(new)
    return out


def with_team_ids(names: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """names (keys, name, ord) with team_id: the same as team_ids(), folded in the order of ord within each season's list."""

    def add(state: Column, x: Column) -> Column:
        base = F.substring(F.regexp_replace(F.upper(x["name"]), "[^A-Z0-9]", ""), 1, 4)
        base = F.when(base == "", "TEAM").otherwise(base)
        used = F.transform(state, lambda s: s["team_id"])
        # of one more candidate than there are ids one at least is free
        numbered = F.transform(F.sequence(F.lit(1), F.size(state) + 1), lambda n: F.concat(F.substring(base, 1, 3), n.cast("string")))
        free = F.filter(F.concat(F.array(base), numbered), lambda c: ~F.array_contains(used, c))[0]
        return F.concat(state, F.array(F.struct(free.alias("team_id"), x["name"].alias("name"), x["ord"].alias("ord"))))

    none = F.array().cast("array<struct<team_id:string,name:string,ord:bigint>>")
    listed = names.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "name"))).alias("n"))
    return listed.select(*keys, F.explode(F.aggregate("n", none, add)).alias("t")).select(*keys, "t.team_id", "t.name", "t.ord")


def is_text(c: str) -> Column:
    """VAL1: text that says something."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def first_of(df: DataFrame, by: list[str]) -> DataFrame:
    """The first row of each key by ord."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where("_r = 1").drop("_r")


def coerce_teams(raw: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """VAL2: trimmed ids and names (120 characters), without blanks; the first of equal ids stays."""
    t = raw.withColumns({"team_id": F.trim("team_id"), "name": F.substring(F.trim("name"), 1, 120)})
    return first_of(t.where(is_text("team_id") & is_text("name")), [*keys, "team_id"])


def coerce_matchups(raw: DataFrame, teams: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """VAL3: games between two different known teams (any, in a season without teams); the first of equal ids stays."""
    g = raw.withColumns({c: F.trim(c) for c in ("game_id", "away_id", "home_id")} | {"date_text": normal_date(F.col("date_text"))})
    g = g.where(is_text("game_id") & is_text("away_id") & is_text("home_id") & (F.col("away_id") != F.col("home_id")))
    has_teams = teams.select(*keys).distinct().withColumn("_has", F.lit(True))
    g = g.join(has_teams, list(keys), "left")
    for side in ("away", "home"):
        known = teams.select(*keys, F.col("team_id").alias(f"{side}_id"), F.lit(True).alias(f"_{side}")).distinct()
        g = g.join(known, [*keys, f"{side}_id"], "left")
    g = g.where("_has IS NULL OR (_away AND _home)").drop("_has", "_away", "_home")
    return first_of(g, [*keys, "game_id"])


def clamp_text(v: Column, most: int) -> Column:
    """VAL5: a whole number as text, within 0 and most; '' for blanks and what is no number."""
    x = number(v, float("nan"))
    blank = F.coalesce(F.trim(v) == "", F.lit(True)) | F.isnan(x)
    return F.when(blank, "").otherwise(clamp(F.floor(x + 0.5), 0, most).cast("long").cast("string"))


def clamp_innings(v: Column) -> Column:
    """VAL6: innings within 1 and 10 as text; 1 for blanks, 6 for what is no number."""
    return clamp(F.floor(number(F.coalesce(v, F.lit("6")), 6.0) + 0.5), 1, 10).cast("long").cast("string")


def coerce_logs(raw: DataFrame, matchups: DataFrame, settings: Settings = Settings(), keys: Keys = SEASON) -> DataFrame:
    """VAL4: logs of known games (any, in a season without games), clamped; final only with what its mode requires."""
    has = matchups.select(*keys).distinct().withColumn("_has", F.lit(True))
    known = matchups.select(*keys, "game_id", F.lit(True).alias("_known")).distinct()
    g = raw.join(has, list(keys), "left").join(known, [*keys, "game_id"], "left").where("_has IS NULL OR _known").drop("_has", "_known")
    sides = ("away", "home")
    g = g.withColumns({f"{s}_runs": clamp_text(F.col(f"{s}_runs"), RUN_CAP) for s in sides} | {f"{s}_{x}": clamp_text(F.col(f"{s}_{x}"), STAT_CAP) for s in sides for x in TEXT_STATS if f"{s}_{x}" in raw.columns} | {"innings": clamp_innings(F.col("innings"))})
    full = lambda x: (F.col(f"away_{x}") != "") & (F.col(f"home_{x}") != "")
    return g.withColumn("is_final", is_final() & full("runs") & (full("runs") if settings.pitch_mode == "player" else full("k")))


def typed_games(matchups: DataFrame, logs: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """J1 over text logs: games with whole numbers, blank statistics of finals 0."""
    g = matchups.join(logs, [*keys, "game_id"], "left").withColumn("is_final", is_final())
    cols = [f"{s}_{x}" for s in ("away", "home") for x in ("runs", *TEXT_STATS)]
    stat = lambda c: F.when(F.col("is_final"), number(F.coalesce(F.col(c), F.lit(""))).cast("long")) if c in g.columns else F.when(F.col("is_final"), F.lit(0)).cast("long")
    inns = F.coalesce(F.nullif(number(F.coalesce("innings", F.lit("6")), 6.0), F.lit(0.0)), F.lit(6.0)).cast("long")
    return g.withColumns({c: stat(c) for c in cols} | {"innings": inns})


_SAME = ["away_runs", "home_runs", "away_hits", "home_hits", "away_k", "home_k", "innings"]


def duplicates(incoming: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """REC2: incoming games with duplicate and reversed: an earlier game has their date and teams, or has them the other way round."""
    w = Window.partitionBy(*keys, "date_text", "away_id", "home_id").orderBy("ord")
    first = incoming.groupBy(*keys, "date_text", F.col("home_id").alias("away_id"), F.col("away_id").alias("home_id")).agg(F.min("ord").alias("_first"))
    out = incoming.withColumn("duplicate", F.row_number().over(w) > 1).join(first, [*keys, "date_text", "away_id", "home_id"], "left")
    return out.withColumn("reversed", F.coalesce(F.col("_first") < F.col("ord"), F.lit(False))).drop("_first")


def changed_finals(incoming: DataFrame, current: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """REC3, REC4: current games (with logs) against incoming ones: keys, game_id, change.

    change is downgraded (final before, open now), rescored (final in both, another score) or removed
    (a final that the import lacks); others have no row.
    """
    now = incoming.select(*keys, "game_id", F.coalesce("is_final", F.lit(False)).alias("_final"), F.lit(True).alias("_there"), *[F.col(c).alias("n_" + c) for c in _SAME])
    j = current.where(is_final()).join(now, [*keys, "game_id"], "left")
    same = F.lit(True)
    for c in _SAME:
        same = same & F.col(c).eqNullSafe(F.col("n_" + c))
    change = F.when(F.col("_there").isNull(), "removed").when(~F.col("_final"), "downgraded").when(~same, "rescored")
    return j.withColumn("change", change).where("change IS NOT NULL").select(*keys, "game_id", "change")


def added_removed(incoming: DataFrame, current: DataFrame, by: str, keys: Keys = SEASON) -> DataFrame:
    """REC1, J6, U4: keys, the id, change (added or removed)."""
    cols = [*keys, by]
    added = incoming.select(*cols).distinct().join(current.select(*cols), cols, "left_anti").withColumn("change", F.lit("added"))
    removed = current.select(*cols).distinct().join(incoming.select(*cols), cols, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def import_preview(new_teams: DataFrame, new_games: DataFrame, old_teams: DataFrame, old_games: DataFrame, keys: Keys = SEASON) -> DataFrame:
    """REC5, REC6: one row per season with counts, samples and notes of an import; games carry their logs and team names."""
    k = list(keys)
    names = new_teams.unionByName(old_teams).groupBy(*k, "team_id").agg(F.min_by("name", "ord").alias("name"))
    counts = new_games.groupBy(*k).agg(F.count("*").alias("games"), F.count_if(is_final()).alias("finals"))
    teams = new_teams.groupBy(*k).agg(F.count("*").alias("teams"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ord", "name"))), 1, 5), lambda x: x["name"]), ", ").alias("sample_teams"))
    early = new_games.withColumn("_r", F.row_number().over(Window.partitionBy(*k).orderBy("ord"))).where("_r <= 3")
    for side in ("away", "home"):
        early = early.join(names.select(*k, F.col("team_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")), [*k, f"{side}_id"], "left")
    line = F.concat(F.when(is_text("date_text"), F.concat("date_text", F.lit(": "))).otherwise(""), F.coalesce("away_name", "away_id"), F.lit(" at "), F.coalesce("home_name", "home_id"))
    samples = early.groupBy(*k).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))), lambda x: x["line"]), "; ").alias("sample_games"))
    change = lambda df, p: df.groupBy(*k).agg(F.count_if(F.col("change") == "added").alias(f"added_{p}"), F.count_if(F.col("change") == "removed").alias(f"removed_{p}"))
    dup = duplicates(new_games, keys).groupBy(*k).agg(F.count_if("duplicate").alias("duplicate_games"), F.count_if("reversed").alias("reversed_games"))
    fin = changed_finals(new_games, old_games, keys).groupBy(*k).agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("rescored", "changed_finals"), ("downgraded", "final_downgrades"), ("removed", "removed_finals"))])
    played = old_games.where(is_final()).select(*k, F.explode(F.array("away_id", "home_id")).alias("team_id")).distinct()
    gone = old_teams.join(new_teams, [*k, "team_id"], "left_anti").join(played, [*k, "team_id"], "left_semi").groupBy(*k).agg(F.count("*").alias("removed_teams_with_finals"))
    out = teams.join(counts, k, "full_outer")
    for part in (change(added_removed(new_teams, old_teams, "team_id", keys), "teams"), change(added_removed(new_games, old_games, "game_id", keys), "games"), dup, fin, gone, samples):
        out = out.join(part, k, "left")
    numbers = [c for c, t in out.dtypes if t == "bigint"]
    out = out.fillna(0, numbers).fillna("", ["sample_teams", "sample_games"]).withColumn("open", F.greatest(F.lit(0), F.col("games") - F.col("finals")))
    s = lambda c: F.when(F.col(c) == 1, "").otherwise("s")
    n = lambda c, *text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), *[x if isinstance(x, Column) else F.lit(x) for x in text]))
    notes = F.array_compact(F.array(
        n("duplicate_games", " duplicate date/team game", s("duplicate_games")), n("reversed_games", " possible home/away duplicate", s("reversed_games")),
        n("changed_finals", " completed score change", s("changed_finals")), n("final_downgrades", " completed game", s("final_downgrades"), " becoming scheduled"),
        n("removed_finals", " completed game", s("removed_finals"), " removed"), n("removed_teams_with_finals", " removed team", s("removed_teams_with_finals"), " with finals"),
    ))
    return out.withColumn("notes", notes)


def preview_text(preview: DataFrame, warnings: Column | None = None, keys: Keys = SEASON) -> DataFrame:
    """REC6: keys, text: the preview as paragraphs."""
    head = F.format_string("%d teams · %d games · %d finals · %d open", "teams", "games", "finals", "open")
    change = F.format_string("Change summary: +%d/-%d teams · +%d/-%d games", "added_teams", "removed_teams", "added_games", "removed_games")
    told = lambda c, p: F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c)))
    listed = lambda c, p: F.when(F.size(c) > 0, F.concat(F.lit(p + "\n- "), F.array_join(c, "\n- ")))
    warn = listed(warnings, "Warnings:") if warnings is not None else F.lit(None).cast("string")
    return preview.select(*keys, F.concat_ws("\n\n", head, change, told("sample_teams", "Teams preview: "), told("sample_games", "Games preview: "), listed(F.col("notes"), "Reconciliation checks:"), warn).alias("text"))


def issue_summary(issues: DataFrame, row_limit: int = 5) -> DataFrame:
    """REC7: a line for each kind of issue (kind, row_number, detail), in the order in which kinds first occur."""
    g = issues.groupBy("kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("row_number")).alias("rows"), F.sort_array(F.collect_list(F.struct("row_number", "detail"))).alias("d"))
    details = F.array_distinct(F.filter(F.transform("d", lambda x: x["detail"]), lambda x: x != ""))
    shown = F.array_join(F.transform(F.slice("rows", 1, row_limit), lambda r: r.cast("string")), ", ")
    more = F.when(F.col("n") > row_limit, F.concat(F.lit(", +"), (F.col("n") - row_limit).cast("string"), F.lit(" more"))).otherwise("")
    label = F.create_map(*[F.lit(x) for kv in ISSUES.items() for x in kv])
    tail = F.when(F.size(details) > 0, F.concat(F.lit(" — "), F.array_join(F.slice(details, 1, 2), "; "))).otherwise("")
    line = F.concat(F.col("n").cast("string"), F.lit(" row(s) skipped: "), F.try_element_at(label, "kind"), F.lit(" (rows "), shown, more, F.lit(")"), tail)
    return g.select("kind", F.col("rows")[0].alias("first_row"), line.alias("line"))


def pending_imports(games: DataFrame) -> DataFrame:
    """REC8: imported finals are open until someone verifies them."""
    return games.withColumns({"pending_verification": is_final(), "is_final": F.lit(False)})
