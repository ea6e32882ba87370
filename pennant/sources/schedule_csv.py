"""Schedules as CSV: read with issues of rejected rows, written in the two column layouts."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pennant.functions.scalars import csv_guard, csv_unguard, display_name, normal_date
from pennant.operators.validate import with_team_ids

# Column names by what they hold; the first that is there counts.
REQUIRED = {"game_id": ["Game ID"], "date": ["Date"], "away": ["Away Team"], "home": ["Home Team"]}
OPTIONAL = {
    "innings": ["Innings"], "away_runs": ["Away Runs"], "home_runs": ["Home Runs"], "away_hits": ["Away Hits"], "home_hits": ["Home Hits"], "away_k": ["Away K"], "home_k": ["Home K"],
    "away_errors": ["Away E", "Away Errors"], "home_errors": ["Home E", "Home Errors"], "away_bb": ["Away BB"], "home_bb": ["Home BB"], "away_walks": ["Away BB Allowed"], "home_walks": ["Home BB Allowed"],
}


def normal_header(name: str) -> str:
    """F14, SRC5: a column's name without a byte order mark, trimmed, in lower case, spaces squeezed."""
    return re.sub(r"\s+", " ", name.removeprefix(chr(0xFEFF)).strip().lower())


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC1, SRC2, SRC4: the rows of a schedule file as text columns, with row_number (2 for the first).

    Raises ValueError for a file without rows or without a required column.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    if not raw.columns or raw.isEmpty():
        raise ValueError("CSV has no rows")
    found = {normal_header(c): c for c in reversed(raw.columns)}

    def pick(names: list[str]) -> Column | None:
        known = [found[normal_header(n)] for n in names if normal_header(n) in found]
        return csv_unguard(F.coalesce(F.col(f"`{known[0]}`"), F.lit(""))) if known else None

    cols = {k: pick(v) for k, v in (REQUIRED | OPTIONAL).items()}
    if any(cols[k] is None for k in REQUIRED):
        raise ValueError("Missing required columns")
    # a schedule is a file, which one task reads whole: rows are numbered within it
    place = Window.partitionBy("_file").orderBy("_at")
    rows = raw.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), *[(c if c is not None else F.lit("")).alias(k) for k, c in cols.items()])
    return rows.withColumn("row_number", F.row_number().over(place) + 1).drop("_at", "_file")


_FIELDS = [*REQUIRED, *OPTIONAL]


def _file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (season, content) to their rows, each file by its own header; a file that can't be used is one row with its problem."""
    names = ["season", "row_number", "problem", *_FIELDS]
    for batch in batches:
        for season, content in zip(batch.column("season").to_pylist(), batch.column("content"), strict=True):
            # decoded and read as a stream: a task holds a file's bytes and one batch of its rows
            lines = csv.reader(io.TextIOWrapper(pa.BufferReader(content.as_buffer()), "utf-8-sig", "replace", newline=""))
            head = next((x for x in lines if any(map(str.strip, x))), [])
            at = {normal_header(h): i for i, h in reversed(list(enumerate(head)))}
            places = [next((at[normal_header(n)] for n in (REQUIRED | OPTIONAL)[f] if normal_header(n) in at), None) for f in _FIELDS]
            if any(p is None for p in places[: len(REQUIRED)]):
                rows = iter([(season, None, "Missing required columns" if head else "CSV has no rows", *[""] * len(_FIELDS))])
            else:
                read = ((season, n, None, *["" if p is None or p >= len(x) else x[p].strip() for p in places]) for n, x in enumerate((x for x in lines if x), 2))
                first = next(read, (season, None, "CSV has no rows", *[""] * len(_FIELDS)))
                rows = chain([first], read)
            while out := list(islice(rows, 10_000)):
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "row_number" else pa.string()) for k, c in zip(names, columns, strict=True)], names)


def read_seasons(spark: SparkSession, path: str, season: str = r"season=([^/]+)/|([^/]+?)(?:\.csv)?$") -> tuple[DataFrame, DataFrame]:
    """SRC1 of many files: (rows, issues). rows are those of read_rows with the season that a file's path names (the
    pattern's group that matches); each file is read by its own header, in either layout, and numbers its own rows. A
    file without rows or without a required column is an issue, and the others are read nevertheless (files of no bytes are not seen).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path)
    named = F.coalesce(*[F.nullif(F.regexp_extract("path", season, i + 1), F.lit("")) for i in range(re.compile(season).groups)])
    text = ", ".join(f"{f} string" for f in _FIELDS)
    every = files.select(named.alias("season"), "content").mapInArrow(_file_rows, f"season string, row_number long, problem string, {text}")
    issues = every.where("problem IS NOT NULL").select("season", F.col("problem").alias("kind"), "row_number", F.lit(None).cast("string").alias("detail"))
    return every.where("problem IS NULL").select("season", "row_number", *[csv_unguard(F.col(f)).alias(f) for f in _FIELDS]), issues


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """SRC1, SRC3: (teams, matchups, logs, issues) of a schedule's rows; of each season's own, if rows have a season.

    A row without both teams or with an id seen before is an issue. Both runs make a final, whose
    missing strikeouts are 0. Walks allowed are the explicit column's, else the other side's walks.
    """
    keys = ["season"] if "season" in rows.columns else []
    rows = rows if keys else rows.withColumn("season", F.lit(""))
    names = rows.select("season", F.explode(F.array("away", "home")).alias("said")).where("said <> ''").distinct().withColumn("name", display_name(F.col("said")))
    listed = names.select("season", "name", F.row_number().over(Window.partitionBy("season").orderBy("name", "said")).cast("long").alias("ord"), "said")  # a league's teams: few
    teams = with_team_ids(listed.drop("said")).join(listed.select("season", "ord", "said"), ["season", "ord"]).select("season", "team_id", F.col("said").alias("name"), (F.col("ord") - 1).alias("ord"))
    whole = (F.col("away") != "") & (F.col("home") != "")
    r = rows.withColumn("game_id", F.when(F.col("game_id") == "", F.concat(F.lit("game_"), (F.col("row_number") - 2).cast("string"))).otherwise(F.col("game_id")))
    r = r.withColumn("nth", F.when(whole, F.row_number().over(Window.partitionBy("season", "game_id", whole).orderBy("row_number"))))
    kind = F.when(~whole, "missing-team").when(F.col("nth") > 1, "duplicate-id")
    issues = r.select(*keys, kind.alias("kind"), "row_number", F.when(whole, F.col("game_id")).alias("detail")).where("kind IS NOT NULL")
    kept = r.where("nth = 1")
    for side in ("away", "home"):
        kept = kept.join(teams.select("season", F.col("name").alias(side), F.col("team_id").alias(f"{side}_id")), ["season", side])
    matchups = kept.select(*keys, "game_id", F.col("row_number").cast("long").alias("ord"), normal_date(F.col("date")).alias("date_text"), "away_id", "home_id")
    final = (F.col("away_runs") != "") & (F.col("home_runs") != "")
    k = lambda c: F.when(final & (F.col(c) == ""), "0").otherwise(F.col(c)).alias(c)
    walks = lambda own, other: F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(other)).alias(own)
    logs = kept.select(*keys, "game_id", "away_runs", "home_runs", "away_hits", "home_hits", k("away_k"), k("home_k"), "away_errors", "home_errors", walks("away_walks", "home_bb"), walks("home_walks", "away_bb"), F.when(F.col("innings") == "", "6").otherwise(F.col("innings")).alias("innings"), final.alias("is_final"))
    return (teams if keys else teams.drop("season")), matchups, logs, issues


def team_list(text: str) -> list[str]:
    """SRC13: names from a list by lines or commas, each once."""
    return list(dict.fromkeys(n for n in (p.strip() for p in re.split(r"\r?\n|,", text)) if n))


def listed_teams(text: Column) -> Column:
    """SRC13: the same of a column of lists, as arrays; null without a list."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"\r?\n|,"), lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")), lambda n: n != ""))


def layout(games: DataFrame, names: DataFrame, mode: str = "machine", keys: tuple[str, ...] = ()) -> DataFrame:
    """SNK1, SNK3: games (text or whole numbers) as the columns of a schedule file, behind the keys."""
    g = games
    for side in ("away", "home"):
        g = g.join(names.select(*keys, F.col("team_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")), [*keys, f"{side}_id"], "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = [text("game_id").alias("Game ID"), text("date_text").alias("Date")]

    def side(s: str) -> list[Column]:
        t = s.capitalize()
        cols = [F.coalesce(F.col(f"{s}_name"), F.col(f"{s}_id")).alias(f"{t} Team"), text(f"{s}_runs").alias(f"{t} Runs"), text(f"{s}_hits").alias(f"{t} Hits")]
        if mode == "player":
            return [*cols, text(f"{s}_errors").alias(f"{t} E"), text("home_walks" if s == "away" else "away_walks").alias(f"{t} BB")]
        bip = F.col(f"{s}_hits").try_cast("double") + F.col("innings").try_cast("double") * 3 - F.col(f"{s}_k").try_cast("double")
        return [*cols, text(f"{s}_k").alias(f"{t} K"), F.coalesce(bip.cast("long").cast("string"), F.lit("")).alias(f"{t} BIP")]

    in_order = g.repartition(*keys).sortWithinPartitions(*keys, "ord") if keys else g.orderBy("ord")
    out = in_order.select(*keys, *head, text("innings").alias("Innings"), *side("away"), *side("home"))
    return out.select(*keys, *[csv_guard(F.col(f"`{c}`")).alias(c) for c in out.columns if c not in keys])


def write(games: DataFrame, names: DataFrame, path: str, mode: str = "machine") -> None:
    """SNK1: a schedule file (a folder of parts) at path."""
    layout(games, names, mode).write.option("escape", '"').csv(path, header=True, mode="overwrite", emptyValue="")


def write_seasons(games: DataFrame, names: DataFrame, path: str, mode: str = "machine") -> None:
    """SNK1 for many seasons: a folder for each season, with a schedule file in it, all in one job."""
    layout(games, names, mode, ("season",)).write.option("escape", '"').partitionBy("season").csv(path, header=True, mode="overwrite", emptyValue="")
