"""ST2, ST4: results arrive as a stream; each batch is merged into the stored games and recomputes the seasons it touches.

The stored games are folders of seasons; a manifest names the folder that holds each season's games, and a
commit names the manifest. A batch opens the folders of the seasons that it touches and no others,
writes their new games to a folder of its own, then a manifest, then the commit. So what it reads
and writes follows the seasons that it touches (and one small row for each season), not how many batches
there were; whoever fails before the commit has changed nothing. A batch that runs again after its
commit starts from the manifest before it. compact() brings all seasons into one folder and removes
folders that no kept manifest names. Of all changes of a game, in whatever batch they come, the one with the
largest change_no stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from pennant.operators import standings, stats
from pennant.settings import Settings
from pennant.sources.commits import Commits

MANIFEST = "season string, folder string"
#: Seasons of a batch that are named in its plan, so that their folders alone are opened; with more they are joined.
MOST_NAMED = 1000


def begin(games: DataFrame, path: str) -> None:
    """Stores the games (any columns with season and game_id) before the first batch."""
    _write(games.withColumn("change_no", F.lit(-1).cast("long")), path, "begin")
    _commit(games.select("season").distinct().withColumn("folder", F.lit("begin")), path, -1, None)


def _write(games: DataFrame, path: str, folder: str) -> None:
    games.write.mode("overwrite").partitionBy("season").parquet(f"{path}/games/{folder}")


def _commit(manifest: DataFrame, path: str, batch: int, before: str | None, after: int = 0) -> None:
    """Writes the manifest and makes it the latest, after commit number after."""
    name = f"{after + 1:012d}-{uuid.uuid4().hex[:8]}"
    manifest.coalesce(1).write.parquet(f"{path}/manifests/{name}")
    Commits(manifest.sparkSession, f"{path}/commits").commit({"batch": batch, "manifest": name, "before": before}, after)


def _manifest(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{name}")


def _opened(spark: SparkSession, path: str, schema: StructType, manifest: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The games of the manifest's seasons, from the folders that it names; only: these seasons, whose folders are then the only ones that are opened."""
    full = StructType([f for f in schema if f.name != "change_no"]).add("change_no", LongType())
    parts = None
    # one row for each folder that is still in use: compaction keeps them few
    for r in manifest.select("folder").distinct().collect():
        games = spark.read.schema(full).parquet(f"{path}/games/{r.folder}")
        games = games if only is None else games.where(F.col("season").isin(only))
        games = games.join(manifest.where(F.col("folder") == r.folder).select("season"), "season", "left_semi")
        parts = games if parts is None else parts.unionByName(games)
    return spark.createDataFrame([], full) if parts is None else parts


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored games as of the latest commit, with change_no."""
    return _opened(spark, path, schema, _manifest(spark, path, Commits(spark, f"{path}/commits").current()[1]["manifest"]))


def compact(spark: SparkSession, path: str, schema: StructType) -> None:
    """Brings all seasons into one folder; removes folders and manifests that neither the latest commit nor the one before its batch names."""
    commits = Commits(spark, f"{path}/commits")
    number, latest = commits.current()
    folder = f"compact-{number:012d}"
    _write(stored(spark, path, schema), path, folder)
    manifest = _manifest(spark, path, latest["manifest"]).select("season", F.lit(folder).alias("folder"))
    _commit(manifest, path, latest["batch"], latest["before"], number)
    now = commits.current()[1]
    names = [n for n in (now["manifest"], now["before"]) if n]
    used = {r.folder for n in names for r in _manifest(spark, path, n).select("folder").distinct().collect()}
    commits.remove(*[f"games/{f}" for f in commits.beside("games") if f not in used], *[f"manifests/{m}" for m in commits.beside("manifests") if m not in names])


def merged(games: DataFrame, changes: DataFrame) -> DataFrame:
    """games with the rows of changes in place of those with equal ids; the largest change_no stays."""
    w = Window.partitionBy("season", "game_id").orderBy(F.col("change_no").desc())
    every = games.unionByName(changes.select(*games.columns))
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def standings_of(games: DataFrame, teams: DataFrame, settings: Settings = Settings()) -> DataFrame:
    s = stats.team_stats(games, teams.join(games.select("season").distinct(), "season", "left_semi"), settings.max_run_differential)
    return standings.rank_teams(s, stats.head_to_head(games), settings)


def apply_batch(changes: DataFrame, number: int, path: str, teams: DataFrame, out: str, settings: Settings = Settings()) -> None:
    """Merges a batch into the stored games and writes the standings of its seasons below out/batch=number."""
    spark = changes.sparkSession
    at, latest = Commits(spark, f"{path}/commits").current()
    base = latest["before"] if latest["batch"] == number else latest["manifest"]
    manifest = _manifest(spark, path, base)
    seasons = changes.select("season").distinct()
    few = seasons.limit(MOST_NAMED + 1).collect()
    names = [r.season for r in few] if len(few) <= MOST_NAMED else None
    folder = f"batch-{number:012d}-{uuid.uuid4().hex[:8]}"
    _write(merged(_opened(spark, path, changes.schema, manifest.join(seasons, "season", "left_semi"), names), changes), path, folder)
    now = manifest.join(seasons, "season", "left_anti").unionByName(seasons.withColumn("folder", F.lit(folder)))
    _commit(now, path, number, base, at)
    games = _opened(spark, path, changes.schema, seasons.withColumn("folder", F.lit(folder)))
    standings_of(games.drop("change_no"), teams, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")


def follow(changes: DataFrame, path: str, teams: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), every: str | None = "1 second") -> StreamingQuery:
    """Follows a stream of changes (rows of games with change_no); every: the trigger's interval, None for what is there now."""
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            if not df.isEmpty():
                apply_batch(df, number, path, teams, out, settings)
        finally:
            df.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
