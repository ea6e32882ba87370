"""Stored tables, backup documents, the one undo snapshot."""

from __future__ import annotations

import re
import time
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pennant.sources.commits import Commits

TEAMS = "season string, team_id string, name string, ord long"
MATCHUPS = "season string, game_id string, ord long, date_text string, away_id string, home_id string"
LOGS = "season string, game_id string, away_runs string, home_runs string, away_hits string, home_hits string, away_k string, home_k string, away_errors string, home_errors string, away_walks string, home_walks string, innings string, is_final boolean"
SETTINGS = "season string, settings string"
# Names of a log's fields in documents, and of the columns that hold them.
FIELDS = {
    "awayRuns": "away_runs", "awayHits": "away_hits", "awayK": "away_k", "homeRuns": "home_runs", "homeHits": "home_hits", "homeK": "home_k", "innings": "innings", "isFinal": "is_final",
    "awayErrors": "away_errors", "homeErrors": "home_errors", "awayWalksAllowed": "away_walks", "homeWalksAllowed": "home_walks",
}
LOG = ",".join(f"{f}:{'boolean' if f == 'isFinal' else 'string'}" for f in FIELDS)
DOCUMENT = f"teams array<struct<id:string,name:string>>, matchups array<struct<id:string,date:string,away:string,home:string>>, logs map<string,struct<{LOG}>>, bracketLogs map<string,struct<{LOG}>>"


class Stored(NamedTuple):
    """The tables of seasons; settings are JSON texts."""

    teams: DataFrame
    matchups: DataFrame
    logs: DataFrame
    bracket_logs: DataFrame
    settings: DataFrame


def load(spark: SparkSession, path: str, schema: str | StructType, legacy: str | None = None) -> DataFrame:
    """SRC6, SRC7: the table at path, else at its former place, else an empty one."""
    for place in filter(None, (path, legacy)):
        try:
            return spark.read.schema(schema).parquet(place)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


SCHEMAS = {"teams": TEAMS, "matchups": MATCHUPS, "logs": LOGS, "bracket_logs": LOGS, "settings": SETTINGS}


def load_all(spark: SparkSession, path: str, legacy: str | None = None) -> Stored:
    """SRC6, SRC7: the five tables of the latest commit below path.

    Without one, tables that lie there or at the former place are carried over: once, as a first
    commit of all five, from which every later reader reads.
    """
    latest = Commits(spark, f"{path}/commits").current()
    if latest is None:
        found = Stored(**{n: load(spark, f"{path}/{n}", s, f"{legacy}/{n}" if legacy else None) for n, s in SCHEMAS.items()})
        if all(df.isEmpty() for df in found) or not save_all(found, path):
            return found
        latest = Commits(spark, f"{path}/commits").current()
    return Stored(**{n: load(spark, f"{path}/{latest[1]['version']}/{n}", s) for n, s in SCHEMAS.items()})


#: What a store that can't be written to raises, in Java's names.
_STORE = re.compile(r"java\.(?:io|nio\.file|net)\.\w*Exception|org\.apache\.hadoop\.\S*Exception")


def save(df: DataFrame, path: str) -> bool:
    """Writes the table, a folder for each season; False if the store failed. Wrong plans and failing rows are raised."""
    try:
        df.write.mode("overwrite").partitionBy("season").parquet(path)
    except (Py4JJavaError, PySparkException) as e:
        if isinstance(e, AnalysisException) or not _STORE.search(str(e)):
            raise
        df.sparkSession.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("pennant").warn(f"{path} was not saved: {e}")
        return False
    return True


def save_all(stored: Stored, path: str) -> bool:
    """SNK5: the five tables below path, by one commit; False if one of them failed, and then all stay as they were.

    They are written to a version of their own, and the commit that names it is the last step. The
    version before stays, for those who read it now; older ones go.
    """
    spark, version = stored.teams.sparkSession, f"versions/{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    try:
        commits = Commits(spark, f"{path}/commits")
        before = commits.current()
        if not all(save(df, f"{path}/{version}/{n}") for n, df in stored._asdict().items()):
            commits.remove(version)
            return False
        commits.commit({"version": version, "before": before[1]["version"] if before else None}, before[0] if before else 0)
        kept = {version, before[1]["version"] if before else None}
        commits.remove(*[f"versions/{v}" for v in commits.beside("versions") if f"versions/{v}" not in kept])
    except Py4JJavaError as e:
        if not _STORE.search(str(e)):
            raise
        return False
    return True


def capture_undo(stored: Stored, path: str, label: str) -> bool:
    """MU5: keeps the tables as the one snapshot that can be restored, in a folder of their own; the pointer to it is written last."""
    spark, version = stored.teams.sparkSession, f"{path}/undo/{time.time_ns()}"
    if not save_all(stored, version):
        return False
    spark.createDataFrame([(label, version)], "label string, version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/undo/latest")
    return True


def restore_undo(spark: SparkSession, path: str) -> tuple[str, Stored] | None:
    """MU5: label and tables of the snapshot, None if there is none."""
    latest = load(spark, f"{path}/undo/latest", "label string, version string").first()
    return (latest.label, load_all(spark, latest.version)) if latest else None


def _listed(rows: list, order: str, keys: list[str], df: DataFrame, name: str, shape) -> DataFrame:
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, *rows))), shape).alias(name))


def teams_list(teams: DataFrame, keys: list[str]) -> DataFrame:
    return _listed(["team_id", "name"], "ord", keys, teams, "teams", lambda x: F.struct(x["team_id"].alias("id"), x["name"].alias("name")))


def matchups_list(matchups: DataFrame, keys: list[str]) -> DataFrame:
    return _listed(["game_id", "date_text", "away_id", "home_id"], "ord", keys, matchups, "matchups", lambda x: F.struct(x["game_id"].alias("id"), x["date_text"].alias("date"), x["away_id"].alias("away"), x["home_id"].alias("home")))


def _logs_map(logs: DataFrame, keys: list[str], name: str) -> DataFrame:
    log = F.struct(*[F.col(c).alias(f) for f, c in FIELDS.items()])
    return logs.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("game_id", log.alias("log"))))).alias(name))


def documents(stored: Stored, keys: tuple[str, ...] = ("season",)) -> DataFrame:
    """SNK4: season, document: everything about a season as one JSON document."""
    k = list(keys)
    d = teams_list(stored.teams, k)
    for part in (matchups_list(stored.matchups, k), _logs_map(stored.logs, k, "logs"), _logs_map(stored.bracket_logs, k, "bracketLogs"), stored.settings.select(*k, "settings")):
        d = d.join(part, k, "left")
    text = lambda c, none: F.coalesce(F.to_json(c), F.lit(none))
    parts = [("teams", text("teams", "[]")), ("matchups", text("matchups", "[]")), ("logs", text("logs", "{}")), ("bracketLogs", text("bracketLogs", "{}")), ("settings", F.coalesce("settings", F.lit("{}")))]
    return d.select(*k, F.concat(F.lit("{"), *[x for i, (n, v) in enumerate(parts) for x in (F.lit(f'{"," * (i > 0)}"{n}":'), v)], F.lit("}")).alias("document"))


def log_rows(logs: Column, keys: tuple[str, ...], df: DataFrame) -> DataFrame:
    return df.select(*keys, F.explode(logs).alias("game_id", "l")).select(*keys, "game_id", *[F.col(f"l.{f}").alias(c) for f, c in FIELDS.items()])


def from_documents(docs: DataFrame, keys: tuple[str, ...] = ("season",)) -> Stored:
    """SRC8: the tables of documents (keys, document), not yet coerced; documents without teams, games or logs give no rows."""
    d = docs.select(*keys, F.from_json("document", DOCUMENT).alias("d"), F.get_json_object("document", "$.settings").alias("settings")).where("d.teams IS NOT NULL AND d.matchups IS NOT NULL AND d.logs IS NOT NULL")
    ord_ = F.col("ord").cast("long").alias("ord")
    teams = d.select(*keys, F.posexplode("d.teams").alias("ord", "t")).select(*keys, F.col("t.id").alias("team_id"), F.col("t.name").alias("name"), ord_)
    games = d.select(*keys, F.posexplode("d.matchups").alias("ord", "m")).select(*keys, F.col("m.id").alias("game_id"), ord_, F.col("m.date").alias("date_text"), F.col("m.away").alias("away_id"), F.col("m.home").alias("home_id"))
    return Stored(teams, games, log_rows(F.col("d.logs"), keys, d), log_rows(F.col("d.bracketLogs"), keys, d), d.select(*keys, "settings"))


def read_backup(spark: SparkSession, path: str, season: str) -> Stored:
    """SRC8: the tables of the backup document at path. Raises ValueError if it holds no teams, games or logs."""
    docs = spark.read.text(path, wholetext=True).select(F.lit(season).alias("season"), F.col("value").alias("document"))
    if docs.select(F.from_json("document", DOCUMENT).alias("d")).where("d.teams IS NOT NULL AND d.matchups IS NOT NULL AND d.logs IS NOT NULL").isEmpty():
        raise ValueError("not a backup of a season")
    return from_documents(docs)
