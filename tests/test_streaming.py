"""A stream of results over several batches against the same changes at once."""

from pyspark.sql import functions as F

from pennant.operators import schedule
from pennant.streaming import live


def scored(games, ids, runs, change_no):
    g = games.where(F.col("game_id").isin(ids))
    return g.withColumns({c: F.lit(v).cast("long") for c, v in (("away_runs", runs[0]), ("home_runs", runs[1]), ("away_k", 1), ("home_k", 1))} | {"is_final": F.lit(True), "change_no": F.lit(change_no).cast("long")})


def ranks(df):
    return sorted((r.team_id, r.rank, r.w, r.l, r.t, r.rs) for r in df.collect())


def test_batches_keep_what_came_before(spark, tmp_path):
    teams, games = schedule.demo_season(spark)
    games = games.unionByName(games.withColumn("season", F.lit("other")))
    teams = teams.unionByName(teams.withColumn("season", F.lit("other")))
    place, out, source = (str(tmp_path / n) for n in ("games", "out", "changes"))
    live.begin(games, place)
    one = scored(games.where("season = 'demo'"), ["demo-20", "demo-21"], (9, 2), 5)
    two = scored(games.where("season = 'demo'"), ["demo-22"], (1, 8), 6)
    late = scored(games.where("season = 'demo'"), ["demo-20"], (0, 9), 4)  # older than what is there
    for i, df in enumerate((one, two, late)):
        df.coalesce(1).write.parquet(f"{source}/{i}")
    for i in range(3):
        stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/{{{','.join(map(str, range(i + 1)))}}}")
        live.follow(stream, place, teams, out, str(tmp_path / "checkpoint"), every=None).awaitTermination(120)
    want = live.merged(games.where("season = 'demo'").withColumn("change_no", F.lit(-1).cast("long")), one.unionByName(two))
    want = ranks(live.standings_of(want.drop("change_no"), teams))
    batches = sorted(int(p.name.partition("=")[2]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    assert len(batches) == 3
    assert ranks(spark.read.parquet(f"{out}/batch={batches[1]}")) == want == ranks(spark.read.parquet(f"{out}/batch={batches[2]}"))
    assert ranks(spark.read.parquet(f"{out}/batch={batches[0]}")) != want
    now = live.stored(spark, place, one.schema)
    assert now.count() == 56 and now.where("season = 'other' AND is_final").count() == 36 // 2
    assert now.where("game_id = 'demo-20' AND season = 'demo'").first().away_runs == 9


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    teams, games = schedule.demo_season(spark)
    place, out = str(tmp_path / "games"), str(tmp_path / "out")
    live.begin(games, place)
    changes = scored(games, ["demo-20"], (9, 2), 1)
    live.apply_batch(changes, 0, place, teams, out)
    first = ranks(spark.read.parquet(f"{out}/batch=0"))
    live.apply_batch(changes, 0, place, teams, out)
    assert ranks(spark.read.parquet(f"{out}/batch=0")) == first and live.stored(spark, place, changes.schema).where("is_final").count() == 19


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    """Data and manifest are written, the commit isn't: readers see what was there, and the batch runs again."""
    import pytest

    from pennant.sources.commits import Commits

    teams, games = schedule.demo_season(spark)
    place, out = str(tmp_path / "games"), str(tmp_path / "out")
    live.begin(games, place)
    changes = scored(games, ["demo-20"], (9, 2), 1)

    def fails(*_):
        raise OSError("the store is gone")

    with monkeypatch.context() as m:
        m.setattr(Commits, "commit", fails)
        with pytest.raises(OSError):
            live.apply_batch(changes, 0, place, teams, out)
    assert live.stored(spark, place, changes.schema).where("is_final").count() == 18
    live.apply_batch(changes, 0, place, teams, out)
    assert live.stored(spark, place, changes.schema).where("is_final").count() == 19


def test_batches_open_only_their_seasons_and_compaction_keeps_them(spark, tmp_path):
    teams, games = schedule.demo_season(spark)
    games = games.unionByName(games.withColumn("season", F.lit("other")))
    place, out = str(tmp_path / "games"), str(tmp_path / "out")
    live.begin(games, place)
    for i, g in enumerate(("demo-20", "demo-21", "demo-22")):
        live.apply_batch(scored(games.where("season = 'demo'"), [g], (9, 2), i), i, place, teams, out)
    schema = scored(games, ["demo-20"], (9, 2), 1).schema
    opened = {f.split("/games/games/")[1].split("/")[0] for f in live.stored(spark, place, schema).inputFiles() if "/games/games/" in f}
    assert len(opened) == 2 and "begin" in opened  # the other season, and the latest batch
    before = sorted(map(str, live.stored(spark, place, schema).collect()))
    live.compact(spark, place, schema)
    assert sorted(map(str, live.stored(spark, place, schema).collect())) == before
    left = sorted(p.name[:7] for p in (tmp_path / "games" / "games").iterdir())
    assert left == ["batch-0", "begin", "compact"]  # the last batch can still start again
    live.apply_batch(scored(games.where("season = 'demo'"), ["demo-22"], (9, 2), 2), 2, place, teams, out)
    assert sorted(map(str, live.stored(spark, place, schema).collect())) == before


def test_the_latest_request_wins(spark, tmp_path):
    """The first of two requests is cancelled while it runs, and only the second one's result is there."""
    import threading
    import time

    from pyspark import InheritableThread

    from pennant.streaming.latest import Latest

    table = Latest(spark, str(tmp_path / "table"))
    assert table.read("id long").count() == 0
    began, ended = tmp_path / "began", {}

    def slowly(batches):
        began.touch()
        time.sleep(60)
        yield from batches

    def first():
        at = time.time()
        ended["first"] = (table.run(lambda: spark.range(3).coalesce(1).mapInPandas(slowly, "id long")), time.time() - at)

    thread = InheritableThread(target=first)
    thread.start()
    while not began.exists():
        time.sleep(0.1)
    assert table.run(lambda: spark.range(5)) is True
    thread.join(50)
    assert ended["first"][0] is False and ended["first"][1] < 50
    assert table.read("id long").count() == 5
    assert table.run(lambda: spark.range(2)) and table.run(lambda: spark.range(7)) and table.read("id long").count() == 7
    assert len(list((tmp_path / "table" / "versions").iterdir())) == 2 and threading.active_count() < 50
    import pytest

    with pytest.raises(Exception, match="no_such"):
        table.run(lambda: spark.range(1).selectExpr("raise_error('no_such') AS id"))
