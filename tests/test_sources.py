"""Round trips of files and texts."""

import pytest

from pennant.operators import mutations, schedule
from pennant.sources import schedule_csv, share, storage


def test_schedule_csv(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("Game ID,Date,Away Team,Away Runs,Home Team,Home Runs,Away BB,Home BB Allowed\ng1,5/1,Aces,3,Bears,2,4,\ng1,5/2,Aces,,Bears,,,\n,5/3,Aces,,,,,\n,May 4,\"Co, mets\",,Bears,,,\n", encoding="utf-8-sig")
    teams, games, logs, issues = schedule_csv.parse(schedule_csv.read_rows(spark, str(p)))
    assert sorted(r.team_id for r in teams.collect()) == ["ACES", "BEAR", "COME"]
    assert {(r.kind, r.row_number) for r in issues.collect()} == {("duplicate-id", 3), ("missing-team", 4)}
    g1 = logs.where("game_id = 'g1'").first()
    assert (g1.away_k, g1.is_final, g1.home_walks) == ("0", True, "4")
    assert {r.date_text for r in games.collect()} == {"5/1", "5/4"}
    q = tmp_path / "bad.csv"
    q.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        schedule_csv.read_rows(spark, str(q))


def season_tables(spark):
    from pyspark.sql import functions as F

    teams, games = schedule.demo_season(spark)
    games = games.withColumn("date_text", F.date_format("game_date", "M/d"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    logs = games.select("season", "game_id", *[text(c).alias(c) for c in storage.FIELDS.values() if c != "is_final"], "is_final")
    odd = spark.createDataFrame([("demo", 'g"1', "3", "1", "", "é\\", "", "", "", "", "1", "", "6", True)], storage.LOGS)
    settings = spark.createDataFrame([("demo", '{"goldCutoff":4,"seasonLabel":"Spring \\"26\\""}')], storage.SETTINGS)
    return storage.Stored(teams.select("season", "team_id", "name", "ord"), games.select("season", "game_id", "ord", "date_text", "away_id", "home_id"), logs, odd, settings)


def rows_of(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.drop("ord").collect())


def test_backup_round_trip_of_every_column(spark, tmp_path):
    import json

    kept = season_tables(spark)
    doc = tmp_path / "b.json"
    doc.write_text(storage.documents(kept).first().document)
    assert set(json.loads(doc.read_text())) == {"teams", "matchups", "logs", "bracketLogs", "settings"}
    back = storage.read_backup(spark, str(doc), "demo")
    for name in ("teams", "matchups", "logs", "bracket_logs", "settings"):
        assert rows_of(getattr(back, name)) == rows_of(getattr(kept, name)), name
    doc.write_text('{"teams": [], "matchups": {}}')
    with pytest.raises(ValueError):
        storage.read_backup(spark, str(doc), "demo")


def test_share_round_trip_of_every_column(spark):
    from pyspark.sql import functions as F

    kept = season_tables(spark)
    s = share.snapshots(kept, most=None)
    back = share.expand(s, most=None)
    for name in ("teams", "matchups", "settings"):
        assert rows_of(getattr(back, name)) == rows_of(getattr(kept, name)), name
    assert rows_of(back.logs.where("is_final")) == rows_of(kept.logs.where("is_final"))
    assert back.logs.count() == kept.logs.count() and back.logs.where("NOT is_final AND away_runs = ''").count() == 10
    small = share.snapshots(kept, most=100).first()
    assert small.too_large and small.payload is None
    with pytest.raises(Exception, match="too large"):
        share.snapshots(kept, most=100).select(share.share_address("http://x/", F.col("payload"))).collect()
    url = s.select(share.share_address("http://x/#old", F.lit("abc"), "games", "A")).first()[0]
    assert url == "http://x/#s=abc&view=games&team=A" and share.address_parts(url.partition("#")[2])["team"] == "A"
    bad = spark.createDataFrame([("s", "%%%"), ("s", "x" * 8000), ("s", "e30")], "season string, payload string")
    assert share.expand(bad).teams.count() == 0
    old = spark.createDataFrame([("s", '{"v":1,"teams":[{"id":"A","name":"Aces"}],"matchups":[{"id":"g","date":"5/1","away":"A","home":"B"}],"logs":{"g":{"awayRuns":"3","isFinal":true}},"settings":{"goldCutoff":2}}')], "season string, j string")
    first = share.expand(old.select("season", share.encode(F.col("j")).alias("payload")))
    assert (first.teams.first().name, first.matchups.first().away_id, first.logs.first().away_runs, first.logs.first().is_final) == ("Aces", "A", "3", True)


def test_tables_undo_and_entries(spark, tmp_path):
    kept, place = season_tables(spark), str(tmp_path / "store")
    assert storage.load_all(spark, place).teams.count() == 0 and storage.restore_undo(spark, place) is None
    assert storage.save_all(kept, place) and rows_of(storage.load_all(spark, place).logs) == rows_of(kept.logs)
    (tmp_path / "file").write_text("x")
    assert storage.save(kept.teams, str(tmp_path / "file" / "below")) is False
    assert storage.capture_undo(kept, place, "first") and storage.capture_undo(kept._replace(teams=kept.teams.limit(3)), place, "second")
    label, before = storage.restore_undo(spark, place)
    assert label == "second" and before.teams.count() == 3 and rows_of(before.bracket_logs) == rows_of(kept.bracket_logs)
    entries = spark.createDataFrame([("demo", "demo-20", "away_runs", "7", 1), ("demo", "demo-20", "away_runs", "8", 2), ("demo", "new", "is_final", "true", 3)], "season string, game_id string, field string, value string, change_no long")
    got = {r.game_id: r for r in mutations.enter(kept.logs, entries, bracket=True).collect()}
    assert (got["demo-20"].away_runs, got["demo-20"].home_k, got["demo-20"].is_final) == ("8", "0", False)
    assert (got["new"].is_final, got["new"].innings, got["new"].away_hits, got["new"].away_k) == (True, "6", "", "0")
    assert len(got) == 29 and got["demo-01"].asDict() == next(r for r in kept.logs.collect() if r.game_id == "demo-01").asDict()
    _, games = schedule.demo_season(spark)
    assert mutations.toggle_final(games, games.select("season", "game_id")).where("is_final").count() == 10


def test_five_tables_are_one_commit(spark, tmp_path, monkeypatch):
    """A table that fails leaves all five as they were; a failure of the plan is raised; the former place is carried over once."""
    kept, place = season_tables(spark), str(tmp_path / "store")
    assert storage.save_all(kept, place)
    changed = kept._replace(teams=kept.teams.limit(2), settings=kept.settings.where("false"))
    plain = storage.save

    def fourth_fails(df, path):
        return False if path.endswith("bracket_logs") else plain(df, path)

    with monkeypatch.context() as m:
        m.setattr(storage, "save", fourth_fails)
        assert storage.save_all(changed, place) is False
    now = storage.load_all(spark, place)
    assert rows_of(now.teams) == rows_of(kept.teams) and rows_of(now.settings) == rows_of(kept.settings)
    assert len(list((tmp_path / "store" / "versions").iterdir())) == 1
    assert storage.save_all(changed, place) and storage.load_all(spark, place).teams.count() == 2
    for _ in range(2):
        assert storage.save_all(kept, place)
    assert len(list((tmp_path / "store" / "versions").iterdir())) == 2
    with pytest.raises(Exception, match="no_such_column"):
        storage.save(kept.teams.selectExpr("season", "raise_error('no_such_column') AS x"), str(tmp_path / "x"))
    # a former place without commits: carried over by the first reader, then left alone
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for name, df in kept._asdict().items():
        plain(df, f"{old}/{name}")
    assert rows_of(storage.load_all(spark, new, old).logs) == rows_of(kept.logs)
    plain(kept.teams.limit(1), f"{old}/teams")
    assert rows_of(storage.load_all(spark, new, old).teams) == rows_of(kept.teams) and len(list((tmp_path / "new" / "commits").glob("*.json"))) == 1


def test_of_two_commits_at_once_one_fails(spark, tmp_path):
    from pennant.sources.commits import Commits

    a, b = Commits(spark, str(tmp_path / "c")), Commits(spark, str(tmp_path / "c"))
    assert a.current() is None and a.commit({"x": 1}, 0) == 1
    with pytest.raises(RuntimeError):
        b.commit({"x": 2}, 0)
    for i in range(3):
        a.commit({"x": i})
    assert b.current() == (4, {"x": 2}) and len(list((tmp_path / "c").glob("*.json"))) == 2


def test_many_schedule_files_in_one_read(spark, tmp_path):
    """Each file by its own header and with ids, duplicates and teams of its own; unusable files are issues."""
    (tmp_path / "a.csv").write_text("Game ID,Date,Away Team,Away Runs,Home Team,Home Runs\ng1,5/1,Aces,3,Bears,2\ng1,5/2,Aces,,Bears,\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text('Home Team,Away Team,Date,Game ID,Home Runs,Away Runs,Away BB\nBears,"Cats, big",5/3,g1,1,4,7\n\n,Cats,5/4,,,\nBears,Dogs\n')
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d.csv").write_text("\n")
    rows, bad = schedule_csv.read_seasons(spark, str(tmp_path))
    assert {(r.season, r.kind) for r in bad.collect()} == {("c", "Missing required columns"), ("d", "CSV has no rows")}
    teams, games, logs, issues = schedule_csv.parse(rows)
    assert sorted((r.season, r.team_id, r.name) for r in teams.collect()) == [("a", "ACES", "Aces"), ("a", "BEAR", "Bears"), ("b", "BEAR", "Bears"), ("b", "CAT1", "Cats, big"), ("b", "CATS", "Cats"), ("b", "DOGS", "Dogs")]
    assert sorted((r.season, r.kind, r.row_number) for r in issues.collect()) == [("a", "duplicate-id", 3), ("b", "missing-team", 3)]
    assert sorted((r.season, r.game_id, r.away_id, r.home_id, r.date_text) for r in games.collect()) == [("a", "g1", "ACES", "BEAR", "5/1"), ("b", "g1", "CAT1", "BEAR", "5/3"), ("b", "game_2", "DOGS", "BEAR", "")]
    assert {(r.season, r.game_id): (r.away_runs, r.home_walks, r.is_final) for r in logs.collect()} == {("a", "g1"): ("3", "", True), ("b", "g1"): ("4", "7", True), ("b", "game_2"): ("", "", False)}


def test_team_lists_of_a_column(spark):
    from pyspark.sql import functions as F

    from pennant.sources import schedule_csv

    texts = ["Aces, Bears\r\nCubs\n\n Aces ,Dogs,", "", ",\n ,", "\tOne team\n", "a\rb"]
    df = spark.createDataFrame([*[(t,) for t in texts], (None,)], "text string")
    assert [r.names for r in df.select(schedule_csv.listed_teams(F.col("text")).alias("names")).collect()] == [*map(schedule_csv.team_list, texts), None]


def test_files_are_read_as_streams():
    """A season's file of many rows passes in batches, never as one list."""
    import tracemalloc

    import pyarrow as pa

    from pennant.sources.schedule_csv import _file_rows

    line = "g{:06d},5/1,Aces,Bears,6,3,4,5,6,7,8\r\n"
    text = "\ufeffGame ID,Date,Away Team,Home Team,Innings,Away Runs,Home Runs,Away Hits,Home Hits,Away K,Home K\r\n" + "".join(line.format(i) for i in range(60_000))
    files = pa.RecordBatch.from_arrays([pa.array(["s", "t", "u", "v"]), pa.array([text.encode(), b"", b"Game ID,Date,Away Team,Home Team\n", b'Date,Home Team,Away Team,Game ID\n5/2,"B\nb",A,x'])], ["season", "content"])
    tracemalloc.start()
    rows, others = 0, []
    for b in _file_rows(iter([files])):
        if b.column("season")[0].as_py() == "s":
            rows += b.num_rows
        else:
            others += b.to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60_000 and peak < 20e6
    assert [(r["season"], r["row_number"], r["problem"], r["home"]) for r in others] == [("t", None, "CSV has no rows", ""), ("u", None, "CSV has no rows", ""), ("v", 2, None, "B\nb")]


def test_shared_settings_are_read_in_one_pass(spark):
    """Both forms at once, with their filter; a snapshot is neither decoded nor parsed for each form."""
    import base64

    from pennant.sources import share

    docs = ['{"v":2,"t":[["A","Aces"]],"m":[],"l":{},"s":{"goldCutoff":3}}', '{"v":1,"teams":[{"id":"A","name":"Aces"}],"matchups":[],"logs":{},"settings":{"goldCutoff":5}}', '{"v":2,"t":[],"s":{"goldCutoff":9}}', '{"v":3,"t":[],"m":[],"l":{},"s":{}}']
    rows = [(str(i), base64.urlsafe_b64encode(d.encode()).decode().rstrip("=")) for i, d in enumerate(docs)]
    settings = share.expand(spark.createDataFrame(rows, "season string, payload string")).settings
    assert sorted(map(tuple, settings.collect())) == [("0", '{"goldCutoff":3}'), ("1", '{"goldCutoff":5}')]
    assert "Union" not in settings._jdf.queryExecution().optimizedPlan().toString()
