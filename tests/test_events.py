"""Events by their own time: streams in several batches against tables, late and repeated rows, zones, nulls."""

import datetime as dt

from pennant.streaming import events

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
START = dt.datetime(2024, 3, 31)  # a day with a change of clocks in some zones


def rows(*some):
    """(id, hours after START, user, value)."""
    return [(i, None if h is None else START + dt.timedelta(hours=h), u, "t", v) for i, h, u, v in some]


def listed(result, key, bounds):
    return sorted((str(r[key]), str(r[bounds].start), str(r[bounds].end), r.events, r.cents) for r in result.collect())


def streamed(spark, folder, batches, what):
    """Each batch is a file, read after those before it; the rows that came late are counted."""
    schema = spark.createDataFrame([], SCHEMA).schema
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    late = events.Lateness()
    spark.streams.addListener(late)
    try:
        return events.followed(spark, f"{folder}/*", schema, what, 1), late
    finally:
        assert all(e.wait(30) for e in late.ended.values())
        spark.streams.removeListener(late)


def test_stream_in_batches_equals_the_table_without_late_rows(spark, tmp_path):
    first = rows((1, 0, 7, 1.25), (2, 1, 7, 2.0), (2, 1, 7, 2.0), (3, 0.5, 8, None), (4, 2, None, 1.0))
    second = rows((2, 1, 7, 2.0), (5, 6.5, 7, 0.1), (6, 9, 8, 4.0))  # the session of user 7 goes on, id 2 comes again in time
    third = rows((8, 10, 9, 5.0))
    fourth = rows((7, 3, 7, 100.0), (9, 30, 8, 6.0))  # id 7 is four hours behind the watermark of the second batch, which the fourth goes by
    batches = [first, second, third, fourth]
    for what, key, bounds in ((events.sessions, "user_id", "session"), (events.windows, "event_type", "window")):
        got, late = streamed(spark, tmp_path / bounds, batches, what)
        table = spark.createDataFrame([r for b in batches for r in b if r[0] != 7], SCHEMA)
        assert listed(got, key, bounds) == listed(events.closed(what(table), table, bounds), key, bounds)
        assert list(late.late.values()) == [1] and min(late.batches.values()) >= 4


def test_sessions_by_hand(spark):
    table = spark.createDataFrame(rows((1, 0, 7, 1.25), (2, 6, 7, 2.0), (3, 12.5, 7, 1.0), (4, None, 7, 9.0), (None, 1, 7, 9.0), (5, 1, None, 3.0), (5, 1, None, 3.0)), SCHEMA)
    at = lambda h: str(START + dt.timedelta(hours=h))
    # an event exactly a gap after the last one still belongs to its session
    assert listed(events.sessions(table), "user_id", "session") == [("7", at(0), at(12), 2, 325), ("7", at(12.5), at(18.5), 1, 100), ("None", at(1), at(7), 1, 300)]
    assert events.sessions(table.limit(0)).count() == events.windows(table.limit(0)).count() == 0


def test_times_without_a_zone_are_utc(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows((1, 0, 7, 1.0), (2, 2.5, 7, 1.0), (3, -600_000.25, 7, 1.0)), SCHEMA)
    want = sorted((r.event_id, int((r.ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))) for r in table.collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = sorted(tuple(r) for r in events.timed(table).select("event_id", F.unix_micros("ts")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == want
