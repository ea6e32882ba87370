"""ST1: events by their own time: repeated rows, sessions, windows, and rows that come too late.

Each function takes the events as a table or as a stream and gives the same rows for both, but that a
stream gives a session or window once, when the watermark has passed its end, and never those
that are still open. closed() is what a stream has given when it has read the whole table: the
watermark is then the latest time less the allowed delay.

A row is late if it lies behind the watermark that the batch before began with, so within a batch or two
a row may come later than the delay and still count.

Rows without a time belong to no session or window, as rows that come later than the delay
allows; Lateness counts the latter. A null user or type is a group of its own.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType, TimestampNTZType

from pennant.plans.tables import shared_dir

#: How much later than the latest row a row may come, the gap that ends a session, and the windows' width and step.
DELAY, GAP, WIDTH, STEP = "2 hours", "6 hours", "1 day", "6 hours"


def _cents() -> F.Column:
    return F.coalesce(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(0)).alias("cents")


def timed(events: DataFrame) -> DataFrame:
    """events with ts as an instant: a time without a zone, which watermarks don't take, is read as UTC whatever the session's zone."""
    if events.schema["ts"].dataType != TimestampNTZType():
        return events
    part = lambda unit: F.expr(f"extract({unit} FROM ts - TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return events.withColumn("ts", F.timestamp_micros(minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")))


def once(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """events with one row for each event_id; of a stream's rows those that come within the delay of the first one.

    Rows without a time or an id go. Repeated rows are taken to be equal. The state holds an id no longer than the delay.
    """
    known = timed(events).where("ts IS NOT NULL AND event_id IS NOT NULL")
    if events.isStreaming:
        return known.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return known.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = GAP, delay: str = DELAY) -> DataFrame:
    """user_id, session (start, end), events, cents: runs of a user's events of which none is more than gap after the one before.

    Partial sessions are merged before the shuffle too, so that a user with very many events is no hot task.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return once(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("events"), _cents())


def windows(events: DataFrame, width: str = WIDTH, step: str = STEP, delay: str = DELAY) -> DataFrame:
    """event_type, window (start, end), events, cents: windows of a width, one beginning at each step."""
    return once(events, delay).groupBy("event_type", F.window("ts", width, step).alias("window")).agg(F.count("*").alias("events"), _cents())


def closed(result: DataFrame, events: DataFrame, ends: str, delay: str = DELAY) -> DataFrame:
    """Of a table's sessions or windows (ends: the column of their bounds) those that a stream over all of events has given."""
    mark = timed(events).agg((F.date_trunc("millisecond", F.max("ts")) - F.expr(f"INTERVAL {delay}")).alias("mark"))
    return result.join(F.broadcast(mark), result[ends]["end"] <= F.col("mark")).drop("mark")  # one row


def followed(spark: SparkSession, source: str, schema: StructType, what, files: int | None = None) -> DataFrame:
    """Streams all files of the source (a folder or a pattern) through what (a function of the stream), then reads what it has given; files: most files a batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    place, out = shared_dir(spark), what(reader.parquet(source))
    query = out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


class Lateness(StreamingQueryListener):
    """Counts, for each stream of the session that it is added to, the rows that came behind the watermark, and its batches."""

    def __init__(self):
        self._lock, self.late, self.batches, self.ended = threading.Lock(), {}, {}, {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.late[str(event.id)], self.batches[str(event.id)], self.ended[str(event.id)] = 0, 0, threading.Event()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self.batches[str(p.id)] += 1
            # the first stateful operator sees the rows, those after it see what it lets through
            self.late[str(p.id)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)].set()
