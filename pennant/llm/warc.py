"""WARC archives with revisit records: resolved on headers, written one gzip member a record, read back and checked.

Of the rows with equal payloads of at least min_bytes the one with the largest page_id is the
response and the others revisit it (rows that repeat that page_id are responses too); smaller
payloads are all responses. A null html is an empty payload, a null url gets a name made from
the page_id, rows without a page_id never become the target of a revisit. Rows that repeat a
page_id with another payload are pages of their own. Columns other than page_id, url and html are
not read; an empty table gives archives without files.

Only ids, digests and lengths are shuffled by digest. The pages themselves are shuffled once, by id and
digest, to meet their decisions, so that a payload that a third of the pages share is spread over
all tasks. The folder of the archives has to be one that pyarrow's file systems reach from the
executors (a mounted folder, hdfs, s3, gs). Every attempt of a task writes files of its own, and only
those in the manifest count, so lost or repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pennant.llm.common import Scratch, arrow_batches, deal, shared_dir, written

CRLF = "\r\n"
#: What ends a record.
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive file is closed once the records in it have this many bytes before compression.
FILE_BYTES = 1 << 30
#: Rows and payload bytes of one batch that is read.
READ_ROWS, READ_BYTES = 512, 8 << 20

_READ = [("record_id", "string"), ("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_record", "string"), ("payload", "binary")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _uuid(page_id: Column, digest: Column, serial: Column | None = None) -> Column:
    """The record's name; serial tells rows of one page_id and payload apart, null for the one that revisits refer to."""
    parts = [F.coalesce(page_id.cast("string"), F.lit("none")), digest] + ([serial.cast("string")] if serial is not None else [])
    h = F.md5(F.concat_ws("/", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri(page_id: Column, url: Column) -> Column:
    number = F.coalesce(page_id.cast("string"), F.lit("none"))
    return F.regexp_replace(F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("urn:page:"), number)), r"[\x00-\x20]", "%20")


def resolved(pages: DataFrame, tmp: Scratch, min_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type, refers_to, refers_uri and serial.

    serial numbers the rows that repeat a page_id and payload, but for one of each; only such rows are
    written once more, and no group of them is brought together.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    again = tmp.table(p.groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest"))
    heads = p.where(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "payload_digest", "payload_bytes")
    first = heads.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    # written before the join, so that Spark can split a digest that many headers share
    first = tmp.table(first.where("n > 1 AND first.has_id").select("payload_digest", "payload_bytes", F.col("first.page_id").alias("refers_to"), _uri(F.col("first.page_id"), F.col("first.url")).alias("refers_uri")))
    revisits = heads.drop("url").join(first, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = tmp.table(revisits.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "refers_to", "refers_uri").distinct())
    if again.isEmpty():
        p = p.withColumn("serial", F.lit(None).cast("long"))
    else:
        numbered = tmp.table(p.join(again, same).withColumn("serial", F.monotonically_increasing_id()))
        first_of = tmp.table(numbered.groupBy("id", "digest").agg(F.min("serial").alias("named")))
        numbered = numbered.drop("id", "digest").join(first_of, same).withColumn("serial", F.nullif("serial", "named")).drop("id", "digest", "named")
        p = p.join(again, same, "left_anti").withColumn("serial", F.lit(None).cast("long")).unionByName(numbered)
    out = p.join(revisits, same, "left").drop("id", "digest")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _headers(date: str) -> tuple[Column, Column]:
    """The record's own headers, and the HTTP headers that its block begins with."""
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    is_revisit = F.col("record_type") == "revisit"
    block_bytes = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    refers = F.concat(line("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("payload_digest"))), line("WARC-Refers-To-Target-URI", F.col("refers_uri")), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE)))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_digest"), F.col("serial"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("page_id"), F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_revisit, refers).otherwise(""),
        line("X-Page-Id", number),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        F.concat(F.lit("Content-Length: "), block_bytes.cast("string"), F.lit(END)),
    )
    return head, http


def _archived(folder: str, date: str, file_bytes: int):
    """Writes the records of a task to files below the folder; returns a row for each file that is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        about = f"software: pennant{CRLF}format: WARC File Format 1.1{CRLF}".encode()
        out, name, n, size = None, "", 0, 0

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

        for batch in batches:
            for head, http, html in zip(*(batch.column(c) for c in ("head", "http", "html")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{CRLF}WARC-Date: {date}{CRLF}WARC-Filename: {name}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{END}"
                    out.write(gzip.compress(info.encode() + about + END.encode(), mtime=0))
                record = b"".join((head.as_buffer().to_pybytes(), http.as_buffer().to_pybytes(), html.as_buffer().to_pybytes() if html.is_valid else b"", END.encode()))
                out.write(gzip.compress(record, 6, mtime=0))
                n, size = n + 1, size + len(record)
                if size >= file_bytes:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    return run


def write_archive(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes one WARC/1.1 record per page to .warc.gz files below path/files, and their names to path/manifest.

    A file begins with a warcinfo record; each record is a gzip member of its own.
    """
    arrow_batches(pages.sparkSession)
    with Scratch(pages.sparkSession) as tmp:
        head, http = _headers(date)
        rows = resolved(pages, tmp, min_bytes).select(head.alias("head"), http.alias("http"), F.when(F.col("record_type") == "response", F.col("html")).alias("html"))
        written(rows.mapInArrow(_archived(f"{path}/files", date, file_bytes), "file string, records long, bytes long"), f"{path}/manifest")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by the lengths that the headers give."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError(f"record {head.get('warc-record-id')} ends early")
        yield head, block


def digest_of(told: str) -> str:
    """A SHA-1 digest in hexadecimal digits, from hexadecimal digits or base 32."""
    told = told.removeprefix("sha1:")
    return base64.b32decode(told).hex() if len(told) == 32 else told.lower()


def _row(head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    whole = head["warc-type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2] if whole else None
    told = digest_of(head["warc-payload-digest"])
    if whole and hashlib.sha1(payload).hexdigest() != told:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    number = head.get("x-page-id", "none")
    return head["warc-record-id"], None if number == "none" else int(number), head["warc-target-uri"], len(payload) if whole else None, told, head["warc-type"], head.get("warc-refers-to"), payload if payloads else None


def _parsed(folder: str, payloads: bool):
    schema = pa.schema([(n, _ARROW[t]) for n, t in _READ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for head, block in records(io.BufferedReader(gzip.GzipFile(fileobj=f))):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        rows.append(_row(head, block, payloads))
                        size += len(block) * payloads
                        if len(rows) >= READ_ROWS or size >= READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload: one row per record of the archives that write_archive left at path.

    Digests and lengths of responses are taken from the bytes read. A revisit is joined to the
    response that it refers to and gets its page_id and length; it is an error if that response
    isn't there or has another digest. payload is null for revisits, and without payloads.
    """
    files = deal(spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest"), "file")
    every = written(files.mapInArrow(_parsed(f"{path}/files", payloads), ", ".join(f"{n} {t}" for n, t in _READ)))
    answers = every.where("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("whole_bytes"), F.min("payload_digest").alias("whole_digest"))
    answers = written(answers.withColumnRenamed("record_id", "answer"))
    back = every.where("record_type = 'revisit'").drop("payload_bytes").join(answers, F.col("refers_record") == F.col("answer"), "left")
    good = F.coalesce(F.col("whole_digest") == F.col("payload_digest"), F.lit(False))
    size = F.when(good, F.col("whole_bytes")).otherwise(F.raise_error(F.concat(F.lit("no response with the payload of revisit "), "record_id")).cast("long"))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    out = every.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    return out.unionByName(back.withColumn("payload_bytes", size).select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns what the archives hold."""
    path = shared_dir(pages.sparkSession)
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""
