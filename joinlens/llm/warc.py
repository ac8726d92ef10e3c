"""WARC archives, index first.

Writing makes one gzip member for each record, in files of bounded size, and an index row for each
record: file, offset, length, URL and digest. Reading takes index rows (all or selected ones), deals stretches of the files to as many
tasks as their bytes ask for, sorts the rows by file and offset, joins close byte ranges into one read, and parses the records.

Records with equal payloads of at least ``least`` bytes are written once: the smallest page_id's record is
the response, the others are revisits that refer to it.

Cases: null html is an empty payload. A null url is left out of the record's header. Rows that repeat the
response's page_id and payload are responses too; among rows with a null page_id and equal payloads, which
nothing can refer to, all are responses. An empty table gives no files, an empty index and no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import saved, table, text_of, work_dir

LEAST_SHARED = 100
FILE_BYTES = 64 << 20
#: Ranges this close are read together, up to READ_BYTES at once.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes of archives that one task reads, about.
TASK_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, Spark's default one if it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _name(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_name(page_id)}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_name(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of one gzip member; checks a response's payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI")


def write(pages: DataFrame, folder: str, least: int = LEAST_SHARED) -> DataFrame:
    """Write the archives and return their index, itself a table in the shared folder.

    Each attempt of a task writes files under new names, and only the index of the attempt that counted
    names them, so a lost executor or a second attempt does no harm.
    """
    folder = qualified(pages.sparkSession, folder)
    html = F.encode(text_of(pages, "html"), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    # Only digests that occur twice: a row for each of them, whatever the number of copies.
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    marked = rows.join(first, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        out, file, at = None, "", 0
        try:
            for batch in batches:
                index: list[tuple] = []
                for r in batch.to_pylist():
                    revisit = r["first"] is not None and r["first"] != r["page_id"]
                    member = record(r["page_id"], r["url"], r["payload"], r["digest"], r["first"], revisit)
                    if out is None or at + len(member) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        file, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(file, compression=None)
                    out.write(member)
                    index.append((file, at, len(member), r["page_id"], r["url"], r["digest"], "revisit" if revisit else "response"))
                    at += len(member)
                if index:
                    yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return saved(marked.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name. Tasks are as many as the records' bytes ask for, not the index's."""
    spark = index.sparkSession
    folder = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)

        def fetch(ranges: list[tuple[int, int]], source: fs.NativeFile) -> Iterator[tuple]:
            start = ranges[0][0]
            source.seek(start)
            data = memoryview(source.read(ranges[-1][0] + ranges[-1][1] - start))
            for offset, length in ranges:
                yield parse(data[offset - start : offset - start + length])

        name, source, ranges = None, None, []
        for batch in batches:
            out: list[tuple] = []
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ranges and (file != name or offset - sum(ranges[-1]) > GAP_BYTES or offset + length - ranges[0][0] > READ_BYTES):
                    out += fetch(ranges, source)
                    ranges = []
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(file)
                ranges.append((offset, length))
            if ranges:
                out += fetch(ranges, source)
                ranges = []
            if out:
                yield _batch(out, RECORD)
        if source is not None:
            source.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    ordered = index.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    named = [f.split() for f in fields.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), named, strict=True)], [n for n, _ in named])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> d.page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
