"""WARC archives: a writer with revisit records, and a splittable reader.

The writer gives each input partition one archive of gzip members, a record each, under a name that depends on the
partition alone; it is written aside and then renamed, so a task that runs again leaves the same file. Of records
with equal payloads of at least ``least_bytes`` the one with the largest page_id is a response and the others revisit
it. The reader plans byte ranges from file sizes alone. A task looks for gzip magic in its range, takes a candidate
for a member only if it decodes to the head of a WARC record, and owns the records that start inside its range,
reading the last one past the range's end. From an owned record it goes straight on to the next member, so bytes
inside records are never taken for members. Ranges are dealt out to as many tasks as their bytes call for. Digest and
length of a response are computed from the payload that was read, and must be the ones its header names; a revisit
holds no payload, so its header's are returned.

Rows: a null url or html counts as empty. A null page_id sorts below all others and comes back null. Rows that repeat
a page_id and a payload with the largest id are all responses. An empty table leaves no archive and no records.
Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import scratch_dir, table, tidy

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
#: Most tasks that ranges are dealt out to; beyond it a task takes several ranges, one after another.
MOST_TASKS = 50_000
READ_BYTES = 1 << 20
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
CRLF = b"\r\n"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. The payload of a revisit stays in the record it refers to; its size and digest are named."""
    digest = digest32(payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    else:
        body += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head) + CRLF + body + CRLF + CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _page(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(CRLF + CRLF)
    said = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(said["Content-Length"])]
    revisit = said["WARC-Type"] == "revisit"
    size, digest, payload = int(said["X-Payload-Length"]), said["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if not revisit:
        payload = body.partition(CRLF + CRLF)[2]
        if (len(payload), digest32(payload)) != (size, digest):
            raise ValueError(f"{said['WARC-Record-ID']}: the payload isn't the one its header names")
    return _page(said["WARC-Record-ID"]), said["WARC-Target-URI"], said["WARC-Type"], _page(said.get("WARC-Refers-To")), size, digest, payload


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """(path, size) of the archives of pages(page_id, url, html), written when this is run."""
    text = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = text.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("long_enough", F.octet_length("html") >= least_bytes)
    small = keyed.where("long_enough").select("page_id", "sha")
    first = small.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    # (page, payload) pairs of revisits; their rows, not their pages, meet at a payload that many share
    again = small.join(first, "sha").where("not page_id <=> refers_to").distinct().select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to", F.lit(True).alias("revisit"))
    marked = keyed.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")) & F.col("long_enough"), "left").select("page_id", "url", "html", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers, revisit = (c[i].as_py() for c in batch.columns)
                out = out or fs.open_output_stream(part)
                out.write(record(page, url, html.encode(), refers, bool(revisit)))
        if out:
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([fs.get_file_info(name).size])], names=["path", "size"])

    return marked.mapInArrow(tidy(run), "path string, size long")


class Bytes:
    """A file read forward in pieces; ``at(p)`` gives what is buffered from p on."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """At least n bytes from place, less at the end of the file."""
        if not self.base <= place <= self.base + len(self.data):
            self.base, self.data = place, b""
        if place > self.base:
            self.data, self.base = self.data[place - self.base :], place
        while len(self.data) < n and (more := min(READ_BYTES, self.size - self.base - len(self.data))) > 0:
            self.file.seek(self.base + len(self.data))
            self.data += self.file.read(more)
        return self.data


def member_at(source: Bytes, place: int) -> tuple[bytes, int] | None:
    """The record that a gzip member at place holds, and where the member ends; None if there is no such member."""
    unpacker, out, at, first = zlib.decompressobj(31), [], place, True
    try:
        while not unpacker.eof:
            piece = source.at(at, 1)[: READ_BYTES // 4]
            if not piece:
                return None
            got = unpacker.decompress(piece)
            at += len(piece)
            if got:
                if first and not b"WARC/1.".startswith(got[:7]) and not got.startswith(b"WARC/1."):
                    return None
                first = False
                out.append(got)
    except zlib.error:
        return None
    raw = b"".join(out)
    return (raw, at - len(unpacker.unused_data)) if raw.startswith(b"WARC/1.") else None


def records_in(source: Bytes, start: int, end: int) -> Iterator[bytes]:
    """Records whose members start in [start, end)."""
    place, chained = start, False
    while place < end:
        if not chained:
            seen = source.at(place, READ_BYTES)
            hit = seen.find(MAGIC)
            if hit < 0:
                if place + len(seen) >= source.size:
                    return
                place += len(seen) - 2
                continue
            place += hit
            if place >= end:
                return
        found = member_at(source, place)
        if found is None:
            chained, place = False, place + 1
            continue
        yield found[0]
        place, chained = found[1], True


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives of a (path, size) manifest; see RECORD."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.select("path", "size", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        fs, _ = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(r["path"]) as file:
                    rows, held = [], 0
                    for raw in records_in(Bytes(file, r["size"]), r["start"], r["end"]):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # the rows of ranges are tiny, so their number must say how far they are spread
    tasks = manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes))).collect()[0][0] or 1
    return ranges.repartition(int(min(tasks, MOST_TASKS))).mapInArrow(tidy(run), RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    made = write_archives(table(spark, sf_dir, "pages"), folder).collect()  # a row for each archive
    manifest = spark.createDataFrame(made, "path string, size long")
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (
  SELECT page_id, html, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(sha1(html), i, 1)) - 1), 4, '0')), '') AS bits, max(page_id) OVER (PARTITION BY html) AS top
  FROM p
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CASE WHEN substr(bits, i * 5 + j, 1) = '1' THEN power(2, 5 - j) ELSE 0 END)) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM h
"""
