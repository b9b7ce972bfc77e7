"""WARC archives: a writer, and a splittable reader.

The writer puts each page into a gzip member of its own, in one archive per task, in the shared folder. Of pages
with equal payloads the one with the largest id is a response, the others are revisits that refer to it.
Each attempt of a task writes a file of its own name; the manifest lists the files of the attempts that
counted, so a lost executor leaves a stray file at most.

The reader splits archives into byte ranges. A task scans its range for gzip magic, and takes a candidate for
a member only if what it holds begins with a WARC header that decodes. It owns the records that *start* inside
its range, and reads the last of them to its end beyond. From one record on, the next is at the end of
its member, so the scan is needed once a range, or after damage. A member whose check sum or
length is wrong is no record.

Files are opened with ``pyarrow.fs`` by the address of the shared folder, so the folder may be on any store
that it knows (file, hdfs, s3, gs).

Defined results: null html is an empty payload; a null page id stays null (such a page refers to a copy with
an id, but is never referred to); rows that share the largest id are all responses; an empty table gives no
archive; extra columns are ignored; payloads under ``min_bytes`` are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from farelake.llm.tables import shared_path, stored

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
SPLIT_BYTES = 4 << 20
BLOCK = 1 << 20
_URN = "<urn:page:%s>"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for a response).

    Payloads are compared by SHA-1, in narrow rows that are counted before they move; the pages themselves
    move once, by their ids, whatever the size of a group of copies.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    narrow = stored(rows.select("page_id", "sha", (F.octet_length("html") >= min_bytes).alias("compared")).where("compared"), "payloads")
    groups = narrow.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null").select("sha", "keeper")
    copies = narrow.join(groups, "sha").where("page_id is null or page_id < keeper").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "keeper").distinct()
    of = rows["page_id"].eqNullSafe(copies["_id"]) & (rows["sha"] == copies["_sha"])
    return rows.join(copies, of, "left").select("page_id", "url", "html", F.col("keeper").alias("refers_to"))


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    name = "" if page_id is None else page_id
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _URN % name), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", len(payload))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _URN % refers_to)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    machine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return machine.compress(head.encode() + block + b"\r\n\r\n") + machine.flush()


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", address))


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives; the manifest: file, bytes, records."""
    typed = with_types(pages, key, url, html, min_bytes)
    folder = folder or shared_path(pages.sparkSession, "warc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, size, records = None, "", 0, 0
        for batch in batches:
            for row in range(len(batch)):
                page_id, link, text, refers_to = (batch.column(i)[row].as_py() for i in range(4))
                if out is None:
                    store, root = _opened(folder)
                    store.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, file = store.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}"
                data = member(page_id, link, text.encode(), refers_to)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [size], "records": [records]})

    return stored(typed.mapInArrow(put, "file string, bytes long, records long"), "manifest")


class Window:
    """Bytes of a file from some place on, read in blocks as they are needed."""

    def __init__(self, source: pa.NativeFile, at: int, size: int):
        self.source, self.start, self.size, self.data = source, at, size, bytearray()
        source.seek(at)

    def upto(self, end: int) -> bool:
        """Have the bytes before ``end``; False if the file ends earlier."""
        while self.start + len(self.data) < min(end, self.size):
            self.data += self.source.read(BLOCK)  # grows in place
        return self.start + len(self.data) >= end

    def find(self, at: int, end: int) -> int:
        """The first magic that starts in at..end-1, or -1; what lies before ``at`` is let go of."""
        while at < end:
            if at - self.start > BLOCK:
                self.data, self.start = self.data[at - self.start :], at
            stop = min(at + BLOCK, end) + len(MAGIC) - 1
            self.upto(stop)
            k = self.data.find(MAGIC, at - self.start, stop - self.start)
            if k >= 0:
                return self.start + k
            at = min(at + BLOCK, end)
        return -1


def record_at(w: Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the member at ``at``; None if no record starts there."""
    machine, out, done = zlib.decompressobj(31), [], at
    while not machine.eof:
        w.upto(done + (1 << 16))
        part = w.data[done - w.start : done - w.start + (1 << 16)]
        if not part:
            return None
        try:
            out.append(machine.decompress(part))
        except zlib.error:
            return None
        if done == at and not out[0].startswith(b"WARC/1."):
            return None
        done += len(part) - len(machine.unused_data)
    head, mark, body = b"".join(out).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = headers.get("content-length", "")
    if not mark or not length.isdigit() or len(body) != int(length) + 4:
        return None
    return headers, body[:-4], done


def records(source: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in start..end-1."""
    w, at = Window(source, start, size), start
    while (at := w.find(at, end)) >= 0:
        got = record_at(w, at)
        if got is None:
            at += 1
            continue
        yield at, got[0], got[1]
        at = got[2]


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record: file, at, page_id, url, record_type, payload_bytes, payload_digest, refers_to and html (null
    for a revisit). A response's payload is held against its recorded digest."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    splits = manifest.where("bytes > 0").select("file", "bytes", starts)
    n_splits = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    # rows of splits are tiny: without a number of partitions they would all be merged into one task
    spark = manifest.sparkSession
    n_tasks = min(n_splits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    splits = splits.select("file", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"), "bytes").repartition(n_tasks, "file", "start")
    schema = "file string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        arrow = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "))])
        for batch in batches:
            for split in batch.to_pylist():
                store, path = _opened(split["file"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for at, h, block in records(source, split["start"], split["end"], split["bytes"]):
                        rows.append((split["file"], at, *page_of(h, block)))
                        held += len(block)
                        if held > BLOCK:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    return splits.mapInArrow(take, schema)


def page_of(h: dict[str, str], block: bytes) -> tuple:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, html of a record."""
    ids = [re.fullmatch(r"<urn:page:(-?\d*)>", h.get(name, "")) for name in ("warc-record-id", "warc-refers-to")]
    page_id, refers_to = (int(m[1]) if m and m[1] else None for m in ids)
    url = h.get("warc-target-uri")
    url = None if url is None else re.sub(r"%([0-7][0-9A-F])", lambda m: chr(int(m[1], 16)), url)
    written = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] != "response":
        return page_id, url, h["warc-type"], int(h["x-payload-length"]), written, refers_to, None
    payload = block.partition(b"\r\n\r\n")[2]
    if digest(payload) != written:
        raise ValueError(f"page {page_id}: the payload does not have its digest")
    return page_id, url, "response", len(payload), written, None, payload.decode()
