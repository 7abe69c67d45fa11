"""WARC archives: a writer with revisit records and a splittable reader.

The writer makes one gzip member per record, so an archive can be read from
any member on. The reader cuts archives into byte ranges. A task looks for the
gzip magic in its range, takes a place for a member only if its first bytes
decode to a WARC version line and a header block follows, and owns the records
that start inside the range; the last may end beyond it. A member that is found
is decoded to its end, so bytes within it are never taken for another.

Pages (page_id, url, html): null html is an empty payload; null url leaves the
target out; a null page_id stays null and is never what others refer to. Rows
with the same page_id and payload are all responses if they are the largest.
Payloads under 1000 bytes are all responses. An empty table gives no archives.
A member that has a WARC header but cannot be decoded to its end gives a row
with ``error`` set. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, by_bytes, open_fs

MAGIC = b"\x1f\x8b\x08"
#: Keys that rows of small payloads, which are joined with nothing, are dealt over.
SPREAD = 4096
FILES = "file string, size long"
FILES_ARROW = pa.schema([("file", pa.string()), ("size", pa.int64())])
RECORDS = "file string, at long, record_type string, page_id long, refers_to long, target string, payload_bytes long, payload_digest string, payload binary, error string"
RECORDS_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("target", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def with_responses(pages: DataFrame, work: Workspace, least: int = 1000) -> DataFrame:
    """``page_id, url, html, digest, n`` and ``response``: the page that a page's record refers to, null if it is a response itself.

    The groups of equal payloads are a written table, so that few of them are broadcast and a hot payload's rows are split by adaptive execution.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    found = own.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and response is not null")
    groups = work.save(found.select(F.col("digest").alias("key"), "response"), "equal-payloads")
    no_key = F.concat(F.lit("small "), F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)))  # equal to no digest
    joined = own.withColumn("key", F.when(F.col("n") >= least, F.col("digest")).otherwise(no_key)).join(groups, "key", "left")
    return joined.withColumn("response", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response"))).drop("key")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


URL_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def write_warc(pages: DataFrame, work: Workspace, level: int = 6) -> DataFrame:
    """Archives of ``pages``, one a task; their names and sizes."""
    folder = work.folder("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        fs, p = open_fs(path)
        with fs.open_output_stream(p, compression=None) as out:
            for batch in batches:
                for some in by_bytes(batch, "html"):
                    for row in some.to_pylist():
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = packer.compress(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["response"])) + packer.flush()
                        out.write(data)
                        size += len(data)
        yield pa.RecordBatch.from_pylist([{"file": path, "size": size}], FILES_ARROW)

    return work.save(with_responses(pages, work).select("page_id", "url", "html", "digest", "response").mapInArrow(run, FILES), "archives")


class Bytes:
    """Bytes of an open file from a place on, read in steps; ``past`` of them are done with and are dropped before more are read."""

    def __init__(self, file, at: int, step: int = 1 << 20):
        self.file, self.at, self.data, self.step, self.past = file, at, b"", step, 0

    def more(self) -> bool:
        self.data, self.at, self.past = self.data[self.past :], self.at + self.past, 0
        self.file.seek(self.at + len(self.data))
        new = self.file.read(self.step)
        self.data += new
        return bool(new)

    def find(self, mark: bytes, at: int) -> int:
        """Where in the file the mark is first found from ``at`` on, or -1."""
        found = self.data.find(mark, at - self.at)
        return found if found < 0 else self.at + found


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes | None, str]]:
    """Place, decoded bytes (None if damaged) and fault of the WARC members that start in [start, end)."""
    view = Bytes(file, start)
    at = start
    while at < end:
        while (found := view.find(MAGIC, at)) < 0:
            at = max(at, view.at + len(view.data) - len(MAGIC) + 1)
            view.past = max(0, min(at - view.at, len(view.data)))
            if at >= end or not view.more():
                return
        at = found
        if at >= end:
            return
        view.past = at - view.at
        unpack, out, used, fault = zlib.decompressobj(31), [], 0, ""
        try:
            while not unpack.eof:
                if view.past + used == len(view.data) and not view.more():
                    fault = "the archive ends within the record"
                    break
                step = view.data[view.past + used : view.past + used + (1 << 16)]
                out.append(unpack.decompress(step))
                used += len(step)
                if out and sum(map(len, out[:4])) >= 8 and not b"".join(out[:4]).startswith(b"WARC/1."):
                    out = []
                    break
        except zlib.error as e:
            fault = str(e)
        data = b"".join(out)
        if not data.startswith(b"WARC/1.") or b"\r\n\r\n" not in data:
            at += 1  # not a member
            continue
        yield at, None if fault else data, fault
        at += 1 if fault else used - len(unpack.unused_data)


def parsed(data: bytes) -> dict:
    """The columns of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    else:
        payload, length = block, None
    number = lambda k: int(fields[k]) if fields.get(k, "").lstrip("-").isdigit() else None
    row = {"record_type": fields.get("warc-type"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page"), "target": fields.get("warc-target-uri"), "error": None}
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(length[1]) if length else None, "payload_digest": said, "payload": None}
    digest = hashlib.sha1(payload).hexdigest()
    return row | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload, "error": "the payload's digest differs" if said and said != digest else None}


def read_warc(files: DataFrame, split: int = 8 << 20) -> DataFrame:
    """The records of the archives ``files`` (file, size), read by byte ranges."""
    ranges = files.filter("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                fs, path = open_fs(part["file"])
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for at, data, fault in members(f, part["at"], min(part["at"] + split, part["size"])):
                        row = parsed(data) if data is not None else dict.fromkeys(RECORDS_ARROW.names) | {"error": fault}
                        rows.append(row | {"file": part["file"], "at": at})
                        held += len(data or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS_ARROW)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORDS_ARROW)

    return ranges.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(run, RECORDS)
