"""WARC files with one gzip member for each record: a splittable reader, and a writer.

Files are cut in byte ranges that tasks read independently, though nothing marks where records start.
A task scans its range for gzip's magic bytes and accepts a candidate only if it decodes to a WARC
header. Members follow one another, so after the first the next one's place is known; where something
else lies there, scanning goes on. A task owns the members that start inside its range and reads
beyond its end to finish the last one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import filesystem

#: Bytes of a range, at least and at most; between them, a quarter of each core's share of the files.
LEAST_SPLIT, SPLIT_BYTES = 1 << 18, 64 << 20
#: Tasks that read ranges, at most for each core.
WAVES = 16
_BLOCK = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
SCHEMA = "path string, position long, headers map<string, string>, payload binary"


class _File:
    """Bytes of a file by position, with a window of blocks kept."""

    def __init__(self, handle, size: int, block: int = _BLOCK):
        self.handle, self.size, self.block = handle, size, block
        self.at, self.data = 0, b""

    def read(self, position: int, count: int) -> bytes:
        if not self.at <= position or position + count > self.at + len(self.data):
            self.handle.seek(position)
            self.at, self.data = position, self.handle.read(min(max(count, self.block), max(0, self.size - position)))
        return self.data[position - self.at : position - self.at + count]

    def find(self, position: int, end: int) -> int:
        """The next magic bytes that start in [position, end), or end."""
        while position < end:
            part = self.read(position, min(self.block, end - position + 2))
            i = part.find(_MAGIC)
            if i >= 0 and position + i < end:
                return position + i
            if len(part) < 3:
                break
            position += len(part) - 2
        return end


def _inflate(file: _File, position: int, only_head: bool = False) -> tuple[bytes, int] | None:
    """The member at position and where it ends; None if there is none or it is broken."""
    z, parts, at, size = zlib.decompressobj(31), [], position, 0
    try:
        while not z.eof:
            part = file.read(at, 1 << 16)
            if not part:
                return None  # cut short
            got = z.decompress(part)
            at += len(part)
            if size < 5 <= size + len(got) and not b"".join([*parts, got]).startswith(b"WARC/"):
                return None
            parts.append(got)
            size += len(got)
            if only_head and size >= 5:
                break
    except zlib.error:
        return None
    if size < 5:
        return None
    return b"".join(parts), at - len(z.unused_data)


def records(member: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payloads of a member's records; what isn't a record ends it."""
    at = 0
    while member.startswith(b"WARC/", at):
        end = member.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = member[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {"version": lines[0]}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers.setdefault(name.strip().lower(), value.strip())
        length = headers.get("content-length", "")
        count = int(length) if length.isdigit() else len(member) - end - 4
        yield headers, member[end + 4 : end + 4 + count]
        at = end + 4 + count
        while member.startswith(b"\r\n", at):
            at += 2


def read_range(handle, size: int, start: int, end: int, block: int = _BLOCK) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position of the member, headers, payload) of the records whose members start in [start, end)."""
    file = _File(handle, size, block)
    at, end = start, min(end, size)
    while (at := file.find(at, end)) < end:
        got = _inflate(file, at)
        if got is None:
            at += 1
            continue
        for headers, payload in records(got[0]):
            yield at, headers, payload
        at = got[1]


def read_warc(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(path, position, headers, payload) of all records of the .gz files below path.

    Headers are named in lower case, the first of a repeated one counts; "version" holds the first line.
    A member that is broken or cut short, and bytes between members, are skipped; empty files
    and folders give nothing. A record in a member of its own that stores another gzipped WARC without
    compression would yield the inner records too where a range starts within it. split_bytes: bytes of a range; see LEAST_SPLIT. Tasks take
    neighbouring ranges, as many as there are for WAVES tasks a core.
    """
    from pyarrow import fs

    files, root = filesystem(path)
    info = files.get_file_info(root)
    listed = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    listed = [f for f in listed if f.type == fs.FileType.File and f.path.endswith(".gz")]
    cores = spark.sparkContext.defaultParallelism
    if split_bytes is None:
        split_bytes = min(SPLIT_BYTES, max(LEAST_SPLIT, sum(f.size or 0 for f in listed) // (4 * cores)))
    ranges = [(f.path, f.size, i) for f in listed for i in range(0, f.size or 0, split_bytes)]
    own = spark.createDataFrame(sorted(ranges), "path string, size long, start long")
    if ranges:
        own = own.repartitionByRange(min(len(ranges), WAVES * cores), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_files, _ = filesystem(path)
        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                with own_files.open_input_file(r["path"]) as handle:
                    rows, held = [], 0
                    for position, headers, payload in read_range(handle, r["size"], r["start"], r["start"] + split_bytes):
                        rows.append((r["path"], position, list(headers.items()), payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return own.mapInArrow(run, SCHEMA)


def record(headers: dict[str, str | None], payload: bytes) -> bytes:
    """A gzipped record; headers that are None are left out, line ends in values are written as %0D and %0A."""
    lines = ["WARC/1.0"]
    for name, value in headers.items():
        if value is not None:
            lines.append(f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"Content-Length: {len(payload)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, path: str) -> int:
    """Writes (page_id, url, html) as response records, a file for each partition, and returns their number.

    A null url or page_id has no header; a null html has no block, not even HTTP's header. Rows that
    repeat are written each; other columns are left out. A task writes under a name of its own and renames the file
    when it is complete, so a repeated task replaces the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(path)
        task = TaskContext.get()
        name, n, out = f"part-{task.partitionId():05d}.warc.gz", 0, None
        part = f"{root}/.{name}.{task.taskAttemptId()}"
        for batch in batches:
            for page_id, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                if out is None:
                    files.create_dir(root)
                    out = files.open_output_stream(part)
                head = {
                    "WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "2024-01-01T00:00:00Z",
                    "WARC-Target-URI": url, "X-Page-ID": None if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response",
                }
                body = b"" if html is None else html.encode()
                block = b"" if html is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                out.write(record(head, block))
                n += 1
        if out is not None:
            out.close()
            files.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def pages_from_warc(records: DataFrame) -> DataFrame:
    """(page_id, url, html) of response records: the body behind HTTP's header, null without one; page_id null without its header."""
    head = F.expr("locate('\r\n\r\n', cast(payload AS string))")
    html = F.when(head > 0, F.expr("cast(payload AS string)").substr(head + 4, F.length("payload")))
    own = records.where(F.element_at("headers", "warc-type") == "response")
    return own.select(F.element_at("headers", "x-page-id").cast("long").alias("page_id"), F.element_at("headers", "warc-target-uri").alias("url"), html.alias("html"))
