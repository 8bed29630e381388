"""WARC archives: a writer with revisit records and a salvaging reader.

Each record is a gzip member of its own. Archives are written by tasks, in files of bounded size, to a folder all executors
share. A file counts only if the manifest names it, and the manifest is what the finished tasks returned, so files of
lost or repeated tasks are never read.

The reader checks every record: gzip checksum, version line, header, lengths, closing line ends and payload digest. After a
failed check it searches for the next member (or, in a plain archive, version line) that opens well, goes on there, and logs
the bytes between as quarantined. Files can be read in byte ranges: a range owns the records that begin in it.

Pages: a null html has an empty payload; a null or odd url is left out or escaped; a null page_id has no such header and
stays null. Of rows with equal payload and equal least page_id all are responses. Other columns stay behind.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import bounded, stored
from fxspark.session import work_dir

FILE = 32 << 20  # bytes after which a task opens a new file
RANGE = 64 << 20  # bytes of a file that one task reads
LEAST = 100  # bytes of a payload from which equal ones are revisits
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
HEAD = 1 << 20  # longest header that is taken for one


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}{salt}')}>"


def _block(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def encode(page_id: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One record: a response with its payload, or without one a revisit of ``refers_to``."""
    block = _block(length) + (payload or b"")
    head = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def decode(record: bytes) -> dict:
    """Fields of a whole record; ValueError says which check failed."""
    if not VERSION.match(record):
        raise ValueError("no version line")
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of header")
    if VERSION.search(record, 1, end):
        raise ValueError("two headers")  # a cut header runs into the next record's
    head = {}
    for line in record[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    length = int(head["content-length"])
    block = record[end + 4 : end + 4 + length]
    if len(block) != length or record[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("wrong length")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    found = re.search(rb"(?im)^content-length: *(\d+)", http)
    size, kind = int(found[1]) if found else len(payload), head.get("warc-type")
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda x: int(head[x]) if re.fullmatch(r"-?\d+", head.get(x, "")) else None
    return {"page_id": number("page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
            "payload_digest": digest, "refers_to": number("refers-to-page-id"), "payload": payload if kind == "response" else None}


class _Source:
    """Bytes of a seekable file from any place on, in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(min(n, max(0, self.size - place)))

    def find(self, pattern: re.Pattern, place: int) -> int | None:
        while place < self.size:
            found = pattern.search(self.at(place, READ + 16))
            if found and found.start() < READ:
                return place + found.start()
            place += READ
        return None


def _take(source: _Source, place: int) -> tuple[bytes, int]:
    """The record that begins at a place, and where the next one begins."""
    first = source.at(place, READ)
    if first[:3] == MAGIC:
        z, out, at, chunk = zlib.decompressobj(31), [], place, first
        try:
            while chunk:
                out.append(z.decompress(chunk))
                at += len(chunk)
                if z.eof:
                    return b"".join(out), at - len(z.unused_data)
                if len(out) == 1 and not VERSION.match(out[0][:10]) and len(out[0]) >= 10:
                    raise ValueError("no version line")
                chunk = source.at(at, READ)
        except zlib.error as e:
            raise ValueError("broken member") from e
        raise ValueError("cut member")
    if not VERSION.match(first):
        raise ValueError("no record begins here")
    head = first
    while (end := head.find(b"\r\n\r\n")) < 0:
        if len(head) >= HEAD or place + len(head) >= source.size:
            raise ValueError("no end of header")
        head += source.at(place + len(head), READ)
    found = re.search(rb"(?im)^content-length: *(\d+)\r?$", head[: end + 2])
    if not found:
        raise ValueError("no length")
    total = end + 4 + int(found[1]) + 4
    if place + total > source.size:
        raise ValueError("cut record")
    return source.at(place, total), place + total


_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def records(file, size: int, start: int = 0, end: int | None = None):
    """Yields ("record", place, next, fields) and ("gap", from, to, reason) for what begins in [start, end)."""
    source, end = _Source(file, size), size if end is None else min(end, size)
    place, bad = start, None  # bad: where quarantined bytes begin, and why
    if start:
        # what lies in front of the first record that opens well belongs to the range before
        while place is not None and place < end:
            place = source.find(_BEGIN, place)
            if place is None:
                return
            try:
                decode(_take(source, place)[0])
                break
            except ValueError:
                place += 1
        if place is None or place >= end:
            return  # no record opens here, so damage in this range is an earlier range's to log
    while place is not None and place < end:
        try:
            record, following = _take(source, place)
            fields = decode(record)
        except ValueError as e:
            bad = bad or (place, str(e))
            place = source.find(_BEGIN, place + 1)
            continue
        if bad:
            yield "gap", bad[0], place, bad[1]
            bad = None
        yield "record", place, following, fields
        place = following
    if not bad and place is not None and end <= place < size:
        # damage that begins where the last record ended is skipped by the next range, so it is logged here
        try:
            decode(_take(source, place)[0])
        except ValueError as e:
            bad, place = (place, str(e)), source.find(_BEGIN, place + 1)
    if bad:
        stop = size if place is None else place
        while place is not None:
            try:
                decode(_take(source, place)[0])
                stop = place
                break
            except ValueError:
                place = source.find(_BEGIN, place + 1)
                stop = size if place is None else place
        yield "gap", bad[0], stop, bad[1]


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    if not write:
        return system.open_input_file(where)
    system.create_dir(where.rpartition("/")[0], recursive=True)
    return system.open_output_stream(where, compression=None)  # members are compressed already


_MADE = "page_id long, url string, payload_digest string, payload_bytes long, member binary"


def _responses(pages: DataFrame) -> DataFrame:
    """Each page as a compressed response record, so that what is shuffled later is compressed."""

    def run(parts):
        for part in parts:
            out = []
            for page_id, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                body = (html or "").encode()
                digest = hashlib.sha256(body).hexdigest()
                out.append((page_id, url, digest, len(body), member(encode(page_id, url, digest, len(body), body))))
            cols, kinds = list(zip(*out)) if out else [[]] * 5, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "payload_digest", "payload_bytes", "member"])

    return bounded(pages).select("page_id", "url", "html").mapInArrow(run, _MADE)


def write(pages: DataFrame, folder: str, file_bytes: int = FILE) -> DataFrame:
    """Write a record per page below ``folder``; returns the manifest (path, bytes, records)."""
    hashed = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("b"))
    sums = hashed.select("page_id", F.sha2("b", 256).alias("digest"), F.length("b").alias("n")).filter(F.col("n") >= LEAST)
    first = sums.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    made = _responses(pages)
    known = made.join(first, made["payload_digest"] == first["digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = known.select("page_id", "url", "payload_digest", "payload_bytes", F.when(revisit, F.col("first")).alias("refers_to"),
                        F.when(~revisit, F.col("member")).alias("member"))

    def run(parts):
        file, path, size, n, done = None, None, 0, 0, []
        for part in parts:
            for page_id, url, digest, length, first_id, data in zip(*(part.column(i).to_pylist() for i in range(6))):
                if data is None:
                    data = member(encode(page_id, url, digest, length, None, first_id))
                if file is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    file, size, n = _open(path, True), 0, 0
                file.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    file.close()
                    done.append((path, size, n))
                    file = None
        if file is not None:
            file.close()
            done.append((path, size, n))
        cols, kinds = list(zip(*done)) if done else [[]] * 3, [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "bytes", "records"])

    return stored(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


_READ = ("path string, place long, ends long, kind string, reason string, page_id long, url string, record_type string, "
         "payload_bytes long, payload_digest string, refers_to long, payload binary")


def read(manifest: DataFrame, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """Records (kind record) and quarantined gaps (kind gap) of the files in ``path`` and ``bytes``."""
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    fields = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    names = ["path", "place", "ends", "kind", "reason", *fields]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(parts):
        rows, held = [], 0
        for part in parts:
            for path, size, start in zip(*(part.column(i).to_pylist() for i in range(3))):
                with _open(path) as file:
                    for kind, place, ends, what in records(file, size, start, start + range_bytes):
                        if kind == "gap":
                            rows.append((path, place, ends, kind, what, *[None] * len(fields)))
                        else:
                            if not payloads:
                                what["payload"] = None
                            held += len(what["payload"] or b"")
                            rows.append((path, place, ends, kind, None, *[what[f] for f in fields]))
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(run, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages and read the archives back."""
    return read(write(pages, work_dir(pages.sparkSession, "warc")), payloads=False).filter("kind = 'record'")


def bytes_of(data: bytes) -> list:
    """Records and gaps of an archive in memory."""
    return list(records(io.BytesIO(data), len(data)))
