"""WARC archives: writing, normalising a monolithic gzip stream, reading back.

Some tools gzip a whole archive as one stream, which leaves no place to start
reading but the first.  The normaliser inflates such a stream once, in chunks,
rewrites every record as a gzip member of its own and writes a sidecar index
with each member's offset and length; the reader then seeks by that index.

Archives lie in the session's shared folder and are opened through pyarrow's
file systems, so executors on any machine reach them.  Of records with equal
payloads of at least ``min_bytes`` bytes the one with the smallest id is the
response, the others are revisits that carry no payload, only the digest, the
size and the id they refer to.  Null payloads count as empty, rows with a null
id are responses, and so are all rows of a smallest id that repeats; payloads of
any length are written whole; an empty table gives no archive.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import unique_join
from ..plans.scratch import fresh_path, written

CHUNK = 1 << 18
INDEX = "archive string, offset long, length long, page_id long, record_type string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Record(NamedTuple):
    """One WARC record: its header fields and its block."""

    fields: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def serialised(record: Record) -> bytes:
    """The record's bytes, with its two closing line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**record.fields, "Content-Length": str(len(record.block))}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + record.block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, payload_bytes: int, refers_to: int | None) -> Record:
    """A response with its payload, or a revisit that refers to one."""
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "X-Payload-Length": str(payload_bytes),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        return Record(fields, http)
    return Record(fields, http + payload)


def records(inflated: Iterator[bytes]) -> Iterator[tuple[bytes, Record]]:
    """Records, as they stand and parsed, from chunks of an inflated archive; one record is held at a time."""
    buffer, at = bytearray(), 0
    for chunk in inflated:
        buffer += chunk
        while True:
            head = buffer.find(b"\r\n\r\n", at)
            if head < 0:
                break
            lines = bytes(buffer[at:head]).decode("utf-8").split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            end = head + 4 + int(fields["Content-Length"])
            if len(buffer) < end + 4:
                break
            if not lines[0].startswith("WARC/") or buffer[end : end + 4] != b"\r\n\r\n":
                raise ValueError("not a WARC record")
            yield bytes(buffer[at : end + 4]), Record(fields, bytes(buffer[head + 4 : end]))
            at = end + 4
        del buffer[:at]
        at = 0
    if buffer:
        raise ValueError("the archive ends within a record")


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """What a gzip file holds, of one member or many, chunk by chunk."""
    engine = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = engine.decompress(data, CHUNK)
            if out:
                yield out
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                data = engine.unconsumed_tail
    while out := engine.decompress(engine.unconsumed_tail, CHUNK):
        yield out


class Monolith:
    """Writes records into a single gzip member."""

    def __init__(self, sink: BinaryIO, level: int = 1) -> None:
        self.sink, self.engine = sink, zlib.compressobj(level, zlib.DEFLATED, 31)

    def add(self, record: Record) -> None:
        self.sink.write(self.engine.compress(serialised(record)))

    def close(self) -> None:
        self.sink.write(self.engine.flush())


def normalise(source: BinaryIO, sink: BinaryIO, level: int = 1) -> Iterator[tuple[int, int, Record]]:
    """Rewrite a whole-file stream with a member per record; yields each member's offset, length and record."""
    at = 0
    for raw, record in records(inflated(source)):
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = engine.compress(raw) + engine.flush()
        sink.write(member)
        yield at, len(member), record
        at += len(member)


def page_of(record: Record) -> tuple[int | None, int, str, str, int | None]:
    """Id, payload size, digest, type and the id referred to; a response's digest is computed and held against its header."""
    number = lambda k: int(x) if (x := record.fields[k].removeprefix("<urn:page:").removesuffix(">")) else None
    said = record.fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if record.fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), int(record.fields["X-Payload-Length"]), said, "revisit", number("WARC-Refers-To")
    payload = record.block.partition(b"\r\n\r\n")[2]
    if digest(payload) != said:
        raise ValueError("a payload differs from its digest")
    return number("WARC-Record-ID"), len(payload), said, "response", None


def duplicates(pages: DataFrame, min_bytes: int, id_col: str, payload_col: str) -> DataFrame:
    """The id that each revisit refers to: columns page_id, refers_to.

    Payloads are reduced to digests before the shuffle, and the digests to their
    smallest id within each task.  A digest that many pages share is no key of
    the join, but broadcast to them.
    """
    light = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))).alias("size"))
    light = written(light.where(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes)).select("page_id", "sha"), "digests")
    first = written(light.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where(F.col("n") > 1), "firsts")
    return unique_join(light, first, ["sha"], "n").where(F.col("page_id") != F.col("refers_to")).select("page_id", "refers_to", "sha")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path there."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a monolithic archive per task, then normalise it; returns the sidecar index.

    A task writes under a name of its attempt, so a repeated task leaves no
    half-written file in use; only what the index names counts.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.cast("binary").alias("payload"), F.sha1(payload.cast("binary")).alias("own_sha"))
    refers = duplicates(pages, min_bytes, id_col, payload_col).distinct().withColumnRenamed("page_id", "other_id")
    joined = rows.join(refers, (rows.page_id == refers.other_id) & (rows.own_sha == refers.sha), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        task = TaskContext.get()
        system.create_dir(path, recursive=True)
        part = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        name = f"{path}/{part}"
        mono, out, written_any = f"{name}.mono.gz", f"{name}.warc.gz", False
        with system.open_output_stream(mono, compression=None) as sink:
            archive = Monolith(sink)
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, body, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                    archive.add(page_record(page, url, body, digest(body), len(body), refers_to))
                    written_any = True
            archive.close()
        index: list[tuple] = []
        if written_any:
            with system.open_input_stream(mono, compression=None) as source, system.open_output_stream(out, compression=None) as sink:
                for offset, length, record in normalise(source, sink):
                    index.append((f"{folder}/{part}.warc.gz", offset, length, page_of(record)[0], record.fields["WARC-Type"]))
        system.delete_file(mono)
        columns = list(zip(*index)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 4) else pa.int64()) for k, c in enumerate(columns)], ["archive", "offset", "length", "page_id", "record_type"])

    return written(joined.mapInArrow(run, INDEX), "warc-index")


def read_back(index: DataFrame) -> DataFrame:
    """Every record that the index names, read by seeking to its member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ("", None)
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at[0] != archive:
                    system, path = opened(archive)
                    at = (archive, system.open_input_file(path))
                at[1].seek(offset)
                ((_, record),) = records(inflated(io.BytesIO(at[1].read(length))))
                rows.append(page_of(record))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 3) else pa.int64()) for k, c in enumerate(columns)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("archive", "offset", "length").mapInArrow(run, READ)
