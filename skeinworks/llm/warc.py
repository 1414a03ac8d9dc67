"""WARC archives: a gzip member per record, written by tasks and read back sequentially.

Equal payloads are stored once: the record of the smallest page_id is the response, the others are revisits that
refer to it. The reader inflates a member at a time in small steps, frames records by Content-Length and verifies
block and payload digests, so it needs little memory however large an archive is.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.exact_dedup import grouped
from skeinworks.llm.store import new_folder, stable

#: A task begins another archive beyond this size. Bytes that the reader takes at a time.
ARCHIVE_BYTES, STEP = 256 << 20, 1 << 16
LEVEL = 5
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC-Date of every record: rows have no time of capture, and the same rows give the same archives.
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{copy}')}>"


def _one_line(url: str | None) -> str:
    """A header value without line ends; percent signs are escaped, so it can be read back."""
    return (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, copy: int, url: str | None, payload: bytes | None, payload_digest: str, size: int, refers_to=None) -> bytes:
    """A record as one gzip member; without a payload a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    headers = {
        "WARC-Type": "revisit" if payload is None else "response", "WARC-Record-ID": _uri(page_id, copy), "WARC-Date": DATE, "WARC-Target-URI": _one_line(url), "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block)), "Page-ID": "" if page_id is None else str(page_id), "Has-URL": str(int(url is not None)),
    }
    if payload is None:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _uri(refers_to, 1), "Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    data = stream.read(STEP)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while True:
            parts.append(inflate.decompress(data))
            if inflate.eof:
                data = inflate.unused_data or stream.read(STEP)
                break
            data = stream.read(STEP)
            if not data:
                raise ValueError("an archive ends within a member")
        yield b"".join(parts)


def parse(member: bytes) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of a record; raises where it is damaged."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(headers["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("a block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(http.lower().partition(b"content-length: ")[2].partition(b"\r\n")[0])
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != stated or headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("a payload does not match its digest")
    number = lambda x: int(x) if x else None
    url = headers["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if headers["Has-URL"] == "1" else None
    return number(headers["Page-ID"]), url, headers["WARC-Type"], number(headers.get("Refers-To-Page-ID", "")), stated, headers["WARC-Payload-Digest"][5:], None if revisit else payload


def _responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, size, member): each page as a response record, so that what is shuffled is compressed already."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                size, made = [], []
                for page_id, url, html in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    payload = html.encode()
                    size.append(len(payload))
                    made.append(record(page_id, 1, url, payload, digest(payload), len(payload)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(size, pa.int64()), pa.array(made, pa.binary())], names=["page_id", "url", "key", "size", "member"])

    return pages.mapInArrow(make, "page_id long, url string, key string, size long, member binary")


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as rows of page_id, url, key (SHA-1), size, member, copy, revisit, refers_to.

    ``copy`` numbers the rows that repeat a page_id. Of equal payloads of ``least`` bytes or more the smallest page_id
    is the response (a null one only where there is no other), and of rows that repeat it the first. A null html
    counts as empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1(F.col("html").cast("binary")))
    keys = stable(rows.select("page_id", "key", F.octet_length("html").alias("size")))
    first = grouped(keys.filter(F.col("size") >= least), "key", F.struct(F.bitwise_not("page_id").alias("id"))).select("page_id", "key", F.bitwise_not("best.id").alias("first"))
    small = keys.filter(F.col("size") < least).select("page_id", "key", F.col("page_id").alias("first"))
    place = {"_id": F.coalesce("page_id", F.lit(0)), "_null": F.isnull("page_id")}  # plain keys: the join and the window then share one shuffle of the records
    firsts = first.unionByName(small).distinct().withColumns(place).drop("page_id")
    joined = _responses(rows).withColumns(place).join(firsts.hint("merge"), ["_id", "_null", "key"])
    joined = joined.withColumn("copy", F.row_number().over(Window.partitionBy("_id", "_null", "key").orderBy("url")))
    revisit = ~(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1)) & (F.col("size") >= least)
    return joined.select("page_id", "url", "key", "size", "member", "copy", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``deduplicated`` pages to WARC archives in ``folder``, shared by all executors; (path, records) of each.

    A task writes under a name of its own and then renames, and a task that runs again writes the same, so lost
    executors leave no partial or double archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        context = TaskContext.get()
        out, done, n, path = None, 0, 0, ""

        def closed():
            out.close()
            files.move(f"{path}.{context.taskAttemptId()}", path)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, key, size, member, copy, revisit, refers_to in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if out is None:
                    path = f"{base}/part-{context.partitionId():06d}-{done:04d}.warc.gz"
                    out = files.open_output_stream(f"{path}.{context.taskAttemptId()}", compression=None)
                if revisit or copy > 1:
                    payload = None if revisit else parse(next(members(io.BytesIO(member))))[-1]
                    member = record(page_id, copy, url, payload, base64.b32encode(bytes.fromhex(key)).decode(), size, refers_to)
                out.write(member)
                n += 1
                if out.tell() > ARCHIVE_BYTES:
                    yield closed()
                    out, done, n = None, done + 1, 0
        if out is not None:
            yield closed()

    return stable(pages.mapInArrow(write, "path string, records long"))


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of the archives in column ``path``, with their payloads (null for revisits)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, own = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with files.open_input_stream(own, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        size += len(member)
                        if size > 1 << 22:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return paths.select("path").mapInArrow(read, _RECORD)


def archived(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """``pages`` written to archives and read back, all records. An empty table gives no archive and no rows."""
    return read_archives(write_archives(deduplicated(pages, least), folder or new_folder(pages.sparkSession, "warc")))
