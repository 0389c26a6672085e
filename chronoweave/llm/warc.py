"""WARC archives written and read as streams of chunks.

Payloads travel as a chunked record table in both directions, rows (record, chunk number, data).  The
source rows are cut into chunks before they leave Spark; the writer gives each record its own gzip member
and feeds chunk after chunk to the compressor and a running digest.  The reader yields the chunks again,
each with the digest so far, so a record of any size needs bounded memory beyond its source row.  Lengths
and digests of the result come from the chunk rows read back; a revisit takes those of the response that
it refers to.  Files go below a shared folder through Arrow's file systems, under a name of the
task attempt's own; a table of segments, made by the job that committed, says which files and byte
ranges count, so retried and speculative attempts leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Stage, join_checked, partitions

CHUNK = 1 << 18
SEGMENT = 4 << 20  # bytes of an archive that one reading task takes at a time
DATE = "2024-01-01T00:00:00Z"
_SEGMENTS = "path string, start long, stop long"
_CHUNKS = ("record string, page_id long, chunk int, last boolean, data binary, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, url string")


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _head(page_id, url, refers_to, size: int, digest: str) -> bytes:
    """The WARC and HTTP header blocks of a record."""
    name = "<urn:x-page:{}>".format("null" if page_id is None else page_id)
    url = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or name[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(root: str):
    """Write chunk rows, those of a record in order, and yield the segments of the files."""

    def run(batches):
        fs = out = z = None
        start = at = 0
        rows = []
        for b in batches:
            col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            fields = ("page_id", "url", "refers_to", "size", "sha", "chunk", "chunks")
            for i, (page_id, url, refers_to, size, sha, chunk, chunks) in enumerate(zip(*(col[k].to_pylist() for k in fields), strict=True)):
                if out is None:
                    fs, folder = _filesystem(root)
                    fs.create_dir(folder, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                parts = []
                if chunk == 0:
                    z, run_sha, done = zlib.compressobj(1, wbits=31), hashlib.sha1(), 0
                    parts.append(z.compress(_head(page_id, url, refers_to, size, b32(bytes.fromhex(sha)))))
                if refers_to is None:
                    data = memoryview(col["data"][i].as_buffer())
                    run_sha.update(data)
                    done += len(data)
                    parts.append(z.compress(data))
                if chunk == chunks - 1:
                    if refers_to is None and (done != size or run_sha.hexdigest() != sha):
                        raise ValueError(f"chunks of page {page_id} are not its payload")
                    parts += [z.compress(b"\r\n\r\n"), z.flush()]
                at += sum(map(len, parts))
                out.write(b"".join(parts))
                if chunk == chunks - 1 and at - start >= SEGMENT:
                    rows.append((f"{root}/{name}", start, at))
                    start = at
        if out is not None:
            out.close()
            if at > start:
                rows.append((f"{root}/{name}", start, at))
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "start", "stop"])

    return run


class _Member:
    """Reads one archive's byte range as a run of gzip members, a bounded piece at a time."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.left, self.raw, self.buf, self.z = file, stop - start, b"", b"", None
        file.seek(start)

    def _fill(self) -> bool:
        """More bytes of the member; False at its end."""
        if self.z.eof:
            return False
        if not self.z.unconsumed_tail and not self.raw:
            self.raw = self.file.read(min(self.left, CHUNK))
            self.left -= len(self.raw)
            if not self.raw:
                raise EOFError("archive ends within a record")
        src, self.raw = self.z.unconsumed_tail + self.raw, b""
        self.buf += self.z.decompress(src, CHUNK)
        if self.z.eof:
            self.raw = self.z.unused_data
        return True

    def next(self) -> bool:
        """Move to the next member, if there is one."""
        if self.z is not None:
            while self._fill():
                self.buf = b""
        if not self.raw and not self.left:
            return False
        self.z, self.buf = zlib.decompressobj(31), b""
        return True

    def block(self) -> list[str]:
        """Header lines to the blank line."""
        while b"\r\n\r\n" not in self.buf and self._fill():
            pass
        head, _, self.buf = self.buf.partition(b"\r\n\r\n")
        return head.decode("utf-8", "replace").split("\r\n")

    def body(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in pieces of at most CHUNK."""
        while size:
            while len(self.buf) < min(size, CHUNK) and self._fill():
                pass
            piece, self.buf = self.buf[: min(size, CHUNK)], self.buf[min(size, CHUNK):]
            if not piece:
                raise EOFError("record is shorter than its length says")
            size -= len(piece)
            yield piece


def _number(name: str | None) -> int | None:
    tail = name.rsplit(":", 1)[-1].rstrip(">") if name else "null"
    return None if tail == "null" else int(tail)


def _read(payload: bool):
    fields = [
        ("record", pa.string()), ("page_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("url", pa.string())]
    schema = pa.schema(fields)

    def rows(path, start, stop):
        fs, place = _filesystem(path)
        with fs.open_input_file(place) as f:
            m, number = _Member(f, start, stop), 0
            while m.next():
                head = dict(x.split(": ", 1) for x in m.block()[1:])
                http = dict(x.split(": ", 1) for x in m.block()[1:])
                kind, size = head["WARC-Type"], int(http["Content-Length"])
                own = (kind, _number(head.get("WARC-Refers-To")), head["WARC-Target-URI"])
                page, said = _number(head["WARC-Record-ID"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                record, number = f"{path}#{start}#{number}", number + 1
                sha, done, k = hashlib.sha1(), 0, 0
                if kind == "revisit" or not size:
                    yield record, page, 0, True, b"" if payload and kind != "revisit" else None, size, said, *own
                    continue
                for piece in m.body(size):
                    sha.update(piece)
                    done += len(piece)
                    if done == size and b32(sha.digest()) != said:
                        raise ValueError(f"payload of page {page} does not match its digest")
                    if payload or done == size:
                        yield record, page, k, done == size, piece if payload else None, done, b32(sha.digest()), *own
                    k += 1

    def batch(held):
        cols = zip(zip(*held, strict=True), fields, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in cols], schema=schema)

    def run(batches):
        for b in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, weight = [], 0
                for r in rows(path, start, stop):
                    held.append(r)
                    weight += 200 + len(r[4] or b"")
                    if weight > 16 * CHUNK:
                        yield batch(held)
                        held, weight = [], 0
                if held:
                    yield batch(held)

    return run


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, same, refers_to`` of the rows that repeat the payload (by its SHA-256, ``same``) of a page
    with a larger id; payloads shorter than ``least`` bytes are never revisits."""
    seen = pages.where(F.col("size") >= least).select("page_id", "same").distinct()
    last = seen.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return seen.join(last, "same").where("page_id < refers_to").select("page_id", "same", "refers_to")


def write_archives(pages: DataFrame, stage: Stage, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages(page_id, url, html)``; the segments' table.

    A null html is an empty payload and a null url names the record itself.  Rows that repeat a page_id
    and its payload are all responses or all revisits; with different payloads each is judged by its own.
    A row without an id is a response.  Other columns are ignored.  An empty table gives no archive.
    """
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    src = src.withColumns({"size": F.octet_length("html").cast("long"), "same": F.unhex(F.sha2("html", 256))})
    again = stage.put(revisits(src, least), "revisits")
    src = join_checked(src, again, ["page_id", "same"], "left", 64)
    chunks = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK))).otherwise(1).cast("int")
    src = src.select("page_id", "url", "refers_to", "size", F.sha1("html").alias("sha"), "html", chunks.alias("chunks"))
    src = src.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    data = F.when(F.col("refers_to").isNull(), F.substring("html", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)))
    src = src.select("page_id", "url", "refers_to", "size", "sha", "chunk", "chunks", data.alias("data"))
    return stage.put(src.mapInArrow(_write(stage.path("warc")), _SEGMENTS), "segments")


def read_archives(segments: DataFrame, payload: bool = True) -> DataFrame:
    """The chunked record table: one row per chunk, or without ``payload`` each record's last row only."""
    n = max(1, partitions(segments.sparkSession))
    return segments.repartition(n, "path", "start").mapInArrow(_read(payload), _CHUNKS)


def records(chunks: DataFrame, stage: Stage) -> DataFrame:
    """A row per record of a chunk table: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's length is that of its chunks, its digest the last one's; a revisit takes both from the
    response that it names, and a revisit without one is an error."""
    size = F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).alias("payload_bytes")
    digest = F.max(F.when(F.col("last"), F.col("payload_digest"))).alias("payload_digest")
    out = chunks.groupBy("record").agg(F.first("page_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest, F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"))
    out = stage.put(out, "records")
    again = out.where("record_type = 'revisit'")
    held = out.where("record_type = 'response'").join(again.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
    held = stage.put(held.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("bytes")).distinct(), "referred")
    again = join_checked(again, held, ["refers_to", "payload_digest"], "left", 64)
    found = F.coalesce("bytes", F.raise_error(F.lit("a revisit names no response with its digest")).cast("long"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return out.where("record_type = 'response'").select(cols).unionByName(again.withColumn("payload_bytes", found).select(cols))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the archives, read their chunks back; a row per record: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``."""
    stage = Stage(pages.sparkSession, "warc")
    return records(read_archives(write_archives(pages, stage, least)), stage)
