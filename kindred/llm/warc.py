"""WARC 1.1 archives: a writer with revisit records, and a salvage reader.

The writer makes each record a gzip member of its own. Of records with equal
payloads one is a response and the others are revisits without the payload. The
reader checks each member (gzip's checksum) and each record (version line, header,
length, block digest). Where a check fails it searches on for the next gzip member
or version line that passes all checks, goes on from there, and logs the bytes in
between as a gap.

How Spark runs it. Digests of payloads are grouped and joined back as narrow rows;
pages are shuffled once by digest, and each partition writes archives of at most
``archive_bytes`` to the shared folder under a name that its place gives, by way of
a temporary name, so that a task that runs again writes the same file. Archives are
listed with Spark's binaryFile source; small ones are read by it, and others in pieces.

Defined cases: null html is an empty payload; a null url becomes ``urn:page:<id>``;
rows with equal payload and page_id are all responses if that page_id is the
largest; an empty table gives no archive and no rows; page_id keeps its type; a null page_id
has a record id of its own and is read back as null, last in the order of ids; a page of any
length is one record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import storage

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
HEADER_END = re.compile(rb"\r\n\r\n|\r\nWARC/\d\.\d\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def urn(page: object) -> str:
    """A record id that gives back the page's id as text; there is one for no id."""
    return "urn:no-page" if page is None else f"urn:page:{quote(str(page), safe='')}"


def record(page: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """One record: an HTTP response with the payload, or its revisit."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or urn(page)
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{urn(page)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{urn(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class Held:
    """Bytes in memory, as ``salvage`` reads them."""

    def __init__(self, data: bytes) -> None:
        self.view, self.size = memoryview(data), len(data)

    def read(self, at: int, size: int) -> bytes:
        return bytes(self.view[at : at + size])


class Stream:
    """A file that is read in pieces; the last one is kept, longer ones are not."""

    def __init__(self, file, piece: int = 4 << 20) -> None:
        self.file, self.size, self.piece, self.start, self.held = file, file.size(), piece, 0, b""

    def read(self, at: int, size: int) -> bytes:
        size = max(0, min(size, self.size - at))
        if self.start <= at and at + size <= self.start + len(self.held):
            return self.held[at - self.start : at - self.start + size]
        self.file.seek(at)
        if size > self.piece:
            return self.file.read(size)
        self.start, self.held = at, self.file.read(self.piece)
        return self.held[:size]


def header_end(source, at: int, piece: int = 1 << 20) -> tuple[int, bool]:
    """The first empty line or version line after a place, and whether it is an empty line; the end if there is none.
    Pieces grow from small ones, so that version lines one after another are read about once."""
    size = min(piece, 1 << 10)
    while at < source.size:
        window = source.read(at, size)
        if m := HEADER_END.search(window):
            return at + m.start(), m[0] == b"\r\n\r\n"
        if at + len(window) >= source.size:
            break
        at += max(1, len(window) - 16)  # an end may lie over the end of the piece
        size = min(piece, size * 4)
    return source.size, False


def parse_record(source, at: int) -> tuple[dict, bytes, int] | str:
    """Header, block and end of the record that starts at a place; or why there is none. What the header says of the
    length is checked at the stated end before the block is read."""
    if source.read(at, 5) != b"WARC/":
        return "no version line"
    end, empty = header_end(source, at + 5)
    if not empty:
        return "bad header" if end < source.size else "no end of header"  # another record begins before it ends
    try:
        lines = source.read(at, end - at).decode().split("\r\n")
    except UnicodeDecodeError:
        return "header is not UTF-8"
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = head.get("content-length", "")
    if not re.fullmatch(r"WARC/\d\.\d", lines[0]) or not re.fullmatch(r"[0-9]{1,18}", length):
        return "bad header"
    start, stop = end + 4, end + 4 + int(length)
    if source.read(stop, 4) != b"\r\n\r\n":
        return "bad length"
    block = source.read(start, stop - start)
    if (said := head.get("warc-block-digest")) and said != "sha1:" + base32_sha1(block):
        return "bad digest"
    return head, block, stop + 4


def member_end(source, at: int, piece: int) -> int | str:
    """The end of the gzip member that starts at a place, all of it checked and nothing of it kept; or why there is none."""
    d = zlib.decompressobj(31)
    while not d.eof:
        window = source.read(at, piece)
        if not window:
            return "cut member"
        at += len(window)
        try:
            d.decompress(window, piece)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, piece)
        except zlib.error as e:
            return f"bad member: {e}"[:60]
    return at - len(d.unused_data)


def read_at(source, at: int, small: int = 1 << 16, piece: int = 1 << 20) -> tuple[list[tuple[dict, bytes]], int] | str:
    """Records of the gzip member or the plain record at a place, and where it ends. A member that goes beyond a small
    piece is checked first and then held."""
    if source.read(at, 3) != GZIP:
        found = parse_record(source, at)
        return found if isinstance(found, str) else ([found[:2]], found[2])
    d = zlib.decompressobj(31)
    window = source.read(at, small)
    try:
        plain = d.decompress(window, piece)
    except zlib.error as e:
        return f"bad member: {e}"[:60]
    end = at + len(window) - len(d.unused_data)
    if not d.eof:
        end = member_end(source, at, piece)
        if isinstance(end, str):
            return end
        plain = zlib.decompress(source.read(at, end - at), 31)
    out, inner, whole = [], 0, Held(plain)
    while inner < len(plain):
        found = parse_record(whole, inner)
        if isinstance(found, str):
            return f"in member: {found}"
        out.append(found[:2])
        inner = found[2]
    return out, end


SIGNS = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")


def next_sign(source, at: int, piece: int = 1 << 20) -> int:
    """The next place that looks like the start of a member or a record, or the end."""
    while at < source.size:
        window = source.read(at, piece)
        if m := SIGNS.search(window):
            return at + m.start()
        at += max(1, len(window) - 16)  # a sign may lie over the end of the piece
    return source.size


def salvage(data) -> Iterator[tuple]:
    """('record', start, end, header, block) and ('gap', start, end, reason, b'') in order of place.
    data: bytes, or a source with ``size`` and ``read``, of which no more is held than a member or a record that
    passed the checks of its checksum or its length; what fails them is read in pieces."""
    source = Held(data) if isinstance(data, (bytes, bytearray)) else data
    at, lost, why = 0, None, ""
    while at < source.size:
        found = read_at(source, at)
        if isinstance(found, str):
            if lost is None:
                lost, why = at, found
            at = next_sign(source, at + 1)
            continue
        if lost is not None:
            yield "gap", lost, at, why, b""
            lost = None
        records, end = found
        for head, block in records:
            yield "record", at, end, head, block
        at = end
    if lost is not None:
        yield "gap", lost, source.size, why, b""


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to and revisit for each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    linked = rows.join(firsts, "digest", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return linked.select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes archives of page_id, url and html to a folder that executors can write to,
    and returns a row for each: path, n_records, n_bytes."""
    least = archive_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, held, size, number, done = TaskContext.get(), [], 0, 0, []

        def close() -> None:
            nonlocal held, size, number
            name = f"{root}/part-{context.partitionId():06d}-{number:04d}.warc.gz"
            hidden = f"{root}/_{context.taskAttemptId()}-{number:04d}.tmp"
            with store.open_output_stream(hidden) as out:
                for x in held:
                    out.write(x)
            store.move(hidden, name)
            done.append((name.removeprefix(root), len(held), size))
            held, size, number = [], 0, number + 1

        for batch in batches:
            for r in batch.to_pylist():
                x = member(record(r["page_id"], r["url"], r["payload"], r["refers_to"], r["revisit"]))
                if held and size + len(x) > least:
                    close()
                held.append(x)
                size += len(x)
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [folder + d[0] for d in done], "n_records": [d[1] for d in done], "n_bytes": [d[2] for d in done]})

    return storage.saved(with_references(pages, least_bytes).mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


READ = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())])


def read_row(path: str, found: tuple, payloads: bool) -> dict:
    kind, start, stop, head, block = found
    row = dict.fromkeys(READ.names) | {"path": path, "kind": kind, "start": start, "stop": stop}
    if kind == "gap":
        return row | {"reason": head}
    bare = lambda x: x and x.strip("<>")
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = head.get("warc-type") == "revisit"
    row |= {"record_id": bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "url": head.get("warc-target-uri"), "refers_to": bare(head.get("warc-refers-to"))}
    if revisit:
        return row | {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:")}
    return row | {"payload_digest": base32_sha1(payload), "payload_bytes": len(payload), "payload": payload if payloads else None}


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, whole_bytes: int = 64 << 20) -> DataFrame:
    """Records and gaps of all archives under a folder (gzip members or plain): path, kind,
    start, stop, record_id, record_type, url, refers_to, payload_digest, payload_bytes,
    payload, reason. A gap has only its place and the reason of the first failed check.
    Files above ``whole_bytes`` are read in pieces."""

    def rows(path: str, source) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in salvage(source):
            held.append(read_row(path, found, payloads))
            size += len(found[4])
            if len(held) >= 2000 or payloads and size > 8_000_000:
                yield pa.RecordBatch.from_pylist(held, READ)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from rows(path, content.as_py())

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/(?!/)", path) else path)
                with store.open_input_file(at) as file:
                    yield from rows(path, Stream(file))

    columns = "path string, kind string, start long, stop long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, reason string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    small = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(read, columns)
    large = files.where(F.col("length") > whole_bytes).select("path").mapInArrow(stream, columns)
    return small.unionByName(large)


def page_id_of(urn_of: Column, kind: str) -> Column:
    """The page's id that a record id of ``urn`` gives; null for others and for those that are no ``kind``."""
    return F.when(urn_of.startswith("urn:page:"), F.url_decode(F.replace(F.substring(urn_of, 10, 1 << 30), F.lit("+"), F.lit("%2B")))).try_cast(kind)


def resolved(records: DataFrame, kind: str = "long") -> DataFrame:
    """Pages of the records, with ids of type ``kind``; each revisit has the size of the response that it refers to."""
    rows = records.where("kind = 'record'").select("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    sizes = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("referred_bytes"))
    found = rows.join(sizes, ["refers_to", "payload_digest"], "left")
    return found.select(
        page_id_of(F.col("record_id"), kind).alias("page_id"), F.coalesce("payload_bytes", "referred_bytes").alias("payload_bytes"), "payload_digest", "record_type", page_id_of(F.col("refers_to"), kind).alias("refers_to")
    )


def salvaged(spark: SparkSession, folder: str, kind: str = "long") -> tuple[DataFrame, DataFrame]:
    """The pages of all archives under a folder, and the log of the gaps: path, start, stop, reason. Both are read once."""
    records = storage.saved(read_warc(spark, folder, payloads=False).drop("payload"), "records")
    return resolved(records, kind), records.where("kind = 'gap'").select("path", "start", "stop", "reason")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Writes all pages to archives in the shared folder, reads them back, resolves revisits.
    Bytes that cannot be read back would be pages lost: they raise."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    folder = storage.new_path(spark, "warc")
    if write_warc(pages, folder, least_bytes, archive_bytes).isEmpty():
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    found, gaps = salvaged(spark, folder, kind)
    if lost := gaps.limit(5).collect():
        raise RuntimeError(f"archives of this run have gaps: {lost}")
    return found
