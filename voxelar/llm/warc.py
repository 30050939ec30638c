"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: the request, the response (or a revisit of an equal
earlier payload) and metadata. Request and metadata name their response by
WARC-Concurrent-To. Assembly brings the three together on that identifier in one
shuffle and emits one nested row per capture.

Files are bounded by bytes, start with a warcinfo record and hold one gzip member per
record, so a reader can seek to any record. A file appears under its name when it is
whole, and a retried task writes the same files again.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelar.plans.cut import materialize, new_path
from voxelar.plans.session import small_batches

from ._common import id_back, id_of, join_hot, text_of

#: Payloads below this size are always written in full.
REVISIT_BYTES = 100
#: Bytes of records, before compression, after which a file is closed.
FILE_BYTES = 256 << 20
#: Rows of revisits that are broadcast; beyond it captures are joined by shuffle.
ROW_IDS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 14

_URL = re.compile(r"[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as numbered captures with payload, size and digest (null html: empty payload)."""
    payload = text_of(html_col)
    return pages.select(
        F.monotonically_increasing_id().alias("row"),
        id_of(id_col).alias("page"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )


def revisits(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``(row, first_row, first_page)`` of captures whose payload an earlier page (or equal page, earlier row) has."""
    large = rows.where(F.col("bytes") >= least).select("row", "page", "digest")
    first = large.groupBy("digest").agg(F.min(F.struct("page", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("digest", F.col("first.row").alias("first_row"), F.col("first.page").alias("first_page")), "firsts")
    return join_hot(large.select("row", "digest"), first, "digest").where("row <> first_row").select("row", "first_row", "first_page")


def _uuid(path: str, kind: str, row: int) -> str:
    return f"<{uuid.UUID(hashlib.md5(f'{path}:{kind}:{row}'.encode()).hexdigest()).urn}>"


def _record(block: bytes, **headers: str | None) -> bytes:
    """A whole record; null headers are left out."""
    lines = [f"WARC-{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None and k != "Content_Type"]
    lines = ["WARC/1.1", *lines, f"Content-Type: {headers['Content_Type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def transaction(path: str, row: int, page: int, url: str | None, payload: str, digest: str, first: int | None) -> list[bytes]:
    """The request, response (or revisit of row ``first``) and metadata records of a capture."""
    target = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    parts = _URL.match(target or "")
    host, local = (parts[1], parts[2] or "/") if parts else ("", target or "/")
    body = payload.encode()
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    response = _uuid(path, "response", row)
    both = {"Date": DATE, "Target_URI": target}
    beside = {**both, "Concurrent_To": response}
    again = first is not None
    main = _record(
        status if again else status + body,
        Type="revisit" if again else "response",
        Record_ID=response,
        **both,
        Payload_Digest=f"sha256:{digest}",
        Refers_To=_uuid(path, "response", first) if again else None,
        Profile=PROFILE if again else None,
        Content_Type="application/http;msgtype=response",
    )
    ask = f"GET {local} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    request = _record(ask, Type="request", Record_ID=_uuid(path, "request", row), **beside, Content_Type="application/http;msgtype=request")
    about = f"page-id: {page}\r\n".encode()
    metadata = _record(about, Type="metadata", Record_ID=_uuid(path, "metadata", row), **beside, Content_Type="application/warc-fields")
    return [request, main, metadata]


def _writer(path: str, most: int):
    """Write captures, in order of row, to this partition's files; one row per file."""

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        task = TaskContext.get().partitionId()
        out, temporary, name, number, records, size = None, "", "", 0, 0, 0

        def finish():
            out.close()
            fs.move(temporary, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "page", "url", "payload", "digest", "first_row")]
            for values in zip(*columns, strict=True):
                if out is not None and size >= most:
                    yield finish()
                    out, number = None, number + 1
                if out is None:
                    name, records, size = f"part-{task:06d}-{number:05d}.warc.gz", 0, 0
                    fs.create_dir(root, recursive=True)
                    temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                    info = _record(b"software: voxelar\r\nformat: WARC File Format 1.1\r\n", Type="warcinfo", Record_ID=_uuid(path, name, 0), Date=DATE, Filename=name, Content_Type="application/warc-fields")
                    out.write(gzip.compress(info, mtime=0))
                for record in transaction(path, *values):
                    out.write(gzip.compress(record, 6, mtime=0))
                    records, size = records + 1, size + len(record)
        if out is not None:
            yield finish()

    return run


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = FILE_BYTES
) -> DataFrame:
    """Write all pages as gzip-compressed WARC files under ``path``; one row per file: ``file, records, bytes``.

    Of captures with equal payloads of REVISIT_BYTES or more the smallest page id (a
    null id before all) is the response and the others revisit it. White space and
    controls of a url are percent-encoded in its record.
    """
    small_batches(pages.sparkSession)
    rows = materialize(captures(pages, id_col, url_col, html_col), "captures")
    again = materialize(revisits(rows), "revisits").select("row", "first_row")
    if again.limit(ROW_IDS + 1).count() <= ROW_IDS:
        joined = rows.join(F.broadcast(again), "row", "left")  # rows stay in order of the scan
    else:
        joined = rows.join(again, "row", "left").sortWithinPartitions("row")
    return materialize(joined.mapInArrow(_writer(path, most), "file string, records long, bytes long"), "archives")


RECORD = (
    "record_id string, kind string, uri string, concurrent_to string, refers_to string, digest string,"
    " content_type string, block binary, payload_bytes long, payload_sha256 string"
)


def _stream(content: bytes):
    """Content in parts, decompressed if it is gzip (one member or many)."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        unpack = zlib.decompressobj(31)
        while at < len(view) and not unpack.eof:
            part = view[at : at + CHUNK]
            yield unpack.decompress(part)
            at += len(part) - len(unpack.unused_data)


def parse(content: bytes):
    """Records ``(headers, block)`` of an archive; header names in lower case."""
    parts, held = _stream(content), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while fill(1) and held[:2] in (b"\r\n", b"\r", b"\n"):
            del held[: 2 if held[:2] == b"\r\n" else 1]
        end, size = -1, 1 << 12
        while end < 0:
            more = fill(size)
            end = held.find(b"\r\n\r\n")
            if end < 0 and not more:
                return
            size *= 2
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers.get("content-length", 0))
        if not fill(end + 4 + length):
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        block = bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]
        yield headers, block


def _read(batches):
    names = [c.split()[0] for c in RECORD.split(",")]
    types = [pa.string()] * 7 + [pa.binary(), pa.int64(), pa.string()]
    rows, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for files in batches:
        for i in range(files.num_rows):
            for h, block in parse(files.column("content")[i].as_py()):
                http = h.get("content-type", "").startswith("application/http")
                payload = block.partition(b"\r\n\r\n")[2] if http else block
                fields = ("warc-record-id", "warc-type", "warc-target-uri", "warc-concurrent-to", "warc-refers-to", "warc-payload-digest")
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((*map(h.get, fields), h.get("content-type"), block, len(payload), digest))
                size += len(block)
                if len(rows) >= 2000 or size > 1 << 23:
                    yield batch()
                    rows, size = [], 0
    if rows:
        yield batch()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``, gzip-compressed or not; a file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(path).where("length > 0")
    return files.select("content").mapInArrow(_read, RECORD)


_BESIDE = ("record_id", "content_type", "block")
_MAIN = ("record_id", "kind", "uri", "refers_to", "digest", "content_type", "block", "payload_bytes", "payload_sha256")


def assemble(found: DataFrame, fields: tuple[str, ...] = _MAIN, beside: tuple[str, ...] = _BESIDE) -> DataFrame:
    """One nested row per capture: ``capture, request, response, metadata``.

    ``response`` is the response or revisit. A capture without request or metadata has
    null there; requests or metadata whose response is missing are not captures. Of
    several records of a kind the one with the smallest id counts. ``fields`` and
    ``beside`` name what is kept of the response and of the other records; records meet
    on the response's identifier in one pass over them.
    """
    main = F.col("kind").isin("response", "revisit")
    capture = F.when(main, F.col("record_id")).when(F.col("kind").isin("request", "metadata"), F.col("concurrent_to"))
    parts = found.select(
        capture.alias("capture"),
        F.when(main, F.struct("record_id", *[c for c in fields if c != "record_id"])).alias("response"),
        *[F.when(F.col("kind") == k, F.struct("record_id", *[c for c in beside if c != "record_id"])).alias(k) for k in ("request", "metadata")],
    ).where("capture is not null")
    met = parts.groupBy("capture").agg(*[F.min(c).alias(c) for c in ("request", "response", "metadata")])
    return met.where("response is not null")


def resolved(found: DataFrame) -> DataFrame:
    """Per capture of ``assemble``: page id, size and digest of the full payload, type and the page it revisits.

    A revisit whose response is missing keeps its declared digest, with null size and page.
    """
    page = F.regexp_extract(F.col("metadata.block").cast("string"), r"page-id: (-?\d+)", 1)
    slim = assemble(found, ("kind", "refers_to", "digest", "payload_bytes", "payload_sha256"), ("block",))
    flat = materialize(
        slim.select(
            "capture",
            page.try_cast("long").alias("page"),
            F.col("response.kind").alias("record_type"),
            F.col("response.refers_to").alias("refers"),
            F.col("response.payload_bytes").alias("bytes"),
            F.regexp_replace("response.digest", "^sha256:", "").alias("declared"),
            F.col("response.payload_sha256").alias("digest"),
        ),
        "transactions",
    )
    whole = flat.where("record_type = 'response'")
    again = flat.where("record_type = 'revisit'").select("capture", "page", "refers", "declared")
    targets = whole.select(F.col("capture").alias("refers"), F.col("page").alias("at"), F.col("bytes").alias("size"))
    # Responses stay out of the join: their missing target would be one key for nearly all rows.
    matched = join_hot(again, targets, "refers")
    lost = again.join(targets, "refers", "left_anti").select("*", *[F.lit(None).cast("long").alias(c) for c in ("at", "size")])
    return whole.select(
        id_back("page").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        matched.unionByName(lost).select(
            id_back("page").alias("page_id"),
            F.col("size").alias("payload_bytes"),
            F.col("declared").alias("payload_digest"),
            F.lit("revisit").alias("record_type"),
            id_back("at").alias("refers_to"),
        )
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives to shared storage and give back one row per capture.

    Empty tables give no archives and an empty result; repeated rows are captures of
    their own, of which all but the first revisit; null ids stay null.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    if write_archives(pages, path).isEmpty():
        return resolved(spark.createDataFrame([], RECORD))
    return resolved(read_archives(spark, path))
