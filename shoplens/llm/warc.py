"""Web archives that are written and read by an index.

The writer makes the index first: file, offset, length, URL and digest of every record. The reader
takes chosen rows of an index, sorts them by place, joins neighbouring byte ranges into one read and
parses the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shoplens.llm.common import scratch_path, text_of, written

# Smaller payloads are always stored.
MIN_REVISIT_BYTES = 1_000
FILE_BYTES = 512 << 20
READ_BYTES = 8 << 20
# Archive bytes that a task reads.
TASK_BYTES = 64 << 20
GAP_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, page_id string, url string, payload_digest string, record_type string"
RECORDS = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _one_line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _as_before(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_bytes(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One record, compressed by itself. A revisit has the HTTP head of the page and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{_base32(digest)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = _one_line(url)
    if page_id is not None:
        headers["X-Page-Id"] = _one_line(page_id)
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
        headers["X-Refers-To-Page"] = _one_line(refers_to)
    top = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(top.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The fields of :data:`RECORDS` of one compressed record; its digest is checked where it has a payload."""
    raw = zlib.decompress(member, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if lines[0] != "WARC/1.1" or (kind == "response" and hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    named = {x: headers.get(h) for x, h in (("page_id", "X-Page-Id"), ("url", "WARC-Target-URI"), ("refers_to", "X-Refers-To-Page"))}
    return {x: v if v is None else _as_before(v) for x, v in named.items()} | {
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


@dataclass
class _Archive:
    """One file under construction and the index rows of its records."""

    path: str
    where: fs.FileSystem
    offset: int = 0
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.stream = self.where.open_output_stream(self.path, compression=None)

    def add(self, member: bytes, **row) -> None:
        self.stream.write(member)
        self.rows.append({"file": self.path, "offset": self.offset, "length": len(member), **row})
        self.offset += len(member)

    def closed(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_pylist(self.rows, _arrow_schema(INDEX))


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the index as a written table.

    Of payloads equal in digest and size, of at least ``min_bytes``, those of the largest page_id are
    responses and the others revisit it. Null html is an empty payload; null ids come before all others.
    Each attempt of a task writes files of its own, and only files of attempts that ended are in the
    index, so a lost executor leaves files behind that nobody reads.
    """
    kind = pages.schema["page_id"].dataType
    payload = text_of("html").cast("binary")
    known = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload")}
    )
    narrow = written(known.select("page_id", "digest", "size"), "payloads")
    latest = narrow.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    latest = written(latest.where("n > 1").drop("n"), "repeated-payloads")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    typed = known.join(latest, ["digest", "size"], "left").select(
        F.col("page_id").cast("string"), "url", "digest", revisit.alias("revisit"), F.col("latest").cast("string").alias("latest"), "payload"
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _opened(folder)
        where.create_dir(top, recursive=True)
        archive = None
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive = _Archive(f"{top}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", where)
                member = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["latest"], row["revisit"])
                kind = "revisit" if row["revisit"] else "response"
                archive.add(member, page_id=row["page_id"], url=row["url"], payload_digest=row["digest"], record_type=kind)
                if archive.offset >= FILE_BYTES:
                    yield archive.closed()
                    archive = None
        if archive is not None:
            yield archive.closed()

    return written(typed.mapInArrow(write, INDEX).withColumn("page_id", F.col("page_id").cast(kind)), "warc-index")


def coalesced(places: list[tuple[str, int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted (file, offset, length) in groups that one read serves: one file, gaps up to ``gap``, ``most`` bytes unless one record has more."""
    group: list[tuple[str, int, int]] = []
    for place in places:
        if group:
            end = max(o + n for _, o, n in group[-1:])
            if place[0] != group[0][0] or place[1] - end > gap or place[1] + place[2] - group[0][1] > most:
                yield group
                group = []
        group.append(place)
    if group:
        yield group


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` point to, parsed and checked.

    Rows are sorted by file and offset, so that a task reads a stretch of few files. The number of tasks
    follows from the bytes to read, which the narrow index rows don't show. An empty index gives no records.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    kind = index.schema["page_id"].dataType

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name, stream = _opened(folder)[0], None, None
        for batch in batches:
            for group in coalesced(list(zip(*(batch.column(i).to_pylist() for i in range(3))))):
                if group[0][0] != name:
                    name, stream = group[0][0], where.open_input_file(group[0][0])
                first, end = group[0][1], group[-1][1] + group[-1][2]
                chunk = stream.read_at(end - first, first)
                rows = [parse_record(chunk[o - first : o - first + n]) for _, o, n in group]
                if not with_payload:
                    rows = [row | {"payload": None} for row in rows]
                yield pa.RecordBatch.from_pylist(rows, _arrow_schema(RECORDS))

    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, RECORDS).withColumns({x: F.col(x).cast(kind) for x in ("page_id", "refers_to")})


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Every page as its archive record says after writing and reading back.

    Null html is an empty payload. Rows of equal page_id are records of their own; an empty table gives no
    rows and no archive.
    """
    folder = folder or scratch_path(pages, "warc")
    records = read_records(write_archives(pages.select("page_id", "url", "html"), folder), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
