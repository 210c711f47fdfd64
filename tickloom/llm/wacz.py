"""Web archives in ZIP packages: writing, and reading by ranges.

A package holds stored (not compressed) members: ``archive/data.warc.gz``, one gzip
member per WARC record, and ``indexes/index.cdxj``, a line per record with the place
of its gzip member. A reader opens a package with three small reads (end record, ZIP64
locator and record, central directory), finds where the stored members begin, and then
reads single records by range; nothing is extracted.

Packages are written by tasks into a folder that all executors share, through
``pyarrow.fs``, under a name of their own for each attempt. The rows that name the packages are
written to the checkpoint folder, so a package of a lost or repeated attempt is never
named and never read.

Defined results: a null payload is an empty one; records are written for every row,
repeated rows too, and a null id is kept; with ``dedupe``, of records with equal payloads
the one with the least id (null last) is the response, rows that repeat it whole are
responses as well, and all others revisit it; an empty table gives no packages. Columns
other than the three named are not archived.
"""
from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import durable

#: Payload bytes of one package, about; bytes of a package that one task reads in a row.
PACKAGE, STRETCH = 64 << 20, 8 << 20
#: Signatures of the ZIP format, and its marker for a 64-bit field elsewhere.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
ESCAPE16, ESCAPE32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed date of records: archives of equal rows are equal.
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -------------------------------------------------------------------------


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has headers only: its payload is that of the response."""
    block = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Page-Id": "" if page is None else str(page),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response" if kind == "response" else "message/http",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page"] = "" if refers_to is None else str(refers_to)
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Package:
    """A ZIP file written front to back, with ZIP64 fields throughout.

    Sizes come after a stored member's data, so each member is written to the stream
    as it grows and described by the central directory.
    """

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.at, self.entries = stream, 0, []
        self.open: tuple[str, int, int, int] | None = None

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        head, raw = self.at, name.encode()
        extra = struct.pack("<HHQQ", EXTRA64, 16, 0, 0)
        # flag 8: checksum and sizes follow the data
        self._put(struct.pack(
            "<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, ESCAPE32, ESCAPE32, len(raw), len(extra)
        ) + raw + extra)
        self.open, self.crc = (name, head, self.at), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Offset within the member, and length."""
        place = self.at - self.open[2]
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return place, len(data)

    def end(self) -> None:
        name, head, start = self.open
        size = self.at - start
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.entries.append((name, head, size, self.crc))
        self.open = None

    def close(self) -> None:
        start = self.at
        for name, head, size, crc in self.entries:
            raw, extra = name.encode(), struct.pack("<HHQQQ", EXTRA64, 24, size, size, head)
            self._put(struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, ESCAPE32, ESCAPE32, len(raw),
                len(extra), 0, 0, 0, 0, ESCAPE32,
            ) + raw + extra)
        length, count, at64 = self.at - start, len(self.entries), self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, length, start))
        self._put(struct.pack("<IIQI", LOCATOR, 0, at64, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, ESCAPE16, ESCAPE16, ESCAPE32, ESCAPE32, 0))
        self.stream.close()


def _target(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return system, path


def shared_folder(rows: DataFrame) -> str:
    """A new folder below the shared checkpoint folder."""
    spark = rows.sparkSession
    durable(spark.range(1))  # sets the checkpoint folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/wacz-{uuid.uuid4().hex}"


MANIFEST = "package string, records bigint, payload_bytes bigint"


def _identity(page: str) -> list[Column]:
    """A page's id for joins that must find null ids, too."""
    return [F.col(page).isNull().alias("_null"), F.coalesce(page, F.lit(0)).alias("_id")]


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    dedupe: bool = True, package: int = PACKAGE,
) -> DataFrame:
    """Write every row as a WARC record; returns a row per package (``MANIFEST``)."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    key = F.sha1("payload")
    if dedupe:
        firsts = rows.select("page_id", key.alias("key")).groupBy("key").agg(F.min("page_id").alias("first"))
        # Few pages share a payload with another: only those that revisit are joined.
        again = rows.select("page_id", key.alias("key")).distinct().join(firsts, "key").filter(
            ~F.col("page_id").eqNullSafe(F.col("first"))
        ).select(*_identity("page_id"), F.col("key").alias("_key"), "first", F.lit(True).alias("again"))
        rows = rows.select("*", *_identity("page_id"), key.alias("_key"))
        rows = rows.join(again, ["_null", "_id", "_key"], "left").select(
            "page_id", "url", "payload", F.coalesce("again", F.lit(False)).alias("again"), "first"
        )
    else:
        rows = rows.select("*", F.lit(False).alias("again"), F.lit(None).cast("bigint").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _target(folder)
        out: Package | None = None
        name, lines, held, done = "", [], 0, []

        def finish() -> None:
            out.end()
            out.begin(INDEX)
            out.add("".join(lines).encode())
            out.end()
            out.close()
            done.append((name, len(lines), held))

        for batch in batches:
            for page, url, payload, again, first in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    system.create_dir(path)
                    name, lines, held = f"{path}/{uuid.uuid4().hex}.wacz", [], 0
                    out = Package(system.open_output_stream(name, compression=None))
                    out.begin(ARCHIVE)
                kind = "revisit" if again else "response"
                offset, length = out.add(zipped(record(kind, page, url, payload, first)))
                lines.append(json.dumps({"page": page, "offset": offset, "length": length}) + "\n")
                held += len(payload)
                if held >= package:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in zip(*done)], ["package", "records", "payload_bytes"]
            )

    return durable(rows.mapInArrow(run, MANIFEST))


# --- reading -------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    start: int
    size: int
    method: int


def members(source: pa.NativeFile) -> list[Member]:
    """Members of a ZIP file, from its central directory (plain or ZIP64)."""
    size = source.size()
    tail = source.read_at(min(size, 65557 + 20), max(0, size - 65577))
    at = len(tail)
    while True:
        at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        # the same bytes may stand in the comment: its length must reach to the end
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<10xHII", tail, at)
    if at >= 20 and struct.unpack_from("<I", tail, at - 20)[0] == LOCATOR:
        end64 = struct.unpack_from("<8xQ", tail, at - 20)[0]
        fields = struct.unpack("<IQHHIIQQQQ", source.read_at(56, end64))
        if fields[0] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = fields[7:10]
    directory, found, at = source.read_at(length, start), [], 0
    for _ in range(count):
        if struct.unpack_from("<I", directory, at)[0] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        head = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + names].decode()
        extra = directory[at + 46 + names:at + 46 + names + extras]
        wide = iter(_wide(extra))
        # 64-bit values stand in the extra field in this order, for escaped fields only
        plain = next(wide) if plain == ESCAPE32 else plain
        packed = next(wide) if packed == ESCAPE32 else packed
        head = next(wide) if head == ESCAPE32 else head
        local = source.read_at(30, head)
        if struct.unpack_from("<I", local)[0] != LOCAL:
            raise ValueError("broken local header")
        data = head + 30 + sum(struct.unpack_from("<HH", local, 26))
        found.append(Member(name, data, packed, method))
        at += 46 + names + extras + comment
    return found


def _wide(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def stored(source: pa.NativeFile, name: str) -> Member:
    for member in members(source):
        if member.name == name:
            if member.method:
                raise ValueError(f"{name} is compressed: only stored members can be read by range")
            return member
    raise ValueError(f"no member {name}")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def read_index(manifest: DataFrame) -> DataFrame:
    """Where every record is: ``package, offset, length`` in bytes of the package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("package").to_pylist():
                system, name = _target(path)
                with system.open_input_file(name) as source:
                    archive, index = stored(source, ARCHIVE), stored(source, INDEX)
                    lines = source.read_at(index.size, index.start).decode().splitlines()
                found = [json.loads(line) for line in lines]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(found), pa.string()),
                    pa.array([archive.start + x["offset"] for x in found], pa.int64()),
                    pa.array([x["length"] for x in found], pa.int64()),
                ], ["package", "offset", "length"])

    return manifest.select("package").mapInArrow(run, "package string, offset bigint, length bigint")


def stretches(index: DataFrame, manifest: DataFrame) -> DataFrame:
    """``index`` dealt to tasks by stretches of packages, in order of place.

    The rows are small and what they point at is not: the number of tasks follows the
    payload bytes, four stretches each.
    """
    held = manifest.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-held // (4 * STRETCH)))
    parts = index.repartition(tasks, "package", F.floor(F.col("offset") / STRETCH))
    return parts.sortWithinPartitions("package", "offset")


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records read by range. Only a response carries a payload; its digest is checked."""
    schema = RECORD if payload else T.StructType(RECORD.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if path != opened:
                    if source is not None:
                        source.close()
                    system, name = _target(path)
                    source, opened = system.open_input_file(name), path
                head, block = parse(zlib.decompress(source.read_at(length, offset), 31))
                kind, wanted = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and digest(block) != wanted:
                    raise ValueError(f"payload of {path} at {offset} differs from its digest")
                number = lambda x: int(x) if x else None
                rows.append((
                    number(head["X-Page-Id"]), head["WARC-Target-URI"], kind, wanted, int(head["X-Payload-Length"]),
                    number(head.get("X-Refers-To-Page", "")), block if kind == "response" else None,
                ))
            columns = list(zip(*rows)) or [[] for _ in RECORD.fields]
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)][:len(schema.fields)], schema.names
            )
        if source is not None:
            source.close()

    return index.select("package", "offset", "length").mapInArrow(run, schema)
