"""WARC archives as a PySpark Python data source, and pages written to them without repeats.

Writing.  Each record is a gzip member of its own; the member's extra field holds its length.  A
task writes files of bounded size under names of its own, and the commit lists the files of the
tasks that succeeded in a manifest, so files of lost or repeated attempts are never read.  The manifest also
holds where in a file reading can begin, one place every SPLIT_BYTES or so.

Reading.  The manifest (or, without one, the folder) gives the files, which are cut at those places and
packed into partitions by size, so tasks grow with bytes.  Predicates on the columns that come from headers
are pushed down; a reader inflates just enough of a record to parse its headers, and if they fail a predicate,
or if payloads are not asked for, passes over the rest of the member without inflating it.  Members of other
writers may hold any number of records, or a part of one file's only member: all are read, and those not wanted are inflated
without being kept.

Paths may be local, ``file:`` or of any store that pyarrow knows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import shared_dir, sized, written

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
}
_ARROW = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_bytes" else pa.string()) for c in COLUMNS])
FILE_BYTES = 256 << 20
SPLIT_BYTES = 2 << 20
#: Compressed bytes of a partition: as many as make MOST_PARTITIONS of all, within these bounds.
PARTITION_BYTES = (8 << 20, 128 << 20)
MOST_PARTITIONS = 20_000
READ_AHEAD = 1 << 18
BATCH_BYTES = 8 << 20
MANIFEST = "manifest.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MARK = b"SL"  # extra field: length of the whole member


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


# --- records ---------------------------------------------------------------------------


def _line(value: object) -> str:
    """A header value on one line; what would break the line is written as percent escapes."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP headers and leaves the payload out."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = ["WARC/1.1"]
    lines += [f"{name}: {_line(row[c])}" for c, name in _HEADERS.items() if row[c] is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4BLBB", 0x1F, 0x8B, 8, 4, 0, 0, 255)
    total = len(head) + 2 + 8 + len(body) + 8
    extra = struct.pack("<H2sHL", 8, _MARK, 4, total)
    return head + extra + body + struct.pack("<LL", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Source:
    """A file that is read ahead in blocks; what lies behind the block is skipped by seeking."""

    def __init__(self, file, block: int = READ_AHEAD):
        self.file, self.block, self.first, self.held = file, block, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on; none at the end."""
        if not self.first <= at < self.first + len(self.held):
            self.file.seek(at)
            self.first, self.held = at, self.file.read(self.block)
        return self.held[at - self.first : at - self.first + n]


class Member:
    """One gzip member, inflated as far as it is asked for; what was used is let go."""

    def __init__(self, source: Source, at: int):
        self.source, self.at, self.used = source, at, 0
        self.inflate = zlib.decompressobj(31)
        self.data = bytearray()
        head = source.get(at, 32)
        if len(head) < 32:
            head = b"".join(source.get(at + k, 1) for k in range(32))
        if len(head) < 18 or head[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        #: Length of the whole member where its writer states it; such a member holds one record.
        self.length = struct.unpack("<L", head[16:20])[0] if head[3] & 4 and head[12:14] == _MARK else None

    def more(self) -> bool:
        """Inflate some more; false at the member's end."""
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail
        if not raw:
            # small steps: a record's headers need few bytes
            raw = self.source.get(self.at + self.used, 4096 if not self.used else 1 << 16)
            if not raw:
                raise ValueError(f"truncated gzip member at byte {self.at}")
            self.used += len(raw)
        self.data += self.inflate.decompress(raw, 1 << 20)
        return True

    def until(self, mark: bytes, begin: int = 0) -> int:
        """The place of a mark in the data, or -1 if the member ends before it."""
        while True:
            found = self.data.find(mark, begin)
            if found >= 0:
                return found
            begin = max(begin, len(self.data) - len(mark) + 1)
            if not self.more():
                return -1

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        while len(self.data) < n and self.more():
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def skip(self, n: int) -> None:
        """Pass over n bytes, never holding more than a block of them."""
        while n > len(self.data):
            n -= len(self.data)
            self.data.clear()
            if not self.more():
                return
        del self.data[:n]

    def end(self) -> int:
        """Where the next member begins; what was not inflated stays so if the length is known."""
        if self.length is not None:
            return self.at + self.length
        while self.more():
            self.data.clear()
        return self.at + self.used - len(self.inflate.unused_data)


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(member: Member, accept, payload: bool) -> Iterator[dict]:
    """Rows of a member's records whose header columns ``accept`` takes."""
    while True:
        while member.data[:1] in (b"\r", b"\n") or (not member.data and member.more()):  # lines between records
            if member.data[:1] in (b"\r", b"\n"):
                del member.data[:1]
        end = member.until(b"\r\n\r\n")
        if end < 0:
            if member.data.strip():
                raise ValueError(f"no complete headers in the member at byte {member.at}")
            return
        h = headers(member.take(end + 4)[:end])
        length = int(h["content-length"])
        row = {c: _unline(h[n.lower()]) if n.lower() in h else None for c, n in _HEADERS.items()}
        if accept(row):
            row |= {"payload_bytes": length, "payload": None}
            rest = length
            if h.get("content-type", "").startswith("application/http") and length > 0:
                inner = member.until(b"\r\n\r\n")
                if 0 <= inner <= length - 4:
                    http = headers(member.take(inner + 4)[:inner])
                    rest = length - inner - 4
                    stated = http.get("content-length", "")
                    row["payload_bytes"] = int(stated) if stated.isdigit() else rest
            if payload and row["record_type"] != "revisit":
                row["payload"] = member.take(rest)
                rest = 0
            yield row
        else:
            rest = length
        if member.length is not None:
            return
        member.skip(rest)


def read_file(path: str, accept, payload: bool, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    """Records of the members of a file that begin in [start, stop)."""
    where, name = place(path)
    size = where.get_file_info(name).size
    stop = size if stop is None else min(stop, size)
    with where.open_input_file(name) as file:
        source, at = Source(file), start
        while at < stop:
            one = Member(source, at)
            yield from records(one, accept, payload)
            at = one.end()


# --- data source -----------------------------------------------------------------------


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", folder); option payload=false leaves payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


@dataclass
class Ranges(InputPartition):
    ranges: list[tuple[str, int, int | None]]  # file, first byte, byte behind the last

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        self.ranges = ranges


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.target = int(options.get("partition_bytes", 0))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take over tests of header columns by equality, list, prefix or presence."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((column, "in", frozenset([f.value])))
            elif column in _HEADERS and isinstance(f, In):
                self.tests.append((column, "in", frozenset(v for v in f.value if v is not None)))
            elif column in _HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif column in _HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = place(self.path)
        manifest = f"{root}/{MANIFEST}"
        if where.get_file_info(manifest).type == fs.FileType.File:
            with where.open_input_file(manifest) as f:
                files = [(x["file"], x["bytes"], x.get("splits", [])) for x in json.loads(f.read())["files"]]
        else:
            found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
            files = [(x.base_name, x.size, []) for x in found if x.base_name.endswith(".warc.gz")]
        target = self.target or min(max(PARTITION_BYTES[0], sum(f[1] for f in files) // MOST_PARTITIONS), PARTITION_BYTES[1])
        parts = []
        for name, size, splits in sorted(files):
            edges = [0, *(x for x in splits if 0 < x < size), size]
            parts += [(f"{self.path}/{name}", a, b) for a, b in zip(edges[:-1], edges[1:])]
        packs: list[list[tuple[str, int, int | None]]] = []
        room = 0
        for path, a, b in parts:
            if not packs or room < b - a:
                packs.append([])
                room = target
            if packs[-1] and packs[-1][-1][0] == path and packs[-1][-1][2] == a:
                packs[-1][-1] = (path, packs[-1][-1][1], b)
            else:
                packs[-1].append((path, a, b))
            room -= b - a
        return [Ranges(p) for p in packs] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        def accept(row: dict) -> bool:
            for column, kind, value in self.tests:
                x = row[column]
                if x is None or (kind == "in" and x not in value) or (kind == "prefix" and not x.startswith(value)):
                    return False
            return True

        rows, size = [], 0
        for path, start, stop in partition.ranges:
            for row in read_file(path, accept, self.payload, start, stop):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        done, out, name, size, count, splits = Written(), None, "", 0, 0, [0]

        def close() -> None:
            if out is not None:
                out.close()
                done.files.append({"file": name, "bytes": size, "records": count, "splits": splits[1:]})

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    close()
                    name, size, count, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                if size - splits[-1] >= SPLIT_BYTES:
                    splits.append(size)
                data = member(record(row))
                out.write(data)
                size += len(data)
                count += 1
        close()
        return done

    def commit(self, messages) -> None:
        where, root = place(self.path)
        where.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        manifest = f"{root}/{MANIFEST}"
        if where.get_file_info(manifest).type == fs.FileType.File:  # appended to earlier writes
            with where.open_input_file(manifest) as f:
                files = json.loads(f.read())["files"] + files
        with where.open_output_stream(f"{manifest}.new") as f:
            f.write(json.dumps({"files": files}).encode())
        where.move(f"{manifest}.new", manifest)

    def abort(self, messages) -> None:
        where, root = place(self.path)
        for m in messages:
            for f in m.files if m else ():
                where.delete_file(f"{root}/{f['file']}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages -----------------------------------------------------------------------------


def as_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Records of pages (page_id, url, html).

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response and others revisit it.  Rows that repeat that page_id are responses too; a null
    page_id is a revisit if any row with its payload has an id, and else a response; a null html
    is an empty payload, and shorter payloads are always responses.  The largest ids
    are aggregated by digest before they are shuffled.  Digests that occur more than once are a table of
    their own; if it was counted to be small it is broadcast, so that payloads are written where they are read,
    and else payloads are shuffled to it.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).select(
        "page_id", "url", "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    # only the ids and digests of long payloads are shuffled for the groups
    repeated = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"))
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    repeated = written(repeated, "warc-digests")
    same = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("size"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(sized(repeated, repeated.count()), same, "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.format_string("<urn:page:%s>", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, F.format_string("<urn:page:%s>", F.col("first").cast("string"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        now.alias("date"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str | None = None) -> str:
    """Write pages to archives and return the folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_dir(spark, "warc")
    as_records(pages).write.format("warc").option("path", path).mode("append").save()
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_id(urn: str):
    number = F.regexp_extract(F.col(urn), "^<urn:page:(.*)>$", 1)
    return F.when(number != "", number).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives give them.

    Size and digest of responses are taken anew from the payload that was read.
    """
    spark, path = pages.sparkSession, write_pages(pages)
    # each test goes to the reader, which passes over the other kind of record by its headers; revisits need no payload
    response = read_archives(spark, path).where("record_type = 'response'")
    revisit = read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    of = lambda c: page_id(c).alias("refers_to" if c == "refers_to" else "page_id")
    return response.select(
        of("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", of("refers_to")
    ).unionByName(
        revisit.select(of("record_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", of("refers_to"))
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS size, body,
             max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN size >= 1000 AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM q
"""
