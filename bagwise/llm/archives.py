"""Web archives: legacy ARC files read by their version's header lines and converted to WARC.

Archives are gzip files with one member per record, written through Arrow's file systems into a shared
folder. Tasks write files under names of their own and list them in a table; only listed files are read,
so what a lost or repeated task has left behind does no harm. Files are cut at a size, and records are
read one at a time, so memory holds a record and not a file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.llm.common import lookup, table
from bagwise.plans.scratch import scratch_path, stored

#: Header fields of both ARC versions, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a task starts another file.
FILE_BYTES = 8 << 20
PAGE_HEADER = "X-Page-Id"


def digest_of(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    """The same parts give the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


class ArchiveFiles:
    """Writes records, each a gzip member, to files of bounded size in a folder; ``close`` lists them."""

    def __init__(self, folder: str, suffix: str, head=None):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.base, self.suffix, self.head = folder.rstrip("/"), suffix, head
        self.out, self.size, self.count, self.listed = None, 0, 0, []

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}{self.suffix}"
        self.system.create_dir(self.folder, recursive=True)
        self.out = self.system.open_output_stream(f"{self.folder.rstrip('/')}/{self.name}")
        self.size = self.count = 0
        if self.head:
            self._member(self.head(self.name))

    def _member(self, record: bytes) -> None:
        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
        self.out.write(packer.compress(record) + packer.flush())
        self.size += len(record)

    def write(self, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._member(record)
        self.count += 1
        if self.size >= FILE_BYTES:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.listed.append((f"{self.base}/{self.name}", self.count))
        self.out = None

    def close(self) -> list[tuple[str, int]]:
        if self.out is not None:
            self._end()
        return self.listed


def _opened(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return gzip.GzipFile(fileobj=system.open_input_stream(inner, buffer_size=1 << 20))


# --- ARC ---


def arc_head(version: int):
    """The version block that starts an ARC file."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 corpus\n{fields[version]}\n".encode()

    def head(name: str) -> bytes:
        rest = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
        return f"filedesc://{name} 0.0.0.0 20200101000000 {rest} {len(body)}\n".encode() + body + b"\n"

    return head


def arc_record(version: int, url: str, date: str, mime: str, body: bytes) -> bytes:
    place = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    rest = mime if version == 1 else f"{mime} 200 {hashlib.md5(body).hexdigest()} - 0 -"
    return f"{place} 0.0.0.0 {date} {rest} {len(body)}\n".encode() + body + b"\n"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    at: int


def read_arc(stream) -> Iterator[ArcRecord]:
    """Records of an ARC file; its version block says how many fields a header line has."""
    version, at = None, 0
    while True:
        line = stream.readline()
        while line == b"\n":
            line = stream.readline()
        if not line:
            return
        words = line.decode("utf-8").rstrip("\r\n").split(" ")
        size = int(words[-1])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"record {at} is shorter than its declared length")
        if version is None:
            if not words[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with a version block")
            version = int(body.split(b" ", 1)[0])
            continue
        if len(words) != len(ARC_FIELDS[version]):
            raise ValueError(f"record {at} has {len(words)} fields")
        named = dict(zip(ARC_FIELDS[version], words))
        yield ArcRecord(named["url"], named["ip"], named["date"], named["mime"], body, at)
        at += 1


def payload_of(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its blank line, and what follows; a body without a head is all payload."""
    if body.startswith(b"HTTP/"):
        head, blank, payload = body.partition(b"\r\n\r\n")
        if blank:
            return head + blank, payload
    return b"", body


def page_of(head: bytes) -> int | None:
    m = re.search(rb"\r\n" + PAGE_HEADER.encode() + rb": (-?\d+)\r\n", head)
    return int(m[1]) if m else None


# --- WARC ---


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def convert(record: ArcRecord, digest: str, place: str, first: tuple[int | None, str] | None) -> bytes:
    """The WARC record of an ARC record; ``first`` is the page and place of the one it repeats, if any."""
    head, payload = payload_of(record.body)
    page, d = page_of(head), record.date
    fields = [
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if not head:
        return warc_record("resource", [("WARC-Record-ID", record_id(place)), *fields, ("Content-Type", record.mime)], record.body)
    http = ("Content-Type", "application/http;msgtype=response")
    if first is None:
        block = ("WARC-Block-Digest", f"sha1:{digest_of(record.body)}")
        return warc_record("response", [("WARC-Record-ID", record_id(page, digest, place)), *fields, block, http], record.body)
    repeats = [("WARC-Refers-To", record_id(first[0], digest, first[1])), ("WARC-Profile", REVISIT_PROFILE)]
    block = ("WARC-Block-Digest", f"sha1:{digest_of(head)}")
    return warc_record("revisit", [("WARC-Record-ID", record_id(page, digest, place)), *fields, *repeats, block, http], head)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a block is shorter than its declared length")
        yield fields, block


# --- Spark ---

MANIFEST = "path string, records long"


def _manifest(listed: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    if listed:
        paths, counts = zip(*listed)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])


def write_legacy(pages: DataFrame, folder: str, date: str = "20200101000000") -> DataFrame:
    """Write pages as ARC files of both versions; returns the table of files.

    Page ids are whole numbers, which a header of each record carries; other ids are an error.
    """
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise TypeError("page ids must be whole numbers")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {v: ArchiveFiles(folder, f".v{v}.arc.gz", arc_head(v)) for v in ARC_FIELDS}
        n = 0
        for batch in batches:
            for at in range(batch.num_rows):
                page, url, html = (batch.column(c)[at].as_py() for c in ("page_id", "url", "html"))
                who = f"{PAGE_HEADER}: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{who}Content-Length: {len(html)}\r\n\r\n"
                n += 1
                files[1 + n % 2].write(arc_record(1 + n % 2, url, date, "text/html", head.encode() + html))
        yield from _manifest([x for f in files.values() for x in f.close()])

    blank = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html")
    )
    return stored(blank.mapInArrow(written, MANIFEST), "arc-files")


def _each_file(manifest: DataFrame) -> DataFrame:
    """The files, dealt to as many tasks as a shuffle has."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path")


RECORDS = "place string, url string, ip string, date string, mime string, body binary, page_id long, payload_bytes long, digest string"


def legacy_records(manifest: DataFrame, bodies: bool) -> DataFrame:
    """One row per record of the listed ARC files; without ``bodies`` only what grouping needs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()),
                            ("body", pa.binary()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _opened(path) as stream:
                    for r in read_arc(stream):
                        head, payload = payload_of(r.body)
                        body = r.body if bodies else None
                        held.append((f"{path}#{r.at}", r.url, r.ip, r.date, r.mime, body, page_of(head), len(payload), digest_of(payload)))
                        size += len(body or b"") + 200
                        if size > FILE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return _each_file(manifest).mapInArrow(read, RECORDS)


def convert_archives(manifest: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Convert the listed ARC files to WARC; returns the table of WARC files.

    Of records with equal payloads of ``least_bytes`` or more, the one of the smallest page (of several,
    the first place; a null page is last) becomes a response and the others revisit it.
    """
    rank: Column = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "place")
    index = legacy_records(manifest, bodies=False).where(F.col("payload_bytes") >= least_bytes)
    groups = index.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(groups.where("n > 1").select("digest", F.col("first.page_id").alias("_page"), F.col("first.place").alias("_place")), "firsts")
    records = lookup(legacy_records(manifest, bodies=True), firsts, ["digest"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = warc_record("warcinfo", [("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: legacy archive converter\r\n")
        files = ArchiveFiles(folder, ".warc.gz", lambda name: info.replace(b"\r\nWARC-Date", f"\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Filename: {name}\r\nWARC-Date".encode(), 1))
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                repeats = r["_place"] is not None and r["_place"] != r["place"] and r["payload_bytes"] >= least_bytes
                first = (r["_page"], r["_place"]) if repeats else None
                arc = ArcRecord(r["url"], r["ip"], r["date"], r["mime"], r["body"], 0)
                files.write(convert(arc, r["digest"], r["place"], first))
        yield from _manifest(files.close())

    return stored(records.mapInArrow(written, MANIFEST), "warc-files")


WARC_ROWS = "record_id string, record_type string, refers string, page_id long, payload_bytes long, payload_digest string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page of the listed WARC files; a response's payload is checked against its digest.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``: the page that a revisit's record
    refers to, by the identifier of that record.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [w.split()[0] for w in WARC_ROWS.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _opened(path) as stream:
                    for fields, block in read_warc(stream):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, payload = payload_of(block)
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), len(payload)
                        if kind == "revisit":
                            size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
                        elif digest_of(payload) != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                        rows.append((fields["warc-record-id"], kind, fields.get("warc-refers-to"), page_of(head), size, digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = stored(_each_file(manifest).mapInArrow(read, WARC_ROWS), "records")
    wanted = rows.where("refers IS NOT NULL").select(F.col("refers").alias("record_id")).distinct()
    named = rows.where("record_type = 'response'").join(wanted, "record_id")
    named = stored(named.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")), "named")
    return lookup(rows, named, ["refers"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def through_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC to WARC and back; see :func:`convert_archives` and :func:`read_archives`.

    Null html is an empty payload, a null URL an unknown place; repeated rows are records of their own; an
    empty table writes no file and reads no row. Only ``page_id``, ``url`` and ``html`` are read.
    """
    legacy = write_legacy(pages, f"{folder}/arc")
    return read_archives(convert_archives(legacy, f"{folder}/warc", least_bytes))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))


#: Payload facts from the table; base32 of SHA-1 from its bits, five at a time.
ORACLE = r"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT k, page_id, strlen(h) AS payload_bytes, unhex(sha1(h))::BIT::VARCHAR AS bits FROM p),
b AS (
  SELECT page_id, payload_bytes, k,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, (1 + 5 * i)::BIGINT, 5))::INT, 1)), 'string_agg', '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER same THEN NULL ELSE min(page_id) OVER same END AS refers_to
FROM b WINDOW same AS (PARTITION BY payload_digest)
"""
