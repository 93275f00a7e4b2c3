"""Conversion of legacy ARC archives to WARC, and archives of web pages.

An ARC file begins with a version block, whose second line names the version and whose third
names the fields of every header line that follows; each header line ends with the length of the
block after it. Version 1 has five fields, version 2 ten. Converting a record keeps its block and
derives what WARC asks for besides: an identifier, an ISO date, a record type, a media type and
digests of block and payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.scratch import new_path, written

# The header lines of both versions, and the revisit profile of the standard.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Bytes of the records of one archive file, about: the next record begins another file.
FILE_BYTES = 64_000_000
#: Keys joined by broadcast at most.
BROADCAST_KEYS = 1_000_000
CAPTURED = "20240101000000"


class ArchiveError(ValueError):
    """The archive breaks its format."""


@dataclass
class Record:
    """One WARC record: named fields in order, and the block."""

    fields: dict[str, str]
    block: bytes = b""

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields.items())
        return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int
    version: int = field(default=1)


def arc_version_block(version: int, name: str = "pages.arc", date: str = CAPTURED) -> bytes:
    body = f"{version} 0 vexel\n{ARC_FIELDS[version]}\n\n".encode()
    tail = "" if version == 1 else f"0 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, block: bytes, offset: int = 0, name: str = "pages.arc", date: str = CAPTURED, media: str = "text/html") -> bytes:
    """One ARC record; white space in ``url`` is percent-encoded, as it separates fields."""
    url = _target(url)
    tail = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} {media} {tail}{len(block)}\n".encode("utf-8", "surrogatepass") + block + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file (gzipped or not), the version block aside.

    Raises :class:`ArchiveError` where the version is unknown, a header line lacks fields or a
    declared length is no number or reaches beyond the end.
    """
    if data[:2] == b"\x1f\x8b":
        data = _unzipped(data)
    if not data:
        return
    at, names, version = 0, ARC_FIELDS[1].split(), 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split(" ")
        if end < 0 or not version and not line[0].startswith("filedesc://") or version and len(line) != len(names):
            raise ArchiveError(f"bad header line at byte {at}")
        if not line[-1].isdigit() or end + 1 + int(line[-1]) > len(data):
            raise ArchiveError(f"bad length at byte {at}")
        block = data[end + 1 : end + 1 + int(line[-1])]
        if version:
            yield ArcRecord(dict(zip(names, line, strict=True)), block, at, version)
        else:
            rows = block.decode("utf-8", "replace").split("\n")
            if rows[0].split(" ")[0] not in ("1", "2"):
                raise ArchiveError(f"unknown version {rows[0]!r}")
            version = int(rows[0][0])
            names = rows[1].split(" ") if len(rows) > 1 and rows[1].strip() else ARC_FIELDS[version].split()
        at = end + 1 + len(block)


def _unzipped(data: bytes) -> bytes:
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out)


def payload_of(block: bytes, is_http: bool) -> bytes:
    """The block without the HTTP header, if it is an HTTP response."""
    at = block.find(b"\r\n\r\n") if is_http else -1
    return block[at + 4 :] if at >= 0 else block


def iso_date(date: str) -> str:
    """A date of an ARC header line as WARC writes it; missing parts (there may be 8 or 12 digits) are zero."""
    try:
        return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError as e:
        raise ArchiveError(f"bad date {date!r}") from e


def to_warc(arc: ArcRecord, archive: str = "") -> Record:
    """The WARC equivalent of an ARC record.

    HTTP blocks become ``response`` records, others ``resource``. The identifier is derived from
    the archive's name, which says where it lies, and the record's offset in it.
    """
    f = arc.fields
    http = f["URL"].startswith(("http://", "https://")) and arc.block.startswith(b"HTTP/") or arc.block.startswith(b"HTTP/1.")
    media = "application/http; msgtype=response" if http else f["Content-type"]
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{arc.offset}:{f['URL']}')}"
    fields = {
        "WARC-Type": "response" if http else "resource",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": iso_date(f["Archive-date"]),
        "WARC-Target-URI": f["URL"],
        "WARC-IP-Address": f["IP-address"],
        "Content-Type": media,
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(arc.block).hexdigest(),
        "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload_of(arc.block, http)).hexdigest(),
    }
    return Record(fields, arc.block)


def as_revisit(record: Record, uri: str, date: str) -> Record:
    """The same capture without its payload, which the capture of ``uri`` at ``date`` holds; the HTTP header stays."""
    payload = payload_of(record.block, True)
    block = record.block[: len(record.block) - len(payload)]
    fields = record.fields | {
        "WARC-Type": "revisit",
        "WARC-Profile": REVISIT_PROFILE,
        "WARC-Refers-To-Target-URI": uri,
        "WARC-Refers-To-Date": date,
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
    }
    return Record(fields, block)


def convert(data: bytes, archive: str = "") -> bytes:
    """A whole ARC file as a WARC file."""
    return b"".join(to_warc(r, archive).to_bytes() for r in read_arc(data))


def read_warc(data: bytes) -> Iterator[Record]:
    """Records of a WARC file (gzipped as a whole, by record, or not) by their declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = _unzipped(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ArchiveError(f"bad record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields.pop("Content-Length"))
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        if at > len(data) or data[at - 4 : at] != b"\r\n\r\n":
            raise ArchiveError("a record's length doesn't fit")
        yield Record(fields, block)


def _first_of_each(pages: DataFrame) -> DataFrame:
    """``(digest, first, first_url, first_date)`` of the payloads that several pages share."""
    one = F.struct("page_id", "url", "date")
    by = pages.where((F.col("size") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.min(one).alias("one"), F.count("*").alias("n"))
    return by.where(F.col("n") > 1).select("digest", "first", F.col("one.url").alias("first_url"), F.col("one.date").alias("first_date"))


def write_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Archive pages as gzipped WARC files under ``path``, by way of ARC records of both versions.

    Each row becomes an ARC record (version 1 for even ids, else 2), which is read by its header
    line and declared length and converted. Identifiers are derived from where a record is
    written, so they are unique, and the same if a task is run again. Of equal payloads of at least
    :data:`MIN_REVISIT_BYTES` the least id is the response and the others revisit it; repeated
    rows of that id are all responses. A null html is an empty payload, a null url
    ``about:blank``; a null id is kept as such and neither revisits nor is revisited. Captures are
    dated by ``time_col`` (a timestamp), all alike where there is none or it is null. Files hold
    about :data:`FILE_BYTES`, or one longer record. An empty input leaves no record.
    """
    captured = F.lit(CAPTURED)
    if time_col:
        captured = F.coalesce(F.date_format(time_col, "yyyyMMddHHmmss"), captured)
    url = F.coalesce(F.col(url_col), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), captured.alias("date"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    shared = written(_first_of_each(pages.select("page_id", "url", "date", "digest", "size")), "shared_payloads")
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    pages = pages.withColumn("digest", F.when(F.col("size") >= MIN_REVISIT_BYTES, F.col("digest")))  # short ones meet nothing
    pages = pages.join(shared, "digest", "left").select("page_id", "url", "date", "payload", "first", "first_url", "first_date")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, count, size, file = f"{path}/{TaskContext.get().partitionId()}", 0, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                records, files = [], []
                for row in batch.slice(a, 500).to_pylist():
                    records.append(_page(row, f"{name}/{count}")[:-2])
                    count, size = count + 1, size + len(records[-1])
                    files.append(file)
                    if size >= FILE_BYTES:
                        size, file = 0, file + 1
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(files, pa.int32())], names=["record", "file"])

    records = pages.mapInArrow(task, "record binary, file int").select(F.col("record").cast("string").alias("value"), "file")
    # The writer ends each row with a line break: the second of the two that end a record.
    records.write.partitionBy("file").option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _target(url: str) -> str:
    """The URL as an archive's header line holds it: white space, which separates fields, is percent-encoded."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "about:blank"


def _page(row: dict, place: str) -> bytes:
    page_id, payload = row["page_id"], row["payload"]
    version = 1 if (page_id or 0) % 2 == 0 else 2
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    archive = arc_version_block(version) + arc_record(version, row["url"], head + payload, date=row["date"])
    (arc,) = read_arc(archive)
    record = to_warc(arc, place)
    if page_id is not None:
        record.fields["X-Page-ID"] = str(page_id)
    if row["first"] is not None and page_id is not None and row["first"] != page_id:
        record = as_revisit(record, _target(row["first_url"]), iso_date(row["first_date"]))
        record.fields["X-Refers-To-Page-ID"] = str(row["first"])
    return record.to_bytes()


PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_pages(spark, path: str) -> DataFrame:
    """The records of the archives under ``path``: one row each, in :data:`PAGE_SCHEMA`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [_row(r) for r in read_warc(batch.column(0)[k].as_py())]
                columns = list(zip(*found, strict=True)) if found else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(task, PAGE_SCHEMA)


def _row(record: Record) -> tuple:
    """Raises :class:`ArchiveError` where a response's payload isn't as its headers say."""
    f = record.fields
    head = record.block.partition(b"\r\n\r\n")[0].decode("latin-1")
    size = int(re.search(r"(?im)^Content-Length: (\d+)", head)[1])
    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
    if f["WARC-Type"] == "response":
        payload = payload_of(record.block, True)
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError(f"the payload of {f['WARC-Record-ID']} isn't what its headers say")
    number = lambda name: int(f[name]) if name in f else None
    return number("X-Page-ID"), size, digest, f["WARC-Type"], number("X-Refers-To-Page-ID"), f["WARC-Target-URI"]


def round_trip(df: DataFrame) -> DataFrame:
    """Write ``df`` (``page_id``, ``url``, ``html``) to archives in the shared folder and read them back."""
    path = new_path(df.sparkSession, "archives")
    write_pages(df, path)
    return read_pages(df.sparkSession, path)
