"""Legacy archive converter: ARC files (versions 1 and 2) to WARC 1.1, and readers and writers of both.

An ARC record is a header line whose fields depend on the version that the file's first record declares, then as many bytes
as the line's last field says.  The converter reads by these lengths and makes up what WARC wants and ARC lacks: record ids
(from digest, address and place, so a rerun agrees), ISO dates, types and SHA-1 digests.  Files hold one gzip member a record
and are written in pieces of bounded size by Spark tasks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermark.llm.common import read_blobs, scratch_dir, stored, write_blobs

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLOB = pa.schema([("blob", pa.binary())])
FILE_BYTES = 8 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_EMPTY_MEMBER = member(b"")  # ends in a zero byte, as does any member of under 16 MB


def members(data: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        out, at = [], 0
        while not z.eof and at < len(view):
            out.append(z.decompress(view[at : at + 65536]))
            at += 65536
        if not z.eof:
            raise ValueError("a gzip member ends early")
        view = view[min(at, len(view)) - len(z.unused_data) :]
        yield b"".join(out)


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 tiermark\n{ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, status: int, place: int, name: str, doc: bytes) -> bytes:
    extra = f" {status} {sha1_base32(doc)} - {place} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{extra} {len(doc)}\n".encode() + doc + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Fields and content of every record after the version block; the block's own fields name those of the rest."""
    fields: list[str] = []
    for record in members(data):
        at = 0
        while at < len(record):
            end = record.index(b"\n", at)
            line = record[at:end].decode("utf-8", "replace").split(" ")
            if not fields:
                body = record[end + 1 : end + 1 + int(line[-1])]
                version = int(body.split(b" ", 1)[0])
                fields = ARC_FIELDS[version].split(" ")
            elif len(line) < len(fields):
                raise ValueError(f"an ARC header line has {len(line)} fields, not {len(fields)}")
            else:  # a stray blank can only be in the address, which comes first
                cut = len(line) - len(fields) + 1
                head = dict(zip(fields, [" ".join(line[:cut]), *line[cut:]]))
                yield head, record[end + 1 : end + 1 + int(head["Archive-length"])]
            at = end + 1 + int(line[-1]) + 1


def split_http(doc: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), head and payload of an HTTP response; without a status line it is all payload."""
    if not doc.startswith(b"HTTP/"):
        return {}, b"", doc
    head, blank, payload = doc.partition(b"\r\n\r\n")
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in pairs}, head + blank, payload


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for record in members(data):
        if not record:
            continue
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, rest[: int(fields["Content-Length"])]


def synthesise(head: dict, doc: bytes, place: str) -> tuple[dict[str, str], bytes, bytes, dict[str, str]]:
    """WARC fields that an ARC record lacks, its HTTP head, its payload and its HTTP fields."""
    http, top, payload = split_http(doc)
    date = head["Archive-date"].ljust(14, "0")
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    sha1 = sha1_base32(payload)
    fields = {
        "WARC-Type": "response" if top else "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((head['URL'], when, sha1, place)))}>",
        "WARC-Date": when,
        "WARC-Target-URI": head["URL"],
        "WARC-IP-Address": head["IP-address"],
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "Content-Type": "application/http; msgtype=response" if top else head["Content-type"],
    }
    return fields, top, payload, http


def _pieces(records: Iterator[bytes], first, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """One batch of one blob for every file_bytes of packed records; first(k) is the first record of the k-th file."""
    k, held, size = 0, [], 0
    for r in records:
        if not held:
            held = [member(first(k))]
        packed = member(r)
        held.append(packed if packed[-1] == 0 else packed + _EMPTY_MEMBER)
        size += len(packed)
        if size >= file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], schema=_BLOB)
            k, held, size = k + 1, [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], schema=_BLOB)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20200101000000", file_bytes: int = FILE_BYTES) -> None:
    """Pages as ARC files of versions 1 and 2 in turn, the key in the HTTP field X-Row-Key.  A null payload is empty, a null
    address is "unknown:", blanks and what is not printable in addresses are escaped."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = lambda k: f"part-{part:05d}-{k:03d}.arc"

        def records() -> Iterator[bytes]:
            n = 0
            for batch in batches:
                for k, u, body in zip(batch.column(0), batch.column(1), batch.column(2)):
                    data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                    row = f"X-Row-Key: {k.as_py()}\r\n" if k.is_valid else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{row}Content-Length: {len(data)}\r\n\r\n".encode()
                    address = quote(u.as_py() or "unknown:", safe="!#$%&'()*+,/:;=?@[]~")
                    yield arc_record(version, address, "0.0.0.0", date, "text/html", 200, n, name(0), head + data)
                    n += 1

        yield from _pieces(records(), lambda k: arc_header(version, name(k), date), file_bytes)

    write_blobs(pages.select(F.col(key).cast("string"), F.col(url).cast("string"), F.col(payload).cast("string")).mapInArrow(packed, "blob binary"), "blob", path)


_SEEN = "file string, at bigint, row_key string, record_id string, uri string, date string, sha1 string, bytes bigint"


def _names(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def scan_arc(spark: SparkSession, arc_path: str) -> DataFrame:
    """A row for every ARC record: where it is, its row key if it has one, the WARC identifier and digest it will get."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                rows, file = [], _names(path.as_py())
                for at, (head, doc) in enumerate(parse_arc(data.as_py())):
                    fields, _, payload, http = synthesise(head, doc, f"{file}:{at}")
                    rows.append((file, at, http.get("x-row-key"), fields["WARC-Record-ID"], head["URL"], fields["WARC-Date"], fields["WARC-Payload-Digest"][5:], len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCAN)], names=_SCAN_NAMES)

    return read_blobs(spark, arc_path).mapInArrow(scanned, _SEEN)


_SCAN = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
_SCAN_NAMES = [x.split(" ")[0] for x in _SEEN.split(", ")]


def revisits(scan: DataFrame, least_bytes: int = 0, order: str = "bigint") -> DataFrame:
    """Which records repeat the payload of another: file, at, and of the first record (the smallest row key, as `order`; then
    place) its id, address and date.  Payloads of fewer than least_bytes bytes never do."""
    place = F.struct(F.col("row_key").isNull().alias("none"), F.col("row_key").try_cast(order).alias("k"), "file", "at", "record_id", "uri", "date")
    equal = scan.where(F.col("bytes") >= least_bytes)
    first = stored(equal.groupBy("sha1", "bytes").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    hit = equal.select("file", "at", "sha1", "bytes").join(first, ["sha1", "bytes"]).where("file <> f.file or at <> f.at")
    return hit.select("file", "at", F.col("f.record_id").alias("to_id"), F.col("f.uri").alias("to_uri"), F.col("f.date").alias("to_date"))


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """ARC files to WARC files: a warcinfo record, then a response (resource without an HTTP head) or revisit record for each."""
    scan = stored(scan_arc(spark, arc_path), "scan")
    by_file = revisits(scan, least_bytes).groupBy("file").agg(F.collect_list(F.struct("at", "to_id", "to_uri", "to_date")).alias("repeats"))  # as many as a file has records
    blobs = read_blobs(spark, arc_path).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(by_file, "file", "left").select("file", "content", "repeats")

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for file, data, repeats in zip(*(batch.column(k) for k in range(3))):
                    again = {r["at"]: r for r in repeats.as_py() or ()}
                    for at, (head, doc) in enumerate(parse_arc(data.as_py())):
                        fields, top, payload, http = synthesise(head, doc, f"{file.as_py()}:{at}")
                        if "x-row-key" in http:
                            fields["X-Row-Key"] = http["x-row-key"]
                        if r := again.get(at):
                            fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": r["to_id"], "WARC-Refers-To-Target-URI": r["to_uri"], "WARC-Refers-To-Date": r["to_date"]}
                            yield warc_record(fields, top)
                        else:
                            yield warc_record(fields, top + payload)

        def info(k: int) -> bytes:
            return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}:{k}')}>", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Filename": f"part-{part:05d}-{k:03d}.warc.gz", "Content-Type": "application/warc-fields"}, b"software: tiermark\r\nformat: WARC File Format 1.1\r\n")

        yield from _pieces(records(), info, file_bytes)

    write_blobs(blobs.mapInArrow(converted, "blob binary"), "blob", warc_path)


_READ = "record_type string, row_key string, record_id string, refers_to_id string, uri string, date string, declared_sha1 string, sha1 string, bytes bigint, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every record but warcinfo.  sha1 and bytes are of the payload that the record itself holds (null: revisit)."""
    fields = [pa.field(x.split(" ")[0], {"bigint": pa.int64(), "binary": pa.binary()}.get(x.split(" ")[1], pa.string())) for x in _READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, block in parse_warc(data.as_py()):
                    if (kind := head["WARC-Type"]) == "warcinfo":
                        continue
                    body = None if kind == "revisit" else split_http(block)[2]
                    own = (None, None, None) if body is None else (sha1_base32(body), len(body), body if payloads else None)
                    rows.append((kind, head.get("X-Row-Key"), head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Payload-Digest"][5:], *own))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields], schema=pa.schema(fields))

    return read_blobs(spark, path).mapInArrow(read, _READ)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages through ARC files into WARC files and back: key, payload_bytes, payload_digest, record_type, refers_to.

    Repeated keys give as many records; a null key is kept and is no record's original while an equal payload has one; a
    null payload is an empty one; an empty table gives no record.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    arc, warc = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    write_arc(pages, arc, key, url, payload)
    convert_arc(spark, arc, warc)
    records = stored(read_warc(spark, warc, payloads=False), "records")
    held = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("row_key").alias("to_key"), F.col("sha1").alias("to_sha1"), F.col("bytes").alias("to_bytes"))
    full = records.join(held, "refers_to_id", "left")
    return full.select(
        F.col("row_key").cast(kind).alias(key), F.coalesce("bytes", "to_bytes").alias("payload_bytes"), F.coalesce("sha1", "to_sha1").alias("payload_digest"),
        F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type"), F.col("to_key").cast(kind).alias("refers_to"),
    )
