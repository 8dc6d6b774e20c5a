"""Operator 7: ARC archives of both versions converted to WARC files, and WARC files read back.

An ARC file starts with a version block whose lines name the version and the fields of the header
line that precedes every record: five fields in version 1, ten in version 2. The last field is the
declared length of the block that follows; the parser goes by that length alone, so what a block
holds cannot mislead it. Each network record becomes a WARC record with an identifier, timestamp,
type and digests made from what the ARC record says.

Archives are rows (name, content) of bounded size, as binaryFile gives them, and a task streams
through one at a time. Of records with equal payloads the one with the smallest id is kept whole and
the others become revisits; that choice is an aggregation by digest combined before its shuffle, met
with the records by a salted join, so one payload may have any number of copies.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.llm.common import salted_join

# The header fields of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads of fewer bytes are always kept whole.
REVISIT_BYTES = 100
#: Payload bytes after which an ARC archive is closed, and records after which a WARC file is.
ARC_BYTES, WARC_RECORDS = 4 << 20, 4000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The header that carries a record's id through both formats.
ID_HEADER = "X-Record-Id"


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    offset: int
    block: bytes


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    """One record: the version's header line and the block."""
    values = {
        "URL": url or "-",
        "IP-address": "0.0.0.0",
        "Archive-date": date,
        "Content-type": "text/html",
        "Result-code": "200",
        "Checksum": hashlib.md5(block).hexdigest(),
        "Location": "-",
        "Offset": str(offset),
        "Filename": name,
        "Archive-length": str(len(block)),
    }
    return (" ".join(values[f] for f in FIELDS[version].split()) + "\n").encode() + block + b"\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 none\n{FIELDS[version]}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"}.get(version)
    line = line or f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def parse_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records after the version block, by declared lengths. Raises on a header that does not fit."""
    if not content:
        return
    end = content.index(b"\n")
    start_line = content[:end].decode("utf-8", "replace").split(" ")
    if not start_line[0].startswith("filedesc:"):
        raise ValueError("an ARC file starts with a version block")
    body = content[end + 1 : end + 1 + int(start_line[-1])]
    lines = body.decode("utf-8", "replace").splitlines()
    version = int(lines[0].split(" ")[0])
    if version not in FIELDS or lines[1] != FIELDS[version]:
        raise ValueError(f"unknown ARC version block: {lines[:2]}")
    names, at = FIELDS[version].split(), end + 1 + len(body)
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"record at {at} is cut off")
        values = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(values) != len(names):
            raise ValueError(f"record at {at} has {len(values)} fields, version {version} has {len(names)}")
        fields = dict(zip(names, values, strict=True))
        length = int(fields["Archive-length"])
        if end + 1 + length > len(content):
            raise ValueError(f"record at {at} is cut off")
        yield ArcRecord(fields, at, content[end + 1 : end + 1 + length])
        at = end + 1 + length


def pages_to_arc(pages: DataFrame, key: str, url: str, html: str, version_of: str, date: str = "20240101000000") -> DataFrame:
    """Archives (name, content) of the pages, in either version as the SQL expression `version_of` says.

    Blanks and non-ASCII characters of urls are percent-encoded, as a header line is split at blanks.
    """
    rows = pages.select(
        F.col(key).cast("string").alias("id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"), F.expr(version_of).alias("version")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict[int, tuple[str, list[bytes], int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                version, html = row["version"], row["html"] or b""
                if version not in open_files:
                    name = f"{uuid.uuid4().hex}.arc"
                    first = arc_start(version, name, date)
                    open_files[version] = (name, [first], len(first))
                name, parts, size = open_files[version]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(html)}\r\n"
                head += f"{ID_HEADER}: {row['id']}\r\n\r\n" if row["id"] is not None else "\r\n"
                clean = quote(row["url"] or "", safe="!#$%&'()*+,/:;=?@[]~")
                parts.append(arc_record(version, clean, date, head.encode() + html, size, name))
                size += len(parts[-1])
                open_files[version] = (name, parts, size)
                if size >= ARC_BYTES:
                    del open_files[version]
                    yield _archive(name, parts)
        for name, parts, _ in open_files.values():
            yield _archive(name, parts)

    return rows.mapInArrow(pack, "name string, content binary")


def _archive(name: str, parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header lines with their blank line, and payload; a block without HTTP is all payload."""
    if block.startswith(b"HTTP/"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        if blank:
            return head + blank, payload
    return b"", block


def _http_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return found.group(1).decode("utf-8", "replace") if found else None


RECORD = (
    "id string, record_id string, uri string, date string, mime string, head binary, payload binary, payload_bytes bigint, payload_digest string"
)


def convert(archives: DataFrame) -> DataFrame:
    """One row per ARC record: the parts of the equivalent WARC record.

    The identifier is a name-based UUID of archive, offset and the record's header, so converting again
    gives the same; the timestamp is Archive-date in ISO form; digests are SHA-256 of the payload.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for record in parse_arc(content.as_py()):
                    head, payload = split_http(record.block)
                    f = record.fields
                    d = f["Archive-date"]
                    own = f"{f['URL']} {d} {record.offset} {hashlib.sha256(record.block).hexdigest()}"
                    out.append(
                        {
                            "id": _http_value(head, ID_HEADER),
                            "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own)}>",
                            "uri": f["URL"],
                            "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                            "mime": f["Content-type"],
                            "head": head,
                            "payload": payload,
                            "payload_bytes": len(payload),
                            "payload_digest": hashlib.sha256(payload).hexdigest(),
                        }
                    )
                    if len(out) >= 256:
                        yield _records(out)
                        out = []
                if out:
                    yield _records(out)

    return archives.select("name", "content").mapInArrow(parse, RECORD)


_SCHEMA = pa.schema(
    [(n, {"binary": pa.binary(), "bigint": pa.int64()}.get(k, pa.string())) for n, k in (c.split() for c in RECORD.split(", "))]
)


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def with_types(records: DataFrame, id_type: str = "bigint", least: int = REVISIT_BYTES) -> DataFrame:
    """Add record_type, refers_to (the smallest id of an equal payload) and its record_id, uri and date.

    Payloads under `least` bytes are responses. Rows that share the smallest id are all responses; with
    only null ids there is no smallest and all are responses.
    """
    numbered = records.withColumn("id", F.col("id").cast(id_type))
    long = numbered.where(F.col("payload_bytes") >= least).select("payload_digest", "id", "record_id", "uri", "date")
    first = long.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    whole = salted_join(long, first.drop("n"), ["payload_digest"], ["record_id"], salts=8).where("id = first")
    named = whole.groupBy("payload_digest", "first").agg(F.min(F.struct("record_id", "uri", "date")).alias("whole"))
    met = salted_join(numbered, named, ["payload_digest"], ["record_id"], "left", salts=8)
    again = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return met.select(
        *numbered.columns,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
        F.when(again, F.col("whole")).alias("whole"),
    )


def write_warc(typed: DataFrame, path: str, records_per_file: int = WARC_RECORDS) -> None:
    """Gzipped WARC files under `path`. A record's bytes go through the text writer, whose line end is the record's last CRLF."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = [warc_record(r) for r in batch.slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    laid = typed.mapInArrow(lay, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = laid.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.mode("errorifexists").text(path)


def warc_record(r: dict) -> bytes:
    """The record without its last CRLF: headers, block and one CRLF."""
    revisit = r["record_type"] == "revisit"
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type'] if r['head'] else 'resource'}",
        f"WARC-Record-ID: {r['record_id']}",
        f"WARC-Target-URI: {r['uri']}",
        f"WARC-Date: {r['date']}",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if r['head'] else r['mime']}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[1] = "WARC-Type: revisit"
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {r['whole']['record_id']}",
            f"WARC-Refers-To-Target-URI: {r['whole']['uri']}",
            f"WARC-Refers-To-Date: {r['whole']['date']}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n"


def _inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of a gzipped file of one or more members, or of a plain one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        engine = zlib.decompressobj(31)
        while rest and not engine.eof:
            yield engine.decompress(rest, 1 << 20)
            rest = engine.unconsumed_tail if not engine.eof else engine.unused_data


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by Content-Length; holds one record at a time."""
    held, source = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC record is cut off")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        while len(held) < end + 4 + length + 4:
            if not more():
                raise ValueError("a WARC record is cut off")
        yield headers, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length + 4]


READ = "id string, record_type string, record_id string, refers_to_record string, uri string, payload_bytes bigint, payload_digest string, sound boolean"


def read_warc(spark, path: str) -> DataFrame:
    """One row per WARC record under `path`. A response's length and digest are taken from its payload, a
    revisit's from its HTTP and WARC headers; `sound` says that the digests written fit the bytes read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"bigint": pa.int64(), "boolean": pa.bool_()}.get(k, pa.string())) for n, k in (c.split() for c in READ.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, block in parse_warc(_inflated(content.as_py())):
                    head, payload = split_http(block)
                    revisit = headers["warc-type"] == "revisit"
                    said = headers["warc-payload-digest"].partition(":")[2]
                    digest = said if revisit else hashlib.sha256(payload).hexdigest()
                    out.append(
                        {
                            "id": _http_value(head, ID_HEADER),
                            "record_type": headers["warc-type"],
                            "record_id": headers["warc-record-id"],
                            "refers_to_record": headers.get("warc-refers-to"),
                            "uri": headers["warc-target-uri"],
                            "payload_bytes": int(_http_value(head, "Content-Length") or 0) if revisit else len(payload),
                            "payload_digest": digest,
                            "sound": digest == said and headers["warc-block-digest"].partition(":")[2] == hashlib.sha256(block).hexdigest(),
                        }
                    )
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.mapInArrow(parse, READ)


def resolved(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Add refers_to, the id of the record that a revisit names, by a salted join on record ids."""
    numbered = records.withColumn("id", F.col("id").cast(id_type))
    revisits, rest = numbered.where("record_type = 'revisit'"), numbered.where("record_type <> 'revisit'")
    targets = rest.select(F.col("record_id").alias("refers_to_record"), F.col("id").alias("refers_to"))
    met = salted_join(revisits, targets, ["refers_to_record"], ["record_id"], "left", salts=8)
    return met.unionByName(rest.withColumn("refers_to", F.lit(None).cast(id_type)))
