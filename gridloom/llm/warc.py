"""Conversion of legacy ARC archives to WARC.

The parser takes the two header layouts that ARC files declare in their version block (``1``: five fields, ``2``: ten
fields) and reads each record by its declared length. The converter synthesises what WARC has and ARC lacks: an
identifier (a name-based UUID), a timestamp from the 14-digit date, a type, and block and payload digests. Records are
gzip members of their own, so an archive can be read from any record's offset.

Equal payloads of at least ``MIN_REVISIT`` bytes are written once, by the record with the largest source id; the others
become revisits with the same HTTP header and no payload, which name the responding record, its URL and date in the
standard header fields; the reader finds the responding row by that record's identifier. Each archive begins with a record
about itself.

Null payloads count as empty; a null URL becomes ``urn:none``. White space in URLs is percent-encoded, since ARC header lines
are divided by spaces. Rows that repeat the responding id and its payload are responses too. A null source id never
responds for others unless all ids of its group are null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import make_folder, map_batches, materialize, new_folder, session_of, text_bytes
from gridloom.llm.files import new_file, open_file

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
#: ARC records converted together; a memory bound.
ARC_RECORDS = 128

#: The field names of the two header layouts.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: The date of records laid out here.
ARC_DATE = "20200101000000"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """A record as its header line declares it."""

    fields: dict[str, str]
    block: bytes


def arc_version_block(version: int, file_name: str, date: str = ARC_DATE) -> bytes:
    """The first record of an ARC file, which names the layout of the header lines."""
    body = f"{version} 0 Origin\n{' '.join(FIELDS[version])}\n\n".encode()
    more = {1: "text/plain", 2: "text/plain 200 - - 0 " + file_name}[version]
    return f"filedesc://{file_name} 0.0.0.0 {date} {more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, offset: int = 0, file_name: str = "-", status: int = 200) -> bytes:
    """A record in the layout of the version."""
    more = {1: kind, 2: f"{kind} {status} {hashlib.md5(block).hexdigest()} - {offset} {file_name}"}[version]
    return f"{url} {ip} {date} {more} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block. Raises ValueError where a header line does not fit the declared layout or a
    length goes beyond the data."""
    at, names = 0, ()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at byte {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if not names:
            body = data[end + 1 : end + 1 + int(line[-1])]
            version = int(body.split(None, 1)[0])
            if not line[0].startswith("filedesc:") or version not in FIELDS:
                raise ValueError("the file does not begin with a known version block")
            names = FIELDS[version]
            at = end + 1 + int(line[-1])
            continue
        if len(line) != len(names):
            raise ValueError(f"{len(line)} fields at byte {at}, {len(names)} declared")
        size = int(line[-1])
        if size < 0 or end + 1 + size > len(data):
            raise ValueError(f"declared length {size} at byte {at} goes beyond the data")
        yield ArcRecord(dict(zip(names, line, strict=True)), data[end + 1 : end + 1 + size])
        at = end + 1 + size


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, source_id: object) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source_id} {url}')}>"


def warc_date(arc_date: str) -> str:
    """ISO 8601 from 14 digits; shorter dates are filled up."""
    d = (re.sub(r"[^0-9]", "", arc_date) + "00000101000000"[len(re.sub(r"[^0-9]", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; a block without HTTP header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def about(file_name: str, date: str = ARC_DATE) -> bytes:
    """The record that an archive begins with."""
    block = b"software: gridloom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('warcinfo', file_name)}", f"WARC-Date: {warc_date(date)}", f"WARC-Filename: {file_name}", f"WARC-Block-Digest: {sha1_label(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def to_warc(arc: ArcRecord, source_id: object, refers_to: object = None, refers_url: str | None = None, refers_date: str | None = None) -> bytes:
    """The WARC record for an ARC record; with ``refers_to`` a revisit of that source's record, which has that URL and date
    or else the same ones."""
    head, payload = http_payload(arc.block)
    revisit = refers_to is not None
    block = head if revisit else arc.block
    url = arc.fields["URL"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(url, source_id)}",
        f"WARC-Date: {warc_date(arc.fields['Archive-date'])}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {arc.fields['IP-address']}",
        f"WARC-Block-Digest: {sha1_label(block)}",
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        f"X-Source-Id: {'' if source_id is None else source_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        other = refers_url or url
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(other, refers_to)}", f"WARC-Refers-To-Target-URI: {other}"]
        lines += [f"WARC-Refers-To-Date: {warc_date(refers_date or arc.fields['Archive-date'])}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else arc.fields['Content-type']}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_warc(stream: BinaryIO, read_size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a gzip archive, one member each, read from front to back."""
    raw, z, out = b"", zlib.decompressobj(31), []
    while True:
        if not raw:
            raw = stream.read(read_size)
            if not raw:
                if out and b"".join(out):
                    raise ValueError("the archive ends inside a record")
                return
        out.append(z.decompress(raw))
        if z.eof:
            raw, z, record, out = z.unused_data, zlib.decompressobj(31), b"".join(out), []
            head, _, rest = record.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
            block = rest[: int(fields["Content-Length"])]
            if sha1_label(block) != fields["WARC-Block-Digest"]:
                raise ValueError(f"block of {fields['WARC-Record-ID']} is damaged")
            yield fields, block
        else:
            raw = b""


def decide(df: DataFrame, url: str = "url", payload: str = "html", keep: str = "page_id") -> DataFrame:
    """The rows with ``refers_to``: the largest id among equal payloads of at least MIN_REVISIT bytes, where that is
    another; and ``refers_url``, the URL of its row (the largest, where rows repeat the id)."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = df.withColumns({"_digest": F.sha2(raw, 256), "_size": F.octet_length(raw)})
    big = rows.where(F.col("_size") >= MIN_REVISIT).groupBy("_digest").agg(F.max(F.struct(F.col(keep).alias("id"), F.col(url).alias("url"))).alias("_f"), F.count("*").alias("_n"))
    shared = materialize(big.where("_n > 1").select("_digest", F.col("_f.id").alias("_first"), F.col("_f.url").alias("_url")), "warc-shared")
    out = rows.join(shared, "_digest", "left")
    other = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col(keep))
    return out.withColumns({"refers_to": F.when(other, F.col("_first")), "refers_url": F.when(other, F.coalesce("_url", F.lit("")))}).drop("_digest", "_size", "_first", "_url")


def header_url(url: str | None) -> str:
    """A URL as it may stand in a header line: white space is percent-encoded, none is ``urn:none``."""
    return re.sub(r"\s", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url or "urn:none")


def write_archives(df: DataFrame, folder: str, url: str = "url", payload: str = "html", keep: str = "page_id", refers_to: str = "refers_to", refers_url: str = "refers_url") -> DataFrame:
    """Lays every row out as an ARC record, converts it and appends it to the WARC archive that its task writes;
    (archive, records, bytes) of every archive, as a written table."""

    def arc_file(version: int, rows: list[tuple]) -> bytes:
        parts = [arc_version_block(version, "legacy.arc")]
        at = len(parts[0])
        for _, address, body, *_ in rows:
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
            parts.append(arc_record(version, address, "0.0.0.0", ARC_DATE, "text/html", head + body, at, "legacy.arc"))
            at += len(parts[-1])
        return b"".join(parts)

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, name, size, records, done, version = None, "", 0, 0, [], 1
        try:
            for b in batches:
                ids, urls, refs, others = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
                rows = [(i, header_url(u), body, r, header_url(o)) for i, u, body, r, o in zip(ids, urls, text_bytes(b.column(2)), refs, others, strict=True)]
                for start in range(0, len(rows), ARC_RECORDS):
                    some = rows[start : start + ARC_RECORDS]
                    for (source_id, _, _, ref, other), arc in zip(some, parse_arc(arc_file(version, some)), strict=True):
                        if out is None or size > ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                                done.append((name, records, size))
                            name, out = new_file(folder, ".warc.gz")
                            first = gzip_member(about(name))
                            out.write(first)
                            size, records = len(first), 0
                        member = gzip_member(to_warc(arc, source_id, ref, other, ARC_DATE))
                        out.write(member)
                        size, records = size + len(member), records + 1
                    version = 3 - version
            if out is not None:
                done.append((name, records, size))
        finally:
            if out is not None:
                out.close()
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "records", "bytes"])

    make_folder(session_of(df), folder)
    return materialize(map_batches(df.select(keep, url, payload, refers_to, refers_url), run, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(source_id, url, record_type, payload_bytes, payload_digest, record_id, refers_record) of every record of the
    archives but those about themselves; identifiers without their frame."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = ["source_id", "url", "record_type", "payload_bytes", "payload_digest", "record_id", "refers_record"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for archive in b.column(0).to_pylist():
                with open_file(folder, archive) as stream:
                    for fields, block in parse_warc(stream):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = fields["WARC-Payload-Digest"]
                        if kind == "revisit":
                            size = int(fields["X-Payload-Length"])
                        else:
                            _, payload = http_payload(block)
                            size = len(payload)
                            if sha1_label(payload) != digest:
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        own = fields["X-Source-Id"]
                        bare = lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">")
                        rows.append((int(own) if own else None, fields["WARC-Target-URI"], kind, size, base64.b32decode(digest.removeprefix("sha1:")).hex(), bare(fields["WARC-Record-ID"]), bare(fields.get("WARC-Refers-To"))))
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    parts = max(1, manifest.count())
    return map_batches(manifest.select("archive").repartition(parts), run, "source_id long, url string, record_type string, payload_bytes long, payload_digest string, record_id string, refers_record string")


def resolved(records: DataFrame) -> DataFrame:
    """The records with ``refers_to``, the source id of the record that a revisit names. Only revisits and the records that
    they name are joined."""
    wanted = records.where(F.col("refers_record").isNotNull()).select(F.col("refers_record").alias("record_id")).distinct()
    named = records.where("record_type <> 'revisit'").join(wanted, "record_id", "left_semi").select("record_id", "source_id").distinct()
    named = materialize(named.select(F.col("record_id").alias("refers_record"), F.col("source_id").alias("refers_to")), "warc-named", narrow=True)
    return records.join(named, "refers_record", "left")


def archive_round_trip(df: DataFrame, url: str = "url", payload: str = "html", keep: str = "page_id") -> DataFrame:
    """Writes every row as a WARC record and reads the archives back."""
    folder = new_folder(session_of(df), "warc")
    manifest = write_archives(decide(df.select(keep, url, payload), url, payload, keep), folder, url, payload, keep)
    return resolved(materialize(read_archives(manifest, folder), "warc-records"))
