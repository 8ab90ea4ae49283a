"""Archives and media: exact round trips."""

import hashlib
import io
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import media, warc
from gridloom.llm.common import new_folder
from gridloom.llm.files import open_file


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string, _digest string")


LONG = "<p>" + "é" * 800
PAGES = [
    (1, "http://a/ b", LONG, "x", "y"),
    (2, None, LONG, "x", "y"),
    (3, "http://c", LONG + "!", None, None),
    (4, "http://d\n", "short", None, None),
    (5, "http://e", "short", None, None),
    (6, "http://f", None, None, None),
    (7, "", "", None, None),
    (8, "http://g", "HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n" + "z" * 2000, None, None),
    (9, "http://h", "z" * 3_000_000, None, None),
    (3, "http://c", LONG + "!", None, None),
    (None, "http://n", LONG, None, None),
]


def test_archive_round_trip(spark):
    got = [tuple(r) for r in warc.archive_round_trip(pages(spark, PAGES)).select("source_id", "record_type", "payload_bytes", "payload_digest", "refers_to").collect()]
    want = []
    for i, _, html, *_ in PAGES:
        raw = (html or "").encode()
        first = max((j for j, _, h, *_ in PAGES if j is not None and (h or "") == (html or "")), default=None)
        other = first if len(raw) >= 1000 and first != i else None
        want.append((i, "revisit" if other is not None else "response", len(raw), hashlib.sha1(raw).hexdigest(), other))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_layouts(version):
    data = warc.arc_version_block(version, "f.arc") + warc.arc_record(version, "http://a", "1.2.3.4", "2001", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi\n") + warc.arc_record(version, "http://b", "1.2.3.4", "20010203040506", "text/plain", b"")
    a, b = warc.parse_arc(data)
    assert a.block.endswith(b"hi\n") and b.block == b"" and a.fields["URL"] == "http://a" and len(a.fields) == len(warc.FIELDS[version])
    member = warc.gzip_member(warc.to_warc(a, 5)) + warc.gzip_member(warc.to_warc(b, 6)) + warc.gzip_member(warc.to_warc(a, 7, 5))
    records = list(warc.parse_warc(io.BytesIO(member), 7))
    assert [r[0]["WARC-Type"] for r in records] == ["response", "resource", "revisit"]
    assert records[0][0]["WARC-Date"] == "2001-01-01T00:00:00Z" and records[1][0]["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert records[0][0]["WARC-Payload-Digest"] == records[2][0]["WARC-Payload-Digest"] == warc.sha1_label(b"hi\n")
    assert records[2][1] == b"HTTP/1.0 200 OK\r\n\r\n" and records[0][0]["WARC-Record-ID"] != records[2][0]["WARC-Record-ID"]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse_warc(io.BytesIO(member[:-9])))


def test_revisits_name_the_responding_record(spark):
    """By the standard fields, in every archive that begins with a record about itself."""
    folder = new_folder(spark, "warc-test")
    manifest = warc.write_archives(warc.decide(pages(spark, PAGES)), folder)
    found = []
    for r in manifest.collect():
        with open_file(folder, r["archive"]) as stream:
            records = [f for f, _ in warc.parse_warc(stream)]
        assert records[0]["WARC-Type"] == "warcinfo" and records[0]["WARC-Filename"] == r["archive"] and len(records) == r["records"] + 1
        found += records[1:]
    by = {f["WARC-Record-ID"]: f for f in found}
    revisits = [f for f in found if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 2
    for f in revisits:
        first = by[f["WARC-Refers-To"]]
        assert (first["WARC-Type"], first["X-Source-Id"]) == ("response", "2")
        assert (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"]) == (first["WARC-Target-URI"], first["WARC-Date"])
        assert f["WARC-Payload-Digest"] == first["WARC-Payload-Digest"]


def test_wrong_arcs():
    good = warc.arc_version_block(1, "f") + warc.arc_record(1, "u", "i", "d", "t", b"12345")
    for wrong in (good[:-4], good.replace(b"u i d t 5", b"u i d t 99"), good.replace(b"u i d t 5", b"u i d 5"), good.replace(b"1 0 Origin", b"9 0 Origin")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(wrong))


def test_media(spark, docs, rows, none):
    out = {}
    for r in media.media_columns(docs).collect():
        out.setdefault((r["doc_id"], r["n_bytes"], r["payload_sha256"]), r)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[(i, len(raw), hashlib.sha256(payload).hexdigest())]
        assert (r["payload_bytes"], r["tail_crc32"], r["width"] * r["height"]) == (len(payload), zlib.crc32(payload[-64:]), len(payload))
        assert r["digest"] == hashlib.sha256(media.to_png(payload)).hexdigest() and r["media_bytes"] == len(media.to_png(payload))
    assert media.media_columns(docs).count() == len(rows)
    assert media.media_columns(none).count() == 0


def test_media_rows_have_addresses_and_headers(spark, docs, rows):
    got = media.media_columns(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["shard"] and r["offset"] % 512 == 0 and r["length"] == r["media_bytes"]
        assert r["width"] == media.WIDTH and r["width"] * r["height"] == r["payload_bytes"] and r["depth"] == 8


def test_shards_and_range_reads(spark, docs):
    folder = new_folder(spark, "media-test")
    index = media.store(docs, folder)
    at = media.addresses(index)
    assert at.count() == index.select("digest").distinct().count()
    heads = media.with_headers(at, folder).collect()
    full = {r["digest"]: r for r in media.with_payloads(at, folder).collect()}
    assert heads and all((full[h["digest"]]["width"], full[h["digest"]]["height"]) == (h["width"], h["height"]) and h["depth"] == 8 for h in heads)
    # every shard is a tar archive of payloads named by their digests
    shard = index.select("shard").first()[0]
    with open_file(folder, shard) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        names = tar.getnames()
        assert len(names) == len(set(names))
        for m in tar.getmembers():
            data = tar.extractfile(m).read()
            assert m.name == hashlib.sha256(data).hexdigest() + ".png"
            assert media.to_png(media.from_png(data)) == data
    row = index.where(F.col("shard") == shard).first()
    with open_file(folder, shard) as f:
        assert hashlib.sha256(f.read_at(row["length"], row["offset"])).hexdigest() == row["digest"]


def test_damage_is_found():
    png = bytearray(media.to_png(media.padded(b"hello")))
    png[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(png))
    with pytest.raises(ValueError):
        media.header(b"GIF89a" + bytes(40))
