"""Media columns: content-addressed payloads in tar shards, with metadata filled by header-only range reads.

``store`` turns each text into an 8-bit greyscale PNG, 64 samples wide, and appends it to the tar shard that its task
writes; a payload that the shard already holds is not written again. Rows carry the digest of the stored form, the
shard, the offset and the length. ``addresses`` gives each digest one address, the least (shard, offset).
``with_headers`` reads only the first bytes at each address and fills width, height, depth and form. ``with_payloads``
reads whole payloads back and computes features from the samples.

Null texts count as empty; the payload of an empty text is 64 zero bytes. Repeated texts share one address.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import make_folder, map_batches, materialize, new_folder, session_of, text_bytes
from gridloom.llm.files import new_file, open_file

WIDTH = 64
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: The signature, the size field, the kind and the 13 bytes of the first chunk: all that the metadata needs.
HEADER_BYTES = 33
LEVEL = 6

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of the width."""
    return raw + bytes(WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale image, a row for every 64 bytes, each row unfiltered."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image of to_png(); checks every chunk's sum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES of a stored payload."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack_from(">IIB", first, 16)


def feature(payload: bytes) -> str:
    """A coarse histogram of the samples: 16 levels as parts of 255, two hex digits each."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return (counts * 255 // max(1, len(payload))).astype(np.uint8).tobytes().hex()


def store(df: DataFrame, folder: str, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Writes shards into the folder; (keep, n_bytes, digest, shard, offset, length) of every row, as a written table."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        out, name, at, seen = None, "", 0, {}
        try:
            for b in batches:
                rows = []
                for raw in text_bytes(b.column(1)):
                    payload = padded(raw)
                    inside = hashlib.sha256(payload).digest()
                    if inside not in seen or seen[inside][1] != name:
                        if out is None or at > SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            name, out = new_file(folder, ".tar")
                            at, seen = 0, {}
                        media = to_png(payload)
                        digest = hashlib.sha256(media).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        entry = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(entry + media + bytes(-len(media) % 512))
                        seen[inside] = (digest, name, at + len(entry), len(media))
                        at += len(entry) + len(media) + -len(media) % 512
                    rows.append((len(raw), *seen[inside]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[keep, "n_bytes", "digest", "shard", "offset", "length"])
            if out is not None:
                out.write(bytes(1024))
        finally:
            if out is not None:
                out.close()

    make_folder(session_of(df), folder)
    kind = dict(df.dtypes)[keep]
    written = map_batches(df.select(keep, text), run, f"`{keep}` {kind}, n_bytes long, digest string, shard string, offset long, length long")
    return materialize(written, "media-index")


def addresses(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one address for each stored payload."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.shard", "a.offset", "a.length")


def _in_order(at: DataFrame) -> DataFrame:
    """Addresses dealt out by digest, each task reading its shards from front to back."""
    return at.repartition("digest").sortWithinPartitions("shard", "offset")


def _reading(folder: str, names: list[str], kinds: list[pa.DataType], of, whole: bool):
    def run(batches) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for b in batches:
                rows = []
                for digest, shard, offset, length in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if shard != name:
                        if file is not None:
                            file.close()
                        name, file = shard, open_file(folder, shard)
                    rows.append(of(digest, file.read_at(length if whole else min(length, HEADER_BYTES), offset)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["digest", *names])
        finally:
            if file is not None:
                file.close()

    return run


def with_headers(at: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, depth) by range reads of the first bytes at each address."""
    run = _reading(folder, ["width", "height", "depth"], [pa.int64(), pa.int64(), pa.int32()], lambda _, first: header(first), False)
    return map_batches(_in_order(at), run, "digest string, width long, height long, depth int")


def _features(digest: str, media: bytes) -> tuple:
    if hashlib.sha256(media).hexdigest() != digest:
        raise ValueError(f"the payload at {digest} is damaged")
    width, height, _ = header(media[:HEADER_BYTES])
    payload = from_png(media)
    return width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), feature(payload)


def with_payloads(at: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature) of the payloads read back."""
    names = ["width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    run = _reading(folder, names, kinds, _features, True)
    return map_batches(_in_order(at), run, "digest string, width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def media_columns(df: DataFrame, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Stores every text and joins its address, its header by a range read and what was read back to its row."""
    folder = new_folder(session_of(df), "media")
    index = store(df, folder, text, keep)
    at = addresses(index)
    read = materialize(with_payloads(at, folder).drop("width", "height"), "media-read")
    found = at.join(with_headers(at, folder), "digest").join(read, "digest")
    return index.select(keep, "n_bytes", "digest").join(found, "digest")
