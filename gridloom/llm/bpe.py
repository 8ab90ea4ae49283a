"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library. Long texts are cut first, at places where every pattern match ends anyhow:
between an ASCII letter or digit and a following space. No match of the pattern goes from one to the other, and the
pattern looks only ahead and only from white space, so the ids of the parts are the ids of the whole.

Null texts count as empty and give no ids. Repeated rows give repeated results. Columns of the input other than the
named ones do not matter; ``keep`` names those that are carried along.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import map_batches, texts

#: Characters in one call of the encoder; longer texts are cut at safe places near multiples of it.
PART_CHARS = 1 << 18

_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= )")


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of about ``size`` characters whose encodings join to that of the text. A stretch without a safe place stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    _known: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        """One codec for each Python worker."""
        key = (ranks_path, pattern)
        if key not in cls._known:
            cls._known[key] = cls(ranks_path, pattern)
        return cls._known[key]

    def encode(self, text: str) -> list[int]:
        if len(text) <= PART_CHARS:
            return self.encoding.encode_ordinary(text)
        return [i for part in safe_parts(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Raw bytes; they need not be whole characters."""
        return self.encoding.decode_bytes(ids)


#: From the ids and the decoded bytes of a text, a row of further columns.
Derive = Callable[[list[int], bytes], tuple]


def encode(df: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, ids array<int>) of every text."""

    def run(batches):
        codec = Codec.of(ranks_path, pattern)
        for b in batches:
            ids = [codec.encode(x) for x in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[keep, "ids"])

    kind = dict(df.dtypes)[keep]
    return map_batches(df.select(keep, text), run, f"`{keep}` {kind}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", keep: str = "doc_id") -> DataFrame:
    """(keep, bytes binary) of every list of ids; null counts as empty."""

    def run(batches):
        codec = Codec.of(ranks_path, pattern)
        for b in batches:
            out = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[keep, "bytes"])

    kind = dict(df.dtypes)[keep]
    return map_batches(df.select(keep, ids), run, f"`{keep}` {kind}, bytes binary")


def round_trip(df: DataFrame, ranks_path: str, derive: Derive, columns: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """Encodes and decodes every text in one pass, without sending ids back to the JVM: (keep, n_tokens, *columns), where
    ``derive(ids, decoded)`` gives the values of ``columns``."""

    def run(batches):
        codec = Codec.of(ranks_path, pattern)
        names = [c.split()[0] for c in columns.split(",")]
        for b in batches:
            counts, rows = [], []
            for x in texts(b.column(1)):
                ids = codec.encode(x)
                counts.append(len(ids))
                rows.append(derive(ids, codec.decode(ids)))
            more = [pa.array(v) for v in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *more], names=[keep, "n_tokens", *names])

    kind = dict(df.dtypes)[keep]
    return map_batches(df.select(keep, text), run, f"`{keep}` {kind}, n_tokens long, {columns}")


def digests(ids: list[int], decoded: bytes) -> tuple[str, str]:
    """Hex SHA-256 of the ids as little-endian unsigned 32-bit integers, and of the decoded bytes."""
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()
