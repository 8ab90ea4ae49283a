"""Exact substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash of shift 4 rolls over the bytes, so its 64 bits depend on the last 16. At the end of every word the mixed
hash is a rank; a chunk ends where the rank is the strict least among ``radius`` words to both sides. Cuts so depend on
nearby content only: an insertion moves the chunks around it and no others. Chunks have more than ``radius`` words; where
ranks tie for long (a word repeated over and over), a chunk is cut after ``LONGEST`` words.

Chunks are deduplicated by a 128-bit digest of their bytes without white space at the ends. The first occurrence, by id
and then by place, stays. Of the others, runs of consecutive chunks with at least ``min_words`` words are removed.

Null texts stay null. Texts without any repeated run come back unchanged, byte for byte. A text whose chunks all are
repeats becomes empty. Rows of the same id and text count as one document; texts of the same id that differ are documents
of their own, the first of which is that with the least hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, map_batches, materialize, text_bytes

#: Words to each side among which a cut's rank must be the least.
RADIUS = 4
#: Words after which a chunk without a cut ends.
LONGEST = 64
#: Words in a run of repeated chunks from which it is removed. Of a passage of 51 words, 38 lie in such a run as a rule, and 20
#: or more in 99 of 100; shorter repeats (a licence line, a greeting) are left alone.
MIN_WORDS = 20

_G = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _gear() -> np.ndarray:
    """A 64-bit value for each byte."""
    return np.frombuffer(hashlib.shake_256(b"gear").digest(256 * 8), "<u8")


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 4) + GEAR[data[i]] modulo 2**64, for all i. Since a byte has left after 16 steps, the sums are
    doubled four times instead of rolled."""
    h = GEAR[data]
    for span in (1, 2, 4, 8):
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint64(4 * span))
    return h


def _ends(data: np.ndarray) -> np.ndarray:
    """Positions after the last byte of every word."""
    space = _SPACE[data]
    last = ~space
    last[:-1] &= space[1:]
    return np.flatnonzero(last) + 1


def cuts(data: bytes, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Ends of the chunks in bytes and their word counts; the last chunk ends at the last word."""
    raw = np.frombuffer(data, np.uint8)
    ends = _ends(raw)
    n = len(ends)
    if not n:
        return [], []
    rank = gear_hash(raw)[ends - 1]
    rank = (rank ^ (rank >> np.uint64(29))) * _G
    rank ^= rank >> np.uint64(32)
    least = np.ones(n, bool)
    for d in range(1, radius + 1):
        below = rank[d:] < rank[:-d]
        above = rank[:-d] < rank[d:]
        least[d:] &= below
        least[:-d] &= above
    # a cut needs its whole neighbourhood, so that it does not depend on where the text begins or ends
    least[:radius] = False
    least[n - radius :] = False
    at = np.flatnonzero(least) + 1  # words before each cut
    at = at[at < n]
    bounds = np.concatenate([[0], at, [n]])
    if (np.diff(bounds) > LONGEST).any():
        full = [np.arange(a, b, LONGEST) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        bounds = np.concatenate([*full, [n]])
    return ends[bounds[1:] - 1].tolist(), np.diff(bounds).tolist()


def chunk_digests(data: bytes, ends: list[int]) -> list[bytes]:
    start, out = 0, []
    for end in ends:
        out.append(hashlib.blake2b(data[start:end].strip(), digest_size=16).digest())
        start = end
    return out


def chunks(docs: DataFrame, radius: int = RADIUS, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(doc_id, version, place, digest) of every chunk; the version is a hash of the whole text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for key, version, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), text_bytes(b.column(1)), strict=True):
                ends, _ = cuts(raw, radius)
                rows[0] += [key] * len(ends)
                rows[1] += [version] * len(ends)
                rows[2] += range(len(ends))
                rows[3] += chunk_digests(raw, ends)
                if len(rows[0]) > 1 << 16:
                    yield batch(rows)
                    rows = [[], [], [], []]
            yield batch(rows)

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc_id", "version", "place", "digest"])

    return map_batches(docs.select(F.col(keep).cast("long").alias("doc_id"), text, F.xxhash64(text)), run, "doc_id long, version long, place int, digest binary")


def without_runs(data: bytes, repeated: set[int], min_words: int = MIN_WORDS, radius: int = RADIUS) -> tuple[bytes, int, int]:
    """The text without runs of repeated chunks, the number of chunks removed and their words."""
    ends, words = cuts(data, radius)
    gone: list[tuple[int, int]] = []
    removed = removed_words = 0
    i = 0
    while i < len(ends):
        if i not in repeated:
            i += 1
            continue
        j = i
        while j < len(ends) and j in repeated:
            j += 1
        count = sum(words[i:j])
        if count >= min_words:
            gone.append((ends[i - 1] if i else 0, ends[j - 1]))
            removed += j - i
            removed_words += count
        i = j
    if not gone:
        return data, 0, 0
    out, at = [], 0
    for start, end in gone:
        out.append(data[at:start])
        at = end
    out.append(data[at:])
    left = b"".join(out)
    return (left if left.split() else b""), removed, removed_words


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, radius: int = RADIUS, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """The rows with repeated runs taken out of their text, and columns n_chunks_removed, n_words_removed and repeats_of
    (ids of the documents that keep the first occurrences of what was removed, in order)."""
    # two passes over the chunks are cheaper than a table of all of them
    found = chunks(docs.where(F.col(keep).isNotNull()), radius, text, keep)
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "version", "place")).alias("first"), F.count("*").alias("c"))
    first = materialize(first.where("c > 1").select("digest", F.col("first.doc_id").alias("of"), F.col("first.version").alias("as"), F.col("first.place").alias("at")), "substring-first")
    again = found.join(first, "digest").where("doc_id <> of OR version <> as OR place <> at").select("doc_id", "version", "place", "of")
    lists = again.groupBy("doc_id", "version").agg(F.collect_set("place").alias("_places"), F.sort_array(F.collect_set("of")).alias("_of"))
    lists = materialize(lists.withColumnsRenamed({"doc_id": "_key", "version": "_version"}), "substring-lists")
    discard(first)
    columns = docs.columns
    names = [f"_c{i}" for i in range(len(columns))]
    kinds = dict(docs.dtypes)
    named = docs.toDF(*names)
    where = columns.index(text)
    own = (named[names[columns.index(keep)]].cast("long") == F.col("_key")) & (F.xxhash64(named[names[where]]) == F.col("_version"))
    joined = named.join(lists, own, "left")
    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, columns, strict=True)), "n_chunks_removed int, n_words_removed int, repeats_of array<bigint>"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, words, of = [], [], [], []
            for raw, places, owners in zip(b.column(where).to_pylist(), b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist(), strict=True):
                left, n, w = without_runs(raw.encode(), set(places), min_words, radius) if raw and places else (None, 0, 0)
                texts.append(left.decode() if n else raw)
                removed.append(n)
                words.append(w)
                of.append(owners if n else [])
            arrays = [b.column(i) for i in range(len(columns))]
            arrays[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, pa.int32()), pa.array(words, pa.int32()), pa.array(of, pa.list_(pa.int64()))], names=[*names, "n_chunks_removed", "n_words_removed", "repeats_of"])

    return map_batches(joined.select(*names, "_places", "_of"), run, schema).withColumnsRenamed(dict(zip(names, columns, strict=True)))
