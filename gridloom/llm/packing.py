"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

Documents are taken in blocks of bounded token counts. In each block, a document's whole windows of ``capacity`` ids are
sequences of their own; the rests are partitioned into near-equal windows: each rest starts as a partial partition with
one filled window, and the two partial partitions with the largest spread are merged again and again, the fullest
windows of one with the emptiest of the other, until one is left. The window count starts at the total over the capacity
and rises whenever a window exceeds the capacity. These windows are the sequences, so no document of up to ``capacity``
ids is ever cut, and padding is what the window count leaves over: at most about one window in a block, unless the count
has to rise.

Null texts count as empty: their one id is the end id. Repeated rows are packed as often as they occur. Sequence ids are
unique over the table: the task's partition number in the upper bits, a counter in the lower 40.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm.common import give_back, map_batches, remembers, text_bytes

CAPACITY = 4096
#: Rests that are packed together, at most; bounds the memory of a task and the work of the differencing.
BLOCK_RESTS = 1024
#: Bytes of ids after which a block ends early; a memory bound.
BLOCK_BYTES = 32 << 20
#: Words whose ids a worker remembers, and the longest of them; a memory bound without influence on results.
CACHED_WORDS, CACHED_BYTES = 800_000, 48
#: New words are encoded this many at a time, with a mark between them that no other word's ids hold: a word with the
#: mark in it is encoded alone.
JOINED, MARK = 100, b"~"


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit integers. The tokenizer drops white space and no merge crosses it,
    so stretches between ASCII white space are encoded one by one and remembered."""

    _known: dict[str, WordIds] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # ASCII letters are their own normal form and byte symbols, and a word of them is one match of the pattern
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.ids: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._known:
            cls._known[path] = cls(path)
            give_back()  # reading the file takes as much again as the tokenizers
        return cls._known[path]

    def _split(self, ids: list[int]) -> list[bytes]:
        """The ids between those of the mark."""
        got = np.array(ids, "<u4")
        ends = (np.flatnonzero(got == self.mark) * 4).tolist()
        raw = got.tobytes()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True)]

    def _learn(self, words: set[bytes], into: dict[bytes, bytes]) -> None:
        """Encodes words that are not known yet."""
        letters, other, marked = [], [], []
        for w in words:
            (letters if w.isalpha() else marked if MARK in w else other).append(w)
        for tokenizer, plain in ((self.letters, letters), (self.tokenizer, other)):
            for at in range(0, len(plain), JOINED * 64):
                parts = [plain[i : i + JOINED] for i in range(at, min(at + JOINED * 64, len(plain)), JOINED)]
                found = tokenizer.encode_batch_fast([b" ~ ".join(p).decode() for p in parts], add_special_tokens=False)
                for part, e in zip(parts, found, strict=True):
                    into.update(zip(part, self._split(e.ids), strict=True))
        for w in marked:
            into[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, batch: list[bytes]) -> list[bytes]:
        if len(self.ids) > CACHED_WORDS:
            self.ids.clear()
        split = [x.lower().split() for x in batch]  # the tokenizer lowers letters anyhow
        found = [list(map(self.ids.get, words)) for words in split]
        gaps: list[tuple[int, int]] = []
        new: set[bytes] = set()
        for i, ids in enumerate(found):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                gaps.append((i, at))
                new.add(split[i][at])
        if new:
            # a letter and a comma or full stop after it are never one match, so such words come from their stems
            ended = [w for w in new if w[-1] in b",." and w[-2:-1].isalpha()]
            stems = {w[:-1] for w in ended}
            need = new.difference(ended) | stems.difference(self.ids) | {b",", b"."}
            fresh: dict[bytes, bytes] = {}
            self._learn(need, fresh)
            for w in ended:
                stem = w[:-1]
                fresh[w] = (fresh[stem] if stem in fresh else self.ids[stem]) + fresh[w[-1:]]
            for i, at in gaps:
                found[i][at] = fresh[split[i][at]]
            self.ids.update(x for x in fresh.items() if len(x[0]) <= CACHED_BYTES)
        return [b"".join(ids) for ids in found]


remembers(__name__, WordIds._known.clear)


def differencing(sizes: list[int], count: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: positions of ``sizes`` in each of ``count`` windows, fullest first.

    A partial partition is kept sparse: its windows above its emptiest one, as (sum over the emptiest, members), fullest
    first, and the number of those at its level. Merging pairs the fullest of one with the emptiest of the other.
    """
    if count <= 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(count - 1))]
    # entries: (-spread, tie, windows): windows lists (-excess, members) of the non-level windows, fullest first
    heap = [(-size, i, [(-size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    fullest = itemgetter(0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        meet = len(a) + len(b) - count  # non-level windows that have to share
        if meet < 0:
            merged = a + b
            merged.sort(key=fullest)
        else:
            # the least of a takes the fullest of b's that it must share with, in opposite order
            merged = a[: len(a) - meet] + b[: len(b) - meet]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - meet :], reversed(b[len(b) - meet :]), strict=True)]
            merged.sort(key=fullest)
            # windows at the level carry members but no excess: all but empty ones stay listed
            if level := merged[-1][0]:
                merged = [(s - level, m) for s, m in merged]
        heapq.heapreplace(heap, (merged[0][0], tie, merged))
        tie += 1
    windows = [list(m) for _, m in heap[0][2]]
    return windows + [[] for _ in range(count - len(windows))]


def windows_within(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows, as few from the total over the capacity upwards as keep every window within it."""
    count = max(1, -(-sum(sizes) // capacity))
    while sizes:
        windows = differencing(sizes, count)
        worst = max(sum(sizes[i] for i in w) for w in windows)
        if worst <= capacity:
            return [w for w in windows if w]
        count += max(1, (worst - capacity) * count // capacity // 4)
    return []


#: (document's position, start in it, length)
Piece = tuple[int, int, int]


def pack_block(lengths: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of pieces for documents of these token counts: whole windows of long documents, and near-equal windows of
    the rests."""
    sequences: list[list[Piece]] = []
    rests: list[Piece] = []
    for i, n in enumerate(lengths):
        whole = n // capacity * capacity
        sequences += [[(i, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rests.append((i, whole, n - whole))
    return sequences + [[rests[i] for i in w] for w in windows_within([r[2] for r in rests], capacity)]


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, text: str = "text", keep: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(keep, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece; ``ids`` are the piece's
    ids as little-endian unsigned 32-bit integers."""
    end = end_id.to_bytes(4, "little")

    def run(batches) -> Iterator[pa.RecordBatch]:
        coder = WordIds.of(tokenizer_path)
        task = TaskContext.get()
        counter = (task.partitionId() if task else 0) << 40
        docs: list[tuple[object, bytes]] = []
        key_kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal counter
            rows: list[list] = [[] for _ in range(8)]
            for sequence in pack_block([len(ids) // 4 for _, ids in docs], capacity):
                offset = 0
                for i, start, n in sequence:
                    key, ids = docs[i]
                    piece = ids[4 * start : 4 * (start + n)]
                    for column, value in zip(rows, (key, start, n, zlib.crc32(piece), len(ids) // 4, counter, offset, piece), strict=True):
                        column.append(value)
                    offset += n
                counter += 1
            docs.clear()
            arrays = [pa.array(rows[0], key_kind), *(pa.array(r, pa.int64()) for r in rows[1:7])]
            if with_ids:
                arrays.append(pa.array(rows[7], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[keep, *(c.split()[0] for c in COLUMNS.split(", ")), *["ids"] * with_ids])

        held = 0
        for b in batches:
            key_kind = b.column(0).type
            for key, ids in zip(b.column(0).to_pylist(), coder.encode(text_bytes(b.column(1))), strict=True):
                docs.append((key, ids + end))
                held += len(ids)
                if len(docs) >= BLOCK_RESTS or held >= BLOCK_BYTES:
                    yield from flush()
                    held = 0
        if docs:
            yield from flush()

    kind = dict(df.dtypes)[keep]
    return map_batches(df.select(keep, text), run, f"`{keep}` {kind}, {COLUMNS}" + ", ids binary" * with_ids)
