"""Byte-level BPE and packing against the libraries run plainly."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def test_encode_decode(spark, docs, rows, none, plain):
    got = sorted(((r[0] is None, r[0], r[1]) for r in bpe.encode(docs, RANKS).collect()), key=repr)
    want = sorted(((i is None, i, plain.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert got == want
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert sorted((repr(r[0]), bytes(r[1])) for r in back.collect()) == sorted((repr(i), (t or "").encode()) for i, t in rows)
    assert bpe.encode(none, RANKS).count() == bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    # ids that are no whole characters come back as their bytes
    half = plain.encode_ordinary("😀")[:1]
    cut = spark.createDataFrame([(1, half), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r[0]: bytes(r[1]) for r in bpe.decode(cut, RANKS).collect()} == {1: plain.decode_bytes(half), 2: b"", 3: b""}


def test_digests(docs, rows, plain):
    out = bpe.round_trip(docs, RANKS, bpe.digests, "ids_sha256 string, decoded_sha256 string")
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ9 \n\t.'sé日 \x1c"), max_size=200), st.integers(1, 20))
def test_safe_parts_do_not_change_ids(text, size):
    with open(RANKS, "rb") as lines:
        codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
        del lines
    parts = list(bpe.safe_parts(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in codec.encoding.encode_ordinary(p)] == codec.encoding.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_word_ids_are_those_of_whole_texts(texts):
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    got = packing.WordIds.of(WORDS).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(pieces, rows, tokenizer):
    """Every id lies in one piece; sequences are gapless and within the capacity; only longer documents are cut."""
    want = defaultdict(int)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[(repr(i), tuple(ids))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[(repr(p["doc_id"]), p["doc_tokens"])].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for (key, n), own in by_doc.items():
        copies = {ids: c for (k, ids), c in want.items() if k == key and len(ids) == n}
        assert sum(p["length"] for p in own) == n * sum(copies.values())
        for p in own:
            assert any(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes() == bytes(p["ids"]) for ids in copies)
        starts = sorted((p["start"], p["length"]) for p in own)
        if sum(copies.values()) == 1:
            assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert sum(p["length"] for p in pieces) == sum(len(ids) * c for (_, ids), c in want.items())
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 4096
    for (_, n), own in by_doc.items():
        assert all(p["length"] == n for p in own) if n <= 4096 else all(p["start"] % 4096 == 0 for p in own)


def test_windows_are_the_differencing_ones():
    """Sequences of the rests are the near-equal windows themselves, and their padding is small."""
    rng = random.Random(8)
    lengths = [rng.randint(1, 1500) for _ in range(1000)] + [5000, 4096, 8192, 20_000]
    got = packing.pack_block(lengths)
    rests = [n % 4096 for n in lengths if n % 4096]
    want = sorted(sorted(rests[i] for i in w) for w in packing.windows_within(rests, 4096))
    assert sorted(sorted(n for *_, n in s) for s in got if s[0][2] < 4096) == want
    sums = [sum(n for *_, n in s) for s in got]
    assert max(sums) <= 4096 and sum(sums) == sum(lengths) and sum(sums) >= 0.97 * 4096 * len(sums)
    near = [s for s in sums if s < 4096]
    assert max(near) - min(near) < 0.08 * 4096
    assert packing.pack_block([]) == [] and packing.pack_block([4096]) == [[(0, 0, 4096)]]


def test_pack(docs, rows, none, tokenizer):
    pieces = packing.pack(docs, WORDS, with_ids=True).collect()
    check_packed(pieces, rows, tokenizer)
    assert packing.pack(none, WORDS).count() == 0


def test_query_packs_all(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packed(packing.pack(docs, WORDS, with_ids=True).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)


def test_differencing():
    rng = random.Random(5)
    for n, count in ((1, 1), (3, 5), (40, 4), (200, 37), (500, 90)):
        sizes = [rng.randint(1, 4000) for _ in range(n)]
        windows = packing.differencing(sizes, count)
        assert len(windows) == count and sorted(i for w in windows for i in w) == list(range(n))
        if n >= 5 * count:
            sums = [sum(sizes[i] for i in w) for w in windows]
            assert max(sums) - min(sums) < 0.2 * sum(sums) / count
    # differencing on a known case: 8 7 6 5 4 into two windows of 16 and 14
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.windows_within([10, 10, 10], 10) == [[0], [1], [2]] or len(packing.windows_within([10, 10, 10], 10)) == 3
