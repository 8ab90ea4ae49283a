"""Near-duplicates, components, substrings and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import ann, minhash, substring
from gridloom.llm.common import shared_root
from gridloom.llm.components import components


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def brute(rows, width):
    """Component by id: rows of one id are one node."""
    own = [(i, sets(t, width)) for i, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (own[k][0] is None, own[k][0] or 0))
    links = []
    for p, x in enumerate(order):
        for y in order[p + 1 :]:
            a, b = own[x][1], own[y][1]
            if own[x][0] is not None and own[y][0] is not None and (own[x][0] == own[y][0] or a and b and 100 * len(a & b) >= 80 * len(a | b)):
                links.append((p, order.index(y)))
    root = roots(len(rows), links)
    return {(own[k][0], len(own[k][1])): own[order[root[p]]][0] for p, k in enumerate(order)}


def grown(seed, copies, edits):
    """Near copies of one text, each with some words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark, rows):
    rng = random.Random(9)
    more = grown(1, 60, 9) + grown(2, 25, 3) + [" ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    # unlike texts of one id: a copy of another document, and a near copy of a third
    every = rows + [(18, more[0]), (18, more[62]), (19, more[62])] + list(enumerate(more, 100))
    df = spark.createDataFrame(every, "doc_id long, text string").withColumn("rep", F.lit("clash"))
    got = minhash.near_duplicates(df, width=2).collect()
    want = brute(every, 2)
    assert len(got) == len(every)
    plain = minhash.near_duplicates(df, width=2, agree=0.0)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, got))
    for r in got:
        assert r["component_id"] == want[(r["doc_id"], r["n_shingles"])], r
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    # chains of links join what is itself no link
    assert len({r["component_id"] for r in got if r["doc_id"] and r["doc_id"] >= 100}) < len(more) - 50


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(tuple(r) for r in out) == [(i, 0, i, True) for i, _ in rows]


def test_sketches():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 100, 5000):
        assert len(minhash.sketch(rng.integers(0, 1 << 63, n).astype(np.uint64))) == minhash.COORDINATES
    agree = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        agree.append((minhash.sketch(x[:800]) == minhash.sketch(x[100:])).mean())
    assert abs(np.mean(agree) - 7 / 9) < 0.02


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = roots(600, links)
    assert got == {i: root[i] for a, b in links for i in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- substrings ----------------------------------------------------------------------------------------------------


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    h, want = 0, []
    for b in data:
        h = ((h << 4) + int(substring.GEAR[b])) % (1 << 64)
        want.append(h)
    assert substring.gear_hash(np.frombuffer(data, np.uint8)).tolist() == want


def sentence(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n))


def test_cuts_resist_insertions():
    rng = random.Random(2)
    text = sentence(rng, 800).encode()
    changed = text[:900] + b" some new words here " + text[900:]
    a, b = (set(substring.chunk_digests(t, substring.cuts(t)[0])) for t in (text, changed))
    assert len(a & b) >= len(a) - 4
    for t in (b"", b"  ", b"one", b"same " * 1000, b"x" * 10_000, "日本 語".encode() * 50):
        ends, words = substring.cuts(t)
        assert sum(words) == len(t.split()) and sorted(set(ends)) == ends and all(w <= max(substring.LONGEST, w) for w in words)


def brute_dedup(rows):
    """First occurrences stay, by id, hash of the text and place; runs of repeated chunks go."""
    first = {}
    version = {t: xxhash.xxh64(t.encode(), seed=42).intdigest() for _, t in rows if t}
    signed = {t: v - (1 << 64) if v >= 1 << 63 else v for t, v in version.items()}
    for i, t in sorted(((i, t) for i, t in set(rows) if i is not None and t), key=lambda x: (x[0], signed[x[1]])):
        data = t.encode()
        for place, digest in enumerate(substring.chunk_digests(data, substring.cuts(data)[0])):
            first.setdefault(digest, (i, t, place))
    out = []
    for i, t in rows:
        if i is None or not t:
            out.append((i, t))
            continue
        data = t.encode()
        again = {p for p, d in enumerate(substring.chunk_digests(data, substring.cuts(data)[0])) if first[d] != (i, t, p)}
        out.append((i, substring.without_runs(data, again)[0].decode()))
    return out


def test_substring_dedup(spark, rows):
    rng = random.Random(3)
    passage = sentence(rng, 60)
    every = rows + [(18, sentence(rng, 150)), (18, sentence(rng, 30) + " " + passage), (18, passage + " and more")] + [(100 + k, f"{sentence(rng, 30)}\n{passage} {sentence(rng, 40)}") for k in range(12)] + [(200 + k, sentence(rng, 90)) for k in range(10)]
    df = spark.createDataFrame([(i, t, "k", [1]) for i, t in every], "doc_id long, text string, _key string, _places array<int>")
    out = substring.substring_dedup(df)
    got = out.collect()
    assert out.columns == [*df.columns, "n_chunks_removed", "n_words_removed", "repeats_of"]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, brute_dedup(every)))
    by = {r["doc_id"]: r for r in got}
    assert sum(passage in (r["text"] or "") for r in got) == 1 and all(passage not in by[100 + k]["text"] for k in range(12))
    assert all(18 in by[100 + k]["repeats_of"] and by[100 + k]["n_words_removed"] > 30 for k in range(1, 12))
    # an unlike text of the same id loses nothing
    assert [t for i, t in every if i == 18][2] in {r["text"] for r in got if r["doc_id"] == 18}
    assert all(by[200 + k]["text"] == dict(every)[200 + k] and by[200 + k]["repeats_of"] == [] for k in range(10))
    assert substring.substring_dedup(df.limit(0)).count() == 0


def test_query_over_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring.substring_dedup(docs).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(brute_dedup(rows))


# ---- neighbours ----------------------------------------------------------------------------------------------------


def exact(ids, vectors, queries, k):
    out = {}
    for i, v in queries:
        scores = sorted(((-float(np.dot(np.array(w), np.array(v))), j) for j, w in zip(ids, vectors, strict=True) if j != i and len(w) == len(v)), key=lambda x: x)
        out[i] = scores[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 16)).tolist()
    vectors[7] = vectors[3]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (None, vectors[0]), (20, vectors[20])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, block int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    want = exact(range(300), vectors, [(i, vectors[i]) for i in range(0, 300, 20)], 20)
    assert {r["query_id"] for r in got} == set(want) and len(got) == 20 * len(want)
    hits = 0
    for q, best in want.items():
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - float(np.dot(vectors[q], vectors[r["vec_id"]]))) < 1e-9 for r in own)
        hits += len({r["vec_id"] for r in own} & {j for _, j in best})
    assert hits >= 0.9 * 20 * len(want)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0, 20)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [j for _, j in exact(range(5), vectors[:5], [(0, vectors[0])], 20)[0]]


def test_equal_vectors_and_ties(spark):
    """A third of the rows hold one vector: ties go to smaller ids, and no row meets itself."""
    rng = np.random.default_rng(8)
    own = rng.standard_normal((60, 8))
    rows = [(i, (own[0] if i % 3 == 0 else own[i % 60]).tolist()) for i in range(600)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = exact([i for i, _ in rows], [v for _, v in rows], [r for r in rows if r[0] % 20 == 0], 20)
    for q in (0, 60, 120):
        assert [v for _, v in sorted(got[q])] == [j for _, j in want[q]]
    hits = sum(len({v for _, v in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("name", ["sf0.1", "check_s"])
def test_forest_recall(spark, name):
    """Recall on the given vectors."""
    df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = df.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    hits = 0
    for q, found in got.items():
        s = vectors @ vectors[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.92 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def measured(vectors, asked, count=None):
    """Recall at 20 and the share of the vectors that were candidates, over blocks as build() deals them."""
    rng = np.random.default_rng(3)
    length = np.linalg.norm(vectors, axis=1)
    ranges = np.minimum(ann.RANGES - 1, np.floor(np.log(length.max() / length) / np.log(ann.RATIO)))
    blocks = []
    for r in np.unique(ranges):
        own = rng.permutation(np.flatnonzero(ranges == r))
        for part in np.array_split(own, -(-len(own) // ann.BLOCK)):
            blocks.append((ann.Block(vectors[part], part, np.arange(len(part) + 1), ann.Forest(vectors[part])), len(own)))
    got, met = {}, 0
    for q, v, _ in ann.search(iter(blocks), asked, vectors[asked], 20):
        got.setdefault(q, set()).add(v)
    for block, n in blocks:
        low, high = block.forest.nodes(vectors[asked])
        met += sum(len(block.forest.candidates(low[:, :, i], high[:, :, i], ann.reach(n) * block.forest.n / n, 21)) for i in range(len(asked)))
    hits = 0
    for q in asked.tolist():
        s = vectors @ vectors[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    return hits / (20 * len(asked)), met / len(asked) / len(vectors)


@pytest.mark.parametrize(("lengths", "n", "share"), [("unit", 10_000, 0.42), ("unit", 50_000, 0.22), ("gaussian", 30_000, 0.35), ("lognormal", 30_000, 0.6)])
def test_forest_recall_and_candidates(lengths, n, share):
    """Vectors without any structure in 64 dimensions, the hardest case. The share falls as the table grows."""
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((n, 64))
    if lengths != "gaussian":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if lengths == "lognormal":
        vectors *= np.exp(0.5 * rng.standard_normal((n, 1)))
    recall, met = measured(vectors, np.arange(0, n, n // 80)[:80])
    assert recall >= 0.9 and met <= share, (recall, met)


def test_clustered_vectors_are_found():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((400, 64))
    vectors = centres[rng.integers(0, 400, 20_000)] + 0.25 * rng.standard_normal((20_000, 64))
    recall, _ = measured(vectors, np.arange(0, 20_000, 250))
    assert recall >= 0.99


def test_descent_and_ascent():
    """Each tree's nodes shrink to its own longest match; the ascent takes the deepest level that holds enough."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((500, 8))
    forest = ann.Forest(vectors, trees=5)
    low, high = forest.nodes(vectors[:9])
    counts = high - low
    assert (np.diff(counts, axis=0) <= 0).all() and (counts[0] == 500).all()
    keys = forest.strings(np.column_stack([vectors[:9] / np.abs(vectors[:9]).max(1, keepdims=True), np.zeros(9)]))
    for t in range(5):
        for i in range(9):
            for level, bits in enumerate(forest.levels):
                shift = np.uint64(forest.bits - bits)
                same = (forest.keys[t] >> shift) == (keys[t, i] >> shift) if bits else np.ones(500, bool)
                assert counts[level, t, i] == same.sum()
    for least in (1, 30, 200, 2500):
        stop = forest.ascended(low[:, :, 0], high[:, :, 0], least)
        held = counts[stop, np.arange(5), 0].sum()
        assert held >= min(least, counts[stop, np.arange(5), 0].sum()) and stop.max() - stop.min() <= 1
        deeper = np.minimum(stop + 1, len(counts) - 1)
        assert least > 1 and counts[deeper.max(), np.arange(5), 0].sum() <= held or held >= 1
    assert len(forest.candidates(low[:, :, 0], high[:, :, 0], 10**9, 21)) == 500
    again = ann.Block.from_bytes(ann.Block(vectors, np.arange(500), np.arange(501), ann.Forest(vectors)).to_bytes())
    assert again.forest.n == 500 and (again.forest.keys == ann.Forest(vectors).keys).all()


def test_shared_folder_is_the_sessions(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
