"""Near-duplicates by fast similarity sketching, banding and exact verification.

Words are the stretches between ASCII white space, with A to Z in lower case; a document's set holds its distinct
shingles of ``width`` words, or its whole word sequence where it has fewer. Documents of equal sets are one class at
once. Each class representative gets a fast similarity sketch (Dahlgaard, Knudsen, Thorup, 2017): in each round every
element falls into a random bin with a value that grows with the round, and from round t on into bin (round - t), so that
every one of the t coordinates fills after at most 2t rounds. Bands of coordinates make buckets.

In each bucket the least id is compared with all other members. Where members of a bucket are then in different
components, a few members of its largest one are compared with all outside it, twice. What is still outside is compared
with every member of another component, in blocks of buckets that share members. So no pair of a bucket is left
uncompared unless it is in one component, and large groups of copies cost a few comparisons for each member. Pairs whose
sketches agree too little to be links are dropped; all others are confirmed on the full sets.

Null texts and texts without words have an empty set and link with nothing; a null id links with nothing and is kept.
Rows that repeat an id share its component, and its links are those of all its texts; equal texts are always in one
component. With ``agree=0`` no pair is dropped by its sketches, and all that share a band are compared on their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, map_batches, materialize, text_bytes
from gridloom.llm.components import components

#: Coordinates, and those in each band. A pair at similarity 0.8 misses all 32 bands with probability 5e-8.
COORDINATES, BAND = 128, 4
#: A pair at similarity 0.8 agrees in fewer coordinates than this share with a probability of about one in a million.
AGREE = 0.625
#: Members of a bucket's largest component that are compared with all members outside it, and how often others take
#: their place, before the members outside are compared with all others.
PIVOTS, PIVOT_ROUNDS = 4, 2
#: Documents of a family in one block of that comparison, and bytes of their sets.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Words whose hashes a worker remembers; a memory bound without influence on results.
CACHED_WORDS = 200_000

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a document's distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    size = min(width, len(words))
    n = len(words) - size + 1
    x = np.full(n, size, np.uint64)
    for i in range(size):
        x = mix(x + h[i : i + n] * _K1)
    return np.unique(x)


_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _K1)
_BITS = np.uint64(64 - COORDINATES.bit_length() + 1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit values; two sets agree in each with the probability of their similarity."""
    t = COORDINATES
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    start, chunk = 0, max(1, -(-8 * t // len(elements)))
    while start < 2 * t:
        rounds = np.arange(start, min(2 * t, start + chunk))
        x = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = (x >> _BITS).astype(np.int64)
        late = rounds >= t
        if late.any():
            bins[late] = (rounds[late] - t)[:, None]
        # the round in the upper bits: later rounds fill only bins that are still empty
        values = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (x & np.uint64((1 << 48) - 1))
        np.minimum.at(best, bins.ravel(), values.ravel())
        if best.max() != np.iinfo(np.uint64).max:
            break
        start += chunk
    return mix(best).astype(np.uint32)


def sketches(docs: DataFrame, width: int, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(doc_id, n, digest, sketch array<int>) of every row; digest and sketch are null for empty sets."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sizes, digests, out = [], [], []
            for raw in text_bytes(b.column(1)):
                s = shingle_set(raw, width, hashes)
                sizes.append(len(s))
                digests.append(_digest(s.tobytes()) if len(s) else None)
                out.append(sketch(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "n", "digest", "sketch"])

    return map_batches(docs.select(F.col(keep).alias("doc_id"), text), run, "doc_id long, n long, digest binary, sketch array<int>")


def _digest(elements: bytes) -> bytes:
    return hashlib.blake2b(elements, digest_size=16).digest()


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, da, db) of the rows (a, b, da, db, left, right) whose sketches agree in that share of coordinates."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(i).flatten().to_numpy().reshape(-1, COORDINATES) for i in (4, 5))
                good = pa.array((x == y).sum(1) >= least * COORDINATES)
                yield pa.RecordBatch.from_arrays([b.column(i).filter(good) for i in range(4)], names=["a", "b", "da", "db"])

    return map_batches(pairs.select("a", "b", "da", "db", "left", "right"), run, "a long, b long, da binary, db binary")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, elements) of documents: the set's digest and the set."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            out = [shingle_set(raw, width, hashes).tobytes() for raw in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, out), pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "digest", "elements"])

    return map_batches(docs, run, "doc_id long, digest binary, elements binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, b, left, right) whose sets have 100 * intersection >= percent * union."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for left, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                good.append(_linked(np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    return map_batches(pairs.select("a", "b", "left", "right"), run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", keep: str = "doc_id", agree: float = AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. Documents are linked at a similarity of at least
    ``percent``; the component is the least id that links reach."""
    rows = docs.select(F.col(keep).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = materialize(sketches(rows, width, "text"), "near-sketches")
    valid = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    copies = made.where(valid).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("digest", "rep")
    copies = materialize(copies, "near-copies")
    member = made.join(copies, "digest", "left").select("doc_id", "n", "digest", "sketch", F.when(valid, F.coalesce("rep", "doc_id")).alias("rep"))
    member = materialize(member, "near-members")
    discard(made)
    discard(copies)
    own = member.where(valid & (F.col("rep") == F.col("doc_id")))
    # a set each; an id of unlike texts has several
    reps = own.select("doc_id", "digest", "n", "sketch").dropDuplicates(["doc_id", "digest"])
    reps = materialize(reps, "near-representatives")
    several = member.where(valid).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    joined = materialize(member.where(valid).join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct(), "near-joined", narrow=True)

    placed = reps.select("doc_id", F.posexplode(_bands(F.col("sketch"))).alias("band", "key"))
    crowded = placed.groupBy("key", "band").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    crowded = materialize(crowded, "near-buckets")
    members = materialize(placed.join(crowded, ["key", "band"]), "near-bucketed")
    discard(crowded)

    pairs = members.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = _verify(pairs.distinct(), reps, rows, width, percent, agree).unionAll(joined)
    labels = materialize(components(links), "near-components", narrow=True)
    for turn in range(PIVOT_ROUNDS + 1):
        # buckets of three or more whose members are in different components; the largest component of each is its main one
        open_ = members.where("c > 2").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        open_ = materialize(open_.select("key", "band", "first", "doc_id", F.coalesce("component", "doc_id").alias("label")), "near-labelled", narrow=True)
        sizes = open_.groupBy("key", "band", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key", "band").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.count("*").alias("labels"))
        main = materialize(main.where("labels > 1").select("key", "band", "main"), "near-main", narrow=True)
        known = materialize(open_.join(main, ["key", "band"]), "near-open", narrow=True)
        if known.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            known = known.join(reps.select("doc_id", "n", "sketch"), "doc_id")
            outside = known.where("label <> main").select([F.col(c).alias(f"o_{c}") for c in known.columns])
            drawn = F.xxhash64("doc_id", F.lit(turn))
            pivots = known.where("label = main").groupBy("key", "band", F.pmod(drawn, F.lit(PIVOTS))).agg(F.min_by(F.struct(known.columns), drawn).alias("p")).select("p.*")
            same = (F.col("key") == F.col("o_key")) & (F.col("band") == F.col("o_band"))
            near = F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent
            agreeing = F.size(F.filter(F.zip_with("sketch", "o_sketch", lambda x, y: x == y), lambda e: e)) >= agree * COORDINATES
            pairs = pivots.join(outside, same & near & agreeing).select(F.least("doc_id", "o_doc_id").alias("a"), F.greatest("doc_id", "o_doc_id").alias("b"))
            found = _verify(pairs.distinct(), reps, rows, width, percent, agree)
        else:
            found = _outsiders(known, reps, rows, width, percent, agree)
        for x in (open_, main):
            discard(x)
        if found.isEmpty():
            continue
        discard(labels)
        links = links.unionAll(found)
        labels = materialize(components(links), "near-components", narrow=True)

    out = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out = materialize(out, "near-result")
    for x in (member, reps, members, labels, joined):
        discard(x)
    return out


def _bands(sketch_column: Column) -> Column:
    """A 64-bit key for each band of a sketch."""
    count = COORDINATES // BAND
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.xxhash64(j, F.slice(sketch_column, j * BAND + 1, BAND)))


def _outsiders(known: DataFrame, reps: DataFrame, rows: DataFrame, width: int, percent: int, agree: float) -> DataFrame:
    """The links, as a written table, among members of open buckets that are in different components.

    Buckets that share members are a family. In it every document outside the family's largest component is compared with
    all others, in blocks: a task holds about BLOCK members and BLOCK outsiders, or as many of several small families, or
    fewer where their sets are large. Only links leave it.
    """
    family = materialize(components(known.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))), "near-families", narrow=True)
    docs = known.select("doc_id", "label").distinct().join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    docs = docs.join(reps.groupBy("doc_id").agg(F.sum("n").alias("w")), "doc_id")
    docs = materialize(docs, "near-family-members", narrow=True)
    # a document weighs one, or as many as its set's bytes are of a block's share
    weight = F.greatest(F.lit(1), F.ceil(F.col("w") * 8 * BLOCK / BLOCK_BYTES))
    sizes = docs.groupBy("family", "label").agg(F.sum(weight).alias("c"))
    sizes = sizes.groupBy("family").agg(F.sum("c").alias("size"), F.max_by("label", F.struct("c", -F.col("label"))).alias("main"), F.max("c").alias("largest"))
    sizes = materialize(sizes.where("size > largest"), "near-family-sizes", narrow=True)
    small = sizes.where(F.col("size") <= BLOCK).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, -(-small // BLOCK))
    alone = F.col("size") > BLOCK
    placed = docs.join(sizes, "family").withColumns(
        {
            "unit": F.when(alone, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(bins))),
            "inner": F.when(alone, F.ceil(F.col("size") / BLOCK)).otherwise(F.lit(1)).cast("int"),
            "outer": F.when(alone, F.ceil((F.col("size") - F.col("largest")) / BLOCK)).otherwise(F.lit(1)).cast("int"),
        }
    )
    sets = materialize(_sets(rows.join(docs.select("doc_id"), "doc_id").select("doc_id", "text"), width).dropDuplicates(["doc_id", "digest"]), "near-sets")
    full = materialize(placed.join(reps, "doc_id").join(sets, ["doc_id", "digest"]), "near-family-sets")
    columns = ["family", "doc_id", "label", "main", "n", "sketch", "elements", "unit", "i", "j"]
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = full.withColumn("i", block("inner")).withColumn("j", every("outer")).select(columns)
    outside = full.where("label <> main").withColumn("j", block("outer")).withColumn("i", every("inner")).select(columns)

    def run(members: pa.Table, outsiders: pa.Table) -> pa.Table:
        a, b = [], []
        if members.num_rows and outsiders.num_rows:
            own = {c: members[c].to_numpy() for c in ("family", "doc_id", "label", "main", "n")}
            sketches_ = members["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            elements = [np.frombuffer(x, np.uint64) for x in members["elements"].to_pylist()]
            others = zip(*(outsiders[c].to_pylist() for c in ("family", "doc_id", "label", "n", "sketch", "elements")), strict=True)
            for fam, doc, label, n, sk, el in others:
                apart = (own["family"] == fam) & (own["label"] != label) & ((own["label"] == own["main"]) | (own["doc_id"] < doc))
                near = np.flatnonzero(apart & (np.minimum(own["n"], n) * 100 >= np.maximum(own["n"], n) * percent))
                near = near[(sketches_[near] == np.array(sk, np.int32)).sum(1) >= agree * COORDINATES]
                x = np.frombuffer(el, np.uint64)
                for k in near.tolist():
                    if _linked(x, elements[k], percent):
                        a.append(min(doc, int(own["doc_id"][k])))
                        b.append(max(doc, int(own["doc_id"][k])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ("unit", "i", "j")
    found = materialize(inside.groupBy(*keys).cogroup(outside.groupBy(*keys)).applyInArrow(run, "a long, b long"), "near-links")
    for x in (family, docs, sizes, sets, full):
        discard(x)
    return found


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, reps: DataFrame, rows: DataFrame, width: int, percent: int, agree: float) -> DataFrame:
    """The links among pairs (a, b), as a written table."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("digest").alias("da"), F.col("n").alias("na"), F.col("sketch").alias("left"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("digest").alias("db"), F.col("n").alias("nb"), F.col("sketch").alias("right"))
    pairs = materialize(pairs, "near-pairs", narrow=True)
    sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = materialize(_agreeing(sized, agree), "near-agreeing")
    needed = near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id"))).distinct()
    needed = materialize(needed, "near-needed", narrow=True)
    sets = _sets(rows.join(needed, "doc_id").select("doc_id", "text"), width).dropDuplicates(["doc_id", "digest"])
    sets = materialize(sets, "near-sets")
    held = near.join(sets.select(F.col("doc_id").alias("a"), F.col("digest").alias("da"), F.col("elements").alias("left")), ["a", "da"])
    held = held.join(sets.select(F.col("doc_id").alias("b"), F.col("digest").alias("db"), F.col("elements").alias("right")), ["b", "db"])
    found = materialize(_confirmed(held, percent), "near-links")
    for x in (pairs, near, needed, sets):
        discard(x)
    return found
