"""Approximate nearest neighbours by a forest of hash prefixes (LSH Forest; Bawa, Condie, Ganesan, 2005).

Each tree gives every vector a long string of digits and keeps the strings as a sorted array: vectors with a common prefix
lie side by side, so a node of the tree is a range. A digit is the direction, of several random ones and their opposites,
that is nearest to the vector (cross-polytope hashing; Andoni et al., 2015), which tells near from far better than signs do. A
query descends every tree to its own longest match. Then it ascends all trees together, one digit a step and at the last
step tree by tree, until the nodes hold ``REACH`` times the root of the table's size, so that the share of the table which
a query meets falls as the table grows. These candidates are ranked by the inner product.

Vectors go into ranges of length, each at most ``RATIO`` long from end to end, and a range into blocks of about ``BLOCK``.
Within a block the mean is taken off (which changes no order of inner products) and one more coordinate makes all equally
long: then the largest inner product is the smallest angle. A block's arrays are built once and written to the shared
folder; a task reads a run of blocks and takes one group of queries past them, so it holds one block and one group
whatever the size of the tables, and no vector moves for a query. Answers of the runs are merged.

Equal vectors are one entry, with its k + 1 least ids: others can't be among the k nearest of any row. Vectors that are
null, empty, zero, or hold null or non-finite components take no part, nor do rows without id. Rows that repeat an id
count once, with the smallest vector. A query meets only vectors of its own dimension. Lengths of up to 1e150 are safe.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, make_folder, map_batches, materialize, new_folder, session_of, short_batches
from gridloom.llm.files import new_file, open_file

#: Vectors in a block and queries in a group, about; blocks in a task's run.
BLOCK, GROUP, RUN = 1 << 14, 1 << 10, 16
TREES = 128
#: Random directions of each digit of a string: with their opposites 64, 32, 32, ... values.
DIRECTIONS = (32, 16, 16, 16, 16)
#: A query ascends until its nodes hold so many entries for each root of the number of vectors.
REACH = 54.0
#: Longest over shortest vector of a range, and ranges; the last one takes all that is shorter.
RATIO, RANGES = 1.25, 24


def _bits(k: int) -> int:
    return (2 * k - 1).bit_length()


class Forest:
    """Sorted arrays of hash strings over one block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, directions: tuple[int, ...] = DIRECTIONS, seed: int = 5):
        self.n, self.trees, self.directions, self.seed = len(vectors), trees, directions, seed
        level = [0, *np.cumsum([_bits(k) for k in directions]).tolist()]
        self.levels, self.bits = level, level[-1]
        middle = vectors - vectors.mean(0)
        norms = np.sqrt(np.einsum("ij,ij->i", middle, middle))
        longest = norms.max() or 1.0
        rows = np.column_stack([middle / longest, np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))])
        keys = self.strings(rows)
        order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, order, axis=1)
        self.order = order.astype(np.uint16 if self.n <= 1 << 16 else np.uint32)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows) strings of digits as numbers, first digit highest."""
        kind = np.uint32 if self.bits <= 32 else np.uint64
        out = np.zeros((self.trees, len(rows)), kind)
        rows = rows.astype(np.float32)
        d = rows.shape[1]
        rng = np.random.default_rng(self.seed)
        step = 1 << 10
        for k in self.directions:
            # a rotation's columns are dealt out to digits; few dimensions give independent directions
            count = self.trees * k
            if d >= k:
                own = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, : d // k * k] for _ in range(-(-count // (d // k * k)))]
            else:
                own = [rng.standard_normal((d, count))]
            own = np.concatenate(own, axis=1)[:, :count].astype(np.float32)
            for at in range(0, len(rows), step):
                p = (rows[at : at + step] @ own).reshape(-1, self.trees, k)
                high, low = p.argmax(2), p.argmin(2)
                up = np.take_along_axis(p, high[:, :, None], 2) >= -np.take_along_axis(p, low[:, :, None], 2)
                digit = np.where(up[:, :, 0], 2 * high, 2 * low + 1).astype(kind)
                out[:, at : at + step] = (out[:, at : at + step] << kind(_bits(k))) | digit.T
        return out

    def nodes(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, trees, queries) first and last positions of the node of every level from the root down."""
        keys = self.strings(np.column_stack([queries / np.maximum(np.abs(queries).max(1, keepdims=True), 1e-300), np.zeros(len(queries))]))
        low = np.zeros((len(self.levels), *keys.shape), np.int32)
        high = np.full(low.shape, self.n, np.int32)
        for i, bits in enumerate(self.levels[1:], 1):
            shift = keys.dtype.type(self.bits - bits)
            a = (keys >> shift) << shift
            b = a | keys.dtype.type((1 << int(shift)) - 1)
            for t in range(self.trees):
                low[i, t] = np.searchsorted(self.keys[t], a[t])
                high[i, t] = np.searchsorted(self.keys[t], b[t], "right")
        return low, high

    def ascended(self, low: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
        """(trees,) the level of each tree at which one query stops: it ascends all trees together until their nodes hold
        ``least`` entries, at the last level tree by tree."""
        counts = high - low
        deep = int(np.flatnonzero(counts.sum(1) >= least)[-1]) if counts[0].sum() >= least else 0
        stop = np.full(self.trees, deep)
        if deep + 1 < len(counts):
            more = counts[deep] - counts[deep + 1]
            below = np.cumsum(more) - more + counts[deep + 1].sum()
            stop[below >= least] = deep + 1
        return stop

    def within(self, low: np.ndarray, high: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Positions of the vectors in the nodes at which the trees of one query stop."""
        trees = np.arange(self.trees)
        a, b = low[stop, trees].astype(np.int64), high[stop, trees].astype(np.int64)
        size = b - a
        begin = np.cumsum(size) - size
        flat = np.arange(int(size.sum())) + np.repeat(a + trees * self.n - begin, size)
        seen = np.zeros(self.n, bool)
        seen[self.order.ravel()[flat]] = True
        return np.flatnonzero(seen)

    def candidates(self, low: np.ndarray, high: np.ndarray, least: float, enough: int) -> np.ndarray:
        """One query's candidates: of at least ``least`` entries, and ``enough`` different ones where there are so many."""
        stop = self.ascended(low, high, least)
        found = self.within(low, high, stop)
        while len(found) < min(enough, self.n):
            stop = np.maximum(0, stop - 1)
            found = self.within(low, high, stop)
        return found


class Block:
    """Vectors with the ids of the rows that hold them, and their forest."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, begins: np.ndarray, forest: Forest):
        self.vectors, self.ids, self.begins, self.forest = vectors, ids, begins, forest
        self.single = vectors.astype(np.float32) if np.abs(vectors).max() < 1e15 else None
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, ids=self.ids, begins=self.begins, order=self.forest.order, keys=self.forest.keys)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Block:
        with np.load(io.BytesIO(raw)) as got:
            forest = Forest.__new__(Forest)
            forest.order, forest.keys = got["order"], got["keys"]
            forest.trees, forest.n = forest.keys.shape
            forest.directions, forest.seed = DIRECTIONS, 5
            forest.levels = [0, *np.cumsum([_bits(k) for k in DIRECTIONS]).tolist()]
            forest.bits = forest.levels[-1]
            return cls(got["vectors"], got["ids"], got["begins"], forest)

    def best(self, at: np.ndarray, own: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(-inner product, id) of the k best rows of the vectors at these positions, without ``own``."""
        if self.single is not None and len(at) > k + 1 and np.abs(q).max() < 1e15:
            # single precision sorts out what lies below the (k + 1)-th best by more than its error
            rough = self.single[at] @ q.astype(np.float32)
            bound = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1] - 1e-5 * self.longest * float(np.linalg.norm(q))
            at = at[rough >= bound]
        # one product for each vector, summed in one order wherever the vector lies
        exact = np.einsum("ij,j->i", self.vectors[at], q)
        rows = [(-s, i) for s, p in zip(exact.tolist(), at.tolist(), strict=True) for i in self.ids[self.begins[p] : self.begins[p + 1]].tolist() if i != own]
        return sorted(rows)[:k]


def reach(count: int) -> float:
    """Entries that a query's nodes shall hold over all blocks of a range of so many vectors."""
    return REACH * math.sqrt(count)


def search(blocks: Iterator[tuple[Block, int]], query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, inner product) of the best k rows found for every query. blocks: each with the vectors in its range."""
    best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    for block, count in blocks:
        least = reach(count) * block.forest.n / count
        for start in range(0, len(queries), 256):
            low, high = block.forest.nodes(queries[start : start + 256])
            for i in range(low.shape[2]):
                q, own = queries[start + i], int(query_ids[start + i])
                at = block.forest.candidates(low[:, :, i], high[:, :, i], least, k + 1)
                best[start + i] = sorted(best[start + i] + block.best(at, own, q, k))[:k]
    return [(int(own), i, -s) for own, rows in zip(query_ids.tolist(), best, strict=True) for s, i in rows]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def build(rows: DataFrame, folder: str, k: int) -> DataFrame:
    """Builds the forest of every block of the rows (vec_id, v) and writes it to the folder; (dim, block, range_size,
    file) of every block, as a written table."""
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    few = rows.select("vec_id", "v", *digest).withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries.select("v", "ids", "h1", F.size("v").alias("dim"), length.alias("length")), "ann-entries")
    longest = entries.agg(F.max("length")).first()[0] or 1.0
    shorter = F.floor(F.log(F.lit(longest) / F.col("length")) / math.log(RATIO))
    entries_ = entries.withColumn("range", F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), shorter)).cast("int"))
    sizes = entries_.groupBy("dim", "range").agg(F.count("*").alias("range_size"))
    total = int(sizes.agg(F.sum(F.ceil(F.col("range_size") / BLOCK))).first()[0] or 1)
    dealt = entries_.join(sizes, ["dim", "range"])
    dealt = dealt.withColumn("block", F.pmod("h1", F.ceil(F.col("range_size") / BLOCK)).cast("int")).select("dim", "range", "range_size", "block", "ids", "v")

    def run(part: pa.Table) -> pa.Table:
        vectors = _matrix(part["v"], part.num_rows)
        ids = part["ids"].combine_chunks()
        counts = ids.value_lengths().to_numpy(zero_copy_only=False)
        block = Block(vectors, ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)]), Forest(vectors))
        name, out = new_file(folder, ".npz")
        with out:
            out.write(block.to_bytes())
        return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "range_size": part["range_size"].slice(0, 1), "file": [name]})

    make_folder(session_of(rows), folder)
    short_batches(session_of(rows))
    dealt = dealt.repartition(total, "dim", "range", "block")
    made = materialize(dealt.groupBy("dim", "range", "block").applyInArrow(run, "dim int, range_size long, file string"), "ann-blocks")
    discard(entries)
    return made


def nearest(df: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", keep: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors found for every row with ``is_query``."""
    spark = session_of(df)
    rows = df.where(usable(F.col(vector)) & F.col(keep).isNotNull())
    whole = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    rows = rows.select(F.col(keep).cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("q"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("v", "q")).alias("x")).select("vec_id", "x.v", "x.q")
    rows = materialize(rows, "ann-vectors")
    folder = new_folder(spark, "ann-forest")
    blocks = build(rows.select("vec_id", "v"), folder, k)

    asked = rows.where("q").select("vec_id", "v", F.size("v").alias("dim"))
    groups = max(1, -(-asked.count() // GROUP))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))

    def write_group(part: pa.Table) -> pa.Table:
        name, out = new_file(folder, ".arrow")
        with out, pa.ipc.new_stream(out, part.schema) as stream:
            stream.write_table(part)
        return pa.table({"dim": part["dim"].slice(0, 1), "queries": [name]})

    groups_ = materialize(asked.groupBy("dim", "group").applyInArrow(write_group, "dim int, queries string"), "ann-queries")
    # runs of blocks by the groups of queries of the same dimension: file names only
    number = F.row_number().over(Window.partitionBy("dim").orderBy("file"))
    length = max(1, min(RUN, blocks.count() * groups // (2 * spark.sparkContext.defaultParallelism)))
    runs = blocks.withColumn("run", F.floor((number - 1) / length)).groupBy("dim", "run").agg(F.collect_list(F.struct("file", "range_size")).alias("blocks"))
    work = runs.join(groups_, "dim")
    work = materialize(work.select("blocks", "queries"), "ann-work")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for files, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_file(folder, name) as raw, pa.ipc.open_stream(raw) as stream:
                    part = stream.read_all()

                def read(files=files) -> Iterator[tuple[Block, int]]:
                    for f in files:
                        with open_file(folder, f["file"]) as raw:
                            yield Block.from_bytes(raw.read()), f["range_size"]

                found = search(read(), part["vec_id"].to_numpy(), _matrix(part["v"], part.num_rows), k)
                cols = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    tasks = max(1, work.count())
    found = map_batches(work.repartition(tasks), run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    found = materialize(found, "ann-found")
    for x in (rows, blocks, groups_, work, folder):
        discard(x)
    return found
