"""Quality classifier by supervised subword embeddings.

Every stretch between ASCII white space is a word. Its features are the word itself and its character 3- to 5-grams with
border marks, each hashed to a learned vector; the word's vector is their mean. Word 2-grams are hashed too, by the
difference of their words' hashes, so that a word after itself is one 2-gram whatever the word. The document's vector is
the mean over its words and word 2-grams. A softmax layer gives the class probabilities. Vectors and layer are trained by
numpy stochastic gradient descent (AdaGrad steps over small batches).

For scoring, the layer is applied to the vectors once, which leaves one number for each bucket: the averages are linear,
so the scores are the same. Null and empty texts have the zero vector and score by the bias alone. Repeated texts have
equal scores. Without labelled rows of both classes, every score is the share of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from gridloom.llm.common import map_batches, text_bytes
from gridloom.llm.labelled import labelled_rows

#: Buckets of words and character n-grams, and those of word 2-grams after them.
BUCKETS, PAIRS = 1 << 17, 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
EPOCHS = 3
BATCH = 32
RATE = 0.5
#: Words whose sums a worker remembers, and the longest of them; memory bounds without influence on results.
CACHED_WORDS, CACHED_BYTES = 500_000, 48


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of these words, and where each word's begin. Words must not be empty."""
    marked = [f"<{w.decode()}>" for w in words]
    joined = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(joined))  # characters from here to the word's end
    buckets = [np.fromiter(map(crc32, words), np.uint64, len(words))]
    owners = [np.arange(len(words))]
    mixed = joined + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        mixed[: len(joined) - n + 1] = mixed[: len(joined) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + joined[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            inside = np.flatnonzero(left >= n)
            buckets.append(mixed[inside] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40))
            owners.append(owner[inside])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return (buckets[order] % np.uint64(BUCKETS)).astype(np.int64), starts


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the 2-grams of a document's words, given the 64-bit hashes of the words in order."""
    mixed = (hashes[1:] - hashes[:-1]) * np.uint64(0xBF58476D1CE4E5B9)
    return (BUCKETS + (mixed >> np.uint64(40)) % np.uint64(PAIRS)).astype(np.int64)


class Model:
    """One weight for each bucket, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.at: dict[bytes, int] = {}
        self.means, self.hashes, self.used = np.zeros(1 << 12), np.zeros(1 << 12, np.uint64), 0

    def _learn(self, words: list[bytes]) -> None:
        """Remembers the mean weight of each word's features, and its hash."""
        for at in range(0, len(words), 1 << 14):
            part = words[at : at + (1 << 14)]
            buckets, starts = word_features(part)
            need = self.used + len(part)
            if need > len(self.means):
                grown = max(need, 2 * len(self.means))
                self.means, self.hashes = (np.concatenate([x[: self.used], np.zeros(grown - self.used, x.dtype)]) for x in (self.means, self.hashes))
            self.means[self.used : need] = np.add.reduceat(self.weights[buckets], starts) / np.diff(np.append(starts, len(buckets)))
            self.hashes[self.used : need] = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part))
            self.at.update(zip(part, range(self.used, need), strict=True))
            self.used = need

    def scores(self, texts: list[bytes]) -> list[float]:
        split = [t.split() for t in texts]
        if len(self.at) > CACHED_WORDS:
            self.at.clear()
            self.used = 0
        new = list({w for words in split for w in words}.difference(self.at))
        self._learn(new)
        out = []
        for words in split:
            z = self.bias
            if words:
                own = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                pairs = self.weights[pair_buckets(self.hashes[own])]
                z += (float(self.means[own].sum()) + float(pairs.sum())) / (2 * len(words) - 1)
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        for w in new:
            if len(w) > CACHED_BYTES:
                del self.at[w]
        return out


def _features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_features() of many words, some at a time."""
    buckets, sizes = [], []
    for at in range(0, len(vocabulary), 1 << 14):
        part, starts = word_features(vocabulary[at : at + (1 << 14)])
        buckets.append(part.astype(np.int32))
        sizes.append(np.diff(np.append(starts, len(part))))
    return np.concatenate(buckets), np.concatenate(sizes)


def train(sample: Iterable[tuple[str | None, str | None, int]], share: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits the model; ``share`` of label 1 in the population corrects the bias for the sample's balance. Texts are read
    one by one; the numbers and counts of their words are kept."""
    numbers: dict[bytes, int] = {}
    hashes: list[int] = []
    bags, labels = [], []
    for text, _, label in sample:
        words = (text or "").encode().split()
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
                hashes.append(xxhash.xxh3_64_intdigest(w))
        own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        pairs = pair_buckets(np.array([hashes[i] for i in own.tolist()], np.uint64))
        bags.append([(k.astype(np.int32), (n / (2 * len(words) - 1)).astype(np.float32)) for k, n in (np.unique(x, return_counts=True) for x in (own, pairs))])
        labels.append(label)
    if len(set(labels)) < 2:
        share = min(max(share, 1e-4), 1 - 1e-4)
        return Model(np.zeros(BUCKETS + PAIRS), math.log(share / (1 - share)))
    buckets, sizes = _features(list(numbers)) if numbers else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + PAIRS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (2, DIMENSIONS)), np.zeros(2)
    seen_v, seen_l, seen_b = np.full(BUCKETS + PAIRS, 1e-4), np.full((2, DIMENSIONS), 1e-2), np.full(2, 1e-2)
    y = np.array(labels)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH].tolist()
            gather = lambda kind, part: np.concatenate([bags[i][kind][part] for i in some])
            owner, pair_owner = (np.repeat(np.arange(len(some)), [len(bags[i][kind][0]) for i in some]) for kind in (0, 1))
            weight, pairs, pair_weight = gather(0, 1), gather(1, 0), gather(1, 1)
            words, place = np.unique(gather(0, 0), return_inverse=True)
            hidden = np.zeros((len(some), DIMENSIONS))
            if len(words):
                size = sizes[words]
                begin = np.cumsum(size) - size
                flat = buckets[np.arange(size.sum()) + np.repeat(starts[words] - begin, size)]
                means = np.add.reduceat(vectors[flat], begin) / size[:, None]
                for k in range(DIMENSIONS):
                    hidden[:, k] = np.bincount(owner, weight * means[place, k], len(some)) + np.bincount(pair_owner, pair_weight * vectors[pairs, k], len(some))
            logits = hidden @ layer.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ layer
            g = p.T @ hidden
            seen_l += g * g
            seen_b += p.sum(0) ** 2
            if len(words):
                keys, to = np.unique(np.concatenate([flat, pairs]), return_inverse=True)
                step = np.empty((len(keys), DIMENSIONS))
                for k in range(DIMENSIONS):
                    own = np.bincount(place, weight * back[owner, k], len(words)) / size
                    step[:, k] = np.bincount(to, np.concatenate([np.repeat(own, size), pair_weight * back[pair_owner, k]]), len(keys))
                seen_v[keys] += (step * step).mean(1)
                vectors[keys] -= RATE * step / np.sqrt(seen_v[keys])[:, None]
            layer -= RATE * g / np.sqrt(seen_l)
            bias -= RATE * p.sum(0) / np.sqrt(seen_b)
    ones = sum(labels) / len(labels)
    prior = math.log(max(share, 1e-4) / max(1 - share, 1e-4)) - math.log(ones / (1 - ones))
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]) + prior)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out."""
    return train(*labelled_rows(docs, labels, "quality"))


def score(docs: DataFrame, model: Model, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, score) of every row: the probability of label 1."""
    weights, bias = model.weights.astype(np.float32), model.bias

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = Model(weights.astype(np.float64), bias)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.scores(text_bytes(b.column(1))), pa.float64())], names=[keep, "score"])

    kind = dict(docs.dtypes)[keep]
    return map_batches(docs.select(keep, text), run, f"`{keep}` {kind}, score double")
