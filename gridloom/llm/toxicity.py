"""Toxicity by a convolutional text classifier, trained in numpy on every labelled row.

Every stretch between ASCII white space, without ASCII punctuation at its ends and in lower case, is a word. A word's
vector is the sum of learned vectors at the hashes of the word and of its first 3 to 6 bytes, so that inflected and
compounded forms share what their stem has. Filters of widths 1 to 3 run over the word vectors, each keeps its largest
value (max pooling), and a logistic layer gives the score.

All labelled rows that are not held out teach, whatever their number and length. They are dealt out by id to shards; their
texts are written once as word numbers, and EPOCHS passes go over these, a task for each shard: it goes down from the same
weights over its own shard, the driver goes along the mean of what the shards moved, and the next pass starts there. A task
holds one segment of its shard, the driver two sets of weights, whatever the size of the tables.

For scoring, every word's contribution to every filter tap is computed once and remembered; the sums are the same.
Thresholds are calibrated by language on the fifth of the labelled texts that the passes leave out (by a hash of the
text), on all rows of it; a language with too few rows has the common threshold. The language is no input of the score.

Null and empty texts have only padding and score by the biases. Repeated texts have equal scores. With fewer than
LEAST_OF_CLASS labelled rows of a class every score is the share of label 1, and no row is rejected.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice
from typing import BinaryIO, NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import discard, held_out, make_folder, map_batches, materialize, new_folder, session_of, text_bytes
from gridloom.llm.files import new_file, open_file

BUCKETS = 1 << 15
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (3, 4, 5, 6)
#: Labelled documents that must share a bucket.
LEAST_DOCUMENTS = 3
EPOCHS = 6
BATCH = 16
RATE = 0.1
#: Labelled rows for each shard, up to so many shards: their number follows from the rows, not from the cluster.
SHARD_ROWS, SHARDS = 3000, 256
#: How far the weights go along the mean of what several shards moved. A mean goes less far than one pass over all rows;
#: at 2, held-out mistakes are as few as with a single shard.
STRIDE = 2.0
#: Words after which a segment of a shard ends, and a batch, if it has fewer documents: bounds for memory.
SEGMENT_WORDS, BATCH_WORDS = 1 << 20, 1 << 18
#: Rows of each class that the network needs.
LEAST_OF_CLASS = 5
#: Rows set aside of a language, and toxic ones among them, that a threshold of its own needs; so many toxic ones the
#: common threshold needs too, which else is one half.
LANGUAGE_ROWS, LANGUAGE_TOXIC = 100, 15
#: Words in one pass of the filters, and words that a worker remembers: memory bounds without influence on results. More
#: words would not save time: most are rare, and rows of the others are farther apart.
SLICE_WORDS, CACHED_WORDS, CACHED_BYTES = 1 << 16, 60_000, 48
#: Words whose rows are looked up at a time, so that they stay near the processor: without influence on results.
NEAR_WORDS = 1 << 12

_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: CRC-32 by bytes, and what a start at n changes in it after n bytes.
_CRC = np.array([crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)
_STARTS = {n: np.uint32(crc32(bytes(n), n) ^ crc32(bytes(n))) for n in PREFIXES}


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_buckets(word: bytes) -> list[int]:
    """Buckets whose vectors add up to the word's."""
    w = word.strip(_EDGES) or word
    keys = [crc32(w)]
    keys += [crc32(w[:n], n) for n in PREFIXES if len(w) > n]
    return [k % (BUCKETS - 1) + 1 for k in keys]


def bucket_table(words: list[bytes]) -> np.ndarray:
    """word_buckets() of every word, filled up with bucket 0. The prefixes of a word have one CRC, byte by byte, for all
    words at once."""
    bare = [w.strip(_EDGES) or w for w in words]
    out = np.zeros((len(bare), 1 + len(PREFIXES)), np.uint16)
    out[:, 0] = np.fromiter(map(crc32, bare), np.uint32, len(bare)) % (BUCKETS - 1) + 1
    longest = max(PREFIXES)
    heads = [w[: longest + 1] for w in bare]
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    at = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(heads) + bytes(longest), np.uint8)
    state = np.full(len(bare), 0xFFFFFFFF, np.uint32)
    for n in range(1, longest + 1):
        state = _CRC[(state ^ flat[at + n - 1]) & 0xFF] ^ (state >> 8)
        if n in PREFIXES:
            keys = (state ^ 0xFFFFFFFF ^ _STARTS[n]) % (BUCKETS - 1) + 1
            out[:, 1 + PREFIXES.index(n)] = np.where(sizes > n, keys, 0)
    return out


def numbering(start: dict[bytes, int] | None = None) -> defaultdict[bytes, int]:
    """Gives every new word the next number, from 1."""
    return defaultdict(count(1).__next__, start or {})


def numbers_of(words: list[bytes], numbers: defaultdict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def in_order(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows @ weights, each sum taken term by term in order. A library's product sums a row in an order that depends on
    its place among the rows and on their number, so equal texts in different company would differ in the last digits."""
    out = rows[:, :1] * weights[:1]
    for k in range(1, len(weights)):
        out += rows[:, k : k + 1] * weights[k]
    return out


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def logit(p: float) -> float:
    return math.log(p / (1 - p))


class Segment(NamedTuple):
    """Documents as numbers of words, and the buckets of each word, filled up with bucket 0, whose vector stays zero. Word 0
    is padding."""

    bags: list[np.ndarray]
    table: np.ndarray
    labels: list[int]
    langs: list[str | None]

    def shared(self) -> np.ndarray:
        """How many of the documents have each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for bag in self.bags:
            has = np.zeros(BUCKETS, bool)
            has[self.table[bag]] = True
            out += has
        return out


def segments_of(rows: Iterable[tuple[bytes, str | None, int]]) -> Iterator[tuple[bool, Segment]]:
    """Segments of the labelled texts that are shown and of those that are set aside for thresholds (True). Texts are read
    one by one; of each kind, the numbers of the words of one segment are kept."""
    begun: dict[bool, tuple] = {}

    def closed(aside: bool) -> tuple[bool, Segment]:
        numbers, bags, labels, langs = begun.pop(aside)
        table = bucket_table(list(numbers))
        table[0] = 0
        if len(numbers) <= 1 << 16:
            bags = [bag.astype(np.uint16) for bag in bags]
        return aside, Segment(bags, table, labels, langs)

    held = {False: 0, True: 0}
    for raw, lang, label in rows:
        aside = crc32(raw) % 5 == 1
        numbers, bags, labels, langs = begun.setdefault(aside, (numbering({b"": 0}), [], [], []))  # no word is empty: 0 is padding
        words = words_of(raw)
        bags.append(numbers_of(words, numbers))
        labels.append(label)
        langs.append(lang)
        held[aside] += len(words) + 16
        if held[aside] >= SEGMENT_WORDS:
            yield closed(aside)
            held[aside] = 0
    for aside in sorted(begun):
        yield closed(aside)


class Model:
    """Embedding (BUCKETS, DIMENSIONS), filters (width * DIMENSIONS, FILTERS) for each width, the layer and thresholds."""

    def __init__(self, embedding: np.ndarray, filters: list[np.ndarray], shifts: list[np.ndarray], layer: np.ndarray, bias: float, common: float = 0.5, by_language: dict[str, float] | None = None):
        self.embedding, self.filters, self.shifts, self.layer, self.bias = embedding, filters, shifts, layer, bias
        self.common, self.by_language = common, by_language or {}
        taps = [f[t * DIMENSIONS : (t + 1) * DIMENSIONS] for f in filters for t in range(f.shape[0] // DIMENSIONS)]
        self._taps = np.concatenate(taps, axis=1).astype(np.float32)
        self._at = numbering()
        self._rows = np.zeros((1, self._taps.shape[1]), np.float32)  # row 0 is padding
        self._used = 1

    def _learn(self, words: list[bytes]) -> None:
        """Rows of words that have got the next numbers."""
        need = self._used + len(words)
        if need > len(self._rows):
            more = np.zeros((max(need, min(2 * len(self._rows), CACHED_WORDS + need)), self._rows.shape[1]), np.float32)
            more[: self._used] = self._rows[: self._used]
            self._rows = more
        table = bucket_table(words)
        for begin in range(0, len(words), NEAR_WORDS):
            buckets = table[begin : begin + NEAR_WORDS]
            vectors = self.embedding[buckets[:, 1]]
            for k in range(2, buckets.shape[1]):
                vectors += self.embedding[buckets[:, k]]
            vectors += self.embedding[buckets[:, 0]]
            self._rows[self._used + begin : self._used + begin + len(buckets)] = in_order(vectors, self._taps)
        self._used = need

    def _pooled(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each segment. at: word rows. The last two of a segment begin no window: they
        are padding, or belong to the segment after."""
        n = len(at) - 2
        total = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for begin in range(0, n, NEAR_WORDS):
            own = total[begin : begin + NEAR_WORDS]
            rows = self._rows.take(at[begin : begin + len(own) + 2], axis=0)
            column = 0
            for k, width in enumerate(WIDTHS):
                out = own[:, k * FILTERS : (k + 1) * FILTERS]
                out[:] = rows[: len(own), column : column + FILTERS]
                for tap in range(1, width):
                    out += rows[tap : len(own) + tap, column + tap * FILTERS : column + (tap + 1) * FILTERS]
                column += width * FILTERS
        ends = np.append(starts[1:], n)
        total[np.concatenate([ends - 2, ends - 1])] = -np.inf
        best = np.maximum.reduceat(total, starts) + np.concatenate(self.shifts).astype(np.float32)
        return np.maximum(best, 0)

    def _documents(self, split: list[list[bytes]]) -> np.ndarray:
        if len(self._at) > CACHED_WORDS:
            self._forget()
        rows = [numbers_of(words, self._at) for words in split]
        if new := len(self._at) + 1 - self._used:
            self._learn([*islice(reversed(self._at), new)][::-1])
        return self._of_rows(rows)

    def _forget(self) -> None:
        self._at = numbering()
        self._used = 1

    def _of_rows(self, split: list[np.ndarray]) -> np.ndarray:
        at, starts, owners, size = [], [], [], 0
        pad = np.zeros(2, np.int32)
        for i, rows in enumerate(split):
            rows = rows if len(rows) else pad[:1]
            for begin in range(0, len(rows), SLICE_WORDS):
                # a slice runs on for two words, so that no window is lost; padding follows the last only
                part = rows[begin : begin + SLICE_WORDS + 2]
                least = min(SLICE_WORDS, len(rows) - begin) + 2
                starts.append(size)
                owners.append(i)
                at += part, pad[: least - len(part)]
                size += least
        pooled = self._pooled(np.concatenate([*at, pad]), np.array(starts, np.int64))
        if len(owners) == len(split):
            return pooled
        out = np.full((len(split), pooled.shape[1]), -np.inf, np.float32)
        np.maximum.at(out, owners, pooled)
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        return self.scored(map(words_of, texts))

    def scored(self, split: Iterable[list[bytes]]) -> list[float]:
        """The scores of texts that are lists of words."""
        out: list[float] = []
        group: list[list[bytes]] = []
        held = 0
        for words in split:
            group.append(words)
            held += len(words)
            if held >= SLICE_WORDS:
                out += self._scored(group)
                group, held = [], 0
        return out + (self._scored(group) if group else [])

    def _scored(self, split: list[list[bytes]]) -> list[float]:
        return [sigmoid(x) for x in self._logits(self._documents(split))]

    def _logits(self, pooled: np.ndarray) -> list[float]:
        return (in_order(pooled.astype(np.float64), self.layer[:, None])[:, 0] + self.bias).tolist()

    def logits(self, segment: Segment) -> list[float]:
        """Of all documents of a segment, before the logistic function; what the model remembers of words is lost."""
        self._forget()
        self._rows = in_order(self.embedding[segment.table].sum(1), self._taps)
        out, group, held = [], [], 0
        for bag in segment.bags:
            group.append(bag)
            held += len(bag)
            if held >= SLICE_WORDS:
                out += self._logits(self._of_rows(group))
                group, held = [], 0
        out += self._logits(self._of_rows(group)) if group else []
        self._rows = self._rows[:1].copy()  # a view would keep all rows
        return out

    def threshold(self, lang: str | None) -> float:
        return self.by_language.get(lang, self.common)


def _start(shared: np.ndarray, seed: int) -> dict:
    """Weights and AdaGrad sums before the first pass. shared: how many documents have each bucket."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    # a bucket that few documents share tells nothing about others: its vector stays zero, as that of unseen words
    learned = shared >= LEAST_DOCUMENTS
    learned[0] = False
    embedding[~learned] = 0
    out = {"learned": learned, "embedding": embedding, "seen_embedding": np.full(BUCKETS, 1e-3)}
    for w in WIDTHS:
        out |= {f"filter{w}": rng.normal(0, 0.4, (w * DIMENSIONS, FILTERS)).astype(np.float32), f"shift{w}": np.zeros(FILTERS)}
        out |= {f"seen_filter{w}": np.full((w * DIMENSIONS, FILTERS), 1e-2), f"seen_shift{w}": np.full(FILTERS, 1e-2)}
    out |= {"layer": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "bias": np.zeros(1)}
    return out | {"seen_layer": np.full(FILTERS * len(WIDTHS), 1e-2), "seen_bias": np.full(1, 1e-2)}


def _batches(bags: list[np.ndarray], order: np.ndarray) -> Iterator[list[int]]:
    some, held = [], 0
    for i in order.tolist():
        if some and (len(some) == BATCH or held + len(bags[i]) > BATCH_WORDS):
            yield some
            some, held = [], 0
        some.append(i)
        held += len(bags[i])
    if some:
        yield some


def _descend(state: dict, segments: Iterable[Segment], rate: float, seed: list[int]) -> dict:
    """One pass over the documents of a shard: gradient descent over mini-batches with AdaGrad steps; max pooling passes
    gradients to the winning windows only."""
    state = {k: v.copy() for k, v in state.items()}
    learned, embedding, seen_e = state["learned"], state["embedding"], state["seen_embedding"]
    filters, shifts, seen_f, seen_s = ([state[f"{k}{w}"] for w in WIDTHS] for k in ("filter", "shift", "seen_filter", "seen_shift"))
    layer, seen_l, bias, seen_b = state["layer"], state["seen_layer"], state["bias"], state["seen_bias"]
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    rng = np.random.default_rng(seed)
    for segment in segments:
        bags, table, y = segment.bags, segment.table, np.array(segment.labels, float)
        number = np.zeros(len(table), np.int64)
        for some in _batches(bags, rng.permutation(len(bags))):
            parts = [x for i in some for x in (bags[i] if len(bags[i]) else pad[:1], pad)]
            sizes = np.array([max(1, len(bags[i])) + len(pad) for i in some])
            starts = np.cumsum(sizes) - sizes
            flat = np.concatenate(parts)
            number[flat] = 1
            words = np.flatnonzero(number)
            number[words] = np.arange(len(words))
            place = number[flat]
            number[words] = 0
            vectors = embedding[table[words]].sum(1)
            n = len(place) - len(pad)
            owner = np.repeat(np.arange(len(some)), sizes)[:n]
            idle = (np.append(starts[1:], len(place))[:, None] - 1 - np.arange(len(pad))).ravel()
            idle = idle[idle < n]
            tops, pooled = [], []
            for w, f, s in zip(WIDTHS, filters, shifts, strict=True):
                values = (vectors @ f[:DIMENSIONS]).take(place[:n], axis=0)
                for t in range(1, w):
                    values += (vectors @ f[t * DIMENSIONS : (t + 1) * DIMENSIONS]).take(place[t : n + t], axis=0)
                values[idle] = -np.inf
                best = np.maximum.reduceat(values, starts)
                won, column = np.nonzero(values == best.take(owner, axis=0))
                top = np.empty(best.shape, np.int64)
                top[owner[won[::-1]], column[::-1]] = won[::-1]  # of equal windows the first
                tops.append(top)
                pooled.append(best + s)
            h = np.concatenate(pooled, axis=1)
            slope = np.where(h > 0, 1.0, 0.01)  # a slight slope below zero keeps filters alive while training
            h *= slope
            d = 1 / (1 + np.exp(-np.clip(h @ layer + bias, -60, 60))) - y[some]
            back = d[:, None] * layer * slope
            g = d @ h
            seen_l += g * g
            seen_b += float(d.sum()) ** 2
            layer -= rate * g / np.sqrt(seen_l)
            bias -= rate * float(d.sum()) / np.sqrt(seen_b)
            step = np.zeros_like(vectors)
            for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.empty_like(f)
                for t in range(w):
                    at_word = place[tops[k] + t]  # (batch, FILTERS)
                    tap = slice(t * DIMENSIONS, (t + 1) * DIMENSIONS)
                    np.add.at(step, at_word.ravel(), (own[:, :, None] * f[tap].T).reshape(-1, DIMENSIONS))
                    g[tap] = np.einsum("bj,bjd->dj", own, vectors[at_word])
                seen_f[k] += g * g
                f -= rate * g / np.sqrt(seen_f[k])
                g = own.sum(0)
                seen_s[k] += g * g
                shifts[k] -= rate * g / np.sqrt(seen_s[k])
            moved = np.flatnonzero(step.any(axis=1))
            buckets = table[words[moved]]
            which, used = np.nonzero(learned[buckets])[0], buckets[learned[buckets]]
            if len(used):
                keys, back_to = np.unique(used, return_inverse=True)
                g = np.zeros((len(keys), DIMENSIONS))
                np.add.at(g, back_to, step[moved[which]])
                seen_e[keys] += (g * g).mean(1)
                embedding[keys] -= rate * g / np.sqrt(seen_e[keys])[:, None]
    return state


def _merged(start: dict, ends: Iterable[dict]) -> dict:
    """The start and the mean of what the shards moved, STRIDE times for weights; of a bucket's vector, the mean over the
    shards that moved it."""
    total = {k: np.zeros(v.shape) for k, v in start.items() if k != "learned"}
    count, movers = 0, np.zeros(BUCKETS)
    for end in ends:
        for k, v in total.items():
            v += end[k].astype(np.float64) - start[k]
        movers += end["seen_embedding"] != start["seen_embedding"]
        count += 1
    of = lambda k: np.maximum(movers, 1).reshape(-1, *[1] * (start[k].ndim - 1)) if k.endswith("embedding") else max(count, 1)
    far = lambda k: 1.0 if count < 2 or k.startswith("seen") else STRIDE
    return {"learned": start["learned"]} | {k: (start[k] + far(k) * v / of(k)).astype(start[k].dtype) for k, v in total.items()}


def _passes(state: dict, shards: int, run: Callable[[dict, list[int], float, int], Iterable[dict]]) -> dict:
    """EPOCHS passes over all shards. Several shards that start from chance would go different ways, which have no useful
    mean: before the first pass, one more over the first shard alone brings them on the same way."""
    if shards > 1:
        state = _merged(state, run(state, [0], RATE, EPOCHS))
    for epoch in range(EPOCHS):
        state = _merged(state, run(state, list(range(shards)), RATE * (1 - epoch / EPOCHS), epoch))
    return state


def _model(state: dict) -> Model:
    return Model(state["embedding"], [state[f"filter{w}"] for w in WIDTHS], [state[f"shift{w}"] for w in WIDTHS], state["layer"], float(state["bias"][0]))


def _flat(share: float) -> Model:
    """Every score is the share of label 1."""
    flat = Model(np.zeros((BUCKETS, DIMENSIONS), np.float32), [np.zeros((w * DIMENSIONS, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), 0.0)
    flat.bias = logit(min(max(share, 1e-4), 1 - 1e-4))
    flat.common = 2.0  # no score gets there: without evidence nothing is rejected
    return flat


def _prior(share: float, ones: int, rows: int) -> float:
    """What the balance of the rows shown adds to the logit of the population's."""
    return logit(min(max(share, 1e-4), 1 - 1e-4)) - logit(min(max(ones / max(1, rows), 1e-3), 1 - 1e-3))


def best_threshold(scores: list[float], labels: list[int]) -> float:
    """The middle of the gap at which F1 is largest; of equally good gaps, the one nearest a half."""
    order = sorted(zip(scores, labels, strict=True), reverse=True)
    total, hits, found = sum(labels), 0, []
    for i, (s, y) in enumerate(order):
        hits += y
        low = order[i + 1][0] if i + 1 < len(order) else 0.0
        if low < s:
            found.append((2 * hits / (i + 1 + total), -abs((s + low) / 2 - 0.5), (s + low) / 2))
    return max(found)[2] if found and total else 0.5


def _calibrate(model: Model, common: Callable[[], tuple[int, float]], by_language: Callable[[float], dict[str, float]]) -> Model:
    """Sets thresholds. common: how many toxic rows were set aside, and their best threshold; by_language: the thresholds
    of languages once the logits are moved down."""
    toxic, best = common()
    if toxic >= LANGUAGE_TOXIC:
        # the score's middle is moved to the common threshold, so that one half decides without a language
        move = logit(best) if 0 < best < 1 else 0.0
        model.bias -= move
        model.by_language = by_language(move)
    return model


def train(sample: Iterable[tuple[str | None, str | None, int]], share: float, seed: int = 11) -> Model:
    """Fits one shard here: the network on the texts that are not set aside, the thresholds on the rest. ``share`` of label
    1 in the population corrects the bias for the rows' balance."""
    parts = {aside: [] for aside in (False, True)}
    for aside, segment in segments_of(((text or "").encode(), lang, label) for text, lang, label in sample):
        parts[aside].append(segment)
    every = [y for x in parts.values() for segment in x for y in segment.labels]
    if min(sum(every), len(every) - sum(every)) < LEAST_OF_CLASS:
        return _flat(share)
    shown = parts[False]
    shared = sum((segment.shared() for segment in shown), np.zeros(BUCKETS, np.int64))
    model = _model(_passes(_start(shared, seed), 1, lambda state, _, rate, epoch: [_descend(state, shown, rate, [seed, epoch, 0])]))
    model.bias += _prior(share, sum(sum(x.labels) for x in shown), sum(len(x.labels) for x in shown))
    held = [row for x in parts[True] for row in zip(model.logits(x), x.labels, x.langs, strict=True)]

    def by_language(move: float) -> dict[str, float]:
        found = {}
        for lang in sorted({lang for *_, lang in held if lang is not None}):
            own = [(sigmoid(z - move), y) for z, y, x in held if x == lang]
            if len(own) >= LANGUAGE_ROWS and sum(y for _, y in own) >= LANGUAGE_TOXIC:
                found[lang] = best_threshold([s for s, _ in own], [y for _, y in own])
        return found

    labels = [y for _, y, _ in held]
    return _calibrate(model, lambda: (sum(labels), best_threshold([sigmoid(z) for z, *_ in held], labels)), by_language)


def _put(out: BinaryIO, thing) -> None:
    raw = pickle.dumps(thing, 5)
    packed = pa.compress(raw, "zstd", asbytes=True)
    out.write(struct.pack("<QQ", len(packed), len(raw)) + packed)


def _write(folder: str, thing) -> str:
    """Writes a thing into a new file and returns its name."""
    name, out = new_file(folder, ".bin")
    with out:
        _put(out, thing)
    return name


def _read(folder: str, names: Iterable[str]) -> Iterator:
    """The things in these files, one after another."""
    for name in names:
        with open_file(folder, name) as source:
            while head := source.read(16):
                packed, size = struct.unpack("<QQ", head)
                yield pickle.loads(pa.decompress(source.read(packed), size, "zstd", asbytes=True))


def _encoded(docs: DataFrame, known: DataFrame, folder: str, tasks: int) -> list:
    """Writes the labelled texts as segments. Of each task, the files of those shown, of those set aside and of the numbers
    of documents by bucket among the shown, then (rows, toxic ones) of both kinds. Labels and texts meet in the order of
    ids, so texts move once; of several texts of one id the least counts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        def labelled() -> Iterator[tuple[bytes, str | None, int]]:
            """The label of an id comes before its texts."""
            of, label = object(), None
            for b in batches:
                raw, lang = b.column(2).cast(pa.binary()), b.column(3)
                for i, (doc_id, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    if y is not None:
                        of, label = doc_id, y
                    elif doc_id == of and label is not None:
                        yield raw[i].as_py(), lang[i].as_py(), label
                        label = None

        names, sinks = zip(*(new_file(folder, ".bin") for _ in range(2)), strict=True)
        shared, counts = np.zeros(BUCKETS, np.int64), np.zeros((2, 2), np.int64)
        with sinks[0], sinks[1]:
            for aside, segment in segments_of(labelled()):
                _put(sinks[aside], segment)
                counts[int(aside)] += (len(segment.labels), sum(segment.labels))
                if not aside:
                    shared += segment.shared()
        if counts.any():
            columns = [TaskContext.get().partitionId(), *names, _write(folder, shared), counts.ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in columns], names=["task", "shown", "aside", "shared", "counts"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = texts.select("doc_id", F.lit(None).cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    rows = texts.unionAll(known.select("doc_id", "label", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang")))
    rows = rows.repartition(tasks, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.desc_nulls_last("label"), "text", "lang")
    return sorted(map_batches(rows, run, "task long, shown string, aside string, shared string, counts array<long>").collect())


def _each(spark: SparkSession, shards: list[int], fn: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows of every shard, a task for each."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from fn(shards[i])

    return map_batches(spark.range(0, len(shards), 1, len(shards)), run, schema)


def best_thresholds(scored: DataFrame, by: Column) -> DataFrame:
    """(scope, n, toxic, threshold): best_threshold() of (score, label) rows for each value of ``by``."""
    steps = scored.groupBy(by.alias("scope"), "score").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    down = Window.partitionBy("scope").orderBy(F.desc("score"))
    whole = Window.partitionBy("scope")
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.select(
        "scope", "n", "toxic", "score", F.coalesce(F.lead("score").over(down), F.lit(0.0)).alias("low"), F.sum("n").over(so_far).alias("taken"),
        F.sum("toxic").over(so_far).alias("hits"), F.sum("toxic").over(whole).alias("total"),
    )
    middle = (F.col("score") + F.col("low")) / 2
    gap = F.struct((2 * F.col("hits") / (F.col("taken") + F.col("total"))).alias("f1"), (-F.abs(middle - 0.5)).alias("near"), middle.alias("at"))
    found = steps.groupBy("scope").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.max(F.when(F.col("low") < F.col("score"), gap)).alias("g"))
    return found.select("scope", "n", "toxic", F.when(F.col("toxic") > 0, F.coalesce("g.at", F.lit(0.5))).otherwise(0.5).alias("threshold"))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """Fits on all labelled rows that are not held out. A document with several labels has the largest. Labels without a
    document take no part."""
    spark = session_of(docs)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    number = min(SHARDS, max(1, -(-known.count() // SHARD_ROWS)))
    folder = make_folder(spark, new_folder(spark, "toxicity-shards"))
    files = _encoded(docs, known, folder, number)
    (rows, ones), (rows_aside, ones_aside) = np.sum([r["counts"] for r in files], axis=0, initial=0).reshape(-1, 2).tolist() if files else [(0, 0)] * 2
    total, toxic = rows + rows_aside, ones + ones_aside
    share = toxic / total if total else 0.5
    if min(toxic, total - toxic) < LEAST_OF_CLASS:
        discard(folder)
        return _flat(share)
    # a session may use more tasks than were asked for: the number of shards stays
    shown, aside = ([y for k in range(number) if (y := [r[kind] for r in files if r["counts"][at]][k::number])] for kind, at in (("shown", 0), ("aside", 2)))

    def run(state: dict, some: list[int], rate: float, epoch: int) -> Iterator[dict]:
        if not some:
            return
        own = make_folder(spark, new_folder(spark, "toxicity-weights"))
        start = _write(own, state)

        def end(i: int) -> Iterator[pa.RecordBatch]:
            state = _descend(next(_read(own, [start])), _read(folder, shown[i]), rate, [seed, epoch, i])
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([_write(own, state)])], names=["shard", "name"])

        yield from _read(own, [r["name"] for r in sorted(_each(spark, some, end, "shard long, name string").collect())])
        discard(own)

    shared = sum(_read(folder, [r["shared"] for r in files]), np.zeros(BUCKETS, np.int64))
    state = _passes(_start(shared, seed), len(shown), run)
    model = _model(state)
    model.bias += _prior(share, ones, rows)
    bias = model.bias
    if ones_aside < LANGUAGE_TOXIC:
        discard(folder)
        return model

    def logits(i: int) -> Iterator[pa.RecordBatch]:
        own = _model(state)
        own.bias = bias
        for segment in _read(folder, aside[i]):
            columns = [pa.array(own.logits(segment), pa.float64()), pa.array(segment.labels, pa.int32()), pa.array(segment.langs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["z", "label", "lang"])

    scored = materialize(_each(spark, list(range(len(aside))), logits, "z double, label int, lang string"), "toxicity-aside", narrow=True)

    def found(move: float, by: Column, least: int) -> list:
        z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("z") - move))
        best = best_thresholds(scored.where(by.isNotNull()).withColumn("score", 1 / (1 + F.exp(-z))), by)
        return best.where((F.col("n") >= least) & (F.col("toxic") >= LANGUAGE_TOXIC)).collect()

    common = lambda: next(((r["toxic"], r["threshold"]) for r in found(0.0, F.lit(""), 0)), (0, 0.5))
    _calibrate(model, common, lambda move: {r["scope"]: r["threshold"] for r in found(move, F.col("lang"), LANGUAGE_ROWS)})
    discard(scored)
    discard(folder)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: doc_id), the score and ``rejected``: whether it reaches the threshold of the row's
    language, if the input has a column lang, or the common one."""
    keep = keep or ["doc_id"]
    parts = (model.embedding, model.filters, model.shifts, model.layer, model.bias, model.common, model.by_language)
    has_lang = "lang" in docs.columns
    lang = F.col("lang") if has_lang else F.lit(None).cast("string")
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = Model(*parts)
        for b in batches:
            scores = own.scores(text_bytes(b.column(0)))
            bad = [s >= own.threshold(x) for s, x in zip(scores, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], names=[*names, "score", "rejected"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keep, strict=True)), "score double, rejected boolean"])
    out = map_batches(docs.select(F.col(text), lang, *(F.col(k).alias(n) for k, n in zip(keep, names, strict=True))), run, schema)
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))
