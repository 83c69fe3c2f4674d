"""Toxicity: a convolutional classifier over hashed word embeddings, with a threshold for each language.

All labelled documents are learned from, dealt out into shards: in each round every shard goes through its documents once, from
the same weights, and the weights that the shards arrive at are averaged. A text's language is found from its words by byte
context trees, one for each language that has enough learning documents and one for all others, learned from the same documents.
"""

from __future__ import annotations

import math
import pickle
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.scratch import remove, written
from lakescribe.llm import ppm
from lakescribe.llm.common import chunks, cut, fold, map_arrow, per_text, runs_of, text_bytes
from lakescribe.operators.numbering import running_total

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: A word is its own bucket and those of its beginnings of so many bytes.
PREFIXES = (4, 5, 6)
OTHER = "other"
_PART = 1 << 18
#: Words whose projections a worker keeps from chunk to chunk.
_KEPT_WORDS = 1 << 16
#: Buckets whose averages are taken together.
_BLOCK = 1 << 12
#: Slots of the filter by which texts without a label stay out of the join; a bound, not a limit of the labels.
_SLOTS = 1 << 23


@dataclass(frozen=True)
class Settings:
    """shard_rows, shard_bytes: labelled documents, and bytes of their texts, of a shard on average; there are as many shards as it takes
    for all of them. Languages with min_per_language learning documents have a tree of order language_order, 0.8 MB each at order 1."""

    shard_rows: int = 8_000
    shard_bytes: int = 64 << 20
    buckets: int = 1 << 18
    size: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    seed: int = 7
    min_per_language: int = 100
    language_order: int = 1
    #: Buckets of fewer learning documents have no vector: what one document holds does not generalise.
    min_documents: int = 3


def features(word: bytes, buckets: int) -> tuple[int, ...]:
    """Buckets of a word: of the whole, and of its beginnings."""
    return (zlib.crc32(word) % buckets, *[zlib.crc32(word[:k], k) % buckets for k in PREFIXES])


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without ASCII punctuation."""
    return text.lower().translate(None, _PUNCTUATION).split()


@dataclass
class Sample:
    """Texts as numbers of their words, and the buckets of each word (word x features); 32-bit integers throughout."""

    docs: list[np.ndarray]
    buckets: np.ndarray

    words: list[bytes]

    def of(self, chosen: np.ndarray) -> Sample:
        return Sample([x for x, k in zip(self.docs, chosen, strict=True) if k], self.buckets, self.words)

    def holders(self, buckets: int) -> np.ndarray:
        """Texts of each bucket."""
        held = np.zeros(buckets, np.int32)
        for x in self.docs:
            held[np.unique(self.buckets[x])] += 1
        return held


class SampleReader:
    """Makes a sample text by text; no text is kept."""

    def __init__(self, buckets: int):
        self.size, self.number, self.docs, self.rows = buckets, {}, [], array("i")

    def add(self, words: list[bytes]) -> None:
        for w in words:
            if w not in self.number:
                self.number[w] = len(self.number)
                self.rows.extend(features(w, self.size))
        self.docs.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))

    def sample(self) -> Sample:
        return Sample(self.docs, np.array(self.rows, np.int32).reshape(-1, len(PREFIXES) + 1), list(self.number))


class WordTrees:
    """Languages by the words of a text: of each a byte context tree over its learning documents' words, where no context
    reaches beyond its word, so that a word is scored once however often it occurs."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.trees: list[ppm.ContextTree] = []

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Code lengths (tree x word); word 0 is a blank."""
        logs = np.array([tree.score(words) for tree in self.trees]).reshape(len(self.trees), len(words))
        logs[:, :1] = 0
        return logs

    def guess(self, words: list[bytes], places: np.ndarray, starts: np.ndarray) -> list[str]:
        """The language with the shortest code for each text; of equal ones the first name, `other` for a text without words.

        places: the texts' words as numbers, at least one for each text; number 0 is a blank.
        """
        return self.guess_from(self.word_logs(words), places, starts)

    def guess_from(self, word_logs: np.ndarray, places: np.ndarray, starts: np.ndarray) -> list[str]:
        """`guess` by the code lengths of the words."""
        if not self.trees or not len(starts):
            return [OTHER] * len(starts)
        logs = np.empty((len(self.trees), len(starts)))
        for log, of_word in zip(logs, word_logs, strict=True):
            log[:] = np.add.reduceat(of_word[places], starts)
        there = np.add.reduceat(places != 0, starts, dtype=np.int64) > 0
        return [self.names[k] if has else OTHER for k, has in zip(logs.argmax(axis=0), there, strict=True)]


@dataclass
class Steps:
    """What training carries on beside the weights: buckets that are learned, class weights, sums of squares and moments."""

    known: np.ndarray
    share: float  # of the learning documents that have label 1
    squares: np.ndarray
    moments: dict[str, tuple[np.ndarray, np.ndarray]]
    step: int = 0


@dataclass
class Classifier:
    settings: Settings
    vectors: np.ndarray  # bucket x size
    kernels: np.ndarray  # size x (offsets of all widths * filters)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: WordTrees = field(default_factory=WordTrees)

    @classmethod
    def fresh(cls, s: Settings) -> Classifier:
        rng = np.random.default_rng(s.seed)
        offsets, kinds = sum(s.widths), len(s.widths)
        return cls(
            s, rng.normal(0, 0.02, (s.buckets, s.size)).astype(np.float32), rng.normal(0, 0.4, (s.size, offsets * s.filters)).astype(np.float32),
            np.zeros(kinds * s.filters, np.float32), rng.normal(0, 0.3, kinds * s.filters).astype(np.float32), 0.0)

    def _convolve(self, projected: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Sums of the filters (filter x position) before bias, from the projections (offset and filter x word) of the words at the places.

        A blank, word 0, behind a text has the sums of nothing, so that no window reaches the next text.
        """
        s, at = self.settings, 0
        found = np.empty((len(s.widths) * s.filters, len(places)), np.float32)
        for w, width in enumerate(s.widths):
            total = found[w * s.filters : (w + 1) * s.filters]
            for j in range(width):
                own = projected[at : at + s.filters].take(places[j:], axis=1)
                if j:
                    total[:, : len(places) - j] += own
                else:
                    total[:] = own
                at += s.filters
        found[:, places == 0] = 0
        return found

    def _pooled(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Greatest activations (text x filter); bias and cut at zero keep the order of the sums."""
        return np.maximum(np.maximum.reduceat(found, starts, axis=1).T + self.bias, 0)

    def project(self, buckets: np.ndarray) -> np.ndarray:
        """Projections (offset and filter x word) of words by their buckets (word x features)."""
        return np.ascontiguousarray((self.vectors[buckets].sum(axis=1) @ self.kernels).T)

    def _numbered(self, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, the first of them blank, the texts as their numbers with blanks behind each, and where each starts."""
        pad = max(max(self.settings.widths) - 1, 1)
        number: dict[bytes, int] = {b"": 0}
        flat: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(flat))
            flat += [number.setdefault(w, len(number)) for w in words]
            flat += [0] * pad
        return list(number), np.array(flat, np.int64), np.array(starts, np.int64)

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Before thresholds; a text without words has the shift alone."""
        return self._logits(*self._numbered(texts))

    def _logits(self, words: list[bytes], places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        projected = self.project(np.array([features(w, self.settings.buckets) for w in words], np.int64))
        projected[:, 0] = 0
        return self._pooled(self._convolve(projected, places), starts) @ self.out + self.shift

    def sample_logits(self, sample: Sample) -> np.ndarray:
        """logits() of the texts of a sample."""
        pad = max(max(self.settings.widths) - 1, 1)
        found = np.empty(len(sample.docs))
        for i, words in enumerate(sample.docs):
            unique, places = np.unique(words, return_inverse=True)
            projected = np.zeros((self.kernels.shape[1], len(unique) + 1), np.float32)
            projected[:, 1:] = self.project(sample.buckets[unique])
            places = np.concatenate([places.reshape(-1) + 1, np.zeros(pad, np.int64)])
            found[i] = (self._pooled(self._convolve(projected, places), np.zeros(1, np.int64)) @ self.out + self.shift)[0]
        return found

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1; the threshold of the text's guessed language is at one half."""
        return Scorer(self).scores(texts)

    def begin(self, held: np.ndarray, share: float) -> Steps:
        """The start of training: buckets that too few learning documents have get no vector. held: learning documents of each bucket."""
        known = held >= self.settings.min_documents
        self.vectors[~known] = 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.dense().items()}
        return Steps(known, share, np.zeros(self.settings.buckets, np.float32), moments)

    def dense(self) -> dict[str, np.ndarray]:
        return {"kernels": self.kernels, "bias": self.bias, "out": self.out}

    def train(self, sample: Sample, labels: np.ndarray) -> None:
        """All rounds over one sample."""
        steps = self.begin(sample.holders(self.settings.buckets), float(labels.mean()))
        for number in range(self.settings.epochs):
            self.train_round(sample, labels, steps, number)

    def train_round(self, sample: Sample, labels: np.ndarray, steps: Steps, number: int, shard: int = 0) -> None:
        """Minibatches once through a sample, logistic loss, adaptive steps."""
        s, rng, pad = self.settings, np.random.default_rng(self.settings.seed + 1 + shard), max(max(self.settings.widths) - 1, 1)
        n_features, docs, dense = len(PREFIXES) + 1, sample.docs, self.dense()
        weight = np.where(labels > 0, 0.5 / max(steps.share, 1e-6), 0.5 / max(1 - steps.share, 1e-6))
        blank = np.full(pad, -1, np.int32)
        for _ in range(number + 1):
            order = rng.permutation(len(docs))
        for i in range(0, len(order), s.batch):
            own = order[i : i + s.batch]
            words, places = np.unique(np.concatenate([x for k in own for x in (docs[k], blank)]), return_inverse=True)  # the blank is the first
            places = places.reshape(-1)
            sizes = np.array([len(docs[k]) + pad for k in own])
            starts = np.cumsum(sizes) - sizes
            buckets = np.full((len(words), n_features), -1, np.int32)
            buckets[1:] = sample.buckets[words[1:]]
            vectors = self.vectors[np.maximum(buckets, 0)].sum(axis=1)
            vectors[0] = 0
            found = self._convolve(np.ascontiguousarray((vectors @ self.kernels).T), places)
            pooled = self._pooled(found, starts)
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))
            error = ((p - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = error[:, None] * self.out * (pooled > 0)
            grads = {"kernels": np.zeros_like(self.kernels), "bias": back.sum(0), "out": pooled.T @ error}
            touched, moved = [], []
            where = np.empty(pooled.shape, np.int64)
            for k, (a, n) in enumerate(zip(starts, sizes, strict=True)):
                where[k] = a + found[:, a : a + n].argmax(axis=1)
            there = (places > 0).astype(np.float32)
            column = 0
            for w, width in enumerate(s.widths):
                mine = slice(w * s.filters, (w + 1) * s.filters)
                for j in range(width):
                    cols = np.arange(column, column + s.filters)
                    at = np.minimum(where[:, mine] + j, len(places) - 1)
                    g = back[:, mine] * there[where[:, mine]]  # the activations of nothing move the bias only
                    grads["kernels"][:, cols] += np.einsum("dfk,df->kf", vectors[places[at]], g)
                    moved.append((self.kernels.T[cols][None] * (g * there[at])[..., None]).reshape(-1, s.size))
                    touched.append(at.ravel())
                    column += s.filters
            flow, rows = np.concatenate(moved), buckets[places[np.concatenate(touched)]]
            used = (rows[:, 0] >= 0) & (np.abs(flow).max(axis=1) > 0)
            bucket, inverse = np.unique(rows[used], return_inverse=True)
            if len(bucket):
                inverse, flow = inverse.reshape(-1), np.repeat(flow[used], n_features, axis=0)
                change = np.stack([np.bincount(inverse, flow[:, c], len(bucket)) for c in range(s.size)], axis=1).astype(np.float32)
                change *= steps.known[bucket][:, None]
                steps.squares[bucket] += (change**2).mean(axis=1)
                self.vectors[bucket] -= s.rate * 5 * change / (np.sqrt(steps.squares[bucket])[:, None] + 1e-4)
            steps.step += 1
            for k, value in dense.items():
                m, v = steps.moments[k]
                m += 0.1 * (grads[k] - m)
                v += 0.01 * (grads[k] ** 2 - v)
                value -= s.rate * (m / (1 - 0.9**steps.step)) / (np.sqrt(v / (1 - 0.99**steps.step)) + 1e-6)
            self.shift -= s.rate * float(error.sum())


class Scorer:
    """A classifier at work in one task: what a word adds is kept from chunk to chunk, for a bounded number of words."""

    def __init__(self, model: Classifier):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.done = 1
        self.projected = np.zeros((self.model.kernels.shape[1], 1 << 12), np.float32)
        self.logs = np.zeros((len(self.model.languages.trees), 1 << 12))

    def _learn(self) -> None:
        """Projections and code lengths of the words that are new."""
        words = list(islice(self.number, self.done, None))
        if not words:
            return
        end = self.done + len(words)
        if end > self.projected.shape[1]:
            room = 1 << end.bit_length()
            self.projected, self.logs = (np.concatenate([x, np.zeros((len(x), room - x.shape[1]), x.dtype)], axis=1) for x in (self.projected, self.logs))
        self.projected[:, self.done : end] = self.model.project(np.array([features(w, self.model.settings.buckets) for w in words], np.int64))
        if len(self.logs):
            self.logs[:, self.done : end] = self.model.languages.word_logs([b"", *words])[:, 1:]
        self.done = end

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, model, number = np.empty(len(texts)), self.model, self.number
        blank = [0] * max(max(model.settings.widths) - 1, 1)
        for a, b in chunks(texts, _PART):
            if len(number) > _KEPT_WORDS:
                self._forget()
                number = self.number
            flat: list[int] = []
            starts = []
            for text in texts[a:b]:
                starts.append(len(flat))
                flat += [number.setdefault(w, len(number)) for w in words_of(text)]
                flat += blank
            self._learn()
            places, begin = np.array(flat, np.int64), np.array(starts, np.int64)
            logits = model._pooled(model._convolve(self.projected, places), begin) @ model.out + model.shift
            cut_ = [model.thresholds.get(x, model.thresholds.get(OTHER, 0.0)) for x in model.languages.guess_from(self.logs, places, begin)]
            out[a:b] = 1 / (1 + np.exp(-np.clip(logits - cut_, -40, 40)))
        return out


def _guessed(languages: WordTrees, sample: Sample) -> list[str]:
    """Languages of a sample's texts; number 0 becomes the blank, and stands behind each text."""
    sizes = np.array([len(x) + 1 for x in sample.docs], np.int64)
    places = np.concatenate([y for x in sample.docs for y in (x.astype(np.int64) + 1, [0])])
    return languages.guess([b"", *sample.words], places, np.cumsum(sizes) - sizes)


@dataclass
class Shard:
    """Labelled documents that one task goes through, with label, whether held back, and language."""

    number: int
    sample: Sample
    label: np.ndarray
    held: np.ndarray
    language: list[str | None]

    @classmethod
    def of(cls, number: int, rows: pa.Table, buckets: int) -> Shard:
        reader = SampleReader(buckets)
        for batch in rows.to_batches():
            for text in text_bytes(batch.column(3)):
                reader.add(words_of(text))
        return cls(number, reader.sample(), rows.column(1).to_numpy().astype(np.float32), rows.column(2).to_numpy() == 0, rows.column(4).to_pylist())

    def learning(self, all_: bool) -> np.ndarray:
        return np.ones(len(self.held), bool) if all_ else ~self.held

    def checking(self, all_: bool) -> np.ndarray:
        return np.ones(len(self.held), bool) if all_ else self.held


def _packed(value: object) -> bytes:
    plain = pickle.dumps(value, pickle.HIGHEST_PROTOCOL)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> object:
    return pickle.loads(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def _shards(rows: DataFrame, n_shards: int, settings: Settings) -> tuple[DataFrame, str]:
    """(shard, model) with all rows (shard, label, held, text, lang, doc_id) of each shard as numbers, written, and the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), own in runs_of(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([_packed(Shard.of(number, own, settings.buckets))], pa.binary())], names=["shard", "model"])

    # the same order whatever the partitions were
    dealt = rows.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id", "text", "lang")
    return written(map_arrow(dealt.select("shard", "label", "held", "text", "lang"), run, "shard int, model binary"))


def _over_shards(shards: DataFrame, work, schema: str) -> DataFrame:
    """Rows of `work(shards of a task)`, which yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(_unpacked(x.as_py()) for batch in batches for x in batch.column(1))

    return map_arrow(shards, run, schema)


def _holders(shards: DataFrame, everything: bool, settings: Settings) -> np.ndarray:
    """Learning documents of each bucket."""

    def work(own):
        held = np.zeros(settings.buckets, np.int64)
        for shard in own:
            held += shard.sample.of(shard.learning(everything)).holders(settings.buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    rows = _over_shards(shards, work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one small row for each bucket
    found = np.zeros(settings.buckets, np.int64)
    found[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return found


#: Weights are averaged in integers, so that the order in which shards are added changes nothing.
_VECTOR_LIMIT, _DENSE_LIMIT = 1 << 12, 1 << 8


def _scale(n_shards: int, limit: int) -> float:
    return 2.0 ** (62 - int(math.log2(limit)) - math.ceil(math.log2(n_shards + 1)))


def _fixed(values: np.ndarray, scale: float, limit: int) -> np.ndarray:
    return np.rint(np.clip(values.astype(np.float64), -limit, limit) * scale).astype(np.int64)


def _flat(model: Classifier, steps: Steps) -> np.ndarray:
    """Everything but vectors as one row of numbers."""
    return np.concatenate([x.ravel().astype(np.float64) for x in (*model.dense().values(), *[y for m in steps.moments.values() for y in m], np.array([model.shift]))])


def _train_round(shards: DataFrame, model: Classifier, steps: Steps, number: int, n_shards: int, everything: bool) -> None:
    """One round of all shards, each from the same weights; then a bucket has the mean of the shards that moved it, and
    what all shards move has the mean of all. No more than the weights comes to the driver."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((model, steps))
    vector_scale, dense_scale, size = _scale(n_shards, _VECTOR_LIMIT), _scale(n_shards, _DENSE_LIMIT), model.settings.size

    def work(own):
        base = pickle.dumps(shared.value)
        sums = np.zeros((model_buckets, size + 1), np.int64)
        count = np.zeros(model_buckets, np.int32)
        dense, last, n = 0, 0, 0
        for shard in own:
            learned = shard.learning(everything)
            if not learned.any():
                continue
            m, t = pickle.loads(base)
            before = t.squares.copy()
            m.train_round(shard.sample.of(learned), shard.label[learned], t, number, shard.number)
            at = np.flatnonzero(t.squares != before)
            now = np.concatenate([m.vectors[at], t.squares[at, None]], axis=1)
            sums[at] += _fixed(now, vector_scale, _VECTOR_LIMIT)
            count[at] += 1
            dense, last, n = dense + _fixed(_flat(m, t), dense_scale, _DENSE_LIMIT), max(last, t.step), n + 1
        if n:
            moved = np.flatnonzero(count)
            ends = np.searchsorted(moved, np.arange(0, model_buckets + _BLOCK, _BLOCK))
            for block, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if a < b:
                    at = moved[a:b]
                    values = (now[a:b] if n == 1 else sums[at])  # of one shard the numbers as they are, which are half as long
                    yield _row(block, (at, count[at], values))
            yield _row(-1, (n, dense, last))

    def reduce(batches):
        for (block,), rows in runs_of(batches, 1):
            parts = [_unpacked(x.as_py()) for x in rows.column(1)]
            if block < 0:
                n = sum(p[0] for p in parts)
                yield _row(block, (sum(p[1] for p in parts) / dense_scale / n, max(p[2] for p in parts)))
                continue
            sums, count = np.zeros((_BLOCK, size + 1), np.int64), np.zeros(_BLOCK, np.int64)
            for at, n, values in parts:
                sums[at - block * _BLOCK] += values if values.dtype == np.int64 else _fixed(values, vector_scale, _VECTOR_LIMIT)
                count[at - block * _BLOCK] += n
            at = np.flatnonzero(count)
            yield _row(block, (at + block * _BLOCK, (sums[at] / vector_scale / count[at, None]).astype(np.float32)))

    model_buckets = model.settings.buckets
    moved = _over_shards(shards, work, "block int, model binary")
    for row in map_arrow(moved.repartition("block").sortWithinPartitions("block"), reduce, "block int, model binary").collect():
        found = _unpacked(row.model)
        if row.block >= 0:
            at, values = found
            model.vectors[at], steps.squares[at] = values[:, :size], values[:, size]
            continue
        flat, steps.step = found
        place = 0
        for x in (*model.dense().values(), *[y for m in steps.moments.values() for y in m]):
            x[:] = flat[place : place + x.size].reshape(x.shape)
            place += x.size
        model.shift = float(flat[-1])
    shared.destroy()


def _row(block: int, value: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(value)], pa.binary())], names=["block", "model"])


def _learn_languages(shards: DataFrame, known: set[str], everything: bool, settings: Settings) -> WordTrees:
    """Trees of the known languages and one, `other`, of all other learning documents; none if no language is known."""
    found = WordTrees()
    if not known:
        return found

    def work(own):
        for shard in own:
            learned = shard.learning(everything)
            named = [x if x in known else OTHER for x, k in zip(shard.language, learned, strict=True) if k]
            docs = shard.sample.of(learned).docs
            for name in sorted(set(named)):
                number, count = np.unique(np.concatenate([x for x, y in zip(docs, named, strict=True) if y == name]), return_counts=True)
                if len(number):
                    keys, n = ppm.window_keys([shard.sample.words[i] for i in number], settings.language_order)
                    by = np.argsort(keys, kind="stable")
                    keys, n = ppm.run_lengths(keys[by], np.repeat(count, n)[by])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "key", "n"])

    counts = _over_shards(shards, work, "label string, key bigint, n bigint").groupBy("label", "key").agg(F.sum("n").alias("n"))
    for row in sorted(ppm.trees(counts, settings.language_order).collect(), key=lambda r: r.label):  # one tree for each language
        found.names.append(row.label)
        found.trees.append(pickle.loads(row.model))
    return found


def _thresholds(shards: DataFrame, model: Classifier, everything: bool, weights: tuple[float, float]) -> dict[str, float]:
    """The cut of the best F1 in each guessed language with enough held-back rows of both classes, and over all (`other`).

    weights: of a row of each class, clean and toxic, so that ids count alike however many rows they have. The middle of the gap where F1 is best, from running totals over all rows; of equal ones the highest.
    """
    shared = shards.sparkSession.sparkContext.broadcast(model)

    def work(own):
        for shard in own:
            checked = shard.checking(everything)
            if checked.any():
                sample, m = shard.sample.of(checked), shared.value
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_guessed(m.languages, sample), pa.string()), pa.array(m.sample_logits(sample)), pa.array((shard.label[checked] > 0).astype(np.int64))],
                    names=["lang", "logit", "label"])

    rows = _over_shards(shards, work, "lang string, logit double, label bigint")
    each = rows.select(F.explode(F.array_distinct(F.array(F.lit(OTHER), "lang"))).alias("lang"), "logit", "label")
    # both counts of a row in one long: no cut lies between equal logits
    counts = cut(each.groupBy("lang", (-F.col("logit")).alias("low")).agg((F.shiftleft(F.sum("label"), 32) + F.count(F.lit(1))).alias("both")))
    hits, n = F.shiftright("both", 32), F.col("both").bitwiseAND((1 << 32) - 1)
    total = counts.groupBy("lang").agg(F.sum(hits).alias("all_hits"), F.sum(n).alias("all_n"))
    enough = (F.col("all_n") >= model.settings.min_per_language) & F.col("all_hits").between(15, F.col("all_n") - 15)
    total = total.where((F.col("lang") == OTHER) | enough)
    before = running_total(counts, ["lang"], ["low"], "both", "earlier").withColumn("both", F.col("both") + F.col("earlier"))
    clean, toxic = (F.lit(float(x)) for x in weights)
    f1 = 2 * toxic * hits / (clean * (n - hits) + toxic * (hits + F.col("all_hits")))
    # one small row for each language
    best = before.join(total, "lang").groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), (-F.col("low")).alias("logit")))["logit"].alias("top"))
    best = cut(best)
    following = counts.join(best, "lang").where(-F.col("low") < F.col("top")).groupBy("lang").agg(F.max(-F.col("low")).alias("next"))
    found = best.join(following, "lang", "left").collect()
    return {r.lang: (r.top + (r.top if r.next is None else r.next)) / 2 for r in found}


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column, settings: Settings = Settings(), label_col: str = "toxic", lang_col: str = "lang") -> Classifier:
    """A classifier of all labelled training rows; `training` is a condition on doc_id.

    A quarter of them, by a hash of the id, sets the thresholds, all others are learned from. Rows are dealt out into shards by a hash of
    their id; tasks learn from shards, and only weights and counts of a fixed size reach the driver. The languages of lang_col teach the trees that
    find a text's language for its threshold; without such a column there is one threshold. An id with several labels counts as
    toxic if one says so; of its rows each is learned from. Without both classes
    every score is one half of its prior: the untrained classifier gives no document a score of 0.5 or more.
    """
    known = (
        labels.where(training & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label")).where(F.col("label").isin(0, 1)))
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)).cast("int").alias("held")
    rows = docs.where(training).select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"), held)
    facts = cut(
        rows.select("doc_id", "lang", "held", F.octet_length("text").alias("bytes")).join(known, "doc_id")
        .groupBy("lang", "label", "held").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))
    sizes = facts.groupBy("label", "held").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()  # eight rows at most
    model = Classifier.fresh(settings)
    if len({r.label > 0 for r in sizes}) < 2:
        model.shift = -5.0
        model.out[:] = 0
        model.thresholds = {OTHER: 0.0}
        return model
    # too few rows to hold any back
    everything = len({r.label > 0 for r in sizes if r.held == 0}) < 2 or len({r.label > 0 for r in sizes if r.held}) < 2
    learned = [r for r in sizes if everything or r.held]
    learning = F.lit(True) if everything else F.col("held") != 0
    names = facts.where(learning & F.col("lang").isNotNull() & (F.col("lang") != OTHER)).groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.min_per_language)
    languages = {r.lang for r in names.collect()}  # one row for each language that has a tree
    n_shards = max(1, -(-sum(r.n for r in sizes) // settings.shard_rows), -(-sum(r.bytes or 0 for r in sizes) // settings.shard_bytes))

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS))
    taken = known.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63).cast("int"))).alias("mask"))
    marked = rows.withColumn("slot", slot).join(F.broadcast(taken), F.shiftright("slot", 6) == F.col("word"))  # bounded by the slots
    few = marked.where(F.bit_get("mask", F.col("slot").bitwiseAND(63).cast("int")) == 1).select("doc_id", "text", "lang", "held")
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(n_shards)).cast("int").alias("shard")
    shards, folder = _shards(few.join(known, "doc_id").select(shard, "label", "held", "text", "lang", "doc_id"), n_shards, settings)

    steps = model.begin(_holders(shards, everything, settings), sum(r.n for r in learned if r.label > 0) / sum(r.n for r in learned))
    for number in range(settings.epochs):
        _train_round(shards, model, steps, number, n_shards, everything)
    model.languages = _learn_languages(shards, languages, everything, settings)
    ids = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = tuple(ids[x] / sum(r.n for r in sizes if r.label == x) for x in (0, 1))
    model.thresholds = _thresholds(shards, model, everything, weights)
    remove(docs.sparkSession, folder)
    return model


def score_toxicity(
    docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from 0.5 on) of every whole text, the two under `names`.

    Nothing but the text enters a score. Null and empty texts get the score of a text without words. Rows
    are independent; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        scorer = Scorer(shared.value)

        def work(texts):
            scores = scorer.scores(texts)
            return scores, (scores >= 0.5).astype(np.int32)

        return work

    schema = T.StructType([T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return per_text(docs, worker, schema, keep, text_col)


def held_out_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Scores of all documents, learned from labelled rows outside fold 0 of 5."""
    held_out = fold(F.col("doc_id")) == 0
    found = score_toxicity(docs, fit_toxicity(docs, labels, ~held_out, settings))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
