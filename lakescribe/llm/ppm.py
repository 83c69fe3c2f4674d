"""Prediction by partial matching over bytes: counts from Spark, frozen statistics, many texts at once.

A context is what stands up to `order` bytes in front of a symbol; texts are padded in front, and end with a
symbol of their own (byte 0xFF, which UTF-8 never holds, serves as both). Every position of the corpus is
counted, and `window_logs` scores windows with every context that the corpus has, as a distributed table. A
`ContextTree` of `trees` has every context of its label's texts as well, in the memory of a task, and so no more than
two bytes of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.llm.common import chunks, cut, map_arrow, text_bytes

END = 0xFF
_PART_BYTES = 2 << 20  # windows are sorted in pieces that stay in the processor's cache
_FLUSH = 1_500_000
_LANE = 256


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each with `order` bytes of padding in front and END behind; starts of the texts."""
    pad = bytes([END]) * order
    joined = b"".join([x for text in texts for x in (pad, text, pad[:1])]) if order else b""
    sizes = np.array([len(x) + order + 1 for x in texts], np.int64)
    return np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes + order


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows of order + 1 bytes (as integers, the symbol lowest) and how often they occur."""
    return run_lengths(np.sort(window_keys(texts, order)[0]))


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys and the sums of their counts."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.r_[first, len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    return run_lengths(keys[order], np.concatenate([n for _, n in parts])[order])


def window_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts in their order, and how many each text has (its bytes and its end)."""
    data, starts = padded(texts, order)
    valid = np.ones(len(data), bool)
    for j in range(order):
        valid[starts - order + j] = False
    keys = np.zeros(len(data), np.uint64)
    for j in range(order + 1):
        keys[order:] |= data[j : len(data) - order + j].astype(np.uint64) << np.uint64(8 * (order - j))
    return keys[valid], np.array([len(x) + 1 for x in texts], np.int64)


def window_counts(texts: DataFrame, order: int) -> DataFrame:
    """(label, key, n) of all windows of order + 1 bytes in a frame (label string, text string)."""
    return window_parts(texts, order).groupBy("label", "key").agg(F.sum("n").alias("n"))


def window_parts(texts: DataFrame, order: int) -> DataFrame:
    """Rows (label, key, n) whose sums are the window counts.

    Tasks count before the shuffle; what they hold is bounded, and given out when it grows beyond that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for label, parts in held.items():
                keys, n = merged(parts)
                for i in range(0, len(keys), 100_000):
                    k = keys[i : i + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(k), pa.string()), pa.array(k), pa.array(n[i : i + 100_000].astype(np.int64))], names=["label", "key", "n"])
            held.clear()

        for batch in batches:
            by_label: dict[str, list[bytes]] = {}
            for label, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                by_label.setdefault(label, []).append(text.lower())
            for label, own in by_label.items():
                for a, b in chunks(own, _PART_BYTES):
                    held.setdefault(label, []).append(windows(own[a:b], order))
                held[label] = [merged(held[label])]
            if sum(len(k) for parts in held.values() for k, _ in parts) > _FLUSH:
                yield from given()
        yield from given()

    return map_arrow(texts, run, "label string, key bigint, n bigint")


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    place = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return place, table[place] == keys if len(table) else np.zeros(len(keys), bool)


class _Level:
    """Contexts of one length: windows with counts, and of each context the sum of its counts and its symbols.

    rest_total and rest_distinct are those of the context one byte shorter without the symbols seen here.
    """

    def __init__(self, windows: np.ndarray, counts: np.ndarray, size: int, below: _Level | None) -> None:
        self.windows, self.counts = windows, counts
        self.contexts, self.total = run_lengths(windows >> np.uint64(8), counts)
        self.distinct = run_lengths(windows >> np.uint64(8))[1]
        if below is not None:
            shorter = _at(below.windows, windows & np.uint64((1 << 8 * size) - 1))[0]
            seen = run_lengths(windows >> np.uint64(8), below.counts[shorter])[1]
            place = _at(below.contexts, self.contexts & np.uint64((1 << 8 * (size - 1)) - 1))[0]
            self.rest_total, self.rest_distinct = below.total[place] - seen, below.distinct[place] - self.distinct


def window_probabilities(keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """Base-10 log probability of the last byte of each window, as under a tree of all contexts.

    keys holds, with count n, all training windows that share their contexts of `group_bytes` with any of
    them; a window with n 0 is not of the training. low holds the training windows of group_bytes bytes, all.
    """
    group = group_bytes(order)
    levels: list[_Level] = []
    seen = n > 0
    known, times = keys[seen], n[seen]
    for d in range(order + 1):
        part, count = (low if d < group else (known, times))
        part = part & np.uint64((1 << 8 * (d + 1)) - 1)
        by = np.argsort(part, kind="stable")
        levels.append(_Level(*run_lengths(part[by], count[by]), d, levels[-1] if d else None))
    out, left = np.zeros(len(keys)), np.ones(len(keys))
    open_, longer = np.arange(len(keys)), np.full(len(keys), -1, np.int64)  # windows without a probability, and their context last seen
    for d in range(order, -1, -1):
        level, own = levels[d], keys[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
        context, there = _at(level.contexts, own >> np.uint64(8))
        if not there.any():
            continue
        total, distinct = level.total[context], level.distinct[context].copy()
        before = longer[open_]
        if d < order and len(levels[d + 1].contexts):
            up = levels[d + 1]
            total = np.where(before >= 0, up.rest_total[before], total)
            distinct = np.where(before >= 0, up.rest_distinct[before], distinct)
        distinct = np.where(level.distinct[context] == 256, 0, distinct)  # nothing is left to escape to
        window, hit = _at(level.windows, own)
        live = there & (total > 0)
        whole = np.where(live, total + distinct, 1)
        hit &= live
        out[open_[hit]] = left[open_[hit]] * level.counts[window[hit]] / whole[hit]
        left[open_] *= np.where(live, distinct / whole, 1.0)
        longer[open_] = np.where(there, context, -1)
        open_ = open_[~hit]
    if len(open_):
        context, there = _at(levels[0].contexts, np.zeros(1, np.uint64))
        out[open_] = left[open_] / max(256 - (int(levels[0].distinct[context[0]]) if there[0] else 0), 1)
    return np.log10(out)


def group_bytes(order: int) -> int:
    """Length of the contexts by which windows are dealt; all longer contexts of a window share its group."""
    return min(2, order)


def window_logs(counts: DataFrame, order: int) -> DataFrame:
    """(key, n, logp) from (key, n, trained): windows of order + 1 bytes with all counts and those of the training.

    Windows are dealt by the last bytes of their context, so that a task has all contexts that can stand in for
    another. Counts of the shorter contexts, 65,536 at most, go to all tasks.
    """
    if not 0 < order <= 5:
        raise ValueError("windows are packed in 48 bits: order 1 to 5")
    group = group_bytes(order)
    rows = counts.where("trained > 0").groupBy(F.col("key").bitwiseAND((1 << 8 * group) - 1).alias("low")).agg(F.sum("trained").alias("n")).toArrow()
    keys, n = rows.column("low").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)
    by = np.argsort(keys)
    shared = counts.sparkSession.sparkContext.broadcast((keys[by], n[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def given(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            logs = window_probabilities(rows[0].astype(np.uint64), rows[2], shared.value, order)
            for i in range(0, len(logs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (rows[0], rows[1], logs)], names=["key", "n", "logp"])

        waiting, limit = 0, _FLUSH
        for batch in batches:
            held.append(np.array([batch.column(i).to_numpy() for i in range(1, 4)], np.int64))
            waiting += batch.num_rows
            if waiting >= limit:
                rows = np.concatenate(held, axis=1)
                groups = rows[0] >> 8 & ((1 << 8 * group) - 1)
                end = int(np.argmax(groups == groups[-1]))  # the last group may go on
                if end:
                    yield from given(rows[:, :end])
                held = [rows[:, end:].copy()]
                waiting = len(groups) - end
                limit = max(_FLUSH, 2 * waiting)
        if held:
            yield from given(np.concatenate(held, axis=1))

    suffix = F.shiftright("key", 8).bitwiseAND((1 << 8 * group) - 1).alias("suffix")
    dealt = counts.select(suffix, "key", "n", "trained").repartition("suffix").sortWithinPartitions("suffix")
    return map_arrow(dealt, run, "key bigint, n bigint, logp double")


class WindowTable:
    """Values of some windows, found many at a time: a chain of hash tables, each with the keys that met another before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, self.tables = keys.astype(np.uint64), []
        while len(keys):
            bits = max(4, (2 * len(keys)).bit_length())
            slot = self._slot(keys, bits, len(self.tables))
            table, value = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits)
            table[slot] = keys
            won = table[slot] == keys
            value[slot[won]] = values[won]
            self.tables.append((bits, table, value))
            keys, values = keys[~won], values[~won]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, number: int) -> np.ndarray:
        mixed = (keys + np.uint64(number)) * np.uint64((0x9E3779B97F4A7C15 + 0xD1B54A32D192ED02 * number) % 2**64 | 1)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, 0 where it has none, and the places of those."""
        out, left = np.zeros(len(keys)), None
        for number, (bits, table, value) in enumerate(self.tables):
            own = keys if left is None else keys[left]
            slot = self._slot(own, bits, number)
            hit = table[slot] == own
            if left is None:
                out = np.where(hit, value[slot], 0.0)
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = value[slot[hit]]
                left = left[~hit]
            if not len(left):
                break
        return out, np.arange(len(keys)) if left is None else left


class ContextTree:
    """Frozen statistics as an automaton: a state is a context, with the log probability of each symbol.

    `next` and `logp` have a row for each state and a column for each byte. Probabilities are exact: method C
    escapes, and symbols that a longer context has seen are excluded from the shorter one.
    """

    def __init__(self, order: int, depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> None:
        if not 0 < order <= 5:
            raise ValueError("contexts are packed in 40 bits: order 1 to 5")
        self.order = order
        pair = (depth.astype(np.int64) << 40) | context.astype(np.int64)
        states, row = np.unique(pair, return_inverse=True) if len(pair) else (np.zeros(1, np.int64), np.empty(0, np.int64))
        level, key = states >> 40, states & ((1 << 40) - 1)
        count = np.zeros((len(states), 256))
        np.add.at(count, (row, symbol.astype(np.int64)), n.astype(np.float64))
        suffix = np.zeros(len(states), np.int64)
        deeper = level > 0
        shorter = ((level[deeper] - 1) << 40) | (key[deeper] & ((np.int64(1) << (8 * (level[deeper] - 1))) - 1))
        suffix[deeper] = np.searchsorted(states, shorter)
        self.next = np.zeros((len(states), 256), np.int32)
        for d in range(order + 1):
            own = np.flatnonzero(level == d)
            if d:
                self.next[own] = self.next[suffix[own]]
            longer = np.flatnonzero(level == d + 1)
            front = np.searchsorted(states, (np.int64(d) << 40) | (key[longer] >> 8))
            self.next[front, key[longer] & 255] = longer
        self.logp = np.empty((len(states), 256), np.float32)
        for i in range(0, len(states), 1024):
            self.logp[i : i + 1024] = np.log10(self._probabilities(np.arange(i, min(i + 1024, len(states))), level, suffix, count))
        state = 0
        for _ in range(order):
            state = self.next[state, END]
        self.start = int(state)

    def _probabilities(self, state: np.ndarray, level: np.ndarray, suffix: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros((len(state), 256))
        seen = np.zeros((len(state), 256), bool)
        left = np.ones(len(state))
        depth = level[state]
        for d in range(self.order, -1, -1):
            on = np.flatnonzero(depth >= d)
            c = np.where(seen[on], 0.0, count[state[on]])
            fresh = c > 0
            total, distinct = c.sum(1), fresh.sum(1)
            distinct = np.where((seen[on] | fresh).all(1), 0, distinct)  # nothing is left to escape to
            whole = np.where(total > 0, total + distinct, 1.0)
            out[on] += c * (left[on] / whole)[:, None]
            left[on] *= np.where(total > 0, distinct / whole, 1.0)
            seen[on] |= fresh
            state = state.copy()
            state[on] = suffix[state[on]]
        rest = (~seen).sum(1)
        return np.where(seen, out, (left / np.maximum(rest, 1))[:, None])

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Base-10 log probability of each text, its end included.

        Long texts are cut into lanes that run side by side. A state depends on no more than `order` bytes, so
        a lane that reads those first gives the same numbers as one walk over the text.
        """
        data, starts = padded(texts, self.order)
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        lanes = -(-sizes // _LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * _LANE
        length = np.minimum(_LANE, sizes[owner] - offset)
        order = np.argsort(-length, kind="stable")
        position = (starts[owner] + offset - self.order)[order]
        length, total = length[order], np.zeros(len(owner))
        state, follow, logp = np.zeros(len(owner), np.int32), self.next.ravel(), self.logp.ravel()
        for _ in range(self.order):
            state = follow[(state << 8) + data[position]]
            position += 1
        live = np.searchsorted(-length, -np.arange(_LANE), side="left")  # lanes that are longer than each step
        for step in range(int(length[0]) if len(length) else 0):
            k = live[step]
            at = (state[:k] << 8) + data[position[:k] + step]
            total[:k] += logp[at]
            state[:k] = follow[at]
        return np.bincount(owner[order], weights=total, minlength=len(texts))


def tree_of_windows(keys: np.ndarray, n: np.ndarray, order: int) -> ContextTree:
    """The tree with every context of all windows of order + 1 bytes."""
    keys, found = keys.astype(np.uint64), []
    for d in range(order + 1):
        part, count = merged([(keys & np.uint64((1 << 8 * (d + 1)) - 1), n)])
        found.append((np.full(len(part), d), part.astype(np.int64) >> 8, part.astype(np.int64) & 255, count))
    return ContextTree(order, *[np.concatenate(x) for x in zip(*found, strict=True)])


def trees(counts: DataFrame, order: int) -> DataFrame:
    """(label, size, model): the pickled tree of each label from its window counts (label, key, n).

    A task holds the windows of one label, 256^(order + 1) at most; so for orders up to 2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def given() -> pa.RecordBatch:
            model = pickle.dumps(tree_of_windows(*[np.concatenate(x) for x in zip(*held, strict=True)], order))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([len(model)], pa.int64()), pa.array([model], pa.binary())], names=["label", "size", "model"])

        for batch in batches:
            label = batch.column(0).dictionary_encode()
            place = label.indices.to_numpy()
            starts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                name = label.dictionary[int(place[a])].as_py()
                if held and name != last:
                    yield given()
                last = name
                held.append((batch.column(1).to_numpy()[a:b], batch.column(2).to_numpy()[a:b]))
        if held:
            yield given()

    if not 0 < order <= 2:
        raise ValueError("trees are of order 1 or 2: their size is bounded")
    return map_arrow(counts.repartition("label").sortWithinPartitions("label").select("label", "key", "n"), run, "label string, size bigint, model binary")


def labelled(docs: DataFrame, label: Column, text_col: str = "text") -> DataFrame:
    return docs.select(label.cast("string").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text"))
