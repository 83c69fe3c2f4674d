"""N-gram Jaccard join, size-aware: subsets of small sets, inverted lists of large ones.

Sets are distinct word shingles. Two sets of similarity t or more share a large part, so
- a small set (below the boundary) gives out the two-element subsets of a prefix, and meets others in a bucket
  of one subset;
- a large set, and a smaller one that may link with one, gives out the elements of a prefix, and meets others
  in the inverted list of one element.
The prefix is taken in one order for all sets: elements that many sets hold come last. Any order gives the same
links; a sketch of all elements, of fixed size, only says which lists would be long. The boundary has the least
cost, counted from the sizes of all sets.

Buckets and lists with one set only (nearly all) end there. Parity bitmaps, whose differing bits are a lower bound of
the difference of two sets, rule most other pairs out: a task grows the groups of a bucket from set to set, comparing
each with those that no group has yet, and gives out one edge for each set that joined. Groups that meet over all
buckets make a cluster; any two sets that link are in one. Each cluster's texts then come together once, in
blocks if they are large, and its sets are compared exactly where no link connects them so far. So no task gives out pairs:
edges are fewer than the rows that it reads.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.llm.common import chunks, cut, map_arrow, runs_of, text_bytes
from lakescribe.llm.components import components
from lakescribe.llm.shingles import mix, shingle_set

_SKETCH_BITS = 20
_BLOCKS = 64
_SEEN = 200_000
#: Sets of a bucket that one task compares with each other; larger buckets are dealt out in blocks.
_BLOCK_ROWS = 2_048
#: Elements of a cluster that make a block, about; a task holds two blocks.
_BLOCK_ELEMENTS = 1 << 20
_SMALL = 48
#: Sets whose texts are looked up by a broadcast of their ids, at most.
_BROADCAST_ROWS = 500_000


def set_id(elements: np.ndarray) -> int:
    """64-bit fingerprint of a set, signed. Two different sets of n share one with a chance of n*n/2^65."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n shares with any set it links with, at least."""
    return -(-n * percent // 100)


# --- sets and sketch ------------------------------------------------------------------------------


def set_table(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sid, bits) of every row, and the sketch: occurrences of elements by hash cell.

    One pass over the texts. Equal sets that a task meets again do not count twice in the sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, kind = np.zeros(1 << _SKETCH_BITS, np.int64), set(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = text_bytes(batch.column(1))
            for a, b in chunks(texts):
                n, sid, bits, fresh = [], [], [], []
                for text in texts[a:b]:
                    elements = shingle_set(text, width)
                    n.append(len(elements))
                    sid.append(set_id(elements))
                    bits.append(parity(elements))
                    if sid[-1] not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(sid[-1])
                        fresh.append(elements)
                if fresh:
                    cells += np.bincount((np.concatenate(fresh) >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64), minlength=len(cells))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.binary())],
                    names=["doc_id", "n", "sid", "bits", "cells"])
        if kind is not None:
            parts = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(cells, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(_BLOCKS, kind), pa.array(range(_BLOCKS), pa.int32()), pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.binary()), pa.array(parts, pa.binary())],
                names=["doc_id", "n", "sid", "bits", "cells"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(zlib.decompress(part), np.uint32)
                totals[block] = totals.get(block, 0) + cells.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["block", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    both = cut(map_arrow(own, run, f"doc_id {kind}, n int, sid bigint, bits binary, cells binary"))
    parts = both.where(F.col("cells").isNotNull()).select(F.col("n").alias("block"), "cells").repartition(_BLOCKS, "block")
    sketch = np.zeros(1 << _SKETCH_BITS, np.int64)
    size = len(sketch) // _BLOCKS
    for row in map_arrow(parts, summed, "block int, cells binary").collect():  # 64 rows of fixed size
        sketch[row.block * size : (row.block + 1) * size] += np.frombuffer(row.cells, np.int64)
    return both.where(F.col("cells").isNull()).select("doc_id", "n", "sid", "bits"), sketch


def boundary(sizes: dict[int, int], lists: float, percent: int) -> int:
    """Sets below this size give out subsets. sizes: number of sets by size (small ones exactly, all larger
    ones under any larger size); lists: sets that a prefix element leads to on average.

    An element of a prefix costs its row and the sets in its list, a subset only its row.
    """

    def cost(x: int) -> float:
        total = 0.0
        for n, k in sizes.items():
            single = n - least_overlap(n, percent) + 1
            if 3 <= n < x:
                total += k * (single + 1) * single / 2
            if n >= 3 and 100 * n >= percent * x:
                total += k * single * (1 + lists)
        return total

    return min([0, *range(4, _SMALL + 1)], key=cost)


def excess(sketch: np.ndarray) -> np.ndarray:
    """By how much a cell holds more than chance puts there (four deviations over the mean); 0 for most."""
    mean = sketch.mean()
    return np.maximum(0, sketch - (mean + 4 * np.sqrt(mean) + 4)).astype(np.int64)


def signatures(elements: np.ndarray, crowd: np.ndarray, x: int, percent: int) -> np.ndarray:
    """Buckets of a set: fingerprints of prefix elements, and of two-element subsets if it is small."""
    n = len(elements)
    if n < 3:  # links with equal sets only
        return np.empty(0, np.int64)
    order = elements[np.argsort(crowd[(elements >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)], kind="stable")]
    single, found = n - least_overlap(n, percent) + 1, []
    if 100 * n >= percent * x:
        found.append(order[:single])
    if n < x:
        prefix = mix(order[: single + 1])
        a, b = np.triu_indices(len(prefix), 1)
        low, high = np.minimum(prefix[a], prefix[b]), np.maximum(prefix[a], prefix[b])
        found.append(mix(low * np.uint64(3) + high))
    return np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)


def shared_buckets(docs: DataFrame, sketch: np.ndarray, x: int, width: int, percent: int) -> DataFrame:
    """(bucket, sid, pivot) of the buckets that two different sets or more are in; pivot is one of them."""
    crowd = docs.sparkSession.sparkContext.broadcast(excess(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in chunks(texts, 1 << 20):
                buckets, ids = [], []
                for text in texts[a:b]:
                    elements = shingle_set(text, width)
                    sid = set_id(elements)
                    if sid in seen:  # a copy: the set is given out once
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(sid)
                    own = signatures(elements, crowd.value, x, percent)
                    buckets.append(own)
                    ids.append(np.full(len(own), sid, np.int64))
                if buckets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(ids))], names=["bucket", "sid"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows; a bucket may go on in the next batch, of which only its first set and state are held."""
        last_bucket = last_sid = None
        pivot, open_ = 0, False  # of the last bucket: its first set, and whether it has a second one
        for batch in batches:
            bucket, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(bucket):
                continue
            fresh = np.r_[last_bucket is None or bucket[0] != last_bucket, bucket[1:] != bucket[:-1]]
            again = np.r_[last_sid is not None and not fresh[0] and sid[0] == last_sid, (sid[1:] == sid[:-1]) & ~fresh[1:]]
            bucket, sid, fresh = bucket[~again], sid[~again], fresh[~again]
            if not len(bucket):
                continue
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(sid)), -1))
            lead = np.where(first >= 0, sid[np.maximum(first, 0)], pivot)
            second = ~fresh  # every row but its bucket's first is kept; the first comes with the second
            starts = np.flatnonzero(fresh)
            paired = starts[np.r_[~fresh, False][starts + 1]]
            keep = second.copy()
            keep[paired] = True
            out_bucket, out_sid, out_pivot = bucket[keep], sid[keep], lead[keep]
            if second[0] and not open_ and last_bucket is not None and bucket[0] == last_bucket:
                out_bucket, out_sid, out_pivot = np.r_[bucket[0], out_bucket], np.r_[pivot, out_sid], np.r_[pivot, out_pivot]
            open_ = bool(second[-1]) or (len(second) == 1 and second[0])
            last_bucket, last_sid, pivot = bucket[-1], sid[-1], int(lead[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket), pa.array(out_sid), pa.array(out_pivot.astype(np.int64))], names=["bucket", "sid", "pivot"])

    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("text").cast("string").alias("text"))
    rows = map_arrow(own, run, "bucket bigint, sid bigint")
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "sid")
    return map_arrow(ordered, shared, "bucket bigint, sid bigint, pivot bigint")


# --- comparison -----------------------------------------------------------------------------------


def parity(elements: np.ndarray) -> bytes:
    """Bitmap of 2 to 4 bits for each element (fewer for very large sets): the parity of the elements at each place.

    One element more or less changes one bit, so two sets differ in at least as many elements as bits.
    """
    bits = 1 << min(max((len(elements) - 1).bit_length() + 1, 6), 16)
    held = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) brought down to a shorter size."""
    while bitmaps.shape[1] > size:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def may_link(bits: int, both: int, percent: int) -> bool:
    """Whether sets of `both` elements together, differing in `bits` at least, may reach the similarity."""
    return (100 + percent) * bits <= (100 - percent) * both


class Bitmaps:
    """The bitmaps of sets in the order of their sizes; a larger set's bitmap is as long or longer."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.percent = n, percent
        length = np.array([len(x) for x in bits])
        self.starts, self.ends = np.searchsorted(n, -(-n * percent // 100), "left"), np.searchsorted(n, 100 * n // percent, "right")
        self.groups = []  # (first, end, bitmaps, the same folded to half their length)
        for size in np.unique(length):
            first, end = np.searchsorted(length, [size, size + 1])
            rows = np.frombuffer(b"".join(bits[first:end]), np.uint8).reshape(end - first, size)
            half = folded(rows, size // 2).copy().view(np.uint64) if size > 8 else None
            self.groups.append((first, end, rows.copy().view(np.uint64), half))

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of the sets marked in `among` that may link with set i."""
        a, b = self.starts[i], self.ends[i]
        found = []
        own = next(k for k, (first, end, _, _) in enumerate(self.groups) if first <= i < end)
        first, _, mine, halved = self.groups[own]
        for k in range(max(own - 1, 0), min(own + 2, len(self.groups))):
            low, high, rows, half = self.groups[k]
            at = np.flatnonzero(among[max(a, low) : min(b, high)]) + max(a, low)
            if not len(at):
                continue
            width = rows.shape[1]
            if width == mine.shape[1]:
                differ = rows[at - low] ^ mine[i - first]
            elif width == 2 * mine.shape[1]:
                differ = half[at - low] ^ mine[i - first]
            elif 2 * width == mine.shape[1]:
                differ = rows[at - low] ^ halved[i - first]
            else:  # lengths further apart belong to sizes too far apart
                continue
            odd = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            found.append(at[(100 + self.percent) * odd <= (100 - self.percent) * (self.n[at] + self.n[i])])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def grown(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """For each set the first of its group: sets that pairs which may link connect. Sets in the order of their sizes."""
    maps, free, leader = Bitmaps(n, bits, percent), np.ones(len(n), bool), np.arange(len(n))
    for i in range(len(n)):
        if not free[i]:
            continue
        free[i], waiting = False, [i]
        while waiting:
            found = maps.near(waiting.pop(), free)
            free[found], leader[found] = False, i
            waiting += found.tolist()
    return leader


def may_meet(n: tuple[int, int], bits: tuple[bytes, bytes], percent: int) -> bool:
    """grown() of two sets, the smaller first."""
    if 100 * n[0] < percent * n[1]:
        return False
    x, y = (np.frombuffer(b, np.uint8)[None] for b in bits)
    if x.shape[1] == y.shape[1]:
        odd = (int.from_bytes(bits[0]) ^ int.from_bytes(bits[1])).bit_count()
    else:
        odd = int(np.bitwise_count(folded(y, x.shape[1]) ^ x).sum())
    return may_link(odd, n[0] + n[1], percent)


def bucket_edges(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): in each bucket, or pair of its blocks, one edge for each set that others may link with.

    rows: (bucket, part_a, part_b, n, sid, bits); a task holds two blocks of one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for batch, starts in whole_groups(batches, 3):
            n, sid, bits = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_pylist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a == 2:
                    if may_meet((int(n[a]), int(n[a + 1])), (bits[a], bits[a + 1]), percent):
                        u.append(sid[a : a + 1])
                        v.append(sid[a + 1 : a + 2])
                elif b - a > 2:
                    lead = grown(n[a:b].astype(np.int64), bits[a:b], percent)
                    joined = np.flatnonzero(lead != np.arange(b - a))
                    u.append(sid[a:b][lead[joined]])
                    v.append(sid[a:b][joined])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
                u, v = [], []

    ordered = rows.repartition("bucket", "part_a", "part_b").sortWithinPartitions("bucket", "part_a", "part_b", "n", "sid")
    return map_arrow(ordered, run, "u bigint, v bigint").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that begin and end with a group of equal keys (integers), with the starts of their groups and the end."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole, np.r_[0, fresh_rows(whole), whole.num_rows]

    def fresh_rows(batch: pa.RecordBatch) -> np.ndarray:
        key = np.array([batch.column(i).to_numpy() for i in range(keys)])
        return np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = fresh_rows(batch)
        if held and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield joined()
            held = []
        if len(cuts):
            held.append(batch.slice(0, cuts[-1]))
            yield joined()
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield joined()


def open_buckets(shared: DataFrame) -> DataFrame:
    """(bucket, part_a, part_b, sid) of the buckets; of those with the same sets one is kept.

    A bucket of many sets is dealt out: each block of it meets each other in a task of its own.
    """
    facts = shared.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.xxhash64(F.lit(1), "sid").cast("decimal(20,0)")).alias("s"))
    chosen = facts.groupBy("m", "x", "s").agg(F.min("bucket").alias("bucket"))
    dealt = shared.join(chosen.select("bucket", F.ceil(F.col("m") / _BLOCK_ROWS).cast("int").alias("parts")), "bucket")
    return _dealt(dealt.select("bucket", "sid", "parts"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with `sid` and `parts`, once for each pair (part_a, part_b) of blocks that theirs (part) is one of."""
    part = rows.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least(k, F.col("part")).alias("part_a"), F.greatest(k, F.col("part")).alias("part_b"))))
    return part.withColumn("meet", meets).select("*", "meet.part_a", "meet.part_b").drop("meet", "parts")


def block_links(sets: list[np.ndarray], part: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs that link, one for each set that joins another: pairs that links connect already are not compared."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    maps = Bitmaps(np.array([len(sets[i]) for i in order]), [parity(sets[i]) for i in order], percent)
    parent, found, later = list(range(len(sets))), [], np.ones(len(sets), bool)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(order)):
        later[i] = False
        a = sets[order[i]]
        for j in maps.near(i, later).tolist():
            if across and part[order[i]] == part[order[j]]:
                continue
            x, y = root(i), root(j)
            if x == y:
                continue
            b = sets[order[j]]
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[y] = x
                found.append((order[i], order[j]))
    return found


def links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): ids of sets that link, enough to connect what links connect.

    rows: (cluster, part_a, part_b, part, sid, rep, text); a task holds the sets of two blocks of one cluster.
    """
    kind = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), group in runs_of(batches, 3):
            sid = group.column(4).to_numpy()
            group = group.filter(pa.array(np.r_[True, sid[1:] != sid[:-1]]))  # repeated rows of several tasks
            part, rep = group.column(3).to_numpy(), group.column(5)
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in group.column(6)]
            found = block_links(sets, part, a != b, percent)
            if found:
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(x)).combine_chunks() for x in zip(*found, strict=True)], names=["u", "v"])

    ordered = rows.repartition("cluster", "part_a", "part_b").sortWithinPartitions("cluster", "part_a", "part_b", "sid")
    return map_arrow(ordered.select("cluster", "part_a", "part_b", "part", "sid", "rep", "text"), run, f"u {kind}, v {kind}")


# --- the join -------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    n_shingles is the size of its set: distinct shingles of `width` words, A-Z in lower case; with fewer words
    the whole sequence. Documents link when 100 * intersection >= percent * union; component_id is the least
    doc_id that links reach. Null and empty texts have an empty set and link with nothing. Rows with the same
    id are one document; a row without id has its set's size, links with nothing and has a null component. Other
    columns are ignored. percent: 67 to 99.
    """
    if not 67 <= percent < 100:
        raise ValueError("percent must be 67 to 99: below, sets of two or three shingles may link without sharing a bucket")
    sets, sketch = set_table(docs, width)
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    reps = cut(full.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    sizes = {int(r.k): r.sets for r in reps.groupBy(F.least("n", F.lit(2 * _SMALL)).alias("k")).agg(F.count(F.lit(1)).alias("sets")).collect()}
    total = max(int(sketch.sum()), 1)
    lists = max(0.0, float((sketch * (sketch - 1)).sum()) / total - total / len(sketch))
    shared = cut(shared_buckets(docs, sketch, boundary(sizes, lists, percent), width, percent).select("bucket", "sid"))
    meeting = open_buckets(shared).join(reps.select("sid", "n", "bits"), "sid").select("bucket", "part_a", "part_b", "n", "sid", "bits")
    clusters = components(bucket_edges(meeting, percent)).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    found = links(_cluster_texts(clusters, reps, docs, width), width, percent)
    # rows of one id join its sets
    several = full.groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low != high").select("doc_id")
    bridges = full.join(several, "doc_id", "left_semi").join(reps.select("sid", "rep"), "sid").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    final = components(found.unionByName(bridges))
    named = cut(reps.join(final, F.col("rep") == F.col("node"), "left").select("sid", F.coalesce("component", "rep").alias("component_id")))
    return sets.join(named, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def _cluster_texts(clusters: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cluster, part_a, part_b, part, sid, rep, text) of the sets in clusters, a cluster dealt out by its elements."""

    def run(batches):
        seen = set()
        for batch in batches:  # an id with several texts: only those that have the set; a repeated row once
            keep = []
            for sid, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(4)), strict=True):
                keep.append(sid not in seen and set_id(shingle_set(text, width)) == sid)
                if keep[-1]:
                    seen.add(sid)
            yield batch.filter(pa.array(keep, pa.bool_()))

    members = clusters.join(reps.select("sid", "rep", "n"), "sid")
    parts = members.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / _BLOCK_ELEMENTS)).cast("int").alias("parts"))
    names = cut(members.join(parts, "cluster").select("sid", "cluster", "parts", "rep"))
    if names.count() <= _BROADCAST_ROWS:  # checked size; beyond it the texts are shuffled to the names
        names = F.broadcast(names)
    own = docs.select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text"))
    kind = own.schema["rep"].dataType.simpleString()
    texts = map_arrow(own.join(names, "rep").select("sid", "cluster", "parts", "rep", "text"), run, f"sid bigint, cluster bigint, parts int, rep {kind}, text string")
    return _dealt(texts)


def one_of_equal(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, of those equal in the columns (nulls are equal) only that with the least hash of all columns.

    Only rows that occur again are shuffled.
    """
    names = rows.columns
    values = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (F.col(f"`{c}`").cast("string") for c in columns)]
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(F.concat(*values), 256).alias("key"))
    again = cut(marked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if again.isEmpty():
        return rows
    chosen = marked.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in names])).alias("row")).select("row")
    return marked.join(again, "key", "left_anti").select("row").unionByName(chosen).select(*[F.col("row")[c].alias(c) for c in names])


def drop_near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """The documents, with all their columns, less those whose component has a smaller id.

    Of rows equal in doc_id and text (nulls are equal) one stays, that with the least hash of all its columns; this holds
    for rows without id as well, which nothing else takes out.
    """
    found = jaccard_components(docs.select("doc_id", "text"), percent, width)
    copies = found.where("component_id != doc_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return one_of_equal(kept, ["doc_id", "text"])


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, y AS r FROM ways UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.r),
least_of AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, r), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
