"""Scores of texts: word unigrams as the base, and prediction by partial matching over bytes."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.llm import ppm
from lakescribe.llm.common import chunks, cut, fold, map_arrow, per_text, text_bytes

#: Most words and windows whose counts go to all executors; the others are joined.
FREQUENT_WORDS = 131_072
FREQUENT_WINDOWS = 1_048_576
_LONGEST = 64
_FLUSH = 300_000
_PART_BYTES = 1 << 20


def word_key(word: bytes) -> bytes:
    """The word, or beyond 64 bytes its SHA-256 behind a byte that no word holds."""
    return word if len(word) <= _LONGEST else b"\xff" + hashlib.sha256(word).digest()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all words, A-Z in lower case, of a frame with a text column; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def given():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                words = text.lower().split()
                held.update(words if len(text) <= _LONGEST or max(map(len, words), default=0) <= _LONGEST else map(word_key, words))
                if len(held) > _FLUSH:
                    yield given()
                    held.clear()
        if held:
            yield given()

    return map_arrow(texts.select(F.col("text").cast("string")), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _step() -> Column:
    return F.floor(F.log2("n") * 8)


def lowest_step(counts: DataFrame, most: int) -> int | None:
    """The least step of counts (an eighth of a power of two) from which on there are `most` rows at most."""
    bins = {r.step: r.rows for r in counts.groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("rows")).toLocalIterator()}
    held, lowest = 0, None
    for x in sorted(bins, reverse=True):
        held += bins[x]
        if held > most:
            break
        lowest = x
    return lowest


def frequent_words(counts: DataFrame, most: int = FREQUENT_WORDS) -> tuple[dict[bytes, int], int]:
    """All words with at least some count, chosen so that there are `most` at most; and that count.

    The choice comes from a histogram of the counts in steps of an eighth of a power of two.
    """
    lowest = lowest_step(counts, most)
    if lowest is None:
        return {}, 0
    rows = counts.where(_step() >= lowest).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True)), lowest


def window_scores(own: DataFrame, training: Column, order: int, most: int) -> tuple[ppm.WindowTable, DataFrame]:
    """Frequent windows with their log probabilities, and (key, logp) of all others, over all texts."""
    parts = ppm.window_parts(ppm.labelled(own, F.when(training, "t").otherwise("")), order)
    counts = cut(parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == "t", F.col("n")).otherwise(0)).alias("trained")))
    logs = cut(ppm.window_logs(counts, order))
    lowest = lowest_step(logs, most)
    if lowest is None:
        return ppm.WindowTable(np.empty(0, np.uint64), np.empty(0)), logs.select("key", "logp")
    rows = logs.where(_step() >= lowest).select("key", "logp").toArrow()
    table = ppm.WindowTable(rows.column("key").to_numpy(), rows.column("logp").to_numpy())
    return table, logs.where(_step() < lowest).select("key", "logp")


_SCHEMA = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("frequent_known", T.LongType()), T.StructField("frequent_sum", T.DoubleType()),
    T.StructField("window_sum", T.DoubleType()), T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
])


def lm_scores(docs: DataFrame, order: int = 5, frequent: int = FREQUENT_WORDS, frequent_windows: int = FREQUENT_WINDOWS) -> DataFrame:
    """Base and model scores of every whole text, learned from the documents outside fold 1 of 5.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (word unigrams, add-half smoothing)
    and score: the log10 probability of the text, A-Z in lower case, and its end, under a byte context tree
    of frozen counts with every context of the training texts. Null and empty texts have one token, the end. Equal rows give equal results. With no
    training rows base_score is 0 and score that of equally likely bytes. Other columns are ignored.

    Frequent words and windows, of bounded number, are looked up in place. The others are joined with their
    counts or probabilities; they are rare by choice, so that no key of the join is hot.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    held_out = fold(F.col("doc_id")) == 1
    training = own.where(~held_out)
    table, rare_windows = window_scores(own, ~held_out, order, frequent_windows)
    counts = cut(word_counts(training))
    ends = training.count()
    words = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    n_all, n_distinct = words.n + ends, words.v + (ends > 0)
    floor = n_all + 0.5 * (n_distinct + 1)
    best, lowest = frequent_words(counts, frequent)
    logs = {w: math.log10((c + 0.5) / floor) for w, c in best.items()}
    shared, shared_table = spark.sparkContext.broadcast(logs), spark.sparkContext.broadcast(table)
    end_log = math.log10((ends + 0.5) / floor)

    def worker():
        known, model = shared.value, shared_table.value

        def work(texts):
            rows = []
            get = known.get
            for text in texts:
                split = text.lower().split()
                if len(text) > _LONGEST and max(map(len, split), default=0) > _LONGEST:
                    split = [*map(word_key, split)]
                values = [x for x in map(get, split) if x is not None]
                rows.append((len(split) + 1, len(values) + (ends > 0), math.fsum(values) + end_log))
            sums, rare, times = [], [], []
            for a, b in chunks(texts, _PART_BYTES):
                keys, sizes = ppm.window_keys([x.lower() for x in texts[a:b]], order)
                values, missed = model.find(keys)
                owner = np.repeat(np.arange(b - a), sizes)
                sums.append(np.bincount(owner, weights=values, minlength=b - a))
                ends_of = np.searchsorted(owner[missed], np.arange(1, b - a))
                for own_keys in np.split(keys[missed].astype(np.int64), ends_of):
                    found, count = np.unique(own_keys, return_counts=True)
                    rare.append(found)
                    times.append(count)
            return [*zip(*rows, strict=True), np.concatenate(sums), rare, times]

        return work

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, mark, word, n, first) of the words that are not frequent; `first` counts equal rows."""
        known = shared.value
        for batch in batches:
            took, word, n, first = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(2))):
                found = Counter(map(word_key, [w for w in text.lower().split() if w not in known]))
                found = {w: k for w, k in found.items() if w not in known}
                took += [i] * len(found)
                word += found.keys()
                n += found.values()
                first += [1, *[0] * (len(found) - 1)] if found else []
            at = pa.array(took, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.int32())],
                names=["doc_id", "mark", "word", "n", "first"])

    mark = F.xxhash64("text").alias("mark")
    kind = own.schema["doc_id"].dataType.simpleString()
    others = map_arrow(own.select("doc_id", mark, "text"), rare, f"doc_id {kind}, mark bigint, word binary, n bigint, first int")
    fewer = counts.where(F.floor(F.log2("n") * 8) < lowest) if best else counts
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor))
    sums = (
        others.join(fewer.withColumnRenamed("n", "c"), "word", "left")
        .groupBy("doc_id", "mark").agg(
            (F.sum(F.col("n") * log) / F.sum("first")).alias("rare_sum"),
            (F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)) / F.sum("first")).cast("long").alias("rare_known"))
        .withColumnsRenamed({"doc_id": "rare_id", "mark": "rare_mark"})
    )
    scored = cut(per_text(own.select("doc_id", mark, "text"), worker, _SCHEMA, keep=("doc_id", "mark")))
    opened = scored.where(F.size("windows") > 0).select(
        "doc_id", "mark", F.posexplode(F.arrays_zip("windows", "times")).alias("pos", "w")).select(
        "doc_id", "mark", F.col("w.windows").alias("key"), F.col("w.times").alias("n"), (F.col("pos") == 0).cast("int").alias("first"))
    deep = (
        opened.join(rare_windows, "key")
        .groupBy("doc_id", "mark").agg((F.sum(F.col("n") * F.col("logp")) / F.sum("first")).alias("deep_sum"))
        .withColumnsRenamed({"doc_id": "deep_id", "mark": "deep_mark"})
    )
    joined = scored.join(sums, scored["doc_id"].eqNullSafe(sums["rare_id"]) & scored["mark"].eqNullSafe(sums["rare_mark"]), "left")
    joined = joined.join(deep, scored["doc_id"].eqNullSafe(deep["deep_id"]) & scored["mark"].eqNullSafe(deep["deep_mark"]), "left")
    return joined.select(
        "doc_id", held_out.alias("held_out"), "n_tokens",
        (F.col("frequent_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("frequent_sum") + F.coalesce("rare_sum", F.lit(0.0))).alias("base_score"),
        (F.col("window_sum") + F.coalesce("deep_sum", F.lit(0.0))).alias("score"))
