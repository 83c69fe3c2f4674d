"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in built-in functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut
from lakescribe.llm.common import fresh

#: What separates words: all ASCII but digits and letters.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The index of windows goes to all executors up to so many bytes; beyond, both joins shuffle.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; none for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lower, _GAP), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(item_id, window): all runs of `width` words of an item; a shorter item that has words is one window."""
    split = benchmark.select("item_id", words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    starts = split.select("item_id", "w", size.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    return starts.select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("window")).distinct()


def _small(df: DataFrame, text: Column, limit: int) -> bool:
    """Whether the rows take up less than the limit."""
    held = df.agg(F.coalesce(F.sum(F.length(text) + 64), F.lit(0)).alias("bytes")).head().bytes
    return held <= limit


def word_frequency(split: DataFrame, vocabulary: DataFrame, limit: int) -> DataFrame:
    """(token, df): occurrences in all documents of the words that windows hold."""
    each = split.select(F.explode_outer("w").alias("token"))  # a plain explode would split each text twice, to test its size
    if _small(vocabulary, F.col("token"), limit):
        each = each.join(F.broadcast(vocabulary), "token", "left_semi")  # size checked
        return each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(vocabulary, "token", "left_semi")


def rarest_tokens(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(token, offset, item_id, window): of each window the necessary prefix.

    A window must be contained whole, so in the order of rarity its first token is all that has to be joined.
    Of equally rare ones the first by text is taken, at its first place.
    """
    each = windows.select("item_id", "window", F.explode("window").alias("token"))
    rarest = (
        each.join(frequency, "token", "left")
        .groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("first"))
        .where(F.col("first.df") > 0))  # a word that no document holds rules the window out
    return rarest.select(
        F.col("first.token").alias("token"), (F.array_position("window", F.col("first.token")).cast("int") - 1).alias("offset"), "item_id", "window")


def occurrences(split: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """(doc_id, mark, start, n, item_id) of every place where a document holds a window; start from 0.

    Bounds before the words are compared: the window has to begin in the document and to end in it.
    """
    fits = (F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n_words"))
    same = F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("window")) == F.col("window")
    shown = ("doc_id", "mark", "start", F.size("window").alias("n"), "item_id")
    if _small(index, F.concat_ws(" ", "window"), limit):
        each = split.select("doc_id", "mark", "n_words", "w", F.posexplode_outer("w").alias("at", "token"))
        found = each.join(F.broadcast(index), "token").withColumn("start", F.col("at") - F.col("offset"))  # size checked
        return found.where(fits).where(same).select(*shown)
    each = split.select("doc_id", "mark", "n_words", F.posexplode_outer("w").alias("at", "token"))
    near = each.join(index, "token").withColumn("start", F.col("at") - F.col("offset")).where(fits).drop("token", "at", "offset", "n_words")
    texts = split.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "w").distinct()
    found = near.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    return found.where(same).select(*shown)


def _covered(places: Column) -> Column:
    """Words in the union of (start, n) ranges."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def add(held: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        new = F.greatest(end - F.greatest(held["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(held["end"], end).alias("end"), (held["hit"] + new).alias("hit"))

    return F.aggregate(F.array_sort(places), begin, add)["hit"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """How far benchmark items occur in every whole document.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with such a
    window), items_sha256 (of their ids, sorted as strings, comma-joined) and contaminated (n_hit > 0). Null
    and empty texts have no words. Null item texts have no windows; an empty benchmark hits nothing. Equal
    rows give equal results; an item that occurs several times counts once. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    split = docs.select("doc_id", F.xxhash64(text).alias("mark"), words(text).alias("w")).withColumn("n_words", F.size("w"))
    windows = item_windows(benchmark.select("item_id", "text"), width)
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    # as small as the benchmark; written, so that its words are counted once
    index = cut(rarest_tokens(windows, word_frequency(split, vocabulary, broadcast_bytes)))
    hits = (
        occurrences(split, index, broadcast_bytes)
        .groupBy("doc_id", "mark").agg(
            F.collect_set(F.struct("start", "n")).alias("places"),  # as many as the text has words, at most
            F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(
            F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), _covered(F.col("places")).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"), F.concat_ws(",", F.array_sort("items")).alias("items")))
    each = split.select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words"))
    joined = each.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item.

    Texts are told apart by a 64-bit hash; two different ones of n share it with a chance of n*n/2^65.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    bad = find_contamination_marks(docs, benchmark, width)
    mark = fresh("mark", docs.columns)
    return docs.withColumn(mark, key).join(bad.withColumnRenamed("mark", mark), mark, "left_anti").drop(mark)


def find_contamination_marks(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(mark): hashes of the texts that hold a window."""
    found = find_contamination(docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text"), benchmark, width)
    return found.where("contaminated").select(F.col("doc_id").alias("mark")).distinct()


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT doc_id, item_id, spots.n, s FROM spots JOIN win ON spots.k = win.k AND spots.n = win.n),
cover AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""
