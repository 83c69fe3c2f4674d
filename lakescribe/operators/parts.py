"""Whole texts of a source, as consecutive pieces of bounded size.

A text of one source may hold millions of lines, so it is never gathered in one task. It comes as rows (source_id, at,
text): in the order of `at`, the byte at which a piece begins, the pieces make up the text. A line belongs to
the piece numbered `byte at which it begins div limit`; so a piece has fewer bytes than the limit, beside its last line, and the rule
is the same for all sources. Nearly all have one piece, which is then the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut
from lakescribe.operators.numbering import running_total, total_by_group

PIECE_BYTES = 1 << 20
TASK_BYTES = 1 << 26  # of text of one source that one task may place


def joined_lines(order: Sequence[str], text: str = "text") -> Column:
    """Aggregate: the texts of a group one after the other, in their order."""
    lines = F.sort_array(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(lines, lambda x: x[text]), "")


def large_sources(sizes: DataFrame, limit: int) -> DataFrame | None:
    """(source_id) of those with more than `limit` bytes; None if there are none. sizes: (source_id, bytes)."""
    large = cut(sizes.where(F.col("bytes") > limit).select("source_id"))
    return None if large.isEmpty() else large


def pieces(lines: DataFrame, order: Sequence[str], limit: int, total=running_total) -> DataFrame:
    """(source_id, at, text) from the lines (source_id, *order, text) of sources of any size; a task holds one piece.

    With `total_by_group`, of sources of which a task may hold all lines: they are placed and joined where they are sorted.
    """
    placed = total(lines.withColumn("bytes", F.octet_length("text").cast("long")), ["source_id"], [*order, "text"], "bytes", "at")
    piece = F.floor(F.col("at") / limit).alias("piece")
    return placed.groupBy("source_id", piece).agg(F.min("at").alias("at"), joined_lines(order).alias("text")).select("source_id", "at", "text")


def by_size(sizes: DataFrame, limit: int, task: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(source_id) of all with more than `limit` bytes, of those among them that a task may hold, and of the others; None if there are
    none. sizes: (source_id, bytes)."""
    large = large_sources(sizes, limit)
    huge = None if large is None else large_sources(sizes, max(task, limit))
    medium = large if huge is None else large.join(huge, "source_id", "left_anti")
    return large, medium, huge


def whole_texts(lines: DataFrame, order: Sequence[str], limit: int = PIECE_BYTES, task: int = TASK_BYTES) -> DataFrame:
    """(source_id, at, text) from the lines (source_id, *order, text), which are ordered by (order, text).

    Sources within the limit are one group each; of others, only lines of those above `task` bytes are placed by prefix sums.
    Runs jobs when called.
    """
    lines = cut(lines, "zstd")
    sizes = lines.groupBy("source_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large, medium, huge = by_size(sizes, limit, task)
    small = lines if large is None else lines.join(large, "source_id", "left_anti")
    whole = small.groupBy("source_id").agg(joined_lines(order).alias("text")).select("source_id", F.lit(0).cast("long").alias("at"), "text")
    if large is None:
        return whole
    whole = whole.unionByName(pieces(lines.join(medium, "source_id", "left_semi"), order, limit, total_by_group))
    return whole if huge is None else whole.unionByName(pieces(lines.join(huge, "source_id", "left_semi"), order, limit))
