"""Numbers and running sums in order, without a window over a group: a group may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut

_SHIFT = 33  # monotonically_increasing_id: number of the partition, then 33 bits of the row in it


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ord", start: int = 1) -> DataFrame:
    """The rows, with their number (start, start + 1, ...) in the order of their group as a long.

    A prefix sum over partitions: rows are range-sorted by group and order, so a huge group is many
    partitions and a small one shares its partition; the rows of each group and partition are counted, and a row's
    number is the count of its group's rows in earlier partitions and earlier in its own. Only these counts are summed
    in a window: for each group as many rows as it has partitions. Null group values make a group. Equal rows
    in `order` are numbered in any order, so give an order that tells apart what must be. Runs jobs when called.
    """
    if not {name, "_at", "_part"}.isdisjoint(df.columns):
        raise ValueError(f"columns {name}, _at and _part are taken")
    sort = [F.col(c) for c in (*group, *order)]
    # partition ids follow the order of the ranges; written, so that no retry deals the rows out anew
    placed = cut(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _SHIFT).cast("int"))
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the optimizer knows its size when it plans the join
    shifts = cut(counts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(shifts, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") + F.col("_shift") + start).alias(name))


def numbered_by_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ord") -> DataFrame:
    """As `numbered` from 1, for rows whose groups are all small enough for one task: one shuffle, nothing written."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def total_by_group(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """As `running_total`, for rows whose groups are all small enough for one task: one shuffle, nothing written."""
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The rows, with the sum of `value` (a long) over the rows of their group that come before them in the order.

    As `numbered`: a window adds up the rows of a group in one partition, the partitions' sums are added up on their own.
    Runs jobs when called.
    """
    if not {name, "_at", "_part", "_before", "_own"}.isdisjoint(df.columns):
        raise ValueError(f"columns {name}, _at, _part, _before and _own are taken")
    sort = [F.col(c) for c in (*group, *order)]
    placed = cut(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", _SHIFT).cast("int"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(
        placed.groupBy(*group, "_part").agg(F.sum(value).alias("_n"))
        .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    here = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    summed = placed.withColumn("_own", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return summed.join(parts, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))
