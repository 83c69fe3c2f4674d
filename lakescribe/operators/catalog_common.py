"""Parts that the catalog normalisers of all dialects share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.dialect import LABELS
from lakescribe.model import ARGUMENT, FRAMES

Frames = Mapping[str, DataFrame]

def text(name: str | Column) -> Column:
    """Missing text is ''."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def number(name: str, kind: str = "int") -> Column:
    """Missing numbers are 0."""
    return F.coalesce(F.col(name), F.lit(0)).cast(kind)


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def finish(df: DataFrame, frame: str, dialect: str, **values: Column) -> DataFrame:
    """The canonical frame: named values, and columns of the frame that already exist under their name."""
    chosen = {"dialect": F.lit(dialect), **values}
    names = FRAMES[frame].names
    return df.select(*[chosen[n].alias(n) if n in chosen else n for n in names]).to(FRAMES[frame])


def ordered(position: str, value: Column) -> Column:
    """Aggregate: values in the order of their position. For index columns and routine arguments,
    whose number per group the database itself limits."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def no_arguments() -> Column:
    return F.array().cast(T.ArrayType(ARGUMENT))


def argument(name: Column, position: Column, mode: Column, data_type: Column, default: Column) -> Column:
    return F.struct(
        name.alias("name"), position.cast("int").alias("position"), mode.alias("mode"),
        data_type.alias("data_type"), default.alias("default_value"),
    )


def first_target(keyed: DataFrame, keys: Sequence[str], order: str, *facts: str) -> DataFrame:
    """One row of facts per key, the first by order; combined before the shuffle, unlike a window."""
    best = F.min(F.struct(order, *facts)).alias("best")
    return keyed.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{f}").alias(f) for f in facts])


def source_info(frames: Frames, dialect: str, extracted_at: Column) -> DataFrame:
    """Name, type and version of every database: the first line of what it reports."""
    first = Window.partitionBy("source_id").orderBy("line")
    one = frames["database_info"].withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return finish(
        one, "sources", dialect,
        database_type=F.lit(LABELS[dialect]), version=text("version"), extracted_at=extracted_at,
    )
