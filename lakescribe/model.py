"""Canonical frames: the shape every normaliser and every measurement ends in.

No frame here may ever hold the body, definition or source text of a view, routine or trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema



class LazyFrames(Mapping[str, DataFrame]):
    """Named frames, each built when it is first asked for: a report plans only the kinds it reads."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


Catalog = Mapping[str, DataFrame]

_TYPES = {
    "s": T.StringType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "b": T.BooleanType(),
    "n": T.DecimalType(38, 0),  # catalog values of sequences can exceed 64 bits
    "t": T.TimestampType(),
    "s[]": T.ArrayType(T.StringType()),
}

ARGUMENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("default_value", T.StringType()),
    ]
)
_TYPES["args"] = T.ArrayType(ARGUMENT)

ORIGIN = ("source_id", "dialect")


def _frame(fields: str) -> T.StructType:
    columns = [T.StructField("source_id", T.LongType()), T.StructField("dialect", T.StringType())]
    for field in fields.split():
        name, code = field.split(":")
        columns.append(T.StructField(name, _TYPES[code]))
    return T.StructType(columns)


FRAMES: dict[str, T.StructType] = {
    "sources": _frame("database_name:s database_type:s version:s extracted_at:t"),
    "tables": _frame("owner:s name:s type:s comment:s row_count:l created_at:t modified_at:t"),
    "columns": _frame(
        "owner:s table_name:s object_kind:s name:s position:i data_type:s length:i precision:i scale:i "
        "nullable:b default_value:s comment:s is_primary_key:b is_foreign_key:b is_unique:b "
        "fk_target_table:s fk_target_column:s is_auto_increment:b"
    ),
    "views": _frame("owner:s name:s type:s comment:s is_updatable:b"),
    "indexes": _frame(
        "owner:s table_name:s name:s type:s columns:s[] is_unique:b is_primary:b is_enabled:b comment:s"
    ),
    "routines": _frame(
        "owner:s name:s type:s comment:s signature:s return_type:s language:s arguments:args"
    ),
    "sequences": _frame(
        "owner:s name:s min_value:n max_value:n increment:n last_number:n cache_size:i "
        "is_cyclic:b is_ordered:b comment:s"
    ),
    "triggers": _frame(
        "owner:s name:s target_table:s target_type:s timing:s event:s events:s[] level:s status:s comment:s"
    ),
    "synonyms": _frame("owner:s name:s target_object:s target_owner:s target_type:s is_public:b comment:s"),
}

# Kinds of documented objects, in the order in which they are reported.
OBJECT_KINDS = ("tables", "views", "routines", "sequences", "triggers", "synonyms", "indexes")


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """A small driver-side list as a local relation: no tasks to read it, and its size is known to
    the optimizer, which then decides on a broadcast. For rows per column, pair or source only."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = list(rows)
    arrow = to_arrow_schema(struct)
    arrays = [pa.array([r[i] for r in rows], type=field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def empty(spark: SparkSession, frame: str) -> DataFrame:
    """A canonical frame without rows, for kinds that a dialect does not have."""
    return local_frame(spark, [], FRAMES[frame])


def conform(df: DataFrame, frame: str) -> DataFrame:
    """Select the canonical columns in order, with the canonical types."""
    return df.to(FRAMES[frame])


def spread(df: DataFrame) -> DataFrame:
    """One side of a join by source, to be joined by sorting. What holds rows of every source grows with the fleet, and the
    optimizer's estimate of exploded or compressed rows is far too low: broadcast on it, they fill the driver."""
    return df.hint("merge")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
