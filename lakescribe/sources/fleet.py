"""Catalog relations of a fleet of databases as a data source whose partitions are the databases.

One scan reads a relation of all databases, each in a task of its own that opens a connection of a DB-API module on the
executor. So a plan has one scan for each relation whatever the number of databases, the driver connects to none, and a
database that is down is a row with its error.
"""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lakescribe.functions.scratch import cut
from lakescribe.model import union_all
from lakescribe.sources.jdbc import QUERIES
from lakescribe.sources.native import native_schema

FETCH_ROWS = 10_000


@dataclass(frozen=True)
class Database:
    """One database: what `connect` of the DB-API module takes. Credentials stay out of plans and logs."""

    source_id: int
    arguments: Mapping[str, Any] = field(default_factory=dict, repr=False)


def _converter(kind: T.DataType) -> Callable[[Any], Any]:
    """Drivers differ in what they give for booleans, times and wide numbers."""
    if isinstance(kind, T.BooleanType):
        return lambda x: x.strip().lower() in ("t", "true", "y", "yes", "1") if isinstance(x, str) else bool(x)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int
    if isinstance(kind, T.DecimalType):
        return lambda x: Decimal(str(x))
    if isinstance(kind, T.TimestampType):
        return lambda x: x if isinstance(x, datetime) else datetime.fromisoformat(str(x))
    if isinstance(kind, T.ArrayType):
        one = _converter(kind.elementType)
        return lambda x: [one(v) for v in (x.strip("{}[]").replace(",", " ").split() if isinstance(x, str) else x)]
    return lambda x: x.decode(errors="replace") if isinstance(x, (bytes, bytearray)) else str(x)


class _Relation(DataSourceReader):
    def __init__(self, databases: Sequence[Database], module: str, query: str, schema: T.StructType):
        self.databases, self.module, self.query, self.fields = databases, module, query, schema

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(database) for database in self.databases]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        database: Database = partition.value
        shape = to_arrow_schema(self.fields)
        convert = [_converter(f.dataType) for f in self.fields[1:-1]]

        def batch(rows: list, error: str | None = None) -> pa.RecordBatch:
            n = 1 if error else len(rows)
            columns = [[None] * n for _ in convert] if error else [[None if r[i] is None else c(r[i]) for r in rows] for i, c in enumerate(convert)]
            values = [[database.source_id] * n, *columns, [error] * n]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, shape, strict=True)], schema=shape)

        try:
            connection = importlib.import_module(self.module).connect(**database.arguments)
            try:
                cursor = connection.cursor()
                cursor.execute(self.query)
                while rows := cursor.fetchmany(FETCH_ROWS):
                    yield batch(rows)
            finally:
                connection.close()
        except Exception as error:  # noqa: BLE001  whatever a driver throws is that database's error
            yield batch([], f"{type(error).__name__}: {str(error)[:500]}")


def read_relation(spark: SparkSession, databases: Sequence[Database], dialect: str, relation: str, module: str, query: str | None = None) -> DataFrame:
    """A native relation of all databases, with `error`: null, or in a row of its own why a database could not be read
    (to its end). The schema is that of `native_schema`; nothing is asked of a database before a job runs."""
    schema = T.StructType([*native_schema(dialect, relation).fields, T.StructField("error", T.StringType())])
    reader = _Relation(list(databases), module, query or QUERIES[dialect][relation], schema)

    class Fleet(DataSource):
        @classmethod
        def name(cls) -> str:
            return "database_fleet"

        def schema(self) -> T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return reader

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
    spark.dataSource.register(Fleet)
    return spark.read.format("database_fleet").load()


def read_fleet(
    spark: SparkSession, databases: Sequence[Database], dialect: str, module: str, queries: Mapping[str, str] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(native frames, errors): each relation of each database is read once, into a table in the shared folder.

    errors: (source_id, relation, error). A database with an error in any relation has no rows in any frame, so that no
    catalog is read in part. Runs jobs when called, one for each relation.
    """
    if not databases:
        raise ValueError("no databases")
    ids = [d.source_id for d in databases]
    if len(set(ids)) < len(ids):
        raise ValueError("a source_id occurs twice")
    read = {r: cut(read_relation(spark, databases, dialect, r, module, q)) for r, q in (queries or QUERIES[dialect]).items()}
    errors = cut(union_all([df.where("error IS NOT NULL").select("source_id", F.lit(r).alias("relation"), "error") for r, df in read.items()]))
    failed = errors.select("source_id").distinct()
    return {r: df.where("error IS NULL").drop("error").join(failed, "source_id", "left_anti") for r, df in read.items()}, errors
