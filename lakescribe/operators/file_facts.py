"""Facts of the columns of tables that grow by files: measured once for each file, stored, and merged.

A stored fact belongs to a file as it was: its path, length, modification time and the columns of its table. So
files that came since are measured, files that were replaced are measured again, files that are gone do not count
any more, and all others are not opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions import files
from lakescribe.functions.values import quoted, text_literal
from lakescribe.model import local_frame, union_all
from lakescribe.operators.profiles import COLUMNS_PER_SCAN, MERGED, mergeable_facts, merged_profile

#: Files that are measured by one job. A run that breaks off loses the work of one job only.
FILES_PER_JOB = 4_096

_FILE = ["file_path", "file_size", "modified_at"]
_FACT_TYPES = {"n_rows": "bigint", "n_nulls": "bigint", "n_odd": "bigint"} | dict.fromkeys(
    ("min_chars", "max_chars", "max_bytes", "digits", "scale"), "int") | dict.fromkeys(
    ("min_long", "max_long", "min_hash", "max_hash", "bits_low", "bits_high"), "bigint")
_STORED = (
    "file_path string, file_size bigint, modified_at timestamp, columns_sha256 string, part int, facts array<struct<column_name: string, "
    + ", ".join(f"{name}: {_FACT_TYPES[name]}" for name in MERGED) + ">>, table_name string")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).format(fmt).load(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_size, modified_at) of the files of a table; none is opened."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").alias("modified_at"))


def _groups(schema: T.StructType) -> list[list[T.StructField]]:
    return [schema.fields[a : a + COLUMNS_PER_SCAN] for a in range(0, len(schema.fields), COLUMNS_PER_SCAN)]


def _columns_sha256(schema: T.StructType) -> str:
    named = "\n".join(f"{f.name}\t{f.dataType.simpleString()}" for f in schema.fields)
    return hashlib.sha256(named.encode()).hexdigest()


def stored_facts(spark: SparkSession, store: str) -> DataFrame:
    """What has been measured: a row for each file and group of columns."""
    if not files.names(spark, store):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).parquet(store)


def _known(spark: SparkSession, store: str, table: str, schema: T.StructType) -> DataFrame:
    """Stored rows of a table's present columns, each once however often it was measured."""
    found = stored_facts(spark, store).where((F.col("table_name") == table) & (F.col("columns_sha256") == _columns_sha256(schema)))
    return found.dropDuplicates([*_FILE, "part"])


def unmeasured_files(spark: SparkSession, store: str, table: str, path: str, schema: T.StructType) -> DataFrame:
    """Files of a table without stored facts of all columns as they are now."""
    complete = _known(spark, store, table, schema).groupBy(*_FILE).agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == len(_groups(schema)))
    return list_files(spark, path).join(complete, _FILE, "left_anti")


def _batches(rows: Iterator, size: int) -> Iterator[list]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def measure_files(
    spark: SparkSession, paths: Mapping[str, str], store: str, schemas: Mapping[str, T.StructType] | None = None, fmt: str = "parquet",
    files_per_job: int = FILES_PER_JOB,
) -> dict[str, int]:
    """Measure the files of tables that have no stored facts and add these to the store; files measured by table.

    paths: the folder (or file) of each table. A file's rows are combined where they are read, so that one row for each task and file is
    shuffled; the scan opens the chosen files only, since they are named by a filter on their path. The driver sees the
    names of the new files, one job's at a time. Files without rows are stored with no rows.
    """
    counted = {}
    for table, path in paths.items():
        df = read_table(spark, path, (schemas or {}).get(table), fmt)
        counted[table] = 0
        # files and facts are listed when the plan is made, so what is added below changes nothing here
        todo = unmeasured_files(spark, store, table, path, df.schema).orderBy("file_path")
        for batch in _batches(todo.toLocalIterator(), files_per_job):
            _measured(df, table, batch).write.mode("append").partitionBy("table_name").parquet(store)
            counted[table] += len(batch)
    return counted


def _measured(df: DataFrame, table: str, batch: list) -> DataFrame:
    spark = df.sparkSession
    named = local_frame(spark, [tuple(r) for r in batch], "file_path string, file_size bigint, modified_at timestamp")
    chosen = df.where(F.col("_metadata.file_path").isin([r.file_path for r in batch]))
    parts = []
    for number, group in enumerate(_groups(df.schema)):
        structs = [
            F.expr("named_struct('column_name', " + text_literal(f.name) + ", " + ", ".join(
                f"'{name}', CAST({sql} AS {_FACT_TYPES[name]})" for name, sql in mergeable_facts(f).items()) + ")")
            for f in group
        ]
        rows = chosen.select(F.col("_metadata.file_path").alias("__file"), *[F.col(quoted(f.name)) for f in group])
        found = rows.groupBy("__file").agg(F.array(*structs).alias("facts"))
        empty = F.expr("array(" + ", ".join(
            "named_struct('column_name', " + text_literal(f.name) + ", " + ", ".join(
                f"'{name}', CAST({0 if MERGED[name] == 'sum' else 'NULL'} AS {_FACT_TYPES[name]})" for name in MERGED) + ")"
            for f in group) + ")")
        parts.append(named.join(found, named.file_path == F.col("__file"), "left").select(
            *_FILE, F.lit(_columns_sha256(df.schema)).alias("columns_sha256"), F.lit(number).alias("part"),
            F.coalesce("facts", empty).alias("facts"), F.lit(table).alias("table_name")))
    return union_all(parts)


def file_profile(spark: SparkSession, paths: Mapping[str, str], store: str, schemas: Mapping[str, T.StructType] | None = None, fmt: str = "parquet") -> DataFrame:
    """scan_profile of the tables as they are now, merged from the stored facts of their files: no data is read.

    Files without stored facts are an error, so measure first.
    """
    parts = []
    for table, path in paths.items():
        schema = read_table(spark, path, (schemas or {}).get(table), fmt).schema
        if unmeasured_files(spark, store, table, path, schema).limit(1).count():
            raise ValueError(f"table {table} has files that are not measured")
        facts = _known(spark, store, table, schema).join(list_files(spark, path), _FILE, "left_semi")
        merged = facts.select("table_name", F.inline("facts")).select("table_name", "column_name", *MERGED)
        # a table without files has its columns nevertheless
        none = local_frame(spark, [(table, f.name, 0, 0, 0) for f in schema.fields], "table_name string, column_name string, n_rows bigint, n_nulls bigint, n_odd bigint")
        parts.append(merged.unionByName(none, allowMissingColumns=True))
    return merged_profile(union_all(parts))
