"""Flagship: a lake documented as if it were a database, every fact measured.

The first pass scans every table once for all per-column facts; its result, one row per column, also
tells which columns later passes must read. The second compares values, for keys and
foreign keys, and reads only columns that may be unique or may lie in a unique column.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.values import INTEGER, NUMERIC, STRING, scalar_columns, type_class
from lakescribe.model import Catalog, LazyFrames, conform, empty, local_frame
from lakescribe.operators.distincts import (
    ColumnFacts,
    column_sets,
    comparable_columns,
    inclusions_from,
    lake_facts,
    may_be_unique,
)
from lakescribe.operators.keys import sequence_profile_from, suggest_foreign_keys
from lakescribe.operators.profiles import Tables, row_counts

_KEY = ["table_name", "column_name"]

_FACTS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("precision", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("key_rank", T.IntegerType()),
    ]
)


def _fact_frame(spark: SparkSession, tables: Tables, facts: list[ColumnFacts]) -> DataFrame:
    by_name = {(r["table_name"], r["column_name"]): r for r in facts}
    rows = []
    for table, df in tables.items():
        for position, field in enumerate(df.schema.fields, start=1):
            r, cls = by_name[(table, field.name)], type_class(field.dataType)
            # Integer and string keys are preferred as the primary key, then the order of the columns.
            rank = position if cls in (INTEGER, STRING) else len(df.schema.fields) + position
            rows.append(
                (
                    table, field.name, position, field.dataType.simpleString(),
                    r["max_chars"] or 0 if cls == STRING else 0,
                    r["precision"] or 0 if cls in NUMERIC else 0,
                    r["scale"] or 0 if cls in NUMERIC else 0,
                    bool(r["nullable"]), r["n_rows"], rank,
                )
            )
    return local_frame(spark, rows, _FACTS)


def document_lake(
    tables: Tables,
    comments: DataFrame | None = None,
    *,
    database_name: str = "lake",
    owner: str = "lake",
    source_id: int = 0,
    version: str | None = None,
    extracted_at: datetime | None = None,
    profile: DataFrame | None = None,
) -> Catalog:
    """Canonical catalog of the given tables, each frame measured when it is first used. Comments:
    (table_name, column_name, comment), the column name being '' for a table's own comment. profile: the tables'
    scan_profile if it is known, such as the merged facts of their files; then only the comparison of values reads data."""
    spark = next(iter(tables.values())).sparkSession
    notes = comments if comments is not None else local_frame(
        spark, [], "table_name string, column_name string, comment string"
    )
    where = {"source_id": F.lit(source_id), "dialect": F.lit("lake"), "owner": F.lit(owner)}

    def sources() -> DataFrame:
        stamp = extracted_at or datetime.now(timezone.utc)
        return local_frame(
            spark,
            [(source_id, database_name, version or spark.version, stamp)],
            "source_id long, database_name string, version string, extracted_at timestamp",
        ).withColumns({"dialect": F.lit("lake"), "database_type": F.lit("Spark")})

    def documented() -> DataFrame:
        return (
            (row_counts(tables) if profile is None else profile.groupBy("table_name").agg(F.max("n_rows").alias("row_count")))
            .join(notes.where("column_name = ''").select("table_name", "comment"), "table_name", "left")
            .withColumns(
                {
                    **where,
                    "name": F.col("table_name"),
                    "type": F.lit("TABLE"),
                    "comment": F.coalesce("comment", F.lit("")),
                    "created_at": F.lit(None).cast("timestamp"),
                    "modified_at": F.lit(None).cast("timestamp"),
                }
            )
        )

    def columns() -> DataFrame:
        return _measured_columns(tables, notes, profile).withColumns({**where, "object_kind": F.lit("TABLE")})

    built: dict[str, Callable[[], DataFrame]] = {
        "sources": lambda: conform(sources(), "sources"),
        "tables": lambda: conform(documented(), "tables"),
        "columns": lambda: conform(columns(), "columns"),
    }
    for kind in ("views", "indexes", "routines", "sequences", "triggers", "synonyms"):
        built[kind] = lambda kind=kind: empty(spark, kind)
    return LazyFrames(built)


def _measured_columns(tables: Tables, notes: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The columns with all their facts. One comparison of values gives uniqueness and inclusions; both
    uses of it are in one plan, where equal exchanges run once."""
    spark = next(iter(tables.values())).sparkSession
    facts = lake_facts(tables, profile)
    compared = comparable_columns(tables, facts) | {(r["table_name"], r["column_name"]) for r in facts if may_be_unique(r)}
    sets = column_sets(tables, compared, facts=facts)
    unique = sets.where("is_unique").select(*_KEY)
    targets = suggest_foreign_keys(inclusions_from(sets)).select(
        F.col("child_table").alias("table_name"),
        F.col("child_column").alias("column_name"),
        F.col("parent_table").alias("fk_target_table"),
        F.col("parent_column").alias("fk_target_column"),
    )

    base = _fact_frame(spark, tables, facts)
    marked = base.join(unique.withColumn("unique_mark", F.lit(True)), _KEY, "left").select(
        *base.columns, F.coalesce("unique_mark", F.lit(False)).alias("single")
    )
    keys = marked.where("single and not nullable")
    primary = keys.groupBy("table_name").agg(F.min_by("column_name", "key_rank").alias("column_name"))
    integers = {t: df for t, df in tables.items() if scalar_columns(df.schema, INTEGER)}
    if integers:
        ranges = sequence_profile_from(integers, facts, keys.select(*_KEY, F.lit(True).alias("is_key")))
        counting = ranges.where("is_dense and increment = 1").select(*_KEY)
    else:
        counting = keys.select(*_KEY).limit(0)

    return (
        marked.join(primary.withColumn("pk_mark", F.lit(True)), _KEY, "left")
        .join(targets, _KEY, "left")
        .join(counting.withColumn("counting_mark", F.lit(True)), _KEY, "left")
        .join(notes.where("column_name <> ''"), _KEY, "left")
        .withColumns(
            {
                "name": F.col("column_name"),
                "default_value": F.lit(""),
                "comment": F.coalesce("comment", F.lit("")),
                "is_primary_key": F.coalesce("pk_mark", F.lit(False)),
                "is_unique": F.col("single") & F.col("pk_mark").isNull(),
                "is_foreign_key": F.col("fk_target_table").isNotNull(),
                "fk_target_table": F.coalesce("fk_target_table", F.lit("")),
                "fk_target_column": F.coalesce("fk_target_column", F.lit("")),
                "is_auto_increment": F.coalesce("counting_mark", F.lit(False)),
            }
        )
    )
