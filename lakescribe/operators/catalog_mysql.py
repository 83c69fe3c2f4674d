"""MySQL information schema to canonical frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.signature import mysql_signature
from lakescribe.model import spread
from lakescribe.operators.catalog_common import (
    Frames,
    argument,
    finish,
    first_target,
    number,
    ordered,
    text,
)
from lakescribe.operators.filters import Schemas, filter_schemas

DIALECT = "mysql"
SOURCE = "source_id"


def _kept(frames: Frames, relation: str, owner: str, schemas: Schemas) -> DataFrame:
    return filter_schemas(frames[relation], DIALECT, schemas, owner, frames.get("database_info"))


def mysql_tables(frames: Frames, schemas: Schemas = None) -> DataFrame:
    tables = _kept(frames, "tables", "table_schema", schemas).where("table_type = 'BASE TABLE'")
    return finish(
        tables, "tables", DIALECT,
        owner=F.col("table_schema"), name=F.col("table_name"), type=text("engine"), comment=text("table_comment"),
        row_count=number("table_rows", "long"), created_at=F.col("create_time"), modified_at=F.col("update_time"),
    )


def mysql_fktarget(frames: Frames, schemas: Schemas = None) -> DataFrame:
    used = _kept(frames, "key_column_usage", "table_schema", schemas).where("referenced_table_name is not null")
    named = used.withColumnsRenamed(
        {"table_schema": "owner", "referenced_table_name": "fk_target_table",
         "referenced_column_name": "fk_target_column"}
    )
    return first_target(
        named, [SOURCE, "owner", "table_name", "column_name"], "constraint_name", "fk_target_table", "fk_target_column"
    )


def mysql_columns(frames: Frames, schemas: Schemas = None, raw_foreign_keys: bool = False) -> DataFrame:
    """Columns of base tables and views. A column is a foreign key if it references something;
    raw_foreign_keys marks every column with key code MUL instead, which any plain index has too."""
    columns = _kept(frames, "columns", "table_schema", schemas).withColumnRenamed("table_schema", "owner")
    kinds = _kept(frames, "tables", "table_schema", schemas).where(
        F.col("table_type").isin("BASE TABLE", "VIEW")
    ).select(
        SOURCE, F.col("table_schema").alias("owner"), "table_name",
        F.when(F.col("table_type") == "VIEW", F.lit("VIEW")).otherwise(F.lit("TABLE")).alias("object_kind"),
    )
    joined = columns.join(spread(kinds), [SOURCE, "owner", "table_name"]).join(
        spread(mysql_fktarget(frames, schemas)), [SOURCE, "owner", "table_name", "column_name"], "left"
    )
    coded: Column = F.col("column_key").isin("MUL", "FOR")
    return finish(
        joined, "columns", DIALECT,
        name=F.col("column_name"), position=F.col("ordinal_position"),
        length=number("character_maximum_length"), precision=number("numeric_precision"),
        scale=number("numeric_scale"),
        nullable=F.col("is_nullable") == "YES", default_value=text("column_default"), comment=text("column_comment"),
        is_primary_key=text("column_key") == "PRI",
        is_foreign_key=F.coalesce(coded, F.lit(False)) if raw_foreign_keys else F.col("fk_target_table").isNotNull(),
        is_unique=text("column_key") == "UNI",
        fk_target_table=text("fk_target_table"), fk_target_column=text("fk_target_column"),
        is_auto_increment=text("extra").contains("auto_increment"),
    )


def mysql_indexes(frames: Frames, schemas: Schemas = None) -> DataFrame:
    statistics = _kept(frames, "statistics", "table_schema", schemas).withColumnRenamed("table_schema", "owner")
    indexes = statistics.groupBy(SOURCE, "owner", "table_name", "index_name", "index_type", "non_unique").agg(
        ordered("seq_in_index", F.col("column_name")).alias("columns")
    )
    return finish(
        indexes, "indexes", DIALECT,
        name=F.col("index_name"), type=F.col("index_type"), is_unique=F.col("non_unique") == 0,
        is_primary=F.col("index_name") == "PRIMARY", is_enabled=F.lit(True), comment=F.lit(""),
    )


def mysql_views(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return finish(
        _kept(frames, "views", "table_schema", schemas), "views", DIALECT,
        owner=F.col("table_schema"), name=F.col("table_name"), type=F.lit("VIEW"), comment=F.lit(""),
        is_updatable=text("is_updatable") == "YES",
    )


def mysql_routines(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """A procedure and a function may share a name; each has its own arguments."""
    routines = _kept(frames, "routines", "routine_schema", schemas).withColumnsRenamed(
        {"routine_schema": "owner", "routine_name": "name", "routine_type": "type"}
    )
    listed = (
        _kept(frames, "parameters", "specific_schema", schemas)
        .where("parameter_name is not null")
        .groupBy(SOURCE, F.col("specific_schema").alias("owner"), F.col("specific_name").alias("name"), F.col("routine_type").alias("type"))
        .agg(ordered("ordinal_position", argument(
            F.col("parameter_name"), F.col("ordinal_position"), F.col("parameter_mode"), F.col("data_type"), F.lit("")
        )).alias("arguments"))
    )
    joined = routines.join(spread(listed), [SOURCE, "owner", "name", "type"], "left")
    return finish(
        joined, "routines", DIALECT,
        comment=text("routine_comment"),
        signature=mysql_signature(F.col("type"), F.col("name"), F.col("arguments")),
        return_type=F.when(F.col("type") == "FUNCTION", text("dtd_identifier")).otherwise(F.lit("")),
        language=F.lit("SQL"), arguments=F.coalesce("arguments", F.array()),
    )


def mysql_triggers(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return finish(
        _kept(frames, "triggers", "trigger_schema", schemas), "triggers", DIALECT,
        owner=F.col("trigger_schema"), name=F.col("trigger_name"), target_table=F.col("event_object_table"),
        target_type=F.lit("TABLE"), timing=F.col("action_timing"), event=F.col("event_manipulation"),
        events=F.array("event_manipulation"), level=F.lit("ROW"), status=F.lit("ENABLED"), comment=F.lit(""),
    )
