"""SQL Server catalog views to canonical frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.signature import mssql_signature
from lakescribe.model import spread
from lakescribe.operators.catalog_common import (
    Frames,
    argument,
    finish,
    first_target,
    flag,
    number,
    ordered,
    text,
)
from lakescribe.operators.filters import Schemas, filter_schemas

DIALECT = "mssql"
SOURCE = "source_id"
OBJECT = [SOURCE, "object_id"]
COLUMN = [*OBJECT, "column_id"]


def _schemas(frames: Frames, schemas: Schemas) -> DataFrame:
    return filter_schemas(
        frames["schemas"].select(SOURCE, "schema_id", F.col("name").alias("owner")), DIALECT, schemas
    )


def _objects(frames: Frames, relation: str, schemas: Schemas) -> DataFrame:
    return frames[relation].join(spread(_schemas(frames, schemas)), [SOURCE, "schema_id"])


def _described(df: DataFrame, frames: Frames, minor: str | None = None, kind: int = 1) -> DataFrame:
    """Left join the MS_Description of the object, or of its column or index.

    Index ids and column ids overlap, so the class of the property is part of the match.
    """
    notes = frames["extended_properties"].where((F.col("name") == "MS_Description") & (F.col("class") == kind))
    if minor is None:
        notes = notes.where("minor_id = 0").select(SOURCE, F.col("major_id").alias("object_id"),
                                                   F.col("value").alias("description"))
        return df.join(spread(notes), OBJECT, "left")
    notes = notes.where("minor_id > 0").select(
        SOURCE, F.col("major_id").alias("object_id"), F.col("minor_id").alias(minor), F.col("value").alias("description")
    )
    return df.join(spread(notes), [*OBJECT, minor], "left")


def _types(frames: Frames) -> DataFrame:
    return frames["types"].select(SOURCE, "user_type_id", F.col("name").alias("data_type"))


def mssql_tables(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Rows of heaps and clustered indexes, summed over partitions before the join."""
    rows = frames["partitions"].where(F.col("index_id").isin(0, 1)).groupBy(*OBJECT).agg(F.sum("rows").alias("n"))
    tables = _described(_objects(frames, "tables", schemas), frames).join(spread(rows), OBJECT, "left")
    return finish(
        tables, "tables", DIALECT,
        type=F.col("type_desc"), comment=text("description"), row_count=number("n", "long"),
        created_at=F.col("create_date"), modified_at=F.col("modify_date"),
    )


def _key_marks(frames: Frames) -> DataFrame:
    """Primary, unique and foreign key flags, one row per column however many keys it is in."""
    keyed = frames["index_columns"].select(*COLUMN, "index_id").join(
        spread(frames["indexes"].where("is_unique or is_primary_key").select(*OBJECT, "index_id", "is_unique", "is_primary_key")),
        [*OBJECT, "index_id"],
    )
    no = F.lit(False)
    indexes = keyed.select(*COLUMN, F.col("is_primary_key").alias("pk"), no.alias("fk"),
                           (F.col("is_unique") & ~F.col("is_primary_key")).alias("uk"))
    foreign = frames["foreign_key_columns"].select(
        SOURCE, F.col("parent_object_id").alias("object_id"), F.col("parent_column_id").alias("column_id"),
        no.alias("pk"), F.lit(True).alias("fk"), no.alias("uk"),
    )
    return indexes.unionByName(foreign).groupBy(*COLUMN).agg(
        F.bool_or("pk").alias("pk"), F.bool_or("fk").alias("fk"), F.bool_or("uk").alias("uk")
    )


def _fk_targets(frames: Frames) -> DataFrame:
    """Target per (source, object_id, column_id): first constraint by name."""
    pairs = frames["foreign_keys"].select(
        SOURCE, F.col("object_id").alias("constraint_object_id"), F.col("name").alias("constraint_name"),
        F.col("referenced_object_id").alias("target"),
    ).join(spread(frames["foreign_key_columns"]), [SOURCE, "constraint_object_id"]).select(
        SOURCE, "constraint_name", "target", F.col("parent_object_id").alias("object_id"),
        F.col("parent_column_id").alias("column_id"), F.col("referenced_column_id").alias("target_column"),
    )
    owners = frames["schemas"].select(SOURCE, "schema_id", F.col("name").alias("target_owner"))
    parents = frames["tables"].select(
        SOURCE, F.col("object_id").alias("target"), F.col("name").alias("target_name"), "schema_id"
    ).join(spread(owners), [SOURCE, "schema_id"]).select(
        SOURCE, "target", F.concat_ws(".", "target_owner", "target_name").alias("fk_target_table")
    )
    columns = frames["columns"].select(
        SOURCE, F.col("object_id").alias("target"), F.col("column_id").alias("target_column"),
        F.col("name").alias("fk_target_column"),
    )
    named = pairs.join(spread(parents), [SOURCE, "target"]).join(spread(columns), [SOURCE, "target", "target_column"])
    return first_target(named, COLUMN, "constraint_name", "fk_target_table", "fk_target_column")


def mssql_fktarget(frames: Frames, schemas: Schemas = None) -> DataFrame:
    tables = _objects(frames, "tables", schemas).select(*OBJECT, "owner", F.col("name").alias("table_name"))
    columns = frames["columns"].select(*COLUMN, F.col("name").alias("column_name"))
    return _fk_targets(frames).join(spread(columns), COLUMN).join(spread(tables), OBJECT).select(
        SOURCE, "owner", "table_name", "column_name", "fk_target_table", "fk_target_column"
    )


def mssql_columns(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Table columns. The joins by column all use one partitioning."""
    tables = _objects(frames, "tables", schemas).select(*OBJECT, "owner", F.col("name").alias("table_name"))
    defaults = frames["default_constraints"].select(
        SOURCE, F.col("parent_object_id").alias("object_id"), F.col("parent_column_id").alias("column_id"), "default_text"
    )
    joined = (
        _described(frames["columns"], frames, "column_id")
        .join(spread(defaults), COLUMN, "left")
        .join(spread(_key_marks(frames)), COLUMN, "left")
        .join(spread(_fk_targets(frames)), COLUMN, "left")
        .join(spread(_types(frames)), [SOURCE, "user_type_id"])
        .join(spread(tables), OBJECT)
    )
    return finish(
        joined, "columns", DIALECT,
        object_kind=F.lit("TABLE"), position=F.col("column_id"), length=number("max_length"),
        precision=number("precision"), scale=number("scale"), nullable=flag("is_nullable"),
        default_value=text("default_text"), comment=text("description"),
        is_primary_key=flag("pk"), is_foreign_key=flag("fk"), is_unique=flag("uk"),
        fk_target_table=text("fk_target_table"), fk_target_column=text("fk_target_column"),
        is_auto_increment=flag("is_identity"),
    )


def mssql_viewcols(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """View columns: position, name, type and comment only."""
    views = _objects(frames, "views", schemas).select(*OBJECT, "owner", F.col("name").alias("table_name"))
    joined = (
        _described(frames["columns"].select(*COLUMN, "name", "user_type_id").join(spread(views), OBJECT), frames, "column_id")
        .join(spread(_types(frames)), [SOURCE, "user_type_id"])
    )
    zero, no, none = F.lit(0), F.lit(False), F.lit("")
    return finish(
        joined, "columns", DIALECT,
        object_kind=F.lit("VIEW"), position=F.col("column_id"), length=zero, precision=zero, scale=zero,
        nullable=no, default_value=none, comment=text("description"), is_primary_key=no, is_foreign_key=no,
        is_unique=no, fk_target_table=none, fk_target_column=none, is_auto_increment=no,
    )


def mssql_indexes(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Named indexes; a heap has no name."""
    tables = _objects(frames, "tables", schemas).select(*OBJECT, "owner", F.col("name").alias("table_name"))
    columns = (
        frames["index_columns"]
        .join(spread(frames["columns"].select(*COLUMN, F.col("name").alias("column_name"))), COLUMN)
        .groupBy(*OBJECT, "index_id")
        .agg(ordered("key_ordinal", F.col("column_name")).alias("columns"))
    )
    indexes = (
        _described(frames["indexes"].where("name is not null"), frames, "index_id", kind=7)
        .join(spread(columns), [*OBJECT, "index_id"], "left")
        .join(spread(tables), OBJECT)
    )
    return finish(
        indexes, "indexes", DIALECT,
        type=F.col("type_desc"), columns=F.coalesce("columns", F.array().cast("array<string>")),
        is_primary=F.col("is_primary_key"), is_enabled=F.lit(True), comment=text("description"),
    )


def mssql_views(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return finish(
        _described(_objects(frames, "views", schemas), frames), "views", DIALECT,
        type=F.lit("VIEW"), comment=text("description"), is_updatable=flag("has_instead_of"),
    )


def mssql_routines(frames: Frames, schemas: Schemas = None, raw_type: bool = False) -> DataFrame:
    """Procedures; raw_type keeps the server's own text for the type."""
    listed = (
        frames["parameters"].join(spread(_types(frames)), [SOURCE, "user_type_id"])
        .withColumn("mode", F.when(F.col("is_output"), F.lit("OUT")).otherwise(F.lit("IN")))
        .groupBy(*OBJECT)
        .agg(ordered("parameter_id", argument(
            F.col("name"), F.col("parameter_id"), F.col("mode"), F.col("data_type"), F.lit("")
        )).alias("arguments"))
    )
    kind: Column = F.col("type_desc") if raw_type else F.lit("PROCEDURE")
    joined = _described(_objects(frames, "procedures", schemas), frames).join(spread(listed), OBJECT, "left")
    return finish(
        joined, "routines", DIALECT,
        type=kind, comment=text("description"), signature=mssql_signature(kind, F.col("name"), F.col("arguments")),
        return_type=F.lit(""), language=F.lit("T-SQL"), arguments=F.coalesce("arguments", F.array()),
    )


def mssql_sequences(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return finish(
        _described(_objects(frames, "sequences", schemas), frames), "sequences", DIALECT,
        min_value=F.col("minimum_value"), max_value=F.col("maximum_value"), last_number=F.col("current_value"),
        cache_size=F.lit(0), is_cyclic=flag("is_cycling"), is_ordered=F.lit(False), comment=text("description"),
    )


def mssql_triggers(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Triggers on tables; `event` is the first of the properties that is set."""
    tables = _objects(frames, "tables", schemas).select(
        SOURCE, F.col("object_id").alias("parent_id"), "owner", F.col("name").alias("target_table")
    )
    events = F.array_compact(F.array(
        F.when(F.col("is_insert"), F.lit("INSERT")), F.when(F.col("is_update"), F.lit("UPDATE")),
        F.when(F.col("is_delete"), F.lit("DELETE")),
    ))
    triggers = _described(
        frames["triggers"].where("not is_ms_shipped").join(spread(tables), [SOURCE, "parent_id"]), frames
    ).withColumn("events", events)
    unknown = F.lit("UNKNOWN")
    return finish(
        triggers, "triggers", DIALECT,
        target_type=F.lit("TABLE"),
        timing=F.when(F.col("is_after"), F.lit("AFTER")).when(F.col("is_instead_of"), F.lit("INSTEAD OF")).otherwise(unknown),
        event=F.when(F.size("events") > 0, F.element_at("events", 1)).otherwise(unknown),
        level=F.lit("ROW"),
        status=F.when(F.col("is_disabled"), F.lit("DISABLED")).otherwise(F.lit("ENABLED")),
        comment=text("description"),
    )


def mssql_synonyms(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """The last two parts of the target name, without brackets."""
    parts = F.split(F.regexp_replace("base_object_name", r"[\[\]]", ""), r"\.")
    n = F.size(parts)
    return finish(
        _described(_objects(frames, "synonyms", schemas), frames), "synonyms", DIALECT,
        target_object=F.element_at(parts, -1),
        target_owner=F.when(n >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit("")),
        target_type=F.lit("TABLE"), is_public=F.lit(False), comment=text("description"),
    )
