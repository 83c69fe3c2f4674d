"""PostgreSQL catalog relations to canonical frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.signature import postgresql_signature
from lakescribe.model import spread
from lakescribe.operators.catalog_common import Frames, finish, first_target, flag, no_arguments, ordered, text
from lakescribe.operators.filters import Schemas, filter_schemas

DIALECT = "postgresql"
SOURCE = "source_id"

# Bits of pg_trigger.tgtype.
ROW, BEFORE, INSERT, DELETE, UPDATE, TRUNCATE, INSTEAD = 1, 2, 4, 8, 16, 32, 64
RELKINDS = {"r": "TABLE", "p": "PARTITIONED", "v": "VIEW", "m": "MATERIALIZED VIEW", "S": "SEQUENCE"}


def _relations(frames: Frames, schemas: Schemas, *kinds: str) -> DataFrame:
    """(source_id, relid, owner, relation, relkind, live_tuples) of the wanted kinds and owners."""
    namespaces = filter_schemas(
        frames["pg_namespace"].select(SOURCE, F.col("oid").alias("relnamespace"), F.col("nspname").alias("owner")),
        DIALECT, schemas,
    )
    relations = frames["pg_class"]
    if kinds:
        relations = relations.where(F.col("relkind").isin(*kinds))
    return relations.join(spread(namespaces), [SOURCE, "relnamespace"]).select(
        SOURCE, F.col("oid").alias("relid"), "owner", F.col("relname").alias("relation"), "relkind", "live_tuples"
    )


def _comments(frames: Frames, classname: str, key: str) -> DataFrame:
    """Comments of whole objects; the same oid may mean another object in another catalog."""
    return frames["pg_description"].where((F.col("objsubid") == 0) & (F.col("classname") == classname)).select(
        SOURCE, F.col("objoid").alias(key), F.col("description").alias("comment")
    )


def _table_kinds(include_partitioned: bool) -> tuple[str, ...]:
    return ("r", "p") if include_partitioned else ("r",)


def _view_kinds(include_materialized: bool) -> tuple[str, ...]:
    return ("v", "m") if include_materialized else ("v",)


def pg_tables(frames: Frames, schemas: Schemas = None, include_partitioned: bool = False) -> DataFrame:
    relations = _relations(frames, schemas, *_table_kinds(include_partitioned))
    commented = relations.join(spread(_comments(frames, "pg_class", "relid")), [SOURCE, "relid"], "left")
    return finish(
        commented, "tables", DIALECT,
        name=F.col("relation"),
        type=F.when(F.col("relkind") == "p", F.lit("PARTITIONED")).otherwise(F.lit("TABLE")),
        comment=text("comment"),
        row_count=F.coalesce("live_tuples", F.lit(0)),
        created_at=F.lit(None), modified_at=F.lit(None),
    )


def _key_marks(frames: Frames) -> DataFrame:
    """Key flags per attribute. The key arrays of indexes and constraints are exploded and folded in
    one grouping, which is partitioned like the attributes that it joins."""
    def marks(df: DataFrame, relid: str, keys: str, **flags: Column) -> DataFrame:
        return df.select(SOURCE, F.col(relid).alias("relid"), F.explode(keys).alias("attnum"),
                         *[v.alias(k) for k, v in flags.items()])

    no = F.lit(False)
    indexes = marks(
        frames["pg_index"].where("indisunique or indisprimary"), "indrelid", "indkey",
        pk=F.col("indisprimary"), fk=no, uk=F.col("indisunique") & ~F.col("indisprimary"),
    )
    constraints = marks(
        frames["pg_constraint"].where("contype = 'f'"), "conrelid", "conkey", pk=no, fk=F.lit(True), uk=no
    )
    return indexes.unionByName(constraints).groupBy(SOURCE, "relid", "attnum").agg(
        F.bool_or("pk").alias("pk"), F.bool_or("fk").alias("fk"), F.bool_or("uk").alias("uk")
    )


def _fk_targets(frames: Frames) -> DataFrame:
    """Target per (source, relid, attnum): key columns paired by ordinal, first constraint by name."""
    pairs = frames["pg_constraint"].where("contype = 'f'").select(
        SOURCE, "conname", F.col("conrelid").alias("relid"), F.col("confrelid").alias("target"),
        F.explode(F.arrays_zip("conkey", "confkey")).alias("pair"),
    ).select(SOURCE, "conname", "relid", "target", F.col("pair.conkey").alias("attnum"),
             F.col("pair.confkey").alias("target_attnum"))
    parents = frames["pg_class"].select(
        SOURCE, F.col("oid").alias("target"), F.col("relname").alias("target_name"), "relnamespace"
    ).join(
        spread(frames["pg_namespace"].select(SOURCE, F.col("oid").alias("relnamespace"), "nspname")), [SOURCE, "relnamespace"]
    ).select(SOURCE, "target", F.concat_ws(".", "nspname", "target_name").alias("fk_target_table"))
    parent_columns = frames["pg_attribute"].select(
        SOURCE, F.col("attrelid").alias("target"), F.col("attnum").alias("target_attnum"),
        F.col("attname").alias("fk_target_column"),
    )
    named = pairs.join(spread(parents), [SOURCE, "target"]).join(spread(parent_columns), [SOURCE, "target", "target_attnum"])
    return first_target(named, [SOURCE, "relid", "attnum"], "conname", "fk_target_table", "fk_target_column")


def pg_fktarget(frames: Frames, schemas: Schemas = None) -> DataFrame:
    attributes = frames["pg_attribute"].select(
        SOURCE, F.col("attrelid").alias("relid"), "attnum", F.col("attname").alias("column_name")
    )
    return (
        _fk_targets(frames)
        .join(spread(_relations(frames, schemas)), [SOURCE, "relid"])
        .join(spread(attributes), [SOURCE, "relid", "attnum"])
        .select(SOURCE, "owner", F.col("relation").alias("table_name"), "column_name",
                "fk_target_table", "fk_target_column")
    )


def pg_columns(
    frames: Frames, schemas: Schemas = None, include_partitioned: bool = False, include_materialized: bool = False
) -> DataFrame:
    """Columns of tables and views. The joins by attribute all use one partitioning."""
    views = _view_kinds(include_materialized)
    relations = _relations(frames, schemas, *_table_kinds(include_partitioned), *views)
    live = frames["pg_attribute"].where("attnum > 0 and not attisdropped").withColumnRenamed("attrelid", "relid")
    key = [SOURCE, "relid", "attnum"]
    defaults = frames["pg_attrdef"].select(
        SOURCE, F.col("adrelid").alias("relid"), F.col("adnum").alias("attnum"), "expr_text"
    )
    comments = frames["pg_description"].where("objsubid > 0 and classname = 'pg_class'").select(
        SOURCE, F.col("objoid").alias("relid"), F.col("objsubid").alias("attnum"), F.col("description").alias("comment")
    )
    described = (
        live.join(spread(defaults), key, "left")
        .join(spread(comments), key, "left")
        .join(spread(_key_marks(frames)), key, "left")
        .join(spread(_fk_targets(frames)), key, "left")
        .join(spread(relations), [SOURCE, "relid"])
    )
    zero = F.lit(0)
    return finish(
        described, "columns", DIALECT,
        table_name=F.col("relation"),
        object_kind=F.when(F.col("relkind").isin(*views), F.lit("VIEW")).otherwise(F.lit("TABLE")),
        name=F.col("attname"), position=F.col("attnum"), data_type=F.col("format_type"),
        length=zero, precision=zero, scale=zero,  # part of the type text
        nullable=~F.col("attnotnull"),
        default_value=text("expr_text"), comment=text("comment"),
        is_primary_key=flag("pk"), is_foreign_key=flag("fk"), is_unique=flag("uk"),
        fk_target_table=text("fk_target_table"), fk_target_column=text("fk_target_column"),
        is_auto_increment=text("expr_text").contains("nextval"),
    )


def pg_indexes(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Indexes by oid, never by table name alone, which another schema may have as well."""
    index_class = frames["pg_class"].select(
        SOURCE, F.col("oid").alias("indexrelid"), F.col("relname").alias("index_name"), F.col("relam").alias("am")
    )
    methods = frames["pg_am"].select(SOURCE, F.col("oid").alias("am"), "amname")
    attributes = frames["pg_attribute"].select(SOURCE, F.col("attrelid").alias("indrelid"), "attnum", "attname")
    columns = (
        frames["pg_index"]
        .select(SOURCE, "indexrelid", "indrelid", F.posexplode("indkey").alias("place", "attnum"))
        .join(spread(attributes), [SOURCE, "indrelid", "attnum"])
        .groupBy(SOURCE, "indexrelid")
        .agg(ordered("place", F.col("attname")).alias("columns"))
    )
    tables = _relations(frames, schemas).withColumnRenamed("relid", "indrelid")
    named = (
        frames["pg_index"]
        .join(spread(index_class), [SOURCE, "indexrelid"])
        .join(spread(methods), [SOURCE, "am"])
        .join(spread(_comments(frames, "pg_class", "indexrelid")), [SOURCE, "indexrelid"], "left")
        .join(spread(columns), [SOURCE, "indexrelid"], "left")
        .join(spread(tables), [SOURCE, "indrelid"])
    )
    return finish(
        named, "indexes", DIALECT,
        table_name=F.col("relation"), name=F.col("index_name"), type=F.col("amname"),
        columns=F.coalesce("columns", F.array().cast("array<string>")),
        is_unique=F.col("indisunique"), is_primary=F.col("indisprimary"), is_enabled=F.lit(True),
        comment=text("comment"),
    )


def pg_views(frames: Frames, schemas: Schemas = None, include_materialized: bool = False) -> DataFrame:
    updatable = frames["views"].select(
        SOURCE, F.col("table_schema").alias("owner"), F.col("table_name").alias("relation"), "is_updatable"
    )
    views = (
        _relations(frames, schemas, *_view_kinds(include_materialized))
        .join(spread(_comments(frames, "pg_class", "relid")), [SOURCE, "relid"], "left")
        .join(spread(updatable), [SOURCE, "owner", "relation"], "left")
    )
    return finish(
        views, "views", DIALECT,
        name=F.col("relation"),
        type=F.when(F.col("relkind") == "m", F.lit("MATERIALIZED VIEW")).otherwise(F.lit("VIEW")),
        comment=text("comment"), is_updatable=F.coalesce(F.col("is_updatable") == "YES", F.lit(False)),
    )


def pg_routines(frames: Frames, schemas: Schemas = None) -> DataFrame:
    namespaces = filter_schemas(
        frames["pg_namespace"].select(SOURCE, F.col("oid").alias("pronamespace"), F.col("nspname").alias("owner")),
        DIALECT, schemas,
    )
    languages = frames["pg_language"].select(SOURCE, F.col("oid").alias("prolang"), "lanname")
    routines = (
        frames["pg_proc"].where(F.col("prokind").isin("f", "p"))
        .join(spread(namespaces), [SOURCE, "pronamespace"])
        .join(spread(languages), [SOURCE, "prolang"])
        .join(spread(_comments(frames, "pg_proc", "oid")), [SOURCE, "oid"], "left")
        .withColumn("type", F.when(F.col("prokind") == "p", F.lit("PROCEDURE")).otherwise(F.lit("FUNCTION")))
    )
    return finish(
        routines, "routines", DIALECT,
        name=F.col("proname"), comment=text("comment"),
        signature=postgresql_signature(F.col("type"), F.col("proname"), text("identity_args"), text("return_type")),
        return_type=F.when(F.col("type") == "FUNCTION", text("return_type")).otherwise(F.lit("")),
        language=F.col("lanname"), arguments=no_arguments(),
    )


def pg_sequences(frames: Frames, schemas: Schemas = None) -> DataFrame:
    sequences = (
        _relations(frames, schemas, "S")
        .join(spread(frames["pg_sequences"].withColumnRenamed("seqrelid", "relid")), [SOURCE, "relid"])
        .join(spread(_comments(frames, "pg_class", "relid")), [SOURCE, "relid"], "left")
    )
    return finish(
        sequences, "sequences", DIALECT,
        name=F.col("relation"), min_value=F.col("seqmin"), max_value=F.col("seqmax"), increment=F.col("seqincrement"),
        last_number=F.coalesce("last_value", F.lit(0)), cache_size=F.lit(0), is_cyclic=F.col("seqcycle"),
        is_ordered=F.lit(False), comment=text("comment"),
    )


def _has(bit: int) -> Column:
    return F.col("tgtype").bitwiseAND(F.lit(bit)) == bit


def pg_triggers(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Timing, event and level from the bits of the trigger type; `event` is the first in the fixed order."""
    events = F.array_compact(F.array(
        F.when(_has(INSERT), F.lit("INSERT")), F.when(_has(DELETE), F.lit("DELETE")),
        F.when(_has(UPDATE), F.lit("UPDATE")), F.when(_has(TRUNCATE), F.lit("TRUNCATE")),
    ))
    triggers = (
        frames["pg_trigger"].where("not tgisinternal").withColumnRenamed("tgrelid", "relid")
        .join(spread(_relations(frames, schemas)), [SOURCE, "relid"])
        .join(spread(_comments(frames, "pg_trigger", "oid")), [SOURCE, "oid"], "left")
        .withColumn("events", events)
    )
    return finish(
        triggers, "triggers", DIALECT,
        name=F.col("tgname"), target_table=F.col("relation"), target_type=F.lit("TABLE"),
        timing=F.when(_has(BEFORE), F.lit("BEFORE")).when(_has(INSTEAD), F.lit("INSTEAD OF")).otherwise(F.lit("AFTER")),
        event=F.when(F.size("events") > 0, F.element_at("events", 1)).otherwise(F.lit("TRUNCATE")),
        level=F.when(_has(ROW), F.lit("ROW")).otherwise(F.lit("STATEMENT")),
        status=F.when(F.col("tgenabled") == "O", F.lit("ENABLED")).otherwise(F.lit("DISABLED")),
        comment=text("comment"),
    )
