"""Oracle dictionary views to canonical frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.signature import oracle_signature
from lakescribe.model import spread
from lakescribe.operators.catalog_common import (
    Frames,
    argument,
    finish,
    flag,
    number,
    ordered,
    text,
)
from lakescribe.operators.filters import Schemas, filter_schemas

DIALECT = "oracle"
SOURCE = "source_id"
TABLE = [SOURCE, "owner", "table_name"]
COLUMN = [*TABLE, "column_name"]


def _kept(frames: Frames, relation: str, schemas: Schemas, owner: str = "owner") -> DataFrame:
    return filter_schemas(frames[relation], DIALECT, schemas, owner)


def ora_tables(frames: Frames, schemas: Schemas = None) -> DataFrame:
    commented = _kept(frames, "all_tables", schemas).join(spread(frames["all_tab_comments"]), TABLE, "left")
    return finish(
        commented, "tables", DIALECT,
        name=F.col("table_name"), type=F.lit("TABLE"), comment=text("comments"), row_count=number("num_rows", "long"),
        created_at=F.col("created"), modified_at=F.col("last_ddl_time"),
    )


def ora_constraints(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Constraint rows folded to one row per column; foreign keys are paired by position and the first
    constraint by name gives the target."""
    wanted = _kept(frames, "all_constraints", schemas).where(F.col("constraint_type").isin("P", "R", "U"))
    own = frames["all_cons_columns"].select(SOURCE, "owner", "constraint_name", "column_name", "position")
    # The referenced constraint's columns name its table as well.
    referenced = frames["all_cons_columns"].select(
        SOURCE, F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), "position",
        F.col("table_name").alias("r_table"), F.col("column_name").alias("r_column"),
    )
    rows = wanted.join(spread(own), [SOURCE, "owner", "constraint_name"]).join(
        spread(referenced), [SOURCE, "r_owner", "r_constraint_name", "position"], "left"
    )
    kind = F.col("constraint_type")
    target = F.min(F.when((kind == "R") & F.col("r_column").isNotNull(),
                          F.struct("constraint_name", "r_table", "r_column")))
    return rows.groupBy(*COLUMN).agg(
        F.bool_or(kind == "P").alias("is_primary_key"),
        F.bool_or(kind == "R").alias("is_foreign_key"),
        F.bool_or(kind == "U").alias("is_unique"),
        target.alias("target"),
    ).select(
        *COLUMN, "is_primary_key", "is_foreign_key", "is_unique",
        text(F.col("target.r_table")).alias("fk_target_table"), text(F.col("target.r_column")).alias("fk_target_column"),
    )


def ora_columns(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Columns of tables and views; the length is the declared character length."""
    kinds = frames["all_tables"].select(*TABLE, F.lit("TABLE").alias("object_kind")).unionByName(
        frames["all_views"].select(SOURCE, "owner", F.col("view_name").alias("table_name"),
                                   F.lit("VIEW").alias("object_kind"))
    )
    joined = (
        _kept(frames, "all_tab_columns", schemas)
        .join(spread(frames["all_col_comments"]), COLUMN, "left")
        .join(spread(ora_constraints(frames, schemas)), COLUMN, "left")
        .join(spread(kinds), TABLE)
    )
    return finish(
        joined, "columns", DIALECT,
        name=F.col("column_name"), position=F.col("column_id"), data_type=text("data_type"),
        length=number("char_col_decl_length"), precision=number("data_precision"), scale=number("data_scale"),
        nullable=F.col("nullable") == "Y", default_value=F.trim(text("data_default")), comment=text("comments"),
        is_primary_key=flag("is_primary_key"), is_foreign_key=flag("is_foreign_key"), is_unique=flag("is_unique"),
        fk_target_table=text("fk_target_table"), fk_target_column=text("fk_target_column"),
        is_auto_increment=F.lit(False),
    )


def ora_indexes(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """An index is primary when a primary key constraint of its table has its name."""
    index = [SOURCE, "index_owner", "index_name"]
    columns = frames["all_ind_columns"].groupBy(*index).agg(
        ordered("column_position", F.col("column_name")).alias("columns")
    )
    comments = frames["all_ind_comments"].withColumnRenamed("owner", "index_owner")
    primaries = frames["all_constraints"].where("constraint_type = 'P'").select(
        SOURCE, F.col("owner").alias("table_owner"), "table_name", F.col("constraint_name").alias("index_name"),
        F.lit(True).alias("is_primary"),
    )
    indexes = (
        _kept(frames, "all_indexes", schemas, "table_owner").withColumnRenamed("owner", "index_owner").distinct()
        .join(spread(comments), index, "left")
        .join(spread(columns), index, "left")
        .join(spread(primaries), [SOURCE, "table_owner", "table_name", "index_name"], "left")
    )
    return finish(
        indexes, "indexes", DIALECT,
        owner=F.col("table_owner"), name=F.col("index_name"), type=F.col("index_type"),
        columns=F.coalesce("columns", F.array().cast("array<string>")),
        is_unique=text("uniqueness") == "UNIQUE", is_primary=flag("is_primary"), is_enabled=F.lit(True),
        comment=text("comments"),
    )


def ora_views(frames: Frames, schemas: Schemas = None) -> DataFrame:
    views = _kept(frames, "all_views", schemas).withColumnRenamed("view_name", "table_name")
    return finish(
        views.join(spread(frames["all_tab_comments"]), TABLE, "left"), "views", DIALECT,
        name=F.col("table_name"), type=F.lit("VIEW"), comment=text("comments"),
        is_updatable=text("read_only") != "Y",
    )


def ora_routines(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Standalone routines and package members.

    The dictionary lists a member under its package, with the member as procedure name; the package itself
    has none. Overloads differ by their number in the package, by which their arguments are found. A member
    is a function if it has an argument without a name at position 0, its result.
    """
    standalone = text("procedure_name") == ""
    key = [SOURCE, "owner", "package_name", "routine", "subprogram"]
    routines = (
        _kept(frames, "all_procedures", schemas)
        .where(F.col("object_type").isin("PROCEDURE", "FUNCTION") | ((F.col("object_type") == "PACKAGE") & ~standalone))
        .withColumns({
            "package_name": F.when(standalone, F.lit("")).otherwise(F.col("object_name")),
            "routine": F.when(standalone, F.col("object_name")).otherwise(F.col("procedure_name")),
            "name": F.when(standalone, F.col("object_name")).otherwise(F.concat_ws(".", "object_name", "procedure_name")),
            "subprogram": F.when(standalone, F.lit(0)).otherwise(F.coalesce("subprogram_id", F.lit(0))),
        })
    )
    arguments = frames["all_arguments"].withColumns({
        "package_name": text("package_name"), "routine": F.col("object_name"),
        "subprogram": F.when(text("package_name") == "", F.lit(0)).otherwise(F.coalesce("subprogram_id", F.lit(0))),
    })
    listed = (
        arguments.where("argument_name is not null")
        .groupBy(*key)
        .agg(ordered("position", argument(
            F.col("argument_name"), F.col("position"), F.col("in_out"), F.col("data_type"), text("default_value")
        )).alias("arguments"))
    )
    results = arguments.where("argument_name is null and position = 0").select(*key).distinct().withColumn("has_result", F.lit(True))
    comments = frames["all_tab_comments"].select(SOURCE, "owner", F.col("table_name").alias("object_name"), "comments")
    member = F.when(F.col("has_result"), F.lit("FUNCTION")).otherwise(F.lit("PROCEDURE"))
    joined = (
        routines.join(spread(listed), key, "left").join(spread(results), key, "left").join(spread(comments), [SOURCE, "owner", "object_name"], "left")
        .withColumn("type", F.when(F.col("object_type") == "PACKAGE", member).otherwise(F.col("object_type"))))
    return finish(
        joined, "routines", DIALECT,
        comment=text("comments"), signature=oracle_signature(F.col("type"), F.col("name"), F.col("arguments")),
        return_type=F.lit(""), language=F.lit("PL/SQL"), arguments=F.coalesce("arguments", F.array()),
    )


def ora_sequences(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return finish(
        _kept(frames, "all_sequences", schemas, "sequence_owner"), "sequences", DIALECT,
        owner=F.col("sequence_owner"), name=F.col("sequence_name"), increment=F.col("increment_by"),
        cache_size=number("cache_size"), is_cyclic=text("cycle_flag") == "Y", is_ordered=text("order_flag") == "Y",
        comment=F.lit(""),
    )


def ora_triggers(frames: Frames, schemas: Schemas = None) -> DataFrame:
    """Timing is the first word of the trigger type, or the two words INSTEAD OF."""
    kind, event = text("trigger_type"), text("triggering_event")
    return finish(
        _kept(frames, "all_triggers", schemas), "triggers", DIALECT,
        name=F.col("trigger_name"), target_table=text("table_name"), target_type=F.lit("TABLE"),
        timing=F.when(kind.startswith("INSTEAD OF"), F.lit("INSTEAD OF")).otherwise(
            F.element_at(F.split(F.trim(kind), r"\s+"), 1)
        ),
        event=event, events=F.split(event, r"\s+OR\s+"),
        level=F.when(kind.contains("EACH ROW"), F.lit("ROW")).otherwise(F.lit("STATEMENT")),
        comment=F.lit(""),
    )


def ora_synonyms(frames: Frames, schemas: Schemas = None) -> DataFrame:
    return finish(
        _kept(frames, "all_synonyms", schemas), "synonyms", DIALECT,
        name=F.col("synonym_name"), target_object=F.col("table_name"), target_owner=text("table_owner"),
        target_type=F.lit("TABLE"), is_public=F.col("owner") == "PUBLIC", comment=F.lit(""),
    )
