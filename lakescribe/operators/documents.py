"""Nested JSON documents of whole databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut
from lakescribe.functions.text import rfc3339, seconds
from lakescribe.model import OBJECT_KINDS, Catalog, spread, union_all
from lakescribe.operators.numbering import total_by_group
from lakescribe.operators.parts import PIECE_BYTES, TASK_BYTES, by_size, pieces

_OWNED = ["source_id", "owner", "table_name"]


def _some(name: str | Column) -> Column:
    """Empty text, zero and empty lists are left out of the JSON."""
    value = F.col(name) if isinstance(name, str) else name
    return F.when(value != "", value)


def _nonzero(name: str) -> Column:
    return F.when(F.col(name) != 0, F.col(name))


def _listed(value: Column) -> Column:
    return F.when(F.size(value) > 0, value)


def _column() -> Column:
    return F.struct(
        F.col("name"), F.col("position"), F.col("data_type").alias("dataType"), _nonzero("length").alias("length"),
        _nonzero("precision").alias("precision"), _nonzero("scale").alias("scale"), F.col("nullable"),
        _some("default_value").alias("defaultValue"), _some("comment").alias("comment"),
        F.col("is_primary_key").alias("isPrimaryKey"), F.col("is_foreign_key").alias("isForeignKey"),
        F.col("is_unique").alias("isUnique"), _some("fk_target_table").alias("fkTargetTable"),
        _some("fk_target_column").alias("fkTargetColumn"), F.col("is_auto_increment").alias("isAutoIncrement"),
    )


def _index() -> Column:
    return F.struct(
        F.col("name"), F.col("table_name").alias("tableName"), _some("owner").alias("owner"), F.col("type"),
        F.col("columns"), F.col("is_unique").alias("isUnique"), F.col("is_primary").alias("isPrimary"),
        F.col("is_enabled").alias("isEnabled"), _some("comment").alias("comment"),
    )


def _nested(df: DataFrame, key: list[str], order: str, item: Column, name: str) -> DataFrame:
    """Items of one table in order; few, as databases limit the columns and indexes of a table."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v"))))
    return df.groupBy(*key).agg(F.transform(lines, lambda x: x["v"]).alias(name))


def _nested_objects(cat: Catalog) -> DataFrame:
    """Tables with their columns and indexes, views with their columns, and the indexes themselves.

    Tables and views join their columns together, and indexes come out of the table that they were
    nested in, so that each frame is read once.
    """
    tables = cat["tables"].select(
        "source_id", "owner", F.col("name").alias("table_name"), F.lit("TABLE").alias("object_kind"), "type", "comment",
        _nonzero("row_count").alias("row_count"), _some(seconds(F.col("created_at"))).alias("created_at"),
        _some(seconds(F.col("modified_at"))).alias("modified_at"), F.lit(None).cast("boolean").alias("is_updatable"),
    )
    views = cat["views"].select(
        "source_id", "owner", F.col("name").alias("table_name"), F.lit("VIEW").alias("object_kind"), "type", "comment",
        F.lit(None).cast("long").alias("row_count"), F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("modified_at"), "is_updatable",
    )
    columns = _nested(cat["columns"], [*_OWNED, "object_kind"], "position", _column(), "columns")
    indexes = _nested(cat["indexes"].withColumn("object_kind", F.lit("TABLE")), [*_OWNED, "object_kind"], "name",
                      _index(), "indexes")
    key = [*_OWNED, "object_kind"]
    joined = tables.unionByName(views).join(spread(columns), key, "left").join(spread(indexes), key, "left")
    whole = F.struct(
        F.when(F.col("object_kind") == "TABLE", F.lit("tables")).otherwise(F.lit("views")).alias("kind"),
        F.col("table_name").alias("name"),
        F.lit("").alias("detail"),
        F.to_json(F.struct(
            F.col("table_name").alias("name"), _some("owner").alias("owner"), F.col("type"), _some("comment").alias("comment"),
            F.coalesce("columns", F.array()).alias("columns"), F.col("indexes"), F.col("row_count").alias("rowCount"),
            F.col("is_updatable").alias("isUpdatable"), F.col("created_at").alias("createdAt"),
            F.col("modified_at").alias("modifiedAt"),
        )).alias("json"),
    )
    listed = F.transform(F.coalesce("indexes", F.array()), lambda i: F.struct(
        F.lit("indexes").alias("kind"), i["name"].alias("name"), F.col("table_name").alias("detail"),
        F.to_json(i).alias("json")))
    return joined.select("source_id", "owner", F.inline(F.concat(F.array(whole), listed))).select(
        "source_id", "kind", "owner", "name", "detail", "json")


def _objects(cat: Catalog) -> DataFrame:
    """(source_id, kind, owner, name, detail, json), one row per object."""
    def rows(kind: str, df: DataFrame, name: str, detail: Column, *fields: Column) -> DataFrame:
        return df.select(
            "source_id", F.lit(kind).alias("kind"), "owner", F.col(name).alias("name"), detail.alias("detail"),
            F.to_json(F.struct(*fields)).alias("json"),
        )

    none = F.lit("")
    owner, comment = _some("owner").alias("owner"), _some("comment").alias("comment")
    name, kind = F.col("name"), F.col("type")
    return union_all([
        _nested_objects(cat),
        rows("routines", cat["routines"], "name", F.col("signature"),
             name, owner, kind, comment, F.col("signature"),
             _listed(F.transform("arguments", lambda a: F.struct(
                 a["name"].alias("name"), a["position"].alias("position"), a["mode"].alias("mode"),
                 a["data_type"].alias("dataType"), _some(a["default_value"]).alias("defaultValue"),
             ))).alias("arguments"),
             _some("return_type").alias("returnType"), _some("language").alias("language")),
        rows("sequences", cat["sequences"], "name", none,
             name, owner, F.col("min_value").alias("minValue"), F.col("max_value").alias("maxValue"),
             F.col("increment"), F.col("last_number").alias("lastNumber"), _nonzero("cache_size").alias("cacheSize"),
             F.col("is_cyclic").alias("isCyclic"), F.col("is_ordered").alias("isOrdered"), comment),
        rows("triggers", cat["triggers"], "name", F.col("target_table"),
             name, owner, F.col("target_table").alias("targetTable"), F.col("target_type").alias("targetType"),
             F.col("timing"), F.col("event"), F.col("level"), F.col("status"), comment),
        rows("synonyms", cat["synonyms"], "name", none,
             name, owner, F.col("target_object").alias("targetObject"), _some("target_owner").alias("targetOwner"),
             _some("target_type").alias("targetType"), F.col("is_public").alias("isPublic"), comment),
    ])


def schema_documents(cat: Catalog, limit: int = PIECE_BYTES, task: int = TASK_BYTES) -> DataFrame:
    """(source_id, at, json): one nested document per database, its lists in the order of OBJECT_KINDS, each by
    owner, name and detail.

    The texts of a source in the order of `at` are its document, see `parts`; nearly all have one. Runs jobs when called.
    """
    objects = cut(_objects(cat), "zstd")
    head = F.to_json(F.struct(
        F.col("database_name").alias("databaseName"), F.col("database_type").alias("databaseType"), F.col("version"),
        rfc3339(F.col("extracted_at")).alias("extractedAt"),
    ))
    heads = cat["sources"].select("source_id", F.substring(head, F.lit(1), F.length(head) - 1).alias("head"))
    # with a comma for each object, and more than the head and the names of the lists have
    sizes = objects.groupBy("source_id").agg((F.sum(F.octet_length("json").cast("long") + 1) + 4_096).alias("bytes"))
    large, medium, huge = by_size(sizes, limit, task)
    small = objects if large is None else objects.join(large, "source_id", "left_anti")
    line = F.struct("owner", "name", "detail", "json")
    lists = small.groupBy("source_id").agg(
        *[F.array_join(
            F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, line))), lambda x: x["json"]), ","
          ).alias(kind)
          for kind in OBJECT_KINDS]
    )
    body = [
        F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit(f',"{kind}":['), F.col(kind), F.lit("]"))).otherwise(F.lit(""))
        for kind in OBJECT_KINDS
    ]
    few = heads if large is None else heads.join(large, "source_id", "left_anti")
    whole = few.join(spread(lists), "source_id", "left").select("source_id", F.lit(0).cast("long").alias("at"), F.concat("head", *body, F.lit("}")).alias("json"))
    if large is None:
        return whole
    order = ["place", "line", "owner", "name", "detail"]
    of = lambda sources: (objects.join(sources, "source_id", "left_semi"), heads.join(sources, "source_id", "left_semi"))
    whole = whole.unionByName(pieces(_lines_by_source(*of(medium)), order, limit, total_by_group).withColumnRenamed("text", "json"))
    return whole if huge is None else whole.unionByName(pieces(_document_lines(*of(huge)), order, limit).withColumnRenamed("text", "json"))


def _lines_by_source(objects: DataFrame, heads: DataFrame) -> DataFrame:
    """As `_document_lines`, of sources of which a task may hold all objects: the first of a list is found where they are sorted."""
    none, end = F.lit(""), len(OBJECT_KINDS) + 1
    place = F.array_position(F.array(*[F.lit(k) for k in OBJECT_KINDS]), F.col("kind")).cast("int")
    key = F.struct("owner", "name", "detail", "json")
    listed = Window.partitionBy("source_id", "kind").orderBy(key)
    line = lambda number, text, *names: F.struct(
        F.lit(number).alias("line"), *[(F.col(c) if c in names else none).alias(c) for c in ("owner", "name", "detail")], text.alias("text"))
    # what equals the first has no comma either
    own = line(1, F.concat(F.when(key == F.col("first"), none).otherwise(F.lit(",")), "json"), "owner", "name", "detail")
    begin, stop = line(0, F.concat(F.lit(',"'), F.col("kind"), F.lit('":['))), line(2, F.lit("]"))
    lists = (
        objects.repartition("source_id").withColumns({"first": F.first(key).over(listed), "rank": F.row_number().over(listed)})
        .select("source_id", place.alias("place"), F.inline(F.when(F.col("rank") == 1, F.array(begin, own, stop)).otherwise(F.array(own))))
    )
    ends = F.array(*[F.struct(F.lit(p).alias("place"), line(0, text).alias("line")) for p, text in ((0, F.col("head")), (end, F.lit("}")))])
    around = heads.repartition("source_id").select("source_id", F.inline(ends)).select("source_id", "place", "line.*")
    return lists.unionByName(around)


def _document_lines(objects: DataFrame, heads: DataFrame) -> DataFrame:
    """(source_id, place, line, owner, name, detail, text): the documents line by line; place orders the lists."""
    none, end = F.lit(""), len(OBJECT_KINDS) + 1
    place = F.array_position(F.array(*[F.lit(k) for k in OBJECT_KINDS]), F.col("kind")).cast("int")
    key = F.struct("owner", "name", "detail", "json")
    # the first object of a list has no comma before it; as a list may be long, it is found by grouping, not by a window
    first = objects.groupBy("source_id", "kind").agg(F.min(key).alias("first"))
    marked = objects.join(spread(first), ["source_id", "kind"])
    comma = F.when(key == F.col("first"), none).otherwise(F.lit(","))
    fixed = lambda df, place_, line, text: df.select(
        "source_id", place_.alias("place"), F.lit(line).alias("line"), none.alias("owner"), none.alias("name"), none.alias("detail"), text.alias("text"))
    return union_all([
        fixed(heads, F.lit(0), 0, F.col("head")),
        fixed(first, place, 0, F.concat(F.lit(',"'), F.col("kind"), F.lit('":['))),
        marked.select("source_id", place.alias("place"), F.lit(1).alias("line"), "owner", "name", "detail", F.concat(comma, "json").alias("text")),
        fixed(first, place, 2, F.lit("]")),
        fixed(heads, F.lit(end), 0, F.lit("}")),
    ])
