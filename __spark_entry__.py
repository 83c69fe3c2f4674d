"""Queries of the engine over the test tables, and the SQL that they are compared with."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleet import native, seed  # noqa: E402
from lakescribe.functions.dialect import split_dialects  # noqa: E402
from lakescribe.functions.scratch import new_folder  # noqa: E402
from lakescribe.functions.text import escape_markup, rfc3339, seconds  # noqa: E402
from lakescribe.model import OBJECT_KINDS, Catalog, spread, union_all  # noqa: E402
from lakescribe.operators import audit, distincts, docs, enrich, file_facts, keys, pages, profiles  # noqa: E402
from lakescribe.operators import catalog_oracle as ora  # noqa: E402
from lakescribe.operators import catalog_mssql as ms  # noqa: E402
from lakescribe.operators import catalog_mysql as my  # noqa: E402
from lakescribe.operators import catalog_pg as pg  # noqa: E402
from lakescribe.operators.documents import schema_documents  # noqa: E402
from lakescribe.operators.parts import PIECE_BYTES  # noqa: E402
from lakescribe.operators.filters import ALL, ObjectFilter  # noqa: E402
from lakescribe.plans.document_lake import document_lake  # noqa: E402
from lakescribe.plans.extract import NORMALISERS, ExtractConfig, extract  # noqa: E402
from lakescribe.functions.values import INTEGER, STRING, quoted, scalar_columns, type_class  # noqa: E402
from lakescribe.sinks import write_pages, write_sheets  # noqa: E402
from lakescribe.sources import compact_snapshot, read_snapshot, read_tables, snapshot_changes, write_snapshot  # noqa: E402
from oracles import fleet_sql, lake_sql, text_sql  # noqa: E402

try:
    from lakescribe.llm import queries as llm_queries
except ModuleNotFoundError as error:  # the subpackage is away; a package that it needs must not be
    if not (error.name or "").startswith("lakescribe.llm"):
        raise
    llm_queries = None
try:
    import corpus_pipeline
except ModuleNotFoundError as error:
    if error.name != "corpus_pipeline" and not (error.name or "").startswith("lakescribe.llm"):
        raise
    corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
LAKE_TIME = datetime(2025, 1, 1, tzinfo=timezone.utc)
FLEET_TIME = datetime(2025, 1, 31, 9, tzinfo=timezone.utc)

COMPOSITE_KEYS = [("conversations", ["conv_id", "turn"]), ("lineitem", ["l_orderkey", "l_linenumber"])]
# Declared pairs: seven that hold, and two whose parents miss some children.
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("lineitem", "l_partkey", "supplier", "s_suppkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]
# Declared pairs of column lists, the second of which does not hold.
COMPOSITE_FOREIGN_KEYS = [
    ("conversations", ["conv_id", "turn"], "lineitem", ["l_orderkey", "l_linenumber"]),
    ("lineitem", ["l_partkey", "l_suppkey"], "lineitem", ["l_suppkey", "l_partkey"]),
    ("lineitem", ["l_orderkey", "l_linenumber"], "lineitem", ["l_orderkey", "l_linenumber"]),
]
# Keys of many digits, made of integer columns: table, name, column, factor, summand.
DECIMAL_KEYS = [
    ("orders", "far", "o_orderkey", "1000000000000000000000", "-5000000000000000000000000000000"), ("customer", "dense", "c_custkey", "1", "70000000000000000000000000000"),
    ("supplier", "stepped", "s_suppkey", "900719925474099300", "0"), ("customer", "repeated", "c_nationkey", "3", "1"),
]
APPENDED = ("region", "nation", "customer", "supplier", "orders", "lineitem", "documents", "embeddings")
KEYED = ("conversations", "lineitem", "orders", "nation", "supplier", "labels")


# --- measured lake --------------------------------------------------------------------------------


def _lake(spark: SparkSession, sf_dir: str, names=lake_sql.TABLES) -> dict[str, DataFrame]:
    return read_tables(spark, sf_dir, names)


def _lake_catalog(spark: SparkSession, sf_dir: str, names=lake_sql.TABLES) -> Catalog:
    return document_lake(_lake(spark, sf_dir, names), version="1", extracted_at=LAKE_TIME)


def _on_lake(operator: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_lake(spark, sf_dir))


def _contents(tables: dict[str, DataFrame]) -> DataFrame:
    """Of every scalar column: values, and the sum of integers or of the lengths of strings."""
    def facts(field: T.StructField) -> dict[str, str]:
        c = quoted(field.name)
        totals = {INTEGER: f"sum(CAST({c} AS bigint))", STRING: f"sum(CAST(length({c}) AS bigint))"}
        return {"n_values": f"count({c})", "total": totals.get(type_class(field.dataType), "CAST(NULL AS bigint)")}

    return profiles.per_column(tables, scalar_columns, facts)


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return new_folder(spark, "landed")


def _with_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables have no nulls, so some are put in."""
    customer = tables["customer"].withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return profiles.null_profile({**tables, "customer": customer})


def _wide_numbers(tables: dict[str, DataFrame]) -> DataFrame:
    """Numbers with more digits than the tables have."""
    wide = tables["customer"].selectExpr(
        "c_custkey / 1e9D AS small",
        "c_acctbal * 1e33D AS huge",
        "CAST(c_custkey AS decimal(20,8)) + CAST('0.12345678' AS decimal(20,8)) AS fine",
        "CAST(concat('12345678901234567890123456789012345', c_custkey % 10) AS decimal(38,0)) AS long",
    )
    return profiles.numeric_profile({"wide": wide})


def _decimal_sequences(tables: dict[str, DataFrame]) -> DataFrame:
    wide: dict[str, list[str]] = {}
    for table, name, source, factor, shift in DECIMAL_KEYS:
        wide.setdefault(table, []).append(f"CAST(CAST({source} AS decimal(12,0)) * CAST('{factor}' AS decimal(24,0)) + CAST('{shift}' AS decimal(38,0)) AS decimal(38,0)) AS {name}")
    return _flat(keys.decimal_sequence_profile({t: tables[t].selectExpr(*made) for t, made in wide.items()}))


def _file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of tables that grew: half of each lands and is measured, then the other half."""
    folder = _folder(spark)
    paths = {name: f"{folder}/tables/{name}" for name in APPENDED}
    for half in (0, 1):
        for name, df in _lake(spark, sf_dir, APPENDED).items():
            df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(2)) == half).write.mode("append").parquet(paths[name])
        file_facts.measure_files(spark, paths, f"{folder}/facts")
    return file_facts.file_profile(spark, paths, f"{folder}/facts").drop("n_odd", "min_hash", "max_hash", "bits_low", "bits_high")


def _composite_keys(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([
        keys.check_key(tables[table], columns).select(
            F.lit(table).alias("table_name"), F.lit(", ".join(columns)).alias("columns"), "*")
        for table, columns in COMPOSITE_KEYS
    ])


def _suggestions(tables: dict[str, DataFrame]) -> DataFrame:
    return keys.suggest_foreign_keys(distincts.inclusion_dependencies(tables))


def _escaped(tables: dict[str, DataFrame]) -> DataFrame:
    documents = tables["documents"].select(
        F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), escape_markup(F.col("text")).alias("escaped"))
    raw = tables["pages"].select(F.lit("pages"), "page_id", escape_markup(F.col("html")))
    return documents.union(raw)


# --- fleet ----------------------------------------------------------------------------------------


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tables(spark, sf_dir, ["customer"])["customer"]


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of MySQL dumps that were landed in two runs, one source in five twice."""
    frames, path = _dump(spark, sf_dir, "mysql"), _folder(spark)
    for wanted in ("source_id % 2 = 0 OR source_id % 5 = 0", "source_id % 2 = 1 OR source_id % 5 = 0"):
        write_snapshot({k: df.where(wanted) for k, df in frames.items()}, path, "mysql", buckets=4)
    return _flat(my.mysql_tables(read_snapshot(spark, path, "mysql"), ALL))


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of MySQL dumps from a base of two runs and a run after it. What older runs say of a source must not show."""
    frames, path = _dump(spark, sf_dir, "mysql"), _folder(spark)
    write_snapshot({k: df.where("source_id % 3 < 2") if k != "tables" else df.where("source_id % 3 = 0") for k, df in frames.items()}, path, "mysql", buckets=4)
    write_snapshot({k: df.where("source_id % 3 > 0") for k, df in frames.items()}, path, "mysql", buckets=4)
    compact_snapshot(spark, path, "mysql", buckets=4)
    write_snapshot({k: df.where("source_id % 4 = 0") for k, df in frames.items()}, path, "mysql", buckets=4)
    return _flat(my.mysql_tables(read_snapshot(spark, path, "mysql"), ALL))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run changed: of one source in three, long names are gone and the tables named Dienst have other counts."""
    frames, path = _dump(spark, sf_dir, "mysql"), _folder(spark)
    first = write_snapshot(frames, path, "mysql", buckets=4)
    again = {k: df.where("source_id % 3 = 0 OR source_id % 5 = 0") for k, df in frames.items()}
    again["tables"] = again["tables"].where("source_id % 3 <> 0 OR length(table_name) <= 8").withColumn(
        "table_rows", F.expr("CASE WHEN source_id % 3 = 0 AND table_name = 'Dienst' THEN table_rows + 1 ELSE table_rows END"))
    second = write_snapshot(again, path, "mysql", buckets=4)
    found = snapshot_changes(spark, path, "mysql", "tables", first, second).where("table_type = 'BASE TABLE'")
    return found.select("source_id", F.col("table_schema").alias("owner"), F.col("table_name").alias("name"), F.col("table_rows").alias("row_count"), "change", "copies")


def _column_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    write_sheets(_catalog(spark, sf_dir, ALL, None, True), path, buckets=4)
    return spark.read.parquet(f"{path}/Columns").drop("source_bucket")


def _landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    write_pages(pages.table_pages(_catalog(spark, sf_dir, ALL, None, True)), path, buckets=4)
    return spark.read.parquet(path).drop("source_bucket")


def _dump(spark: SparkSession, sf_dir: str, dialect: str) -> dict[str, DataFrame]:
    return native.BUILDERS[dialect](_customer(spark, sf_dir))


def _catalog(spark: SparkSession, sf_dir: str, schemas=ALL, objects: ObjectFilter | None = None, staged: bool = False) -> Catalog:
    cfg = ExtractConfig(schemas=schemas, objects=objects or ObjectFilter(), extracted_at=FLEET_TIME, staged=staged)
    return extract(native.fleet(_customer(spark, sf_dir)), cfg)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays, times and wide decimals as text, so that both engines show them alike."""
    shown = []
    for field in df.schema.fields:
        value, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            value = F.array_join(F.transform(value, lambda a: F.concat_ws(
                ":", a["name"], a["position"].cast("string"), a["mode"], a["data_type"], a["default_value"])), ";")
        elif isinstance(kind, T.ArrayType):
            value = F.array_join(value, ",")
        elif isinstance(kind, T.TimestampType):
            value = seconds(value)
        elif isinstance(kind, T.DecimalType):
            value = value.cast("string")
        shown.append(value.alias(field.name))
    return df.select(*shown)


def _normaliser(dialect: str, operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: _flat(operator(_dump(spark, sf_dir, dialect), ALL))


def _on_fleet(operator: Callable[[Catalog], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_catalog(spark, sf_dir))


def _on_staged_fleet(operator: Callable[[Catalog], DataFrame]) -> Query:
    """For reports that read most of a catalog."""
    return lambda spark, sf_dir: operator(_catalog(spark, sf_dir, ALL, None, True))


def _on_lake_catalog(operator: Callable[[Catalog], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_lake_catalog(spark, sf_dir))


def _source_info(cat: Catalog) -> DataFrame:
    return cat["sources"].withColumn("extracted_at", rfc3339(F.col("extracted_at")))


def _dialect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = split_dialects(native.registry(_customer(spark, sf_dir)), "raw")
    none = F.lit("")
    return good.select("source_id", "raw", "dialect", none.alias("error")).unionByName(
        bad.select("source_id", "raw", none.alias("dialect"), "error"))


def _tables_of(schemas) -> Query:
    return lambda spark, sf_dir: _catalog(spark, sf_dir, schemas)["tables"].select("source_id", "dialect", "owner", "name")


def _filtered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = _catalog(spark, sf_dir, objects=ObjectFilter(
        include=("tables",), tables=("Messstelle", "Ablesung", "Einstellung"), exclude_system=True, row_counts=False))
    shown = cat["tables"].select(
        F.lit("tables").alias("frame"), "source_id", "owner", F.col("name").alias("object"), "row_count")
    columns = cat["columns"].select(
        F.lit("columns"), "source_id", "owner", F.concat_ws(".", "table_name", "name"), F.lit(0).cast("long"))
    rest = [cat[kind].select(F.lit(kind), "source_id", "owner", "name", F.lit(0).cast("long"))
            for kind in OBJECT_KINDS if kind != "tables"]
    for part in (columns, *rest):
        shown = shown.union(part)
    return shown


def _excluded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without InnoDB tables and without SQL Server's: nothing that belongs to them."""
    cat = _catalog(spark, sf_dir, objects=ObjectFilter(exclude_types=("InnoDB", "USER_TABLE")), staged=True)
    parts = [
        cat[kind].select(F.lit(kind).alias("frame"), "source_id", "owner", F.col(named).alias("belongs_to"), "name")
        for kind, named in (("tables", "name"), ("views", "name"), ("columns", "table_name"), ("indexes", "table_name"), ("triggers", "target_table"))
    ]
    return union_all(parts)


def _auto_increment(cat: Catalog) -> DataFrame:
    return cat["columns"].where("is_auto_increment").select("source_id", "dialect", "owner", "table_name", "name")


def _ordered(cat: Catalog) -> DataFrame:
    return enrich.stable_order(cat["columns"], "columns").select("source_id", "owner", "table_name", "position", "name")


def _union_counts(cat: Catalog) -> DataFrame:
    return union_all([
        cat[kind].groupBy("dialect").agg(F.count(F.lit(1)).alias("n")).select("dialect", F.lit(kind).alias("kind"), "n")
        for kind in ("columns", *OBJECT_KINDS)
    ])


def _schema_counts(cat: Catalog) -> DataFrame:
    columns = cat["columns"].groupBy("source_id").agg(F.count(F.lit(1)).alias("columns"))
    return docs.object_totals(cat).join(spread(columns), "source_id")


def _report(cat: Catalog) -> DataFrame:
    return audit.audit_report(cat).withColumn("details", F.array_join("details", " | "))


# --- registry -------------------------------------------------------------------------------------

_NORMALISER_QUERIES = {
    "pg_tables": ("postgresql", "tables", pg.pg_tables),
    "mysql_tables": ("mysql", "tables", my.mysql_tables),
    "ora_tables": ("oracle", "tables", ora.ora_tables),
    "mssql_tables": ("mssql", "tables", ms.mssql_tables),
    "pg_columns": ("postgresql", "columns", pg.pg_columns),
    "mysql_columns": ("mysql", "columns", my.mysql_columns),
    "ora_columns": ("oracle", "columns", ora.ora_columns),
    "mssql_columns": ("mssql", "columns", ms.mssql_columns),
    "mssql_viewcols": ("mssql", "columns", ms.mssql_viewcols),
    "pg_indexes": ("postgresql", "indexes", pg.pg_indexes),
    "mysql_indexes": ("mysql", "indexes", my.mysql_indexes),
    "ora_indexes": ("oracle", "indexes", ora.ora_indexes),
    "mssql_indexes": ("mssql", "indexes", ms.mssql_indexes),
    "pg_views": ("postgresql", "views", pg.pg_views),
    "mysql_views": ("mysql", "views", my.mysql_views),
    "ora_views": ("oracle", "views", ora.ora_views),
    "mssql_views": ("mssql", "views", ms.mssql_views),
    "pg_routines": ("postgresql", "routines", pg.pg_routines),
    "mysql_routines": ("mysql", "routines", my.mysql_routines),
    "ora_routines": ("oracle", "routines", ora.ora_routines),
    "mssql_routines": ("mssql", "routines", ms.mssql_routines),
    "pg_sequences": ("postgresql", "sequences", pg.pg_sequences),
    "ora_sequences": ("oracle", "sequences", ora.ora_sequences),
    "mssql_sequences": ("mssql", "sequences", ms.mssql_sequences),
    "pg_triggers": ("postgresql", "triggers", pg.pg_triggers),
    "mysql_triggers": ("mysql", "triggers", my.mysql_triggers),
    "ora_triggers": ("oracle", "triggers", ora.ora_triggers),
    "mssql_triggers": ("mssql", "triggers", ms.mssql_triggers),
    "ora_synonyms": ("oracle", "synonyms", ora.ora_synonyms),
    "mssql_synonyms": ("mssql", "synonyms", ms.mssql_synonyms),
}
_COLUMN_FACTS = {
    "ora_constraints": ("oracle", ora.ora_constraints),
    "pg_fktarget": ("postgresql", pg.pg_fktarget),
    "mysql_fktarget": ("mysql", my.mysql_fktarget),
    "mssql_fktarget": ("mssql", ms.mssql_fktarget),
}


def _column_fact_sql(name: str) -> str:
    dialect = _COLUMN_FACTS[name][0]
    flags = "is_primary_key, is_foreign_key, is_unique, " if name == "ora_constraints" else ""
    where = "is_primary_key OR is_foreign_key OR is_unique" if name == "ora_constraints" else "is_foreign_key"
    return (f"SELECT source_id, owner, table_name, name AS column_name, {flags}fk_target_table, fk_target_column "
            f"FROM ({fleet_sql.kind_sql(dialect, 'columns')}) WHERE {where}")


def _normaliser_sql(name: str) -> str:
    dialect, kind, _ = _NORMALISER_QUERIES[name]
    sql = fleet_sql.kind_sql(dialect, kind)
    if name in ("mssql_columns", "mssql_viewcols"):
        sql = f"SELECT * FROM ({sql}) WHERE object_kind = '{'VIEW' if name == 'mssql_viewcols' else 'TABLE'}'"
    return sql


# name -> (query, expected-result SQL)
def _registry() -> dict[str, tuple[Query, str]]:
    lake, fleet, texts = lake_sql, fleet_sql, text_sql
    found: dict[str, tuple[Query, str]] = {
        "src_info": (_on_fleet(_source_info), fleet.source_info()),
        "src_dialect": (_dialect_names, fleet.dialect_names()),
        "src_lake": (_on_lake(_contents), lake.contents()),
        "src_snap": (_landed, _normaliser_sql("mysql_tables")),
        "src_snap_compacted": (_compacted, _normaliser_sql("mysql_tables")),
        "src_snap_changes": (_changes, fleet.changed_tables()),
        "snk_sheets": (_column_sheet, fleet.doc_columns()),
        "snk_pages": (_landed_pages, texts.table_pages()),
        "snk_json": (_on_staged_fleet(schema_documents), texts.documents(PIECE_BYTES)),
        "snk_json_pieces": (_on_staged_fleet(lambda c: schema_documents(c, 4_096)), texts.documents(4_096)),
        "flt_schema": (_tables_of(None), fleet.filter_schemas()),
        "flt_schema_named": (_tables_of(["PEGEL", "dbo"]), fleet.filter_schemas_named()),
        "flt_objects": (_filtered_objects, fleet.filter_objects()),
        "flt_objects_types": (_excluded_types, fleet.filter_types()),
        "enr_autoinc": (_on_fleet(_auto_increment), fleet.auto_increment()),
        "enr_signature": (
            _on_fleet(lambda c: c["routines"].select("source_id", "dialect", "owner", "name", "signature")),
            fleet.signatures()),
        "enr_indexflat": (
            _on_fleet(lambda c: _flat(c["indexes"].select("source_id", "dialect", "owner", "table_name", "name", "columns"))),
            fleet.flat_indexes()),
        "enr_order": (_on_fleet(_ordered), fleet.ordered()),
        "enr_union": (_on_fleet(_union_counts), fleet.union_counts()),
        "enr_schema": (_on_fleet(_schema_counts), fleet.schema_counts()),
        "msr_rows": (_on_lake(profiles.row_counts), lake.rows()),
        "msr_nulls": (_on_lake(_with_nulls), lake.nulls()),
        "msr_length": (_on_lake(profiles.length_profile), lake.lengths()),
        "msr_precision": (_on_lake(profiles.numeric_profile), lake.precision()),
        "msr_precision_wide": (_on_lake(_wide_numbers), lake.precision_wide()),
        "msr_distinct": (_on_lake(distincts.distinct_profile), lake.distincts()),
        "msr_unique": (_on_lake(distincts.key_candidates), lake.unique()),
        "msr_compkey": (_on_lake(_composite_keys), lake.composite_keys(COMPOSITE_KEYS)),
        "msr_fkcheck_composite": (_on_lake(lambda t: keys.check_composite_foreign_keys(t, COMPOSITE_FOREIGN_KEYS)), lake.composite_foreign_keys(COMPOSITE_FOREIGN_KEYS)),
        "msr_findkeys": (_on_lake(lambda t: keys.find_keys({n: t[n] for n in KEYED})), lake.found_keys(KEYED)),
        "msr_fkcheck": (_on_lake(lambda t: keys.check_foreign_keys(t, FOREIGN_KEYS)), lake.foreign_keys(FOREIGN_KEYS)),
        "msr_inds": (_on_lake(distincts.inclusion_dependencies), lake.inclusions()),
        "msr_fksuggest": (_on_lake(_suggestions), lake.suggestions()),
        "msr_sequence": (_on_lake(keys.sequence_profile), lake.sequences()),
        "msr_sequence_decimal": (_on_lake(_decimal_sequences), lake.decimal_sequences(DECIMAL_KEYS)),
        "msr_filefacts": (_file_facts, lake.file_facts(APPENDED)),
        "msr_document": (_on_lake_catalog(lambda c: c["columns"]), lake.document()),
        "doc_overview": (_on_fleet(docs.doc_overview), fleet.doc_overview()),
        "doc_overview_lake": (_on_lake_catalog(docs.doc_overview), lake.doc_overview()),
        "doc_tables": (_on_fleet(docs.doc_tables), fleet.doc_tables()),
        "doc_tables_lake": (_on_lake_catalog(docs.doc_tables), lake.doc_tables()),
        "doc_columns": (_on_staged_fleet(docs.doc_columns), fleet.doc_columns()),
        "doc_columns_lake": (_on_lake_catalog(docs.doc_columns), lake.doc_columns()),
        "doc_objects": (_on_fleet(docs.doc_objects), fleet.doc_objects()),
        "doc_outline": (_on_staged_fleet(docs.doc_outline), fleet.doc_outline()),
        "doc_outline_all": (_on_staged_fleet(lambda c: docs.doc_outline(c, with_views_and_synonyms=True)), fleet.doc_outline(True)),
        "doc_html": (_on_staged_fleet(pages.table_pages), texts.table_pages()),
        "doc_html_summary": (_on_staged_fleet(pages.summary_pages), texts.summary_pages(PIECE_BYTES)),
        "doc_html_summary_pieces": (_on_staged_fleet(lambda c: pages.summary_pages(c, True, 2_048)), texts.summary_pages(2_048, True)),
        "doc_xmlesc": (_on_lake(_escaped), lake.escape()),
        "doc_detail": (_on_staged_fleet(docs.doc_detail), fleet.doc_detail()),
        "aud_forbidden": (_on_fleet(audit.audit_forbidden), fleet.forbidden()),
        "aud_forbidden_lake": (_on_lake_catalog(audit.audit_forbidden), lake.forbidden()),
        "aud_comments": (_on_staged_fleet(audit.audit_comments), fleet.comments()),
        "aud_comments_failing": (_on_fleet(audit.audit_comments_failing), fleet.comments_failing()),
        "aud_coverage": (_on_fleet(audit.audit_coverage), fleet.coverage()),
        "aud_report": (_on_staged_fleet(_report), fleet.report()),
        "aud_passed": (_on_staged_fleet(audit.audit_passed), fleet.passed()),
    }
    for name, (dialect, _, operator) in _NORMALISER_QUERIES.items():
        found[name] = (_normaliser(dialect, operator), _normaliser_sql(name))
    for name, (dialect, operator) in _COLUMN_FACTS.items():
        found[name] = (_normaliser(dialect, operator), _column_fact_sql(name))
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Table sheet of the star schema, every fact measured."""
    return docs.doc_tables(_lake_catalog(spark, SMOKE_DIR, lake_sql.STAR))


def queries() -> dict[str, Query]:
    found = {name: query for name, (query, _) in _registry().items()}
    if llm_queries:
        found |= llm_queries.QUERIES
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, sql) in _registry().items()}
    if llm_queries:
        found |= llm_queries.ORACLE_SQL
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
