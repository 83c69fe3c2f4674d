"""Normalisers: the four dialects agree, and every known defect has its chosen behaviour."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from fleet import native
from lakescribe.functions.dialect import normalise_dialect, split_dialects
from lakescribe.model import FRAMES, local_frame
from lakescribe.operators import catalog_mssql as ms
from lakescribe.operators import catalog_mysql as my
from lakescribe.operators import catalog_oracle as ora
from lakescribe.operators import catalog_pg as pg
from lakescribe.operators import audit, docs
from lakescribe.operators.filters import ALL, ObjectFilter, filter_schemas
from lakescribe.plans.extract import NORMALISERS, ExtractConfig, extract
from lakescribe.sources.native import NATIVE, native_schema


@pytest.fixture(scope="module")
def customer(spark):
    return spark.read.parquet(f"{SF_DIR}/customer.parquet")


@pytest.fixture(scope="module")
def dumps(customer):
    return native.fleet(customer)


def one(df, where):
    rows = df.where(where).collect()
    assert len(rows) == 1, rows
    return rows[0]


def of_customer(df, k=1):
    return df.where(F.floor(F.col("source_id") / 4) == k)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dialect", sorted(NORMALISERS))
@pytest.mark.parametrize("schemas", [None, ALL])
def test_no_relation_is_broadcast(dumps, dialect, schemas):
    """Each relation grows with the fleet, which the estimate of its size does not show."""
    for kind, normalise in NORMALISERS[dialect].items():
        assert "Broadcast" not in plan_of(normalise(dumps[dialect], schemas)), kind


def test_joins_of_a_catalog_are_not_broadcast(dumps):
    catalog = extract(dumps, ExtractConfig(schemas=ALL, objects=ObjectFilter(exclude_types=("InnoDB",))))
    for df in (catalog["columns"], catalog["indexes"], docs.doc_tables(catalog), docs.doc_overview(catalog), audit.audit_report(catalog)):
        assert "Broadcast" not in plan_of(df)


def test_customers_are_dealt_out_before_they_are_exploded(customer):
    for dialect, build in native.BUILDERS.items():
        above, below = plan_of(build(customer.coalesce(1))["database_info"]).split("Generate", 1)
        assert "hashpartitioning(c_custkey" in below, dialect


@pytest.mark.parametrize("dialect", sorted(NORMALISERS))
def test_frames_have_the_canonical_schema(dumps, dialect):
    for kind, normalise in NORMALISERS[dialect].items():
        found = normalise(dumps[dialect], ALL).schema
        assert found.simpleString() == FRAMES[kind].simpleString(), kind


def test_dialects_agree(fleet_catalog):
    """Names, keys, nullability and comments of table columns do not depend on the dialect."""
    facts = ["table_name", "name", "position", "nullable", "comment", "is_primary_key", "is_foreign_key", "fk_target_column"]
    columns = of_customer(fleet_catalog["columns"]).where("object_kind = 'TABLE'")
    found = {
        d: sorted(map(tuple, columns.where(F.col("dialect") == d).select(*facts).collect())) for d in NORMALISERS
    }
    assert len(found["oracle"]) == 25
    assert found["oracle"] == found["postgresql"] == found["mysql"] == found["mssql"]


def test_composite_foreign_keys_are_paired(fleet_catalog):
    rows = of_customer(fleet_catalog["columns"]).where("table_name = 'Dienst' and is_foreign_key").collect()
    assert {(r["dialect"], r["name"], r["fk_target_column"]) for r in rows} == {
        (d, child, parent) for d in NORMALISERS for child, parent in (("Dienstabschnitt", "Abschnitt"), ("Dienstbezirk", "Bezirk"))}


def test_mysql_key_code_is_not_a_foreign_key(dumps):
    archived = "table_name = 'Gewässer' and name = 'Name' and owner not in ('PEGEL', 'PEGEL2')"
    assert not one(of_customer(my.mysql_columns(dumps["mysql"], ALL)), archived)["is_foreign_key"]
    assert one(of_customer(my.mysql_columns(dumps["mysql"], ALL, raw_foreign_keys=True)), archived)["is_foreign_key"]


@pytest.mark.parametrize("dialect", sorted(NORMALISERS))
def test_indexes_of_equal_table_names_stay_apart(fleet_catalog, dialect):
    found = of_customer(fleet_catalog["indexes"]).where((F.col("dialect") == dialect) & (F.col("table_name") == "Gewässer"))
    assert found.groupBy("owner").count().select("count").orderBy("count").collect() == [(1,), (2,)]
    assert found.where("is_primary").count() == 2


def test_column_in_two_unique_indexes_is_one_row(fleet_catalog):
    rows = of_customer(fleet_catalog["columns"]).where("table_name = 'Dienst' and name = 'Ausweis'").collect()
    assert len(rows) == 4 and all(r["is_unique"] for r in rows)


def test_trigger_events(spark, fleet_catalog):
    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    k = customer.where("c_mktsegment <> 'BUILDING'").first()["c_custkey"]
    rows = {(r["dialect"], r["name"]): r for r in of_customer(fleet_catalog["triggers"], k).collect()}
    audit = rows[("postgresql", "TR_Gewässer_Prüfung")]
    assert (audit["event"], audit["events"], audit["level"], audit["status"]) == (
        "INSERT", ["INSERT", "DELETE", "UPDATE"], "STATEMENT", "DISABLED")
    assert rows[("mssql", "TR_Gewässer_Prüfung")]["events"] == ["INSERT", "UPDATE", "DELETE"]
    assert rows[("mssql", "TR_Gewässer_Prüfung")]["level"] == "ROW"
    assert rows[("oracle", "TR_Übersicht_Ersatz")]["timing"] == "INSTEAD OF"
    assert ("mssql", "TR_Übersicht_Ersatz") not in rows  # triggers on views are lost
    assert not any("RI_trigger" in n or "shipped" in n for _, n in rows)


def test_trigger_bits(spark):
    bits = {7: ("BEFORE", "INSERT", "ROW"), 69: ("INSTEAD OF", "INSERT", "ROW"), 32: ("AFTER", "TRUNCATE", "STATEMENT"),
            24: ("AFTER", "DELETE", "STATEMENT"), 17: ("AFTER", "UPDATE", "ROW"), 0: ("AFTER", "TRUNCATE", "STATEMENT")}
    frames = {
        "pg_namespace": local_frame(spark, [(1, 5, "public")], native_schema("postgresql", "pg_namespace")),
        "pg_class": local_frame(spark, [(1, 9, "t", 5, "r", 0, 0)], native_schema("postgresql", "pg_class")),
        "pg_description": local_frame(spark, [], native_schema("postgresql", "pg_description")),
        "pg_trigger": local_frame(spark, [(1, b, f"t{b}", 9, b, on, False) for b, on in zip(bits, "OARDOO", strict=True)],
                                  native_schema("postgresql", "pg_trigger")),
    }
    found = {r["name"]: r for r in pg.pg_triggers(frames).collect()}
    assert {int(n[1:]): (r["timing"], r["event"], r["level"]) for n, r in found.items()} == bits
    assert [found[f"t{b}"]["status"] for b in bits] == ["ENABLED", "DISABLED", "DISABLED", "DISABLED", "ENABLED", "ENABLED"]


def test_first_constraint_by_name_gives_the_target(spark):
    usage = [(1, name, "d", "c", "x", table, "id") for name, table in (("FK_B", "second"), ("FK_A", "first"), ("FK_C", "third"))]
    frames = {"key_column_usage": local_frame(spark, usage, native_schema("mysql", "key_column_usage"))}
    assert one(my.mysql_fktarget(frames, ALL), "true")["fk_target_table"] == "first"


def test_oracle_choices(fleet_catalog):
    tables = of_customer(fleet_catalog["tables"]).where("dialect = 'oracle'")
    assert {r["type"] for r in tables.collect()} == {"TABLE"}
    overloads = of_customer(fleet_catalog["routines"]).where("name = 'Auswertung.Ganglinie'").collect()
    assert sorted(r["signature"] for r in overloads) == [
        "PROCEDURE Auswertung.Ganglinie(p_monat IN NUMBER)", "PROCEDURE Auswertung.Ganglinie(p_monat IN NUMBER, p_jahr IN NUMBER)"]
    assert sorted(r["arguments"][0]["default_value"] for r in overloads) == ["", "1"]
    member = one(of_customer(fleet_catalog["routines"]), "name = 'Auswertung.Summe'")
    assert member["type"] == "FUNCTION" and member["signature"] == "FUNCTION Auswertung.Summe(p_monat IN NUMBER) RETURN <type>"
    function = one(of_customer(fleet_catalog["routines"]), "dialect = 'oracle' and type = 'FUNCTION' and not contains(name, '.')")
    assert function["signature"].endswith(" RETURN <type>")
    assert one(of_customer(fleet_catalog["sequences"]), "name = 'BIG_SEQ'")["max_value"] == 10**28 - 1
    default = one(of_customer(fleet_catalog["columns"]), "dialect = 'oracle' and name = 'Betriebsart'")
    assert default["default_value"] == "'HAND'"


def test_mssql_routine_types(dumps):
    plain, raw = (one(of_customer(ms.mssql_routines(dumps["mssql"], ALL, raw_type=r)), "true") for r in (False, True))
    assert (plain["type"], raw["type"]) == ("PROCEDURE", "SQL_STORED_PROCEDURE")
    assert plain["signature"].startswith("PROCEDURE Ablesung_nachtragen(@p_stelle IN ")


def test_mssql_synonym_targets(spark):
    targets = {"[PEGEL].[T]": ("PEGEL", "T"), "[db].[PEGEL].[T]": ("PEGEL", "T"), "[srv].[db].[PEGEL].[T]": ("PEGEL", "T"), "T": ("", "T")}
    frames = {
        "schemas": local_frame(spark, [(1, 1, "dbo")], native_schema("mssql", "schemas")),
        "synonyms": local_frame(spark, [(1, i, 1, t, t) for i, t in enumerate(targets)], native_schema("mssql", "synonyms")),
        "extended_properties": local_frame(spark, [], native_schema("mssql", "extended_properties")),
    }
    found = {r["name"]: (r["target_owner"], r["target_object"]) for r in ms.mssql_synonyms(frames).collect()}
    assert found == targets


def test_mssql_view_columns_are_bare(fleet_catalog):
    rows = of_customer(fleet_catalog["columns"]).where("dialect = 'mssql' and object_kind = 'VIEW'").collect()
    assert len(rows) == 4 and not any(r["nullable"] or r["length"] for r in rows)


def test_pg_kinds_behind_flags(dumps):
    default, wide = (of_customer(pg.pg_tables(dumps["postgresql"], ALL, include_partitioned=f)) for f in (False, True))
    assert wide.exceptAll(default).first()["type"] == "PARTITIONED"
    views = of_customer(pg.pg_views(dumps["postgresql"], ALL, include_materialized=True))
    assert sorted(r["type"] for r in views.collect()) == ["MATERIALIZED VIEW", "VIEW"]
    columns = of_customer(pg.pg_columns(dumps["postgresql"], ALL, include_partitioned=True, include_materialized=True))
    assert {r["object_kind"] for r in columns.where("table_name in ('Jahresmittel', 'Ablesung_alt')").collect()} == {"TABLE", "VIEW"}


def test_dialect_names(spark):
    df = spark.createDataFrame([(n,) for n in (" PG ", "Postgres", "postgresql", "SQLServer", "MSSQL", "MySQL", "oracle", "db2")], "n string")
    assert [r[0] for r in df.select(normalise_dialect(F.col("n"))).collect()] == [
        "postgresql", "postgresql", "postgresql", "mssql", "mssql", "mysql", "oracle", None]
    assert split_dialects(df, "n")[1].first()["error"] == "unsupported database type: db2"


def test_schema_defaults(spark, dumps):
    owners = lambda df: {r["owner"] for r in df.select("owner").distinct().collect()}
    assert owners(pg.pg_tables(dumps["postgresql"])) == {"public"}
    assert owners(ms.mssql_tables(dumps["mssql"])) == {"dbo"}
    assert owners(of_customer(my.mysql_tables(dumps["mysql"]))) == {"Pegeldienst_1"}
    assert {"PEGEL_ARC", "SYS"} < owners(ora.ora_tables(dumps["oracle"]))
    df = local_frame(spark, [(1, "a"), (1, "b")], "source_id long, owner string")
    assert filter_schemas(df, "oracle", ["b"]).count() == 1 and filter_schemas(df, "oracle").count() == 2


def test_stable_order_is_an_order(fleet_catalog):
    from lakescribe.operators.enrich import ORDER, stable_order

    for frame in ("columns", "indexes"):
        rows = [tuple(r) for r in stable_order(fleet_catalog[frame], frame).select(*ORDER[frame]).collect()]
        assert rows == sorted(rows) and len(rows) > 100


def test_jdbc_queries_select_the_native_columns():
    """Every relation has a query that names the native columns in their order; none has been run on a server."""
    import re

    from lakescribe.sources.jdbc import QUERIES
    from lakescribe.sources.native import NATIVE, native_schema

    for dialect, queries in QUERIES.items():
        assert queries.keys() == NATIVE[dialect].keys()
        for relation, query in queries.items():
            at = -1
            for name in native_schema(dialect, relation).names[1:]:
                found = re.compile(rf"\b{name}\b", re.IGNORECASE).search(query, at + 1)
                assert found, (dialect, relation, name)
                at = found.start()


def test_object_filter(dumps):
    cfg = ExtractConfig(schemas=ALL, objects=ObjectFilter(include=("views",), exclude_types=("PROCEDURE",)))
    cat = extract(dumps, cfg)
    assert cat["tables"].count() == 0 and cat["views"].count() > 0
    assert {r[0] for r in cat["columns"].select("object_kind").distinct().collect()} == {"VIEW"}
    cfg = ExtractConfig(schemas=ALL, objects=ObjectFilter(exclude_types=("PROCEDURE",)))
    assert {r[0] for r in extract(dumps, cfg)["routines"].select("type").distinct().collect()} == {"FUNCTION"}


def test_kinds_that_a_dialect_lacks_are_empty(fleet_catalog):
    assert fleet_catalog["sequences"].where("dialect = 'mysql'").count() == 0
    assert fleet_catalog["synonyms"].where("dialect in ('mysql', 'postgresql')").count() == 0


def test_no_place_for_source_code():
    from lakescribe.operators.audit import FORBIDDEN_NAMES, forbidden_in_model

    assert forbidden_in_model() == []
    forbidden = {n.lower() for n in FORBIDDEN_NAMES}
    for dialect, relations in NATIVE.items():
        for relation in relations:
            assert not forbidden & {n.lower() for n in native_schema(dialect, relation).names}, (dialect, relation)
