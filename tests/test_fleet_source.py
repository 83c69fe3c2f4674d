"""A fleet of databases read by one scan for each relation; files of an embedded database stand in for servers."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from fleet import native
from lakescribe.operators.catalog_mysql import mysql_columns, mysql_tables
from lakescribe.operators.filters import ALL
from lakescribe.sources import Database, land_databases, read_fleet, read_snapshot
from lakescribe.sources.fleet import read_relation
from lakescribe.sources.native import NATIVE, native_schema

def names_of(relation):
    return [x.split()[0] for x in NATIVE["mysql"][relation].split(", ")]


QUERIES = {r: "SELECT " + ", ".join(f'"{n}"' for n in names_of(r)) + f" FROM t_{r}" for r in NATIVE["mysql"]}


@pytest.fixture(scope="module")
def landed(spark):
    frames = native.mysql(spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 12"))
    return {r: df.cache() for r, df in frames.items()}


@pytest.fixture(scope="module")
def databases(landed, tmp_path_factory):
    """Each source's relations in a database file of its own."""
    folder, found = tmp_path_factory.mktemp("databases"), []
    for source in sorted(r.source_id for r in landed["database_info"].select("source_id").distinct().collect()):
        found.append(Database(source, {"database": f"{folder}/{source}.db"}))
    for relation, df in landed.items():
        rows, names = df.collect(), df.columns[1:]
        for d in found:
            with sqlite3.connect(d.arguments["database"]) as con:
                con.execute(f"CREATE TABLE t_{relation} (" + ", ".join(f'"{n}"' for n in names) + ")")
                own = [[str(v) if v is not None and not isinstance(v, (int, str)) else v for v in (r[n] for n in names)] for r in rows if r["source_id"] == d.source_id]
                con.executemany(f"INSERT INTO t_{relation} VALUES ({', '.join('?' * len(names))})", own)
    return found


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_relations_come_back_as_they_are(spark, landed, databases):
    frames, errors = read_fleet(spark, databases, "mysql", "sqlite3", QUERIES)
    assert errors.count() == 0
    for relation, df in frames.items():
        assert df.schema == native_schema("mysql", relation)
        assert same(df.withColumns({}), landed[relation]), relation
    assert same(mysql_tables(frames, ALL), mysql_tables(landed, ALL)) and same(mysql_columns(frames, ALL), mysql_columns(landed, ALL))


def test_a_database_that_is_down_is_a_row(spark, landed, databases, tmp_path):
    sqlite3.connect(tmp_path / "half.db").execute("CREATE TABLE t_database_info AS SELECT 1 AS line, 'x' AS database_name, 'v' AS version").connection.commit()
    down = [Database(901, {"database": "/nowhere/missing.db"}), Database(902, {"database": str(tmp_path / "half.db")}), Database(903, {"what": 1})]
    errors = land_databases(spark, [down[0], *databases, *down[1:]], "mysql", str(tmp_path / "landed"), "sqlite3", 2, QUERIES)
    found = {(r.source_id, r.relation): r.error for r in errors.collect()}
    assert {i for i, _ in found} == {901, 902, 903} and "unable to open" in found[(901, "tables")] and "TypeError" in found[(903, "tables")]
    assert (902, "database_info") not in found and "no such table" in found[(902, "tables")]
    back = read_snapshot(spark, str(tmp_path / "landed"), "mysql")
    assert same(back["tables"], landed["tables"]) and same(back["database_info"], landed["database_info"])


def test_values_that_drivers_give_differently(spark, tmp_path):
    path = str(tmp_path / "pg.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE i (indexrelid, indrelid, indkey, indisunique, indisprimary)")
        con.executemany("INSERT INTO i VALUES (?, ?, ?, ?, ?)", [(1, "2", "1 3", 1, "f"), (None, 5, "{4,5}", "true", 0)])
    df = read_relation(spark, [Database(1, {"database": path})], "postgresql", "pg_index", "sqlite3", "SELECT * FROM i")
    assert sorted(map(tuple, df.drop("error").collect()), key=repr) == sorted([(1, 1, 2, [1, 3], True, False), (1, None, 5, [4, 5], True, False)], key=repr)


def test_plans_do_not_grow_with_the_fleet(spark, databases):
    def plan(n):
        many = [Database(i, {"database": f"/secret/{i}.db"}) for i in range(n)]
        df = read_relation(spark, many, "mysql", "tables", "sqlite3", QUERIES["tables"])
        return df.select(F.count("*"))._jdf.queryExecution().toString()

    small, large = plan(2), plan(2_000)
    assert abs(len(small) - len(large)) < 50 and "secret" not in large


def test_wrong_fleets_are_refused(spark, databases):
    for wrong in ([], [databases[0], databases[0]]):
        with pytest.raises(ValueError):
            read_fleet(spark, wrong, "mysql", "sqlite3", QUERIES)
