"""Every query of the library against its SQL. The reports share one landed catalog."""

import re

import pytest

import __spark_entry__ as entry
from compare import difference
from conftest import SF_DIR

# The training-data queries have tests of their own.
OTHER = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in entry.queries().items() if not OTHER.match(k)}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if not OTHER.match(k)}
# These choose owners or kinds themselves, so they extract on their own.
OWN_EXTRACTION = {"flt_schema", "flt_schema_named", "flt_objects", "flt_objects_types"}


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, fleet_catalog, lake_catalog, monkeypatch):
    if name not in OWN_EXTRACTION:
        monkeypatch.setattr(entry, "_catalog", lambda *_: fleet_catalog)
    monkeypatch.setattr(entry, "_lake_catalog", lambda *_: lake_catalog)
    assert difference(spark, duck, QUERIES[name], ORACLE[name], SF_DIR) == ""


def test_entry(spark):
    found = {r["name"]: r["row_count"] for r in entry.entry(spark).collect()}
    assert found["lineitem"] > found["orders"] > 0 and len(found) == 7
