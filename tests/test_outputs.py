"""Documents, pages, sheets, snapshots, JDBC and the shape of plans."""

import io
import json
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from fleet import native
from lakescribe.functions.text import escape_html, escape_markup
from lakescribe.operators import audit, distincts, docs, keys, pages, profiles
from lakescribe.operators.documents import schema_documents
from lakescribe.operators.filters import ALL
from lakescribe.operators.numbering import numbered, running_total
from lakescribe.plans.extract import NORMALISERS
from lakescribe.sinks import write_documents, write_pages, write_sheets
from lakescribe.sources import JdbcSource, land_fleet, read_catalog_jdbc, read_snapshot, write_snapshot
from lakescribe.sources.jdbc import QUERIES
from lakescribe.sources.native import NATIVE, native_schema


@pytest.fixture(scope="module")
def few(fleet_catalog):
    """Three customers' databases."""
    return {k: df.where(F.floor(F.col("source_id") / 4) < 3) for k, df in fleet_catalog.items()}


def test_json_document(few):
    by_id = {r["source_id"]: r for r in schema_documents(few).collect()}
    assert len(by_id) == 12 and all(r["at"] == 0 for r in by_id.values())
    doc = json.loads(by_id[6]["json"])  # Oracle of customer 1
    assert list(doc)[:4] == ["databaseName", "databaseType", "version", "extractedAt"]
    assert (doc["databaseType"], doc["extractedAt"]) == ("Oracle", "2025-01-31T09:00:00Z")
    employee = next(t for t in doc["tables"] if t["name"] == "Messstelle")
    assert [c["position"] for c in employee["columns"]] == list(range(1, 8))
    assert employee["createdAt"] == "2019-04-02 08:15:00" and employee["rowCount"] == 85
    assert "fkTargetTable" not in employee["columns"][0] and "length" not in employee["columns"][0]
    assert next(c for c in employee["columns"] if c["name"] == "Gewässernummer")["fkTargetTable"] == "Gewässer"
    archived = next(t for t in doc["tables"] if t["owner"] == "PEGEL_ARC")
    assert "rowCount" not in archived and "modifiedAt" not in archived
    assert next(i for i in doc["indexes"] if i["name"] == "IX_Ablesung_Reihe")["columns"] == ["Stelle", "Tag"]
    assert not {"body", "definition", "text", "source"} & set(re.findall(r'"(\w+)":', by_id[6]["json"].lower()))
    assert "synonyms" not in json.loads(by_id[5]["json"])  # MySQL has none


def whole(rows, text):
    """The pieces of each source one after the other; each begins where the one before ends."""
    found = {}
    for r in sorted(rows, key=lambda r: (r["source_id"], r["at"])):
        before = found.get(r["source_id"], "")
        assert len(before.encode()) == r["at"]
        found[r["source_id"]] = before + r[text]
    return found


@pytest.mark.parametrize("limit", [1, 700, 5_000])
def test_pieces_make_up_the_whole_documents(few, limit):
    expected = {r["source_id"]: r["json"] for r in schema_documents(few).collect()}
    rows = schema_documents(few, limit).collect()
    assert whole(rows, "json") == expected and len(rows) > len(expected)
    lines = max(len(json.dumps(t, ensure_ascii=False).encode()) for d in expected.values() for k, v in json.loads(d).items() if isinstance(v, list) for t in v)
    assert max(len(r["json"].encode()) for r in rows) < limit + lines + 99
    html = {r["source_id"]: r["html"] for r in pages.summary_pages(few, True).collect()}
    assert whole(pages.summary_pages(few, True, limit).collect(), "html") == html


def test_running_totals_and_numbers_against_lists(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), rnd.randint(0, 30), i, rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, i int, v long").repartition(7)
    expected, totals, places = {}, {}, {}
    for g, o, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        totals[g], places[g] = totals.get(g, 0) + v, places.get(g, 0) + 1
        expected[i] = (totals[g] - v, places[g])
    summed = {r.i: r.s for r in running_total(df, ["g"], ["o", "i"], "v", "s").collect()}
    numbers = {r.i: r.k for r in numbered(df, ["g"], ["o", "i"], "k").collect()}
    assert {i: (summed[i], numbers[i]) for i in summed} == expected
    assert numbered(df.limit(0), ["g"], ["o"], "k").count() == 0


def test_table_page(few):
    page = pages.table_pages(few).where("source_id = 6 and table_name = 'Revier'").first()["html"]
    assert "<p><em>Revier &lt;Nord &amp; Süd&gt;</em></p>" in page
    assert page.count("badge-pk") == 2 and page.count("<td><strong>") == 3 and page.count("<thead>") == 1
    assert page.index("Bezirk") < page.index("Abschnitt") < page.index("Titel")


def test_summary_page(spark, few):
    k = spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_mktsegment <> 'BUILDING' and c_custkey < 3").first()["c_custkey"]
    row = pages.summary_pages(few).where(F.col("source_id") == 4 * k + 2).first()
    page = row["html"]
    assert page.count("summary-card") == 6 and row["at"] == 0
    assert [t for t in re.findall("<h2>(.*?)</h2>", page)] == ["Tables", "Procedures / Functions", "Triggers", "Sequences"]
    assert page.count("<td><strong>") == 7 + 5 + 4 + 3 and "RETURN &lt;type&gt;" in page
    more = pages.summary_pages(few, with_views_and_synonyms=True).where(F.col("source_id") == 4 * k + 2).first()["html"]
    assert "<h2>Views</h2>" in more


def test_seed_pages_have_the_expected_counts(few):
    """The three large tables: 15 column rows, 3 primary key, 2 foreign key and 1 unique badges."""
    hr = pages.table_pages(few).where("source_id = 6 and owner in ('PEGEL', 'PEGEL2') and table_name in ('Messstelle', 'Gewässer', 'Ablesung')").collect()
    text = "".join(r["html"] for r in hr)
    assert [text.count(x) for x in ("<td><strong>", "badge-pk", "badge-fk", "badge-uk", "<thead>")] == [15, 3, 2, 1, 3]


def test_escapes(spark):
    row = spark.createDataFrame([("<a href=\"x\">&amp; 'y' +</a>",)], "s string").select(
        escape_markup(F.col("s")), escape_html(F.col("s"))).first()
    assert row[0] == "&lt;a href=&quot;x&quot;&gt;&amp;amp; 'y' +&lt;/a&gt;"
    assert row[1] == "&lt;a href=&#34;x&#34;&gt;&amp;amp; &#39;y&#39; &#43;&lt;/a&gt;"


def test_column_line(few):
    lines = {r["content"] for r in docs.doc_outline(few).where("source_id = 6").collect()}
    assert "  • Kennung (VARCHAR2) [UK]  - Kennung im Funknetz" in lines or "  • Kennung (VARCHAR2) [UK] " in lines
    escaped = {r["content"] for r in docs.doc_outline(few, escaped=True).where("source_id = 6").collect()}
    assert "Revier &lt;Nord &amp; Süd&gt;" in escaped


def test_outline_reads_in_order(few):
    rows = docs.doc_outline(few).where("source_id = 6").orderBy(*docs.OUTLINE_ORDER).collect()
    assert rows[0]["style"] == "Title" and rows[-1]["content"] == "─" * 38
    assert [r["ord"] for r in rows] == list(range(1, len(rows) + 1))
    more = docs.doc_outline(few, with_views_and_synonyms=True).where("source_id = 6").orderBy("ord").collect()
    assert [r["content"] for r in more if r["style"] == "Heading1"] == [r["content"] for r in rows if r["style"] == "Heading1"] + ["Views", "Synonyms"]
    at = next(i for i, r in enumerate(rows) if r["content"] == "Table: Messstelle")
    assert [r["style"] for r in rows[at : at + 5]] == ["Heading2", "Normal", "Normal", "Heading3", "Normal"]
    assert rows[at + 11]["content"] == "" and rows[at + 10]["content"].startswith("  • Eröffnet")


def test_objects_sheet_in_order(few):
    rows = docs.doc_objects(few).where("source_id = 5").orderBy("section", "line", "owner", "name", "detail").collect()
    assert rows[0]["c1"] == "ROUTINES" and rows[1]["c4"] == "Signature"
    assert "SEQUENCES" not in {r["c1"] for r in rows}  # an empty section is left out


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sheets_round_trip(spark, few, tmp_path, fmt):
    write_sheets(few, str(tmp_path), fmt, buckets=3)
    reader = spark.read.option("header", True).option("escape", '"')
    for sheet, build in (("Overview", docs.doc_overview), ("Tables", docs.doc_tables),
                         ("Columns", docs.doc_columns), ("Objects", docs.doc_objects)):
        back = reader.format(fmt).load(f"{tmp_path}/{sheet}")
        assert back.select("source_bucket").distinct().count() <= 3
        assert back.drop("source_bucket").count() == build(few).count()
    if fmt == "parquet":
        back = spark.read.parquet(f"{tmp_path}/Columns").drop("source_bucket")
        assert back.exceptAll(docs.doc_columns(few)).count() == 0
    with pytest.raises(ValueError):
        write_sheets(few, str(tmp_path), "xlsx")


def test_pages_and_documents_round_trip(spark, few, tmp_path):
    write_pages(pages.table_pages(few), f"{tmp_path}/pages", buckets=2)
    assert spark.read.parquet(f"{tmp_path}/pages").count() == few["tables"].count()
    write_documents(few, f"{tmp_path}/documents", buckets=2)
    assert spark.read.parquet(f"{tmp_path}/documents").select("source_id").distinct().count() == 12


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_snapshot_round_trip(spark, tmp_path):
    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 5")
    frames = native.mysql(customer)
    write_snapshot(frames, str(tmp_path), "mysql", buckets=4)
    back = read_snapshot(spark, str(tmp_path), "mysql")
    assert set(back) == set(NATIVE["mysql"])
    for kind, normalise in NORMALISERS["mysql"].items():
        assert normalise(back, ALL).exceptAll(normalise(frames, ALL)).count() == 0
    one = read_snapshot(spark, str(tmp_path), "mysql", buckets=[1])["tables"]
    assert "PartitionFilters: [isnotnull(source_bucket" in plan(one) or "source_bucket#" in plan(one).split("PartitionFilters")[1][:80]
    assert one.count() < back["tables"].count()
    with pytest.raises(ValueError):
        read_snapshot(spark, str(tmp_path), "db2")


def test_batches_and_repeated_sources_land_without_loss(spark, tmp_path):
    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    ids = [r.source_id for r in native.mysql(customer.where("c_custkey < 13"))["database_info"].select("source_id").distinct().collect()]
    first, second = native.mysql(customer.where("c_custkey < 7")), native.mysql(customer.where("c_custkey between 7 and 12"))
    write_snapshot(first, str(tmp_path), "mysql", buckets=2)
    write_snapshot(second, str(tmp_path), "mysql", buckets=2)
    whole = native.mysql(customer.where("c_custkey < 13"))
    back = read_snapshot(spark, str(tmp_path), "mysql")
    for relation, frame in whole.items():
        assert back[relation].exceptAll(frame).count() == 0 and frame.exceptAll(back[relation]).count() == 0
    again = {k: v.where(F.col("source_id") == ids[0]) for k, v in whole.items()}
    again["tables"] = again["tables"].limit(1)
    write_snapshot(again, str(tmp_path), "mysql", buckets=2)
    back = read_snapshot(spark, str(tmp_path), "mysql")
    assert back["tables"].where(F.col("source_id") == ids[0]).count() == 1
    assert back["tables"].where(F.col("source_id") != ids[0]).exceptAll(whole["tables"]).count() == 0
    assert {r.source_id for r in back["database_info"].collect()} == set(ids)


def test_a_database_that_is_down_costs_no_other(spark, tmp_path):
    up = [JdbcSource(i, f"jdbc:derby:memory:land{i};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}) for i in (1, 2)]
    down = JdbcSource(3, "jdbc:derby:memory:missing", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    text = {"string": "VARCHAR(9)", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}
    queries = {
        relation: "SELECT " + ", ".join(
            f"CAST(NULL AS {text.get(f.dataType.simpleString(), 'VARCHAR(9)')}) AS {f.name}" for f in native_schema("mysql", relation).fields[1:]
        ) + " FROM SYSIBM.SYSDUMMY1"
        for relation in ("database_info",)
    }
    failed = land_fleet(spark, [up[0], down, up[1]], "mysql", str(tmp_path), queries=queries, buckets=2)
    assert [x for x, _ in failed] == [3]
    landed = spark.read.parquet(f"{tmp_path}/dialect=mysql/database_info")
    assert {r.source_id for r in landed.collect()} == {1, 2}


def test_owner_filter_reaches_the_scan(spark, tmp_path):
    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 5")
    write_snapshot(native.oracle(customer), str(tmp_path), "oracle", buckets=2)
    back = read_snapshot(spark, str(tmp_path), "oracle")
    tables = NORMALISERS["oracle"]["tables"](back, ["PEGEL"])
    assert re.search(r"PushedFilters: \[[^\]]*owner", plan(tables))
    assert "num_rows" not in plan(tables.select("name"))


def test_jdbc(spark, tmp_path):
    """In-process Derby stands in for a server; its tables have the native shape."""
    from lakescribe.operators.catalog_mysql import mysql_tables

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 1")
    landed = native.mysql(customer)
    queries = {}
    for relation in ("tables", "database_info"):
        rows = landed[relation].drop("source_id")
        rows.write.format("jdbc").option("url", url).options(**driver).option("dbtable", f"t_{relation}").save()
        # Derby stores Spark's strings as CLOB, which cannot be compared.
        shown = [f'CAST("{f.name}" AS VARCHAR(200)) AS "{f.name}"' if f.dataType.simpleString() == "string" else f'"{f.name}"'
                 for f in rows.schema]
        queries[relation] = f"SELECT {', '.join(shown)} FROM t_{relation}"
    sources = [JdbcSource(i, url, driver) for i in (7, 9)]
    frames = read_catalog_jdbc(spark, sources, "mysql", queries)
    assert re.search(r"PushedFilters: .*table_type", plan(mysql_tables(frames, ALL)))
    found = mysql_tables(frames, ALL)
    assert found.count() == 14 and {r[0] for r in found.select("source_id").distinct().collect()} == {7, 9}
    assert found.where("source_id = 7").drop("source_id").exceptAll(mysql_tables(landed, ALL).drop("source_id")).count() == 0


def test_jdbc_queries_cover_all_relations():
    assert {d: set(q) for d, q in QUERIES.items()} == {d: set(r) for d, r in NATIVE.items()}


def test_audits(few):
    report = {(r["source_id"], r["rule"]): r for r in audit.audit_report(few).collect()}
    assert len(report) == 36
    assert "no Sequence" in report[(5, "coverage")]["details"] and not report[(5, "coverage")]["passed"]
    assert audit.audit_forbidden(few, exact_case=True).where("column_name = 'text'").count() == 0


def test_plans_have_no_cross_join_and_no_global_window(spark, few, fleet_catalog):
    tables = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("orders", "customer", "lineitem")}
    frames = [build(few) for build in (docs.doc_overview, docs.doc_tables, docs.doc_columns, docs.doc_objects,
                                       docs.doc_detail, schema_documents, audit.audit_report)]
    frames += [distincts.distinct_profile(tables), distincts.inclusion_dependencies(tables), profiles.scan_profile(tables),
               keys.check_foreign_keys(tables, [("orders", "o_custkey", "customer", "c_custkey")])]
    for df in frames:
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert not re.search(r"\n\(\d+\) Window\b", text)


def test_scans_read_only_what_is_measured(spark):
    lineitem = {"lineitem": spark.read.parquet(f"{SF_DIR}/lineitem.parquet")}
    assert "ReadSchema: struct<>" in plan(profiles.row_counts(lineitem))
    assert "l_quantity" not in plan(profiles.length_profile(lineitem)).split("ReadSchema")[1][:200]
    assert "HashAggregate" in plan(profiles.scan_profile(lineitem)) and "SortAggregate" not in plan(profiles.scan_profile(lineitem))
