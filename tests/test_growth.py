"""Tables and dumps that grow: facts of files, bases of runs, changes between runs."""

import glob
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_DIR
from fleet import native
from lakescribe.functions import files
from lakescribe.operators import file_facts, profiles
from lakescribe.plans.document_lake import document_lake
from lakescribe.sources import clean_snapshot, compact_snapshot, read_snapshot, snapshot_changes, write_snapshot
from lakescribe.sources.snapshot import read_manifest


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_scan(spark, path, store, schema):
    found = file_facts.file_profile(spark, {"t": path}, store, {"t": schema})
    whole = profiles.scan_profile({"t": spark.read.schema(schema).parquet(path)})
    assert found.columns == whole.columns and found.dtypes == whole.dtypes
    return rows(found) == rows(whole)


def test_only_new_files_are_opened(spark, tmp_path):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    path, store, schemas = f"{tmp_path}/or ders%20", f"{tmp_path}/facts", {"t": orders.schema}
    orders.where("o_orderkey % 3 = 0").repartition(3).write.parquet(path)
    assert file_facts.measure_files(spark, {"t": path}, store, schemas, files_per_job=2) == {"t": 3}
    old = {f: open(f, "rb").read() for f in glob.glob(f"{path}/*.parquet")}
    for f, content in old.items():  # of the same length and time, but nobody can read them
        at = os.stat(f).st_mtime_ns
        with open(f, "wb") as out:
            out.write(b"x" * len(content))
        os.utime(f, ns=(at, at))
    orders.where("o_orderkey % 3 <> 0").repartition(2).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        file_facts.file_profile(spark, {"t": path}, store, schemas)
    assert file_facts.measure_files(spark, {"t": path}, store, schemas) == {"t": 2}
    assert file_facts.measure_files(spark, {"t": path}, store, schemas) == {"t": 0}
    found = file_facts.file_profile(spark, {"t": path}, store, schemas)
    assert rows(found) == rows(profiles.scan_profile({"t": orders}))


def test_replaced_and_removed_files(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, name string, v double, d decimal(12,3)")
    path, store = f"{tmp_path}/t", f"{tmp_path}/facts"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr(
            "CAST(id AS int) AS id", "concat('n', id) AS name", "id / 8 AS v", "CAST(id * 100.125 AS decimal(12,3)) AS d").coalesce(1).write.parquet(f"{path}/part={i}")
    partitioned = T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])
    assert file_facts.measure_files(spark, {"t": path}, store, {"t": partitioned}) == {"t": 3}
    assert same_as_scan(spark, path, store, partitioned)
    spark.range(500, 503).selectExpr("CAST(id AS int) AS id", "CAST(NULL AS string) AS name", "double('NaN') AS v", "CAST(0 AS decimal(12,3)) AS d").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/part=1")
    assert file_facts.measure_files(spark, {"t": path}, store, {"t": partitioned}) == {"t": 1}
    assert same_as_scan(spark, path, store, partitioned)
    for f in glob.glob(f"{path}/part=2/*"):
        os.remove(f)
    assert file_facts.measure_files(spark, {"t": path}, store, {"t": partitioned}) == {"t": 0}
    assert same_as_scan(spark, path, store, partitioned)
    # another column: all files are measured with it
    wider = T.StructType([*schema.fields, T.StructField("late", T.StringType()), T.StructField("part", T.IntegerType())])
    assert file_facts.measure_files(spark, {"t": path}, store, {"t": wider}) == {"t": 2}
    assert same_as_scan(spark, path, store, wider)


def test_files_without_rows_wide_tables_and_measuring_twice(spark, tmp_path):
    path, store = f"{tmp_path}/t", f"{tmp_path}/facts"
    wide = spark.range(20).select(*[(F.col("id") * i).alias(f"c {i}") for i in range(70)], F.lit(None).cast("string").alias("it's"))
    wide.where("false").coalesce(1).write.parquet(path)
    assert file_facts.measure_files(spark, {"t": path}, store, {"t": wide.schema}) == {"t": 1}
    assert rows(file_facts.file_profile(spark, {"t": path}, store, {"t": wide.schema}).select("column_name", "n_rows", "max_long", "precision")) == rows(
        profiles.scan_profile({"t": wide.where("false")}).select("column_name", "n_rows", "max_long", "precision"))
    wide.coalesce(1).write.mode("append").parquet(path)
    before = glob.glob(f"{store}/**/*.parquet", recursive=True)
    assert file_facts.measure_files(spark, {"t": path}, store, {"t": wide.schema}) == {"t": 1}
    assert same_as_scan(spark, path, store, wide.schema)
    # another run that measured the same files at the same time: their facts count once
    for f in set(glob.glob(f"{store}/**/*.parquet", recursive=True)) - set(before):
        with open(f.replace("part-", "part-9"), "wb") as out:
            out.write(open(f, "rb").read())
    assert same_as_scan(spark, path, store, wide.schema)


def test_a_lake_is_documented_again_from_stored_facts(spark, tmp_path):
    names = ("nation", "customer", "orders")
    tables = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in names}
    paths = {n: f"{SF_DIR}/{n}.parquet" for n in names}
    file_facts.measure_files(spark, paths, f"{tmp_path}/facts")
    again = document_lake(tables, profile=file_facts.file_profile(spark, paths, f"{tmp_path}/facts"))
    whole = document_lake(tables)
    assert rows(again["columns"]) == rows(whole["columns"]) and rows(again["tables"]) == rows(whole["tables"])


@pytest.fixture(scope="module")
def dump(spark):
    frames = native.mysql(spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 9"))
    ids = sorted(r.source_id for r in frames["database_info"].select("source_id").distinct().collect())
    return frames, ids


def of(frames, wanted):
    return {k: v.where(F.col("source_id").isin(wanted)) for k, v in frames.items()}


def test_readers_open_the_base_and_later_runs_only(spark, tmp_path, dump):
    frames, ids = dump
    path = str(tmp_path)
    for i in range(4):  # every run holds the first source again
        write_snapshot(of(frames, [ids[0], ids[i]]), path, "mysql", 2)
    expected = {k: rows(v) for k, v in read_snapshot(spark, path, "mysql").items()}
    base = compact_snapshot(spark, path, "mysql", 2)
    late = write_snapshot(of(frames, ids[4:5]), path, "mysql", 2)
    found = read_snapshot(spark, path, "mysql")
    assert {f.split("run=")[1].split("/")[0] for k in found for f in found[k].inputFiles()} == {base, late}
    for k in found:
        assert rows(found[k].where(F.col("source_id") != ids[4])) == expected[k]
    second = compact_snapshot(spark, path, "mysql", 2)
    assert second != base and compact_snapshot(spark, path, "mysql", 2) is None
    assert {r.source_id for r in read_snapshot(spark, path, "mysql", buckets=[0, 1])["tables"].select("source_id").distinct().collect()} == set(ids[:5])


def test_a_source_keeps_its_newest_run_when_an_older_one_lands_late(spark, tmp_path, dump):
    frames, ids = dump
    path, less = str(tmp_path), of(frames, ids[:1])
    less["tables"] = less["tables"].limit(1)
    write_snapshot(of(frames, ids[:3]), path, "mysql", 2, run="r2")
    write_snapshot(of(frames, ids[3:4]), path, "mysql", 2, run="r3")
    compact_snapshot(spark, path, "mysql", 2)
    write_snapshot(less, path, "mysql", 2, run="r1")
    assert rows(read_snapshot(spark, path, "mysql")["tables"]) == rows(of(frames, ids[:4])["tables"])
    write_snapshot(less, path, "mysql", 2, run="r4")
    assert read_snapshot(spark, path, "mysql")["tables"].where(F.col("source_id") == ids[0]).count() == 1
    with pytest.raises(ValueError):  # it is in the base
        write_snapshot(less, path, "mysql", 2, run="r2")
    with pytest.raises(ValueError):
        write_snapshot(less, path, "mysql", 2, run="r~5")


def test_a_run_that_broke_off_is_neither_read_nor_folded(spark, tmp_path, dump):
    frames, ids = dump
    path = str(tmp_path)
    write_snapshot(of(frames, ids[:1]), path, "mysql", 2, run="r1")
    write_snapshot(of(frames, ids[1:2]), path, "mysql", 2, run="r2")
    unfinished = write_snapshot({k: v for k, v in of(frames, ids[2:3]).items() if k != "database_info"}, path, "mysql", 2, run="r3")
    assert compact_snapshot(spark, path, "mysql", 2) is not None
    assert unfinished not in read_manifest(spark, path, "mysql").folded
    write_snapshot(of(frames, ids[2:3]), path, "mysql", 2, run="r3")
    assert rows(read_snapshot(spark, path, "mysql")["views"]) == rows(of(frames, ids[:3])["views"])


def test_states_changes_and_cleaning(spark, tmp_path, dump):
    frames, ids = dump
    path, less = str(tmp_path), of(frames, ids[:1])
    name = less["tables"].select("table_name").orderBy("table_name").head().table_name
    less["tables"] = less["tables"].where(F.col("table_name") != name)
    write_snapshot(of(frames, ids[:3]), path, "mysql", 2, run="r1")
    write_snapshot({k: v.unionByName(of(frames, ids[3:4])[k]) for k, v in less.items()}, path, "mysql", 2, run="r2")
    compact_snapshot(spark, path, "mysql", 2)
    write_snapshot(of(frames, ids[:2]), path, "mysql", 2, run="r3")

    def changes(before, after):
        return sorted((r.source_id, r.table_name, r.change, r.copies) for r in snapshot_changes(spark, path, "mysql", "tables", before, after).collect())

    gone = [(r.source_id, r.table_name) for r in of(frames, ids[:1])["tables"].where(F.col("table_name") == name).collect()]
    new = [(r.source_id, r.table_name) for r in of(frames, ids[3:4])["tables"].collect()]
    assert changes("r1", "r2") == sorted([(*x, "removed", 1) for x in gone] + [(*x, "added", 1) for x in new])
    assert changes("r2", "r3") == sorted((*x, "added", 1) for x in gone)
    assert changes("r1", "r3") == sorted((*x, "added", 1) for x in new)
    assert changes("r3", "r3") == []
    assert rows(read_snapshot(spark, path, "mysql", as_of="r1")["tables"]) == rows(of(frames, ids[:3])["tables"])
    now = rows(read_snapshot(spark, path, "mysql")["tables"])
    assert clean_snapshot(spark, path, "mysql") == []  # too soon
    assert clean_snapshot(spark, path, "mysql", timedelta(0)) == ["r1", "r2"]
    assert not [x for x in files.names(spark, f"{path}/dialect=mysql/tables") if x in ("run=r1", "run=r2")]
    assert rows(read_snapshot(spark, path, "mysql")["tables"]) == now
    assert changes("r2", "r3") == sorted((*x, "added", 1) for x in gone)
    with pytest.raises(ValueError):
        changes("r1", "r3")


def test_landed_runs_are_not_broadcast(spark, tmp_path, dump):
    """What says which run of a source counts has a row for each source."""
    frames, ids = dump
    path = str(tmp_path)
    runs = [write_snapshot(of(frames, ids[i : i + 2]), path, "mysql", 2) for i in (0, 1)]
    for df in (read_snapshot(spark, path, "mysql")["tables"], snapshot_changes(spark, path, "mysql", "tables", *runs)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
