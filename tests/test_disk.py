"""What reports leave on the executors' disks."""

import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_DIR
from fleet import native
from lakescribe.functions.scratch import cut
from lakescribe.operators import docs, pages
from lakescribe.operators.documents import schema_documents
from lakescribe.operators.parts import whole_texts
from lakescribe.sinks import write_pages


@pytest.fixture(scope="module")
def few(fleet_catalog):
    """Catalog of the first sources only."""
    return {k: df.where(F.floor(F.col("source_id") / 4) < 2) for k, df in fleet_catalog.items()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().endswith(".data") for i in range(files.size()))


def less_than(spark, before: int) -> bool:
    """Files are removed in the background."""
    for _ in range(50):
        if shuffle_files(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_steps_remove_their_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    kept = cut(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    assert less_than(spark, before)
    write_pages(spark.createDataFrame([(1, "x"), (2, "y")], "source_id long, html string"), str(tmp_path / "pages"), buckets=2)
    assert less_than(spark, before)
    assert len(kept.collect()) == 7


def test_staged_catalogs_are_the_same_without_joins(spark):
    customer = spark.read.parquet(f"{SF_DIR}/customer.parquet").where("c_custkey < 3")
    dumps = {"postgresql": native.BUILDERS["postgresql"](customer)}
    lazy, staged = (entry.extract(dumps, entry.ExtractConfig(schemas="*", extracted_at=entry.FLEET_TIME, staged=s)) for s in (False, True))
    for kind in ("sources", "columns", "indexes", "synonyms"):
        assert rows(staged[kind]) == rows(lazy[kind])
        assert "Join" not in staged[kind]._jdf.queryExecution().toString()


@pytest.mark.parametrize("all_kinds", [False, True])
def test_outlines_of_large_and_small_sources_agree(few, all_kinds):
    small = docs.doc_outline(few, with_views_and_synonyms=all_kinds)
    assert small._jdf.queryExecution().toString().count("rangepartitioning") == 0
    # some sources above the limit, some not; then all
    for lines in (130, 1):
        assert rows(docs.doc_outline(few, with_views_and_synonyms=all_kinds, task_lines=lines)) == rows(small)


def test_outlines_bound_their_lines(few):
    bound = sum(few[k].where("source_id = 6").count() * n for k, n in docs._MOST_LINES.items())
    assert docs.doc_outline(few, with_views_and_synonyms=True).where("source_id = 6").count() <= bound


def test_documents_of_huge_and_other_sources_agree(few):
    pieces = schema_documents(few, 4_096)
    assert pieces._jdf.queryExecution().toString().count("rangepartitioning") == 0
    for task in (1, 13_000):
        assert rows(schema_documents(few, 4_096, task)) == rows(pieces)


def test_texts_of_huge_and_other_sources_agree(spark):
    rnd = random.Random(5)
    lines = [(rnd.randint(0, 5) ** 2, rnd.randint(0, 40), rnd.choice([None, "", "ä", "bcd", "e" * 9])) for _ in range(900)]
    df = spark.createDataFrame(lines, "source_id long, n int, text string").repartition(5)
    found = [rows(whole_texts(df, ["n"], 64, task)) for task in (1, 400, 1 << 20)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
