import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session(4)
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="session")
def fleet_catalog(spark, tmp_path_factory):
    """The fleet's catalog at the smallest scale, landed once for all report tests."""
    import __spark_entry__ as entry
    from lakescribe.sinks import write_catalog
    from lakescribe.sources import read_catalog

    path = str(tmp_path_factory.mktemp("catalog"))
    write_catalog(entry._catalog(spark, SF_DIR), path, buckets=4)
    return read_catalog(spark, path)


@pytest.fixture(scope="session")
def lake_catalog(spark):
    import __spark_entry__ as entry

    return entry._lake_catalog(spark, SF_DIR)
