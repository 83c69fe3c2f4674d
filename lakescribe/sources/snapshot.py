"""Landed catalog dumps: `<path>/dialect=<dialect>/<relation>/run=<run>/source_bucket=<n>/*.parquet`.

Dialects have different relations, so the dialect is chosen by path; run and bucket are partition columns.
Each write is a run of its own and replaces nothing of other runs, so a fleet lands in batches. Of a source
that several runs hold, the newest counts, in all relations. A run counts once its database_info is there,
which is written last: one that broke off is not read.

Runs accumulate. `compact_snapshot` folds all finished ones into a base, a run that holds the newest rows of every source,
and commits it by one small file, the manifest `<path>/dialect=<dialect>/_manifest/<time>.json`. From then on readers open
the base and the runs that it has not folded, nothing else. `clean_snapshot` removes folded runs; until then any
earlier state can be read, and `snapshot_changes` compares two states.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions import files
from lakescribe.model import local_frame, spread
from lakescribe.sources.fleet import Database, read_fleet
from lakescribe.sources.jdbc import JdbcSource, read_catalog_jdbc
from lakescribe.sources.native import NATIVE, native_schema

BUCKETS = 64
# Every source has rows in this relation.
LAST = "database_info"
# In the database_info of a base: the run that a source comes from.
_ORIGIN = "landed_run"
_RUN_NAME = re.compile(r"[\w.-]+")


@dataclass(frozen=True)
class Manifest:
    """base: the run that stands for the folded ones; lost: the newest run that has been removed, '' if none has."""

    base: str = ""
    folded: tuple[str, ...] = ()
    lost: str = ""


def _root(path: str, dialect: str) -> str:
    if dialect not in NATIVE:
        raise ValueError(f"unsupported database type: {dialect} (supported: {', '.join(sorted(NATIVE))})")
    return f"{path.rstrip('/')}/dialect={dialect}"


def _location(path: str, dialect: str, relation: str) -> str:
    return f"{_root(path, dialect)}/{relation}"


def _origin(run: str) -> str:
    """The newest run that a base has folded; an ordinary run itself."""
    return run.split("~")[0]


def _manifest_names(spark: SparkSession, path: str, dialect: str) -> list[str]:
    return [x for x in files.names(spark, f"{_root(path, dialect)}/_manifest") if x.endswith(".json")]


def read_manifest(spark: SparkSession, path: str, dialect: str) -> Manifest:
    """The newest manifest; an empty one before the first compaction."""
    found = _manifest_names(spark, path, dialect)
    if not found:
        return Manifest()
    content = json.loads(files.read_text(spark, f"{_root(path, dialect)}/_manifest/{found[-1]}"))
    return Manifest(content["base"], tuple(content["folded"]), content["lost"])


def _commit(spark: SparkSession, path: str, dialect: str, manifest: Manifest) -> None:
    files.write_text(spark, f"{_root(path, dialect)}/_manifest", f"{new_run()}.json", json.dumps(asdict(manifest)))


def _runs(spark: SparkSession, path: str, dialect: str, relation: str = LAST) -> list[str]:
    return [x[4:] for x in files.names(spark, _location(path, dialect, relation)) if x.startswith("run=")]


def _chosen_runs(spark: SparkSession, path: str, dialect: str, as_of: str | None) -> list[str]:
    """The runs that hold a state: the base and what it has not folded; of a state before the base, all runs up to it."""
    manifest = read_manifest(spark, path, dialect)
    if as_of is not None and as_of < manifest.lost:
        raise ValueError(f"runs up to {manifest.lost} have been removed; the state of {as_of} cannot be read")
    found = _runs(spark, path, dialect)
    if as_of is None or as_of >= _origin(manifest.base):
        folded = set(manifest.folded)
        found = [r for r in found if r not in folded]
    return found if as_of is None else [r for r in found if _origin(r) <= as_of]


def _rows(spark: SparkSession, path: str, dialect: str, relation: str, runs: Iterable[str]) -> DataFrame:
    """Rows of some runs, with run and source_bucket; only the folders of these runs are listed."""
    origin = [T.StructField(_ORIGIN, T.StringType())] if relation == LAST else []
    landed = T.StructType([
        *native_schema(dialect, relation).fields, *origin, T.StructField("run", T.StringType()), T.StructField("source_bucket", T.IntegerType())])
    there, base = set(_runs(spark, path, dialect, relation)), _location(path, dialect, relation)
    paths = [f"{base}/run={r}" for r in runs if r in there]
    return spark.read.schema(landed).option("basePath", base).parquet(*paths) if paths else local_frame(spark, [], landed)


def _newest(info: DataFrame) -> DataFrame:
    """Of each source the run it comes from, and the folder that holds it, (source_id, landed_run, run)."""
    place = F.max(F.struct(F.coalesce(_ORIGIN, "run").alias(_ORIGIN), "run")).alias("place")
    return info.groupBy("source_id").agg(place).select("source_id", "place.*")


def read_snapshot(
    spark: SparkSession, path: str, dialect: str, buckets: Iterable[int] | None = None, as_of: str | None = None
) -> dict[str, DataFrame]:
    """Native frames of one dialect, of each source its newest run; a choice of buckets prunes directories.

    as_of: the state when the run of this name, or of the last name before it, was the newest one.
    """
    runs = _chosen_runs(spark, path, dialect, as_of)
    chosen = None if buckets is None else list(buckets)

    def rows(relation: str) -> DataFrame:
        found = _rows(spark, path, dialect, relation, runs)
        return found if chosen is None else found.where(F.col("source_bucket").isin(*chosen))

    newest = _newest(rows(LAST)).select("source_id", "run")
    return {
        relation: rows(relation).join(spread(newest), ["source_id", "run"], "left_semi").select(*native_schema(dialect, relation).names)
        for relation in NATIVE[dialect]
    }


def snapshot_changes(spark: SparkSession, path: str, dialect: str, relation: str, before: str, after: str) -> DataFrame:
    """Rows of a relation that the state of one run has and that of another has not: the relation's columns,
    change (`removed` or `added`) and copies, by how many equal rows.

    Only sources that landed between the two states are compared, by one grouping of their rows; equal rows of
    both states meet there and cancel out, so a source that landed again unchanged gives nothing.
    """
    columns = native_schema(dialect, relation).names
    sides = []
    for state, sign in ((before, -1), (after, 1)):
        runs = _chosen_runs(spark, path, dialect, state)
        sides.append((_newest(_rows(spark, path, dialect, LAST, runs)), _rows(spark, path, dialect, relation, runs), sign))
    places = sides[0][0].unionByName(sides[1][0])
    # a source of one state only, or from different runs in the two
    moved = places.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min(_ORIGIN).alias("low"), F.max(_ORIGIN).alias("high"))
    moved = moved.where("n = 1 OR low <> high").select("source_id")
    parts = [
        rows.join(spread(newest.join(spread(moved), "source_id", "left_semi")), ["source_id", "run"], "left_semi").select(*columns, F.lit(sign).alias("__sign"))
        for newest, rows, sign in sides
    ]
    total = parts[0].unionByName(parts[1]).groupBy(*columns).agg(F.sum("__sign").alias("__sign")).where("__sign <> 0")
    change = F.when(F.col("__sign") > 0, "added").otherwise("removed")
    return total.select(*columns, change.alias("change"), F.abs("__sign").alias("copies"))


def new_run() -> str:
    """A run's name; names sort by time."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def _land(rows: DataFrame, path: str, dialect: str, relation: str, run: str, buckets: int) -> None:
    bucketed = rows.withColumn("source_bucket", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int"))
    (
        bucketed.hint("rebalance", "source_bucket").sortWithinPartitions("source_bucket", "source_id")
        .write.mode("overwrite").partitionBy("source_bucket").parquet(f"{_location(path, dialect, relation)}/run={run}")
    )


def write_snapshot(
    frames: Mapping[str, DataFrame], path: str, dialect: str, buckets: int = BUCKETS, run: str | None = None
) -> str:
    """Land native frames so that read_snapshot finds them; gives the run's name.

    Writing a run of the same name again replaces that run and nothing else; a run that a base has folded is final.
    """
    run = run or new_run()
    if not _RUN_NAME.fullmatch(run):
        raise ValueError(f"a run's name is letters, digits, '_', '.' and '-': {run}")
    spark = next(iter(frames.values())).sparkSession
    manifest = read_manifest(spark, path, dialect)
    if run in manifest.folded or run <= manifest.lost:
        raise ValueError(f"run {run} has been folded or is older than one that was removed")
    for relation in sorted(frames, key=lambda x: x == LAST):
        _land(frames[relation], path, dialect, relation, run, buckets)
    return run


def compact_snapshot(spark: SparkSession, path: str, dialect: str, buckets: int = BUCKETS) -> str | None:
    """Fold all finished runs into a base; gives its name, or None if there is nothing to fold.

    The base is a run of its own that nobody reads before the manifest names what it has folded; one that broke off
    does no harm. Runs that land meanwhile stay as they are. Finished are runs whose database_info has
    the marker file that Spark's writer leaves. One compaction or cleaning of a dialect at a time.
    """
    manifest = read_manifest(spark, path, dialect)
    there = _runs(spark, path, dialect)
    done = [r for r in there if r not in manifest.folded and files.exists(spark, f"{_location(path, dialect, LAST)}/run={r}/_SUCCESS")]
    if not [r for r in done if r != manifest.base] or len(done) < 2:
        return None
    base = f"{max(map(_origin, done))}~{uuid.uuid4().hex[:8]}"
    info = _rows(spark, path, dialect, LAST, done)
    newest = _newest(info)
    for relation in sorted(NATIVE[dialect], key=lambda x: x == LAST):
        columns = native_schema(dialect, relation).names
        rows = info.drop(_ORIGIN) if relation == LAST else _rows(spark, path, dialect, relation, done)
        kept = rows.join(spread(newest), ["source_id", "run"]).select(*columns, *([_ORIGIN] if relation == LAST else []))
        _land(kept, path, dialect, relation, base, buckets)
    folded = tuple(sorted({*done, *(r for r in manifest.folded if r in there)}))
    _commit(spark, path, dialect, Manifest(base, folded, manifest.lost))
    return base


def clean_snapshot(spark: SparkSession, path: str, dialect: str, older_than: timedelta = timedelta(days=1)) -> list[str]:
    """Remove the runs that the newest base has folded, and older manifests; gives the names of the runs.

    Nothing happens before the manifest is of that age: whoever reads what came before it can finish.
    States before the base cannot be read any more, which is written down before anything is removed.
    """
    named, manifest = _manifest_names(spark, path, dialect), read_manifest(spark, path, dialect)
    written = datetime.strptime(named[-1].split("-")[0], "%Y%m%dT%H%M%S%f").replace(tzinfo=timezone.utc) if named else None
    if written is None or not manifest.folded or datetime.now(timezone.utc) - written < older_than:
        return []
    _commit(spark, path, dialect, replace(manifest, lost=max(manifest.lost, *map(_origin, manifest.folded))))
    for relation in NATIVE[dialect]:
        there = set(_runs(spark, path, dialect, relation))
        for run in manifest.folded:
            if run in there:
                files.delete(spark, f"{_location(path, dialect, relation)}/run={run}")
    for name in named:
        files.delete(spark, f"{_root(path, dialect)}/_manifest/{name}")
    return list(manifest.folded)


def land_fleet(
    spark: SparkSession, sources: Sequence[JdbcSource], dialect: str, path: str, batch: int = 50, buckets: int = BUCKETS,
    queries: Mapping[str, str] | None = None,
) -> list[tuple[int, str]]:
    """Land the catalogs of many databases in batches; gives (source_id, error) of those that failed.

    A batch that fails is tried again one database at a time, so one that is down costs no other.
    """
    failed, todo = [], [list(sources[i : i + batch]) for i in range(0, len(sources), batch)]
    while todo:
        part = todo.pop(0)
        try:
            write_snapshot(read_catalog_jdbc(spark, part, dialect, queries), path, dialect, buckets)
        except Exception as error:  # whatever a driver throws
            if len(part) > 1:
                todo = [[x] for x in part] + todo
            else:
                failed.append((part[0].source_id, str(error).splitlines()[0]))
    return failed


def land_databases(
    spark: SparkSession, databases: Sequence[Database], dialect: str, path: str, module: str, buckets: int = BUCKETS,
    queries: Mapping[str, str] | None = None,
) -> DataFrame:
    """Land the catalogs of any number of databases as one run, through a DB-API module on the executors.

    Gives the errors (source_id, relation, error) of the databases that are not in the run.
    """
    frames, errors = read_fleet(spark, databases, dialect, module, queries)
    write_snapshot(frames, path, dialect, buckets)
    return errors
