"""Vector codes: each vector becomes the indexes of its parts' nearest codebook entries, in exact integers.

Codebooks come from Lloyd's rounds over all vectors. A part whose entry did not move in the last update keeps its
exact distance, so it compares only the entries that did; all other parts look at every entry again. Each round
reads the vectors and their state once and writes the next state beside the sums of the entries: no shuffle of vectors, and
a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import remove, written
from lakescribe.llm.common import map_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of larger absolute value could make a squared distance that is no 64-bit integer.
_LARGEST = 1 << 26


@dataclass(frozen=True)
class Codebooks:
    """entries: part x entry x component, integers. moved: the entries that the last update changed."""

    entries: np.ndarray
    moved: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def updated(self, sums: dict[tuple[int, int], tuple[int, dict[int, int]]]) -> Codebooks:
        """Each entry with parts becomes their floored mean; sums: (part, entry) -> number, sum by component."""
        new = self.entries.copy()
        for (p, e), (n, total) in sums.items():
            new[p, e] = [total[i] // n for i in range(new.shape[2])]
        return Codebooks(new, (new != self.entries).any(axis=2))


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (row x entry) of the parts from the entries."""
    found = np.empty((len(parts), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        gap = parts - entry
        found[:, e] = np.einsum("ij,ij->i", gap, gap)
    return found


def assign(vectors: np.ndarray, books: Codebooks, state: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), row x part; ties go to the lower index.

    state: what the last round gave, exact for its codebooks. Without one, every part is compared with every entry.
    """
    n, (parts, _, size) = len(vectors), books.entries.shape
    cubes = vectors.reshape(n, parts, size)
    codes, errors = (x.copy() for x in state) if state else (np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64))
    for p in range(parts):
        moved = np.flatnonzero(books.moved[p])
        anew = np.flatnonzero(books.moved[p][codes[:, p]]) if state else np.arange(n)
        if len(anew):
            d = distances(cubes[anew, p], books.entries[p])
            codes[anew, p], errors[anew, p] = d.argmin(axis=1), d.min(axis=1)
        if not state or not len(moved):
            continue
        kept = np.ones(n, bool)
        kept[anew] = False
        kept = np.flatnonzero(kept)
        if not len(kept):
            continue
        d = distances(cubes[kept, p], books.entries[p, moved])
        best, least = moved[d.argmin(axis=1)], d.min(axis=1)
        old_code, old = codes[kept, p], errors[kept, p]
        wins = (least < old) | ((least == old) & (best < old_code))
        codes[kept[wins], p], errors[kept[wins], p] = best[wins], least[wins]
    return codes, errors


def _integers(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a whole vector, and their components as floor(4096 * x)."""
    column = batch.column(2)
    found = column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy() == size)
    flat = column.filter(pa.array(found)).flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy().astype(np.float64).reshape(-1, size)
    whole = (np.isfinite(values) & ~bad.reshape(-1, size)).all(axis=1)
    found[found] = whole
    values = np.floor(values[whole] * SCALE)
    if len(values) and np.abs(values).max() > _LARGEST:
        raise ValueError(f"components beyond {_LARGEST // SCALE} are too large for 64-bit squared distances")
    return found, values.astype(np.int64)


def _first_vectors(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The integer vectors of the smallest kept ids (at most `entries` of them), row x component."""
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(whole).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = kept.limit(entries).toArrow()  # bounded: as many rows as entries
    if not len(first):
        return np.zeros((0, 0), np.int64)
    size = len(first.column("v")[0])
    if any(len(x) != size for x in first.column("v")):
        first = kept.where(F.size("v") == size).limit(entries).toArrow()
    batch = first.select(["vec_id", "label", "v"]).combine_chunks().to_batches()[0]
    return _integers(batch, size)[1]


_STATE = "v binary, codes binary, errors binary, error bigint, part int, entry int, n bigint, total array<bigint>"


def _round(rows: DataFrame, books: Codebooks, first: bool) -> tuple[DataFrame, str]:
    """One assignment, written: (vec_id, label, v, codes, errors, error) of each vector, v and its state packed, and at
    the end of each task the number and sum of its parts by (part, entry)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, {_STATE}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = shared.value, None
        number, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            kept = batch.schema.field(0).type, batch.schema.field(1).type
            if first:
                found, vectors = _integers(batch, parts * width)
                batch, state = batch.filter(pa.array(found)), None
            else:
                vectors, codes, errors = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), t).reshape(batch.num_rows, -1)
                    for i, t in ((2, np.int32), (3, np.uint8), (4, np.int64)))
                vectors, state = vectors.astype(np.int64), (codes, errors)
            if not batch.num_rows:
                continue
            codes, errors = assign(vectors, own, state)
            for p in range(parts):
                number[p] += np.bincount(codes[:, p], minlength=entries)
                for i in range(width):  # sums of a batch are exact in doubles
                    total[p, :, i] += np.bincount(codes[:, p], vectors[:, p * width + i], entries).astype(np.int64)
            packed = [pa.array([x.tobytes() for x in block], pa.binary()) for block in (vectors.astype(np.int32), codes, errors)]
            blank = [pa.nulls(len(vectors), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed, pa.array(errors.sum(axis=1)), *blank], names=names)
        if kept is not None:
            p, e = np.nonzero(number)
            blank = [pa.nulls(len(p), t) for t in (*kept, pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(number[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=names)

    return written(map_arrow(rows, run, schema))


def _sums(state: DataFrame) -> dict[tuple[int, int], tuple[int, dict[int, int]]]:
    """Number and component sums by (part, entry): one row for each component of the codebooks."""
    rows = state.where("part IS NOT NULL").select("part", "entry", "n", F.posexplode("total").alias("i", "x"))
    whole = rows.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
    for r in whole.collect():  # as many rows as the codebooks have components
        found.setdefault((r.part, r.entry), (r.n, {}))[1][r.i] = int(r.x)
    return found


def vector_codes(vectors: DataFrame, vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector.

    Vectors that are null, hold null or non-finite components, or differ in length from the one with the least id
    (of those whose length is a multiple of `parts`, and not 0) are left out. Components become floor(4096 * x); an absolute
    value beyond 2^26 raises an error. Each part position's codebook begins with the parts of the vectors of least
    vec_id (null last; equal ids by vector), so with fewer vectors it has fewer entries; repeated rows are vectors of
    their own. After `rounds` updates the parts are assigned once more. code: an index for each part as two hex digits; error: sum of the squared
    distances; label_error: its sum over the rows of the label, nulls together. Other columns are ignored.
    """
    if not (0 < entries <= 256 and parts > 0 and rounds >= 0):
        raise ValueError("entries must be 1 to 256, parts 1 or more")
    rows = vectors.select("vec_id", "label", F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    spark = rows.sparkSession
    begin = _first_vectors(rows, parts, entries)
    if not len(begin):
        return rows.where("false").select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    start = begin.reshape(len(begin), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start, np.ones(start.shape[:2], bool))
    state, folder = _round(rows, books, True)
    for _ in range(rounds):
        books = books.updated(_sums(state))
        if not books.moved.any():  # all further rounds would give the same
            break
        old, (state, folder) = folder, _round(state.where("part IS NULL"), books, False)
        remove(spark, old)
    final = state.where("part IS NULL").select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    by_label = final.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return final.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of vector_codes(embeddings): plain rounds, every part against every entry."""
    ctes = [f"""k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v FROM k, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {ENTRIES})"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (
  SELECT r, x.p AS p, any_value(x.v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': e}}) AS n
  FROM x JOIN c{k} c ON c.p = x.p GROUP BY r, x.p)""")
        if k < rounds:
            ctes.append(f"""m{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT p, n.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p AS p, c.e AS e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)""")
    return "WITH " + ",\n".join(ctes) + f""",
g AS (SELECT r, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN g USING (r)
"""
