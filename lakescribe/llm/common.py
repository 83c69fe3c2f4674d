"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.scratch import cut, shared_folder  # noqa: F401

#: Texts go through the helpers in chunks of about so many bytes; one text is never cut.
CHUNK_BYTES = 8 << 20

Chunk = list[bytes]
Worker = Callable[[Chunk], Sequence]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def chunks(texts: Chunk, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> Chunk:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def per_text(
    docs: DataFrame, worker: Callable[[], Worker], schema: T.StructType,
    keep: Sequence[str] = ("doc_id",), text_col: str = "text",
) -> DataFrame:
    """Columns that a worker computes from each whole text, beside the columns to keep.

    `worker()` runs once per task and gives a function from a chunk of texts to one sequence per field of
    `schema`. Narrow: no shuffle, memory bounded by an Arrow batch. Null text is empty text. A kept column
    whose name is also a computed one is left out; choose `fresh` names where that must not be.
    """
    kept = [c for c in keep if c not in schema.names]
    again = text_col in kept and docs.schema[text_col].dataType == T.StringType()  # the text goes over once
    place = kept.index(text_col) if again else len(kept)
    made = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker()
        for batch in batches:
            texts = text_bytes(batch.column(place))
            for a, b in chunks(texts):
                columns = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                columns += [pa.array(x, f.type) for x, f in zip(work(texts[a:b]), made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *schema.names])

    text = [] if again else [F.col(f"`{text_col}`").cast("string").alias(fresh("text", kept))]
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], *text)
    out = T.StructType([*[narrow.schema[i] for i in range(len(kept))], *schema.fields])
    return map_arrow(narrow, run, out)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
}


def fresh(name: str, taken: Sequence[str]) -> str:
    """The name, or with as many underscores behind it as it takes to differ from the names that are taken."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name += "_"
    return name


def fold(doc_id: Column, of: int = 5) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of consecutive rows that are equal in the first `keys` columns, across batches.

    Holds one run at a time, so only for runs of bounded size.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            column = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(batch.column(i)[a].as_py() for i in range(keys))
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


#: A file's place, or a function that an executor asks for its place there.
Place = str | Callable[[], str]


def located(path: Place) -> str:
    return path() if callable(path) else path


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def span_digest(spans: Sequence[tuple[str, int, int]]) -> str:
    """kind:start:end of the spans in their order, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def code_points(text: bytes, offsets: Sequence[int]) -> dict[int, int]:
    """Code point offsets of byte offsets that are character boundaries."""
    if text.isascii():
        return {x: x for x in offsets}
    found, at, points = {}, 0, 0
    for x in sorted(set(offsets)):
        points += len(text[at:x].decode())
        found[x], at = points, x
    return found
