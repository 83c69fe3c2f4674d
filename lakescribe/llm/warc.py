"""WARC archives of pages, and the capture histories that their index gives.

Writing: one record a page, payloads that occur again become revisits of one response. Archives are gzip files of
records, written by Spark's text writer, so any file system that Spark knows will do.

Reading: each archive is one task that follows Content-Length through its lines, checks the digest of each payload and
gives its captures as sorted runs. The runs are merged by URL key and time outside of memory: a run is a sequence of
blocks, Spark sorts the blocks (not the captures) by their first key within ranges of keys, and a task streams
them into a loser tree, where at most the blocks that overlap are open. So the order is global across ranges, and no task
holds a range, a run or the captures of a URL.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut, new_folder
from lakescribe.llm.common import map_arrow
from lakescribe.operators.numbering import numbered

#: Smaller payloads are never revisits.
LEAST_BYTES = 1_000
#: Captures that a task sorts at once, captures in a block of a run, blocks in a range at least, and ranges at most.
RUN_ROWS, BLOCK_ROWS, RANGE_BLOCKS, RANGES = 50_000, 256, 64, 4_096

# Names of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = 946_684_800


# --- writing --------------------------------------------------------------------------------------


def _uuid(page_id: Column, key: Column) -> Column:
    """A record id from the page and its payload, so that a revisit can name its response."""
    h = F.md5(F.concat_ws(":", page_id.cast("string"), F.hex(key)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _on_one_line(url: Column) -> Column:
    """The URL with blanks and control characters percent-encoded; null is empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_archives(pages: DataFrame, path: str, time_col: str | None = None) -> None:
    """Gzipped WARC files below path, one for each task, with one record for each row.

    Of rows whose html is equal and has 1,000 bytes or more, those of the largest page_id are responses, all others revisits
    that name it; without any id they are all responses, as are smaller ones. Null html is an empty payload. Equal rows are
    records of their own. The time of a capture is time_col, or without one 2000-01-01 plus page_id seconds (modulo
    2^31). Other columns are ignored. Payloads are shuffled only if the revisits are too many for a broadcast.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    at = F.col(f"`{time_col}`").cast("timestamp") if time_col else F.timestamp_seconds(F.lit(_EPOCH) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1 << 31)), F.lit(0)))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), _on_one_line(F.col("url")).alias("url"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("key"),
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    facts = cut(rows.where(F.octet_length("html") >= LEAST_BYTES).select("page_id", "key"))
    best = facts.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    again = facts.join(best.select("key", "refers_to"), "key").where("page_id IS NULL OR page_id != refers_to").distinct()
    revisits = cut(again.select(F.col("page_id").alias("p"), F.col("key").alias("k"), "refers_to"))
    whole = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left")

    revisit, line = F.col("refers_to").isNotNull(), F.lit("\r\n")
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, line)
    optional = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _uuid(F.col("page_id"), F.col("key"))), field("WARC-Date", F.coalesce("at", F.lit("2000-01-01T00:00:00Z"))),
        field("WARC-Target-URI", F.col("url")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        optional("Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit(_PROFILE)), field("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("key"))),
            field("Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http;msgtype=response")), field("Content-Length", F.octet_length(block).cast("string")),
        line, block, line)  # the writer ends it with one line end more
    whole.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


# --- reading --------------------------------------------------------------------------------------


_SCHEME, _WWW, _USER_PORT = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://"), re.compile(r"^www[0-9]*\."), re.compile(r"^.*@|:[0-9]*$")


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query; without scheme, user, port, www and fragment."""
    rest = _SCHEME.sub("", url.split("#", 1)[0])
    host = re.match(r"[^/?]*", rest)[0]
    path = rest[len(host) :]
    name = ",".join(reversed(_WWW.sub("", _USER_PORT.sub("", host.lower())).split(".")))
    return f"{name}){'' if path.startswith('/') else '/'}{path}"


class ArchiveReader:
    """Records of one archive from its lines (without their line ends), in order; holds one record at a time."""

    def __init__(self, archive: str):
        self.archive, self.offset, self.start = archive, 0, 0
        self.fields: dict[str, str] | None = None
        self.head: list[bytes] = []
        self.block: list[bytes] = []
        self.missing = 0

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes, int, int] | None:
        """(fields, block, offset, length) when the line ends a record."""
        at, self.offset = self.offset, self.offset + len(line) + 2
        if self.fields is None:
            if line:
                if not self.head:
                    self.start = at
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"{self.archive} has no record at {at}")
                self.head.append(line)
            elif self.head:
                pairs = [x.decode("utf-8", "replace").partition(":") for x in self.head[1:]]
                self.fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
                self.missing = int(self.fields["content-length"]) + 2
            return None
        self.block.append(line)
        self.missing -= len(line) + 2
        if self.missing > 0:
            return None
        if self.missing < 0:
            raise ValueError(f"{self.archive}: the record at {self.start} is longer than it says")
        found = self.fields, b"\r\n".join(self.block), self.start, self.offset - self.start
        self.fields, self.head, self.block = None, [], []
        return found

    def close(self) -> None:
        if self.fields is not None or self.head:
            raise ValueError(f"{self.archive} ends inside the record at {self.start}")


_CAPTURE = pa.schema([
    ("key", pa.binary()), ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()),
])
_COLUMNS = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, record_offset bigint"


def capture(archive: str, fields: dict[str, str], block: bytes, offset: int) -> dict:
    """The index entry of a response or revisit; raises if a payload is not what its digest says."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].partition(":")[2]
    page_id, refers_to = fields.get("page-id"), fields.get("refers-to-page-id")
    if fields["warc-type"] == "revisit":
        size = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1])
    else:
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{archive}: the payload of the record at {offset} is damaged")
    key, at = url_key(fields["warc-target-uri"]), fields["warc-date"]
    page = "" if page_id is None else f"{int(page_id) + (1 << 63):020d}"
    return {
        "key": "\0".join([key, at, page, archive, f"{offset:020d}"]).encode(), "url_key": key, "captured_at": at, "page_id": None if page_id is None else int(page_id),
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": None if refers_to is None else int(refers_to),
        "archive": archive, "record_offset": offset}


def packed(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


_BLOCK = pa.schema([("run", pa.string()), ("seq", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("body", pa.binary())])


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, seq, first, last, body): the captures of the archives below path as sorted runs, in blocks with their first and
    last key. An archive is one task, since gzip files are not split; a run has RUN_ROWS captures at most."""

    def blocks(name: str, held: list[dict]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda c: c["key"])
        for seq, a in enumerate(range(0, len(held), BLOCK_ROWS)):
            own = pa.RecordBatch.from_pylist(held[a : a + BLOCK_ROWS], _CAPTURE)
            yield pa.RecordBatch.from_pylist([{
                "run": name, "seq": seq, "first": held[a]["key"], "last": own.column(0)[-1].as_py(), "body": packed(own)}], _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, number = None, [], 0
        for batch in batches:
            for archive, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if reader is None or archive != reader.archive:
                    if reader:
                        reader.close()
                        yield from blocks(f"{reader.archive}:{number}", held)
                    reader, held, number = ArchiveReader(archive), [], 0
                found = reader.feed(line.as_buffer().to_pybytes())
                if found is None or found[0].get("warc-type") not in ("response", "revisit"):
                    continue
                held.append(capture(archive, *found[:3]))
                if len(held) >= RUN_ROWS:
                    yield from blocks(f"{archive}:{number}", held)
                    held, number = [], number + 1
        if reader:
            reader.close()
            yield from blocks(f"{reader.archive}:{number}", held)

    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("line"))
    return map_arrow(lines, run, "run string, seq int, first binary, last binary, body binary")


# --- merging --------------------------------------------------------------------------------------


class LoserTree:
    """Tournament of sorted sources: inner nodes hold losers, so a new key of the winner meets one node a level."""

    def __init__(self, keys: list):
        self.size = 1
        while self.size < len(keys):
            self.size *= 2
        self.keys = [*keys, *[None] * (self.size - len(keys))]  # None: a source that has ended
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y)

    @property
    def least(self):
        """The winner's key; None if all sources have ended."""
        return self.keys[self.winner]

    def replace(self, key) -> None:
        """The winner's next key."""
        now = self.winner
        self.keys[now] = key
        node = (now + self.size) // 2
        while node:
            if self._before(self.losers[node], now):
                now, self.losers[node] = self.losers[node], now
            node //= 2
        self.winner = now


def merged(blocks: Iterator[tuple[bytes, pa.RecordBatch]], chunk: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their first column from sorted blocks, which come in the order of their first keys.

    Only blocks that overlap are open at one time: a block is opened when its first key comes up.
    """
    opened: list[list] = []  # of each source in the tree: rows, keys, place
    tree = LoserTree([])
    coming = next(blocks, None)
    taken: list[tuple[int, int]] = []

    def given() -> pa.RecordBatch:
        starts, total = [], 0
        for rows, _, _ in opened:
            starts.append(total)
            total += rows.num_rows
        table = pa.Table.from_batches([rows for rows, _, _ in opened])
        chosen = table.take(pa.array([starts[s] + i for s, i in taken], pa.int64())).combine_chunks()
        taken.clear()
        return chosen.to_batches()[0]

    while coming is not None or tree.least is not None:
        if coming is not None and (tree.least is None or coming[0] <= tree.least):
            if taken:
                yield given()
            opened = [x for x in opened if x[2] < len(x[1])]
            opened.append([coming[1], coming[1].column(0).to_pylist(), 0])
            tree = LoserTree([keys[i] for _, keys, i in opened])
            coming = next(blocks, None)
            continue
        source = opened[tree.winner]
        taken.append((tree.winner, source[2]))
        source[2] += 1
        tree.replace(source[1][source[2]] if source[2] < len(source[1]) else None)
        if len(taken) >= chunk:
            yield given()
    if taken:
        yield given()


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures of the runs with ord, their place (from 0) in the order of URL key, time and page.

    Key ranges are cut at first keys of blocks, at most RANGES of them, chosen by the places of all blocks; a block that
    lies across a cut is divided. A URL of very many captures is many ranges, since keys go on with time and page.
    """
    runs = cut(runs)
    n_blocks = runs.count()
    step = max(RANGE_BLOCKS, -(-n_blocks // RANGES))
    cuts = numbered(runs.select(F.lit(0).alias("all"), "first"), ["all"], ["first"], "place", 0).where((F.col("place") > 0) & (F.col("place") % step == 0))
    bounds = sorted(bytes(r.first_key) for r in cuts.select(F.col("first").alias("first_key")).collect())  # RANGES at most
    shared = runs.sparkSession.sparkContext.broadcast(bounds)

    def divide(batches):
        own = shared.value
        schema = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("body", pa.binary())])
        for batch in batches:
            for first, last, body in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                # part p holds the keys from bounds[p - 1] (included) to bounds[p]
                low, high = bisect_left(own, first + b"\0"), bisect_left(own, last + b"\0")
                out = [(low, first, body)]
                if low != high:
                    rows = unpacked(body)
                    keys, out, a = rows.column(0).to_pylist(), [], 0
                    for part in range(low, high + 1):
                        b = bisect_left(keys, own[part]) if part < high else len(keys)
                        if b > a:
                            out.append((part, keys[a], packed(rows.slice(a, b - a))))
                        a = b
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def merge(batches):
        def rows():
            for batch in batches:
                for part, first, body in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    yield part, first, unpacked(body)

        source = rows()
        held = next(source, None)
        while held is not None:
            part, place = held[0], 0

            def own():
                nonlocal held
                while held is not None and held[0] == part:  # noqa: B023
                    yield held[1], held[2]
                    held = next(source, None)

            for batch in merged(own()):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())], names=[*batch.schema.names[1:], "part", "place"])
                place += n

    dealt = map_arrow(runs.select("first", "last", "body"), divide, "part int, first binary, body binary")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "first")
    rows = cut(map_arrow(ordered, merge, f"{_COLUMNS}, part int, place bigint"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES + 1 rows at most
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").withColumn("ord", F.col("place") + F.col("start")).drop("part", "place", "start")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(url_key, captured_at, page_id, payload_bytes, payload_digest, record_type, refers_to, archive, record_offset, ord) of
    every response and revisit in the gzipped archives below path. ord counts all captures in the order of URL key, time and
    page, so the history of a URL is a range of it. record_offset is that in the archive's bytes before compression.
    A damaged or cut archive raises an error."""
    return merge_runs(sorted_runs(spark, path))


def warc_captures(pages: DataFrame, time_col: str | None = None) -> DataFrame:
    """read_captures of the pages, written by write_archives to the shared folder."""
    path = new_folder(pages.sparkSession, "archives")
    write_archives(pages, path, time_col)
    return read_captures(pages.sparkSession, path)


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(url, ''), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
k AS (
  SELECT page_id, html, regexp_extract(rest, '^[^/?]*') AS host, rest[len(regexp_extract(rest, '^[^/?]*')) + 1:] AS path,
    CASE WHEN strlen(html) >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS best
  FROM p),
u AS (
  SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(lower(host), '^.*@|:[0-9]*$', '', 'g'), '^www[0-9]*\.', ''), '.')), ',') || ')' || CASE WHEN starts_with(path, '/') THEN '' ELSE '/' END || path AS url_key,
    strftime(make_timestamp((946684800 + page_id % 2147483648) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
  FROM k)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < best THEN best END AS refers_to,
  url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS ord
FROM u
"""
