"""Documentation datasets: each report is a query over a catalog of canonical frames.

A report of one source can be as long as the source is large, so no report numbers its lines in a
per-source window or gathers a source in one task: every line carries the columns that order it, and the
outline's numbers are prefix sums over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.text import escape_markup, rfc3339, yes_no
from lakescribe.model import OBJECT_KINDS, Catalog, spread, union_all
from lakescribe.operators.numbering import numbered, numbered_by_group
from lakescribe.operators.parts import large_sources

TABLE_KEY = ["source_id", "owner", "table_name"]

# Labels of the report lines.
OVERVIEW_ITEMS = ("Database Name", "Database Type", "Version", "Extracted At")
TOTALS = {
    "tables": "Total Tables",
    "views": "Total Views",
    "routines": "Total Routines",
    "sequences": "Total Sequences",
    "triggers": "Total Triggers",
    "synonyms": "Total Synonyms",
    "indexes": "Total Indexes",
}
OBJECT_HEADERS = {
    "ROUTINES": ("Name", "Owner", "Type", "Signature", "Return Type", "Language", "Comment"),
    "SEQUENCES": ("Name", "Min", "Max", "Increment", "Current", "Cyclic", "Comment"),
    "TRIGGERS": ("Name", "Table", "Timing", "Event", "Level", "Status", "Comment"),
    "SYNONYMS": ("Name", "Target", "Owner", "Type", "Comment", "", ""),
}


def object_totals(cat: Catalog) -> DataFrame:
    """One row per source with the number of objects of each kind, 0 where it has none.

    All kinds are counted in one grouping; a source is one row per task before the shuffle.
    """
    marks = [cat[kind].select("source_id", F.lit(kind).alias("kind")) for kind in ("sources", *OBJECT_KINDS)]
    return union_all(marks).groupBy("source_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in OBJECT_KINDS]
    )


def doc_overview(cat: Catalog) -> DataFrame:
    """Eleven (item, value) lines per source: four facts and seven totals."""
    wide = cat["sources"].join(spread(object_totals(cat)), "source_id")
    values = [F.col("database_name"), F.col("database_type"), F.col("version"), rfc3339(F.col("extracted_at"))]
    lines = list(zip(OVERVIEW_ITEMS, values, strict=True))
    lines += [(TOTALS[kind], F.col(kind).cast("string")) for kind in OBJECT_KINDS]
    return wide.select(
        "source_id",
        F.inline(
            F.array(
                *[F.struct(F.lit(i).alias("ord"), F.lit(item).alias("item"), value.alias("value"))
                  for i, (item, value) in enumerate(lines, start=1)]
            )
        ),
    )


def doc_tables(cat: Catalog) -> DataFrame:
    """Tables with their number of columns and indexes."""
    columns = (
        cat["columns"].where("object_kind = 'TABLE'").groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("column_count"))
    )
    indexes = cat["indexes"].groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("index_count"))
    return (
        cat["tables"]
        .withColumnRenamed("name", "table_name")
        .join(spread(columns), TABLE_KEY, "left")
        .join(spread(indexes), TABLE_KEY, "left")
        .select(
            "source_id",
            F.col("table_name").alias("name"),
            "owner",
            "type",
            F.coalesce("column_count", F.lit(0)).alias("column_count"),
            F.coalesce("index_count", F.lit(0)).alias("index_count"),
            "row_count",
            "comment",
        )
    )


def table_columns(cat: Catalog) -> DataFrame:
    """Columns of documented tables; those of views are left out."""
    tables = cat["tables"].select("source_id", "owner", F.col("name").alias("table_name"))
    return cat["columns"].where("object_kind = 'TABLE'").join(spread(tables), TABLE_KEY, "left_semi")


def doc_columns(cat: Catalog) -> DataFrame:
    """Column sheet, with flags as Y / N."""
    return table_columns(cat).select(
        "source_id",
        "owner",
        "table_name",
        F.col("name").alias("column_name"),
        "position",
        "data_type",
        yes_no(F.col("nullable")).alias("nullable"),
        yes_no(F.col("is_primary_key")).alias("pk"),
        yes_no(F.col("is_foreign_key")).alias("fk"),
        yes_no(F.col("is_unique")).alias("uk"),
        "default_value",
        "comment",
    )


def _object_rows(cat: Catalog) -> list[tuple[str, DataFrame, list[Column]]]:
    """(section, frame, seven cells) in the order of the sheet."""
    text = lambda name: F.col(name).cast("string")
    return [
        ("ROUTINES", cat["routines"],
         [F.col(c) for c in ("name", "owner", "type", "signature", "return_type", "language", "comment")]),
        ("SEQUENCES", cat["sequences"],
         [F.col("name"), text("min_value"), text("max_value"), text("increment"), text("last_number"),
          yes_no(F.col("is_cyclic")), F.col("comment")]),
        ("TRIGGERS", cat["triggers"],
         [F.col(c) for c in ("name", "target_table", "timing", "event", "level", "status", "comment")]),
        ("SYNONYMS", cat["synonyms"],
         [F.col(c) for c in ("name", "target_object", "target_owner", "target_type", "comment")]
         + [F.lit(""), F.lit("")]),
    ]


def doc_objects(cat: Catalog) -> DataFrame:
    """Objects sheet: per section that has rows a title, a header, its rows and a blank line.

    Lines are ordered by (source_id, section, line, owner, name, detail); the last section has no blank.
    """
    cells = [f"c{i}" for i in range(1, 8)]
    parts = []
    for section, (title, frame, values) in enumerate(_object_rows(cat), start=1):
        detail = {"ROUTINES": F.col("signature"), "TRIGGERS": F.col("target_table")}.get(title, F.lit(""))
        parts.append(
            frame.select(
                "source_id", F.lit(section).alias("section"), F.lit(3).alias("line"), "owner", "name",
                detail.alias("detail"), *[v.alias(c) for v, c in zip(values, cells, strict=True)],
            )
        )
        fixed = [(1, (title, *[""] * 6)), (2, OBJECT_HEADERS[title])]
        if title != "SYNONYMS":
            fixed.append((4, ("",) * 7))
        lines = F.array(
            *[F.struct(F.lit(section).alias("section"), F.lit(line).alias("line"), F.lit("").alias("owner"),
                       F.lit("").alias("name"), F.lit("").alias("detail"),
                       *[F.lit(v).alias(c) for v, c in zip(texts, cells, strict=True)])
              for line, texts in fixed]
        )
        parts.append(frame.select("source_id").distinct().select("source_id", F.inline(lines)))
    return union_all(parts)


# --- outline --------------------------------------------------------------------------------------

OUTLINE_ORDER = ["source_id", "ord"]
_READING_ORDER = ["part", "owner", "name", "detail", "line", "style", "content"]
# No row of a frame gives more lines than this; a table's heading of columns counts with its first column.
_MOST_LINES = {"sources": 30, "tables": 4, "columns": 2, "routines": 4, "triggers": 5, "sequences": 4, "views": 4, "synonyms": 4}
TASK_LINES = 200_000


def _outline(df: DataFrame, part: int, owner: Column, name: Column, detail: Column, lines: list) -> DataFrame:
    """Lines (number, style, content) of each row; a line with null content is left out.

    A line may bring its own number as a column.
    """
    rows = F.array(
        *[F.struct((F.lit(n) if isinstance(n, int) else n).cast("int").alias("line"),
                   F.lit(style).alias("style"), content.alias("content"))
          for n, style, content in lines]
    )
    return df.select(
        "source_id", F.lit(part).alias("part"), owner.alias("owner"), name.alias("name"), detail.alias("detail"),
        F.inline(rows),
    ).where(F.col("content").isNotNull())


def column_line(name: Column, data_type: Column, pk: Column, fk: Column, uk: Column, comment: Column) -> Column:
    """`  • name (type) [PK] [FK] [UK]  - comment`, with the marks and the comment where they apply."""
    mark = lambda flag, text: F.when(flag, F.lit(text)).otherwise(F.lit(""))
    note = F.when(comment != "", F.concat(F.lit(" - "), comment)).otherwise(F.lit(""))
    return F.concat(
        F.lit("  • "), name, F.lit(" ("), data_type, F.lit(") "),
        mark(pk, "[PK] "), mark(fk, "[FK] "), mark(uk, "[UK] "), note,
    )


def doc_outline(cat: Catalog, escaped: bool = False, with_views_and_synonyms: bool = False, task_lines: int = TASK_LINES) -> DataFrame:
    """(source_id, ord, style, content): document outline in reading order, one row per paragraph.

    ord counts the paragraphs of a source from 1. Views and synonyms are counted; they are listed, after the
    sequences, if asked for. Sources that may have more than `task_lines` lines are numbered by prefix sums, see `numbered`; all
    others are sorted source by source, which shuffles a line once. Runs jobs when called.
    """
    none, blank = F.lit(""), F.lit("")
    fmt = F.format_string
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    head = cat["sources"].join(spread(object_totals(cat)), "source_id")
    totals = [("Tables", "tables"), ("Views", "views"), ("Routines", "routines"), ("Sequences", "sequences"),
              ("Triggers", "triggers"), ("Synonyms", "synonyms")]
    present = lambda kind, content: F.when(F.col(kind) > 0, content)
    extra = [(9, "Heading1", present("views", F.lit("Views"))), (11, "Heading1", present("synonyms", F.lit("Synonyms")))]
    # All lines that a source has once: the head, the headings of its sections, the end.
    once = [
        (0, "Title", fmt("%s - Database Schema Document", F.col("database_name"))),
        (0, "Normal", blank),
        (0, "Heading1", F.lit("Overview")),
        (0, "Normal", fmt("Database type: %s", F.col("database_type"))),
        (0, "Normal", fmt("Version: %s", F.col("version"))),
        (0, "Normal", fmt("Extracted at: %s", rfc3339(F.col("extracted_at")))),
        (0, "Normal", blank),
        (0, "Heading2", F.lit("Object statistics")),
        *[(0, "Normal", fmt(f"• {label}: %d", F.col(kind))) for label, kind in totals],
        (0, "Normal", blank),
        (1, "Heading1", present("tables", F.lit("Tables"))),
        (3, "Heading1", present("routines", F.lit("Procedures / Functions"))),
        (3, "Normal", present("routines", F.lit("Security: routine bodies are left out (signatures only)"))),
        (3, "Normal", present("routines", blank)),
        (5, "Heading1", present("triggers", F.lit("Triggers"))),
        (5, "Normal", present("triggers", F.lit("Security: trigger definitions are left out (metadata only)"))),
        (5, "Normal", present("triggers", blank)),
        (7, "Heading1", present("sequences", F.lit("Sequences"))),
        *(extra if with_views_and_synonyms else []),
        (13, "Normal", blank),
        (13, "Normal", F.lit("─" * 38)),
    ]
    seen: dict[int, int] = {}
    lines = []
    for part, style, content in once:
        seen[part] = seen.get(part, 0) + 1
        lines.append(F.struct(
            F.lit(part).alias("part"), none.alias("owner"), none.alias("name"), none.alias("detail"),
            F.lit(seen[part]).alias("line"), F.lit(style).alias("style"), content.alias("content")))
    parts = [head.select("source_id", F.inline(F.array(*lines))).where(F.col("content").isNotNull())]

    owner, name = F.col("owner"), F.col("name")
    # Line numbers inside a table leave room: columns start at 10, the blank line ends the table.
    columns = table_columns(cat)
    flags = [F.col(c) for c in ("is_primary_key", "is_foreign_key", "is_unique")]
    text = column_line(name, F.col("data_type"), *flags, F.col("comment"))
    parts += [
        _outline(cat["tables"], 2, owner, name, none, [
            (1, "Heading2", fmt("Table: %s", name)),
            (2, "Normal", filled("comment")),
            (3, "Normal", fmt("Owner: %s, rows: %d", owner, F.col("row_count"))),
            (2_000_000_000, "Normal", blank),
        ]),
        _outline(columns.select(*TABLE_KEY).distinct(), 2, owner, F.col("table_name"), none, [(4, "Heading3", F.lit("Columns:"))]),
        _outline(columns, 2, owner, F.col("table_name"), none, [(F.col("position") + 10, "Normal", text)]),
        _outline(cat["routines"], 4, owner, name, F.col("signature"), [
            (1, "Heading2", fmt("%s: %s", F.col("type"), name)),
            (2, "Normal", F.col("signature")),
            (3, "Normal", filled("comment")),
            (4, "Normal", blank),
        ]),
        _outline(cat["triggers"], 6, owner, name, F.col("target_table"), [
            (1, "Heading2", fmt("Trigger: %s", name)),
            (2, "Normal", fmt("Target table: %s", F.col("target_table"))),
            (3, "Normal", fmt("Timing: %s, event: %s, status: %s", F.col("timing"), F.col("event"), F.col("status"))),
            (4, "Normal", filled("comment")),
            (5, "Normal", blank),
        ]),
        _outline(cat["sequences"], 8, owner, name, none, [
            (1, "Heading2", fmt("Sequence: %s", name)),
            (2, "Normal", F.concat(
                F.lit("Range: "), F.col("min_value").cast("string"), F.lit(" ~ "), F.col("max_value").cast("string"),
                F.lit(", increment: "), F.col("increment").cast("string"),
                F.lit(", current: "), F.col("last_number").cast("string"))),
            (3, "Normal", filled("comment")),
            (4, "Normal", blank),
        ]),
    ]
    if with_views_and_synonyms:
        parts += [
            _outline(cat["views"], 10, owner, name, none, [
                (1, "Heading2", fmt("View: %s", name)),
                (2, "Normal", fmt("Owner: %s, type: %s", owner, F.col("type"))),
                (3, "Normal", filled("comment")),
                (4, "Normal", blank),
            ]),
            _outline(cat["synonyms"], 12, owner, name, none, [
                (1, "Heading2", fmt("Synonym: %s", name)),
                (2, "Normal", F.concat(F.lit("Target: "), F.when(F.col("target_owner") != "", F.concat("target_owner", F.lit("."))).otherwise(none), F.col("target_object"))),
                (3, "Normal", filled("comment")),
                (4, "Normal", blank),
            ]),
        ]
    whole = union_all(parts)
    if escaped:
        whole = whole.withColumn("content", escape_markup(F.col("content")))
    most = union_all([cat[kind].groupBy("source_id").agg((F.count(F.lit(1)) * n).alias("bytes")) for kind, n in _MOST_LINES.items()])
    large = large_sources(most.groupBy("source_id").agg(F.sum("bytes").alias("bytes")), task_lines)
    if large is None:
        placed = numbered_by_group(whole, ["source_id"], _READING_ORDER)
    else:
        same = whole["source_id"].eqNullSafe(large["source_id"])
        placed = numbered_by_group(whole.join(large, same, "left_anti"), ["source_id"], _READING_ORDER).unionByName(
            numbered(whole.join(large, same, "left_semi"), ["source_id"], _READING_ORDER))
    return placed.select("source_id", F.col("ord"), "style", "content")


# --- details --------------------------------------------------------------------------------------


def doc_detail(cat: Catalog) -> DataFrame:
    """Detail lines of the preview: columns with a NULL mark, index lists, routine arguments."""
    marks = F.concat_ws(
        " ",
        F.when(F.col("is_primary_key"), F.lit("PK")),
        F.when(F.col("is_foreign_key"), F.lit("FK")),
        F.when(F.col("is_unique"), F.lit("UK")),
        F.when(F.col("nullable"), F.lit("NULL")),
    )
    tables = cat["tables"].select("source_id", "owner", F.col("name").alias("table_name"))
    columns = table_columns(cat).select(
        "source_id", F.lit("COLUMN").alias("detail"), "owner", F.col("table_name").alias("object_name"),
        F.lit("").alias("object_signature"), F.col("position").alias("ord"), "name", F.col("data_type").alias("type"),
        marks.alias("marks"), F.col("default_value").alias("value"), "comment",
    )
    indexes = cat["indexes"].join(spread(tables), TABLE_KEY, "left_semi").select(
        "source_id", F.lit("INDEX").alias("detail"), "owner", F.col("table_name").alias("object_name"),
        F.lit("").alias("object_signature"), F.lit(0).alias("ord"), "name", "type",
        F.when(F.col("is_unique"), F.lit("✓")).otherwise(F.lit("✗")).alias("marks"),
        F.array_join("columns", ", ").alias("value"), "comment",
    )
    arguments = (
        cat["routines"]
        .select("source_id", "owner", F.col("name").alias("object_name"),
                F.col("signature").alias("object_signature"), F.posexplode("arguments").alias("place", "arg"))
        .select(
            "source_id", F.lit("ARGUMENT").alias("detail"), "owner", "object_name", "object_signature",
            (F.col("place") + 1).alias("ord"), F.col("arg.name").alias("name"), F.col("arg.data_type").alias("type"),
            F.col("arg.mode").alias("marks"), F.col("arg.default_value").alias("value"), F.lit("").alias("comment"),
        )
    )
    return union_all([columns, indexes, arguments])
