"""HTML: one page per documented table and a summary page per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.text import escape_html, seconds
from lakescribe.model import Catalog, spread, union_all
from lakescribe.operators.docs import TABLE_KEY, object_totals, table_columns
from lakescribe.operators.parts import PIECE_BYTES, whole_texts


def _cells(*values: Column) -> Column:
    """A table row; the first cell is the name."""
    first, *others = [escape_html(v) for v in values]
    return F.concat(
        F.lit("<tr><td><strong>"), first, F.lit("</strong></td>"),
        *[part for v in others for part in (F.lit("<td>"), v, F.lit("</td>"))], F.lit("</tr>\n"),
    )


def _header(*titles: str) -> str:
    return "<table>\n<thead><tr>" + "".join(f"<th>{t}</th>" for t in titles) + "</tr></thead>\n<tbody>\n"


_END = "</tbody>\n</table>\n"


_PAGE_END = "</body>\n</html>\n"


def _page_begin(title: Column) -> Column:
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="UTF-8"><title>'), title,
        F.lit("</title></head>\n<body>\n"))


def _page(title: Column, body: Column) -> Column:
    return F.concat(_page_begin(title), body, F.lit(_PAGE_END))


def _badge(flag: str, kind: str) -> Column:
    mark = f'<span class="badge badge-{kind.lower()}">{kind}</span>'
    return F.when(F.col(flag), F.lit(mark)).otherwise(F.lit(""))


def _column_row() -> Column:
    nullable = F.when(F.col("nullable"), F.lit("YES")).otherwise(F.lit("NO"))
    return F.concat(
        F.lit("<tr><td><strong>"), escape_html(F.col("name")), F.lit("</strong></td><td>"),
        escape_html(F.col("data_type")), F.lit("</td><td>"), nullable, F.lit("</td><td>"),
        _badge("is_primary_key", "PK"), _badge("is_foreign_key", "FK"), _badge("is_unique", "UK"),
        F.lit("</td><td>"), escape_html(F.col("default_value")), F.lit("</td><td>"),
        escape_html(F.col("comment")), F.lit("</td></tr>\n"),
    )


def table_pages(cat: Catalog) -> DataFrame:
    """(source_id, owner, table_name, html). The columns of one table are few, as databases limit them."""
    rows = table_columns(cat).select(*TABLE_KEY, F.struct("position", _column_row().alias("row")).alias("line"))
    bodies = rows.groupBy(*TABLE_KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["row"]), "").alias("rows")
    )
    heading = F.concat(F.lit("Table: "), escape_html(F.col("table_name")))
    note = F.when(
        F.col("comment") != "", F.concat(F.lit("<p><em>"), escape_html(F.col("comment")), F.lit("</em></p>\n"))
    ).otherwise(F.lit(""))
    body = F.concat(
        F.lit("<h3>"), heading, F.lit("</h3>\n"), note,
        F.lit(_header("Column", "Data Type", "Nullable", "Constraints", "Default", "Comment")),
        F.coalesce("rows", F.lit("")), F.lit(_END),
    )
    return (
        cat["tables"].withColumnRenamed("name", "table_name")
        .join(spread(bodies), TABLE_KEY, "left")
        .select(*TABLE_KEY, _page(heading, body).alias("html"))
    )


def _summary_rows(cat: Catalog, with_views_and_synonyms: bool) -> list[tuple[str, str, DataFrame, tuple[str, ...]]]:
    """(kind, heading, frame, header titles) with the row in column `row`, in page order."""
    def rows(kind: str, detail: str, *values: Column) -> DataFrame:
        return cat[kind].select("source_id", "owner", "name", F.col(detail).alias("detail"), _cells(*values).alias("row"))

    text = lambda c: F.col(c).cast("string")
    name, comment = F.col("name"), F.col("comment")
    sections = [
        ("tables", "Tables", rows("tables", "type", name, F.col("owner"), text("row_count"), comment),
         ("Name", "Owner", "Rows", "Comment")),
        ("routines", "Procedures / Functions",
         rows("routines", "signature", name, F.col("type"), F.col("signature"), comment),
         ("Name", "Type", "Signature", "Comment")),
        ("triggers", "Triggers",
         rows("triggers", "target_table", name, F.col("target_table"), F.col("timing"), F.col("event"), F.col("status"), comment),
         ("Name", "Target Table", "Timing", "Event", "Status", "Comment")),
        ("sequences", "Sequences",
         rows("sequences", "owner", name, text("min_value"), text("max_value"), text("increment"), text("last_number"), comment),
         ("Name", "Min", "Max", "Increment", "Current", "Comment")),
    ]
    if with_views_and_synonyms:
        sections += [
            ("views", "Views", rows("views", "type", name, F.col("owner"), F.col("type"), comment),
             ("Name", "Owner", "Type", "Comment")),
            ("synonyms", "Synonyms",
             rows("synonyms", "target_object", name, F.col("target_object"), F.col("target_owner"), comment),
             ("Name", "Target", "Target Owner", "Comment")),
        ]
    return sections


# What stands below the lists whose source code is left out.
NOTICES = {
    "routines": "<p>Security: routine bodies are left out (signatures only)</p>\n",
    "triggers": "<p>Security: trigger definitions are left out (metadata only)</p>\n",
}


def summary_pages(cat: Catalog, with_views_and_synonyms: bool = False, limit: int = PIECE_BYTES) -> DataFrame:
    """(source_id, at, html): cards with totals, then the lists that are not empty, each by owner, name and detail.

    The texts of a source in the order of `at` are its page, see `parts`; nearly all have one. Runs jobs when called.
    """
    sections = _summary_rows(cat, with_views_and_synonyms)
    card = lambda label, value: F.concat(
        F.lit(f'<div class="summary-card"><h3>{label}</h3><div class="value">'), value, F.lit("</div></div>\n")
    )
    title = F.concat(escape_html(F.col("database_name")), F.lit(" - Database Schema Document"))
    cards = [
        card("Database type", escape_html(F.col("database_type"))),
        card("Version", escape_html(F.col("version"))),
        *[card(kind.capitalize(), F.col(kind).cast("string")) for kind in ("tables", "views", "routines", "triggers")],
    ]
    begin = F.concat(_page_begin(title), F.lit("<h1>"), title, F.lit("</h1>\n"), *cards)
    end = F.concat(F.lit("<p>Generated: "), seconds(F.col("extracted_at")), F.lit("</p>\n" + _PAGE_END))
    once = [(0, 0, begin), (len(sections) + 1, 0, end)]
    for place, (kind, heading, _, header) in enumerate(sections, start=1):
        present = lambda text: F.when(F.col(kind) > 0, F.lit(text))  # noqa: B023, E731
        once += [(place, 0, present(f"<h2>{heading}</h2>\n{_header(*header)}")), (place, 2, present(_END + NOTICES.get(kind, "")))]
    none = F.lit("")
    fixed = cat["sources"].join(spread(object_totals(cat)), "source_id").select("source_id", F.inline(F.array(*[
        F.struct(F.lit(place).alias("place"), F.lit(line).alias("line"), none.alias("owner"), none.alias("name"), none.alias("detail"), text.alias("text"))
        for place, line, text in once]))).where("text IS NOT NULL")
    rows = [
        df.select("source_id", F.lit(place).alias("place"), F.lit(1).alias("line"), "owner", "name", "detail", F.col("row").alias("text"))
        for place, (_, _, df, _) in enumerate(sections, start=1)
    ]
    return whole_texts(union_all([fixed, *rows]), ["place", "line", "owner", "name", "detail"], limit).withColumnRenamed("text", "html")
