"""Whole texts of documents and pages as DuckDB SQL."""

from __future__ import annotations

from lakescribe.functions.text import HTML
from oracles.fleet_sql import OBJECTS, _lit, _totals, ctes


def _q(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def _object(*fields: tuple[str, str, str]) -> str:
    """JSON object of (key, column, kind); kinds s, n, b are always there, s?, n? only if not empty or zero, raw? if not ''."""
    parts = []
    for key, column, kind in fields:
        value = {"s": _q(column), "b": f"CASE WHEN {column} THEN 'true' ELSE 'false' END"}.get(kind[0], f"CAST({column} AS VARCHAR)")
        if kind == "raw?":
            value = column
        text = f"""',"{key}":' || {value}"""
        if kind.endswith("?"):
            text = f"CASE WHEN {column} {'<> 0' if kind == 'n?' else '''<> '' '''} THEN {text} ELSE '' END"
        parts.append(text)
    return "'{' || substr(" + " || ".join(parts) + ", 2) || '}'"


_COLUMN = _object(
    ("name", "name", "s"), ("position", "position", "n"), ("dataType", "data_type", "s"), ("length", "length", "n?"), ("precision", "precision", "n?"),
    ("scale", "scale", "n?"), ("nullable", "nullable", "b"), ("defaultValue", "default_value", "s?"), ("comment", "comment", "s?"),
    ("isPrimaryKey", "is_primary_key", "b"), ("isForeignKey", "is_foreign_key", "b"), ("isUnique", "is_unique", "b"),
    ("fkTargetTable", "fk_target_table", "s?"), ("fkTargetColumn", "fk_target_column", "s?"), ("isAutoIncrement", "is_auto_increment", "b"))
_INDEX = _object(
    ("name", "name", "s"), ("tableName", "table_name", "s"), ("owner", "owner", "s?"), ("type", "type", "s"),
    ("columns", "'[' || array_to_string(list_transform(string_split(columns, ','), lambda x: CAST(to_json(x) AS VARCHAR)), ',') || ']'", "raw"),
    ("isUnique", "is_unique", "b"), ("isPrimary", "is_primary", "b"), ("isEnabled", "is_enabled", "b"), ("comment", "comment", "s?"))
_ARGUMENT = _object(("name", "a[1]", "s"), ("position", "a[2]", "n"), ("mode", "a[3]", "s"), ("dataType", "a[4]", "s"), ("defaultValue", "a[5]", "s?"))


def _table(kind: str) -> str:
    more = [("isUpdatable", "is_updatable", "b")] if kind == "views" else [
        ("rowCount", "row_count", "n?"), ("createdAt", "created_at", "s?"), ("modifiedAt", "modified_at", "s?")]
    return _object(("name", "name", "s"), ("owner", "owner", "s?"), ("type", "type", "s"), ("comment", "comment", "s?"),
                   ("columns", "'[' || coalesce(columns, '') || ']'", "raw"), ("indexes", "coalesce('[' || indexes || ']', '')", "raw?"), *more)


_PIECES = """placed AS (
  SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY source_id ORDER BY place, line, owner, name, detail, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM lines)
SELECT source_id, CAST(min(start) AS BIGINT) AS at, string_agg(text, '' ORDER BY place, line, owner, name, detail, text) AS {name}
FROM placed GROUP BY source_id, start // {limit}"""


def documents(limit: int) -> str:
    """JSON documents in pieces of `limit` bytes."""
    routine = _object(
        ("name", "name", "s"), ("owner", "owner", "s?"), ("type", "type", "s"), ("comment", "comment", "s?"), ("signature", "signature", "s"),
        ("arguments", "CASE WHEN arguments = '' THEN '' ELSE '[' || array_to_string(list_transform(list_transform(string_split(arguments, ';'), "
                      f"lambda t: string_split(t, ':')), lambda a: {_ARGUMENT}), ',') || ']' END", "raw?"),
        ("returnType", "return_type", "s?"), ("language", "language", "s?"))
    sequence = _object(
        ("name", "name", "s"), ("owner", "owner", "s?"), ("minValue", "min_value", "n"), ("maxValue", "max_value", "n"), ("increment", "increment", "n"),
        ("lastNumber", "last_number", "n"), ("cacheSize", "cache_size", "n?"), ("isCyclic", "is_cyclic", "b"), ("isOrdered", "is_ordered", "b"), ("comment", "comment", "s?"))
    trigger = _object(
        ("name", "name", "s"), ("owner", "owner", "s?"), ("targetTable", "target_table", "s"), ("targetType", "target_type", "s"), ("timing", "timing", "s"),
        ("event", "event", "s"), ("level", "level", "s"), ("status", "status", "s"), ("comment", "comment", "s?"))
    synonym = _object(
        ("name", "name", "s"), ("owner", "owner", "s?"), ("targetObject", "target_object", "s"), ("targetOwner", "target_owner", "s?"),
        ("targetType", "target_type", "s?"), ("isPublic", "is_public", "b"), ("comment", "comment", "s?"))
    nested = lambda kind: (
        f"cat_{kind} t LEFT JOIN (SELECT source_id AS s, owner AS o, table_name AS n, string_agg({_COLUMN}, ',' ORDER BY position) AS columns FROM cat_columns "
        f"WHERE object_kind = '{kind[:-1].upper()}' GROUP BY ALL) c ON s = source_id AND o = owner AND n = name "
        f"LEFT JOIN (SELECT source_id AS si, owner AS oi, table_name AS ni, string_agg({_INDEX}, ',' ORDER BY name) AS indexes FROM cat_indexes "
        f"GROUP BY ALL) i ON si = source_id AND oi = owner AND ni = name{' AND false' if kind == 'views' else ''}")
    frames = {
        "tables": (nested("tables"), "''", _table("tables")), "views": (nested("views"), "''", _table("views")), "routines": ("cat_routines", "signature", routine),
        "sequences": ("cat_sequences", "''", sequence), "triggers": ("cat_triggers", "target_table", trigger), "synonyms": ("cat_synonyms", "''", synonym),
        "indexes": ("cat_indexes", "table_name", _INDEX),
    }
    objects = "\nUNION ALL\n".join(
        f"SELECT source_id, '{kind}' AS kind, {place} AS place, owner, name, {detail} AS detail, {json} AS json FROM {frame}"
        for place, (kind, (frame, detail, json)) in enumerate(((k, frames[k]) for k in OBJECTS), start=1))
    head = _object(("databaseName", "database_name", "s"), ("databaseType", "database_type", "s"), ("version", "version", "s"), ("extractedAt", "extracted_at", "s"))
    once = "SELECT DISTINCT source_id, place, {line}, '', '', '', {text} FROM objects"
    return ctes("columns", *OBJECTS).rstrip() + f""",
objects AS (
{objects}),
lines(source_id, place, line, owner, name, detail, text) AS (
SELECT source_id, 0, 0, '', '', '', {head}[:-2] FROM cat_sources
UNION ALL {once.format(line=0, text="',\"' || kind || '\":['")}
UNION ALL SELECT source_id, place, 1, owner, name, detail,
  CASE WHEN row_number() OVER (PARTITION BY source_id, kind ORDER BY owner, name, detail, json) = 1 THEN '' ELSE ',' END || json FROM objects
UNION ALL {once.format(line=2, text="']'")}
UNION ALL SELECT source_id, {len(OBJECTS) + 1}, 0, '', '', '', '}}' FROM cat_sources),
""".replace(f"{head}[:-2]", f"substr({head}, 1, len({head}) - 1)") + _PIECES.format(name="json", limit=limit)


def _html(x: str) -> str:
    for old, new in HTML:
        x = f"replace({x}, {_lit(old)}, {_lit(new)})"
    return x


def _row(*cells: str) -> str:
    first, *others = [_html(f"CAST({c} AS VARCHAR)") for c in cells]
    return f"'<tr><td><strong>' || {first} || '</strong></td>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in others) + f" || '</tr>' || chr(10)"


def _lines(*texts: str) -> str:
    return "".join(_lit(t) + " || chr(10) || " for t in texts)[: -len(" || ")]


def _header(*titles: str) -> tuple[str, ...]:
    return ("<table>", "<thead><tr>" + "".join(f"<th>{t}</th>" for t in titles) + "</tr></thead>", "<tbody>")


_END = ("</tbody>", "</table>")


def _begin(title: str) -> str:
    head = _lines("<!DOCTYPE html>", '<html lang="en">')
    return f"""{head} || '<head><meta charset="UTF-8"><title>' || {title} || {_lines('</title></head>', '<body>')}"""


_CLOSE = _lines("</body>", "</html>")


def table_pages() -> str:
    badge = lambda flag, kind: f"""CASE WHEN {flag} THEN '<span class="badge badge-{kind.lower()}">{kind}</span>' ELSE '' END"""
    row = (f"'<tr><td><strong>' || {_html('name')} || '</strong></td><td>' || {_html('data_type')} || '</td><td>' || CASE WHEN nullable THEN 'YES' ELSE 'NO' END || '</td><td>' || "
           f"{badge('is_primary_key', 'PK')} || {badge('is_foreign_key', 'FK')} || {badge('is_unique', 'UK')} || '</td><td>' || {_html('default_value')} || '</td><td>' || {_html('comment')} || '</td></tr>' || chr(10)")
    title = f"'Table: ' || {_html('name')}"
    note = f"CASE WHEN comment <> '' THEN '<p><em>' || {_html('comment')} || '</em></p>' || chr(10) ELSE '' END"
    return ctes("tables", "columns") + f"""SELECT source_id, owner, name AS table_name,
  {_begin(title)} || '<h3>' || {title} || '</h3>' || chr(10) || {note} || {_lines(*_header('Column', 'Data Type', 'Nullable', 'Constraints', 'Default', 'Comment'))}
  || coalesce(rows, '') || {_lines(*_END)} || {_CLOSE} AS html
FROM cat_tables LEFT JOIN (SELECT source_id AS s, owner AS o, table_name AS n, string_agg({row}, '' ORDER BY position) AS rows FROM cat_columns
  WHERE object_kind = 'TABLE' GROUP BY ALL) ON s = source_id AND o = owner AND n = name"""


def summary_pages(limit: int, with_views_and_synonyms: bool = False) -> str:
    """Summary pages in pieces of `limit` bytes."""
    sections = [
        ("tables", "Tables", "type", ("name", "owner", "row_count", "comment"), ("Name", "Owner", "Rows", "Comment"), ()),
        ("routines", "Procedures / Functions", "signature", ("name", "type", "signature", "comment"), ("Name", "Type", "Signature", "Comment"),
         ("<p>Security: routine bodies are left out (signatures only)</p>",)),
        ("triggers", "Triggers", "target_table", ("name", "target_table", "timing", "event", "status", "comment"),
         ("Name", "Target Table", "Timing", "Event", "Status", "Comment"), ("<p>Security: trigger definitions are left out (metadata only)</p>",)),
        ("sequences", "Sequences", "owner", ("name", "min_value", "max_value", "increment", "last_number", "comment"), ("Name", "Min", "Max", "Increment", "Current", "Comment"), ()),
    ]
    if with_views_and_synonyms:
        sections += [("views", "Views", "type", ("name", "owner", "type", "comment"), ("Name", "Owner", "Type", "Comment"), ()),
                     ("synonyms", "Synonyms", "target_object", ("name", "target_object", "target_owner", "comment"), ("Name", "Target", "Target Owner", "Comment"), ())]
    card = lambda label, value: f"""'<div class="summary-card"><h3>{label}</h3><div class="value">' || {value} || '</div></div>' || chr(10)"""
    title = f"{_html('database_name')} || ' - Database Schema Document'"
    cards = [card("Database type", _html("database_type")), card("Version", _html("version")), *[card(k.capitalize(), k) for k in ("tables", "views", "routines", "triggers")]]
    head = "cat_sources JOIN totals USING (source_id)"
    parts = [f"SELECT source_id, 0, 0, '', '', '', {_begin(title)} || '<h1>' || {title} || '</h1>' || chr(10) || {' || '.join(cards)} FROM {head}"]
    for place, (kind, heading, detail, cells, titles, notice) in enumerate(sections, start=1):
        parts.append(f"SELECT source_id, {place}, 0, '', '', '', {_lines(f'<h2>{heading}</h2>', *_header(*titles))} FROM totals WHERE {kind} > 0")
        parts.append(f"SELECT source_id, {place}, 1, owner, name, {detail}, {_row(*cells)} FROM cat_{kind}")
        parts.append(f"SELECT source_id, {place}, 2, '', '', '', {_lines(*_END, *notice)} FROM totals WHERE {kind} > 0")
    at = "replace(replace(extracted_at, 'T', ' '), 'Z', '')"
    parts.append(f"SELECT source_id, {len(sections) + 1}, 0, '', '', '', '<p>Generated: ' || {at} || '</p>' || chr(10) || {_CLOSE} FROM cat_sources")
    return ctes(*OBJECTS).rstrip() + ",\n" + _totals() + ",\nlines(source_id, place, line, owner, name, detail, text) AS (\n" + "\nUNION ALL\n".join(parts) + "),\n" + _PIECES.format(name="html", limit=limit)
