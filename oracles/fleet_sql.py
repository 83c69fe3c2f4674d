"""Expected results over the fleet, as DuckDB SQL.

The canonical rows are written down from the logical seed; the native shapes that Spark reads are
never used here. `cat_<kind>` is the canonical frame of all dialects, with arrays and times as text.
"""

from __future__ import annotations

from fleet import seed

DIALECTS = tuple(seed.DIALECT_CODES)
KINDS = ("tables", "columns", "views", "indexes", "routines", "sequences", "triggers", "synonyms")
HAS = {
    "postgresql": set(KINDS) - {"synonyms"},
    "mysql": set(KINDS) - {"sequences", "synonyms"},
    "oracle": set(KINDS),
    "mssql": set(KINDS),
}
LABELS = {"postgresql": "PostgreSQL", "mysql": "MySQL", "oracle": "Oracle", "mssql": "MSSQL"}
OWNER = ("CASE role WHEN 'main' THEN main_owner WHEN 'archive' THEN archive_owner "
         "WHEN 'system' THEN system_owner ELSE role END")
NAME_OF = {**{t[0]: t[1] for t in seed.TABLES}, 8: seed.VIEW[1]}
ROLE_OF = {**{t[0]: t[2] for t in seed.TABLES}, 8: seed.VIEW[2]}
COLUMN_OF = {(c[0], c[1]): c[2] for c in seed.COLUMNS}


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    listed = ",\n  ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES\n  {listed}) {name}({columns})"


def _source(d: str) -> str:
    archive = {"postgresql": "'public'", "mysql": "'Pegeldienst_' || c_custkey", "oracle": "'PEGEL_ARC'", "mssql": "'dbo'"}
    return f"""src_{d} AS (
SELECT c_custkey * 4 + {seed.DIALECT_CODES[d]} AS source_id, '{d}' AS dialect, c_custkey AS k, c_mktsegment AS segment,
  CASE WHEN c_nationkey < 20 THEN 'PEGEL' ELSE 'PEGEL2' END AS main_owner, {archive[d]} AS archive_owner,
  '{seed.SYSTEM_OWNER[d]}' AS system_owner, c_acctbal AS balance
FROM customer)"""


def _tables(d: str) -> str:
    rows = [(t[1], t[2], t[3], t[4], t[5] or "", t[6] or "") for t in seed.TABLES]
    kind = {"postgresql": "TABLE", "mysql": "InnoDB", "oracle": "TABLE", "mssql": "USER_TABLE"}[d]
    dates = "'' AS created_at, '' AS modified_at" if d == "postgresql" else "created AS created_at, modified AS modified_at"
    return f"""SELECT source_id, dialect, {OWNER} AS owner, name, '{kind}' AS type, note AS comment,
  coalesce(n + k, 0)::BIGINT AS row_count, {dates}
FROM src_{d}, {_values('s', 'name, role, n, note, created, modified', rows)}"""


def _unique_columns(d: str) -> set[tuple[int, int]]:
    found = set()
    for _, t, _, positions, unique, primary, _ in seed.INDEXES:
        if unique and not primary and (d != "mysql" or len(positions) == 1):
            found |= {(t, p) for p in positions}
    return found


def _columns(d: str) -> str:
    primary = {(i[1], p) for i in seed.INDEXES if i[5] for p in i[3]}
    unique = _unique_columns(d)
    targets = {(c, cp): (p, pp) for _, c, cps, p, pps in seed.FOREIGN_KEYS for cp, pp in zip(cps, pps, strict=True)}
    rows = []
    for t, pos, name, kind, nullable, note in seed.COLUMNS:
        dtype, length, precision, scale = seed.TYPES[kind][d]
        if d == "mssql" and t == 8:
            length, precision, scale, nullable = 0, 0, 0, False
        target = targets.get((t, pos))
        auto = (t, pos) == seed.AUTO_INCREMENT and d != "oracle"
        rows.append((
            NAME_OF[t], ROLE_OF[t], "VIEW" if t == 8 else "TABLE", pos, name, dtype, length, precision, scale, nullable,
            seed.DEFAULTS.get((t, pos), {}).get(d) or "", note, (t, pos) in primary, target is not None, (t, pos) in unique,
            NAME_OF[target[0]] if target else "", COLUMN_OF[target] if target else "", auto,
        ))
    dotted = d in ("postgresql", "mssql")
    table = "CASE WHEN ptable = '' THEN '' ELSE main_owner || '.' || ptable END" if dotted else "ptable"
    return f"""SELECT source_id, dialect, {OWNER} AS owner, tname AS table_name, object_kind,
  CASE WHEN segment = '{seed.RENAMES}' AND cname = '{COLUMN_OF[seed.RENAMED[:2]]}' THEN '{seed.RENAMED[2]}' ELSE cname END AS name,
  pos AS position, dtype AS data_type, len AS length, prec AS precision, sc AS scale, nul AS nullable,
  dflt AS default_value, CASE WHEN (k + pos) % 3 = 0 THEN '' ELSE note END AS comment,
  pk AS is_primary_key, fk AS is_foreign_key, uk AS is_unique, {table} AS fk_target_table, pcolumn AS fk_target_column,
  auto AS is_auto_increment
FROM src_{d}, {_values('s', 'tname, role, object_kind, pos, cname, dtype, len, prec, sc, nul, dflt, note, pk, fk, uk, ptable, pcolumn, auto', rows)}"""


def _views(d: str) -> str:
    note = "''" if d == "mysql" else _lit(seed.VIEW[3])
    return f"""SELECT source_id, dialect, main_owner AS owner, {_lit(seed.VIEW[1])} AS name, 'VIEW' AS type, {note} AS comment,
  segment = '{seed.UPDATABLE}' AS is_updatable FROM src_{d}"""


def _indexes(d: str) -> str:
    rows = []
    for _, t, name, positions, unique, primary, note in seed.INDEXES:
        kind = {"postgresql": "btree", "mysql": "BTREE", "oracle": "NORMAL",
                "mssql": "CLUSTERED" if primary else "NONCLUSTERED"}[d]
        rows.append((
            NAME_OF[t], ROLE_OF[t], "PRIMARY" if d == "mysql" and primary else name, kind,
            ",".join(COLUMN_OF[(t, p)] for p in positions), unique, primary, "" if d == "mysql" else note,
        ))
    return f"""SELECT source_id, dialect, {OWNER} AS owner, tname AS table_name, name, type, cols AS columns, uniq AS is_unique,
  prim AS is_primary, true AS is_enabled, note AS comment
FROM src_{d}, {_values('s', 'tname, role, name, type, cols, uniq, prim, note', rows)}"""


def _argument_text(arguments: list[tuple]) -> str:
    return ";".join(f"{n}:{i}:{m}:{t}:{dflt}" for i, (n, m, t, dflt) in enumerate(arguments, start=1))


def _routines(d: str) -> str:
    kind_of = lambda k: seed.TYPES[k][d][0]
    language = {"postgresql": "plpgsql", "mysql": "SQL", "oracle": "PL/SQL", "mssql": "T-SQL"}[d]
    rows = []
    for _, name, kind, note, arguments, returns in seed.ROUTINES:
        if d == "mssql" and kind == "FUNCTION":
            continue
        typed = [(("@" if d == "mssql" else "") + a, m, kind_of(t), "") for a, m, t in arguments]
        result = kind_of(returns) if returns and d in ("postgresql", "mysql") else ""
        if d == "postgresql":
            listed = ", ".join(f"{a} {t}" for a, _, t, _ in typed)
            signature = f"{kind} {name}({listed})" + (f" RETURNS {result}" if result else "")
            typed = []
        elif d == "mysql":
            signature = f"{kind} {name}({', '.join(f'{m} {a} {t}' for a, m, t, _ in typed)})"
        else:
            listed = ", ".join(f"{a} {m} {t}" for a, m, t, _ in typed)
            signature = f"{kind} {name}({listed})" + (" RETURN <type>" if kind == "FUNCTION" else "")
        rows.append((name, kind, note, signature, result, _argument_text(typed)))
    if d == "postgresql":
        _, name, kind, _, _, returns = seed.ROUTINES[1]
        result = kind_of(returns)
        rows.append((name, kind, "", f"{kind} {name}(p_name text) RETURNS {result}", result, ""))
    if d == "mysql":
        name = seed.ROUTINES[1][1]
        rows.append((name, "PROCEDURE", "", f"PROCEDURE {name}(OUT p_out int)", "", "p_out:1:OUT:int:"))
    if d == "oracle":
        name, one, two = "Auswertung.Ganglinie", "p_monat:1:IN:NUMBER:", "p_jahr:2:IN:NUMBER:"
        rows.append((name, "PROCEDURE", "", f"PROCEDURE {name}(p_monat IN NUMBER)", "", one + "1"))
        rows.append((name, "PROCEDURE", "", f"PROCEDURE {name}(p_monat IN NUMBER, p_jahr IN NUMBER)", "", f"{one};{two}"))
        rows.append(("Auswertung.Summe", "FUNCTION", "", "FUNCTION Auswertung.Summe(p_monat IN NUMBER) RETURN <type>", "", one))
    return f"""SELECT source_id, dialect, main_owner AS owner, name, type, note AS comment, signature, return_type,
  '{language}' AS language, args AS arguments
FROM src_{d}, {_values('s', 'name, type, note, signature, return_type, args', rows)}"""


def _sequences(d: str) -> str:
    rows = []
    for i, name, lo, hi, step, last, cache, note in seed.SEQUENCES:
        if i == 43 and d != "oracle":
            continue
        oracle = d == "oracle"
        rows.append((name, str(lo), str(hi), str(step), str(last), cache if oracle else 0, i == 42, oracle and i == 43,
                     "" if oracle else note))
    return f"""SELECT source_id, dialect, main_owner AS owner, name, lo AS min_value, hi AS max_value, step AS increment,
  last AS last_number, cache AS cache_size, may_cycle AND segment = '{seed.CYCLIC}' AS is_cyclic, ordered AS is_ordered,
  note AS comment
FROM src_{d}, {_values('s', 'name, lo, hi, step, last, cache, may_cycle, ordered, note', rows)}"""


def _triggers(d: str) -> str:
    rows = []
    for _, name, t, timing, events, level, on, note in seed.TRIGGERS:
        status = "ENABLED" if on else "DISABLED"
        if d == "postgresql":
            events = sorted(events, key=["INSERT", "DELETE", "UPDATE"].index)
            rows.append((name, NAME_OF[t], timing, events[0], ",".join(events), level, status, note))
        elif d == "oracle":
            level = "ROW" if level == "ROW" and timing != "INSTEAD OF" else "STATEMENT"
            rows.append((name, NAME_OF[t], timing, " OR ".join(events), ",".join(events), level, status, ""))
        elif t != 8 and d == "mysql":
            rows.append((name, NAME_OF[t], timing, events[0], events[0], "ROW", "ENABLED", ""))
        elif t != 8:
            timing = timing if timing == "AFTER" else "INSTEAD OF"
            rows.append((name, NAME_OF[t], timing, events[0], ",".join(events), "ROW", status, note))
    return f"""SELECT source_id, dialect, main_owner AS owner, name, target AS target_table, 'TABLE' AS target_type, timing, event,
  events, level, status, note AS comment
FROM src_{d}, {_values('s', 'name, target, timing, event, events, level, status, note', rows)}
WHERE segment <> '{seed.NO_TRIGGERS}'"""


def _synonyms(d: str) -> str:
    rows = [(n, NAME_OF[t], "" if d == "oracle" else note) for _, n, t, note in seed.SYNONYMS]
    if d == "oracle":
        facts = "CASE WHEN name = 'READING' THEN main_owner ELSE 'PUBLIC' END AS owner, name, target AS target_object, " \
                "main_owner AS target_owner, 'TABLE' AS target_type, name <> 'READING' AS is_public"
    else:
        facts = "main_owner AS owner, name, target AS target_object, " \
                "CASE WHEN name = 'READING' THEN '' ELSE main_owner END AS target_owner, 'TABLE' AS target_type, false AS is_public"
    return f"""SELECT source_id, dialect, {facts}, note AS comment
FROM src_{d}, {_values('s', 'name, target, note', rows)} WHERE balance >= 0"""


_BUILD = {"tables": _tables, "columns": _columns, "views": _views, "indexes": _indexes, "routines": _routines,
          "sequences": _sequences, "triggers": _triggers, "synonyms": _synonyms}


def kind_sql(dialect: str, kind: str) -> str:
    return f"WITH {_source(dialect)}\n{_BUILD[kind](dialect)}"


def changed_tables() -> str:
    """MySQL tables that the second run of one source in three leaves out or counts anew."""
    own = f"SELECT source_id, owner, name, row_count FROM ({kind_sql('mysql', 'tables')}) WHERE source_id % 3 = 0"
    gone = f"SELECT *, 'removed' AS change, 1 AS copies FROM ({own}) WHERE length(name) > 8 OR name = 'Dienst'"
    return f"{gone} UNION ALL SELECT source_id, owner, name, row_count + 1, 'added', 1 FROM ({own}) WHERE name = 'Dienst'"


def _info(d: str) -> str:
    return f"""SELECT source_id, dialect, 'Pegeldienst_' || k AS database_name, '{LABELS[d]}' AS database_type,
  {_lit(seed.VERSIONS[d][0])} AS version, '{seed.EXTRACTED_AT}' AS extracted_at FROM src_{d}"""


def ctes(*kinds: str) -> str:
    """src_<dialect> and the wanted cat_<kind>; cat_sources always."""
    parts = [_source(d) for d in DIALECTS]
    parts.append("cat_sources AS (" + "\nUNION ALL\n".join(_info(d) for d in DIALECTS) + ")")
    for kind in kinds:
        parts.append(f"cat_{kind} AS (" + "\nUNION ALL\n".join(_BUILD[kind](d) for d in DIALECTS if kind in HAS[d]) + ")")
    return "WITH " + ",\n".join(parts) + "\n"


OBJECTS = ("tables", "views", "routines", "sequences", "triggers", "synonyms", "indexes")


# --- sources and enrichment -----------------------------------------------------------------------


def source_info() -> str:
    return ctes() + "SELECT * FROM cat_sources"


def dialect_names() -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{raw}'" for s, raw in seed.RAW_DIALECTS.items())
    return f"""WITH registry AS (SELECT c_custkey AS source_id, CASE c_mktsegment {cases} END AS raw FROM customer)
SELECT source_id, raw, coalesce(m.dialect, '') AS dialect,
  CASE WHEN m.dialect IS NULL THEN 'unsupported database type: ' || lower(trim(raw)) ELSE '' END AS error
FROM registry LEFT JOIN (VALUES ('oracle', 'oracle'), ('mysql', 'mysql'), ('postgresql', 'postgresql'),
  ('postgres', 'postgresql'), ('pg', 'postgresql'), ('mssql', 'mssql'), ('sqlserver', 'mssql')) m(name, dialect)
  ON m.name = lower(trim(raw))"""


def filter_schemas() -> str:
    """Each dialect's default owners; all for Oracle."""
    return ctes("tables") + """SELECT source_id, dialect, owner, name FROM cat_tables
WHERE (dialect = 'postgresql' AND owner = 'public') OR (dialect = 'mssql' AND owner = 'dbo') OR dialect = 'oracle'
   OR (dialect = 'mysql' AND owner = 'Pegeldienst_' || (source_id // 4))"""


def filter_schemas_named() -> str:
    return ctes("tables") + "SELECT source_id, dialect, owner, name FROM cat_tables WHERE owner IN ('PEGEL', 'dbo')"


def filter_objects() -> str:
    """Tables only, no system owners, without the other tables, row counts off."""
    system = " OR ".join(f"(dialect = '{d}' AND owner = '{o}')" for d, o in seed.SYSTEM_OWNER.items())
    return ctes("tables", "columns") + f"""
SELECT 'tables' AS frame, source_id, owner, name AS object, row_count * 0 AS row_count FROM cat_tables
WHERE name IN ('Messstelle', 'Ablesung', 'Einstellung') AND NOT ({system})
UNION ALL
SELECT 'columns', source_id, owner, table_name || '.' || name, 0 FROM cat_columns
WHERE object_kind = 'TABLE' AND table_name IN ('Messstelle', 'Ablesung', 'Einstellung') AND NOT ({system})"""


def filter_types() -> str:
    """Without tables of two types, and without what belongs to them."""
    gone = "SELECT 1 FROM cat_tables t WHERE t.type IN ('InnoDB', 'USER_TABLE') AND t.source_id = x.source_id AND t.owner = x.owner AND t.name = x.{0}"
    parts = [
        f"SELECT '{kind}' AS frame, source_id, owner, {named} AS belongs_to, name FROM cat_{kind} x WHERE NOT EXISTS ({gone.format(named)})"
        for kind, named in (("tables", "name"), ("views", "name"), ("columns", "table_name"), ("indexes", "table_name"), ("triggers", "target_table"))
    ]
    return ctes("tables", "views", "columns", "indexes", "triggers") + "\nUNION ALL\n".join(parts)


def auto_increment() -> str:
    return ctes("columns") + "SELECT source_id, dialect, owner, table_name, name FROM cat_columns WHERE is_auto_increment"


def signatures() -> str:
    return ctes("routines") + "SELECT source_id, dialect, owner, name, signature FROM cat_routines"


def flat_indexes() -> str:
    return ctes("indexes") + "SELECT source_id, dialect, owner, table_name, name, columns FROM cat_indexes"


def ordered() -> str:
    return ctes("columns") + "SELECT source_id, owner, table_name, position, name FROM cat_columns"


def union_counts() -> str:
    parts = [f"SELECT dialect, '{k}' AS kind, count(*) AS n FROM cat_{k} GROUP BY dialect" for k in KINDS]
    return ctes(*KINDS) + "\nUNION ALL\n".join(parts)


def _totals() -> str:
    joined = " ".join(
        f"LEFT JOIN (SELECT source_id, count(*) AS {k} FROM cat_{k} GROUP BY source_id) USING (source_id)" for k in OBJECTS
    )
    zeros = ", ".join(f"coalesce({k}, 0)::BIGINT AS {k}" for k in OBJECTS)
    return f"totals AS (SELECT source_id, {zeros} FROM cat_sources {joined})"


def _with_totals(*kinds: str) -> str:
    needed = list(dict.fromkeys((*OBJECTS, *kinds)))
    return ctes(*needed).rstrip() + ",\n" + _totals() + "\n"


def schema_counts() -> str:
    return _with_totals("columns") + """SELECT t.*, c.n AS columns FROM totals t
JOIN (SELECT source_id, count(*) AS n FROM cat_columns GROUP BY source_id) c USING (source_id)"""


# --- documentation --------------------------------------------------------------------------------


def doc_overview() -> str:
    lines = ["'Database Name', database_name", "'Database Type', database_type", "'Version', version",
             "'Extracted At', extracted_at"]
    lines += [f"'Total {k.capitalize()}', {k}::VARCHAR" for k in OBJECTS]
    return _with_totals() + "\nUNION ALL\n".join(
        f"SELECT source_id, {i} AS ord, " + line.replace(", ", " AS item, ", 1) + " AS value FROM cat_sources JOIN totals USING (source_id)"
        for i, line in enumerate(lines, start=1)
    )


def doc_tables() -> str:
    return ctes("tables", "columns", "indexes") + """SELECT source_id, name, owner, type,
  (SELECT count(*) FROM cat_columns c WHERE c.source_id = t.source_id AND c.owner = t.owner AND c.table_name = t.name
     AND c.object_kind = 'TABLE') AS column_count,
  (SELECT count(*) FROM cat_indexes i WHERE i.source_id = t.source_id AND i.owner = t.owner AND i.table_name = t.name) AS index_count,
  row_count, comment
FROM cat_tables t"""


def _yn(column: str) -> str:
    return f"CASE WHEN {column} THEN 'Y' ELSE 'N' END"


def doc_columns() -> str:
    return ctes("columns") + f"""SELECT source_id, owner, table_name, name AS column_name, position, data_type,
  {_yn('nullable')} AS nullable, {_yn('is_primary_key')} AS pk, {_yn('is_foreign_key')} AS fk, {_yn('is_unique')} AS uk,
  default_value, comment
FROM cat_columns WHERE object_kind = 'TABLE'"""


def doc_objects() -> str:
    sections = [
        (1, "routines", "ROUTINES", "signature", "name, owner, type, signature, return_type, language, comment",
         ("Name", "Owner", "Type", "Signature", "Return Type", "Language", "Comment")),
        (2, "sequences", "SEQUENCES", "''",
         f"name, min_value, max_value, increment, last_number, {_yn('is_cyclic')}, comment",
         ("Name", "Min", "Max", "Increment", "Current", "Cyclic", "Comment")),
        (3, "triggers", "TRIGGERS", "target_table", "name, target_table, timing, event, level, status, comment",
         ("Name", "Table", "Timing", "Event", "Level", "Status", "Comment")),
        (4, "synonyms", "SYNONYMS", "''", "name, target_object, target_owner, target_type, comment, '', ''",
         ("Name", "Target", "Owner", "Type", "Comment", "", "")),
    ]
    parts = []
    for number, kind, title, detail, cells, header in sections:
        parts.append(f"SELECT source_id, {number}, 3, owner, name, {detail}, {cells} FROM cat_{kind}")
        fixed = [(1, (title, *[""] * 6)), (2, header)] + ([(4, ("",) * 7)] if number < 4 else [])
        for line, texts in fixed:
            listed = ", ".join(_lit(t) for t in texts)
            parts.append(f"SELECT DISTINCT source_id, {number}, {line}, '', '', '', {listed} FROM cat_{kind}")
    cells = ", ".join(f"c{i}" for i in range(1, 8))
    return ctes("routines", "sequences", "triggers", "synonyms").rstrip() + (
        f",\nsheet(source_id, section, line, owner, name, detail, {cells}) AS (\n" + "\nUNION ALL\n".join(parts) + ")\nSELECT * FROM sheet"
    )


def doc_outline(with_views_and_synonyms: bool = False) -> str:
    parts = []

    def add(table: str, part: int, owner: str, name: str, detail: str, line: str | int, style: str, content: str, where: str = "true"):
        parts.append(f"SELECT source_id, {part}, {owner}, {name}, {detail}, {line}, '{style}', {content} FROM {table} WHERE {where}")

    head = "cat_sources JOIN totals USING (source_id)"
    for line, (style, content) in enumerate([
        ("Title", "database_name || ' - Database Schema Document'"), ("Normal", "''"), ("Heading1", "'Overview'"),
        ("Normal", "'Database type: ' || database_type"), ("Normal", "'Version: ' || version"),
        ("Normal", "'Extracted at: ' || extracted_at"), ("Normal", "''"), ("Heading2", "'Object statistics'"),
        *[("Normal", f"'• {k.capitalize()}: ' || {k}") for k in OBJECTS[:6]], ("Normal", "''"),
    ], start=1):
        add(head, 0, "''", "''", "''", line, style, content)
    notices = {
        "routines": "Security: routine bodies are left out (signatures only)",
        "triggers": "Security: trigger definitions are left out (metadata only)",
    }
    titles = {"tables": (1, "Tables"), "routines": (3, "Procedures / Functions"), "triggers": (5, "Triggers"),
              "sequences": (7, "Sequences")}
    for kind, (part, title) in titles.items():
        add("totals", part, "''", "''", "''", 1, "Heading1", _lit(title), f"{kind} > 0")
        if kind in notices:
            add("totals", part, "''", "''", "''", 2, "Normal", _lit(notices[kind]), f"{kind} > 0")
            add("totals", part, "''", "''", "''", 3, "Normal", "''", f"{kind} > 0")
    noted = "comment <> ''"
    t = ("cat_tables", 2, "owner", "name", "''")
    add(*t, 1, "Heading2", "'Table: ' || name")
    add(*t, 2, "Normal", "comment", noted)
    add(*t, 3, "Normal", "'Owner: ' || owner || ', rows: ' || row_count")
    add(*t, 4, "Heading3", "'Columns:'")
    add(*t, 2_000_000_000, "Normal", "''")
    add("cat_columns", 2, "owner", "table_name", "''", "position + 10", "Normal",
        "'  • ' || name || ' (' || data_type || ') ' || CASE WHEN is_primary_key THEN '[PK] ' ELSE '' END "
        "|| CASE WHEN is_foreign_key THEN '[FK] ' ELSE '' END || CASE WHEN is_unique THEN '[UK] ' ELSE '' END "
        "|| CASE WHEN comment <> '' THEN ' - ' || comment ELSE '' END", "object_kind = 'TABLE'")
    r = ("cat_routines", 4, "owner", "name", "signature")
    add(*r, 1, "Heading2", "type || ': ' || name")
    add(*r, 2, "Normal", "signature")
    add(*r, 3, "Normal", "comment", noted)
    add(*r, 4, "Normal", "''")
    g = ("cat_triggers", 6, "owner", "name", "target_table")
    add(*g, 1, "Heading2", "'Trigger: ' || name")
    add(*g, 2, "Normal", "'Target table: ' || target_table")
    add(*g, 3, "Normal", "'Timing: ' || timing || ', event: ' || event || ', status: ' || status")
    add(*g, 4, "Normal", "comment", noted)
    add(*g, 5, "Normal", "''")
    s = ("cat_sequences", 8, "owner", "name", "''")
    add(*s, 1, "Heading2", "'Sequence: ' || name")
    add(*s, 2, "Normal", "'Range: ' || min_value || ' ~ ' || max_value || ', increment: ' || increment || ', current: ' || last_number")
    add(*s, 3, "Normal", "comment", noted)
    add(*s, 4, "Normal", "''")
    if with_views_and_synonyms:
        add("totals", 9, "''", "''", "''", 1, "Heading1", "'Views'", "views > 0")
        v = ("cat_views", 10, "owner", "name", "''")
        add(*v, 1, "Heading2", "'View: ' || name")
        add(*v, 2, "Normal", "'Owner: ' || owner || ', type: ' || type")
        add(*v, 3, "Normal", "comment", noted)
        add(*v, 4, "Normal", "''")
        add("totals", 11, "''", "''", "''", 1, "Heading1", "'Synonyms'", "synonyms > 0")
        y = ("cat_synonyms", 12, "owner", "name", "''")
        add(*y, 1, "Heading2", "'Synonym: ' || name")
        add(*y, 2, "Normal", "'Target: ' || CASE WHEN target_owner <> '' THEN target_owner || '.' ELSE '' END || target_object")
        add(*y, 3, "Normal", "comment", noted)
        add(*y, 4, "Normal", "''")
    add("cat_sources", 13, "''", "''", "''", 1, "Normal", "''")
    add("cat_sources", 13, "''", "''", "''", 2, "Normal", f"repeat('─', 38)")
    return _with_totals("columns").rstrip() + (
        ",\noutline(source_id, part, owner, name, detail, line, style, content) AS (\n" + "\nUNION ALL\n".join(parts)
        + ")\nSELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY part, owner, name, detail, line, style, content) AS ord, style, content FROM outline"
    )


def doc_detail() -> str:
    marks = " || ".join(
        f"CASE WHEN {c} THEN '{m} ' ELSE '' END"
        for c, m in (("is_primary_key", "PK"), ("is_foreign_key", "FK"), ("is_unique", "UK"), ("nullable", "NULL"))
    )
    return ctes("columns", "indexes", "routines") + f"""SELECT source_id, 'COLUMN' AS detail, owner, table_name AS object_name,
  '' AS object_signature, position AS ord, name, data_type AS type, rtrim({marks}) AS marks, default_value AS value, comment
FROM cat_columns WHERE object_kind = 'TABLE'
UNION ALL
SELECT source_id, 'INDEX', owner, table_name, '', 0, name, type, CASE WHEN is_unique THEN '✓' ELSE '✗' END,
  replace(columns, ',', ', '), comment FROM cat_indexes
UNION ALL
SELECT source_id, 'ARGUMENT', owner, name, signature, split_part(a, ':', 2)::INT, split_part(a, ':', 1), split_part(a, ':', 4),
  split_part(a, ':', 3), split_part(a, ':', 5), ''
FROM (SELECT source_id, owner, name, signature, unnest(string_split(arguments, ';')) AS a FROM cat_routines WHERE arguments <> '')"""


def page_counts() -> str:
    """Rows and badges of the pages: one page per table."""
    return ctes("columns") + """SELECT source_id, owner, table_name, count(*) AS n_rows, count_if(is_primary_key)::BIGINT AS n_pk,
  count_if(is_foreign_key)::BIGINT AS n_fk, count_if(is_unique)::BIGINT AS n_uk, count_if(nullable)::BIGINT AS n_nullable
FROM cat_columns WHERE object_kind = 'TABLE' GROUP BY source_id, owner, table_name"""


def summary_rows() -> str:
    return _with_totals() + "SELECT source_id, tables + routines + triggers + sequences AS n_rows FROM totals"


# --- audits ---------------------------------------------------------------------------------------


def forbidden() -> str:
    return ctes("columns") + """SELECT source_id, owner, table_name, object_kind, name AS column_name FROM cat_columns
WHERE lower(name) IN ('body', 'definition', 'script', 'text', 'source')"""


def _commented() -> str:
    name = {"columns": "table_name || '.' || name", "indexes": "table_name || '.' || name",
            "triggers": "target_table || '.' || name", "routines": "signature"}
    return "commented AS (" + "\nUNION ALL\n".join(
        f"SELECT source_id, '{k}' AS kind, owner, {name.get(k, 'name')} AS name, comment <> '' AS good FROM cat_{k}" for k in KINDS
    ) + ")"


def comments() -> str:
    return ctes(*KINDS).rstrip() + f",\n{_commented()}\n" + """SELECT source_id, kind, count(*) AS n_objects,
  count_if(good)::BIGINT AS n_commented, count_if(good)::DOUBLE / count(*) AS ratio FROM commented GROUP BY source_id, kind"""


def comments_failing() -> str:
    return ctes(*KINDS).rstrip() + f",\n{_commented()}\nSELECT source_id, kind, owner, name FROM commented WHERE NOT good"


_REQUIRED = {"Table": "tables", "View": "views", "Routine": "routines", "Sequence": "sequences", "Trigger": "triggers",
             "Synonym": "synonyms"}


def coverage() -> str:
    return _with_totals() + "\nUNION ALL\n".join(
        f"SELECT source_id, '{name}' AS missing_kind FROM totals WHERE {kind} = 0" for name, kind in _REQUIRED.items()
    )


def report() -> str:
    missing = "\nUNION ALL\n".join(
        f"SELECT source_id, 'coverage' AS rule, 'no {name}' AS detail FROM totals WHERE {kind} = 0"
        for name, kind in _REQUIRED.items()
    )
    return _with_totals("columns").rstrip() + f""",
{_commented()},
details AS (
SELECT DISTINCT source_id, 'forbidden_names' AS rule, 'column named ' || lower(name) AS detail FROM cat_columns
WHERE lower(name) IN ('body', 'definition', 'script', 'text', 'source')
UNION ALL
SELECT source_id, 'comments', kind || ': ' || count(*) || ' without comment' FROM commented WHERE NOT good GROUP BY source_id, kind
UNION ALL
{missing}),
rules AS (SELECT source_id, unnest(['forbidden_names', 'comments', 'coverage']) AS rule FROM cat_sources)
SELECT r.source_id, r.rule, count(detail) = 0 AS passed, coalesce(string_agg(detail, ' | ' ORDER BY detail), '') AS details
FROM rules r LEFT JOIN details d ON d.source_id = r.source_id AND d.rule = r.rule GROUP BY r.source_id, r.rule"""


def passed() -> str:
    return f"SELECT source_id, bool_and(passed) AS passed FROM ({report()}) GROUP BY source_id"
