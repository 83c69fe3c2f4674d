"""Expected results of the measured operators, as DuckDB SQL over the test tables."""

from __future__ import annotations

_SCHEMA = """
region         r_regionkey:int r_name:string
nation         n_nationkey:int n_name:string n_regionkey:int
customer       c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string
supplier       s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double
part           p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double
orders         o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string
lineitem       l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz
events         event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string
documents      doc_id:bigint text:string lang:string source:string n_chars:bigint
embeddings     vec_id:bigint embedding:array<float> label:int
pages          page_id:bigint url:string html:string
benchmark      item_id:bigint text:string
labels         doc_id:bigint quality:int toxic:int
conversations  conv_id:bigint turn:bigint role:string text:string
"""

SCHEMA: dict[str, list[tuple[str, str]]] = {
    words[0]: [tuple(w.split(":", 1)) for w in words[1:]]
    for words in (line.split() for line in _SCHEMA.strip().splitlines())
}
TABLES = tuple(SCHEMA)

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

INTEGERS, DOUBLE, STRING = ("int", "bigint"), "double", "string"


def _columns(*types: str, tables=TABLES):
    for table in tables:
        for position, (name, kind) in enumerate(SCHEMA[table], start=1):
            if not types or kind in types:
                yield table, position, name, kind


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def rows() -> str:
    return _union(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)


def contents() -> str:
    """Values of every scalar column, and the sum of integers or of the lengths of strings."""
    parts = []
    for t, _, c, kind in _scalars():
        total = f'sum("{c}")' if kind in INTEGERS else f'sum(length("{c}"))' if kind == STRING else "NULL"
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(\"{c}\") AS n_values, ({total})::BIGINT AS total FROM {t}")
    return _union(parts)


def nulls() -> str:
    """With nulls put into customer.c_mktsegment, since the tables have none."""
    parts = []
    for t, _, c, _ in _columns():
        value = "nullif(c_mktsegment, 'BUILDING')" if c == "c_mktsegment" else f'"{c}"'
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
            f"count(*) - count({value}) AS n_nulls, count(*) > count({value}) AS nullable FROM {t}"
        )
    return _union(parts)


def lengths() -> str:
    return _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, min(length(\"{c}\"))::INT AS min_chars, "
        f"max(length(\"{c}\"))::INT AS max_chars, max(strlen(\"{c}\"))::INT AS max_bytes FROM {t}"
        for t, _, c, _ in _columns(STRING)
    )


def _number_text(column: str) -> tuple[str, str, str]:
    """Digits before the point, digits after it, and the exponent."""
    text = f"CAST({column} AS VARCHAR)"
    mantissa = f"split_part({text}, 'e', 1)"
    return f"split_part({mantissa}, '.', 1)", f"split_part({mantissa}, '.', 2)", f"coalesce(TRY_CAST(split_part({text}, 'e', 2) AS INT), 0)"


def _numbers(column: str) -> tuple[str, str]:
    _, after, exponent = _number_text(column)
    scale = f"max(CASE WHEN {column} = 0 THEN 0 ELSE greatest(length(rtrim({after}, '0')) - {exponent}, 0) END)"
    largest = f"greatest(abs(min({column})), abs(max({column})))"
    before, _, exponent = _number_text(largest)
    digits = f"CASE WHEN {largest} < 1 THEN 0 ELSE length({before}) + {exponent} END"
    return f"greatest({digits} + {scale}, 1)::INT", f"({scale})::INT"


def precision() -> str:
    parts = []
    for t, _, c, _ in _columns(*INTEGERS, DOUBLE):
        precision_, scale = _numbers(f'"{c}"')
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {precision_} AS precision, {scale} AS scale FROM {t}"
        )
    return _union(parts)


def file_facts(tables) -> str:
    """All facts that one scan gives, but hashes."""
    parts = []
    for t, _, c, kind in _columns(tables=tables):
        precision_, scale = _numbers(f'"{c}"') if kind in INTEGERS or kind == DOUBLE else ("NULL::INT", "NULL::INT")
        low, high = (f'{end}("{c}")::BIGINT' if kind in INTEGERS else "NULL::BIGINT" for end in ("min", "max"))
        shortest, longest, size = (
            f'{end}({of}("{c}"))::INT' if kind == STRING else "NULL::INT" for end, of in (("min", "length"), ("max", "length"), ("max", "strlen")))
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count(\"{c}\") AS n_nulls, count(*) > count(\"{c}\") AS nullable, "
            f"{shortest} AS min_chars, {longest} AS max_chars, {size} AS max_bytes, {precision_} AS precision, {scale} AS scale, "
            f"{low} AS min_long, {high} AS max_long FROM {t}")
    return _union(parts)


def precision_wide() -> str:
    """Of numbers with many digits, derived from customer."""
    wide = {
        "small": "c_custkey / 1e9",
        "huge": "c_acctbal * 1e33",
        "fine": "CAST(c_custkey AS DECIMAL(20,8)) + CAST('0.12345678' AS DECIMAL(20,8))",
        "long": "CAST(concat('12345678901234567890123456789012345', c_custkey % 10) AS DECIMAL(38,0))",
    }
    parts = []
    for name, value in wide.items():
        precision_, scale = _numbers("v")
        parts.append(f"SELECT 'wide' AS table_name, '{name}' AS column_name, {precision_} AS precision, {scale} AS scale "
                     f"FROM (SELECT {value} AS v FROM customer)")
    return _union(parts)


def _scalars(tables=TABLES):
    return [x for x in _columns(tables=tables) if not x[3].startswith("array")]


def distincts() -> str:
    return _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT \"{c}\") AS n_distinct FROM {t}"
        for t, _, c, _ in _scalars()
    )


def unique() -> str:
    return _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"count(\"{c}\") > 0 AND count(DISTINCT \"{c}\") = count(\"{c}\") AS is_unique, "
        f"count(*) > 0 AND count(DISTINCT \"{c}\") = count(*) AS is_key FROM {t}"
        for t, _, c, _ in _scalars()
    )


def composite_keys(keys) -> str:
    parts = []
    for table, columns in keys:
        listed = ", ".join(columns)
        parts.append(
            f"SELECT '{table}' AS table_name, '{listed}' AS columns, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, "
            f"count(*) FILTER (n > 1) AS dup_groups, sum(n - 1)::BIGINT AS excess_rows, max(n) = 1 AS is_key "
            f"FROM (SELECT {listed}, count(*) AS n FROM {table} GROUP BY {listed})"
        )
    return _union(parts)


def foreign_keys(pairs) -> str:
    parts = []
    for child, cc, parent, pc in pairs:
        missing = f"count(*) FILTER (\"{cc}\" NOT IN (SELECT \"{pc}\" FROM {parent}))"
        parts.append(
            f"SELECT '{child}.{cc}' AS child, '{parent}.{pc}' AS parent, count(*) AS n_checked, "
            f"{missing} AS n_orphans, (count(*) - {missing})::DOUBLE / count(*) AS coverage "
            f"FROM {child} WHERE \"{cc}\" IS NOT NULL"
        )
    return _union(parts)


def composite_foreign_keys(pairs) -> str:
    parts = []
    for child, cc, parent, pc in pairs:
        listed = lambda columns: ", ".join(f'"{c}"' for c in columns)
        missing = f"count(*) FILTER (({listed(cc)}) NOT IN (SELECT ({listed(pc)}) FROM {parent}))"
        there = " AND ".join(f'"{c}" IS NOT NULL' for c in cc)
        parts.append(
            f"SELECT '{child}({', '.join(cc)})' AS child, '{parent}({', '.join(pc)})' AS parent, count(*) AS n_checked, {missing} AS n_orphans, "
            f"(count(*) - {missing})::DOUBLE / count(*) AS coverage FROM {child} WHERE {there}")
    return _union(parts)


def found_keys(tables) -> str:
    """Minimal keys of one or two columns."""
    singles, pairs = [], []
    for t in tables:
        names = [c for _, _, c, _ in _scalars((t,))]
        singles += [f"SELECT '{t}' AS t, '{c}' AS a FROM {t} HAVING count(*) > 0 AND count(DISTINCT \"{c}\") = count(*)" for c in names]
        pairs += [
            f"SELECT '{t}' AS t, '{a}' AS a, '{b}' AS b FROM {t} HAVING count(*) > 0 AND count(*) = count(\"{a}\") AND count(*) = count(\"{b}\") "
            f"AND count(DISTINCT (\"{a}\", \"{b}\")) = count(*)"
            for i, a in enumerate(names) for b in names[i + 1 :]]
    return f"""WITH s AS ({_union(singles)}), p AS ({_union(pairs)})
SELECT t AS table_name, a AS columns, 1 AS width FROM s
UNION ALL
SELECT t, a || ',' || b, 2 FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.t = p.t AND s.a IN (p.a, p.b))"""


def _inclusion_ctes(tables=TABLES) -> str:
    """held: distinct values per column; parents: columns without duplicates; inds: the answer."""
    values, uniques = [], []
    for t, _, c, kind in _scalars(tables):
        cls = "integer" if kind in INTEGERS else kind
        values.append(
            f"SELECT DISTINCT '{cls}' AS cls, '{t}' AS t, '{c}' AS c, CAST(\"{c}\" AS VARCHAR) AS v "
            f"FROM {t} WHERE \"{c}\" IS NOT NULL"
        )
        uniques.append(f"SELECT '{t}' AS t, '{c}' AS c FROM {t} HAVING count(\"{c}\") = count(DISTINCT \"{c}\")")
    return f"""held AS MATERIALIZED ({_union(values)}),
sizes AS (SELECT t, c, count(*) AS n FROM held GROUP BY t, c),
parents AS ({_union(uniques)}),
shared AS (
  SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, count(*) AS n
  FROM held a JOIN held b ON a.cls = b.cls AND a.v = b.v AND a.t <> b.t
  JOIN parents p ON p.t = b.t AND p.c = b.c
  GROUP BY ALL
),
inds AS (
  SELECT child_table, child_column, parent_table, parent_column, s.n AS child_distinct, q.n AS parent_distinct
  FROM shared
  JOIN sizes s ON s.t = child_table AND s.c = child_column AND s.n = shared.n
  JOIN sizes q ON q.t = parent_table AND q.c = parent_column
),
suggested AS (
  SELECT child_table, child_column, parent_table, parent_column FROM inds
  WHERE regexp_replace(child_column, '^[a-z]{{1,2}}_', '') = regexp_replace(parent_column, '^[a-z]{{1,2}}_', '')
  QUALIFY row_number() OVER (PARTITION BY child_table, child_column
                             ORDER BY parent_distinct, parent_table, parent_column) = 1
)"""


def inclusions() -> str:
    return f"WITH {_inclusion_ctes()}\nSELECT * FROM inds"


def suggestions() -> str:
    return f"WITH {_inclusion_ctes()}\nSELECT * FROM suggested"


def sequences() -> str:
    keyed = _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, min(\"{c}\")::BIGINT AS lo, "
        f"max(\"{c}\")::BIGINT AS hi, count(*) AS n FROM {t} HAVING count(DISTINCT \"{c}\") = count(*)"
        for t, _, c, _ in _columns(*INTEGERS)
    )
    # The gaps between neighbours are all equal exactly when the values are a progression.
    steps = _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, min(gap) AS lo_gap, max(gap) AS hi_gap "
        f"FROM (SELECT \"{c}\"::BIGINT - lag(\"{c}\"::BIGINT) OVER (ORDER BY \"{c}\") AS gap FROM {t})"
        for t, _, c, _ in _columns(*INTEGERS)
    )
    return f"""WITH keyed AS ({keyed}), steps AS ({steps})
SELECT table_name, column_name, lo AS min_value, hi AS max_value, n,
  CASE WHEN lo_gap = hi_gap AND lo_gap > 0 THEN lo_gap END AS increment,
  hi + coalesce(CASE WHEN lo_gap = hi_gap AND lo_gap > 0 THEN lo_gap END, 1) AS next_value,
  hi - lo + 1 = n AS is_dense
FROM keyed JOIN steps USING (table_name, column_name)"""


def decimal_sequences(columns) -> str:
    """columns: (table, name, source column, factor, shift): keys of many digits made of integer ones."""
    parts = []
    for t, name, c, factor, shift in columns:
        parts.append(f"""SELECT '{t}' AS table_name, '{name}' AS column_name, min(v) AS lo, max(v) AS hi, count(*) AS n, min(gap) AS lo_gap, max(gap) AS hi_gap,
  count(DISTINCT v) AS d FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT "{c}"::HUGEINT * {factor}::HUGEINT + ({shift})::HUGEINT AS v FROM {t}))""")
    step = "CASE WHEN lo_gap = hi_gap AND lo_gap > 0 THEN lo_gap END"
    return f"""SELECT table_name, column_name, CAST(lo AS VARCHAR) AS min_value, CAST(hi AS VARCHAR) AS max_value, n, CAST({step} AS VARCHAR) AS increment,
  CAST(hi + coalesce({step}, 1) AS VARCHAR) AS next_value, hi - lo + 1 = n AS is_dense FROM ({_union(parts)}) WHERE n = d"""


def catalog_ctes(tables=TABLES) -> str:
    """The canonical frames lake_tables and lake_columns."""
    facts = []
    for t, position, c, kind in _columns(tables=tables):
        q = f'"{c}"'
        precision_, scale = _numbers(q) if kind in (*INTEGERS, DOUBLE) else ("0", "0")
        length = f"max(length({q}))::INT" if kind == STRING else "0"
        scalar = not kind.startswith("array")
        keyed = f"count(DISTINCT {q})" if scalar else "-1"
        dense = f"max({q}) - min({q}) + 1 = count(*) AND count(*) > 1" if kind in INTEGERS else "false"
        rank = position if kind in (*INTEGERS, STRING) else position + 1000
        facts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS name, {position} AS position, '{kind}' AS data_type, "
            f"{length} AS length, {precision_} AS precision, {scale} AS scale, count(*) > count({q}) AS nullable, "
            f"count({q}) > 0 AND {keyed} = count({q}) AS single, {dense} AS dense, {rank} AS key_rank FROM {t}"
        )
    counts = _union(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in tables)
    return f"""{_inclusion_ctes(tables)},
facts AS MATERIALIZED ({_union(facts)}),
pks AS (SELECT table_name, arg_min(name, key_rank) AS name FROM facts WHERE single AND NOT nullable GROUP BY table_name),
lake_tables AS (
  SELECT 0::BIGINT AS source_id, 'lake' AS dialect, 'lake' AS owner, name, 'TABLE' AS type, '' AS comment, row_count
  FROM ({counts})
),
lake_columns AS (
  SELECT 0::BIGINT AS source_id, 'lake' AS dialect, 'lake' AS owner, f.table_name, 'TABLE' AS object_kind, f.name,
    f.position, f.data_type, f.length, f.precision, f.scale, f.nullable, '' AS default_value, '' AS comment,
    p.name IS NOT NULL AS is_primary_key, s.parent_table IS NOT NULL AS is_foreign_key,
    f.single AND p.name IS NULL AS is_unique,
    coalesce(s.parent_table, '') AS fk_target_table, coalesce(s.parent_column, '') AS fk_target_column,
    f.single AND f.dense AND NOT f.nullable AS is_auto_increment
  FROM facts f
  LEFT JOIN pks p ON p.table_name = f.table_name AND p.name = f.name
  LEFT JOIN suggested s ON s.child_table = f.table_name AND s.child_column = f.name
)"""


def document() -> str:
    return f"WITH {catalog_ctes()}\nSELECT * FROM lake_columns"


def doc_overview() -> str:
    kinds = ("Views", "Routines", "Sequences", "Triggers", "Synonyms", "Indexes")
    zero = "\n".join(
        f"UNION ALL SELECT 0, {i}, 'Total {k}', '0'" for i, k in enumerate(kinds, start=6)
    )
    return f"""WITH {catalog_ctes()}
SELECT 0::BIGINT AS source_id, 1 AS ord, 'Database Name' AS item, 'lake' AS value
UNION ALL SELECT 0, 2, 'Database Type', 'Spark'
UNION ALL SELECT 0, 3, 'Version', '1'
UNION ALL SELECT 0, 4, 'Extracted At', '2025-01-01T00:00:00Z'
UNION ALL SELECT 0, 5, 'Total Tables', count(*)::VARCHAR FROM lake_tables
{zero}"""


def doc_tables(tables=TABLES) -> str:
    return f"""WITH {catalog_ctes(tables)}
SELECT t.source_id, t.name, t.owner, t.type, count(c.name) AS column_count, 0::BIGINT AS index_count,
  t.row_count, t.comment
FROM lake_tables t LEFT JOIN lake_columns c ON c.table_name = t.name
GROUP BY t.source_id, t.name, t.owner, t.type, t.row_count, t.comment"""


def doc_columns() -> str:
    yn = "CASE WHEN {0} THEN 'Y' ELSE 'N' END AS {1}"
    flags = ", ".join(
        yn.format(a, b)
        for a, b in (("nullable", "nullable"), ("is_primary_key", "pk"), ("is_foreign_key", "fk"), ("is_unique", "uk"))
    )
    return f"""WITH {catalog_ctes()}
SELECT source_id, owner, table_name, name AS column_name, position, data_type, {flags}, default_value, comment
FROM lake_columns"""


def forbidden() -> str:
    return f"""WITH {catalog_ctes()}
SELECT source_id, owner, table_name, object_kind, name AS column_name FROM lake_columns
WHERE lower(name) IN ('body', 'definition', 'script', 'text', 'source')"""


def escape() -> str:
    chain = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    return f"""SELECT 'documents' AS table_name, doc_id AS id, {chain.format('text')} AS escaped FROM documents
UNION ALL SELECT 'pages', page_id, {chain.format('html')} FROM pages"""
