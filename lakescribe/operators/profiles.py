"""Per-column facts that one scan of a table yields: rows, nulls, lengths, precision, bounds.

Each table is aggregated once, with the facts of all its columns in the same aggregate; wide tables are
cut into column groups so that one aggregate stays small, and the groups read disjoint columns. Facts
are SQL expressions, one string per column, since a lake may have very many columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.values import (
    DECIMAL,
    FLOAT,
    INTEGER,
    NUMERIC,
    STRING,
    column,
    decimal_text,
    quoted,
    scalar_columns,
    text_literal,
    type_class,
)
from lakescribe.model import union_all

COLUMNS_PER_SCAN = 64
HASH_BITS = 128

Tables = Mapping[str, DataFrame]
Facts = dict[str, str]  # name of a fact -> SQL aggregate


def row_counts(tables: Tables) -> DataFrame:
    """Exact rows per table; the scan reads no columns."""
    return union_all(
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
         for t, df in tables.items()]
    )


def per_column(
    tables: Tables,
    pick: Callable[[T.StructType], list[T.StructField]],
    facts: Callable[[T.StructField], Facts],
) -> DataFrame:
    """Long form (table_name, column_name, *facts): one aggregate per table and column group."""
    parts = []
    for table, df in tables.items():
        fields = pick(df.schema)
        for start in range(0, len(fields), COLUMNS_PER_SCAN):
            group = fields[start : start + COLUMNS_PER_SCAN]
            wide = df.selectExpr(
                *[f"named_struct('column_name', {text_literal(f.name)}, "
                  + ", ".join(f"'{fact}', {sql}" for fact, sql in facts(f).items()) + f") AS c{i}"
                  for i, f in enumerate(group)]
            )
            listed = ", ".join(f"c{i}" for i in range(len(group)))
            parts.append(wide.selectExpr(f"{text_literal(table)} AS table_name", f"inline(array({listed}))"))
    if not parts:
        raise ValueError("no table has a column of the kind that is measured")
    return union_all(parts)


def _nulls(field: T.StructField) -> Facts:
    c = quoted(field.name)
    return {"n_rows": "count(1)", "n_nulls": f"count(1) - count({c})", "nullable": f"count(1) > count({c})"}


def null_profile(tables: Tables) -> DataFrame:
    """Rows, nulls and nullability of every column, nested ones included."""
    return per_column(tables, lambda schema: list(schema.fields), _nulls)


def _lengths(field: T.StructField) -> Facts:
    c = quoted(field.name)
    return {"min_chars": f"min(length({c}))", "max_chars": f"max(length({c}))", "max_bytes": f"max(octet_length({c}))"}


def length_profile(tables: Tables) -> DataFrame:
    """Shortest and longest value of string columns, in characters, and the most bytes."""
    return per_column(tables, lambda schema: scalar_columns(schema, STRING), _lengths)


def _parts(text: str) -> tuple[str, str, str]:
    """Digits before the point, digits after it, and the exponent of a number's text."""
    mantissa = f"substring_index({text}, 'E', 1)"
    after = f"CASE WHEN contains({mantissa}, '.') THEN substring_index({mantissa}, '.', -1) ELSE '' END"
    exponent = f"CASE WHEN contains({text}, 'E') THEN CAST(substring_index({text}, 'E', -1) AS int) ELSE 0 END"
    return f"substring_index({mantissa}, '.', 1)", after, exponent


def _scale_by_text(c: str) -> str:
    """Digits after the point that are left when trailing zeros are removed, of a value other than 0."""
    _, after, exponent = _parts(f"CAST({c} AS string)")
    return f"greatest(length(trim(TRAILING '0' FROM {after})) - ({exponent}), 0)"


def _scale_of_double(c: str) -> str:
    """As by text, the shortest that names the value, but by arithmetic where that is exact: a double with
    at most three digits after the point is the nearest one to rint(v * 10^k) / 10^k, and only it is. The
    rest takes the slow way."""
    wide = f"CAST({c} AS double)"
    steps = " ".join(f"WHEN rint({wide} * 1e{k}) / 1e{k} = {wide} THEN {k}" for k in (1, 2, 3))
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN rint({wide}) = {wide} THEN 0 "
            f"WHEN abs({wide}) >= 1e11 THEN {_scale_by_text(c)} {steps} ELSE {_scale_by_text(c)} END")


def _finite(c: str, cls: str) -> str:
    """The numbers that have digits; leaves out NaN and infinities."""
    return f"CASE WHEN abs({c}) < double('Infinity') THEN {c} END" if cls == FLOAT else c


def _digits(field: T.StructField) -> Facts:
    """Digits before the point of the longest number, and digits after it; null without finite numbers."""
    c, cls = quoted(field.name), type_class(field.dataType)
    fits = _finite(c, cls)
    if cls == INTEGER:
        scale = f"CASE WHEN count({c}) > 0 THEN 0 END"
    elif cls == FLOAT:
        scale = f"max({_scale_of_double(f'({fits})')})"
    else:
        scale = f"max(CASE WHEN {c} = 0 THEN 0 ELSE {_scale_by_text(c)} END)"
    ends = [f"CAST({end}({fits}) AS decimal(20,0))" if cls == INTEGER else f"{end}({fits})" for end in ("min", "max")]
    # by their text: abs() keeps 34 digits of a decimal only
    texts = [_parts(f"CAST({end} AS string)") for end in ends]
    digits = ", ".join(f"CASE WHEN {end} > -1 AND {end} < 1 THEN 0 ELSE length(replace({before}, '-', '')) + {exponent} END" for end, (before, _, exponent) in zip(ends, texts, strict=True))
    return {"digits": f"CASE WHEN {ends[0]} IS NOT NULL THEN greatest({digits}) END", "scale": f"CAST({scale} AS int)"}


def precision_of(digits: str, scale: str) -> str:
    """A column of zeros still has one digit."""
    return f"CAST(CASE WHEN {digits} IS NOT NULL THEN greatest({digits} + {scale}, 1) END AS int)"


def _numbers(field: T.StructField) -> Facts:
    found = _digits(field)
    return {"precision": precision_of(found["digits"], found["scale"]), "scale": found["scale"]}


def numeric_profile(tables: Tables) -> DataFrame:
    """Observed precision and scale of numeric columns: all digits of all finite values, whatever their size.

    Decimals count without trailing zeros, doubles and floats in their shortest form.
    """
    return per_column(tables, lambda schema: scalar_columns(schema, *NUMERIC), _numbers)


def approx_distinct_profile(
    tables: Tables, rsd: float = 0.05, columns: set[tuple[str, str]] | None = None
) -> DataFrame:
    """Approximate distinct values of every scalar column, or of the given ones, in one scan."""
    chosen = {
        t: df.select(*[column(f.name) for f in scalar_columns(df.schema) if columns is None or (t, f.name) in columns])
        for t, df in tables.items()
    }
    return per_column(
        {t: df for t, df in chosen.items() if df.columns},
        scalar_columns,
        lambda f: {"n_distinct": f"approx_count_distinct({quoted(f.name)}, {rsd})"},
    )


def _bounds(field: T.StructField) -> Facts:
    """What a contained column must obey: the range of integers; of other values the range of the hashes
    of their key forms, and the bits that these set. All are fixed-width, so the aggregate stays in
    generated code, which the least and greatest string would not."""
    c, cls = quoted(field.name), type_class(field.dataType)
    facts = dict.fromkeys(("min_long", "max_long", "min_hash", "max_hash", "bits_low", "bits_high"), "CAST(NULL AS bigint)")
    if cls == INTEGER:
        facts |= {"min_long": f"CAST(min({c}) AS bigint)", "max_long": f"CAST(max({c}) AS bigint)"}
    elif cls:
        # equal values of different types must have equal hashes
        alike = f"CAST({c} AS double)" if cls == FLOAT else decimal_text(c) if cls == DECIMAL else c
        h = f"CASE WHEN {c} IS NOT NULL THEN xxhash64({alike}) END"
        place = f"CAST({h} & {HASH_BITS - 1} AS int)"
        facts |= {
            "min_hash": f"min({h})",
            "max_hash": f"max({h})",
            "bits_low": f"bit_or(CASE WHEN {place} < 64 THEN shiftleft(1L, {place}) ELSE 0L END)",
            "bits_high": f"bit_or(CASE WHEN {place} >= 64 THEN shiftleft(1L, {place} - 64) ELSE 0L END)",
        }
    return facts


_NO_LENGTHS = dict.fromkeys(("min_chars", "max_chars", "max_bytes"), "CAST(NULL AS int)")
_NO_NUMBERS = dict.fromkeys(("precision", "scale"), "CAST(NULL AS int)")
_NO_DIGITS = dict.fromkeys(("digits", "scale"), "CAST(NULL AS int)")


def _odd(field: T.StructField) -> str:
    c, cls = quoted(field.name), type_class(field.dataType)
    return f"count({c}) - count({_finite(c, cls)})" if cls in NUMERIC else "0L"


def scan_profile(tables: Tables) -> DataFrame:
    """Every fact of this module about every column, from one scan per table, all of it in generated
    code; sketches, which are not, are left to approx_distinct_profile.

    Facts that do not apply to a column's type are null.
    """

    def facts(field: T.StructField) -> Facts:
        cls = type_class(field.dataType)
        return {
            **_nulls(field),
            **(_lengths(field) if cls == STRING else _NO_LENGTHS),
            **(_numbers(field) if cls in NUMERIC else _NO_NUMBERS),
            "n_odd": _odd(field),
            **_bounds(field),
        }

    return per_column(tables, lambda schema: list(schema.fields), facts)


# --- facts that can be merged ---------------------------------------------------------------------

#: How the fact of a whole follows from the facts of its parts.
MERGED = {
    "n_rows": "sum", "n_nulls": "sum", "min_chars": "min", "max_chars": "max", "max_bytes": "max", "digits": "max", "scale": "max", "n_odd": "sum",
    "min_long": "min", "max_long": "max", "min_hash": "min", "max_hash": "max", "bits_low": "bit_or", "bits_high": "bit_or",
}


def mergeable_facts(field: T.StructField) -> Facts:
    """The facts of scan_profile in a form that can be merged: digits before the point in place of the precision."""
    cls = type_class(field.dataType)
    found = {
        **_nulls(field),
        **(_lengths(field) if cls == STRING else _NO_LENGTHS),
        **(_digits(field) if cls in NUMERIC else _NO_DIGITS),
        "n_odd": _odd(field),
        **_bounds(field),
    }
    return {name: found[name] for name in MERGED}


def merged_profile(parts: DataFrame) -> DataFrame:
    """scan_profile of tables from the mergeable facts of their parts (table_name, column_name, *facts)."""
    whole = parts.groupBy("table_name", "column_name").agg(*[F.expr(f"{how}({name})").alias(name) for name, how in MERGED.items()])
    return whole.selectExpr(
        "table_name", "column_name", "n_rows", "n_nulls", "n_nulls > 0 AS nullable", "min_chars", "max_chars", "max_bytes",
        f"{precision_of('digits', 'scale')} AS precision", "scale", "n_odd", "min_long", "max_long", "min_hash", "max_hash", "bits_low", "bits_high")
