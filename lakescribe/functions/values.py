"""Type classes of columns and comparable forms of their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, STRING, DECIMAL, FLOAT = "integer", "string", "decimal", "float"
TIMESTAMP, LOCAL_TIMESTAMP = "timestamp", "timestamp_ntz"
NUMERIC = (INTEGER, DECIMAL, FLOAT)

# Strings up to this many bytes are compared as they are, longer ones by length and SHA-256.
INLINE_BYTES = 64


def type_class(data_type: T.DataType) -> str | None:
    """Class of a scalar type; None for arrays, maps, structs and other types without a key form."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, T.DecimalType):
        return DECIMAL
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(data_type, T.TimestampType):
        return TIMESTAMP
    if isinstance(data_type, T.TimestampNTZType):
        return LOCAL_TIMESTAMP
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.BinaryType):
        return "binary"
    return None


def scalar_columns(schema: T.StructType, *classes: str) -> list[T.StructField]:
    """Fields with a type class, in schema order; only the given classes if any are given."""
    found = [f for f in schema.fields if type_class(f.dataType)]
    return [f for f in found if type_class(f.dataType) in classes] if classes else found


def quoted(name: str) -> str:
    """SQL name of a top-level column, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    return F.col(quoted(name))


def decimal_text(c: str) -> str:
    """SQL text of a decimal that does not depend on its scale: 1.50 and 1.5000 are both 1.5."""
    text = f"CAST({c} AS string)"
    return (f"CASE WHEN {c} = 0 THEN '0' WHEN contains({text}, '.') "
            f"THEN regexp_replace({text}, '[.]?0*(?=$|E)', '') ELSE {text} END")


def comparable(child: T.DataType, parent: T.DataType) -> bool:
    """Whether equality of two types is defined: types of one class, and the two kinds of timestamps."""
    kinds = {type_class(child), type_class(parent)}
    return None not in kinds and (len(kinds) == 1 or kinds == {TIMESTAMP, LOCAL_TIMESTAMP})


def common_key(field: T.StructField, other: T.DataType) -> Column:
    """value_key in the common type of a column and another, comparable one.

    A local timestamp that meets an instant is read in the session's time zone, as in a join.
    """
    if type_class(field.dataType) == LOCAL_TIMESTAMP and type_class(other) == TIMESTAMP:
        return F.unix_micros(column(field.name).cast("timestamp")).cast("string")
    return value_key(field)


def value_key(field: T.StructField) -> Column:
    """Text that is equal exactly when the values are equal, short enough to shuffle.

    Numbers of one class have the same key whatever their scale or width.

    A digest form is always longer than INLINE_BYTES, so it never meets an inline form.
    """
    value, cls = column(field.name), type_class(field.dataType)
    if cls == STRING:
        digest = F.concat_ws(":", F.sha2(value, 256), F.octet_length(value).cast("string"))
        return F.when(F.octet_length(value) <= INLINE_BYTES, value.cast("string")).otherwise(digest)
    if cls == "binary":
        digest = F.concat_ws(":", F.sha2(value, 256), F.octet_length(value).cast("string"))
        return F.when(F.octet_length(value) <= INLINE_BYTES // 2, F.hex(value)).otherwise(digest)
    if cls == FLOAT:
        wide = value.cast("double")  # a float is the double that it stands for
        return F.when(wide == 0, F.lit("0.0")).otherwise(wide.cast("string"))  # -0.0 equals 0.0
    if cls == DECIMAL:
        return F.expr(decimal_text(quoted(field.name)))
    if cls == TIMESTAMP:
        return F.unix_micros(value).cast("string")  # free of the session time zone
    return value.cast("string")
