"""Routine signatures from names, types and argument arrays; no body is ever needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _listed(arguments: Column, *fields: str) -> Column:
    line = lambda a: F.concat_ws(" ", *[F.coalesce(a[f], F.lit("")) for f in fields])
    return F.array_join(F.transform(F.coalesce(arguments, F.array()), line), ", ")


def postgresql_signature(kind: Column, name: Column, arguments: Column, returns: Column) -> Column:
    """`TYPE name(args)`, functions with ` RETURNS type`; the argument text comes from the catalog."""
    tail = F.when(kind == "FUNCTION", F.concat(F.lit(" RETURNS "), returns)).otherwise(F.lit(""))
    return F.concat(F.format_string("%s %s(%s)", kind, name, arguments), tail)


def mysql_signature(kind: Column, name: Column, arguments: Column) -> Column:
    return F.format_string("%s %s(%s)", kind, name, _listed(arguments, "mode", "name", "data_type"))


def oracle_signature(kind: Column, name: Column, arguments: Column) -> Column:
    """The return type is not in the dump, hence its placeholder."""
    listed = _listed(arguments, "name", "mode", "data_type")
    return F.when(kind == "FUNCTION", F.format_string("FUNCTION %s(%s) RETURN <type>", name, listed)).otherwise(
        F.format_string("PROCEDURE %s(%s)", name, listed)
    )


def mssql_signature(kind: Column, name: Column, arguments: Column) -> Column:
    return F.format_string("%s %s(%s)", kind, name, _listed(arguments, "name", "mode", "data_type"))
