"""Facts that need the values themselves: distinct counts, uniqueness and inclusions.

Values are put in long form (column_id, value) and pre-aggregated before they are shuffled, so a value
that fills a third of a table leaves every task as one row. Pairs of columns are never built per
value: the columns that hold a value are bits of a mask, equal masks are counted together, and the
columns that include column c are the bits common to all masks that have bit c.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.scratch import cut
from lakescribe.functions.values import INTEGER, column, scalar_columns, type_class, value_key
from lakescribe.model import local_frame, union_all
from lakescribe.operators.profiles import Tables, approx_distinct_profile, null_profile, scan_profile

ColumnFacts = dict[str, Any]  # a scan_profile row and whether a repeat was seen

# Rows of each partition in which repeats are looked for before all values are: a repeat among them is a proof.
WITNESS_ROWS = 65_536
# monotonically_increasing_id() has the row's place in its partition in its lower bits.
_PLACE_BITS = (1 << 33) - 1
WORD_BITS = 64
# Up to so many columns a value's columns are bits of a mask, beyond they are a list; the results are the same.
MASK_COLUMNS = 256


@dataclass(frozen=True)
class Member:
    """A column that takes part in a value comparison; its number is its bit."""

    number: int
    table: str
    field: T.StructField


def _members(tables: Tables, wanted: set[tuple[str, str]] | None, *classes: str) -> list[Member]:
    found = [
        (table, field)
        for table, df in tables.items()
        for field in scalar_columns(df.schema, *classes)
        if wanted is None or (table, field.name) in wanted
    ]
    return [Member(i, table, field) for i, (table, field) in enumerate(found)]


def _long_form(tables: Tables, members: list[Member]) -> DataFrame:
    """(column_id, value) without nulls: one scan per table, of the members only."""
    whole = all(type_class(m.field.dataType) == INTEGER for m in members)
    parts = []
    for table, df in tables.items():
        own = [m for m in members if m.table == table]
        if not own:
            continue
        pairs = [
            F.struct(
                F.lit(m.number).alias("column_id"),
                (column(m.field.name).cast("long") if whole
                 else F.when(column(m.field.name).isNotNull(), value_key(m.field))).alias("value"),
            )
            for m in own
        ]
        parts.append(df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()))
    return union_all(parts)


def _counted_values(tables: Tables, members: list[Member]) -> DataFrame:
    return _long_form(tables, members).groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("copies"))


def _families(tables: Tables, wanted: set[tuple[str, str]] | None = None) -> list[list[Member]]:
    """Integers are compared as numbers, all other classes by their key text."""
    others = {
        type_class(f.dataType) for df in tables.values() for f in scalar_columns(df.schema)
    } - {INTEGER}
    families = [_members(tables, wanted, INTEGER)]
    if others:
        families.append(_members(tables, wanted, *sorted(others)))
    return [family for family in families if family]


def _names(spark: SparkSession, members: list[Member]) -> DataFrame:
    """Names of the members; as many rows as there are columns."""
    return local_frame(
        spark,
        [(m.number, m.table, m.field.name) for m in members],
        "column_id int, table_name string, column_name string",
    )


def _spark(tables: Tables) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def distinct_profile(tables: Tables, approx: bool = False) -> DataFrame:
    """Distinct non-null values of every scalar column, exact or by sketch."""
    if approx:
        return approx_distinct_profile(tables)
    parts = []
    for family in _families(tables):
        counted = _counted_values(tables, family).groupBy("column_id").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            _names(_spark(tables), family)
            .join(counted, "column_id", "left")
            .select("table_name", "column_name", F.coalesce("n", F.lit(0)).alias("n_distinct"))
        )
    return union_all(parts)


def _repeats_surely(fact: ColumnFacts) -> bool:
    """Whether the facts prove that a column has a duplicate: more rows than values that fit, or one seen."""
    present = fact["n_rows"] - fact["n_nulls"]
    if fact["repeat_seen"]:
        return True
    if fact["min_long"] is not None:
        return fact["max_long"] - fact["min_long"] + 1 < present  # fewer integers in the range than rows
    if fact["max_bytes"] is not None and 256 ** (fact["max_bytes"] + 1) < present:
        return True  # fewer strings of that length than rows
    if fact["precision"] is not None and not fact["n_odd"]:
        return 2 * 10 ** fact["precision"] + 1 < present  # fewer numbers of that precision than rows
    return False


def may_be_unique(fact: ColumnFacts) -> bool:
    """False only when a column has a duplicate for certain, or has no values to compare."""
    present = fact["n_rows"] - fact["n_nulls"]
    comparable = fact["min_long"] is not None or fact["min_hash"] is not None
    return comparable and present > 0 and not _repeats_surely(fact)


def seen_repeats(tables: Tables, columns: set[tuple[str, str]], rows: int = WITNESS_ROWS) -> set[tuple[str, str]]:
    """Those of the columns that repeat a value within the first rows of all partitions of their table, compared exactly.

    No limit over the table: its last step would bring these rows of all partitions to one task.
    """
    parts = []
    for table, df in tables.items():
        own = [m for m in _members({table: df}, columns)]
        if own:
            some = df.select(*[column(m.field.name) for m in own]).where(F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS)) < rows)
            counted = _counted_values({table: some}, own).where("copies > 1").select("column_id").distinct()
            parts.append(counted.join(_names(df.sparkSession, own), "column_id").select("table_name", "column_name"))
    return {(r.table_name, r.column_name) for r in union_all(parts).collect()} if parts else set()


def lake_facts(tables: Tables, profile: DataFrame | None = None) -> list[ColumnFacts]:
    """Facts of every column, on the driver: one small row per column of the lake.

    One scan for all columns, or none if their scan_profile is given; then a look at some rows, for those columns only that the first facts leave
    open. Both can only prove that a column is not unique; what they leave open is decided on all rows.
    """
    facts = [{**row.asDict(), "repeat_seen": False} for row in (scan_profile(tables) if profile is None else profile).collect()]
    # Dense integers are unique or nearly so: no use to look for repeats.
    unclear = {(f["table_name"], f["column_name"]) for f in facts if may_be_unique(f) and f["min_long"] is None}
    repeated = seen_repeats(tables, unclear) if unclear else set()
    for fact in facts:
        fact["repeat_seen"] = (fact["table_name"], fact["column_name"]) in repeated
    return facts


def key_candidates(tables: Tables, prune: bool = True) -> DataFrame:
    """Per scalar column: no duplicate among its non-null values, and no null besides.

    The facts rule out columns that are proven to repeat, so that the second pass reads and shuffles the
    survivors only; those are decided exactly. Without prune every column is, at the cost of shuffling
    the values of all.
    """
    return key_candidates_from(tables, lake_facts(tables), prune)


def key_candidates_from(tables: Tables, facts: Iterable[ColumnFacts], prune: bool = True) -> DataFrame:
    spark = _spark(tables)
    scalar = {(t, f.name) for t, df in tables.items() for f in scalar_columns(df.schema)}
    rows = [r for r in facts if (r["table_name"], r["column_name"]) in scalar]
    survivors = {(r["table_name"], r["column_name"]) for r in rows if not prune or may_be_unique(r)}
    base = local_frame(
        spark,
        [(r["table_name"], r["column_name"], r["n_nulls"] > 0) for r in rows],
        "table_name string, column_name string, nullable boolean",
    )
    if not survivors:
        return base.select("table_name", "column_name", F.lit(False).alias("is_unique"), F.lit(False).alias("is_key"))
    checked = union_all(
        [
            _counted_values(tables, family)
            .groupBy("column_id")
            .agg((F.max("copies") == 1).alias("single"))
            .join(_names(spark, family), "column_id")
            .select("table_name", "column_name", "single")
            for family in _families(tables, survivors)
        ]
    )
    unique = F.coalesce("single", F.lit(False))
    return base.join(checked, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", unique.alias("is_unique"), (unique & ~F.col("nullable")).alias("is_key")
    )


# --- inclusions -----------------------------------------------------------------------------------


def _contains(parent: ColumnFacts, child: ColumnFacts) -> bool:
    """False only when the bounds prove that a child value is missing from the parent."""
    if child["n_rows"] == child["n_nulls"] or parent["n_rows"] == parent["n_nulls"]:
        return False
    if child["min_long"] is not None:
        return parent["min_long"] <= child["min_long"] and child["max_long"] <= parent["max_long"]
    if child["min_chars"] is not None and not (
        parent["min_chars"] <= child["min_chars"]
        and child["max_chars"] <= parent["max_chars"]
        and child["max_bytes"] <= parent["max_bytes"]
    ):
        return False
    return (
        parent["min_hash"] <= child["min_hash"]
        and child["max_hash"] <= parent["max_hash"]
        and not child["bits_low"] & ~parent["bits_low"]
        and not child["bits_high"] & ~parent["bits_high"]
    )


#: Bounds of a column as arrays: (names of facts, whether a child's value must be the larger one), and bit sets.
_LONG_BOUNDS = (("min_long", True), ("max_long", False))
_KEY_BOUNDS = (("min_hash", True), ("max_hash", False))
_TEXT_BOUNDS = (("min_chars", True), ("max_chars", False), ("max_bytes", False))
_BITS = ("bits_low", "bits_high")
_SWEEP_ROWS = 256


def _partnered(facts: list[ColumnFacts]) -> list[bool]:
    """Of columns of one class: whether the bounds leave a parent or a child in another table for them.

    As `_contains` over all pairs, but on sorted arrays: columns that may be parents come in blocks, the widest first, and
    meet the columns that have no partner yet. Nearly all find one in the first blocks, and of the others each pair
    is a few comparisons of arrays.
    """
    bounds = _LONG_BOUNDS if facts[0]["min_long"] is not None else (*_KEY_BOUNDS, *(_TEXT_BOUNDS if facts[0]["min_chars"] is not None else ()))
    tables = {t: i for i, t in enumerate(dict.fromkeys(f["table_name"] for f in facts))}
    table = np.array([tables[f["table_name"]] for f in facts])
    values = [(np.array([f[name] for f in facts], np.int64), larger) for name, larger in bounds]
    bits = [] if bounds is _LONG_BOUNDS else [np.array([f[name] for f in facts], np.int64) for name in _BITS]

    def fits(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """parent x child"""
        ok = table[parent][:, None] != table[child]
        for v, larger in values:
            ok &= v[parent][:, None] <= v[child] if larger else v[parent][:, None] >= v[child]
        for v in bits:
            ok &= (v[child] & ~v[parent][:, None]) == 0
        return ok

    found = np.zeros(len(facts), bool)
    width = values[1][0].astype(float) - values[0][0]  # of the range
    parents = np.array([i for i, f in enumerate(facts) if may_be_unique(f)], np.int64)
    parents = parents[np.argsort(-width[parents], kind="stable")]
    open_ = np.arange(len(facts))  # no parent found yet
    for a in range(0, len(parents), _SWEEP_ROWS):
        block = parents[a : a + _SWEEP_ROWS]
        if len(open_):
            has = fits(block, open_).any(axis=0)
            found[open_[has]] = True
            open_ = open_[~has]
    children, lonely = np.argsort(width, kind="stable"), parents  # the narrowest first; no child found yet
    for a in range(0, len(children), _SWEEP_ROWS):
        if not len(lonely):
            break
        has = fits(lonely, children[a : a + _SWEEP_ROWS]).any(axis=1)
        found[lonely[has]] = True
        lonely = lonely[~has]
    return found.tolist()


def comparable_columns(tables: Tables, facts: Iterable[ColumnFacts]) -> set[tuple[str, str]]:
    """Columns that must be read to find all inclusions: possible parents and their possible children."""
    classes = {(t, f.name): type_class(f.dataType) for t, df in tables.items() for f in df.schema.fields}
    return comparable_facts([(classes[(r["table_name"], r["column_name"])], r) for r in facts])


def comparable_facts(rows: list[tuple[str | None, ColumnFacts]]) -> set[tuple[str, str]]:
    """comparable_columns of (class, facts)."""
    by_class: dict[str, list[ColumnFacts]] = {}
    for cls, r in rows:
        if cls and r["n_rows"] > r["n_nulls"]:
            by_class.setdefault(cls, []).append(r)
    return {(r["table_name"], r["column_name"]) for own in by_class.values() for r, needed in zip(own, _partnered(own), strict=True) if needed}


def _word_bit(word: int) -> Column:
    """The member's bit in the given word, 0 if it lies in another word."""
    place = F.col("column_id") - word * WORD_BITS
    return F.when(
        (place >= 0) & (place < WORD_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), place)
    ).otherwise(F.lit(0).cast("long"))


def _bit(words: list[str], number: Column) -> Column:
    word = F.element_at(F.array(*[F.col(w) for w in words]), (F.floor(number / WORD_BITS) + 1).cast("int"))
    return F.bit_get(word, number % WORD_BITS) == 1


def _sparse_sets(tables: Tables, members: list[Member], every_holder: bool) -> DataFrame:
    """`_column_sets` for many members: a value has the list of its members in place of a mask as wide as the lake.

    Equal lists are counted together. All that hold a member's values are in its shortest list, so only those (the unique
    ones, unless every holder is wanted) are counted in its other lists; those found in all of them hold it.
    """
    lists = cut(
        _counted_values(tables, members).groupBy("value")
        .agg(F.array_sort(F.collect_list("column_id")).alias("seen"), F.array_sort(F.collect_list(F.when(F.col("copies") > 1, F.col("column_id")))).alias("twice"))
        .groupBy("seen", "twice").agg(F.count(F.lit(1)).alias("n_values")))
    each = lists.select("n_values", "seen", "twice", F.explode("seen").alias("column_id"))
    facts = cut(each.groupBy("column_id").agg(
        F.sum("n_values").alias("n_distinct"), (~F.max(F.array_contains("twice", F.col("column_id")))).alias("is_unique"),
        F.count(F.lit(1)).alias("n_lists"), F.min(F.struct(F.size("seen").alias("n"), "seen"))["seen"].alias("shortest")))
    unique = (facts if every_holder else facts.where("is_unique")).select(F.col("column_id").alias("holder"))
    few = facts.select("column_id", F.explode("shortest").alias("holder")).join(unique, "holder").groupBy("column_id").agg(F.collect_list("holder").alias("possible"))
    held = (
        each.select("column_id", "seen").join(few, "column_id")
        .select("column_id", F.explode(F.array_intersect("possible", "seen")).alias("holder"))
        .groupBy("column_id", "holder").agg(F.count(F.lit(1)).alias("n"))
        .join(facts.select("column_id", "n_lists"), "column_id").where("n = n_lists")
        .groupBy("column_id").agg(F.array_sort(F.collect_list("holder")).alias("held_by")))
    return facts.join(held, "column_id", "left").select(
        "column_id", "n_distinct", "is_unique", F.coalesce("held_by", F.array().cast("array<int>")).alias("held_by"))


def _column_sets(tables: Tables, members: list[Member], every_holder: bool, present: dict[tuple[str, str], int]) -> DataFrame:
    """Per member: distinct values, whether any repeats, and the members (the unique ones at least) that hold all of
    its values. A column repeats no value when it has as many values as rows with one, so a value is shuffled once, with the mask
    of its columns, and no copies are counted."""
    if len(members) > MASK_COLUMNS:
        return _sparse_sets(tables, members, every_holder)
    seen = [f"seen_{w}" for w in range(-(-len(members) // WORD_BITS))]
    masks = (
        _long_form(tables, members)
        .groupBy("value")
        .agg(*[F.bit_or(_word_bit(w)).alias(c) for w, c in enumerate(seen)])
        .groupBy(*seen)
        .agg(F.count(F.lit(1)).alias("n_values"))
    )
    numbers = F.sequence(F.lit(0), F.lit(len(members) - 1))
    holders = F.filter(numbers, lambda n: _bit(seen, n))
    rows = F.element_at(F.array(*[F.lit(present[(m.table, m.field.name)]).cast("long") for m in members]), F.col("column_id") + 1)
    return (
        masks.select("*", F.explode(holders).alias("column_id"))
        .groupBy("column_id")
        .agg(F.sum("n_values").alias("n_distinct"), *[F.bit_and(w).alias(w) for w in seen])
        .select("column_id", "n_distinct", (F.col("n_distinct") == rows).alias("is_unique"), F.filter(numbers, lambda n: _bit(seen, n)).alias("held_by"))
    )


def column_sets(tables: Tables, wanted: set[tuple[str, str]], every_holder: bool = False, facts: Iterable[ColumnFacts] | None = None) -> DataFrame:
    """The sets of all wanted scalar columns by name; one row per column. held_by has all unique columns that hold
    a column's values, and with every_holder all others too. facts: those of the tables, if they are known; else nulls are counted."""
    spark = _spark(tables)
    if facts is None:
        read = {t: df.select(*[column(c) for c in df.columns if (t, c) in wanted]) for t, df in tables.items()}
        read = {t: df for t, df in read.items() if df.columns}
        facts = [r.asDict() for r in null_profile(read).collect()] if read else []
    present = {(r["table_name"], r["column_name"]): r["n_rows"] - r["n_nulls"] for r in facts}
    parts = []
    for cls in sorted({type_class(f.dataType) for df in tables.values() for f in scalar_columns(df.schema)}):
        members = _members(tables, wanted, cls)
        if members:
            parts.append(
                _column_sets(tables, members, every_holder, present)
                .join(_names(spark, members), "column_id")
                .select(F.lit(cls).alias("type_class"), "column_id", "table_name", "column_name",
                        "n_distinct", "is_unique", "held_by")
            )
    if parts:
        return union_all(parts)
    return local_frame(
        spark,
        [],
        "type_class string, column_id int, table_name string, column_name string, n_distinct long, "
        "is_unique boolean, held_by array<int>",
    )


def inclusions_from(sets: DataFrame) -> DataFrame:
    """(child ⊆ unique parent in another table) from column_sets."""
    child = sets.select(
        "type_class",
        F.col("table_name").alias("child_table"),
        F.col("column_name").alias("child_column"),
        F.col("n_distinct").alias("child_distinct"),
        F.explode("held_by").alias("column_id"),
    )
    parent = sets.where("is_unique").select(
        "type_class",
        "column_id",
        F.col("table_name").alias("parent_table"),
        F.col("column_name").alias("parent_column"),
        F.col("n_distinct").alias("parent_distinct"),
    )
    return (
        child.join(parent, ["type_class", "column_id"])
        .where(F.col("child_table") != F.col("parent_table"))
        .select("child_table", "child_column", "parent_table", "parent_column", "child_distinct", "parent_distinct")
    )


def inclusion_dependencies(tables: Tables) -> DataFrame:
    """All scalar columns whose values lie in a unique column of the same class in another table."""
    facts = lake_facts(tables)
    return inclusions_from(column_sets(tables, comparable_columns(tables, facts), facts=facts))
