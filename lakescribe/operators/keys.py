"""Verification of declared keys, choice among possible foreign keys, and sequences of integer keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakescribe.functions.values import DECIMAL, FLOAT, INTEGER, LOCAL_TIMESTAMP, TIMESTAMP, column, common_key, comparable, scalar_columns, type_class, value_key
from lakescribe.model import local_frame, union_all
from lakescribe.operators.distincts import ColumnFacts, column_sets, key_candidates_from, lake_facts
from lakescribe.operators.profiles import Tables

ForeignKey = tuple[str, str, str, str]  # child table, child column, parent table, parent column


def check_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whether a column list is a key: groups that repeat, rows in excess, and no nulls.

    Rows that are null in a key column are grouped like any other value but rule the key out.
    """
    parts = [column(c) for c in cols]
    has_null = F.lit(False)
    for part in parts:
        has_null = has_null | part.isNull()
    groups = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("copies")).withColumn("has_null", has_null)
    repeated = F.count_if(F.col("copies") > 1)
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        repeated.alias("dup_groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("excess_rows"),
        ((repeated == 0) & ~F.coalesce(F.bool_or("has_null"), F.lit(False))).alias("is_key"),
    )


def check_foreign_keys(tables: Tables, pairs: Iterable[ForeignKey]) -> DataFrame:
    """Non-null child rows, those without a parent, and the share that has one, per declared pair.

    Values are compared in the common type of the two columns: decimals of different scales by their value.
    Children and parents meet in one grouping by (pair, value) instead of a join, so a hot child
    value is already a single row when it is shuffled, and no side needs to fit in memory.
    """
    pairs = list(pairs)
    sides = []
    for number, (child_table, child_column, parent_table, parent_column) in enumerate(pairs):
        child = tables[child_table].schema[child_column]
        parent = tables[parent_table].schema[parent_column]
        if not comparable(child.dataType, parent.dataType):
            raise ValueError(f"{child_table}.{child_column} and {parent_table}.{parent_column} cannot be compared")
        for table, field, other, rows in ((child_table, child, parent, 1), (parent_table, parent, child, 0)):
            sides.append(
                tables[table]
                .where(column(field.name).isNotNull())
                .select(F.lit(number).alias("pair"), common_key(field, other.dataType).alias("value"), F.lit(rows).alias("child_rows"))
            )
    values = (
        union_all(sides)
        .groupBy("pair", "value")
        .agg(F.sum("child_rows").alias("child_rows"), F.min("child_rows").alias("parent_mark"))
    )
    orphans = F.sum(F.when(F.col("parent_mark") == 1, F.col("child_rows")).otherwise(F.lit(0)))
    counted = values.groupBy("pair").agg(F.sum("child_rows").alias("checked"), orphans.alias("orphans"))
    spark = next(iter(tables.values())).sparkSession
    names = local_frame(
        spark,
        [(i, f"{c}.{cc}", f"{p}.{pc}") for i, (c, cc, p, pc) in enumerate(pairs)],
        "pair int, child string, parent string",
    )
    checked, missing = F.coalesce("checked", F.lit(0)), F.coalesce("orphans", F.lit(0))
    return names.join(counted, "pair", "left").select(
        "child",
        "parent",
        checked.alias("n_checked"),
        missing.alias("n_orphans"),
        F.when(checked > 0, (checked - missing) / checked).alias("coverage"),
    )


def _bare(name: Column) -> Column:
    """Column name without a table prefix of one or two letters."""
    return F.lower(F.regexp_replace(name, "^[A-Za-z]{1,2}_", ""))


def suggest_foreign_keys(inds: DataFrame) -> DataFrame:
    """One target per child column: same bare name; the smaller parent wins, then the name."""
    order = Window.partitionBy("child_table", "child_column").orderBy(
        "parent_distinct", "parent_table", "parent_column"
    )
    return (
        inds.where(_bare(F.col("child_column")) == _bare(F.col("parent_column")))
        .withColumn("choice", F.row_number().over(order))
        .where("choice = 1")
        .select("child_table", "child_column", "parent_table", "parent_column")
    )


def _steps(facts: Iterable[ColumnFacts]) -> dict[tuple[str, str], tuple[int, int, int, int | None]]:
    """(min, max, count, step) per integer column that has values; the step is only a candidate."""
    found = {}
    for r in facts:
        present = r["n_rows"] - r["n_nulls"]
        if r["min_long"] is not None and present:
            spread, gaps = r["max_long"] - r["min_long"], present - 1
            step = spread // gaps if gaps and spread and spread % gaps == 0 else None
            found[(r["table_name"], r["column_name"])] = (r["min_long"], r["max_long"], present, step)
    return found


def _off_step(tables: Tables, steps: dict[tuple[str, str], tuple[int, int, int, int | None]]) -> DataFrame | None:
    """Values off the candidate progression; a step of one needs no second look at the data."""
    parts = []
    for table, df in tables.items():
        checks = []
        for f in scalar_columns(df.schema, INTEGER):
            low, _, _, step = steps.get((table, f.name), (0, 0, 0, None))
            if step and step > 1:
                value = column(f.name).cast("decimal(20,0)")  # a difference of longs may overflow
                off = F.count_if((value - F.lit(low).cast("decimal(20,0)")) % step != 0)
                checks.append(F.struct(F.lit(f.name).alias("column_name"), off.alias("n_off")))
        if checks:
            aliased = [c.alias(f"c{i}") for i, c in enumerate(checks)]
            parts.append(
                df.agg(*aliased).select(
                    F.lit(table).alias("table_name"),
                    F.inline(F.array(*[F.col(f"c{i}") for i in range(len(checks))])),
                )
            )
    return union_all(parts) if parts else None


def sequence_profile(tables: Tables) -> DataFrame:
    """Range of every integer key, and its step when its values form an arithmetic progression."""
    facts = lake_facts(tables)
    integers = {t: df.select(*[column(f.name) for f in scalar_columns(df.schema, INTEGER)])
                for t, df in tables.items() if scalar_columns(df.schema, INTEGER)}
    return sequence_profile_from(integers, facts, key_candidates_from(integers, facts))


def sequence_profile_from(tables: Tables, facts: Iterable[ColumnFacts], keys: DataFrame) -> DataFrame:
    """As sequence_profile; keys has table_name, column_name and is_key."""
    spark = next(iter(tables.values())).sparkSession
    steps = _steps(facts)
    base = local_frame(
        spark,
        [(t, c, low, high, n, step) for (t, c), (low, high, n, step) in steps.items()],
        "table_name string, column_name string, min_value long, max_value long, n long, step long",
    )
    off = _off_step(tables, steps)
    if off is None:
        checked = base.withColumn("n_off", F.lit(0).cast("long"))
    else:
        checked = base.join(off, ["table_name", "column_name"], "left")
    increment = F.when(F.coalesce("n_off", F.lit(0)) == 0, F.col("step"))
    wide = F.col("max_value").cast("decimal(38,0)") - F.col("min_value")
    return (
        checked.join(keys.where("is_key").select("table_name", "column_name"), ["table_name", "column_name"], "left_semi")
        .select(
            "table_name",
            "column_name",
            "min_value",
            "max_value",
            "n",
            increment.alias("increment"),
            (F.col("max_value") + F.coalesce(increment, F.lit(1))).alias("next_value"),
            (wide + 1 == F.col("n")).alias("is_dense"),
        )
    )


def whole_decimals(schema: T.StructType) -> list[T.StructField]:
    """Decimal columns without digits behind the point, as catalogs declare the integer keys of some databases."""
    return [f for f in scalar_columns(schema, DECIMAL) if f.dataType.scale <= 0]


def decimal_sequence_profile(tables: Tables) -> DataFrame:
    """`sequence_profile` of keys that are decimals of scale 0, up to 38 digits, exact.

    Range and count come from one scan. They leave one step at most, spread / (n - 1); whether all values are on it is seen
    by remainders, which do not overflow as differences of 38 digits would. next_value is null if it has more than 38 digits.
    """
    own = {t: df.select(*[column(f.name) for f in whole_decimals(df.schema)]) for t, df in tables.items() if whole_decimals(df.schema)}
    spark = next(iter(tables.values())).sparkSession
    wide = "decimal(38,0)"
    schema = f"table_name string, column_name string, min_value {wide}, max_value {wide}, n long, increment {wide}, next_value {wide}, is_dense boolean"
    if not own:
        return local_frame(spark, [], schema)
    keyed = {(r.table_name, r.column_name) for r in key_candidates_from(own, lake_facts(own)).where("is_key").collect()}
    facts: dict[tuple[str, str], tuple[int, int, int]] = {}
    for table, df in own.items():
        names = [c for c in df.columns if (table, c) in keyed]
        if names:  # one row for each table
            row = df.agg(*[f(column(c).cast(wide)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).head()
            facts |= {(table, c): (int(row[f"lo{i}"]), int(row[f"hi{i}"]), row[f"n{i}"]) for i, c in enumerate(names)}
    steps = {k: (hi - lo) // (n - 1) for k, (lo, hi, n) in facts.items() if n > 1 and (hi - lo) % (n - 1) == 0}
    off: set[tuple[str, str]] = set()
    for table, df in own.items():
        asked = [c for c in df.columns if 1 < steps.get((table, c), 0) and facts[(table, c)][2] > 2]
        if asked:
            literal = lambda x: F.lit(str(x)).cast(wide)
            row = df.agg(*[
                F.count_if(F.pmod(column(c).cast(wide), literal(steps[(table, c)])) != literal(facts[(table, c)][0] % steps[(table, c)])).alias(f"off{i}")
                for i, c in enumerate(asked)]).head()
            off |= {(table, c) for i, c in enumerate(asked) if row[f"off{i}"]}
    rows = []
    for key, (lo, hi, n) in sorted(facts.items()):
        step = steps.get(key) if key not in off else None
        following = hi + (step or 1)
        fits = lambda x: None if x is None or abs(x) >= 10**38 else Decimal(x)
        rows.append((*key, fits(lo), fits(hi), n, fits(step), fits(following), hi - lo + 1 == n))
    return local_frame(spark, rows, schema)


# --- composite keys -------------------------------------------------------------------------------

CompositeKey = tuple[str, Sequence[str], str, Sequence[str]]  # child table, child columns, parent table, parent columns


def _tuple_key(parts: Sequence[Column]) -> Column:
    """Text that is equal exactly when all parts are; null if a part is null. Short enough to shuffle."""
    whole = F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])
    return F.when(F.octet_length(whole) <= 128, whole).otherwise(F.concat(F.sha2(whole, 256), F.lit(":"), F.octet_length(whole).cast("string"), F.lit(":" + "-" * 64)))


def check_composite_foreign_keys(tables: Tables, pairs: Iterable[CompositeKey]) -> DataFrame:
    """`check_foreign_keys` of column lists: child rows without null in any of their columns, those whose tuple no parent
    row has, and the share that has one.

    Tuples meet in one grouping by (pair, tuple), each column in the common type of its two sides, so a hot tuple is a
    single row before the shuffle and a table is scanned once for each pair that names it.
    """
    pairs = [(c, list(cc), p, list(pc)) for c, cc, p, pc in pairs]
    sides = []
    for number, (child, child_columns, parent, parent_columns) in enumerate(pairs):
        if len(child_columns) != len(parent_columns) or not child_columns:
            raise ValueError(f"{child} and {parent}: as many child as parent columns, one at least")
        fields = [(tables[child].schema[a], tables[parent].schema[b]) for a, b in zip(child_columns, parent_columns, strict=True)]
        for a, b in fields:
            if not comparable(a.dataType, b.dataType):
                raise ValueError(f"{child}.{a.name} and {parent}.{b.name} cannot be compared")
        for table, own, rows in ((child, fields, 1), (parent, [(b, a) for a, b in fields], 0)):
            value = _tuple_key([common_key(f, other.dataType) for f, other in own])
            sides.append(tables[table].select(F.lit(number).alias("pair"), value.alias("value"), F.lit(rows).alias("child_rows")).where("value IS NOT NULL"))
    spark = next(iter(tables.values())).sparkSession
    names = local_frame(spark, [(i, f"{c}({', '.join(cc)})", f"{p}({', '.join(pc)})") for i, (c, cc, p, pc) in enumerate(pairs)], "pair int, child string, parent string")
    if not sides:
        return names.select("child", "parent", *[F.lit(None).cast(t).alias(c) for c, t in (("n_checked", "long"), ("n_orphans", "long"), ("coverage", "double"))])
    values = union_all(sides).groupBy("pair", "value").agg(F.sum("child_rows").alias("child_rows"), F.min("child_rows").alias("parent_mark"))
    orphans = F.sum(F.when(F.col("parent_mark") == 1, F.col("child_rows")).otherwise(F.lit(0)))
    counted = values.groupBy("pair").agg(F.sum("child_rows").alias("checked"), orphans.alias("orphans"))
    checked, missing = F.coalesce("checked", F.lit(0)), F.coalesce("orphans", F.lit(0))
    return names.join(counted, "pair", "left").select(
        "child", "parent", checked.alias("n_checked"), missing.alias("n_orphans"), F.when(checked > 0, (checked - missing) / checked).alias("coverage"))


def _refuted(df: DataFrame, candidates: list[tuple[str, ...]], rows: int) -> set[tuple[str, ...]]:
    """Those of the column lists that repeat within some rows, which proves that they are no keys.

    The rows come over as numbers of their values (bounded), and agreeing rows are looked for in numpy.
    """
    names = sorted({c for k in candidates for c in k})
    fields = [df.schema[c] for c in names]
    some = df.select(*[F.xxhash64(value_key(f)).alias(f"c{i}") for i, f in enumerate(fields)]).limit(rows).toArrow()
    codes = {c: np.unique(some.column(i).to_numpy(), return_inverse=True)[1].astype(np.int64) for i, c in enumerate(names)}
    found = set()
    for key in candidates:
        whole = codes[key[0]]
        for c in key[1:]:
            whole = np.unique(whole * (int(codes[c].max(initial=0)) + 1) + codes[c], return_inverse=True)[1]
        if len(whole) and int(whole.max()) + 1 < len(whole):
            found.add(key)
    return found


#: Of the hashes of tuples, one in so many is looked at before all are: it has all rows of its tuples.
_SHARE = 64


def _tuple_hash(fields: Sequence[T.StructField]) -> Column:
    """64 bits that are equal for equal tuples without null."""
    plain = (INTEGER, TIMESTAMP, LOCAL_TIMESTAMP, "date", "boolean")
    return F.xxhash64(*[column(f.name) if type_class(f.dataType) in plain else F.when(column(f.name) == 0, F.lit(0.0)).otherwise(column(f.name).cast("double"))
                        if type_class(f.dataType) == FLOAT else value_key(f) for f in fields])


def _unrepeated(tables: Tables, asked: list[tuple[str, tuple[str, ...]]]) -> set[int]:
    """Numbers of the column lists, none with nulls, that have rows and no tuple twice, exact.

    Tuples are compared first in a share of their hashes, where most repeats show, then by the hashes of all rows: a list without an equal
    pair of hashes has no equal tuples. Where hashes are equal, the rows of one such hash are compared; only if their tuples differ
    are all tuples of the list compared.
    """
    fields = [[tables[t].schema[c] for c in k] for t, k in asked]

    def hashes(i: int) -> DataFrame:
        return tables[asked[i][0]].select(F.lit(i).alias("candidate"), _tuple_hash(fields[i]).alias("hash"), *[column(c) for c in asked[i][1]])

    def repeated(parts: dict[int, DataFrame]) -> set[int]:
        """Those with a tuple twice among their rows."""
        if not parts:
            return set()
        rows = union_all([df.select("candidate", _tuple_key([value_key(f) for f in fields[i]]).alias("value")) for i, df in parts.items()])
        found = rows.groupBy("candidate", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("candidate").distinct().collect()
        return {r.candidate for r in found}  # one row for each list at most

    some = repeated({i: hashes(i).where(F.pmod("hash", F.lit(_SHARE)) == 0) for i in range(len(asked))})
    left = [i for i in range(len(asked)) if i not in some]
    if not left:
        return set()
    counted = union_all([hashes(i).select("candidate", "hash") for i in left]).groupBy("candidate", "hash").agg(F.count(F.lit(1)).alias("n"))
    twice = {r.candidate: r.twice for r in counted.groupBy("candidate").agg(F.min(F.when(F.col("n") > 1, F.col("hash"))).alias("twice")).collect()}
    found = {i for i, h in twice.items() if h is None}
    doubtful = {i: h for i, h in twice.items() if h is not None}
    proven = repeated({i: hashes(i).where(F.col("hash") == h) for i, h in doubtful.items()})
    equal = {i: hashes(i) for i in doubtful if i not in proven}  # two tuples of one hash: all decide
    return found | (set(equal) - repeated(equal))


def find_keys(tables: Tables, width: int = 2, witness_rows: int = 20_000) -> DataFrame:
    """(table_name, columns, width): all minimal keys of up to `width` columns, exact.

    A key has no null and no repeated tuple, and no part of it is a key. Level by level: columns without null that are no
    keys make pairs, pairs that are none make triples whose pairs are all open, and so on. Some rows of a table refute most
    candidates: two of them that agree are a proof. What is left is decided exactly on all rows (`_unrepeated`). columns: comma-joined in the order of the table.
    """
    spark = next(iter(tables.values())).sparkSession
    facts = lake_facts(tables)
    single = {(r.table_name, r.column_name) for r in key_candidates_from(tables, facts).where("is_key").collect()}
    nulls = {(f["table_name"], f["column_name"]): f["n_nulls"] for f in facts}
    found = [(t, c, 1) for t, c in sorted(single)]
    open_ = {t: [(f.name,) for f in scalar_columns(df.schema) if (t, f.name) not in single and nulls[(t, f.name)] == 0] for t, df in tables.items()}
    for size in range(2, width + 1):
        asked: list[tuple[str, tuple[str, ...]]] = []
        following: dict[str, list[tuple[str, ...]]] = {}
        for table, known in open_.items():
            held = set(known)
            candidates = [a + b[-1:] for a in known for b in known if a[:-1] == b[:-1] and known.index(a) < known.index(b)]
            candidates = [k for k in candidates if all(k[:i] + k[i + 1 :] in held for i in range(len(k)))]
            refuted = _refuted(tables[table], candidates, witness_rows) if candidates else set()
            following[table] = candidates
            asked += [(table, k) for k in candidates if k not in refuted]
        exact = set()
        if asked:
            exact = {asked[i] for i in _unrepeated(tables, asked)}
        found += [(t, ",".join(k), size) for t, k in sorted(exact)]
        open_ = {t: [k for k in ks if (t, k) not in exact] for t, ks in following.items()}
    return local_frame(spark, found, "table_name string, columns string, width int")


def composite_inclusions(tables: Tables, keys: Iterable[tuple[str, Sequence[str]]]) -> DataFrame:
    """(child_table, child_columns, parent_table, parent_columns): tuples of another table's columns that lie in a
    composite key of a parent, all child rows without null taken, of which there is one at least.

    keys: (table, columns) of parents, as `find_keys` gives them. Level-wise: a column list is a candidate only if each of
    its columns lies in the parent's column at its place, which is known for all columns from one grouping of values; candidates
    are checked exactly together. Columns of a list differ from each other.
    """
    spark = next(iter(tables.values())).sparkSession
    keys = [(t, list(c)) for t, c in keys]
    parents = {(t, c) for t, columns in keys for c in columns}
    classes = {type_class(tables[t].schema[c].dataType) for t, c in parents}
    wanted = {(t, f.name) for t, df in tables.items() for f in scalar_columns(df.schema) if type_class(f.dataType) in classes}
    sets = column_sets(tables, wanted, every_holder=True).collect()  # one row for each column of the lake
    names = {(r.type_class, r.column_id): (r.table_name, r.column_name) for r in sets}
    holders = {(r.table_name, r.column_name): {names[(r.type_class, h)] for h in r.held_by} for r in sets if r.n_distinct}
    candidates = []
    for parent, columns in keys:
        for child in tables:
            if child == parent:
                continue
            fits = [[c for (t, c), held in holders.items() if t == child and (parent, p) in held] for p in columns]
            candidates += [(child, list(k), parent, columns) for k in product(*fits) if len(set(k)) == len(k)]
    schema = "child_table string, child_columns string, parent_table string, parent_columns string"
    if not candidates:
        return local_frame(spark, [], schema)
    number = {(f"{c}({', '.join(cc)})", f"{p}({', '.join(pc)})"): (c, ",".join(cc), p, ",".join(pc)) for c, cc, p, pc in candidates}
    held = check_composite_foreign_keys(tables, candidates).where("n_checked > 0 AND n_orphans = 0").select("child", "parent").collect()
    return local_frame(spark, sorted(number[(r.child, r.parent)] for r in held), schema)
