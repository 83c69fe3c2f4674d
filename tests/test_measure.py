"""Measured facts on small tables with known answers, and against brute force."""

import itertools
import random
import time
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from lakescribe.model import local_frame
from lakescribe.operators import distincts, keys, profiles
from lakescribe.plans.document_lake import document_lake


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, NaN, signed zeros, long strings, nested values and a name that needs quoting."""
    long_a, long_b = "가" * 40 + "a", "가" * 40 + "b"
    schema = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("it's `odd`", T.StringType()),
        T.StructField("f", T.DoubleType()), T.StructField("d", T.DecimalType(12, 3)), T.StructField("b", T.BooleanType()),
        T.StructField("t", T.TimestampNTZType()), T.StructField("day", T.DateType()), T.StructField("bin", T.BinaryType()),
        T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("gone", T.StringType()),
    ])
    rows = [
        (1, long_a, 0.0, Decimal("1.500"), True, datetime(2024, 1, 1), date(2024, 1, 1), b"x", [1], None),
        (2, long_b, -0.0, Decimal("20.000"), False, datetime(2024, 1, 2), date(2024, 1, 2), b"y" * 40, [2], None),
        (3, None, float("nan"), None, None, None, None, None, None, None),
        (4, "짧", 1234.5625, Decimal("0.125"), True, datetime(2024, 1, 4), date(2024, 1, 4), b"y" * 41, [], None),
    ]
    return {"odd": local_frame(spark, rows, schema)}


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_nulls_of_all_columns(odd):
    found = by_column(profiles.null_profile(odd))
    assert (found["a"]["n_nulls"], found["gone"]["n_nulls"], found["id"]["nullable"]) == (1, 4, False)


def test_lengths_in_characters_and_bytes(odd):
    found = by_column(profiles.length_profile(odd))["it's `odd`"]
    assert (found["min_chars"], found["max_chars"], found["max_bytes"]) == (1, 41, 121)
    assert by_column(profiles.length_profile(odd))["gone"]["max_chars"] is None


def test_precision_and_scale(odd):
    found = by_column(profiles.numeric_profile(odd))
    assert (found["f"]["precision"], found["f"]["scale"]) == (8, 4)  # NaN does not count
    assert (found["d"]["precision"], found["d"]["scale"]) == (5, 3)
    assert (found["id"]["precision"], found["id"]["scale"]) == (1, 0)


@pytest.mark.parametrize("kind, values, expected", [
    ("double", [0.123456789], (9, 9)),
    ("decimal(20,8)", [Decimal("1.12345678")], (9, 8)),
    ("decimal(38,0)", [Decimal("123456789012345678901234567890123456")], (36, 0)),
    ("decimal(38,0)", [Decimal("-" + "9" * 38)], (38, 0)),
    ("decimal(38,0)", [Decimal("9" * 38), Decimal(-5)], (38, 0)),
    ("decimal(12,3)", [Decimal("-12.5"), Decimal("0.125")], (5, 3)),
    ("double", [1e35], (36, 0)),
    ("decimal(20,8)", [Decimal("0.00000012"), Decimal("0")], (8, 8)),
    ("double", [1.5e-7, 12345678.5], (16, 8)),
    ("float", [0.1], (1, 1)),
    ("bigint", [-(2**63)], (19, 0)),
    ("double", [float("inf"), float("nan"), 2.5], (2, 1)),
])
def test_all_digits_count(spark, kind, values, expected):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    found = profiles.numeric_profile({"t": df}).head()
    assert (found["precision"], found["scale"]) == expected


def test_keys_meet_in_their_common_type(spark):
    at = datetime(2024, 5, 1, 12)
    child = spark.createDataFrame([(Decimal("1.5"), at, 1.5)], "d decimal(10,4), t timestamp_ntz, f double")
    parent = spark.createDataFrame([(Decimal("1.5"), at, 1.5)], "d decimal(10,2), t timestamp, f float")
    tables = {"child": child, "parent": parent}
    found = keys.check_foreign_keys(tables, [("child", c, "parent", c) for c in "dtf"]).collect()
    assert [(r["n_orphans"], r["coverage"]) for r in found] == [(0, 1.0)] * 3
    with pytest.raises(ValueError):
        keys.check_foreign_keys(tables, [("child", "d", "parent", "t")])


def test_inclusions_of_all_classes(spark):
    rows = [(Decimal(i), Decimal(i) / 4, date(2024, 1, 1 + i), datetime(2024, 1, 1, i), i / 8, bytes([i])) for i in range(9)]
    names = "n decimal(38,0), q decimal(12,4), day date, at timestamp_ntz, f double, bin binary"
    parent = spark.createDataFrame(rows, names)
    child = spark.createDataFrame(rows[2:5] * 2, names.replace("q decimal(12,4)", "q decimal(9,2)"))
    found = {(r["child_column"], r["parent_column"]) for r in distincts.inclusion_dependencies({"parent": parent, "child": child}).collect()
             if r["child_table"] == "child"}
    assert {(c, c) for c in ("n", "q", "day", "at", "f", "bin")} <= found


def test_a_repeat_seen_is_the_only_other_proof(spark):
    """Every second value repeats far apart: only the exact pass can tell, whatever pruning does."""
    df = spark.range(0, 3_000).selectExpr("CAST(id % 2999 AS string) AS almost", "CAST(id AS string) AS single")
    for prune in (True, False):
        found = by_column(distincts.key_candidates({"t": df}, prune))
        assert not found["almost"]["is_unique"] and found["single"]["is_unique"]
    assert distincts.seen_repeats({"t": df}, {("t", "almost"), ("t", "single")}, rows=100) == set()
    assert distincts.seen_repeats({"t": df}, {("t", "almost"), ("t", "single")}) == {("t", "almost")}


@pytest.mark.parametrize("value, scale", [
    (0.1, 1), (0.29, 2), (1.005, 3), (0.12345, 5), (0.50001, 5), (123456789012.25, 2), (-7.0, 0), (1e30, 0), (0.0003, 4),
])
def test_scale_of_doubles(spark, value, scale):
    df = spark.createDataFrame([(value,)], "v double")
    assert profiles.numeric_profile({"t": df}).first()["scale"] == scale


def test_distinct_values(odd):
    found = {c: r["n_distinct"] for c, r in by_column(distincts.distinct_profile(odd)).items()}
    # Signed zeros are one value, long strings differ in their last character, arrays are left out.
    assert found == {"id": 4, "it's `odd`": 3, "f": 3, "d": 3, "b": 2, "t": 3, "day": 3, "bin": 3, "gone": 0}
    assert by_column(distincts.distinct_profile(odd, approx=True))["id"]["n_distinct"] == 4


def test_unique_and_key_columns(odd):
    found = {c: (r["is_unique"], r["is_key"]) for c, r in by_column(distincts.key_candidates(odd)).items()}
    assert found["id"] == (True, True)
    assert found["it's `odd`"] == found["bin"] == found["day"] == (True, False)
    assert found["f"] == found["b"] == found["gone"] == (False, False)


def test_pruning_does_not_change_the_keys(spark, odd):
    repeats = spark.range(6_000).selectExpr("id", "id % 7 AS few", "concat('v', id % 3000) AS half", "CAST(id AS double) AS x")
    for tables in (odd, {"t": repeats}):
        assert by_column(distincts.key_candidates(tables)) == by_column(distincts.key_candidates(tables, prune=False))


def test_document_of_odd_tables(odd):
    catalog = document_lake(odd)
    columns = {r["name"]: r for r in catalog["columns"].collect()}
    assert columns["id"]["is_primary_key"] and columns["id"]["is_auto_increment"] is True
    assert columns["a"]["data_type"] == "array<int>" and not columns["a"]["is_unique"]
    assert columns["gone"]["nullable"] and columns["gone"]["length"] == 0
    assert catalog["tables"].first()["row_count"] == 4


def test_comments_are_taken_over(spark, odd):
    notes = local_frame(spark, [("odd", "id", "a number"), ("odd", "", "strange")],
                        "table_name string, column_name string, comment string")
    catalog = document_lake(odd, notes)
    assert catalog["tables"].first()["comment"] == "strange"
    assert catalog["columns"].where("name = 'id'").first()["comment"] == "a number"


def test_empty_table(spark):
    tables = {"none": spark.createDataFrame([], "id int, s string, x double")}
    assert profiles.row_counts(tables).first()["row_count"] == 0
    assert not any(r["is_unique"] for r in distincts.key_candidates(tables).collect())
    assert distincts.inclusion_dependencies(tables).count() == 0
    assert document_lake(tables)["columns"].where("is_primary_key").count() == 0


def test_composite_key_with_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 1)], "a int, b int")
    r = keys.check_key(df, ["a", "b"]).first()
    assert (r["n_rows"], r["n_distinct"], r["dup_groups"], r["excess_rows"], r["is_key"]) == (4, 3, 1, 1, False)
    assert keys.check_key(df.where("a is not null"), ["a", "b"]).first()["is_key"]
    assert not keys.check_key(df.where("b = 1").limit(2).where("a is null or a = 1").distinct(), ["a", "b"]).first()["is_key"]


def test_foreign_key_check(spark):
    tables = {
        "c": spark.createDataFrame([(1,), (1,), (5,), (None,)], "p_id int"),
        "p": spark.createDataFrame([(1,), (2,), (2,)], "id long"),
        "e": spark.createDataFrame([], "p_id int"),
    }
    found = {r["child"]: r for r in keys.check_foreign_keys(tables, [("c", "p_id", "p", "id"), ("e", "p_id", "p", "id")]).collect()}
    assert (found["c.p_id"]["n_checked"], found["c.p_id"]["n_orphans"]) == (3, 1)
    assert (found["e.p_id"]["n_checked"], found["e.p_id"]["coverage"]) == (0, None)
    with pytest.raises(ValueError):
        keys.check_foreign_keys({**tables, "s": spark.createDataFrame([("1",)], "id string")}, [("c", "p_id", "s", "id")])


def test_sequences(spark):
    rows = [(7 + 3 * i, i, i * i, -i) for i in range(50)]
    tables = {"t": spark.createDataFrame(rows, "stepped int, dense long, squares int, down int")}
    found = by_column(keys.sequence_profile(tables))
    assert (found["stepped"]["increment"], found["stepped"]["next_value"], found["stepped"]["is_dense"]) == (3, 157, False)
    assert (found["dense"]["increment"], found["dense"]["is_dense"]) == (1, True)
    assert (found["squares"]["increment"], found["squares"]["next_value"]) == (None, 2402)
    assert (found["down"]["min_value"], found["down"]["increment"]) == (-49, 1)


def test_step_that_only_fits_the_ends(spark):
    tables = {"t": spark.createDataFrame([(0,), (4,), (5,), (9,)], "k int")}
    found = keys.sequence_profile(tables).first()
    assert found["increment"] is None and found["next_value"] == 10


def brute_force_inclusions(data):
    columns = {(t, c): [v for v in values if v is not None] for t, cols in data.items() for c, values in cols.items()}
    found = set()
    for (ct, cc), child in columns.items():
        for (pt, pc), parent in columns.items():
            same = child and parent and type(child[0]) is type(parent[0])
            if same and ct != pt and len(set(parent)) == len(parent) and set(child) <= set(parent):
                found.add((ct, cc, pt, pc, len(set(child)), len(set(parent))))
    return found


def frame(spark, columns):
    names = list(columns)
    kinds = ["string" if any(isinstance(v, str) for v in columns[n]) else "int" for n in names]
    rows = list(zip(*columns.values(), strict=True))
    return local_frame(spark, rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


@pytest.mark.parametrize("seed", range(3))
def test_inclusions_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = {}
    for t in range(4):
        n = rng.randint(3, 12)
        whole = rng.sample(range(15), n)
        texts = [str(v) * (30 if seed == 2 else 1) for v in rng.sample(range(15), n)]
        data[f"t{t}"] = {
            "u": whole, "r": [rng.choice([*range(6), None]) for _ in range(n)],
            "s": texts, "x": [rng.choice([*texts[:2], None, texts[0]]) for _ in range(n)],
        }
        data[f"t{t}"]["x"][0] = texts[0]
        data[f"t{t}"]["r"][0] = 1
    tables = {t: frame(spark, cols) for t, cols in data.items()}
    assert {tuple(r) for r in distincts.inclusion_dependencies(tables).collect()} == brute_force_inclusions(data)


def test_lists_of_columns_give_what_masks_give(spark, monkeypatch):
    rng = random.Random(8)
    data = {f"t{t}": {f"c{i}": (rng.sample(range(40), 12) if i % 3 else [rng.choice([*range(5), None]) for _ in range(12)]) for i in range(8)} for t in range(5)}
    data["all"] = {"k": [*range(40)]}
    tables = {t: frame(spark, cols) for t, cols in data.items()}
    expected = brute_force_inclusions(data)
    assert {tuple(r) for r in distincts.inclusion_dependencies(tables).collect()} == expected and len(expected) > 30
    monkeypatch.setattr(distincts, "MASK_COLUMNS", 3)
    assert {tuple(r) for r in distincts.inclusion_dependencies(tables).collect()} == expected


def some_facts(rng, n, n_tables, text):
    found = []
    for i in range(n):
        low = rng.randint(0, 50)
        high = low + rng.choice([0, 3, 30])
        fact = {"table_name": f"t{rng.randrange(n_tables)}", "column_name": f"c{i}", "n_rows": 10, "n_nulls": rng.choice([0, 0, 10]), "repeat_seen": rng.random() < 0.6,
                "min_long": low, "max_long": high + 20, "min_hash": None, "max_hash": None, "bits_low": None, "bits_high": None,
                "min_chars": None, "max_chars": None, "max_bytes": None, "precision": None, "n_odd": 0}
        if text:
            bits = rng.getrandbits(6) | rng.getrandbits(6)
            fact |= {"min_long": None, "max_long": None, "min_hash": low * 10**17, "max_hash": (high + 9) * 10**17, "bits_low": bits - 32, "bits_high": rng.choice([0, 1, 3]),
                     "min_chars": rng.randint(1, 3), "max_chars": rng.randint(3, 6), "max_bytes": rng.randint(6, 9)}
        found.append(fact)
    return found


@pytest.mark.parametrize("text", [False, True])
def test_sweep_leaves_what_all_pairs_leave(text):
    rng = random.Random(3)
    for n in (1, 2, 9, 40, 700):
        facts = some_facts(rng, n, rng.choice([1, 3, 40]), text)
        expected = set()
        for p in facts:
            for c in facts:
                if distincts.may_be_unique(p) and p["table_name"] != c["table_name"] and distincts._contains(p, c):
                    expected |= {(x["table_name"], x["column_name"]) for x in (p, c)}
        assert distincts.comparable_facts([("class", f) for f in facts]) == expected


def test_fifty_thousand_columns_are_planned_in_seconds():
    rng = random.Random(4)
    facts = some_facts(rng, 50_000, 3_000, True)
    start = time.perf_counter()
    assert distincts.comparable_facts([("class", f) for f in facts])
    assert time.perf_counter() - start < 30


def small_lake(spark, seed):
    rng = random.Random(seed)
    data = {}
    for t in range(3):
        n = rng.randint(4, 9)
        data[f"t{t}"] = {"a": [rng.randint(0, 2) for _ in range(n)], "b": [rng.randint(0, 2) for _ in range(n)], "c": [rng.choice([0, 1, 2, 3]) for _ in range(n)],
                         "d": [rng.choice([1, 2, None]) for _ in range(n)], "s": [rng.choice("xyz") * rng.choice([1, 90]) for _ in range(n)], "k": rng.sample(range(20), n)}
    return data, {t: frame(spark, cols) for t, cols in data.items()}


def test_sequences_of_wide_decimals(spark):
    top = 10**38 - 1
    keys_ = {"ends": [-top, top, 0], "two": [-top, top], "step": [7 - 3 * 10**20, 7, 7 + 3 * 10**20], "off": [0, 1, 4], "one": [5], "again": [1, 1, 3], "open": [1, None, 3]}
    tables = {c: frame_of(spark, c, v) for c, v in keys_.items()}
    found = {r.table_name: tuple(r)[2:] for r in keys.decimal_sequence_profile(tables).collect()}
    assert found == {
        "ends": (-top, top, 3, top, None, False), "two": (-top, top, 2, None, None, False), "step": (7 - 3 * 10**20, 7 + 3 * 10**20, 3, 3 * 10**20, 7 + 6 * 10**20, False),
        "off": (0, 4, 3, None, 5, False), "one": (5, 5, 1, None, 6, True)}


def frame_of(spark, name, values):
    return spark.createDataFrame([(None if v is None else Decimal(v),) for v in values], f"{name} decimal(38,0)")


@pytest.mark.parametrize("seed, witness", [(1, 20_000), (2, 2), (3, 0)])
def test_found_keys_against_brute_force(spark, seed, witness):
    data, tables = small_lake(spark, seed)
    expected = set()
    for t, cols in data.items():
        whole = [c for c in cols if None not in cols[c]]
        known = []
        for size in (1, 2, 3):
            for k in itertools.combinations(whole, size):
                rows = list(zip(*[cols[c] for c in k]))
                if len(set(rows)) == len(rows) and not any(set(x) <= set(k) for x in known):
                    expected.add((t, ",".join(k), size))
            known = [tuple(x.split(",")) for u, x, _ in expected if u == t]
    assert {tuple(r) for r in keys.find_keys(tables, 3, witness).collect()} == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_composite_keys_against_brute_force(spark, monkeypatch, seed):
    data, tables = small_lake(spark, seed)
    data["t0"]["a"], data["t0"]["b"] = data["t1"]["b"][:3] + [None], data["t1"]["a"][:3] + [1]
    data["t0"] = {c: (v + v)[:4] for c, v in data["t0"].items()}
    tables["t0"] = frame(spark, data["t0"])
    pairs = [(c, cc, p, pc) for c in data for p in data for cc in (["a", "b"], ["b", "d"], ["a", "b", "c"], ["s"]) for pc in (["b", "a"], ["c", "d"], ["a", "b", "c"], ["s"])
             if len(cc) == len(pc) and c != p and ("s" in cc) == ("s" in pc)]
    found = {(r.child, r.parent): (r.n_checked, r.n_orphans) for r in keys.check_composite_foreign_keys(tables, pairs).collect()}
    included = set()
    for c, cc, p, pc in pairs:
        held = set(zip(*[data[p][x] for x in pc]))
        rows = [r for r in zip(*[data[c][x] for x in cc]) if None not in r]
        assert found[(f"{c}({', '.join(cc)})", f"{p}({', '.join(pc)})")] == (len(rows), sum(r not in held for r in rows))
    parents = [("t1", ["a", "b"]), ("t2", ["c", "k"])]
    for p, pc in parents:
        held = set(zip(*[data[p][x] for x in pc]))
        for c in data:
            for cc in itertools.permutations(["a", "b", "c", "d", "k"], 2):
                rows = [r for r in zip(*[data[c][x] for x in cc]) if None not in r]
                single = all({v for v in data[c][a] if v is not None} <= {v for v in data[p][b]} and any(v is not None for v in data[c][a]) for a, b in zip(cc, pc))
                if c != p and single and rows and set(rows) <= held:
                    included.add((c, ",".join(cc), p, ",".join(pc)))
    for most in (256, 2):
        monkeypatch.setattr(distincts, "MASK_COLUMNS", most)
        assert {tuple(r) for r in keys.composite_inclusions(tables, parents).collect()} == included
    with pytest.raises(ValueError):
        keys.check_composite_foreign_keys(tables, [("t0", ["a"], "t1", ["a", "b"])])


def test_inclusions_of_more_columns_than_a_word_has_bits(spark):
    wide = {f"c{i}": [i % 3, 1, 2] for i in range(70)}
    data = {"wide": wide, "keys": {"k": [0, 1, 2, 3]}, "more": {"k": [2, 0, 1]}}
    tables = {t: frame(spark, cols) for t, cols in data.items()}
    assert {tuple(r) for r in distincts.inclusion_dependencies(tables).collect()} == brute_force_inclusions(data)


def test_hot_value_stays_exact(spark):
    """One value fills most of a column; counts and inclusions must not suffer."""
    child = spark.range(20_000).selectExpr("CASE WHEN id % 10 < 9 THEN 7 ELSE id % 50 END AS p_id")
    tables = {"child": child, "parent": spark.range(50).withColumnRenamed("id", "id")}
    found = {(r["child_table"], r["child_column"]): r["child_distinct"] for r in distincts.inclusion_dependencies(tables).collect()}
    assert found[("child", "p_id")] == child.distinct().count()
    assert keys.check_foreign_keys(tables, [("child", "p_id", "parent", "id")]).first()["n_orphans"] == 0


def test_facts_never_rule_out_a_unique_column(spark):
    df = spark.range(30_000).selectExpr(
        "id", "concat('k', id) AS s", "CAST(id AS double) / 8 AS f", "timestamp_seconds(id) AS t", "id % 3 AS few",
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS flag", "CAST(id % 100 AS double) AS x")
    facts = {f["column_name"]: f for f in distincts.lake_facts({"t": df})}
    assert [c for c in facts if distincts.may_be_unique(facts[c])] == ["id", "s", "f", "t"]


def test_repeats_are_looked_for_in_all_partitions(spark):
    """A limit over the table takes the first rows of the first partitions, and brings those of all to one task."""
    df = spark.range(0, 4000, 1, 4).selectExpr("IF(id < 3000, CAST(id AS string), 'x') AS late", "CAST(id AS string) AS single")
    assert distincts.seen_repeats({"t": df}, {("t", "late"), ("t", "single")}, rows=100) == {("t", "late")}
