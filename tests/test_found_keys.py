"""Exact uniqueness of column lists by hashes."""

import pytest
from pyspark.sql import functions as F

from lakescribe.operators import keys


def table(spark):
    # (a, b) repeats once, far apart; (a, c) does by zeros of both signs, (a, e) by NaN; (a, d) is a key
    rows = spark.range(0, 3_000, 1, 4).select(
        (F.col("id") % 1_500).alias("a"), F.when(F.col("id") == 2_900, 1_400).otherwise(F.col("id")).alias("b"),
        F.when(F.col("id") == 7, F.lit(-0.0)).when(F.col("id") == 1_507, F.lit(0.0)).otherwise(F.col("id") + 0.5).alias("c"),
        F.concat(F.lit("x" * 70), F.col("id").cast("string")).alias("d"),
        F.when(F.col("id") % 1_500 == 9, F.lit(float("nan"))).otherwise(F.col("id") + 0.5).alias("e"))
    return {"t": rows, "none": rows.limit(0)}


ASKED = [("t", ("a", "b")), ("t", ("a", "c")), ("t", ("a", "d")), ("t", ("a", "e")), ("none", ("a", "b"))]


def test_lists_are_decided_exactly(spark):
    assert keys._unrepeated(table(spark), ASKED) == {2}


@pytest.mark.parametrize("share", [1, 64, 1 << 40])
def test_equal_hashes_prove_nothing(spark, monkeypatch, share):
    """With hashes that coincide for different tuples, the tuples themselves decide, whatever share is looked at first."""
    monkeypatch.setattr(keys, "_SHARE", share)
    monkeypatch.setattr(keys, "_tuple_hash", lambda fields: F.pmod(F.col(f"`{fields[0].name}`"), F.lit(10)) + 1)
    assert keys._unrepeated(table(spark), ASKED) == {2}


def test_all_tuples_are_shuffled_as_hashes_only(spark, monkeypatch):
    """The texts of tuples are made for a share of the rows."""
    seen = []
    made = keys._tuple_key

    def counted(parts):
        seen.append(len(parts))
        return made(parts)

    monkeypatch.setattr(keys, "_tuple_key", counted)
    rows = spark.createDataFrame([(i // 3, i % 3, i // 3 + 5) for i in range(3_000)], "a long, b int, c long")
    found = keys.find_keys({"t": rows}, witness_rows=1)
    assert sorted(tuple(r) for r in found.collect()) == [("t", "a,b", 2), ("t", "b,c", 2)]
    assert len(seen) == 3  # the three pairs in a share; (a, b) and (b, c) are decided by hashes
