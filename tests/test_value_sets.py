"""Distinct values, uniqueness and inclusions of columns from one shuffle of their values."""

from lakescribe.operators import distincts


def tables(spark):
    nan = float("nan")
    parent = [(i, f"k{i}", i + 0.5) for i in range(40)] + [(None, None, nan)]
    child = [(i % 7, f"k{i % 5}", 0.0 if i % 2 else -0.0, None) for i in range(30)] + [(None, "k39", nan, None)]
    return {
        "parent": spark.createDataFrame(parent, "id long, name string, x double"),
        "child": spark.createDataFrame(child, "id int, name string, x double, none long"),
        "empty": spark.createDataFrame([], "id long, name string"),
    }


def sets(spark, every_holder, given):
    own = tables(spark)
    wanted = {(t, c) for t, df in own.items() for c in df.columns}
    facts = distincts.lake_facts(own) if given else None
    return distincts.column_sets(own, wanted, every_holder, facts)


def test_sets_are_exact(spark):
    for every_holder in (False, True):
        for given in (False, True):
            rows = sets(spark, every_holder, given).collect()
            found = {(r.table_name, r.column_name): (r.n_distinct, r.is_unique) for r in rows}
            assert found == {
                ("parent", "id"): (40, True), ("parent", "name"): (40, True), ("parent", "x"): (41, True),
                ("child", "id"): (7, False), ("child", "name"): (6, False), ("child", "x"): (2, False)}
            names = {(r.type_class, r.column_id): (r.table_name, r.column_name) for r in rows}
            holders = {(r.table_name, r.column_name): {names[(r.type_class, h)] for h in r.held_by} for r in rows}
            assert ("parent", "id") in holders[("child", "id")] and ("parent", "name") in holders[("child", "name")]
            assert ("parent", "x") not in holders[("child", "x")]


def test_values_are_shuffled_once(spark):
    """No grouping by column and value before that by value."""
    plan = sets(spark, False, True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(value" in plan and "hashpartitioning(column_id" in plan and "copies" not in plan
