"""Few names do not gather their entries in a few tasks."""

from borgata.operators import encoding


def test_names_go_to_the_entries(spark, executed):
    df = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(50)], "id long, n double, kind string")
    pairs = encoding.fit(df, ["n"], ["kind"]).pairs(df, "id")
    plan = executed(pairs)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(at" not in plan
    assert pairs.count() == 50 + 25
