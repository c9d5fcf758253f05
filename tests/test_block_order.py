"""Places among siblings come from a window: no table of siblings is sent to the driver."""

from lodestone import plans
from lodestone.operators import blocks


def test_nothing_is_broadcast(spark, sf):
    plan = plans.queries()["block_order"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Broadcast" not in plan


def test_places_of_nulls_and_repeats(spark):
    rows = [(1, 0, None), (1, 1, 0), (1, 3, 0), (1, 3, 0), (1, 4, 0), (1, None, 0), (1, 5, None), (None, 2, None), (None, 9, None)]
    got = blocks.tree_order(spark.createDataFrame(rows, "doc bigint, pos int, parent int")).collect()
    want = [(1, 0, None, 1.0), (1, 1, 0, 1.0), (1, 3, 0, 2.0), (1, 3, 0, 2.0), (1, 4, 0, 4.0), (1, None, 0, None), (1, 5, None, 2.0), (None, 2, None, 1.0), (None, 9, None, 2.0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
