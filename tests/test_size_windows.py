"""Read windows grown to their tiles' ends without a sort of the tiles."""

from slidemill.operators import tiles


def test_grown_windows_sort_no_tiles(spark):
    r = spark.createDataFrame([(0, i, 3 * i, 5 * i, 40 + 9 * i, 70 - 6 * i, 100, 90) for i in range(6)], "slide_ord int, roi_index long, x long, y long, w long, h long, sw long, sh long")
    t = tiles.with_windows(tiles.plan_tiles(r, 16, 12), 16, 12, 24)
    got = tiles.read_windows(t, grow=16)
    assert got.columns == tiles.read_windows(t).columns
    assert sorted(got.collect()) == sorted(tiles.read_windows(tiles.grown(t, 16)).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
