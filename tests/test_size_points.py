"""What points in tiles shuffle."""

import pytest
from pyspark.sql import functions as F

from slidemill.operators import annotate


@pytest.mark.parametrize("filter_empty", [False, True])
def test_tiles_are_shuffled_once(spark, filter_empty):
    t = spark.createDataFrame([(s, 0, x, y) for s in (0, 1) for x in range(0, 80, 8) for y in range(0, 60, 8)], "slide_ord int, roi_index int, x long, y long")
    points = [(s, (i * 37) % 50, (i * 23) % 70, i) for i in range(40) for s in (0, 1)]
    p = spark.createDataFrame(points, "slide_ord int, px long, py long, label int")
    found = annotate.annotate_points(t, p, 16, filter_empty=filter_empty, copy="points")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    want = {(r.slide_ord, r.x, r.y): sorted((px - r.x, py - r.y, k) for s, px, py, k in points if s == r.slide_ord and r.x <= px < r.x + 16 and r.y <= py < r.y + 16) for r in t.collect()}
    got = {(r.slide_ord, r.x, r.y): [tuple(a) for a in r.annotations] for r in found.collect()}
    assert got == {k: v for k, v in want.items() if v or not filter_empty}
    more = annotate.annotate_points(t.withColumn("more", F.lit("m")), p, 16, filter_empty=filter_empty, copy="points")
    assert more.columns == [*t.columns, "more", "annotations"] or set(more.columns) == {*t.columns, "more", "annotations"}
    assert {(r.slide_ord, r.x, r.y): [tuple(a) for a in r.annotations] for r in more.collect()} == got
