"""Points in tiles against plain loops: with a crowded bucket and with none, whichever side is copied."""

import random

import pytest
from pyspark.sql import functions as F

from slidemill.operators import annotate, audit
from slidemill.operators.audit import Knob

TILE = 16


def made(spark, crowd):
    rng = random.Random(crowd)
    tiles = [(s, 0, x, y) for s in (0, 1) for x in range(0, 80, 8) for y in range(-8, 60, 8)]
    points = [(s, rng.randrange(-10, 90), rng.randrange(-10, 70), i) for i in range(300) for s in (0, 1)] + [(0, 33, 20 + i % 3, 1000 + i) for i in range(crowd)]
    t = spark.createDataFrame(tiles, "slide_ord int, roi_index int, x long, y long")
    p = spark.createDataFrame(points, "slide_ord int, px long, py long, label int")
    want = {(s, r, x, y): sorted((px - x, py - y, k) for z, px, py, k in points if z == s and x <= px < x + TILE and y <= py < y + TILE) for s, r, x, y in tiles}
    return t, p, want


@pytest.mark.parametrize("copy", ["tiles", "points"])
@pytest.mark.parametrize("crowd", [0, 400])
def test_points_in_tiles(spark, copy, crowd):
    t, p, want = made(spark, crowd)
    got = annotate.annotate_points(t, p, TILE, copy=copy, crowd=150)
    assert {(r.slide_ord, r.roi_index, r.x, r.y): [tuple(a) for a in r.annotations] for r in got.collect()} == want
    tiles, points, key = annotate.bucketed(t, p, TILE, copy, 150)
    assert ("part" in key) == bool(crowd)
    if not crowd:  # nothing is copied but for the buckets that a tile covers
        assert (points if copy == "tiles" else tiles).count() == (p if copy == "tiles" else t).count()
    else:
        assert points.groupBy(*key).count().agg(F.max("count")).first()[0] < 260
    plan = annotate.points_in_tiles(t, p, TILE, copy)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_neither_side(spark):
    t, p, _ = made(spark, 0)
    with pytest.raises(ValueError):
        annotate.points_in_tiles(t, p, TILE, "both")


def test_two_stages_of_one_name(spark):
    """Otsu before and after a transform: both stand in the funnel, with the drops of an honest run."""
    rows = spark.createDataFrame([(0, a / 10, b / 10) for a in range(10) for b in range(10)], "slide_ord int, `m@0` double, m double")
    knobs = [Knob("otsu", "m@0", ">=", 0.2), Knob("otsu", "m", ">=", 0.5)]
    f = [(r.stage, r.n_in, r.n_out) for r in audit.funnel(rows, audit.tuned(knobs)).sort("stage_ord").collect()]
    assert f == [("source", 100, 100), ("otsu", 100, 80), ("otsu#2", 80, 40)]
    other = audit.funnel(rows, audit.tuned(knobs, {"otsu": 0.0, "otsu#2": 0.9}, order=["otsu#2", "otsu"])).sort("stage_ord").collect()
    assert [(r.stage, r.n_out) for r in other] == [("source", 100), ("otsu#2", 10), ("otsu", 10)]
    with pytest.raises(KeyError):
        audit.tuned(knobs, {"otsu#3": 1.0})
