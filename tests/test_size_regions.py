"""Grid tiles that regions touch, against the whole grid."""

from pyspark.sql import functions as F

from slidemill.operators import rois, tiles


def test_touched_tiles(spark):
    boxes = [(0, 0, 0, 0, 100, 90), (0, 1, 10, 11, 20, 21), (0, 2, 16, 32, 16, 16), (0, 3, 99, 89, 1, 1), (0, 4, 47, 48, 2, 0), (0, 5, 96, 0, 40, 200), (1, 0, 3, 3, 5, 5), (1, 1, 0, 0, 10, 12)]
    sides = {0: (100, 90), 1: (10, 12)}
    r = spark.createDataFrame([(*b, *sides[b[0]]) for b in boxes], "slide_ord int, roi_index long, rx long, ry long, rw long, rh long, sw long, sh long")
    whole = spark.createDataFrame([(s, 0, 0, 0, w, h, w, h) for s, (w, h) in sides.items()], "slide_ord int, roi_index long, x long, y long, w long, h long, sw long, sh long")
    every = tiles.plan_tiles(whole, 16, 16).select("slide_ord", "x", "y").join(r, "slide_ord")
    for test in (rois.intersects_patch, rois.contains_patch):
        pick = lambda df, test=test: sorted(df.filter(test(F.col("x"), F.col("y"), 16)).select("slide_ord", "roi_index", "x", "y").collect())
        assert pick(tiles.grid_tiles_at(r, 16)) == pick(every)
    assert {(t.x, t.y) for t in tiles.grid_tiles_at(r, 16).filter("roi_index = 1 and slide_ord = 0").collect()} == {(x, y) for x in (0, 16) for y in (0, 16)}
