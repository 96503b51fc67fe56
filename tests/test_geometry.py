import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slidemill.operators import levels, rois, tiles

PYRAMID = [(0, i, float(d), 4000 // d, 3000 // d, 0.25) for i, d in enumerate((1, 2, 4, 8))]
LEVELS = "slide_ord int, level int, ds double, lw long, lh long, mpp0 double"


@pytest.fixture(scope="module")
def pyramid(spark):
    return spark.createDataFrame(PYRAMID, LEVELS)


@pytest.mark.parametrize(
    "resolution,unit,mode,level",
    [
        (0.25, "mpp", "nearest", 0), (0.52, "mpp", "nearest", 1), (3.0, "downsample", "floor", 2), (9.0, "downsample", "floor", 3), (3.0, "downsample", "ceil", 1),
        (0.5, "downsample", "ceil", 0), (4.0, "downsample", "error", 2), (3.0, "downsample", "nearest", 1), (2, "level", "nearest", 2),
    ],
)
def test_levels(pyramid, resolution, unit, mode, level):
    r = levels.select_level(pyramid, resolution, unit, mode, None).first()
    assert (r.level, r.resample_factor) == (level, 1.0)


def test_resample_dims(pyramid):
    r = levels.select_level(pyramid, 3.0, "downsample", "resample").first()
    assert (r.level, r.resample_factor, r.downsample, r.w, r.h) == (1, 1.5, 3.0, 1333, 1000)
    up = levels.select_level(pyramid, 0.5, "downsample", "resample").first()
    assert (up.level, up.resample_factor, up.w) == (0, 0.5, 8000)


def test_level_guards(pyramid):
    for bad in [dict(unit="inch"), dict(mode="best"), dict(unit="level", mode="resample"), dict(unit="level", resolution=1.5), dict(max_relative_deviation=-1.0)]:
        with pytest.raises(ValueError):
            levels.select_level(pyramid, **({"resolution": 1.0} | bad))
    for bad in [dict(resolution=0.7, mode="nearest"), dict(resolution=0.7, mode="error"), dict(resolution=9, unit="level")]:
        with pytest.raises(PySparkException):
            levels.select_level(pyramid, **bad).collect()


def roi(spark, *boxes, sw=10_000, sh=10_000):
    return spark.createDataFrame([(0, i, *b, sw, sh) for i, b in enumerate(boxes)], "slide_ord int, roi_index long, x long, y long, w long, h long, sw long, sh long")


@pytest.mark.parametrize("box,ts,stride,n", [((0, 0, 64, 64), 16, 16, 16), ((0, 0, 2000, 2000), 1200, 900, 4), ((0, 0, 1000, 1000), 1024, 1024, 1), ((0, 0, 10_000, 10_000), 224, 224, 2025), ((0, 0, 10_000, 10_000), 128, 64, 24_336)])
def test_tile_counts(spark, box, ts, stride, n):
    assert tiles.plan_tiles(roi(spark, box), ts, stride).count() == n


def test_modes_and_errors(spark):
    r = roi(spark, (0, 0, 100, 100))
    xy = lambda m: {(t.x, t.y) for t in tiles.plan_tiles(r, 40, 40, m).collect()}
    assert len(xy("any_overlap")) == 9 and xy("full_inside_bounds") == {(a, b) for a in (0, 40) for b in (0, 40)} and len(xy("center_in_roi")) == 4
    for f in (lambda: tiles.plan_tiles(r, 0, 1), lambda: tiles.plan_tiles(r, 8, 8, "some"), lambda: tiles.window_size(6000), lambda: tiles.window_size(10, 25), lambda: tiles.with_padding(r, 8, "wrap")):
        with pytest.raises(ValueError):
            f()


def test_windows_group_tiles(spark):
    t = tiles.plan_tiles(roi(spark, (0, 0, 64, 32)), 16, 16)
    w = {(r.rx, r.ry, r.rw, r.rh): r.n_tiles for r in tiles.read_windows(tiles.with_windows(t, 16, 16, 32)).collect()}
    assert w == {(0, 0, 32, 32): 4, (32, 0, 32, 32): 4}
    one = tiles.with_batches(tiles.with_windows(t, 16, 16, 32), 3)
    assert sorted((r.batch_ord, r.n) for r in one.groupBy("batch_ord").agg(F.count("*").alias("n")).collect()) == [(0, 3), (1, 1), (2, 3), (3, 1)]


def test_grown_reads_are_clamped(spark):
    t = tiles.with_windows(tiles.plan_tiles(roi(spark, (0, 0, 20, 20), sw=22, sh=100), 16, 8), 16, 8, 16)
    g = tiles.read_windows(tiles.grown(t, 16)).collect()
    assert all(r.rx + r.rw <= 22 and r.ry + r.rh <= 24 for r in g) and max(r.rx + r.rw for r in g) == 22


def test_edge_tiles(spark):
    t = tiles.plan_tiles(roi(spark, (0, 0, 1000, 1000), sw=1000, sh=1000), 224, 224)
    assert tiles.remove_edge_tiles(t, 224).count() == 9
    t = tiles.plan_tiles(roi(spark, (0, 0, 1000, 1000), sw=1000, sh=1000), 100, 100)
    assert tiles.remove_edge_tiles(t, 100, 2).count() == 36 and tiles.remove_edge_tiles(t, 100, 0).count() == 100


def test_rois(spark):
    s = spark.createDataFrame([(0, "a", 100, 100), (1, "b", 50, 50)], "slide_ord int, wsi_id string, w long, h long")
    boxes = spark.createDataFrame([("a", 0, 0, 0, 10, 10), ("a", 1, 5, 5, 95, 95), ("zzz", 0, 0, 0, 1, 1)], "wsi_id string, ord int, x int, y int, w int, h int")
    got = rois.rect_rois(s, boxes)
    assert got.count() == 2
    assert {(r.slide_ord, r.roi_index, r.w) for r in rois.attach_rois(s, [got], "whole_slide").collect()} == {(0, 0, 10), (0, 1, 95), (1, 0, 50)}
    with pytest.raises(PySparkException):
        rois.attach_rois(s, [got]).collect()
    with pytest.raises(PySparkException):
        rois.rect_rois(s, boxes.withColumn("w", F.lit(101))).collect()
    parts = rois.subdivide(roi(spark, (10, 10, 250, 100)), 100, 40, 30).collect()
    assert sorted((p.x, p.y, p.w, p.h) for p in parts) == [(10, 10, 90, 90), (110, 10, 90, 90)]
