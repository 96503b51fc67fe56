import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidemill.functions import png
from slidemill.operators import annotate, tiles
from slidemill.plans import builder, pictures, report
from slidemill.sources import annotations, tiff


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(11).integers(0, 256, (300, 420, 3), dtype=np.uint8)


@pytest.mark.parametrize("big", [False, True])
def test_levels_among_other_images(tmp_path, image, big):
    at = str(tmp_path / "a.tiff")
    tiff.write_pyramid(at, [image, image[:90, :90], image[::2, ::2], image[:40, :200]], tile=64, mpp=0.5, big=big)
    rows = list(tiff.header_rows(3, at, probe=True))
    assert [(r[3], r[4], r[5], r[6]) for r in rows] == [(0, 420, 300, 1.0), (1, 210, 150, 2.0)] and rows[0][7] == pytest.approx(0.5, rel=1e-3)
    with open(at, "rb") as f:
        lv = tiff.levels_of(f)
        assert (tiff.read_window(f, lv[0], 30, 40, 200, 180) == image[40:220, 30:230]).all()
        assert (tiff.read_window(f, lv[1], 0, 0, 210, 150) == image[::2, ::2]).all()


def test_mpp_in_descriptions(tmp_path, image):
    for said, mpp in (("Scan|AppMag = 40|MPP = 0.2520|x", 0.252), ('<Pixels PhysicalSizeX="0.33">', 0.33), ("nothing", 0.5)):
        at = str(tmp_path / "m.tiff")
        tiff.write_pyramid(at, [image], tile=64, mpp=0.5, description=said)
        assert next(tiff.header_rows(0, at))[7] == pytest.approx(mpp, rel=1e-3)


def test_failing_slides_are_skipped_and_told(spark, tmp_path, image):
    good, cut, text, bare = (str(tmp_path / f"{n}.tiff") for n in ("good", "cut", "text", "bare"))
    tiff.write_pyramid(good, [image], tile=64, mpp=0.5)
    tiff.write_pyramid(bare, [image], tile=64)
    with open(good, "rb") as f:
        data = f.read()
    with open(cut, "wb") as f:
        f.write(data[: len(data) // 2])
    with open(text, "w") as f:
        f.write("no slide")
    paths = [good, cut, text, str(tmp_path / "none.tiff"), bare]
    p = builder.of_slides(spark, paths, 0.5, on_error="skip").then(builder.extract_patches(100))
    assert {r.slide_ord for r in p.frame().select("slide_ord").distinct().collect()} == {0}
    failed = {r.slide_ord: r.error for r in p.failed_slides().collect()}
    assert set(failed) == {1, 2, 3, 4} and "no level" in failed[4] and "TIFF" in failed[2]
    with pytest.raises(Exception):
        builder.of_slides(spark, [good, text], 0.5).then(builder.extract_patches(100)).frame().count()
    with pytest.raises(ValueError):
        builder.of_slides(spark, [good], 0.5, on_error="pass")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory, image):
    at = str(tmp_path_factory.mktemp("s") / "one.tiff")
    tiff.write_pyramid(at, [image, image[::2, ::2]], tile=64, mpp=0.5)
    return builder.of_slides(spark, [at], 1.0, "downsample")


def test_profile_counts_what_stages_hand_on(base):
    p = base.then(builder.extract_patches(100)).then(builder.keep("left", "x", "<", 200))
    rows = {r.stage: r for r in p.profile().collect()}
    assert rows["extract_patches"].n == 12 and rows["left"].n == rows["run"].n == 6 and rows["run"].wall_s > 0 and rows["left"].wall_s is None


def test_own_filter_and_sink_with_life_cycle(base, tmp_path):
    bright = builder.keep("bright", "first", ">=", 100, lambda df, c: df.withColumn("first", F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("double")), "pixels")
    p = base.then(builder.extract_patches(100)).then(bright)
    found = p.dry_run()
    assert found.resolved().filter("dropped_by is null").count() == p.frame().count()
    page = report.visualize(found, "one", 100).text
    assert "bright" in page and 'type="checkbox"' in page and "earlier(" in page
    found.close()
    steps = []

    class Sink:
        def open(self):
            steps.append("open")

        def __call__(self, df):
            steps.append("write")
            raise OSError("full")

        def close(self):
            steps.append("close")

    with pytest.raises(OSError):
        p.to(Sink()).materialize()
    assert steps == ["open", "write", "close"]
    out = p.to(builder.CsvTable(str(tmp_path / "csv"))).materialize()
    assert out.count() == p.frame().count() and "pixels" not in out.columns and "first" in out.columns


def test_regions_of_other_shapes(spark):
    r = spark.createDataFrame([(0, 0, 0, 0, 40, 40, 40, 40, 15)], "slide_ord int, roi_index int, x long, y long, w long, h long, sw long, sh long, radius long")
    disc = lambda x, y: (x + 5 - 20) * (x + 5 - 20) + (y + 5 - 20) * (y + 5 - 20) <= F.col("radius") * F.col("radius")
    got = {(t.x, t.y) for t in tiles.plan_tiles(r, 10, 10, accept=disc, carry=("radius",)).collect()}
    assert got == {(x, y) for x in range(0, 40, 10) for y in range(0, 40, 10) if (x - 15) ** 2 + (y - 15) ** 2 <= 225}


def test_pictures(spark, base, image):
    slides = base.frame()
    t = pictures.thumbnails(slides, 105).first()
    got = png.decode(t.png)
    assert got.shape == (75, 105, 3) and abs(got.astype(int).mean() - image.mean()) < 2
    patches = spark.createDataFrame([(0, 0, 0), (0, 200, 100), (0, 999, 0), (0, -5, 0)], "slide_ord int, x long, y long")
    out = png.decode(pictures.selected_patches(patches, slides, 100, 210, (1, 2, 3)).first().png)
    red = (out == (1, 2, 3)).all(axis=2)
    assert out.shape == (150, 210, 3) and red[0, :50].all() and red[:50, 49].all() and red[50, 100:150].all() and red.sum() <= 2 * 196 + 4
    assert pictures.selected_patches(patches.limit(0), slides, 100).count() == 1


def test_features_of_files(spark, tmp_path):
    square = lambda x, y: {"type": "Polygon", "coordinates": [[[x, y], [x + 4, y], [x + 4, y + 4], [x, y + 4]]]}
    shapes = [{"properties": {"k": 1, "name": "a"}, "geometry": square(10, 10)}, {"properties": None, "geometry": square(30, 2)}, {"properties": {"k": 3}, "geometry": None}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    slides = spark.createDataFrame([(0, "one", 2.0), (1, "two", 1.0)], "slide_ord int, wsi_id string, downsample double")
    files = {"one": str(tmp_path / "g.json"), "two": str(tmp_path / "g.json")}
    cells = annotations.geojson_cells(spark, files, slides, {"one": (4, -2)})
    assert {(r.slide_ord, r.fid): (r.px, r.py) for r in cells.collect()} == {(0, 0): (8.0, 5.0), (0, 1): (18.0, 1.0), (0, 2): (None, None), (1, 0): (12.0, 12.0), (1, 1): (32.0, 4.0), (1, 2): (None, None)}
    grid = spark.createDataFrame([(s, 0, x, y) for s in (0, 1) for x in (0, 16, 32) for y in (0, 16)], "slide_ord int, roi_index int, x long, y long")
    got = {(r.slide_ord, r.x, r.y): [json.loads(c) for c in r.annotations] for r in annotate.annotate_features(grid, cells, 16, ["k"], geometry=True).collect()}
    assert len(got) == 12 and sum(map(len, got.values())) == 4
    assert got[0, 0, 0][0]["k"] == 1 and got[0, 0, 0][0]["geometry"]["coordinates"] == [[[7, 4], [9, 4], [9, 6], [7, 6]]]
    assert got[0, 16, 0][0]["k"] is None and got[1, 32, 0][0]["geometry"]["coordinates"][0][0] == [-2, 2]
    assert annotate.annotate_features(grid, cells, 16, filter_empty=True).count() == 4
    with pytest.raises(Exception, match="no annotation file"):
        annotations.geojson_cells(spark, {"one": files["one"]}, slides).collect()


def test_points_of_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,label\n5.9,5,1\n20,20,2\n")
    slides = spark.createDataFrame([(0, "one"), (1, "two")], "slide_ord int, wsi_id string")
    files = {"one": str(tmp_path / "p.csv"), "two": str(tmp_path / "p.csv")}
    assert sorted(map(tuple, annotations.csv_points_of(spark, files, slides).collect())) == [(0, 5, 5, 1), (0, 20, 20, 2), (1, 5, 5, 1), (1, 20, 20, 2)]
    with pytest.raises(Exception, match="no annotation file"):
        annotations.csv_points_of(spark, {"one": files["one"]}, slides).collect()
