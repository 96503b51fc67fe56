import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidemill.operators import audit, extract
from slidemill.plans import builder, report
from slidemill.sources import annotations, shards, tiff
from slidemill.streaming import folder

QUADS = [(200, 50, 50), (50, 200, 50), (50, 50, 200), (200, 200, 50)]


def quadrants(n):
    out = np.zeros((n, n, 3), np.uint8)
    h = n // 2
    for k, c in enumerate(QUADS):
        out[k // 2 * h : (k // 2 + 1) * h, k % 2 * h : (k % 2 + 1) * h] = c
    return out


@pytest.fixture(scope="module")
def slide(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("s") / "one.v2.tiff")
    tiff.write_pyramid(at, [quadrants(512), quadrants(512)[::2, ::2]], mpp=0.5)
    return at


@pytest.fixture(scope="module")
def base(spark, slide):
    return builder.of_slides(spark, [slide], 1.0, "downsample")


def test_header_and_window(slide):
    with open(slide, "rb") as f:
        lv = tiff.levels_of(f)
        assert [(x.w, x.h) for x in lv] == [(512, 512), (256, 256)] and lv[0].mpp == pytest.approx(0.5, rel=1e-3)
        assert (tiff.read_window(f, lv[0], 200, 200, 112, 112) == quadrants(512)[200:312, 200:312]).all()
        assert tiff.read_window(f, lv[1], 250, 250, 20, 20)[10:].sum() == 0


def test_sixteen_patches(base, slide):
    rows = list(base.then(builder.extract_patches(128)).stream(batch_size=6, layout="NHWC"))
    assert sum(len(x[2]) for x in rows) == 16 and rows[0][0] == "one.v2"
    for _, px, xy, meta in rows:
        for p, (x, y) in zip(px, xy, strict=True):
            assert (p == quadrants(512)[y : y + 128, x : x + 128]).all()
        assert "pixels" not in meta[0]


def test_same_path_twice_and_none(spark, slide):
    p = builder.of_slides(spark, [slide, slide], 1.0, "downsample").then(builder.extract_patches(128))
    assert p.frame().groupBy("slide_ord").count().count() == 2
    assert list(builder.of_slides(spark, []).then(builder.extract_patches(128)).stream()) == []


def test_rois_and_resampling(spark, base, slide, tmp_path):
    xml = tmp_path / "r.xml"
    xml.write_text('<A><Annotations><Annotation PartOfGroup="roi" Type="Rectangle"><Coordinates><Coordinate X="0" Y="0"/><Coordinate X="256" Y="256"/></Coordinates></Annotation><Annotation PartOfGroup="other" Type="Dot"/></Annotations></A>')

    def boxes(s):
        from slidemill.operators import rois

        return rois.rect_rois(s, annotations.xml_rois(spark, {"one.v2": str(xml)}, s))

    assert base.then(builder.attach([boxes])).then(builder.extract_patches(128)).frame().count() == 4
    for mode in ("resample", "nearest"):
        p = builder.of_slides(spark, [slide], 4.0, "downsample", mode, None).then(builder.extract_patches(64, interpolation="area"))
        got = p.frame().collect()
        assert len(got) == (4 if mode == "resample" else 16)
        if mode == "resample":
            assert {tuple(np.frombuffer(r.pixels, np.uint8)[:3]) for r in got} == set(QUADS)


def test_padding(spark, base):
    px = {(r.x, r.y): np.frombuffer(r.pixels, np.uint8).reshape(200, 200, 3) for r in base.then(builder.extract_patches(200, wsi_edge_policy="zeros")).frame().collect()}
    assert len(px) == 9 and px[400, 400][112:].sum() == 0 and px[400, 400][:112, :112].any()
    edge = {(r.x, r.y): np.frombuffer(r.pixels, np.uint8).reshape(200, 200, 3) for r in base.then(builder.extract_patches(200, wsi_edge_policy="edge")).frame().collect()}
    assert (edge[400, 400] == QUADS[3]).all()
    assert base.then(builder.extract_patches(200)).frame().count() == 4


def test_builder_guards(base):
    p = base.then(builder.extract_patches(128)).then(builder.png_encoder())
    with pytest.raises(RuntimeError):
        p.to(builder.TarShards("/tmp/x")).then(builder.pen())
    with pytest.raises(RuntimeError):
        p.materialize()
    with pytest.raises(TypeError, match="low_contrast.*pixels"):
        base.then(builder.low_contrast()).frame()


def test_shards_round_trip(spark, base, tmp_path):
    p = base.then(builder.extract_patches(128)).then(builder.png_encoder()).to(builder.TarShards(str(tmp_path), shard_size=6))
    assert sorted((r.shard_id, r.n) for r in p.materialize().collect()) == [(0, 6), (1, 6), (2, 4)]
    names = [m.name for f in sorted(tmp_path.glob("*.tar")) for m in tarfile.open(f)]
    assert sum(n.endswith(".png") for n in names) == 16
    rows = shards.load_shards(spark, str(tmp_path), ["one.v2_"])
    assert rows.count() == 16 and shards.load_shards(spark, str(tmp_path), ["two"]).count() == 0
    keys, images, meta = next(shards.batches(rows, 5))
    assert images.shape == (5, 3, 128, 128) and images.max() <= 1 and json.loads(meta[0])["wsi_id"] == "one.v2"
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        shards.load_shards(spark, str(tmp_path / "none"))


def test_audit_equals_honest_run(base):
    p = base.then(builder.extract_patches(96, 80)).then(builder.low_contrast(0.3)).then(builder.edge(1)).then(builder.pen(0.9))
    found = p.dry_run()
    f = {r.stage: r for r in found.funnel().collect()}
    assert f["pen"].n_out == p.frame().count() and f["source"].n_in == found.rows.count()
    assert found.resolved({"edge": 0}).filter("dropped_by is null").count() >= f["pen"].n_out
    page = report.visualize(found, "one.v2", 96)
    assert "low_contrast" in page.text and page._repr_html_().startswith("<iframe")
    with pytest.raises(KeyError):
        report.visualize(found, "two", 96)
    assert "edge" in audit.text_table(found.funnel().collect())


def test_macenko_and_classifier(base):
    p = base.then(builder.extract_patches(96, 80, batch_size=3)).then(builder.macenko(beta=0.05))
    assert p.frame().count() == base.then(builder.extract_patches(96, 80)).frame().count()

    def scorer():
        return lambda px: np.stack([px[..., 0].mean(axis=(1, 2)), px[..., 2].mean(axis=(1, 2))], axis=1) / 255

    kept = extract.classify(base.then(builder.extract_patches(256)).frame(), scorer).collect()
    assert {(r.x, r.y) for r in kept} == {(0, 0), (256, 0), (256, 256)}  # more red than blue, or as much


def test_points_and_geojson(spark, tmp_path):
    from slidemill.operators import annotate

    (tmp_path / "p.csv").write_text("x,y,label\n5.9,5,1\n20,20,2\n16,0,3\n")
    pts = annotations.csv_points(spark, str(tmp_path / "p.csv")).withColumn("slide_ord", F.lit(0))
    t = spark.createDataFrame([(0, 0, x, y) for x in (0, 16) for y in (0, 16)], "slide_ord int, roi_index int, x long, y long")
    got = {(r.x, r.y): [tuple(a) for a in r.annotations] for r in annotate.annotate_points(t, pts, 16).collect()}
    assert got == {(0, 0): [(5, 5, 1)], (16, 16): [(4, 4, 2)], (16, 0): [(0, 0, 3)], (0, 16): []}
    assert annotate.annotate_points(t, pts, 16, filter_empty=True).count() == 3
    with pytest.raises(ValueError, match="lab"):
        annotations.csv_points(spark, str(tmp_path / "p.csv"), label_col="lab")
    square = [[[0, 0], [4, 0], [4, 4, 9], [0, 4], [0, 0]]]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"k": 1}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": None, "geometry": None}]}))
    f = annotations.geojson_features(spark, str(tmp_path / "g.json"))
    v = f.select(F.lit(0).alias("slide_ord"), "fid", F.explode("vertices").alias("v")).select("slide_ord", "fid", "v.*")
    c = annotate.centroids(v, 2.0, 1.0, 0.0).collect()
    assert f.count() == 2 and [(r.px, r.py) for r in c] == [((8 / 5 + 1) * 2, 8 / 5 * 2)]
    assert annotations.shifted(square, 0.5, 1, 0)[0][2] == [1, 2]


def test_folder_stream(spark, slide, tmp_path):
    import os
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(slide, src / "a.tiff")
    for _ in range(2):
        q = folder.catalogue(folder.watch(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        n = spark.read.parquet(str(tmp_path / "out")).groupBy("wsi_id").count().collect()
        shutil.copy(slide, src / "b.tiff")
        os.utime(src / "b.tiff")
    assert {r.wsi_id: r["count"] for r in n} == {"a": 2, "b": 2}
