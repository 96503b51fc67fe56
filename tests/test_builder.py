"""Filters in a chain against each filter alone, and what fails on bad slides and files."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidemill.functions import pixels
from slidemill.operators import levels
from slidemill.plans import builder as b
from slidemill.plans import virtual
from slidemill.sources import annotations

FILTERS = {
    "low_contrast": (lambda: b.low_contrast(0.34), "gray_range"),
    "otsu": (lambda: b.otsu(0.39, num_bins=16), "tissue_fraction"),
    "bright": (lambda: b.otsu(0.4, tissue_is_darker=False, num_bins=64), "tissue_fraction"),
    "pen": (lambda: b.pen(0.14), "pen_fraction"),
    "wide pen": (lambda: b.pen(0.2, diff_thresh=100), "pen_fraction"),
}


@pytest.fixture(scope="module")
def patches(spark, sf):
    return virtual.patches(spark, sf).filter("patch_id < 60").withColumn("wsi_id", F.lit("s")).cache()


def pipeline(patches, *stages):
    p = b.Pipeline(patches.sparkSession, lambda: patches, frozenset(patches.columns), b.Context(0.5, "mpp"))
    for s in stages:
        p = p.then(s)
    return p


def values(df, column):
    return {r[0]: r[1] for r in df.select("patch_id", column).collect()}


def test_chain_is_each_filter_alone(patches):
    """For every pair in both orders, with a transform between and without: same metrics and drops as alone, and a dry run that agrees."""
    change = b.reinhard((60.0, 5.0, 5.0), (10.0, 4.0, 4.0))
    alone = {k: values(pipeline(patches, f()).dry_run().rows, c) for k, (f, c) in FILTERS.items()}
    after = {k: values(pipeline(patches, change, f()).dry_run().rows, c) for k, (f, c) in FILTERS.items()}
    kept = {k: set(values(pipeline(patches, f()).frame(), c)) for k, (f, c) in FILTERS.items()}
    kept_after = {k: set(values(pipeline(patches, change, f()).frame(), c)) for k, (f, c) in FILTERS.items()}
    for one, two in itertools.permutations(FILTERS, 2):
        for between in ((), (change,)):
            p = pipeline(patches, FILTERS[one][0](), *between, FILTERS[two][0]())
            dry = p.dry_run()
            later, later_kept = (after, kept_after) if between else (alone, kept)
            assert values(dry.rows, dry.knobs[0].column) == alone[one] and values(dry.rows, dry.knobs[1].column) == later[two]
            if (one, two) in (("low_contrast", "otsu"), ("otsu", "bright"), ("pen", "wide pen"), ("wide pen", "low_contrast")):
                assert set(values(p.frame(), "patch_id")) == kept[one] & later_kept[two]


@pytest.mark.parametrize("how", pixels.INTERPOLATIONS)
def test_resize_of_large_windows(how):
    """Against a plain sum over all pixels on a small image; a large one takes seconds at most."""
    image = np.random.default_rng(8).integers(0, 256, (23, 17, 3), dtype=np.uint8)
    for h, w in ((11, 9), (40, 31), (23, 17), (7, 50)):
        got = pixels.resize(image, h, w, how)
        rows, cols = (np.zeros((m, n)) for m, n in ((h, 23), (w, 17)))
        for table, n, m in ((rows, 23, h), (cols, 17, w)):
            at, weight = pixels._taps(n, m, how)
            for i in range(m):
                for k in range(at.shape[1]):
                    table[i, at[i, k]] += weight[i, k]
            assert np.allclose(table.sum(axis=1), 1)
        want = np.clip(np.rint(np.einsum("ab,bcd,ec->aed", rows, image.astype(float), cols)), 0, 255)
        assert np.abs(got.astype(int) - want).max() <= 1
    began = time.time()
    pixels.resize(np.zeros((2048, 2048, 3), np.uint8), 1024, 1024, how)
    assert time.time() - began < 20


def test_unknown_mpp_fails(spark):
    lv = spark.createDataFrame([(0, 0, 1.0, 100, 100, None), (0, 1, 2.0, 50, 50, None)], "slide_ord long, level int, ds double, lw long, lh long, mpp0 double")
    for mode in levels.MODES:
        with pytest.raises(Exception, match="no level for mpp"):
            levels.select_level(lv, 0.5, "mpp", mode).collect()
    assert levels.select_level(lv, 2.0, "downsample").first().level == 1


def test_xml_regions(spark, tmp_path):
    box = lambda x0, y0, x1, y1: f'<A><Annotations><Annotation PartOfGroup="roi" Type="Rectangle"><Coordinates><Coordinate X="{x0}" Y="{y0}"/><Coordinate X="{x1}" Y="{y1}"/></Coordinates></Annotation></Annotations></A>'
    for name, text in (("a b", box(0, 0, 256, 256)), ("c", box(3, 3, 30, 60)), ("far", box(0, 0, 400.5, 10))):
        (tmp_path / f"{name}.xml").write_text(text)
    slides = spark.createDataFrame([("one", 3.0, 1.5, 400, 400), ("two", 2.0, 1.0, 400, 400)], "wsi_id string, downsample double, resample_factor double, w long, h long")
    files = {"one": str(tmp_path / "a b.xml"), "two": str(tmp_path / "c.xml")}
    got = {r.wsi_id: (r.x, r.y, r.w, r.h) for r in annotations.xml_rois(spark, files, slides).collect()}
    assert got == {"one": (0, 0, 170, 170), "two": (3, 3, 27, 57)}
    got = {r.wsi_id: (r.x, r.y, r.w, r.h) for r in annotations.xml_rois(spark, files, slides, annotation_downsample=1.0).collect()}
    assert got == {"one": (0, 0, 85, 85), "two": (1, 1, 13, 28)}
    with pytest.raises(Exception, match="no annotation file for slide two"):
        annotations.xml_rois(spark, {"one": files["one"]}, slides).collect()
    with pytest.raises(Exception, match="region beyond slide two"):
        annotations.xml_rois(spark, files | {"two": str(tmp_path / "far.xml")}, slides).collect()


def test_one_filter_before_and_after_a_transform(patches):
    change = b.reinhard((60.0, 5.0, 5.0), (10.0, 4.0, 4.0))
    p = pipeline(patches, b.otsu(0.45), change, b.otsu(0.5))
    f = [(r.stage, r.n_out) for r in p.dry_run().funnel(by=("wsi_id",)).sort("stage_ord").collect()]
    assert f == [("source", 60), ("otsu", pipeline(patches, b.otsu(0.45)).frame().count()), ("otsu#2", p.frame().count())]
