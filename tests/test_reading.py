"""What is read, how often, and what a run leaves where it fails."""

import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidemill.operators import extract, profile
from slidemill.plans import builder
from slidemill.sources import shards, sinks, tiff


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(3).integers(0, 256, (260, 330, 3), dtype=np.uint8)


@pytest.fixture(scope="module")
def slides(tmp_path_factory, image):
    """Three slides; the second has a damaged block inside."""
    out = []
    for k in range(3):
        at = str(tmp_path_factory.mktemp("r") / f"s{k}.tiff")
        tiff.write_pyramid(at, [image], tile=64, mpp=0.5)
        if k == 1:
            with open(at, "rb") as f:
                data, level = bytearray(f.read()), tiff.levels_of(f)[0]
            data[level.offsets[9] + 20 : level.offsets[9] + level.sizes[9]] = os.urandom(level.sizes[9] - 20)
            with open(at, "wb") as f:
                f.write(data)
        out.append(at)
    return out


@pytest.fixture
def reads(tmp_path, monkeypatch):
    """How many windows have been read, by any worker."""
    log, plain = str(tmp_path / "reads"), tiff.read_window

    def counted(*a):
        with open(log, "a") as f:
            f.write(".")
        return plain(*a)

    monkeypatch.setattr(extract, "read_window", counted)
    return lambda: os.path.getsize(log) if os.path.exists(log) else 0


def of(spark, paths, **more):
    return builder.of_slides(spark, paths, 1.0, "downsample", **more).then(builder.extract_patches(50, max_window_size=100))


WINDOWS = 9  # of a slide; those at its ends without a whole tile are never read


def test_stream_is_in_order_and_reads_once(spark, slides, reads):
    """Windows by region and place, slide after slide, each read once, without a sort."""
    got = [(m["slide_ord"], m["batch_ord"], m["tile_ord"]) for _, _, _, meta in of(spark, [slides[0], slides[2], slides[0]]).stream(batch_size=7) for m in meta]
    assert got == sorted(got) and len(got) == 3 * 30 and reads() == 3 * WINDOWS
    plan = of(spark, slides[:1]).frame()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(slide_ord" in plan and plan.rfind("Sort [") > plan.find("MapInPandas")


def test_streams_after_shuffles(spark, slides, reads, image):
    p = of(spark, [slides[0], slides[2]]).then(builder.macenko(beta=0.05))
    got = [(m["slide_ord"], m["batch_ord"], m["tile_ord"]) for _, _, _, meta in p.stream() for m in meta]
    assert got == sorted(got) and len(got) == 60 and reads() == 2 * WINDOWS


def test_tars_read_once(spark, slides, reads, tmp_path):
    p = of(spark, [slides[0], slides[2]]).then(builder.png_encoder()).to(builder.TarShards(str(tmp_path / "t"), 25))
    assert sorted(tuple(r) for r in p.materialize().collect()) == [(0, 25), (1, 25), (2, 10)] and reads() == 2 * WINDOWS


def test_a_damaged_block_takes_its_slide(spark, slides, reads):
    p = of(spark, slides, on_error="skip")
    rows = p.frame()
    n = reads()
    assert {r.slide_ord: r["count"] for r in rows.groupBy("slide_ord").count().collect()} == {0: 30, 2: 30}
    assert 2 * WINDOWS < n <= 3 * WINDOWS and reads() == n
    told = p.failed_slides().collect()
    assert [(r.slide_ord, r.wsi_path) for r in told] == [(1, slides[1])] and "block 9" in told[0].error
    fresh = of(spark, [*slides, "/nowhere/x.tiff"], on_error="skip")
    assert {r.slide_ord for r in fresh.failed_slides().collect()} == {1, 3}
    got = [(m["slide_ord"], m["batch_ord"], m["tile_ord"]) for _, _, _, meta in fresh.stream() for m in meta]
    assert got == sorted(got) and {g[0] for g in got} == {0, 2}
    with pytest.raises(Exception, match=r"s1\.tiff.*block 9"):
        of(spark, slides).frame().count()
    assert of(spark, [slides[0]], on_error="skip").failed_slides().collect() == []


def test_times_of_pixel_stages(spark, slides):
    p = of(spark, [slides[0], slides[2]]).then(builder.low_contrast(0.1)).then(builder.keep("left", "x", "<", 200)).then(builder.reinhard((60.0, 5.0, 5.0), (10.0, 4.0, 4.0))).then(builder.png_encoder())
    rows = {r.stage: r for r in p.profile().collect()}
    assert all(rows[k].wall_s > 0 for k in ("extract_patches", "low_contrast", "reinhard", "png", "run")) and rows["left"].wall_s is None
    messages = p.profile_messages()
    assert {(r.slide_id, r.stage): r.n for r in messages.collect() if r.stage in ("extract_patches", "png")} == {(s, k): n for s in (0, 1) for k, n in (("extract_patches", 30), ("png", 20))}
    by = {r.stage: r for r in profile.by_stage(messages).collect()}
    assert by["png"].n == 40 and by["png"].avg_ms > 0 and profile.by_slide(messages).count() == 8


ROWS = "shard_id long, idx long, key string, encoded binary, meta string"


def samples(spark, n=40, each=10):
    return spark.createDataFrame([(i // each, i, f"{'ab'[i % 2]}_{i}", bytes([i]) * (i + 1), json.dumps({"i": i})) for i in range(n)], ROWS).repartition(4)


def listed(at):
    return sorted(f for f in os.listdir(at)) if os.path.isdir(at) else []


def test_commit_abort_and_retry(spark, tmp_path):
    from slidemill.operators.shards import write_tars

    at = str(tmp_path / "out")
    assert sorted(tuple(r) for r in write_tars(samples(spark), at).collect()) == [(i, 10) for i in range(4)]
    assert listed(at) == ["files.json", *(f"shard-{i:06d}.tar" for i in range(4))]
    with tarfile.open(f"{at}/shard-000002.tar") as tar:
        assert [m.name for m in tar] == [f"{'ab'[i % 2]}_{i}.{s}" for i in range(20, 30) for s in ("png", "json")]
    with pytest.raises(Exception, match="already"):
        write_tars(samples(spark), at)
    assert listed(at)[0] == "files.json" and len(listed(at)) == 5
    assert write_tars(samples(spark, 20), at, overwrite=True).count() == 2 and len(listed(at)) == 3

    class Breaks(sinks.TarSink):
        def write(self, rows, create):
            for facts in super().write(rows, create):
                yield facts
                if facts["shard_id"] == 3:
                    raise OSError("disk full")

    bad = str(tmp_path / "bad")
    with pytest.raises(Exception, match="disk full"):
        sinks.write_files(samples(spark).repartition("shard_id").sortWithinPartitions("shard_id", "idx"), Breaks(), bad, "shard_id long, n long")
    assert listed(bad) == []

    writer = sinks.StagedWriter(sinks.TarSink(), str(tmp_path / "again"), False)
    rows = samples(spark, 10).sort("idx").collect()
    writer.write(iter(rows))  # an attempt that was lost after it had written
    writer.commit([writer.write(iter(rows)), None])
    assert listed(str(tmp_path / "again")) == ["files.json", "shard-000000.tar"]
    twice = sinks.StagedWriter(sinks.TarSink(), str(tmp_path / "twice"), False)
    with pytest.raises(ValueError, match="one name"):
        twice.commit([twice.write(iter(rows)), twice.write(iter(rows))])


def test_own_files(spark, slides, tmp_path):
    class Arrays(sinks.FileSink):
        """One .npy file for each slide."""

        def write(self, rows, create):
            import itertools

            for slide, own in itertools.groupby(rows, lambda r: r["slide_ord"]):
                px = np.stack([np.frombuffer(r["pixels"], np.uint8).reshape(r["ph"], r["pw"], 3) for r in own])
                with create(f"slide-{slide}.npy") as f:
                    np.save(f, px)
                yield {"slide": slide, "n": len(px)}

    at = str(tmp_path / "npy")
    p = of(spark, [slides[0], slides[2]]).to(builder.Files(Arrays(), at, "slide int, n int", ("slide_ord",), ("tile_ord",)))
    assert sorted((r.file, r.slide, r.n) for r in p.materialize().collect()) == [("slide-0.npy", 0, 30), ("slide-1.npy", 1, 30)]
    assert np.load(f"{at}/slide-1.npy").shape == (30, 50, 50, 3)


def test_tar_members_are_found_and_skipped(spark, tmp_path):
    """Ranges of a few members each, keys apart in a file, suffixes that lack, long names; only the wanted are in the index."""
    from slidemill.operators.shards import write_tars

    at = str(tmp_path / "t")
    write_tars(samples(spark), at)
    rows = shards.load_shards(spark, at, read=100)
    assert rows.rdd.getNumPartitions() > 8
    assert sorted((r.key, bytes(r.png), r.meta) for r in rows.collect()) == sorted((f"{'ab'[i % 2]}_{i}", bytes([i]) * (i + 1), json.dumps({"i": i})) for i in range(40))
    assert shards.tar_index(spark, at, ["a_1", "b_3"]).filter(~F.col("key").startswith("a_1") & ~F.col("key").startswith("b_3")).count() == 0
    assert {r.key for r in shards.load_shards(spark, at, ["a_1", "b_3"]).collect()} == {"a_10", "a_12", "a_14", "a_16", "a_18", "b_3", "b_31", "b_33", "b_35", "b_37", "b_39"}
    import io

    with tarfile.open(f"{at}/odd.tar", "w") as tar:
        for name, data in (("x" * 150 + ".png", b"1"), ("y.json", b'{"a": 1}'), ("x" * 150 + ".json", b"{}"), ("y.png", b"22"), ("z.png", b"3")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    odd = {r.key: (bytes(r.png), r.meta) for r in shards.load_shards(spark, at, ["x", "y", "z"]).collect()}
    assert odd == {"x" * 150: (b"1", "{}"), "y": (b"22", '{"a": 1}'), "z": (b"3", "{}")}
    with open(f"{at}/odd.tar", "rb+") as f:
        f.truncate(1536)
    with pytest.raises(Exception):
        shards.load_shards(spark, at, ["x"]).collect()


