"""Pipelines: an immutable list of stages over DataFrames, checked when built, lazy until an action.

A stage is a function of (DataFrame, Context) with the columns it requires and provides. Geometry stages stand
before the pixel read, and Catalyst does the rest.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slidemill.functions import mobilenet
from slidemill.operators import annotate, audit, extract, levels, rois, shards, tiles
from slidemill.operators.audit import Knob
from slidemill.sources.held import hold
from slidemill.sources.sinks import FileSink, write_files
from slidemill.sources.tiff import Slides


@dataclass(frozen=True)
class Context:
    """Settings that stages share; each stage may hand on a changed one."""

    resolution: float = 0.25
    unit: str = "mpp"
    tile_size: int = 0
    stride: int = 0
    on_error: str = "fail"
    #: What reading told of slides that fail, run after run; shared by all pipelines that come of one source.
    failed: list = field(default_factory=list, compare=False)
    #: While a profile is taken: the clock of the stage that runs.
    clock: extract.Clock | None = None


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame, Context], DataFrame]
    requires: frozenset[str] = frozenset()
    provides: frozenset[str] = frozenset()
    drops: frozenset[str] = frozenset()
    knob: Knob | None = None
    context: Callable[[Context], Context] = field(default=lambda c: c)
    encoder: bool = False
    #: If rows stay in their partitions, in order.
    ordered: bool = True


def stage(name: str, run, requires: str = "", provides: str = "", drops: str = "", **more) -> Stage:
    return Stage(name, run, frozenset(requires.split()), frozenset(provides.split()), frozenset(drops.split()), **more)


@dataclass(frozen=True)
class Pipeline:
    """Pipeline.of_slides(spark, paths, ...).then(stage)...; to(sink) closes it."""

    spark: SparkSession
    source: Callable[[], DataFrame]
    columns: frozenset[str]
    context: Context = Context()
    stages: tuple[Stage, ...] = ()
    sink: object | None = None
    failures: Callable[[], DataFrame] | None = None

    def then(self, added: Stage) -> Pipeline:
        if self.sink is not None:
            raise RuntimeError("a pipeline with a sink takes no more stages")
        return replace(self, stages=(*self.stages, added), context=added.context(self.context))

    def to(self, sink: object) -> Pipeline:
        if self.sink is not None:
            raise RuntimeError("the pipeline has a sink already")
        return replace(self, sink=sink)

    def check(self) -> None:
        """All missing columns of all stages in one error."""
        have, wrong = set(self.columns), []
        for s in self.stages:
            if missing := sorted(s.requires - have):
                wrong.append(f"{s.name} needs {missing}")
            have = (have | s.requires | s.provides) - s.drops
        if wrong:
            raise TypeError("; ".join(wrong))

    def frame(self, stages: tuple[Stage, ...] | None = None) -> DataFrame:
        """The lazy plan of the stages."""
        self.check()
        df = self.source()
        for s in self.stages if stages is None else stages:
            df = s.run(df, self.context)
        return df

    def stream(self, batch_size: int = 200, layout: str = "NCHW", dtype: str = "uint8") -> Iterator[tuple[str, np.ndarray, np.ndarray, list[dict]]]:
        """wsi_id, images, coords and metadata rows in batches of one slide, in order of slide, batch and tile.

        Tiles are dealt out in this order before they are read and partitions are taken one after the other, so nothing is sorted and each
        window is read once. Only after stages that shuffle, or where slides may be skipped, are the patches held and sorted.
        """
        if self.sink is not None:
            raise RuntimeError("a pipeline with a materialising sink is not streamed")
        if layout not in ("NCHW", "NHWC"):
            raise ValueError("layout must be 'NCHW' or 'NHWC'")
        held: list = []
        order = self.frame()
        if self.context.on_error == "skip" or not all(s.ordered for s in self.stages):
            order = hold(order, "stream").orderBy("slide_ord", "batch_ord", "tile_ord")

        def emit(rows):
            px = np.stack([np.frombuffer(r["pixels"], np.uint8).reshape(r["ph"], r["pw"], r["pc"]) for r in rows])
            px = (px.transpose(0, 3, 1, 2) if layout == "NCHW" else px).astype(dtype)
            meta = [{k: v for k, v in r.asDict().items() if k != "pixels"} for r in rows]
            return rows[0]["wsi_id"], px, np.array([(r["x"], r["y"]) for r in rows], np.int64), meta

        for r in order.toLocalIterator(prefetchPartitions=True):
            if held and (len(held) == batch_size or held[0]["slide_ord"] != r["slide_ord"]):
                yield emit(held)
                held = []
            held.append(r)
        if held:
            yield emit(held)

    def materialize(self, frame: DataFrame | None = None) -> DataFrame:
        """Run into the sink: what it wrote. A sink is a function of a DataFrame; one with open() and close() is opened before, and closed after, also where the run fails."""
        if self.sink is None:
            raise RuntimeError("materialize needs a sink; use stream")
        frame = self.frame() if frame is None else frame
        getattr(self.sink, "open", lambda: None)()
        try:
            return self.sink(frame)
        finally:
            getattr(self.sink, "close", lambda: None)()

    def failed_slides(self) -> DataFrame:
        """slide_ord, wsi_path, error of the slides that on_error skip leaves out: files that cannot be opened, end too early, have no fitting level or, once a run has read them, a block that can't be decoded. Without a run, the slides are read now."""
        if self.failures is None:
            raise RuntimeError("the source reports no failures")
        if not self.context.failed and any("pixels" in s.provides for s in self.stages):
            self.frame()
        told = self.failures()
        return told.unionByName(self.context.failed[-1]) if self.context.failed else told

    def profile(self) -> DataFrame:
        """One run of all stages and the sink, without keeping what it gives: ord, stage, n (rows that the stage handed on), wall_s.

        Rows are counted where they pass, by observations, so nothing runs twice. wall_s of a stage is the time that Python workers
        spent in it, summed over tasks; null for stages that Spark fuses into others. That of the row `run` is the whole run's.
        """
        return self._profiled()[0]

    def profile_messages(self) -> DataFrame:
        """One run as profile() takes it, told by slide: slide_id, ord, stage, wall_s, n (rows that came to the stage), as profile.by_stage and profile.by_slide take them. Stages whose work is Python's have messages; one row for each slide and stage comes to the driver."""
        return self._profiled()[1]

    def _profiled(self) -> tuple[DataFrame, DataFrame]:
        total = self.spark.sparkContext.accumulator({}, extract.Timings())
        seen, df = [], self.source()
        self.check()
        start = time.monotonic()
        for i, s in enumerate(self.stages):
            o = Observation(f"{i}-{s.name}")
            df = s.run(df, replace(self.context, clock=extract.Clock(total, i, s.name))).observe(o, F.count(F.lit(1)).alias("n"))
            seen.append((i, s.name, o))
        if self.sink is None:
            df.write.format("noop").mode("overwrite").save()
        else:
            self.materialize(df).write.format("noop").mode("overwrite").save()
        took, spent = time.monotonic() - start, total.value
        of = lambda i: [s for (k, _, _), (s, _) in spent.items() if k == i]
        rows = [(i, name, int(o.get["n"]), sum(of(i)) if of(i) else None) for i, name, o in seen]
        stages = self.spark.createDataFrame([*rows, (len(rows), "run", rows[-1][2] if rows else 0, took)], "ord int, stage string, n long, wall_s double")
        return stages, self.spark.createDataFrame([(slide, i, name, s, n) for (i, name, slide), (s, n) in sorted(spent.items())], "slide_id long, ord int, stage string, wall_s double, n long")

    def knobs(self) -> list[Knob]:
        return [s.knob for s in self.stages if s.knob is not None]

    def dry_run(self) -> Audit:
        """Measure all patches with every filter open, without sink and encoders: any thresholds can then be tried on the result.

        Each filter measures with its own settings and at its own place, as in an honest run. A metric that a later filter measures anew
        is kept for the earlier one under a name of its own, metric@place.
        """
        open_, knobs, segments, segment = [], [], [], 0
        places = [s for s in self.stages if not s.encoder]
        for i, s in enumerate(places):
            if s.knob is None:
                open_.append(s)
                segment += 1
                continue
            again = any(t.knob is not None and t.knob.column == s.knob.column for t in places[i + 1 :])
            name = f"{s.knob.column}@{i}" if again else s.knob.column
            run = lambda df, c, s=s, name=name: (lambda d: d.withColumn(name, F.col(s.knob.column)) if name != s.knob.column else d)(s.run.measure(df, c))
            open_.append(replace(s, run=run))
            knobs.append(replace(s.knob, column=name))
            segments.append(segment)
        return Audit(self.frame(tuple(open_)).drop("pixels").persist(), knobs, segments)


@dataclass
class Audit:
    """Metrics of all candidates, and what the knobs make of them."""

    rows: DataFrame
    knobs: list[Knob]
    segments: list[int] = field(default_factory=list)

    def close(self) -> None:
        """Give the held rows back."""
        self.rows.unpersist()

    def resolved(self, values: dict[str, float] | None = None, order=None, off=()) -> DataFrame:
        return audit.resolve(self.rows, audit.tuned(self.knobs, values, order, off))

    def funnel(self, values: dict[str, float] | None = None, order=None, off=(), by=("slide_ord", "wsi_id")) -> DataFrame:
        return audit.funnel(self.rows, audit.tuned(self.knobs, values, order, off), by)


class Filter:
    """A metric, measured with this filter's settings on the pixels as they are here, and its test; measure() leaves the test out."""

    def __init__(self, knob: Knob, metric: Callable[[DataFrame, Context], DataFrame]):
        self.knob, self.measure = knob, metric

    def __call__(self, df: DataFrame, c: Context) -> DataFrame:
        return self.measure(df, c).filter(~self.knob.fails())


def of_slides(spark: SparkSession, paths: list[str], resolution: float = 0.25, unit: str = "mpp", mode: str = "nearest", max_relative_deviation: float | None = 0.05, on_error: str = "fail") -> Pipeline:
    """A source with a row for each path: slide_ord, wsi_id, wsi_path, level, downsample, resample_factor, w, h, level_ds. A path that stands twice is two slides; no paths give no rows.

    on_error skip: slides whose file cannot be opened, ends too early or has no fitting level are left out, and failed_slides() tells of them.
    """

    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")

    def headers(**options: str) -> DataFrame:
        spark.dataSource.register(Slides)
        return spark.read.format("slides").options(paths="\n".join(paths), on_error=on_error, **options).load()

    def failures() -> DataFrame:
        lv = headers()
        fit = levels.select_level(lv, resolution, unit, mode, max_relative_deviation, "skip")
        unfit = lv.select("slide_ord", "wsi_path").distinct().join(fit, "slide_ord", "left_anti").withColumn("error", F.lit(f"no level for {unit} {resolution} by {mode}"))
        return headers(report="failures").unionByName(unfit)

    def source() -> DataFrame:
        lv = hold(headers(), "headers")  # each is opened once
        chosen = levels.select_level(lv, resolution, unit, mode, max_relative_deviation, on_error)
        return chosen.join(lv.select("slide_ord", "wsi_id", "wsi_path", "level", F.col("ds").alias("level_ds")), ["slide_ord", "level"])

    return Pipeline(spark, source, frozenset("slide_ord wsi_id wsi_path level downsample resample_factor w h level_ds".split()), Context(resolution, unit, on_error=on_error), failures=failures)


def attach(providers: list[Callable[[DataFrame], DataFrame]], on_empty: str = "error") -> Stage:
    """Regions of all providers, functions from slides to boxes(slide_ord, sw, sh, ord, x, y, w, h)."""

    def run(df: DataFrame, c: Context) -> DataFrame:
        boxes = rois.attach_rois(df, [p(df) for p in providers], on_empty)
        return boxes.join(df.drop("w", "h"), "slide_ord")

    return stage("attach_rois", run, "slide_ord wsi_id w h", "roi_index x y sw sh")


def extract_patches(tile_size: int, stride: int | None = None, mode: str = "any_overlap", max_window_size: int | None = None, batch_size: int = 200, wsi_edge_policy: str = "drop", roi_edge_policy: str = "clip", interpolation: str = "lanczos", min_edge_distance: int = 0, accept: Callable[[Column, Column], Column] | None = None, carry: Sequence[str] = (), partitions: int | None = None) -> Stage:
    """Plan tiles (accept and carry are plan_tiles'), group them by read window and cut patches. min_edge_distance drops tiles near the slide's edge before anything is read. partitions: how many tasks read.

    Where the source's on_error is skip, a slide with a window that can't be read gives no patches at all; failed_slides() tells of it.
    """
    stride = tile_size if stride is None else stride
    if roi_edge_policy not in tiles.ROI_EDGES:
        raise ValueError(f"unknown region edge policy {roi_edge_policy!r}; one of {tiles.ROI_EDGES}")

    def run(df: DataFrame, c: Context) -> DataFrame:
        if "roi_index" not in df.columns:
            df = df.withColumns({"sw": F.col("w"), "sh": F.col("h"), "x": F.lit(0).cast("long"), "y": F.lit(0).cast("long"), "roi_index": F.lit(0).cast("long")})
        t = tiles.plan_tiles(df, tile_size, stride, mode, accept, carry)
        if min_edge_distance:
            t = tiles.remove_edge_tiles(t, tile_size, min_edge_distance).drop("edge_distance")
        t = tiles.with_windows(t, tile_size, stride, max_window_size)
        if roi_edge_policy == "read_from_image":
            t = tiles.grown(t, tile_size)
        t = tiles.with_batches(tiles.with_padding(t, tile_size, wsi_edge_policy), batch_size)
        info = df.select("slide_ord", "wsi_id", "wsi_path", "level", "level_ds", "downsample", "resample_factor").distinct()
        cut = extract.cut_patches(tiles.level0_origin(t.join(info, "slide_ord")), tile_size, wsi_edge_policy, interpolation, c.on_error, partitions, c.clock)
        if c.on_error == "skip":
            cut, failed = extract.without_failed(cut)
            c.failed.append(failed)
        return cut

    return stage("extract_patches", run, "slide_ord wsi_id wsi_path level downsample resample_factor level_ds", "pixels ph pw pc x y tile_ord batch_ord sw sh", context=lambda c: replace(c, tile_size=tile_size, stride=stride))


def keep(name: str, column: str, op: str, value: float, measure: Callable[[DataFrame, Context], DataFrame] | None = None, requires: str = "", **settings) -> Stage:
    """A filter of one's own: measure adds the column (default: it is there), the knob's test says which rows stay. Audits and reports treat it as any other; settings are Knob's."""
    knob = Knob(name, column, op, value, **settings)
    return stage(name, Filter(knob, measure or (lambda df, c: df)), requires if measure else f"{requires} {column}", column, knob=knob)


def low_contrast(range_threshold: float = 0.2, precision: str = "float32") -> Stage:
    knob = Knob("low_contrast", "gray_range", ">=", range_threshold)
    return stage("low_contrast", Filter(knob, lambda df, c: extract.measure(df, precision=precision, only=("contrast",), clock=c.clock)), "pixels", "gray_min gray_max gray_range", knob=knob)


def otsu(min_tissue_fraction: float = 0.0, tissue_is_darker: bool = True, num_bins: int = 256, precision: str = "float32") -> Stage:
    knob = Knob("otsu", "tissue_fraction", ">=", min_tissue_fraction)
    return stage("otsu", Filter(knob, lambda df, c: extract.measure(df, num_bins, tissue_is_darker, precision=precision, only=("otsu",), clock=c.clock)), "pixels", "otsu_threshold tissue_fraction tissue_pixel_count", knob=knob)


def pen(max_pen_fraction: float = 0.01, diff_thresh: float = 5.0) -> Stage:
    knob = Knob("pen", "pen_fraction", "<=", max_pen_fraction, permissive=1.0)
    return stage("pen", Filter(knob, lambda df, c: extract.measure(df, diff_thresh=diff_thresh, only=("pen",), clock=c.clock)), "pixels", "pen_fraction pen_pixel_count", knob=knob)


def edge(depth: int = 1) -> Stage:
    if depth < 0:
        raise ValueError("depth must not be negative")
    knob = Knob("edge", "edge_distance", ">=", depth, integer=True)
    return stage("edge", Filter(knob, lambda df, c: tiles.with_edge_distance(df, c.tile_size)), "x y sw sh", "edge_distance", knob=knob)


def tissue_classifier(weights: str, keep: int = 0, classes: int = 4) -> Stage:
    """Keeps patches whose likeliest class is `keep` by the small mobile network with the weights of an .npz file, which each worker loads once; adds probs, rounded to two places. Patches under 32 pixels are let through to it, with a warning."""

    def run(df: DataFrame, c: Context) -> DataFrame:
        if 0 < c.tile_size < 32:
            warnings.warn("the tissue network was not trained on patches under 32 pixels", stacklevel=2)
        return extract.classify(df, lambda: mobilenet.load(weights), classes, keep)

    return stage("tissue_classifier", run, "pixels", "probs")


def reinhard(mean, std, modified: bool = False) -> Stage:
    return stage("reinhard", lambda df, c: extract.reinhard(df, mean, std, modified, c.clock), "pixels")


def macenko(**settings) -> Stage:
    return stage("macenko", lambda df, c: extract.macenko(df, clock=c.clock, **settings), "pixels batch_ord", ordered=False)


def cell_points(points: DataFrame, column: str = "annotations", filter_empty: bool = False) -> Stage:
    """points(slide_ord, px, py, label) in patch pixels."""
    return stage("cell_points", lambda df, c: annotate.annotate_points(df, points, c.tile_size, column, filter_empty), "slide_ord roi_index x y", column, ordered=False)


def cell_features(features: DataFrame, property_keys: Sequence[str] | None = None, geometry: bool = False, geometry_key: str = "geometry", column: str = "annotations", filter_empty: bool = False) -> Stage:
    """features as sources.annotations.geojson_cells gives them."""
    return stage("cell_features", lambda df, c: annotate.annotate_features(df, features, c.tile_size, property_keys, geometry, geometry_key, column, filter_empty), "slide_ord roi_index x y", column, ordered=False)


def png_encoder(compress_level: int = 1) -> Stage:
    return stage("png", lambda df, c: extract.encode_png(df, compress_level, c.clock), "pixels", "encoded encoding", "pixels", encoder=True)


@dataclass(frozen=True)
class TarShards:
    """A sink of shards of shard_size samples in seeded order."""

    outdir: str
    shard_size: int = 200
    seed: int = 0
    overwrite: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        meta = [c for c in df.columns if c not in ("encoded", "encoding", "pixels")]
        rows = df.select(shards.sample_key(F.col("wsi_id"), F.col("x"), F.col("y")).alias("key"), F.col("slide_ord").alias("ord"), F.col("roi_index").alias("roi"), "encoded", F.to_json(F.struct(*meta)).alias("meta"))
        rows = hold(rows, "samples")  # pixels are read and encoded once; counts and order take the keys only
        order = [F.xxhash64("key", "ord", "roi", F.lit(self.seed)), F.col("ord"), F.col("roi")]
        return shards.write_tars(shards.assign_shards(rows, self.shard_size, order), self.outdir, self.overwrite)


@dataclass(frozen=True)
class Files:
    """A sink of one's own files: FileSink says what tasks write of the frame's rows, facts the schema of what it tells of each file. Staged, committed and taken back as tar shards are; by: columns whose rows of one value must be one task's, in order of `order`."""

    sink: FileSink
    outdir: str
    facts: str
    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    overwrite: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        df = df.repartition(*self.by).sortWithinPartitions(*self.by, *self.order) if self.by else df
        return write_files(df, self.sink, self.outdir, self.facts, self.overwrite)


@dataclass(frozen=True)
class CsvTable:
    """A sink of CSV files: all columns but pixels and encoded images; arrays, structs and maps as JSON."""

    outdir: str

    def __call__(self, df: DataFrame) -> DataFrame:
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema.fields if f.dataType.typeName() != "binary"]
        df.select(*flat).write.csv(self.outdir, header=True)
        return df.sparkSession.read.csv(self.outdir, header=True)
