"""Reading windows, cutting patches, and pixel stages over rows of patches(pixels, ph, pw, pc, ...)."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.functions import colour, pixels, png
from slidemill.sources.files import opened
from slidemill.sources.held import hold
from slidemill.sources.tiff import levels_at, read_window

PATCH = "slide_ord int, wsi_id string, roi_index long, win_key long, tile_ord long, batch_ord long, x long, y long, sw long, sh long, pixels binary, ph int, pw int, pc int"


def images(batch: pd.DataFrame) -> np.ndarray:
    """Pixels of rows of one shape as (n, h, w, c)."""
    h, w, c = (int(batch[k].iloc[0]) for k in ("ph", "pw", "pc"))
    return np.frombuffer(b"".join(batch["pixels"]), np.uint8).reshape(len(batch), h, w, c)


class Clock:
    """Seconds that Python workers spend in a stage, by slide, summed in an accumulator: {(place, stage, slide_ord): (seconds, rows)}. A task that runs again counts again."""

    def __init__(self, total, place: int, stage: str):
        self.total, self.place, self.stage = total, place, stage

    def add(self, slides: pd.Series, seconds: float) -> None:
        """Share the seconds of a batch among its rows."""
        self.total.add({(self.place, self.stage, int(s)): (seconds * int(n) / len(slides), int(n)) for s, n in slides.value_counts().items()})


class Timings(AccumulatorParam):
    """Sums by key: as many keys as there are slides and stages."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        for k, (s, n) in value2.items():
            had = value1.get(k, (0.0, 0))
            value1[k] = (had[0] + s, had[1] + n)
        return value1


def _timed(clock: Clock | None, batches: Iterator[pd.DataFrame], change) -> Iterator[pd.DataFrame]:
    """change of every batch, its time kept by the clock."""
    for batch in batches:
        began = time.perf_counter()
        out = list(change(batch))
        if clock is not None and len(batch):
            clock.add(batch["slide_ord"], time.perf_counter() - began)
        yield from out


WINDOW = ["slide_ord", "roi_index", "win_key"]
KEPT = ["slide_ord", "wsi_id", "roi_index", "win_key", "tile_ord", "batch_ord", "x", "y", "sw", "sh"]


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles of one window after another, of sorted batches; a window may reach across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for key, part in batch.groupby(WINDOW, sort=False):
            if held and tuple(held[0][WINDOW].iloc[0]) != key:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def cut_patches(planned: DataFrame, tile_size: int, policy: str = "drop", interpolation: str = "lanczos", on_error: str = "fail", partitions: int | None = None, clock: Clock | None = None) -> DataFrame:
    """Patches of planned tiles: one read for each window, whatever the number of its tiles.

    planned has tiles with windows, padding, batches, x0, y0, read_w, read_h, and wsi_id, wsi_path, level,
    level_ds (the downsample of the level itself). A window is resampled where its read size differs, and
    tiles that reach beyond it are padded by zeros or by its edge pixels.

    Tiles are dealt out in ranges of (slide, region, window) before anything is read, so patches come in order of slide,
    batch and tile, partition after partition, and no pixels are ever sorted. partitions: how many ranges, by default
    spark.sql.shuffle.partitions; they are not merged by their size, as plans are small and pixels are not.

    on_error skip: a window that can't be read gives one row without pixels, with error and error_path; other rows have nulls there.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        with opened(r["wsi_path"]) as f:
            level = levels_at(r["wsi_path"], f)[int(r["level"])]
            image = read_window(f, level, int(round(r["x0"] / r["level_ds"])), int(round(r["y0"] / r["level_ds"])), int(r["read_w"]), int(r["read_h"]))
        if image.shape[:2] != (r["rh"], r["rw"]):
            image = pixels.resize(image, int(r["rh"]), int(r["rw"]), interpolation)
        out = []
        for x, y in zip(pdf["x"] - r["rx"], pdf["y"] - r["ry"], strict=True):
            part = image[y : y + tile_size, x : x + tile_size]
            lack = ((0, tile_size - part.shape[0]), (0, tile_size - part.shape[1]), (0, 0))
            if lack[0][1] or lack[1][1]:
                part = np.pad(part, lack, mode="edge" if policy == "edge" else "constant")
            out.append(np.ascontiguousarray(part).tobytes())
        return pdf[KEPT].assign(pixels=out, ph=tile_size, pw=tile_size, pc=3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = None
        for pdf in _windows(batches):
            began, slide = time.perf_counter(), int(pdf["slide_ord"].iloc[0])
            if failed == slide:
                continue
            try:
                out = cut(pdf)
                out = out.assign(error=None, error_path=None) if on_error == "skip" else out
            except Exception as e:  # whatever broken bytes lead to
                said = f"{pdf['wsi_path'].iloc[0]}: {e}"
                if on_error != "skip":
                    raise ValueError(said) from e
                failed = slide
                out = pdf[KEPT].head(1).assign(pixels=None, ph=0, pw=0, pc=0, error=said, error_path=pdf["wsi_path"].iloc[0])
            if clock is not None:
                clock.add(pdf["slide_ord"], time.perf_counter() - began)
            yield out

    n = partitions or int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = planned.repartitionByRange(n, *WINDOW).sortWithinPartitions(*WINDOW, "tile_ord")
    return ranged.mapInPandas(run, PATCH + (", error string, error_path string" if on_error == "skip" else ""))


#: Failing slides up to which they are joined by broadcast.
BROADCAST = 100_000


def without_failed(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches of the slides that could be read throughout, slide_ord, wsi_path and error of the others), of what cut_patches gave under on_error skip. Pixels are read once: they are held until all windows of all slides have been tried."""
    held = hold(cut, "patches")
    failed = hold(held.filter("error is not null").groupBy("slide_ord").agg(F.min_by("error_path", "error").alias("wsi_path"), F.min("error").alias("error")), "failed")
    ids = failed.select("slide_ord")
    ids = F.broadcast(ids) if failed.count() <= BROADCAST else ids.hint("merge")
    out = held.filter("error is null").drop("error", "error_path").join(ids, "slide_ord", "left_anti").select(*[c.split()[0] for c in PATCH.split(", ")])
    return out, failed


#: Metrics by what they need of the pixels, with their types.
METRICS = {
    "contrast": "gray_min double, gray_max double, gray_range double",
    "otsu": "otsu_threshold double, tissue_fraction double, tissue_pixel_count long",
    "pen": "pen_fraction double, pen_pixel_count long",
}


def measure(patches: DataFrame, num_bins: int = 256, tissue_is_darker: bool = True, diff_thresh: float = 5.0, precision: str = "float32", only: tuple[str, ...] = tuple(METRICS), clock: Clock | None = None) -> DataFrame:
    """Patches with the columns of METRICS, or of some of them only, in one pass over the pixels; such columns that are there already are replaced."""
    if precision not in ("float32", "float64"):
        raise ValueError("precision must be 'float32' or 'float64'")
    kind = np.dtype(precision).type
    schema = ", ".join(METRICS[k] for k in only)
    names = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def metrics(px: pd.Series, ph: pd.Series, pw: pd.Series, pc: pd.Series, slides: pd.Series) -> pd.DataFrame:
        began = time.perf_counter()
        batch = pd.DataFrame({"pixels": px, "ph": ph, "pw": pw, "pc": pc})
        out = []
        for _, own in batch.groupby(["ph", "pw", "pc"], sort=False):
            p, found = images(own), {}
            if "contrast" in only:
                lo, hi = pixels.gray_stats(p, kind)
                found |= {"gray_min": lo, "gray_max": hi, "gray_range": hi - lo}
            if "otsu" in only:
                found["otsu_threshold"] = pixels.otsu(p, num_bins, kind)
                found["tissue_fraction"], found["tissue_pixel_count"] = pixels.tissue(p, found["otsu_threshold"], tissue_is_darker, kind)
            if "pen" in only:
                found["pen_fraction"], found["pen_pixel_count"] = pixels.pen_fraction(p, diff_thresh)
            out.append(pd.DataFrame(found, index=own.index))
        if clock is not None and len(batch):
            clock.add(slides, time.perf_counter() - began)
        return pd.concat(out).sort_index()[names].astype({c: "int64" for c in names if c.endswith("count")}) if out else pd.DataFrame(columns=names)

    patches = patches.drop(*names)
    return patches.withColumn("m", metrics("pixels", "ph", "pw", "pc", F.col("slide_ord").cast("long") if "slide_ord" in patches.columns else F.lit(0).cast("long"))).select("*", "m.*").drop("m")


def _mapped(patches: DataFrame, change, clock: Clock | None = None) -> DataFrame:
    """Patches with their pixels changed by change(images, rows) batch by batch."""

    def changed(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, own in batch.groupby(["ph", "pw", "pc"], sort=False) if len(batch) else []:
            yield own.assign(pixels=[p.tobytes() for p in change(images(own), own)])

    return patches.mapInPandas(lambda batches: _timed(clock, batches, changed), patches.schema)


def reinhard(patches: DataFrame, mean, std, modified: bool = False, clock: Clock | None = None) -> DataFrame:
    return _mapped(patches, lambda p, _: colour.reinhard(p, mean, std, modified), clock)


def macenko(patches: DataFrame, alpha: float = 1.0, beta: float = 0.15, light: float = 255.0, pixel_limit: int | None = 500_000, clock: Clock | None = None) -> DataFrame:
    """Each slide's first surviving batch fits its stains; all its patches are rebuilt from them.

    The fit takes one batch for each slide, so no task sees a whole slide; fits, 8 numbers each, are joined
    back by slide. What comes before, reads of pixels too, runs once: the patches are held in the shared folder.
    """
    patches = hold(patches, "patches")
    first = patches.groupBy("slide_ord").agg(F.min("batch_ord").alias("batch_ord"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h, top = colour.macenko_fit(images(pdf.sort_values(["roi_index", "tile_ord"])), alpha, beta, light, pixel_limit)
        return pd.DataFrame({"slide_ord": [pdf["slide_ord"].iloc[0]], "fit": [[*h.ravel(), *top]]})

    fits = patches.join(first, ["slide_ord", "batch_ord"]).select("slide_ord", "roi_index", "tile_ord", "pixels", "ph", "pw", "pc").groupBy("slide_ord").applyInPandas(fit, "slide_ord int, fit array<double>")

    def change(p: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        out = np.empty_like(p)
        slides = rows["slide_ord"].to_numpy()
        for s in np.unique(slides):
            f = np.asarray(rows["fit"].iloc[int(np.argmax(slides == s))], np.float64)
            out[slides == s] = colour.macenko_apply(p[slides == s], f[:6].reshape(3, 2), f[6:], light)
        return out

    return _mapped(patches.join(fits, "slide_ord"), change, clock).drop("fit")


def encode_png(patches: DataFrame, compress_level: int = 1, clock: Clock | None = None) -> DataFrame:
    """Patches with encoded, their PNG files, in place of pixels."""

    @F.pandas_udf("binary")
    def encoded(px: pd.Series, ph: pd.Series, pw: pd.Series, pc: pd.Series, slides: pd.Series) -> pd.Series:
        began = time.perf_counter()
        out = pd.Series([png.encode(np.frombuffer(p, np.uint8).reshape(h, w, c), compress_level) for p, h, w, c in zip(px, ph, pw, pc, strict=True)], dtype=object)
        if clock is not None and len(out):
            clock.add(slides, time.perf_counter() - began)
        return out

    slide = F.col("slide_ord").cast("long") if "slide_ord" in patches.columns else F.lit(0).cast("long")
    return patches.withColumns({"encoded": encoded("pixels", "ph", "pw", "pc", slide), "encoding": F.lit("png")}).drop("pixels")


def classify(patches: DataFrame, scorer, classes: int = 4, keep: int = 0) -> DataFrame:
    """Patches whose best class is `keep`, with probs rounded to two places. scorer() loads a model once for each worker and gives a function from (n, h, w, c) uint8 to (n, classes) scores."""

    def load():
        model = scorer()

        def predict(px: np.ndarray, ph: np.ndarray, pw: np.ndarray, pc: np.ndarray) -> np.ndarray:
            rows = pd.DataFrame({"pixels": px, "ph": ph, "pw": pw, "pc": pc})
            return np.asarray(model(images(rows)), np.float32)

        return predict

    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    udf = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=64)
    out = patches.withColumn("probs", udf("pixels", "ph", "pw", "pc"))
    best = F.array_position("probs", F.array_max("probs")) - 1
    return out.withColumn("best", best).filter(F.col("best") == keep).withColumn("probs", F.transform("probs", lambda p: F.bround(p, 2))).drop("best")
