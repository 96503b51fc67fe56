"""Patch metrics as plain expressions over exploded pixels(patch_id, ..., r, g, b), and the filters on them.

Each filter is a metric for all patches and a test on it, kept apart so that an audit can move the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidemill.functions import pen

#: Luma weights of red, green and blue.
LUMA = (0.2125, 0.7154, 0.0721)


def gray() -> Column:
    return sum((F.col(c) / F.lit(255.0) * w for c, w in zip("rgb", LUMA, strict=True)), F.lit(0.0))


def gray_stats(px: DataFrame) -> DataFrame:
    g = px.groupBy("patch_id").agg(F.min(gray()).alias("gray_min"), F.max(gray()).alias("gray_max"))
    return g.withColumn("gray_range", F.col("gray_max") - F.col("gray_min"))


def low_contrast_filter(px: DataFrame, range_threshold: float = 0.2) -> DataFrame:
    if not 0 <= range_threshold <= 1:
        raise ValueError("range_threshold must be from 0 to 1")
    return gray_stats(px).filter(F.col("gray_range") >= range_threshold)


def pen_pixel(diff_thresh: float = 5.0) -> Column:
    """If a pixel is a pen mark's: it passes not all three colour modes and is not near black."""

    def passes(mode: str) -> Column:
        tests = [[(F.col(c) > v) if up else (F.col(c) < v) for c, v, up in zip("rgb", triple, pen.ABOVE[mode], strict=True)] for triple in pen.MODES[mode]]
        return reduce(Column.__and__, [reduce(Column.__or__, t) for t in tests])

    all_pass = passes("red") & passes("green") & passes("blue")
    return ~all_pass & ~((F.col("r") + F.col("g") + F.col("b")) < 3 * diff_thresh)


def pen_stats(px: DataFrame, diff_thresh: float = 5.0) -> DataFrame:
    n = px.groupBy("patch_id").agg(F.count_if(pen_pixel(diff_thresh)).alias("pen_pixel_count"), F.count("*").alias("n"))
    return n.select("patch_id", "pen_pixel_count", (F.col("pen_pixel_count") / F.col("n")).alias("pen_fraction"))


def pen_filter(px: DataFrame, diff_thresh: float = 5.0, max_pen_fraction: float = 0.01) -> DataFrame:
    return pen_stats(px, diff_thresh).filter(F.col("pen_fraction") <= max_pen_fraction)


def otsu_thresholds(px: DataFrame, num_bins: int = 256) -> DataFrame:
    """patch_id, otsu_threshold: gray values are spread over bins between their extremes and split where the shifted between-class variance is largest.

    For a split after bin k the second class starts at bin k + 2. Ties go to the first bin; a patch of one
    gray value has that as its threshold.
    """
    g = px.select("patch_id", gray().alias("gray"))
    e = g.groupBy("patch_id").agg(F.min("gray").alias("lo"), F.max("gray").alias("hi"), F.count("*").alias("n"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    u = F.least(F.greatest((F.col("gray") - F.col("lo")) / span, F.lit(0.0)), F.lit(1.0))
    b = F.least(F.greatest(F.floor(u * num_bins - 1e-7), F.lit(0)), F.lit(num_bins - 1))
    h = g.join(e, "patch_id").groupBy("patch_id", b.alias("bin")).agg(F.count("*").alias("h"))
    grid = e.select("patch_id", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_bins - 1).cast("long"))).alias("bin"))
    full = grid.join(h, ["patch_id", "bin"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
    full = full.withColumn("hc", F.col("h") * ((F.col("bin") + 0.5) / num_bins))
    own = Window.partitionBy("patch_id")
    run = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"w1": F.sum("h").over(run), "s1": F.sum("hc").over(run), "tot": F.sum("h").over(own), "all": F.sum("hc").over(own)})
    full = full.withColumns({"w2": F.col("tot") - F.col("w1"), "s2": F.col("all") - F.col("s1")})
    mean = lambda s, w: F.when(F.col(w) == 0, 0.0).otherwise(F.col(s) / F.greatest(F.col(w), F.lit(1)))
    full = full.withColumns({"m1": mean("s1", "w1"), "m2": mean("s2", "w2")})
    after = own.orderBy("bin")
    full = full.withColumns({"w2n": F.lead("w2").over(after), "m2n": F.lead("m2").over(after)}).filter(F.col("bin") < num_bins - 1)
    score = F.round(F.col("w1") * F.col("w2n") * F.pow(F.col("m1") - F.col("m2n"), 2), 9)
    best = full.groupBy("patch_id").agg(F.max_by("bin", F.struct(score, -F.col("bin"))).alias("k"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    thr = F.when(F.col("hi") <= F.col("lo"), F.col("lo")).otherwise(F.col("lo") + (F.col("k") + 0.5) / num_bins * F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)))
    return best.select("patch_id", thr.alias("otsu_threshold"))


def otsu_stats(px: DataFrame, num_bins: int = 256, tissue_is_darker: bool = True) -> DataFrame:
    j = px.select("patch_id", gray().alias("gray")).join(otsu_thresholds(px, num_bins), "patch_id")
    tissue = F.col("gray") < F.col("otsu_threshold") if tissue_is_darker else F.col("gray") >= F.col("otsu_threshold")
    n = j.groupBy("patch_id", "otsu_threshold").agg(F.count_if(tissue).alias("tissue_pixel_count"), F.count("*").alias("n"))
    return n.select("patch_id", "otsu_threshold", (F.col("tissue_pixel_count") / F.col("n")).alias("tissue_fraction"), "tissue_pixel_count")


def otsu_filter(px: DataFrame, num_bins: int = 256, tissue_is_darker: bool = True, min_tissue_fraction: float = 0.0) -> DataFrame:
    out = otsu_stats(px, num_bins, tissue_is_darker)
    return out.filter(F.col("tissue_fraction") >= min_tissue_fraction) if min_tissue_fraction else out


def lab_columns() -> dict[str, Column]:
    """Columns L, A, B of the row's r, g, b: sRGB to CIELAB under D65."""
    lin = {c: F.when(F.col(c) / 255.0 > 0.04045, F.pow((F.col(c) / 255.0 + 0.055) / 1.055, 2.4)).otherwise(F.col(c) / 255.0 / 12.92) for c in "rgb"}
    from slidemill.functions.colour import RGB_TO_XYZ, WHITE

    xyz = [sum((lin[c] * m for c, m in zip("rgb", row, strict=True)), F.lit(0.0)) / w for row, w in zip(RGB_TO_XYZ, WHITE, strict=True)]
    f = [F.when(v > 0.008856, F.pow(v, 1 / 3.0)).otherwise(7.787 * v + 4.0 / 29.0) for v in xyz]
    return {"L": 116.0 * f[1] - 16.0, "A": 500.0 * (f[0] - f[1]), "B": 200.0 * (f[1] - f[2])}


def lab_stats(px: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each Lab channel of a patch."""
    lab = px.select("patch_id", *[v.alias(k) for k, v in lab_columns().items()])
    return lab.groupBy("patch_id").agg(*[f(k).alias(f"{n}_{k.lower()}") for k in "LAB" for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def optical_density_stats(px: DataFrame, beta: float = 0.15, light: float = 255.0) -> DataFrame:
    """Pixels whose optical density has a norm of at least beta, and the mean density of each channel."""
    od = {c: -F.ln(F.greatest(F.lit(1.0), F.least(F.col(c).cast("double"), F.lit(light))) / light) for c in "rgb"}
    rows = px.select("patch_id", *[v.alias(f"od_{c}") for c, v in od.items()])
    keep = F.sqrt(sum((F.pow(F.col(f"od_{c}"), 2) for c in "rgb"), F.lit(0.0))) >= beta
    return rows.groupBy("patch_id").agg(F.count_if(keep).alias("n_stained"), *[F.avg(f"od_{c}").alias(f"od_{c}") for c in "rgb"])
