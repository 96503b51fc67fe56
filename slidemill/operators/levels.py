"""Choice of a pyramid level for a requested resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = ("level", "mpp", "downsample")
MODES = ("nearest", "floor", "ceil", "error", "resample")


def select_level(levels: DataFrame, resolution: float, unit: str = "mpp", mode: str = "nearest", max_relative_deviation: float | None = 0.05, on_error: str = "fail") -> DataFrame:
    """slide_ord, level, downsample, resample_factor, w, h of levels(slide_ord, level, ds, lw, lh, mpp0).

    A level's value is its downsample, or that times mpp0. nearest: the closest value, ties to the lowest
    level, checked against max_relative_deviation. floor: the smallest value of at least the request, else
    the last level. ceil and resample: the largest value of at most the request, else level 0; resample then
    changes the dims to round half even of dims / factor, and the downsample by the factor, which may be
    below 1. error: the first level within 1e-6. A slide without a fitting level, or without mpp where unit is mpp, fails the query when read; with on_error skip it has no row.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; one of {UNITS}")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if max_relative_deviation is not None and max_relative_deviation < 0:
        raise ValueError("max_relative_deviation must not be negative")
    if unit == "level":
        if mode == "resample":
            raise ValueError("resample means nothing for unit level")
        if not float(resolution).is_integer() or resolution < 0:
            raise ValueError("a level must be an integer of at least 0")
    want = F.lit(float(resolution))
    value = {"level": F.col("level").cast("double"), "downsample": F.col("ds"), "mpp": F.col("mpp0") * F.col("ds")}[unit]
    rows = levels.withColumns({"value": value, "this": F.struct("level", "ds", "lw", "lh")})
    away = F.abs(F.col("value") - want)
    if unit == "level":
        best = F.min_by(F.when(F.col("value") == want, F.col("this")), F.when(F.col("value") == want, F.col("level")))
    elif mode == "nearest":
        best = F.min_by("this", F.struct(away, "level"))
    elif mode == "floor":
        at = F.when(F.col("value") >= want, F.struct("value", "level"))
        best = F.coalesce(F.min_by("this", at), F.max_by("this", "level"))
    elif mode == "error":
        best = F.min_by("this", F.when(away <= 1e-6 * max(1.0, abs(resolution)), F.col("level")))
    else:
        at = F.when(F.col("value") <= want, F.struct("value", -F.col("level")))
        best = F.coalesce(F.max_by("this", at), F.min_by("this", "level"))
    chosen = rows.groupBy("slide_ord").agg(best.alias("b"), F.max("mpp0").alias("mpp0"), F.bool_or(F.col("value").isNull()).alias("unknown"))
    chosen = chosen.withColumn("value", {"level": F.col("b.level").cast("double"), "downsample": F.col("b.ds"), "mpp": F.col("mpp0") * F.col("b.ds")}[unit])
    none = F.concat(F.lit(f"no level for {unit} {resolution} by {mode} on slide "), F.col("slide_ord").cast("string"))
    bad = F.col("b").isNull() | F.col("unknown")
    if mode == "nearest" and unit != "level" and max_relative_deviation is not None:
        bad = bad | (F.abs(F.col("value") - want) / want > max_relative_deviation)
    if on_error == "skip":
        chosen = chosen.filter(~F.coalesce(bad, F.lit(True)))
    else:
        chosen = chosen.withColumn("b", F.when(bad, F.raise_error(none).cast(chosen.schema["b"].dataType)).otherwise(F.col("b")))
    factor = want / F.col("value") if mode == "resample" else F.lit(1.0)
    out = chosen.withColumn("resample_factor", factor)
    dims = lambda c: F.bround(F.col(c) / F.col("resample_factor"), 0).cast("long") if mode == "resample" else F.col(c).cast("long")
    return out.select("slide_ord", F.col("b.level").cast("int").alias("level"), (F.col("b.ds") * F.col("resample_factor")).alias("downsample"), "resample_factor", dims("b.lw").alias("w"), dims("b.lh").alias("h"))
