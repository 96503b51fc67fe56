"""Profiles: wall time and yields of stages, rolled up by stage and by slide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def avg_ms(wall: Column, n: Column) -> Column:
    return F.when(n > 0, wall / n * 1000).otherwise(0.0)


def by_stage(messages: DataFrame) -> DataFrame:
    """stage, wall_s, n, avg_ms summed over messages(slide_id, stage, wall_s, n)."""
    out = messages.groupBy("stage").agg(F.sum("wall_s").alias("wall_s"), F.sum("n").alias("n"))
    return out.withColumn("avg_ms", avg_ms(F.col("wall_s"), F.col("n")))


def by_slide(messages: DataFrame) -> DataFrame:
    """slide_id, stage, wall_s, n, avg_ms of each slide's last message(…, ord)."""
    out = messages.groupBy("slide_id", "stage").agg(F.max_by(F.struct("wall_s", "n"), "ord").alias("m")).select("slide_id", "stage", "m.*")
    return out.withColumn("avg_ms", avg_ms(F.col("wall_s"), F.col("n")))
