"""Whole-slide grids of the queries are made by many tasks."""

from pyspark.sql import functions as F

from slidemill import queries


def test_grids_are_made_by_many_tasks(spark, sf):
    made = queries.grid(spark, sf).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(made) > 1 and max(r.n for r in made) < 0.75 * sum(r.n for r in made)
