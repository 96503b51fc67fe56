"""Shards: seeded order, a global index without a single task, and shard numbers; tar files written where the rows are, and put into place together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_key(wsi_id: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", wsi_id, x.cast("string"), y.cast("string"))


#: Rows that a range has about, and ranges at most: what one task puts in order.
RANGE, RANGES = 200_000, 4096


def assign_shards(rows: DataFrame, shard_size: int, order: list, ranges: int | None = None, tie: str = "key") -> DataFrame:
    """rows with idx, the place in the given order, and shard_id = idx div shard_size.

    Rows are cut into ranges of the first order column, as many as their number asks for and at least `ranges`; only the
    ranges' counts are summed along, then each range numbers its own rows, so no task sees them all.
    """
    if shard_size <= 0:
        raise ValueError("shard_size must be positive")
    tagged = rows.withColumn("_first", order[0])
    cuts = _cuts(tagged, ranges)
    tagged = _placed(tagged, cuts)
    sums = tagged.groupBy("_bucket").agg(F.count("*").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("_bucket").orderBy("_first", *order[1:], tie)
    out = tagged.join(F.broadcast(sums.select("_bucket", "before")), "_bucket").withColumn("idx", F.col("before") + F.row_number().over(own) - 1)
    return out.withColumn("shard_id", F.floor(F.col("idx") / shard_size)).drop("_first", "_bucket", "before")


def _placed(tagged: DataFrame, cuts: list) -> DataFrame:
    """tagged with _bucket, the number of cuts at or below the row's first order column: found by halving, a column for each step, so that thousands of cuts make a short expression."""
    out, step = tagged.withColumn("_bucket", F.lit(0)), 1 << len(cuts).bit_length() >> 1
    table = F.array(*[F.lit(c) for c in cuts])
    while step:
        to = F.col("_bucket") + step
        out = out.withColumn("_bucket", F.when(F.col("_first") >= F.get(table, to - 1), to).otherwise(F.col("_bucket")))
        step >>= 1
    return out


def _cuts(tagged: DataFrame, ranges: int | None) -> list:
    """Values of the first order column that part the rows about evenly, from a sample of bounded size."""
    n = tagged.count()
    ranges = max(ranges or 1, min(RANGES, -(-n // RANGE)))
    if ranges == 1:
        return []
    sample = tagged.select("_first").sample(min(1.0, 50 * ranges / max(n, 1)), seed=1).limit(200 * ranges).collect()
    values = sorted(r[0] for r in sample if r[0] is not None)
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []


def write_tars(rows: DataFrame, outdir: str, overwrite: bool = False) -> DataFrame:
    """Write rows(shard_id, idx, key, encoded, meta) as shard-000000.tar and so on under outdir; gives shard_id, n.

    outdir is a path or URI that the driver and all executors share. A shard is one task's, which streams it; shards are
    moved into place when all are written, so a failed write leaves none and a task that runs again no second one.
    """
    from slidemill.sources.sinks import TarSink, write_files

    own = rows.select("shard_id", "idx", "key", "encoded", "meta").repartition("shard_id").sortWithinPartitions("shard_id", "idx")
    return write_files(own, TarSink(), outdir, "shard_id long, n long", overwrite).select("shard_id", "n")


def keep_prefixes(rows: DataFrame, prefixes: list[str], column: str = "key") -> DataFrame:
    """Rows whose key starts with any of the prefixes; no prefixes keep all."""
    if not prefixes:
        return rows
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(column).startswith(p)
    return rows.filter(test)


def may_start(stem: Column, prefixes: list[str]) -> Column:
    """If any key that begins with the stem can start with one of the prefixes: tells of a slide, before its tiles are made, if it is wanted. keep_prefixes then tests the keys."""
    if not prefixes:
        return F.lit(True)
    test = F.lit(False)
    for p in prefixes:
        test = test | F.lit(p).startswith(stem) | stem.startswith(p)
    return test
