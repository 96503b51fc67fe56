"""Slides that arrive in a folder, as a stream: headers are read as files appear, and geometry stages follow as they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemill.sources.tiff import header_rows

FILE = "path string, modificationTime timestamp, length long, content binary"
LEVELS = "wsi_id string, wsi_path string, level int, lw long, lh long, ds double, mpp0 double"


def watch(spark: SparkSession, folder: str, pattern: str = "*.tif*", max_files: int = 100) -> DataFrame:
    """A streaming DataFrame with a row for each level of each new file. Only headers are read: the files' contents are not selected."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LEVELS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                rows = [r[1:] for r in header_rows(0, path)]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path").mapInPandas(headers, LEVELS)


def catalogue(levels: DataFrame, out: str, checkpoint: str):
    """Append the levels of new slides to a Parquet table once each; gives the running query."""
    return levels.withColumn("seen_at", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
