"""Tables held as Parquet in the folder that all executors share, so that what is dear is worked out once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slidemill-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def hold(df: DataFrame, what: str) -> DataFrame:
    """df as it is now: written to the shared folder and read back. Reads of some columns leave the others on disk."""
    at = f"{shared_dir(df.sparkSession)}/slidemill-held/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(at)
    out._held_at = at
    return out


def let_go(*held: DataFrame) -> None:
    """Delete what hold() wrote; nothing that is still to be worked out may read it."""
    for df in held:
        if at := getattr(df, "_held_at", None):
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
