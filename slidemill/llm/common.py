"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: How tables of large rows are written. A page has 100 rows at least unless told, and Snappy takes pages whole into memory outside the heap.
LARGE_ROWS = {"parquet.page.row.count.limit": "2", "compression": "zstd"}
#: Folders that settle() has written in this process.
_settled: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under new names: pick(df, doc_id="long", text="string").

    Columns are found by exact name and, of several with that name, the first is taken, so extra columns
    with clashing names (also such that differ in case only) never make a reference ambiguous. A column
    that is missing reads as null.
    """
    bare = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    return bare.select(*[(F.col(f"c{at[k]}") if k in at else F.lit(None)).cast(t).alias(k) for k, t in wanted.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one only where that is unset and the master is local; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slidemill-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def settle(df: DataFrame, what: str, at_once: int | None = None, large: bool = False, by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors. The write's own shuffles are deleted once it ends.

    at_once: rows that Python workers are handed at once on the way: a worker, and its executor besides, holds them all. large: the rows of df are. by: a column that has a folder for each value.
    """
    at = f"{shared_dir(df.sparkSession)}/slidemill/{what}-{uuid.uuid4().hex}"
    _settled.append(at)
    held = {CLEANUP: "true"} | ({AT_ONCE: str(at_once)} if at_once else {})
    before = {k: df.sparkSession.conf.get(k) for k in held}
    for k, v in held.items():
        df.sparkSession.conf.set(k, v)
    try:
        df.write.options(**(LARGE_ROWS if large else {})).parquet(at, partitionBy=by)
    finally:
        for k, v in before.items():
            df.sparkSession.conf.set(k, v)
    out = df.sparkSession.read.schema(nullable(df.schema)).parquet(at)
    out._settled_at = at
    return out


def apart(settled: DataFrame, by: str, values: range) -> list[DataFrame]:
    """What settle(..., by=by) returned as a table for each value that it has, each of which forget() takes on its own."""
    spark, out = settled.sparkSession, []
    for value in values:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{settled._settled_at}/{by}={value}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out.append(spark.read.schema(settled.drop(by).schema).parquet(path.toString()))
            out[-1]._settled_at = path.toString()
            _settled.append(path.toString())
    return out


def forget(*settled: DataFrame) -> None:
    """Delete tables that settle() returned; nothing that is still to be worked out may read them."""
    for df in settled:
        if (at := getattr(df, "_settled_at", None)) in _settled:
            _settled.remove(at)
            _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled_so_far() -> int:
    return len(_settled)


def release(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete what settle() has written, after its first `since` tables, but one; results that still stand on it must have been written or collected before."""
    held = getattr(but, "_settled_at", None)
    for at in _settled[since:]:
        if at != held:
            _settled.remove(at)
            _delete(spark, at)


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives as long as its executor and, left alone, keeps the most it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def few(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A table of few rows of the driver's by Arrow: a list of rows would go by an RDD, whose Python workers come on top of those of SQL."""
    held = rows or [(None,) * len(kinds)]
    out = spark.createDataFrame(pa.table({k: pa.array([r[i] for r in held], t) for i, (k, t) in enumerate(kinds.items())}))
    return out if rows else out.limit(0)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row of df; maps, which have no hash, count by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields])


def arrays(df: DataFrame) -> dict:
    """The columns of df, bounded and without nulls, as numpy arrays on the driver; they come by Arrow, not row by row."""
    found = df.toArrow()
    return {name: found[name].to_numpy() for name in df.columns}


def nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; of a null key that of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def small_enough(df: DataFrame, most: int) -> bool:
    """If df has at most so many rows; reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most
