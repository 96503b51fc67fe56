"""Tar shards read back as rows: an index of where members lie, and reads of their bytes only."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemill.functions import png
from slidemill.sources.files import opened, store_of
from slidemill.sources.held import hold


#: Bytes of members that a task reads, about.
READ = 64_000_000
INDEX = "path string, shard string, key string, suffix string, at long, size long"


def tar_index(spark: SparkSession, tar_dir: str, prefixes: list[str] | None = None) -> DataFrame:
    """path, shard, key, suffix, at, size of every file member, of the keys wanted, of all *.tar in the folder: where its bytes lie. Only headers are read, file by file, and of other keys nothing else; an error if there is no shard."""
    store, root = store_of(tar_dir)
    from pyarrow import fs

    scheme = tar_dir[: len(tar_dir) - len(root)] if tar_dir.endswith(root) else ""
    paths = sorted(scheme + f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith(".tar"))
    if not paths:
        raise FileNotFoundError(f"no .tar file in {tar_dir}")
    wanted = tuple(prefixes or ("",))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows: list[tuple] = []
                with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    for m in tar:
                        key, _, suffix = m.name.rpartition(".")
                        if m.isfile() and key.startswith(wanted):
                            rows.append((path, path.rsplit("/", 1)[-1], key, suffix, m.offset_data, m.size))
                        tar.members.clear()  # a file of any number of members
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                            rows = []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return listed.mapInPandas(walk, INDEX)


def load_shards(spark: SparkSession, tar_dir: str, prefixes: list[str] | None = None, read: int = READ) -> DataFrame:
    """shard, key, png, meta of all *.tar in the folder whose key starts with any prefix; an error if there is no shard.

    An index of the wanted members is held first; then their bytes are read in ranges of (file, place) of about `read`
    bytes, so that a large file is many tasks and a task holds one sample at a time. A key's members belong together wherever in the file they are; of two of one suffix the last counts.
    """
    index = hold(tar_index(spark, tar_dir, prefixes), "tar-index")
    part = lambda s: F.max_by(F.when(F.col("suffix") == s, F.struct("at", "size")), F.when(F.col("suffix") == s, F.col("at")))
    samples = index.groupBy("path", "shard", "key").agg(F.min("at").alias("first"), part("png").alias("png"), part("json").alias("json"))
    total = index.agg(F.sum("size")).first()[0] or 0
    dealt = samples.repartitionByRange(max(1, -(-total // read)), "path", "first").sortWithinPartitions("path", "first")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, f = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["path"] != held:
                    if f is not None:
                        f.close()
                    held, f = r["path"], opened(r["path"])
                got = [f.read_at(r[s]["size"], r[s]["at"]) if r[s] else None for s in ("png", "json")]
                if any(g is not None and len(g) < r[s]["size"] for g, s in zip(got, ("png", "json"), strict=True)):
                    raise ValueError(f"{held} ends before the last byte of {r['key']}")
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]]), pa.array([r["key"]]), pa.array([got[0]], pa.binary()), pa.array([(got[1] if got[1] is not None else b"{}").decode()])], names=["shard", "key", "png", "meta"])
        if f is not None:
            f.close()

    return dealt.mapInArrow(fetch, "shard string, key string, png binary, meta string")


def batches(rows: DataFrame, batch_size: int = 32, seed: int | None = 0) -> Iterator[tuple[list[str], np.ndarray, list[str]]]:
    """Keys, images as (n, 3, h, w) float32 in 0 to 1 without alpha, and metadata, shuffled by the seed (None: as they lie). Images of a batch must be of one shape."""
    if seed is not None:
        rows = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key")
    held: list = []

    def collate(part):
        images = [png.decode(bytes(r["png"]))[..., :3] for r in part]
        if len({i.shape for i in images}) != 1:
            raise ValueError(f"images of several shapes in one batch: {sorted({i.shape for i in images})}")
        return [r["key"] for r in part], np.stack(images).transpose(0, 3, 1, 2).astype(np.float32) / 255, [r["meta"] for r in part]

    for r in rows.toLocalIterator(prefetchPartitions=True):
        held.append(r)
        if len(held) == batch_size:
            yield collate(held)
            held = []
    if held:
        yield collate(held)
