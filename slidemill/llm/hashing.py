"""Labelled samples of bounded size, and hashed byte n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quota(sizes: DataFrame, most: int, label: str, max_bytes: int = 60_000_000) -> Column:
    """A condition on doc_id and the label that about `most` rows of sizes(doc_id, label, bytes) pass, as evenly over the labels as their counts allow.

    Which rows is settled by a hash of the id, so it is the same however the rows are partitioned. Fewer
    pass when the mean text is so long that they would exceed max_bytes.
    """
    stats = sizes.groupBy(label).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
    mean = max(1.0, sum(r["b"] or 0 for r in stats) / max(1, sum(r["n"] for r in stats)))
    each = max(1, min(most, int(max_bytes / mean)) // max(1, len(stats)))
    take = F.lit(False)
    for r in stats:
        take = take | ((F.col(label) == r[label]) & (rank() < int((1 << 30) * min(1.0, each / r["n"]))))
    return take


def rank() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))


def bounded_sample(rows: DataFrame, most: int, label: str) -> DataFrame:
    """About `most` of rows(doc_id, text, label), whole texts; never over twice as many, in one partition."""
    take = quota(rows.select("doc_id", label, F.octet_length("text").alias("bytes")), most, label)
    return rows.filter(take).orderBy(rank(), "doc_id", "text").limit(2 * most)


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """fit(sample) worked out in one task; only the model comes to the driver. sample is bounded and in one partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(batches):
            yield pd.DataFrame({"model": [pickle.dumps(fit(pd.concat(parts, ignore_index=True)))]})

    found = sample.mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pd.DataFrame({c: [] for c in sample.columns}))


def grams(data: np.ndarray, sizes: tuple[int, ...], buckets: int) -> list[np.ndarray]:
    """For each size the bucket of the n-gram that starts at each byte of data."""
    out, h = [], np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + wide[n - 1 :] + np.uint64(1) if len(data) >= n else h[:0]
        if n in sizes:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            out.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
    return out
