"""The corpus pipeline: stages over documents, each applied to all that the one before it kept.

Language identification drops what is in no language that it is sure of, the toxicity network what it scores 0.5 or more,
near-duplicate detection all but one document of each group, decontamination what contains a benchmark item;
mixing says how often each remaining document is drawn. Functions take (spark, docs, sf_dir); all but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidemill.llm import decontaminate, language, mixing, nearcopies, toxicity
from slidemill.llm.common import release, settle, settled_so_far, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null or have no letter, and those that the machines are not sure of (language.SURE). Repeated rows are judged alike; null ids and extra columns stay as they are."""
    return language.keep_identified(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts scored 0.5 or more; null and empty texts are scored like any other."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity 0.8 or more by their fingerprints) the row of the smallest doc_id, null last; of equal rows one. Texts without words are one group."""
    return nearcopies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that contain a benchmark item to the threshold; null and empty texts contain none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is drawn, and its block; all rows stay, null sources are one source."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the trained stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written to the shared folder and read again, and what the stage had there goes. What the last stage stands on stays until release()."""
    docs, since = table(spark, sf_dir, "documents"), settled_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name)
            release(spark, since, docs)
    return docs
