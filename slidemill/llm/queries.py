"""The thin queries over the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemill.llm import collocations, decontaminate, fingerprints, language, licenses, lm, mixing, neardup, rules, tokens, toxicity, trie, urls
from slidemill.llm.common import table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the list is the URLs of the pages whose id is divisible by 100."""
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, pages.filter(F.col("page_id") % 100 == 0).select("url"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(), budget=512)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights half-way between proportional and even in entropy, no source drawn over four times; as many words as there are."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scores": op5_lm_scores,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_neardup": op7_simhash_neardup,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_url_filter": urls.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_quality_rules": rules.SQL,
    "op13_collocations": collocations.SQL,
}
