"""Quality rules by host: rule failures of documents, summed by host, shrunk towards all hosts by an empirical beta prior, judge the hosts; their verdicts go back to their documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidemill.llm.common import pick, settle, small_enough
from slidemill.llm.naming import meet

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Rejected hosts up to which they are joined by broadcast.
BROADCAST = 100_000


@dataclass(frozen=True)
class Rule:
    """fails says whether a document fails, in SQL over the measures; own: failing it is enough to drop the document itself."""

    name: str
    fails: str
    own: bool = False


#: A document that fails an own rule goes; all rules count towards its host.
RULES = (
    Rule("few_words", "n_words < 50", own=True),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words", own=True),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)"),
)
#: A host is rejected by a rule that, with two standard deviations to spare, over half of its documents fail.
LIMIT, SPARE = 0.5, 2.0


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The MEASURES of one whole text; null is a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, triples, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[triples] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= twice
    return int(hit.sum())


def measures(text: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")

    return measured(text)


def failures(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """host, n, and for each rule how many documents of the host fail it; a null host is a host of its own."""
    return measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.expr(r.fails).cast("long")).alias(r.name) for r in rules])


def priors(hosts: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[str, tuple[float, float]]:
    """(mean, strength) of each rule's beta prior, by moments: the variance between hosts is what their rates vary beyond what chance gives.

    One row of sums over hosts(n, rule...) comes to the driver. Strength is at least 1 and infinite where hosts differ no more than by chance.
    """
    p = lambda r: F.col(r.name) / F.col("n")
    s = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[x for r in rules for x in (F.sum(r.name).alias(r.name), F.sum(F.col(r.name) * p(r)).alias(f"{r.name}_squares"))]).first()
    out = {}
    for r in rules:
        n = s["n"] or 0
        mean = (s[r.name] or 0) / n if n else 0.0
        spread = mean * (1 - mean)
        between = (s[f"{r.name}_squares"] / n - mean * mean - spread * (s["hosts"] - 1) / n) if n else 0.0
        out[r.name] = (mean, max(1.0, spread / between - 1) if between > 1e-12 else float("inf"))
    return out


def judged(hosts: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = LIMIT, spare: float = SPARE) -> DataFrame:
    """hosts with, for each rule, rate_<rule> (the mean of the rate after shrinking) and `rejected`: by one rule at least the rate exceeds the limit by `spare` standard deviations of what is left uncertain."""
    rejected = F.lit(False)
    for name, (mean, strength) in priors(hosts, rules).items():
        sure = strength == float("inf")
        rate = F.lit(mean) if sure else (F.col(name) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        wide = F.lit(0.0) if sure else F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1)))
        hosts = hosts.withColumn(f"rate_{name}", rate)
        rejected = rejected | (rate - F.lit(spare) * wide > limit)
    return hosts.withColumn("rejected", rejected)


def judge(docs: DataFrame, host: str = "source", rules: tuple[Rule, ...] = RULES, limit: float = LIMIT, spare: float = SPARE) -> DataFrame:
    """doc_id, the measures, base_failed (fails an own rule), host_rejected, kept, of every row of docs(doc_id, text, <host>).

    Null and empty texts have no words and fail. Null hosts are one host, apart from the empty one. Repeated rows are
    judged and counted each; null ids are kept. An empty table gives an empty result; other columns are ignored
    whatever their names. A host of any size is summed by partial sums; its verdict comes by broadcast, or where over
    BROADCAST hosts are rejected by a join that broadcasts the large ones only.
    """
    rows = pick(docs, doc_id="long", text="string", **{host: "string"}).withColumnRenamed(host, "host")
    measured = settle(rows.select("doc_id", "host", measures(F.col("text")).alias("m")).select("doc_id", "host", "m.*"), "measures")
    hosts = settle(judged(failures(measured, rules), rules, limit, spare), "hosts")
    bad = hosts.filter("rejected").select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("key"), "rejected", "n")
    keyed = measured.withColumn("key", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")))
    if small_enough(bad, BROADCAST):
        met = keyed.join(F.broadcast(bad.select("key", "rejected")), "key", "left")
    else:
        met = meet(keyed, bad, ["key"], "rejected", hosts.agg(F.sum("n")).first()[0], "left")
    failed = F.expr(" or ".join(f"({r.fails})" for r in rules if r.own) or "false")
    out = met.withColumns({"base_failed": failed, "host_rejected": F.coalesce("rejected", F.lit(False))}).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return out.select("doc_id", *[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "host_rejected", "kept")


_RULES_SQL = ", ".join(f"sum(CASE WHEN {r.fails} THEN 1 ELSE 0 END)::DOUBLE AS {r.name}" for r in RULES)
_SUMS_SQL = ", ".join(f"sum({r.name}) / sum(n) AS mean_{r.name}, sum({r.name} * {r.name} / n) / sum(n) AS squares_{r.name}" for r in RULES)
_PRIOR_SQL = ", ".join(
    f"mean_{r.name} AS m_{r.name}, CASE WHEN squares_{r.name} - mean_{r.name} * mean_{r.name} - mean_{r.name} * (1 - mean_{r.name}) * (n_hosts - 1) / n_docs > 1e-12 "
    f"THEN greatest(1.0, mean_{r.name} * (1 - mean_{r.name}) / (squares_{r.name} - mean_{r.name} * mean_{r.name} - mean_{r.name} * (1 - mean_{r.name}) * (n_hosts - 1) / n_docs) - 1) END AS s_{r.name}"
    for r in RULES
)
_RATE_SQL = ", ".join(f"coalesce(({r.name} + m_{r.name} * s_{r.name}) / (n + s_{r.name}), m_{r.name}) AS r_{r.name}" for r in RULES)
_VERDICT_SQL = " OR ".join(f"r_{r.name} - {SPARE} * coalesce(sqrt(r_{r.name} * (1 - r_{r.name}) / (n + s_{r.name} + 1)), 0) > {LIMIT}" for r in RULES)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines, text FROM d),
w AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
g AS (SELECT k, i, {{'a': word, 'b': lead(word) OVER p, 'c': lead(word, 2) OVER p}} AS t, lead(word, 2) OVER p AS third FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, t) AS n FROM g WHERE third IS NOT NULL) WHERE n > 1),
covered AS (SELECT k, count(*) AS n_repeat_words FROM (SELECT DISTINCT k, i + unnest([0, 1, 2]) AS i FROM twice) GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(lines) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT d.doc_id, d.source, len(s.words) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM d JOIN split s USING (k) LEFT JOIN l USING (k) LEFT JOIN covered c USING (k)),
h AS (SELECT source, count(*) AS n, {_RULES_SQL} FROM m GROUP BY source),
sums AS (SELECT count(*) AS n_hosts, sum(n) AS n_docs, {_SUMS_SQL} FROM h),
prior AS (SELECT {_PRIOR_SQL} FROM sums),
verdict AS (SELECT source, {_VERDICT_SQL} AS rejected FROM (SELECT h.*, prior.*, {_RATE_SQL} FROM h, prior)),
f AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, v.rejected AS host_rejected, NOT base_failed AND NOT v.rejected AS kept
FROM f JOIN verdict v ON v.source IS NOT DISTINCT FROM f.source
"""
