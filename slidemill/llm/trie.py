"""The trie of conversation prefixes, by prefix doubling: names of blocks of a power of two turns, in logarithmic join rounds.

A block of 2k turns is named by the pair of its halves' names, distinct pairs getting dense names by a join; a prefix
of d turns by the binary decomposition of d: the prefix less its lowest block, and that block. Equal prefixes, and only
those, have one name, so a node is a group of equal names. Only blocks that start at multiples of their size are
needed, two rows a turn in all. Sums over subtrees double likewise: a node's sum over descendants nearer than 2^k goes
to its ancestor 2^k turns up. Nothing is ever done turn after turn, and no conversation or group is one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.common import forget, pick, settle
from slidemill.llm.naming import meet, named

#: Conversations of one hundred borrow first turns from its first; by a hash, fewer than so many.
FAMILY, BORROWED = 100, 6


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), sig (SHA-256 of role and text), chars (code points of text) of every turn.

    Turns are ordered by turn, null first; of equal turns by role, then text. Null roles and texts are empty ones. Rows
    without a conv_id belong to no conversation and are left out. Positions are counted within ranges of
    (conv_id, turn, ...) and then carried over from range to range, so that a conversation of any length is dealt out.
    """
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    sig = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    line = [F.col("conv_id"), F.col("turn"), F.col("role"), sig.alias("sig"), F.char_length("text").cast("long").alias("chars")]
    lines = settle(rows.select(*line), "lines")
    by = ["conv_id", "turn", "role"]
    tied = lines.groupBy(*by).agg((F.min("sig") != F.max("sig")).alias("tied")).filter("tied").limit(1).count()
    if tied:  # only then do whole texts go to where the turns are sorted
        lines, by = rows.select(*line, "text"), [*by, "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, lead = TaskContext.get().partitionId(), None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            lead = ids[0] if lead is None else lead
            if held is not None and held == ids[0]:
                at[: starts[1] if len(starts) > 1 else len(ids)] += n
            held, n = ids[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("sig"), b.column("chars"), pa.array(np.full(len(ids), task, np.int64)), pa.array(at.astype(np.int64)), pa.array(ids == lead)],
                names=["conv_id", "sig", "chars", "task", "local", "lead"],
            )

    dealt = lines.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, "conv_id long, sig binary, chars long, task long, local long, lead boolean")
    out = settle(dealt, "numbered")
    forget(lines)
    spanning = out.filter("lead").select("conv_id").distinct()  # one for each task at most
    parts = out.join(F.broadcast(spanning), "conv_id", "left_semi").groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    placed = out.join(F.broadcast(carried), ["conv_id", "task"], "left")
    return placed.select("conv_id", (F.col("local") + F.coalesce("carried", F.lit(0))).alias("at"), "sig", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation; conv_id, at, sig, chars of every rebuilt turn) of numbered turns.

    Conversation c has the first h turns of c - c % 100 (all if fewer, none if there is none), then its own after its first h; h = crc32(c) % 6.
    """
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"first": c - c % FAMILY, "h": F.crc32(c.cast("string").cast("binary")) % BORROWED})
    convs = settle(convs, "conversations")
    firsts = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("has"))
    lent = settle(convs.join(firsts, "first", "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0)))).select("conv_id", "first", "h", "n", "lent"), "lent")
    heads = turns.filter(F.col("at") < BORROWED - 1).withColumnRenamed("conv_id", "first")
    borrowed = lent.select("conv_id", "first", "h").join(heads, "first").filter("at < h").select("conv_id", "at", "sig", "chars")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = meet(turns.withColumn("h", F.crc32(c.cast("string").cast("binary")) % BORROWED).filter("at >= h"), lent, ["conv_id"], "lent", total)
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "sig", "chars")
    return convs.select("conv_id"), borrowed.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, d, node, chars: the name of every conversation's prefix of d turns (from 1), and the code points of its last text. Names are over 0; equal ones mean equal prefixes."""
    turns = settle(turns, "turns")
    n_rows = turns.count()
    blocks = []
    pairs, on = turns, ["sig"]
    while True:
        found = named(pairs.groupBy(*on).agg(F.count("*").alias("n")), "names")
        blocks.append(settle(meet(pairs, found, on, "name", n_rows).select("conv_id", "at", "name", "chars"), "blocks"))
        forget(found)
        half = lambda k, c: F.max(F.when(F.col("at") % 2 == k, F.col(c)))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(half(0, "name").alias("a"), half(1, "name").alias("b"), half(1, "chars").alias("chars")).filter("a is not null and b is not null")
        on = ["a", "b"]
        if not (n_rows := pairs.count()):
            break
    forget(turns)
    out, first = None, 1
    for k in reversed(range(len(blocks))):
        last = blocks[k].filter("at % 2 = 0").select("conv_id", F.shiftleft("at", k).alias("start"), "name", "chars")
        if out is None:
            joined = last.withColumn("prefix", F.lit(0).cast("long"))
        else:
            joined = last.join(out.select("conv_id", F.col("d").alias("start"), F.col("node").alias("prefix")), ["conv_id", "start"], "left").withColumn("prefix", F.coalesce("prefix", F.lit(0)))
        joined = joined.withColumnRenamed("name", "block")
        found = named(joined.groupBy("prefix", "block").agg(F.count("*").alias("n")), "prefix-names", first)
        n_names, n_rows = found.agg(F.count("*"), F.sum("n")).first()
        level = settle(meet(joined, found, ["prefix", "block"], "name", n_rows or 0).select("conv_id", (F.col("start") + (1 << k)).alias("d"), F.col("name").alias("node"), "chars"), "prefixes")
        forget(found, blocks[k])
        first += n_names
        out = level if out is None else out.unionByName(level)
    return out


def _ends(convs: DataFrame, where: DataFrame) -> DataFrame:
    """node, ends_sha256: of the conversations that end at a node, ids in order. Ids are joined to text within ranges of (node, conv_id), and the ranges' texts hashed in order, one held at a time."""
    last = where.groupBy("conv_id").agg(F.max(F.struct("d", "node")).alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("last.node", F.lit(0)).alias("node"))
    ranged = ends.repartitionByRange("node", "conv_id").withColumn("task", F.spark_partition_id())
    parts = ranged.groupBy("node", "task").agg(F.min("conv_id").alias("least"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, h = None, None
        for b in batches:
            done = []
            for node, ids in zip(b["node"].tolist(), b["ids"], strict=True):
                if node == held:
                    h.update(b",")
                else:
                    if h is not None:
                        done.append((held, h.hexdigest()))
                    held, h = node, hashlib.sha256()
                h.update(ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if h is not None:
            yield pd.DataFrame([(held, h.hexdigest())], columns=["node", "ends_sha256"])

    return parts.select("node", "least", "ids").repartition("node").sortWithinPartitions("node", "least").select("node", "ids").mapInPandas(digest, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations(conv_id, turn, role, text), and the root.

    conv_id, depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 as the
    contract states. Null turns come first; equal turns go by role, then text; null roles and texts are empty; a
    repeated row is a turn of its own; rows without conv_id are left out; an empty table has no nodes, not even the
    root. Other columns are ignored whatever their names.
    """
    convs, turns = rebuilt(numbered(conversations))
    where = prefixes(turns)
    tops = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.lit(0).cast("long").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
    grouped = where.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = settle(tops.unionByName(grouped), "nodes")
    n_nodes, deepest = nodes.agg(F.count("*"), F.max("depth")).first()

    def up(rows: DataFrame, steps: int) -> DataFrame:
        """rows(conv_id, depth) at least so deep, with the node so many turns up."""
        above = where.select("conv_id", (F.col("d") + steps).alias("depth"), F.col("node").alias("above"))
        return rows.filter(F.col("depth") >= steps).join(above, ["conv_id", "depth"], "left").withColumn("above", F.coalesce("above", F.lit(0)))

    children = settle(up(nodes.select("node", "conv_id", "depth"), 1).select("node", "above"), "children")
    counts = children.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
    known = nodes.join(counts, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    sums = settle(known.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("chars"), "n_leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(0).cast("long")}), "sums")
    steps = 1
    while steps <= (deepest or 0):
        sent = up(sums.select("conv_id", "depth", "saved_tokens", "n_leaves"), steps).groupBy(F.col("above").alias("node")).agg(F.sum("saved_tokens").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))
        added = sums.join(sent, "node", "left").withColumns({"saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))})
        before, sums = sums, settle(added.drop("more_saved", "more_leaves"), "sums")
        forget(before)
        steps *= 2
    parents = sums.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    named_parents = meet(children, parents, ["above"], "parent_conv_id", n_nodes or 0).select("node", "parent_conv_id")
    out = sums.join(named_parents, "node", "left").join(_ends(convs, where), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor(t >> 1, (t & 1) * 3988292384))), 4294967295)"

SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_CRC.format(x="conv_id::VARCHAR")} % {BORROWED} AS h, conv_id - conv_id % {FAMILY} AS base FROM own),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(p.turns[1:c.h], []), coalesce(c.turns[c.h + 1:], [])) AS turns FROM h c LEFT JOIN own p ON p.conv_id = c.base),
pre AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) AS n FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
node AS (
  SELECT d AS depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS chars,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM pre GROUP BY d, path),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
up AS (
  SELECT depth AS lvl, path[1:depth] AS head, n_children, (n_convs - 1) * chars AS saved FROM (
    SELECT n_children, n_convs, chars, path, unnest(range(0, depth + 1)) AS depth FROM full_node)),
sums AS (SELECT lvl, head, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY lvl, head)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN sums s ON s.lvl = n.depth AND s.head = n.path LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
