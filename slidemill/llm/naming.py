"""Dense names of distinct keys, and joins that bring names back to rows of which many may share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.common import settle

#: Rows of one key over which the key is joined by broadcast, at least.
HOT = 1000
#: monotonically_increasing_id() counts rows of a task in so many low bits.
LOW = 33


def named(keys: DataFrame, what: str, first: int = 0) -> DataFrame:
    """keys, which are distinct, with `name`: first, first + 1, ... without gaps.

    Each task numbers its own rows; the tables of how many rows each task had, as many rows as tasks, give where it
    begins. The rows are written before anything reads a name, so a lost executor can't change one.
    """
    rows = settle(keys.withColumn("name", F.monotonically_increasing_id()), what)
    task = F.shiftright("name", LOW)
    counts = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    begins = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n") + first).alias("begins"))
    out = rows.withColumn("task", task).join(F.broadcast(begins), "task").withColumn("name", F.col("begins") + F.col("name").bitwiseAND((1 << LOW) - 1)).drop("task", "begins")
    out._settled_at = rows._settled_at
    return out


def meet(rows: DataFrame, found: DataFrame, on: list[str], wanted: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows with the wanted column of found(*on, wanted, n), whose keys are distinct and have n of the n_rows rows.

    Keys of over a 500th of the rows, 500 at most as the ns sum to n_rows, come by broadcast to where their rows are;
    the others' rows, none a hot key, are shuffled.
    """
    limit = max(HOT, n_rows // 500)
    hot = found.filter(F.col("n") > limit).select(*on, F.lit(True).alias("is_hot"), F.col(wanted).alias("hot_value"))
    met = rows.join(F.broadcast(hot), on, "left")
    rest = met.filter("is_hot is null").drop("is_hot", "hot_value").join(found.filter(F.col("n") <= limit).select(*on, wanted), on, how)
    return met.filter("is_hot").withColumnRenamed("hot_value", wanted).drop("is_hot").unionByName(rest)
