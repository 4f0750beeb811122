"""Running numbers and scans over sequences of any length, in two levels.

A window without keys, or over a key that holds a third of all rows, is one task. Here rows are first cut, in their order, into
blocks of bounded size; each block gives a short summary, a scan over the summaries tells each block what came before it, and the
blocks finish alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatescan.storage import stored

#: Rows of a block, about.
BLOCK_ROWS = 1 << 20
#: Columns that the functions here add on the way.
BLOCK = "__block"


def in_range_partitions(df: DataFrame, order: list[str | Column], parts: int) -> DataFrame:
    """df sorted by order into so many partitions and stored, with __block, its partition, and __place, its place there from 0.

    Rows of equal order stay in one partition. As the table is stored, a lost task can't deal the rows anew.
    """
    ranged = df.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    # the identifier is the partition's number above 33 bits of the row's place
    return stored(ranged.select(*df.columns, F.shiftright("__id", 33).alias(BLOCK), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__place")), "ranges")


def starts_of(counts: DataFrame, order: list[str], keys: list[str] | None = None, n: str = "n") -> DataFrame:
    """counts (one row a block) with before: the sum of n of the blocks before it, by keys if there are any. The number of blocks
    is that of a table's partitions or files, which the driver knows in any case, so one task may hold them."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def number_rows(df: DataFrame, order: list[str | Column], name: str = "row_number", parts: int = 64) -> DataFrame:
    """df with name, the row's number from 1 by order: a range sort, and the sums of the partitions' counts. No task sees more
    than a partition. Rows of equal order are numbered in any order; an empty table stays empty."""
    ranged = in_range_partitions(df, order, parts)
    starts = starts_of(ranged.groupBy(BLOCK).agg(F.count("*").alias("n")), [BLOCK]).select(BLOCK, "before")
    return ranged.join(starts, BLOCK).withColumn(name, F.col("before") + F.col("__place") + 1).drop(BLOCK, "__place", "before")


def session_blocks(df: DataFrame, session: str, order: list[str], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, bool]:
    """(df with __block, whether any session was cut). A session of more than block_rows rows is cut, in its order, into blocks of
    about that size, numbered from 1; the other sessions are one block, 0, and aren't moved."""
    counts = df.groupBy(F.col(session).alias("__session")).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    long = stored(counts, "long-sessions")  # at most one row for each block_rows rows of df
    total = long.agg(F.sum("n")).first()[0]
    if not total:
        return df.withColumn(BLOCK, F.lit(0).cast("long")), False
    same = df[session].eqNullSafe(long["__session"])
    cut = in_range_partitions(df.join(long, same, "left_semi"), [session, *order], math.ceil(total / block_rows)).drop("__place")
    rest = df.join(long, same, "left_anti").withColumn(BLOCK, F.lit(0).cast("long"))
    return rest.unionByName(cut.withColumn(BLOCK, F.col(BLOCK) + 1)), True
