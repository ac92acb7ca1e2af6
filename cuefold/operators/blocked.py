"""Ordered neighbours and running state of a group that no single task holds.

A group (a file) may be a third of all rows, so windows run in blocks of the order
column, and a summary of one row per block carries what crosses block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(df: DataFrame, group: list[str], block: Column, order: list[str], value: Column, out: str, forward: bool = True) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` of the rows before (or after) a row.

    ``order`` must be total within a group and agree with ``block``; for ties in it the
    result is one of the possible ones.  Rows with a null in the group form a group too.
    """
    rows = df.withColumn("_b", block).withColumn("_v", value)
    keys = [*group, "_b"]
    sort = [F.asc(c) if forward else F.desc(c) for c in order]
    own = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    seen = F.when(F.col("_v").isNotNull(), place)
    last = F.max_by("_v", seen) if forward else F.min_by("_v", seen)
    blocks = Window.partitionBy(*group).orderBy(F.asc("_b") if forward else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        rows.groupBy(*keys).agg(last.alias("_l")).withColumn("_c", F.last("_l", ignorenulls=True).over(blocks)).drop("_l")
        .withColumnsRenamed({k: f"_s{j}" for j, k in enumerate(keys)})
    )
    same = None
    for j, k in enumerate(keys):
        eq = F.col(k).eqNullSafe(F.col(f"_s{j}"))
        same = eq if same is None else same & eq
    joined = rows.withColumn(out, F.last("_v", ignorenulls=True).over(own)).join(summary, same, "left")
    return joined.withColumn(out, F.coalesce(out, "_c")).drop("_b", "_v", "_c", *[f"_s{j}" for j in range(len(keys))])


def numbered(df: DataFrame, group: list[str], block: Column, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: the row number from 1 of a row in its group."""
    rows = df.withColumn("_b", block)
    keys = [*group, "_b"]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    return (
        rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).join(offsets, keys)
        .withColumn(out, F.col(out) + F.col("_o")).drop("_b", "_o")
    )
