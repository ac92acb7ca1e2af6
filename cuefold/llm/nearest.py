"""Nearest record in time of the same entity within a tolerance.

Every right-side time becomes the interval of left times it is nearest to,
bounded by the midpoints to its neighbours and by the tolerance.  Intervals of
an entity are disjoint, so a left time falls into one at most.  They are indexed
by cells of time as wide as the longest interval, and the range join runs as an
equality join on (entity, cell) with the interval bounds as filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the blocks in which neighbours are sought, in multiples of the tolerance.
BLOCK = 256


def nearest_intervals(right: DataFrame, entity: str, time_ms: Column, ident: Column, tolerance_ms: int) -> DataFrame:
    """(entity, cell, lo2, hi2, ident, time): left times t with lo2 <= 2t <= hi2 are nearest to ``time``.

    Of right rows at one time the smallest ident counts; at a midpoint the
    neighbour with the smaller ident wins.  A neighbour beyond twice the tolerance
    bounds nothing, so neighbours are sought in blocks of time with that margin;
    a block holds at most as many different times as milliseconds.
    """
    tol, width = tolerance_ms, max(1, BLOCK * tolerance_ms)
    points = (
        right.select(F.col(entity).alias("entity"), time_ms.alias("t"), ident.alias("ident"))
        .where("entity is not null and t is not null and ident is not null")
        .groupBy("entity", "t").agg(F.min("ident").alias("ident"))
    )
    own = F.floor(F.col("t") / width)
    around = F.array_distinct(F.array(own, F.floor((F.col("t") - 2 * tol) / width), F.floor((F.col("t") + 2 * tol) / width)))
    w = Window.partitionBy("entity", "block").orderBy("t")
    bounded = (
        points.withColumn("own", own).withColumn("block", F.explode(around))
        .withColumn("pt", F.lag("t").over(w)).withColumn("pi", F.lag("ident").over(w))
        .withColumn("nt", F.lead("t").over(w)).withColumn("ni", F.lead("ident").over(w))
        .where("block = own")
        .withColumn("lo2", F.greatest(F.lit(2) * (F.col("t") - tol), F.expr("t + pt + case when ident < pi then 0 else 1 end")))
        .withColumn("hi2", F.least(F.lit(2) * (F.col("t") + tol), F.expr("t + nt - case when ident < ni then 0 else 1 end")))
    )
    cell = max(1, 2 * tol)
    return bounded.where("lo2 <= hi2").select(
        "entity", "lo2", "hi2", "ident", "t",
        F.explode(F.sequence(F.floor(F.col("lo2") / (2 * cell)), F.floor(F.col("hi2") / (2 * cell)))).alias("cell"),
    )


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_ms: Column, right_ms: Column,
    left_id: Column, right_id: Column, tolerance_ms: int,
) -> DataFrame:
    """(left_id, right_id, diff_ms) of each left record and the nearest right record in time.

    diff_ms is right minus left.  On a tie the smaller right id wins, and a right
    record may serve several left ones.  Left records without one within the
    tolerance, or with a null entity, time or id, give no row; repeated rows count
    once; empty inputs give no rows.
    """
    cell = max(1, 2 * tolerance_ms)
    index = nearest_intervals(right, entity, right_ms, right_id, tolerance_ms)
    asks = (
        left.select(F.col(entity).alias("entity"), left_ms.alias("lt"), left_id.alias("left_id"))
        .where("entity is not null and lt is not null and left_id is not null").distinct()
        .withColumn("cell", F.floor(F.col("lt") / cell))
    )
    return (
        asks.join(index, ["entity", "cell"]).where("2 * lt between lo2 and hi2")
        .select("left_id", F.col("ident").alias("right_id"), (F.col("t") - F.col("lt")).alias("diff_ms"))
    )
