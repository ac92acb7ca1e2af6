"""Overlapping and gapped time intervals per entity: continuous periods and gaps.

Each interval becomes a Spark session window whose gap duration is the length of
that very row, so overlapping intervals merge natively.  An entity may hold a
third of all rows, so sessions are built within time blocks of the entity and
the few facts that cross a block border (how far earlier blocks reach, where the
period that reaches in began, where the next block starts) are carried by one
summary row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time block.  An hour of captions is about a thousand cues.
BLOCK_MS = 3_600_000


def merge_intervals(
    df: DataFrame,
    entity: str,
    start_ms: F.Column,
    end_ms: F.Column,
    member: F.Column,
    block_ms: int = BLOCK_MS,
) -> DataFrame:
    """One row per continuous period of an entity, with the gap that follows it.

    Intervals that overlap, nest or touch (one ends where the next begins) are
    one period.  Result: ``entity, start_ms, end_ms, n_rows, first_member,
    last_member, next_start_ms``; the gap after a period runs from ``end_ms`` to
    ``next_start_ms`` (null after the last period).

    Rows with a null entity, start or end, or with end at or before start, count
    nowhere.  Repeated rows change no period; ``first_member < last_member`` holds
    exactly for periods of two or more different members, whatever is repeated.
    An empty input gives no rows.  Columns not named here are ignored.
    """
    rows = df.select(
        F.col(entity).alias("entity"), start_ms.alias("s"), end_ms.alias("e"), member.alias("m")
    ).where("entity is not null and s is not null and e is not null and e > s")
    rows = rows.withColumn("block", F.floor(F.col("s") / block_ms))

    seconds = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((e - s) / 1000.0D as decimal(18, 6)))")
    sessions = (
        rows.groupBy("entity", "block", F.session_window(F.timestamp_millis("s"), seconds).alias("w"))
        .agg(F.count("*").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi"))
        .select(
            "entity", "block", "n", "lo", "hi",
            F.unix_millis("w.start").alias("s"), F.unix_millis("w.end").alias("e"),
        )
    )
    # Touching sessions of a block form one run: a run begins where no session reaches.
    in_block = Window.partitionBy("entity", "block")
    by_time = in_block.orderBy("s")
    prev_e = F.lag("e").over(by_time)
    runs = (
        sessions.withColumn("head", F.when(prev_e.isNull() | (F.col("s") > prev_e), F.col("s")))
        .withColumn("run", F.last("head", ignorenulls=True).over(by_time))
        .groupBy("entity", "block", "run")
        .agg(F.max("e").alias("e"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumnRenamed("run", "s")
    )
    # One row per block: how far everything before it reaches, and the period reaching in.
    blocks = Window.partitionBy("entity").orderBy("block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        runs.groupBy("entity", "block").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.max("e").alias("reach"))
        .withColumn("carry_e", F.max("reach").over(before))
        .withColumn("next_s", F.lead("first_s").over(blocks))
        .withColumn("opens", F.expr("case when carry_e is null or last_s > carry_e then last_s end"))
        .withColumn("carry_s", F.last("opens", ignorenulls=True).over(before))
        .select("entity", "block", "carry_e", "carry_s", "next_s")
    )
    stitched = (
        runs.join(summary, ["entity", "block"])
        .withColumn("nxt", F.coalesce(F.lead("s").over(by_time), F.col("next_s")))
        .withColumn("reach", F.greatest("e", "carry_e"))
        .withColumn("period", F.expr("case when s <= carry_e then carry_s else s end"))
    )
    return (
        stitched.groupBy("entity", "period")
        .agg(
            F.max("reach").alias("end_ms"),
            F.sum("n").alias("n_rows"),
            F.min("lo").alias("first_member"),
            F.max("hi").alias("last_member"),
            F.max(F.expr("case when nxt > reach then nxt end")).alias("next_start_ms"),
        )
        .select(
            F.col("entity").alias(entity), F.col("period").alias("start_ms"), "end_ms", "n_rows",
            "first_member", "last_member", "next_start_ms",
        )
    )


def periods_and_gaps(periods: DataFrame, entity: str, min_gap_ms: int, max_gap_ms: int) -> DataFrame:
    """Periods of two or more members and gaps of a length within the bounds, as rows.

    ``periods`` is the result of :func:`merge_intervals`.
    """
    kinds = F.array(
        F.when(
            F.col("first_member") < F.col("last_member"),
            F.struct(F.lit("period").alias("kind"), F.col("start_ms"), F.col("end_ms")),
        ),
        F.when(
            (F.col("next_start_ms") - F.col("end_ms")).between(min_gap_ms, max_gap_ms),
            F.struct(
                F.lit("gap").alias("kind"), F.col("end_ms").alias("start_ms"), F.col("next_start_ms").alias("end_ms")
            ),
        ),
    )
    return (
        periods.select(entity, F.explode(F.array_compact(kinds)).alias("x"))
        .select(entity, "x.kind", "x.start_ms", "x.end_ms")
    )
