"""Runs of identical or nearly identical consecutive events, collapsed to one each.

Every event gets a canonical value: the folded text of the event that opens its
chain of near-identical neighbours, so a line that returns later has the value it
had before.  The row number within the canonical value is subtracted from the row
number within the entity; the rows of one value with one difference are a run.  An
entity may hold a third of all rows, so rows are numbered in blocks of the order
column, and only the parts that touch a block border are put together across blocks.

Nearly the same is no equivalence, so a text has no class of its own for good: a
chain may drift away from its first event and the next chain open with that very
text.  Such a chain's value carries its row number too, which keeps the two apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.llm.lookalike import bare, mapped

#: Orders per block, hence the most rows of one window group.
BLOCK = 4096
#: Neighbours are nearly the same if 1 - distance / length >= SAME / 100.
SAME = 85


def nearly_same(a: str, b: str) -> Column:
    """Whether folded texts ``a`` and ``b`` differ by few enough edits; false with a null.

    Two texts that fold to nothing are the same.  The distance is only counted up to the
    greatest one allowed.
    """
    allowed = f"{100 - SAME} * greatest(length({a}), length({b})) div 100"
    return F.expr(
        f"case when {a} is null or {b} is null then false when {a} = {b} then true "
        f"when abs(length({a}) - length({b})) > {allowed} then false "
        f"else levenshtein({a}, {b}, cast({allowed} as int)) >= 0 end"
    )


def collapse_runs(
    df: DataFrame, entity: str, order: str, text: str, start_ms: Column, end_ms: Column, block: int = BLOCK
) -> DataFrame:
    """One row per longest run of near-identical consecutive events, single events included.

    Result: ``entity, first, last, n, start_ms, end_ms, duration_ms, text`` (the text of
    the first event).  Order holes don't matter.  A null or blank text ends a run and
    belongs to none.  Rows with a null entity or order are left out; rows repeated in
    every column count once; different rows of one order follow each other by a hash of
    their columns.  Null times are ignored, and a run without any has null times.
    """
    rows = df.select(
        F.col(entity).alias("entity"), F.col(order).alias("o"), F.col(text).alias("text"),
        start_ms.alias("s"), end_ms.alias("e"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("rid"),
    ).where("entity is not null and o is not null")
    # Rows cross once, unfolded; all steps within a block use this exchange.
    rows = rows.withColumn("block", F.floor(F.col("o") / block)).repartition("entity", "block")
    w = Window.partitionBy("entity", "block").orderBy("o", "rid")
    rows = (
        rows.withColumn("twin", (F.lag("o").over(w) == F.col("o")) & (F.lag("rid").over(w) == F.col("rid")))
        .where("twin is null or not twin")
        .withColumn("shape", mapped(F.col("text"))).withColumn("fold", bare(F.col("shape"))).drop("shape", "twin")
        .withColumn("pf", F.lag("fold").over(w))
        .withColumn("rn", F.row_number().over(w))
        .withColumn("ends", F.lead("o").over(w).isNull())
        .withColumn("opens", ~nearly_same("pf", "fold"))
        .withColumn("canon", F.last(F.when(F.col("opens"), F.col("fold")), ignorenulls=True).over(w))
    )
    # A chain that opens with the canonical text of the chain right before it is marked.
    again = F.when(F.lag("canon").over(w) == F.col("fold"), F.col("rn"))
    rows = (
        rows.withColumn("opener", F.when(F.col("opens"), F.struct("fold", again.alias("again"))))
        .withColumn("value", F.when(F.col("fold").isNotNull(), F.last("opener", ignorenulls=True).over(w)))
    )
    of_value = Window.partitionBy("entity", "block", "value").orderBy("o", "rid")
    parts = (
        rows.withColumn("difference", F.col("rn") - F.row_number().over(of_value))
        .groupBy("entity", "block", "value", "difference")
        .agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"),
             F.min_by("text", "rn").alias("text"), F.min("rn").alias("at"), F.max("ends").alias("ends"),
             F.max(F.when(F.col("rn") == 1, F.col("fold"))).alias("border"), F.max(F.when(F.col("ends"), F.col("fold"))).alias("edge"))
    )
    # Parts at a border come together by entity, at most two a block; all others stay apart.
    at_border = (F.col("at") == 1) | F.col("ends")
    parts = parts.withColumn("apart", F.when(~at_border, F.col("block")))
    by_block = Window.partitionBy("entity", "apart").orderBy("block", "at")
    parts = (
        parts.withColumn("before", F.when(F.lag("ends").over(by_block), F.lag("edge").over(by_block)))
        .withColumn("goes_on", (F.col("at") == 1) & nearly_same("before", "border"))
        .withColumn("run", F.last(F.when(~F.col("goes_on"), F.struct("block", "at")), ignorenulls=True).over(by_block))
        .where("value is not null")
    )
    return (
        parts.withColumn("run", F.when(at_border, F.col("run")).otherwise(F.struct("block", "at")))
        .groupBy("entity", "apart", "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
             F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.min_by("text", "first").alias("text"))
        .select(F.col("entity").alias(entity), "first", "last", "n", "start_ms", "end_ms",
                (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "text")
    )
