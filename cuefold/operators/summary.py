"""Summaries and orders of small lists: checks, names, partial runs, number of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_summary(checks: DataFrame, group: list[str]) -> DataFrame:
    """``group, checks, failures, warnings, ok``: failures are required checks that did not pass, and only they block.

    ``checks`` has ``required, ok``; null counts as not required and as not passed.
    """
    required, passed = F.coalesce("required", F.lit(False)), F.coalesce("ok", F.lit(False))
    return checks.groupBy(*group).agg(
        F.count("*").alias("checks"), F.count_if(required & ~passed).alias("failures"), F.count_if(~required & ~passed).alias("warnings"),
    ).withColumn("ok", F.col("failures") == 0)


def name_order(df: DataFrame, group: list[str], name: str, ident: str) -> DataFrame:
    """``df`` with the place of a row in its group, by name as a reader sorts (``reader_rank``) and by code (``code_rank``).

    A reader's order is that of the Unicode collation without letter case; ties go by ``ident``.
    A group is one list to be shown and is sorted as a whole.
    """
    w = Window.partitionBy(*group)
    return df.withColumn("reader_rank", F.row_number().over(w.orderBy(F.collate(F.col(name), "UNICODE_CI"), F.col(ident)))).withColumn(
        "code_rank", F.row_number().over(w.orderBy(F.col(name), F.col(ident)))
    )


def partial_run(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The rows before ``limit`` in ``order``; what a partial run gives is not ``cacheable``.

    Without a limit every row stays, null orders too, and may be cached.
    """
    kept = df if limit is None else df.where(F.col(order) < limit)
    return kept.withColumn("cacheable", F.lit(limit is None))


def job_count(cores: Column, asked: Column | None = None, most: int = 16) -> Column:
    """Jobs to run side by side: what was asked for, at least one, else one less than the cores, up to ``most``."""
    found = F.greatest(F.lit(1), F.least(F.lit(most), cores.cast("int") - 1))
    return found if asked is None else F.when(asked.isNull(), found).otherwise(F.greatest(F.lit(1), asked.cast("int")))
