"""Queries of the general data-pipeline operators (problem 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.operators.intervals import merge_intervals, periods_and_gaps
from cuefold.session import millis, table

MIN_GAP_MS, MAX_GAP_MS = 8_000, 600_000


def _periods(spark, sf):
    return merge_intervals(table(spark, sf, "cue"), "file", millis("start"), millis("end"), F.col("ord"))


def p5_found(spark, sf):
    return periods_and_gaps(_periods(spark, sf), "file", MIN_GAP_MS, MAX_GAP_MS)


def p5_periods(spark, sf):
    """Every continuous period, single cues included, and the gap after it."""
    return _periods(spark, sf).select(
        "file", "start_ms", "end_ms",
        F.col("first_member").alias("first_ord"), F.col("last_member").alias("last_ord"),
        (F.col("next_start_ms") - F.col("end_ms")).alias("gap_ms"),
    )


QUERIES = {"p5_found": p5_found, "p5_periods": p5_periods}

_PERIODS = """
with c as (
  select distinct file, ord, cast(round("start" * 1000) as bigint) s, cast(round("end" * 1000) as bigint) e
  from cue where "start" is not null and "end" is not null and file is not null),
v as (select * from c where e > s),
f as (select *, max(e) over (partition by file order by s, e, ord rows between unbounded preceding and 1 preceding) pe from v),
g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by file order by s, e, ord) grp from f),
p as (select file, min(s) start_ms, max(e) end_ms, min(ord) first_ord, max(ord) last_ord from g group by file, grp),
n as (select *, lead(start_ms) over (partition by file order by start_ms) nxt from p)
"""

ORACLE = {
    "p5_found": _PERIODS
    + f"""
select file, 'period' as kind, start_ms, end_ms from n where first_ord < last_ord
union all
select file, 'gap', end_ms, nxt from n where nxt - end_ms between {MIN_GAP_MS} and {MAX_GAP_MS}
""",
    "p5_periods": _PERIODS
    + "select file, start_ms, end_ms, first_ord, last_ord, nxt - end_ms as gap_ms from n",
}
