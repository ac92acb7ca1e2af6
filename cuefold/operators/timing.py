"""When a frame ends: next later time, next display set, fallback chain, output policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.operators.blocked import carry

LAST_SECONDS = 2.5
#: Frames of one block of the stream order.
BLOCK = 4096
#: Milliseconds of one block of presentation time.
TIME_BLOCK_MS = 6 * 3_600_000


def next_later(frames: DataFrame, last_ms: int = 2500) -> DataFrame:
    """``end_ms``: the next time of the file strictly later than ``pts``, else ``pts + last_ms``.

    Frames of one time share their end.  Times are taken as not decreasing.
    """
    times = frames.select("file", "pts").distinct()
    after = carry(times, ["file"], F.floor(F.col("pts") / TIME_BLOCK_MS), ["pts"], F.col("pts"), "later", forward=False)
    return frames.join(after, ["file", "pts"]).withColumn("end_ms", F.coalesce("later", F.col("pts") + last_ms)).drop("later")


def display_ends(sets: DataFrame, usable: Column) -> DataFrame:
    """Usable sets with ``end_ms``: the first later set of the stream, usable or not, that comes later in time.

    Only the most recent usable set can be closed, so one that is followed by another of
    the same time stays open (null), as may the last.  ``sets`` has ``file, ord, pts``.
    """
    marked = sets.withColumn("usable", usable)
    owned = carry(
        marked, ["file"], F.floor(F.col("ord") / BLOCK), ["ord"], F.when(F.col("usable"), F.struct("ord", "pts")), "owner"
    )
    ends = (
        owned.where("owner is not null and pts > owner.pts").groupBy("file", F.col("owner.ord").alias("ord"))
        .agg(F.min_by("pts", "ord").alias("end_ms"))
    )
    return marked.where("usable").drop("usable").join(ends, ["file", "ord"], "left")


def fallback_timing(images: DataFrame) -> DataFrame:
    """``start_s, end_s``: own time else 3 s steps; own end, else the next image's time, else 2.5 s."""
    nxt = carry(images, ["file"], F.floor(F.col("ord") / BLOCK), ["ord"], F.struct("pts"), "nxt", forward=False)
    start = F.coalesce("pts", F.col("ord") * 3.0)
    return nxt.withColumn("start_s", start).withColumn("end_s", F.coalesce("end_pts", F.col("nxt.pts"), F.col("start_s") + LAST_SECONDS)).drop("nxt")


def output_status(kind: Column, found: Column, visible: Column, limited: Column) -> Column:
    """What becomes of a track without visible frames, by its kind."""
    return (
        F.when(found == 0, "error").when((kind == "sup") | (visible > 0), F.when(visible > 0, "ok").otherwise("empty"))
        .otherwise(F.when(limited, "empty").otherwise("error"))
    )
