"""Cues to look at, with their images, and names for what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.functions.text import safe_name
from cuefold.functions.timecode import filename_time


def targets(paired: DataFrame, kind: str) -> DataFrame:
    """``file, ref_id, start`` of the cues to look at: missing ones, or text mismatches with their distance."""
    base = [F.col("file"), F.col("ref_id"), F.col("ref_start").alias("start")]
    if kind == "text":
        return paired.where("cand_id is not null and edit_distance > 0").select(*base, "cand_id", "edit_distance")
    if kind == "missing":
        return paired.where("cand_id is null").select(*base)
    raise ValueError(f"unknown kind {kind}")


def with_images(cues: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """``cues`` with the image of their start; of images with one start the last of the stream counts."""
    last = images.groupBy(*keys).agg(F.max_by("image", F.struct("ord", "image")).alias("image"))
    return cues.join(last, keys, "left")


def manifest_line(name: Column, start: Column, image: Column) -> Column:
    """One JSON line of the manifest."""
    return F.to_json(F.struct(name.alias("name"), start.alias("start"), F.concat(safe_name(name), F.lit("-"), filename_time(start), F.lit(".png")).alias("path"), image.alias("image")))


def within_budget(cues: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` cues, file after file in order of names, within a file by start.

    A file cannot give more than ``limit`` cues, and files are few rows, so the running
    total is over one row per file.
    """
    salted = cues.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(64)))
    order = ["start", "ref_id"]
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("file", "salt").orderBy(*order))).where(F.col("r") <= limit)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("r") <= limit)
    # Names of files in order until the budget is used up: at most ``limit`` files have a cue in it.
    heads = ranked.groupBy("file").agg(F.count("*").alias("n")).orderBy("file").limit(limit)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    budget = heads.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("used") < limit)
    return ranked.join(F.broadcast(budget), "file").where(F.col("used") + F.col("r") <= limit).drop("salt", "r", "used", "n")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with ``unique``: the k-th of equal names gets ``-k`` before its extension.

    Equal names are numbered in blocks of the order column.
    """
    from cuefold.operators.blocked import numbered

    n = numbered(df, [name], F.floor(F.col(order) / 4096), [order], "_k")
    stem, ext = F.regexp_extract(name, r"\A(.+?)(\.[^.]*)?\z", 1), F.regexp_extract(name, r"\A.+?(\.[^.]*)?\z", 1)
    return n.withColumn("unique", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_k").cast("string"), ext))).drop("_k")
