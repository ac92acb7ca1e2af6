"""Doing work once: first of equals, fan-out, result cache, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_equals(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys`` and the smallest ``order`` of the rows with equal keys."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def fan_out(df: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the result of its representative."""
    return df.join(results, keys, "left")


def cache_key(content: Column, *options: Column) -> Column:
    """Hash of the content and of what else the result depends on; names and places don't count."""
    return F.sha2(F.concat_ws("\x1f", F.sha2(content, 256), *[F.coalesce(o.cast("string"), F.lit("")) for o in options]), 256)


def stale(engine: str, revision: int, vision: bool) -> Column:
    """Why a cache entry no longer counts, null if it does."""
    version = F.col("engine_version")
    return (
        F.when(F.coalesce(F.col("srt"), F.lit("")) == "", "malformed")
        .when(version.isNotNull() & (version != "absent") & F.lit(engine != "absent") & (version != engine), "engine")
        .when(F.coalesce("output_revision", F.lit(0)) != revision, "revision")
        .when(~F.coalesce("vision_available", F.lit(True)) & F.lit(vision), "vision")
    )


def cache_lookup(requests: DataFrame, entries: DataFrame, engine: str, revision: int, vision: bool) -> DataFrame:
    """``requests`` with ``outcome`` (hit, miss or what is stale) and the stored ``srt`` of a hit."""
    known = entries.withColumn("why", stale(engine, revision, vision)).select("cache_key", "why", "srt", F.lit(True).alias("there"))
    out = requests.join(known, "cache_key", "left")
    outcome = F.when(F.col("there").isNull(), "miss").otherwise(F.coalesce("why", F.lit("hit")))
    return out.withColumn("outcome", outcome).withColumn("srt", F.when(F.col("outcome") == "hit", F.col("srt"))).drop("why", "there")


def cache_store(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries after a run: one per key, replaced whole."""
    kept = entries.join(fresh.select("cache_key").distinct(), "cache_key", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(["cache_key"]))


def upsert(queue: DataFrame, incoming: DataFrame, key: str, kept: list[str], refreshed: list[str]) -> DataFrame:
    """Queue after more items came in: known ones keep ``kept``, take ``refreshed`` and are selected."""
    q = queue.select(key, *[F.col(c).alias(f"q_{c}") for c in [*kept, *refreshed]], F.col("selected").alias("q_selected"), F.lit(True).alias("in_q"))
    i = incoming.select(key, *[F.col(c).alias(f"i_{c}") for c in [*kept, *refreshed]], F.lit(True).alias("in_i"))
    both = q.join(i, key, "full")
    old = F.col("in_q").isNotNull()
    return both.select(
        key, *[F.when(old, F.col(f"q_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in kept],
        *[F.coalesce(f"i_{c}", f"q_{c}").alias(c) for c in refreshed],
        F.when(F.col("in_i").isNotNull(), True).otherwise(F.col("q_selected")).alias("selected"),
    )


def even_sample(df: DataFrame, number: str, total: str, count: int) -> DataFrame:
    """Rows whose 0-based ``number`` of ``total`` lies in an even sample of at most ``count``, both ends kept."""
    if count < 2:
        raise ValueError("an even sample has two ends")
    n = F.col(total)
    # Row r is taken if some i of 0..count-1 rounds to it.
    at = F.floor(F.col(number) * (count - 1) / (n - 1))
    hit = lambda i: F.floor(i * (n - 1) / (count - 1) + 0.5) == F.col(number)
    picked = F.lit(False)
    for d in (-1, 0, 1):
        i = at + d
        picked = picked | ((i >= 0) & (i <= count - 1) & hit(i))
    return df.where((n <= count) | picked)
