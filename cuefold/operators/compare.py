"""Scoring of a candidate track against its reference: pairing, metrics, totals, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuefold.functions.text import similarity
from cuefold.functions.timecode import percent
from cuefold.operators.pairing import TOLERANCE, pair_cues
from cuefold.session import cut

SHIFT_WINDOW, SHIFT_SIMILARITY = 3.0, 0.92
GAP_MARGIN = 0.5


def tracked(df: DataFrame) -> DataFrame:
    """``file, id, ord, start, end, text`` of readable cues; rows of one id are repeated rows and count once."""
    return (
        df.where("file is not null and start is not null and end is not null")
        .select("file", F.col("cue_id").alias("id"), F.col("index").alias("ord"), "start", "end", F.coalesce("text", F.lit("")).alias("text"))
        .dropDuplicates(["id"])
    )


def pairing(ref: DataFrame, cand: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every reference with its candidate, if any: the table all figures come from."""
    pairs = pair_cues(ref, cand, tolerance)
    side = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "ord", "start", "end", "text")], *([F.col("file")] if p == "ref" else []))
    joined = side(ref, "ref").join(pairs, "ref_id", "left").join(side(cand, "cand"), "cand_id", "left")
    return joined.withColumn(
        "edit_distance", F.when(F.col("cand_id").isNull(), F.length("ref_text")).otherwise(F.levenshtein("cand_text", "ref_text"))
    )


def missing(paired: DataFrame) -> DataFrame:
    return paired.where("cand_id is null")


def extra(cand: DataFrame, paired: DataFrame) -> DataFrame:
    """Candidates that no reference took."""
    used = paired.where("cand_id is not null").select(F.col("cand_id").alias("id"))
    return cand.join(used, "id", "left_anti")


def inside_gap(cues: DataFrame, gaps: DataFrame) -> DataFrame:
    """``cues`` with ``in_gap``: whether a cue starts in a declared gap of its file, margins included.

    Gaps are spread over buckets of a minute, so the join is an equality join.
    """
    spread = gaps.select(
        F.col("file").alias("gf"), F.col("start").alias("gs"), F.col("end").alias("ge"),
        F.explode(F.sequence(F.floor((F.col("start") - GAP_MARGIN) / 60), F.floor((F.col("end") + GAP_MARGIN) / 60))).alias("gb"),
    )
    inside = (
        (F.col("file") == F.col("gf")) & (F.floor(F.col("start") / 60) == F.col("gb"))
        & (F.col("start") >= F.col("gs") - GAP_MARGIN) & (F.col("start") <= F.col("ge") + GAP_MARGIN)
    )
    hit = cues.join(spread, inside, "left_semi").select("id", F.lit(True).alias("in_gap"))
    return cues.join(hit.distinct(), "id", "left").withColumn("in_gap", F.coalesce("in_gap", F.lit(False)))


def shifted(paired: DataFrame, cand: DataFrame) -> DataFrame:
    """The best candidate of each missing reference with a text that is alike within seconds."""
    lost = missing(paired).where("ref_text <> ''").select("file", "ref_id", "ref_start", "ref_text")
    w = SHIFT_WINDOW
    asks = lost.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("ref_start") / w) + k for k in (-1, 0, 1)])))
    offers = cand.select(
        F.col("file"), F.floor(F.col("start") / w).alias("bucket"), F.col("id").alias("cand_id"), F.col("ord").alias("cand_ord"),
        F.col("start").alias("cand_start"), F.col("text").alias("cand_text"),
    )
    near = asks.join(offers, ["file", "bucket"]).where(
        (F.abs(F.col("cand_start") - F.col("ref_start")) <= w)
        # An edit distance is at least the difference in length.
        & (F.abs(F.length("ref_text") - F.length("cand_text")) <= (1 - SHIFT_SIMILARITY) * F.greatest(F.length("ref_text"), F.length("cand_text")) + 1)
    )
    scored = near.withColumn("similarity", similarity(F.col("ref_text"), F.col("cand_text"))).where(F.col("similarity") >= SHIFT_SIMILARITY)
    best = F.max_by(
        F.struct("cand_id", (F.col("cand_start") - F.col("ref_start")).alias("shift"), "similarity"),
        F.struct(F.col("similarity"), -F.abs(F.col("cand_start") - F.col("ref_start")), -F.col("cand_ord"), -F.col("cand_id")),
    )
    return scored.groupBy("file", "ref_id").agg(best.alias("b")).select("file", "ref_id", "b.*")


COUNTS = [
    "reference_cues", "candidate_cues", "missing", "extra", "unverified", "raw_extra", "shifted", "end_mismatches",
    "exact_text_matches", "text_edit_distance", "reference_characters",
]


def _with_rates(df: DataFrame) -> DataFrame:
    rate = F.when(F.col("reference_characters") > 0, F.col("text_edit_distance") / F.col("reference_characters")).otherwise(F.lit(0.0))
    return df.withColumn("character_error_rate", rate).withColumn("exceeds_reference_length", F.col("text_edit_distance") > F.col("reference_characters"))


def summaries(ref: DataFrame, cand: DataFrame, gaps: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per file: counts, edit distance, character error rate.

    An unpaired reference adds its whole length, an extra candidate nothing.  Extras inside a
    declared gap, and all extras of a file without references, are unverified.
    """
    # Three figures come from the pairing, so it is made once.
    paired = cut(pairing(ref, cand, tolerance))
    n = lambda c: F.count_if(c).alias
    is_pair = F.col("cand_id").isNotNull()
    left = paired.groupBy("file").agg(
        F.count("*").alias("reference_cues"), n(~is_pair)("missing"),
        n(is_pair & (F.abs(F.col("cand_end") - F.col("ref_end")) > tolerance))("end_mismatches"),
        n(is_pair & (F.col("cand_text") == F.col("ref_text")))("exact_text_matches"),
        F.sum("edit_distance").alias("text_edit_distance"), F.sum(F.length("ref_text")).cast("long").alias("reference_characters"),
    )
    extras = inside_gap(extra(cand, paired), gaps).groupBy("file").agg(F.count("*").alias("raw_extra"), F.count_if("in_gap").alias("gap_extra"))
    parts = [left, cand.groupBy("file").agg(F.count("*").alias("candidate_cues")), extras, shifted(paired, cand).groupBy("file").agg(F.count("*").alias("shifted"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "file", "full")
    out = out.fillna(0, [c for c in out.columns if c != "file"])
    out = out.withColumn("unverified", F.when(F.col("reference_cues") == 0, F.col("raw_extra")).otherwise(F.col("gap_extra")))
    out = out.withColumn("extra", F.col("raw_extra") - F.col("unverified"))
    return _with_rates(out.select("file", *COUNTS))


def total_row(rows: DataFrame, *more: Column) -> DataFrame:
    """The sums of all rows; the error rate comes from the sums."""
    return _with_rates(rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], *more).withColumn("file", F.lit("TOTAL")))


def with_total(rows: DataFrame) -> DataFrame:
    """The rows and their grand total."""
    return rows.unionByName(total_row(rows).select(*rows.columns))


def verdict() -> Column:
    return (
        F.when((F.col("missing") > 0) | (F.col("extra") > 0) | (F.col("end_mismatches") > 0), "check")
        .when(F.col("unverified") > 0, "unverified").otherwise("ok")
    )


def ranked_mismatches(paired: DataFrame) -> DataFrame:
    """Text mismatches with their error rate and rank within the file, worst first."""
    rows = paired.where("cand_id is not null and edit_distance > 0").withColumn(
        "cer", F.when(F.length("ref_text") > 0, F.col("edit_distance") / F.length("ref_text")).otherwise(F.lit(0.0))
    )
    return rows


def top_per_file(mismatches: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` worst mismatches of each file.

    Every block of a file first keeps its own ``k``, so no task holds a whole file.
    """
    order = [F.desc("edit_distance"), F.desc("cer"), F.asc("ref_ord"), F.asc("ref_id")]
    part = mismatches.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(64)))
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("file", "salt").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("rank") <= k).drop("salt", "r")


def details(ref: DataFrame, cand: DataFrame, gaps: DataFrame, k: int = 100, tolerance: float = TOLERANCE) -> DataFrame:
    """What the counts of :func:`summaries` consist of, a row each, by ``kind``.

    ``missing``, ``extra``, ``unverified``, ``end_mismatch``, ``shifted`` and, the ``k`` worst of a
    file with their ``rank``, ``text_mismatch``.  Columns: ``file, kind, rank, ref_id, cand_id,
    edit_distance, reference_characters, cer, shift, similarity``; null where a kind has none.
    """
    paired = cut(pairing(ref, cand, tolerance))
    known = ref.select("file").distinct().withColumn("known", F.lit(True))
    extras = inside_gap(extra(cand, paired), gaps).join(known, "file", "left")
    texts = top_per_file(ranked_mismatches(paired), k).withColumn("reference_characters", F.length("ref_text"))
    ends = paired.where(F.col("cand_id").isNotNull() & (F.abs(F.col("cand_end") - F.col("ref_end")) > tolerance))
    parts = [
        missing(paired).select("file", F.lit("missing").alias("kind"), "ref_id"),
        extras.select("file", F.when(F.col("known").isNull() | F.col("in_gap"), "unverified").otherwise("extra").alias("kind"), F.col("id").alias("cand_id")),
        ends.select("file", F.lit("end_mismatch").alias("kind"), "ref_id", "cand_id"),
        shifted(paired, cand).select("file", F.lit("shifted").alias("kind"), "ref_id", "cand_id", "shift", "similarity"),
        texts.select("file", F.lit("text_mismatch").alias("kind"), "rank", "ref_id", "cand_id", "edit_distance", "reference_characters", "cer"),
    ]
    out = parts[-1]
    for p in parts[:-1]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def top_overall(mismatches: DataFrame, k: int) -> DataFrame:
    """The ``k`` worst mismatches of all files, counted by file."""
    worst = mismatches.orderBy(F.desc("edit_distance"), F.desc("cer"), F.asc("file"), F.asc("ref_id")).limit(k)
    return worst.groupBy("file").agg(
        F.count("*").alias("targets"), F.max("edit_distance").alias("worst"), F.array_sort(F.collect_list("ref_id")).alias("ref_ids")
    )


def gate(total: DataFrame, compared: Column, unpaired: Column, limits: dict[str, float]) -> DataFrame:
    """``enabled, passed, failures`` of the total row under optional thresholds."""
    checks = [F.when(compared == 0, F.lit("nothing was compared"))]
    if "min_fixtures" in limits:
        least = int(limits["min_fixtures"])
        checks.append(F.when(compared < least, F.concat(F.lit("files compared: "), compared.cast("string"), F.lit(f", at least {least} wanted"))))
    checks.append(F.when(unpaired > 0, F.concat(F.lit("files with one side only: "), unpaired.cast("string"))))
    for c in ("missing", "extra", "end_mismatches"):
        if c in limits:
            checks.append(F.when(F.col(c) > limits[c], F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(f" > {int(limits[c])}"))))
    if "cer" in limits:
        checks.append(F.when(F.col("character_error_rate") > limits["cer"], F.concat(F.lit("CER "), percent(F.col("character_error_rate")), F.lit(" > "), percent(F.lit(limits["cer"])))))
    return total.select(
        F.lit(bool(limits)).alias("enabled"), F.array_compact(F.array(*checks)).alias("failures")
    ).withColumn("passed", F.size("failures") == 0)
