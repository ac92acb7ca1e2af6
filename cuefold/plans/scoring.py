"""Queries that score candidate cues against reference cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuefold.operators import compare as M
from cuefold.operators.pairing import nearest_unmatched, pair_cues
from cuefold.plans import scoring_sql
from cuefold.session import table

TOP, OVERALL = 5, 200
LIMITS = {"min_fixtures": 9, "missing": 0, "extra": 0, "end_mismatches": 0, "cer": 0.01}


def _tracks(spark, sf):
    return M.tracked(table(spark, sf, "ref_cue")), M.tracked(table(spark, sf, "cand_cue"))


def _gaps(ref):
    """Declared gaps: ten seconds from each reference cue that only describes a sound."""
    return ref.where("startswith(text, '[')").select("file", "start", (F.col("start") + 10.0).alias("end"))


def pair(spark, sf):
    return pair_cues(*_tracks(spark, sf))


def pair_details(spark, sf):
    ref, cand = _tracks(spark, sf)
    return M.pairing(ref, cand).select("file", "ref_id", "cand_id", "edit_distance")


def comparison_details(spark, sf):
    """The rows behind the summary with the cues of both sides as they stand in the tables."""
    ref, cand = _tracks(spark, sf)
    out = M.details(ref, cand, _gaps(ref))
    for name, p in (("ref_cue", "ref"), ("cand_cue", "cand")):
        cues = table(spark, sf, name).dropDuplicates(["cue_id"])
        out = out.join(cues.select(F.col("cue_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("index", "number", "start", "end", "timing", "text")]), f"{p}_id", "left")
    return out


def missing_cues(spark, sf):
    ref, cand = _tracks(spark, sf)
    return M.missing(M.pairing(ref, cand)).select("file", "ref_id", "ref_start")


def extra_cues(spark, sf):
    ref, cand = _tracks(spark, sf)
    out = M.inside_gap(M.extra(cand, M.pairing(ref, cand)), _gaps(ref))
    return out.select("file", F.col("id").alias("cand_id"), "start", "in_gap")


def shifted_matches(spark, sf):
    ref, cand = _tracks(spark, sf)
    return M.shifted(M.pairing(ref, cand), cand)


def benchmark_summary(spark, sf):
    ref, cand = _tracks(spark, sf)
    return M.with_total(M.summaries(ref, cand, _gaps(ref))).withColumn("verdict", M.verdict())


def text_mismatch_topk(spark, sf):
    ref, cand = _tracks(spark, sf)
    return M.top_per_file(M.ranked_mismatches(M.pairing(ref, cand)), TOP).select("file", "rank", "ref_id", "cand_id", "edit_distance", "cer")


def global_topk_regroup(spark, sf):
    ref, cand = _tracks(spark, sf)
    return M.top_overall(M.ranked_mismatches(M.pairing(ref, cand)), OVERALL)


def quality_gate(spark, sf):
    ref, cand = _tracks(spark, sf)
    rows = M.summaries(ref, cand, _gaps(ref))
    no_side = (F.col("reference_cues") == 0) | (F.col("candidate_cues") == 0)
    total = M.total_row(rows, F.count_if(~no_side).alias("compared"), F.count_if(no_side).alias("unpaired"))
    return M.gate(total, F.col("compared"), F.col("unpaired"), LIMITS).select("enabled", "passed", F.array_join("failures", "; ").alias("failures"))


def frame_targets(spark, sf):
    """Candidates as frames in the order of their ids, those with text taking the nearest reference within 0.08 s."""
    ref, cand = _tracks(spark, sf)
    return nearest_unmatched(cand.withColumn("ord", F.col("id")).withColumn("usable", F.col("text") != ""), ref)


QUERIES = {f.__name__: f for f in (
    pair, pair_details, comparison_details, missing_cues, extra_cues, shifted_matches, benchmark_summary, text_mismatch_topk, global_topk_regroup, quality_gate, frame_targets,
)}
ORACLE = scoring_sql.ORACLE
