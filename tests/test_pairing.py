import random

from pyspark.sql import functions as F

from cuefold.operators import compare as M
from cuefold.operators import pairing as P

SCHEMA = "file string, id bigint, ord int, start double"


def greedy(ref, cand, tol):
    out = set()
    for f in {r[0] for r in ref}:
        used = set()
        rs = sorted((r[3], r[2], r[1]) for r in ref if r[0] == f)
        cs = sorted((c[3], c[2], c[1]) for c in cand if c[0] == f)
        for s, _, i in rs:
            near = [(abs(c - s), c, o, k) for c, o, k in cs if k not in used and c >= s - tol and c - s <= tol]
            if near:
                used.add(min(near)[3])
                out.add((i, min(near)[3]))
    return out


def rows(rng, side, n):
    return [(rng.choice("ab"), side * 1000 + k, k, rng.randrange(0, 2000) / 100 + rng.choice([0, 3599.99])) for k in range(n)]


def test_pairs_equal_the_sequential_rule(spark, monkeypatch):
    rng = random.Random(5)
    for limit in (400, 3):
        monkeypatch.setattr(P, "FOLD_ROWS", limit)
        for _ in range(3):
            ref, cand = rows(rng, 0, 120), rows(rng, 1, 120)
            got = {tuple(r) for r in P.pair_cues(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(cand, SCHEMA)).collect()}
            assert got == greedy(ref, cand, 0.04)


def test_nulls_ties_and_empty(spark):
    ref = spark.createDataFrame([("f", 1, 0, 1.0), ("f", 2, 1, 1.0), (None, 3, 2, 1.0), ("f", 4, 3, None), ("f", 5, 4, float("nan"))], SCHEMA)
    cand = spark.createDataFrame([("f", 12, 1, 1.01), ("f", 11, 0, 0.99), ("g", 13, 2, 1.0)], SCHEMA)
    assert {tuple(r) for r in P.pair_cues(ref, cand).collect()} == {(1, 11), (2, 12)}
    assert P.pair_cues(ref.limit(0), cand).count() == 0
    assert P.pair_cues(ref, cand.limit(0)).count() == 0


CUE = "cue_id bigint, file string, index int, start double, end double, text string, x string"


def test_scores(spark):
    ref = M.tracked(spark.createDataFrame([
        (1, "f", 0, 1.0, 2.0, "same", "x"), (2, "f", 1, 3.0, 4.0, "other", "x"), (3, "f", 2, 10.0, 11.0, "a shifted line", "x"), (3, "f", 2, 10.0, 11.0, "a shifted line", "x"),
    ], CUE))
    cand = M.tracked(spark.createDataFrame([
        (11, "f", 0, 1.0, 2.5, "same", "x"), (12, "f", 1, 3.01, 4.0, "0ther", "x"), (13, "f", 2, 12.0, 13.0, "a shifted line", "x"), (14, "g", 0, 5.0, 6.0, None, "x"), (15, "f", 3, 20.0, 21.0, "gap", "x"),
    ], CUE))
    gaps = spark.createDataFrame([("f", 20.4, 25.0)], "file string, start double, end double")
    rows = {r.file: r for r in M.with_total(M.summaries(ref, cand, gaps)).collect()}
    f, g, t = rows["f"], rows["g"], rows["TOTAL"]
    assert (f.reference_cues, f.candidate_cues, f.missing, f.extra, f.unverified, f.shifted, f.end_mismatches, f.exact_text_matches) == (3, 4, 1, 1, 1, 1, 1, 1)
    assert f.text_edit_distance == 1 + 14 and f.reference_characters == 23 and f.character_error_rate == 15 / 23
    assert (g.reference_cues, g.extra, g.unverified, g.character_error_rate) == (0, 0, 1, 0.0)
    assert t.candidate_cues == 5 and t.character_error_rate == 15 / 23
    gate = M.gate(M.total_row(M.summaries(ref, cand, gaps)), F.lit(1), F.lit(0), {"missing": 0, "cer": 0.01}).first()
    assert gate.enabled and not gate.passed and gate.failures == ["missing 1 > 0", "CER 65.22% > 1.00%"]
    assert M.gate(M.total_row(M.summaries(ref, cand, gaps)), F.lit(0), F.lit(0), {}).first().failures == ["0 fixtures compared"]


def test_top_mismatches(spark):
    df = spark.createDataFrame([("f", k, k, 100 + k, k % 5, float(k % 3), "a", "b") for k in range(50)], "file string, ref_id bigint, ref_ord int, cand_id bigint, edit_distance int, cer double, ref_text string, cand_text string")
    want = sorted(((-(k % 5), -float(k % 3), k) for k in range(50)))[:7]
    got = M.top_per_file(df, 7).orderBy("rank").collect()
    assert [r.ref_id for r in got] == [k for _, _, k in want]
    assert M.top_overall(df, 7).first().targets == 7
