from cuefold.operators import compare as M

CUE = "file string, id bigint, ord int, start double, end double, text string"


def test_details_of_every_kind(spark):
    ref = spark.createDataFrame([("f", 1, 0, 1.0, 2.0, "one"), ("f", 2, 1, 10.0, 11.0, "two cues"), ("f", 3, 2, 20.0, 21.0, "a long line of words"), ("f", 4, 3, 40.0, 41.0, "gone")], CUE)
    cand = spark.createDataFrame([
        ("f", 11, 0, 1.0, 2.5, "one"), ("f", 12, 1, 10.0, 11.0, "two cups"), ("f", 13, 2, 21.0, 22.0, "a long line of words"), ("f", 14, 3, 60.0, 61.0, "x"),
        ("f", 15, 4, 90.0, 91.0, "in the gap"), ("g", 16, 0, 1.0, 2.0, "no reference"),
    ], CUE)
    gaps = spark.createDataFrame([("f", 85.0, 95.0)], "file string, start double, end double")
    got = {(r.kind, r.ref_id, r.cand_id) for r in M.details(ref, cand, gaps).collect()}
    assert got == {
        ("missing", 3, None), ("missing", 4, None), ("end_mismatch", 1, 11), ("text_mismatch", 2, 12), ("shifted", 3, 13), ("extra", None, 13),
        ("extra", None, 14), ("unverified", None, 15), ("unverified", None, 16),
    }
    one = M.details(ref, cand, gaps).where("kind = 'text_mismatch'").first()
    assert (one.rank, one.edit_distance, one.reference_characters, one.cer) == (1, 1, 8, 0.125)
